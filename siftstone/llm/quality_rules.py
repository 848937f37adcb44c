"""Quality rules by document and by host. DataFrame functions only.

Each text is measured in place: lines and three-word windows are compared inside its own row, so nothing is
exploded or shuffled. A document fails if it has too few words or too many words in repeated windows. Failures
are then counted by host (a column), shrunk towards a beta prior fitted to the hosts' rates by moments, and
hosts whose shrunken rate is over `max_rate` reject all their documents.

Nulls: a null text has no words and fails; a null host is a host of its own. Empty texts have one empty line,
which has no word and so isn't counted. A rate of exactly `max_rate` doesn't reject. Repeated rows count each. Texts of any length are
measured whole. An empty table gives an empty result. Other columns pass `filtered`, whatever their names; the
metrics of `measured` replace columns of the same names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import WORD, let, lookup_join, materialize, sheltering

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    #: Percent of the words that may be in repeated windows.
    max_repeat_percent: int = 50
    #: Shrunken failure rate above which a host is rejected.
    max_rate: float = 0.8


def _repeat_words(words: Column, n: Column) -> Column:
    """Words in three-word windows that occur twice or more. Windows are hashed; only texts with a repeat sort them."""

    def covered(keys: Column) -> Column:
        tagged = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def starts(s: Column) -> Column:
            last = F.size(s)
            twin = lambda e, j: F.when(j > 0, F.element_at(s, j)["k"] == e["k"]).otherwise(False) | F.when(j + 1 < last, F.element_at(s, j + 2)["k"] == e["k"]).otherwise(False)
            return F.array_sort(F.transform(F.filter(s, twin), lambda e: e["i"]))

        def width(p: Column) -> Column:
            last = F.size(p)
            each = F.transform(p, lambda x, j: F.when(j + 1 < last, F.least(F.lit(3), F.element_at(p, j + 2) - x)).otherwise(3))
            return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(tagged, lambda s: let(starts(s), width))

    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    return let(windows, lambda keys: F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(covered(keys)))


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    counted = let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: let(F.size(w), lambda n: F.struct(n.cast("long").alias("n"), _repeat_words(w, n).alias("r"))))
    return df.withColumn("__w", counted).withColumns({
        "n_words": F.col("__w.n"),
        "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": F.col("__w.r"),
    }).drop("__w")


def base_failed(rules: Rules) -> Column:
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def host_rates(flags: DataFrame, host: str, failed: str) -> DataFrame:
    """host, n, failed, rate: the posterior mean under a beta prior with the hosts' own mean and spread.

    One row per host comes out of map-side partial counts, so a hot host is no hot task. The prior is a single
    aggregate over the hosts: between-host variance = weighted variance less the binomial part.
    """
    hosts = materialize(flags.groupBy(host).agg(F.count("*").alias("n"), F.count_if(F.col(failed)).alias("failed")), "hosts")
    totals = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("f"), F.count("*").alias("k")).first()
    mean = (totals["f"] or 0) / (totals["n"] or 1)
    spread = hosts.agg(F.sum(F.col("n") * F.pow(F.col("failed") / F.col("n") - F.lit(mean), 2))).first()[0] or 0.0
    between = spread / (totals["n"] or 1) - mean * (1 - mean) * (totals["k"] or 1) / (totals["n"] or 1)
    # no spread beyond chance: all hosts share the mean
    strength = min(max(mean * (1 - mean) / between - 1, 0.01), 1e6) if between > 0 else 1e6
    return hosts.withColumn("rate", (F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength)))


def judge(df: DataFrame, rules: Rules = Rules(), text: str = "text", host: str = "source", keep=("doc_id",)) -> DataFrame:
    """keep, host, the five metrics, base_failed, host_rate, host_failed, kept. Texts are read once; metrics go through a slim table."""
    slim = measured(df, text).withColumn("base_failed", base_failed(rules))
    slim = materialize(slim.select(*keep, host, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), "measured")
    rates = host_rates(slim, host, "base_failed").select(host, F.col("rate").alias("host_rate"))
    judged = lookup_join(slim, rates, host).withColumn("host_failed", F.col("host_rate") > rules.max_rate)
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


@sheltering
def filtered(df: DataFrame, rules: Rules = Rules(), text: str = "text", host: str = "source") -> DataFrame:
    """The rows of df that pass, with df's columns. Texts are measured once: those that pass on their own are written, beside a count of all
    others by host; rejected hosts reach them by a checked broadcast."""
    flagged = _flag(df, rules, text)
    passing = materialize(flagged.withColumn(text, F.when(~F.col("__failed"), F.col(text))), "passing")
    rates = host_rates(passing.select(host, "__failed"), host, "__failed")
    rejected = materialize(rates.filter(F.col("rate") > rules.max_rate).select(host, F.lit(True).alias("__bad")), "rejected")
    return lookup_join(passing.filter(~F.col("__failed")), rejected, host).filter(F.col("__bad").isNull()).select(*[F.col(f"`{c}`") for c in df.columns])


def _flag(df: DataFrame, rules: Rules, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    counted = let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: let(F.size(w), lambda n: F.struct(n.cast("long").alias("n"), F.when(n < rules.min_words, 0).otherwise(_repeat_words(w, n)).alias("r"))))
    fails = lambda c: (c["n"] < rules.min_words) | (100 * c["r"] > rules.max_repeat_percent * c["n"])
    return df.withColumn("__failed", let(counted, fails))
