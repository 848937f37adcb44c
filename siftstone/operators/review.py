"""Suppression, baselines and review statuses. Empty fields of an entry mean any; so do patterns that aren't valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from siftstone.functions.text import norm_path, norm_text, with_safe_patterns
from siftstone.plans.lineage import materialize, only_missing

#: Entries up to this number are broadcast.
BROADCAST_ENTRIES = 10_000
STATUSES = ("pending", "confirmed", "false_positive", "suppressed")
#: Statuses that hide a finding.
HIDING = ("false_positive", "suppressed")
ENTRY_FIELDS = ("platform", "rule", "category", "file", "line", "path_regex", "code_regex")


ENTRY_SCHEMA = "platform string, rule_title string, category string, file string, line int, path_regex string, code_regex string"


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a suppression file: an object with a list of them, or an object a line. What can't be read is empty."""
    fields = ENTRY_SCHEMA.replace(" string", ":string").replace(" int", ":int")
    try:
        listed = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"struct<suppressions:array<struct<{fields}>>>")["suppressions"]).alias("e")).select("e.*")
        entries = spark.read.schema(ENTRY_SCHEMA).json(path) if listed.isEmpty() else listed
    except AnalysisException as error:  # no such file
        only_missing(error)
        entries = spark.createDataFrame([], ENTRY_SCHEMA)
    return entries.withColumnRenamed("rule_title", "rule")


def normalised_entries(entries: DataFrame) -> DataFrame:
    """s_platform, s_rule, s_category, s_file, s_line, s_path_regex, s_code_regex with any as the empty string or null."""
    e = with_safe_patterns(entries, "path_regex", "code_regex")
    text = [norm_text(F.col(c)).alias(f"s_{c}") for c in ("platform", "rule", "category")]
    return e.select(*text, norm_path(F.col("file")).alias("s_file"), F.expr("try_cast(line AS int)").alias("s_line"), F.coalesce("path_regex", F.lit("")).alias("s_path_regex"), F.coalesce("code_regex", F.lit("")).alias("s_code_regex"))


def _covers() -> Column:
    any_or = lambda s, f: (F.col(s) == "") | (F.col(s) == F.col(f))
    return (
        any_or("s_platform", "__platform") & any_or("s_rule", "__rule") & any_or("s_category", "__category") & any_or("s_file", "__file") & (F.col("s_line").isNull() | (F.col("s_line") == F.col("line")))
        & ((F.col("s_path_regex") == "") | F.expr("regexp_like(__file, '(?i)' || s_path_regex)")) & ((F.col("s_code_regex") == "") | F.expr("regexp_like(code, '(?i)' || s_code_regex)"))
    )


def _few(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES


def _split(hits: DataFrame, entries: DataFrame, how: str) -> DataFrame:
    """Entries meet hits by equality of what they name: rule and file (a baseline's, at any number a hash join), rule or file alone. Only those
    that name neither are tried on all hits, and must be few. Ways without entries are left out."""
    e = normalised_entries(entries)
    ways = {(True, True): (F.col("__rule") == F.col("s_rule")) & (F.col("__file") == F.col("s_file")), (True, False): F.col("__rule") == F.col("s_rule"), (False, True): F.col("__file") == F.col("s_file"), (False, False): F.lit(True)}
    counts = {(r["x"], r["y"]): r["n"] for r in e.groupBy((F.col("s_rule") != "").alias("x"), (F.col("s_file") != "").alias("y")).agg(F.count("*").alias("n")).collect()}  # four rows at most
    if counts.get((False, False), 0) > BROADCAST_ENTRIES:
        raise ValueError("too many suppression entries name neither a rule nor a file")
    if how == "left_semi" and len(counts) > 1:
        hits = materialize(hits, "hits")  # each way reads them
    named = {"__platform": norm_text(F.col("platform")), "__rule": norm_text(F.col("rule")), "__category": norm_text(F.col("category")), "__file": norm_path(F.col("path"))}
    left, met = hits.withColumns(named), None
    for way, key in ways.items():
        if way not in counts:
            continue
        side = e.filter(((F.col("s_rule") != "") == way[0]) & ((F.col("s_file") != "") == way[1]))
        side = F.broadcast(side) if counts[way] <= BROADCAST_ENTRIES else side
        if how == "left_semi":
            found = left.join(side, key & _covers(), "left_semi")
            met = found if met is None else met.unionByName(found)
        left = left.join(side, key & _covers(), "left_anti")
    out = left if how == "left_anti" else met if met is not None else left.limit(0)
    return out.drop(*named)


def active(hits: DataFrame, entries: DataFrame) -> DataFrame:
    return _split(hits, entries, "left_anti")


def suppressed(hits: DataFrame, entries: DataFrame) -> DataFrame:
    return _split(hits, entries, "left_semi")


def baseline(hits: DataFrame) -> DataFrame:
    """Distinct platform, rule, category, file and line without case; the first spelling stays, by file_seq. Hits of a column `aggregate` of
    "file" give entries without a line, which cover their file."""
    hits = hits.withColumn("line", F.when(F.col("aggregate") != "file", F.col("line"))) if "aggregate" in hits.columns else hits
    keys = [norm_text(F.col("platform")), norm_text(F.col("rule")), norm_text(F.col("category")), norm_path(F.col("path")), F.col("line")]
    grouped = hits.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct("platform", "rule", "category", "path", "line"), F.struct("file_seq", "line", "path")).alias("b"))
    return grouped.select("b.platform", "b.rule", "b.category", F.col("b.path").alias("file"), "b.line")


def as_entries(base: DataFrame) -> DataFrame:
    return base.select("platform", "rule", "category", "file", "line", F.lit(None).cast("string").alias("path_regex"), F.lit(None).cast("string").alias("code_regex"))


def normalised_status(c) -> Column:
    s = norm_text(c)
    return F.when(s.isin(*STATUSES), s).otherwise("pending")


def _first_rule(rows: DataFrame, rules: DataFrame, keys: list[str], key: str, extra: Column | None = None) -> DataFrame:
    """key, status, note: of the first rule (by seq) whose fields are equal to the row's or empty, and that `extra` holds for.

    Rules meet rows by the fields that they name, one join by equality for each set of these, so rules of any number don't meet all
    rows. A rule that names none of them meets all; of such without `extra` only the first can count.
    """
    note = "note" if "note" in rules.columns else F.lit(None).cast("string").alias("note")
    r = rules.select("seq", "status", note, *[norm_text(F.col(k)).alias(f"__{k}") for k in keys], *[c for c in rules.columns if c not in ("seq", "status", "note", *keys)])
    f = rows.select(key, *[norm_text(F.col(k)).alias(f"_{k}") for k in keys], *[c for c in rows.columns if c not in (key, *keys)])
    named = F.array_join(F.array(*[F.when(F.col(f"__{k}") != "", "1").otherwise("0") for k in keys]), "")
    counts = r.groupBy(named.alias("named")).agg(F.count("*").alias("n")).collect()  # a row for each set of fields
    met = None
    for row in counts:
        own = r.filter(named == row["named"])
        given = [k for k, bit in zip(keys, row["named"], strict=True) if bit == "1"]
        if not given and extra is None:
            own = own.orderBy("seq").limit(1)
        elif not given and row["n"] > BROADCAST_ENTRIES:
            raise ValueError("too many review rules name no field")
        on = F.lit(True) if extra is None else extra
        for k in given:
            on = on & (F.col(f"__{k}") == F.col(f"_{k}"))
        found = f.join(F.broadcast(own) if row["n"] <= BROADCAST_ENTRIES or not given else own, on).select(key, "seq", "status", "note")
        met = found if met is None else met.unionByName(found)
    if met is None:
        return rows.select(key).limit(0).withColumns({c: F.lit(None).cast("string") for c in ("status", "note")})
    first = met.groupBy(key).agg(F.min_by(F.struct("status", "note"), "seq").alias("x"))
    return first.select(key, "x.status", "x.note")


def first_status(findings: DataFrame, rules: DataFrame, keys: list[str], key: str) -> DataFrame:
    """findings with status: that of the first rule (by seq) whose fields are equal or empty; pending without one."""
    met = _first_rule(findings.select(key, *keys), rules.select("seq", "status", *keys), keys, key)
    return findings.join(met.select(key, "status"), key, "left").withColumn("status", normalised_status(F.col("status")))


def source_status(findings: DataFrame, evidence: DataFrame, rules: DataFrame, key: str = "finding") -> DataFrame:
    """findings (key, platform, rule, category) with status. A rule (seq, status, platform, rule, category, file, line) fits if its fields do, and
    any evidence (key, path, line) stands in its file and line; of one without file and line none has to."""
    r = rules.withColumn("file", norm_path(F.col("file"))).withColumn("line", F.expr("try_cast(line AS int)"))
    names = ["platform", "rule", "category"]
    places = evidence.select(key, norm_path(F.col("path")).alias("file"), F.col("line").cast("string").alias("line")).distinct()
    placed = findings.select(key, *names).join(places, key).withColumn("row", F.xxhash64(key, "file", "line"))
    at = r.filter("file <> '' or line is not null").select("seq", "status", F.col("seq").cast("string").alias("note"), *names, "file", F.col("line").cast("string").alias("line"))
    # the first rule of each place, then the first of the finding's places and of the rules without a place
    own = _first_rule(placed.select("row", *names, "file", "line"), at, [*names, "file", "line"], "row")
    hit = placed.select(key, "row").join(own, "row").select(key, F.col("note").cast("int").alias("seq"), "status")
    first = hit.unionByName(_with_seq(findings, r, names, key)).groupBy(key).agg(F.min_by("status", "seq").alias("status"))
    return findings.join(first, key, "left").withColumn("status", normalised_status(F.col("status")))


def _with_seq(findings: DataFrame, rules: DataFrame, names: list[str], key: str) -> DataFrame:
    bare = rules.filter("file = '' and line is null").select("seq", "status", F.col("seq").cast("string").alias("note"), *names)
    return _first_rule(findings.select(key, *names), bare, names, key).select(key, F.col("note").cast("int").alias("seq"), "status")


def path_status(findings: DataFrame, paths: DataFrame, rules: DataFrame, key: str = "finding") -> DataFrame:
    """findings (key, rule) with status. A rule (seq, status, rule, path, path_regex) fits if any path (key, path) is its path or fits its pattern; one without both fits all."""
    r = with_safe_patterns(rules, "path_regex").withColumn("path", norm_path(F.col("path"))).withColumn("path_regex", F.coalesce("path_regex", F.lit("")))
    p = paths.select(key, norm_path(F.col("path")).alias("path")).distinct().join(findings.select(key, "rule"), key).withColumn("row", F.xxhash64(key, "path"))
    keep = F.col("seq").cast("string").alias("note")
    found = []
    for rows, own, names, extra in (
        (p.select("row", "rule", "path"), r.filter("path <> ''").select("seq", "status", keep, "rule", "path"), ["rule", "path"], None),
        (p.select("row", "rule", F.col("path").alias("own_path")), r.filter("path_regex <> ''").select("seq", "status", keep, "rule", "path_regex"), ["rule"], F.expr("regexp_like(own_path, '(?i)' || path_regex)")),
    ):
        met = _first_rule(rows, own, names, "row", extra)
        found.append(p.select(key, "row").join(met, "row").select(key, F.col("note").cast("int").alias("seq"), "status"))
    bare = r.filter("path = '' and path_regex = ''").select("seq", "status", keep, "rule")
    found.append(_first_rule(findings.select(key, "rule"), bare, ["rule"], key).select(key, F.col("note").cast("int").alias("seq"), "status"))
    first = found[0].unionByName(found[1]).unionByName(found[2]).groupBy(key).agg(F.min_by("status", "seq").alias("status"))
    return findings.join(first, key, "left").withColumn("status", normalised_status(F.col("status")))


ANALYZER_FIELDS = ("target", "title", "severity", "sink", "source", "file", "line")


def analyzer_status(findings: DataFrame, rules: DataFrame, key: str = "finding") -> DataFrame:
    """findings (key and the analyzer's fields) with status: the first rule whose fields are all equal or empty."""
    text = lambda df: df.withColumns({"file": norm_path(F.col("file")), "line": F.expr("try_cast(line AS int)").cast("string")})
    met = _first_rule(text(findings).select(key, *ANALYZER_FIELDS), text(rules).select("seq", "status", *ANALYZER_FIELDS), list(ANALYZER_FIELDS), key)
    return findings.join(met.select(key, "status"), key, "left").withColumn("status", normalised_status(F.col("status")))


def suppressions_of(rules: DataFrame) -> DataFrame:
    """Suppression entries of the review rules that hide findings."""
    return rules.filter(norm_text(F.col("status")).isin(*HIDING)).select(*[F.col(c) if c in rules.columns else F.lit(None).cast("string").alias(c) for c in ENTRY_FIELDS])


def normalised_review(review: Column) -> Column:
    """A review (status, note, updated_at) with an unknown status as pending and empty texts for nulls."""
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return F.struct(normalised_status(review["status"]).alias("status"), text(review["note"]).alias("note"), text(review["updated_at"]).alias("updated_at"))


def breakdown(findings: DataFrame) -> DataFrame:
    """One row with a count for each status, zero where there is none."""
    return findings.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def kept(findings: DataFrame) -> DataFrame:
    return findings.filter(~F.col("status").isin(*HIDING))


def recounted(findings: DataFrame) -> DataFrame:
    """One row: findings in all, those that are left after review, and those that it hides."""
    return findings.agg(F.count("*").alias("found"), F.count_if(~F.col("status").isin(*HIDING)).alias("left"), F.count_if(F.col("status").isin(*HIDING)).alias("hidden"))


def rules_from(findings: DataFrame) -> DataFrame:
    """Review rules of findings: their platform, rule and first place."""
    first = findings.groupBy("platform", "rule").agg(F.min(F.struct("file_seq", "line", "path")).alias("x"))
    return first.select("platform", "rule", F.col("x.path").alias("file"), "x.line", F.lit("pending").alias("status"))


def path_rules_from(findings: DataFrame) -> DataFrame:
    """Review rules of path findings (rule, path): their rule and first path."""
    return findings.groupBy("rule").agg(F.min("path").alias("path")).select("rule", "path", F.lit("").alias("path_regex"), F.lit("pending").alias("status"))


def analyzer_rules_from(findings: DataFrame) -> DataFrame:
    """Review rules of analyzer findings; without a place of their own that of their first step (trace: array of file, line)."""
    first = F.get(F.col("trace"), F.lit(0))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return findings.select(
        *[text(c).alias(c) for c in ("target", "title", "sink", "source", "severity")], F.coalesce(F.nullif("file", F.lit("")), first["file"], F.lit("")).alias("file"), F.coalesce(F.nullif("line", F.lit(0)), first["line"]).alias("line"), F.lit("pending").alias("status")
    )


EVIDENCE = ["platform", "rule", "file", "line", "code", "promoted"]
FACTS = ["platform", "rule", "category", "score", "level", "severity", "rating", "note"]


def promoted(evidence: DataFrame, facts: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence, facts) of findings after hidden items are made findings again.

    evidence: platform, rule, file, line, code; facts: a row for each platform and rule with FACTS; items: seq and both (file, line, code of what was hidden, and what a person
    says of it, null for nothing). An item is evidence of the finding of its platform and rule, unless it has that file and line; without such a finding it makes one,
    of medium level and 50 points where nothing else is said. Of what several items say the last counts.
    """
    spot = ["platform", "rule", "file", "line"]
    own = items.groupBy(*spot).agg(F.min_by("code", "seq").alias("code")).join(evidence.select(*spot), spot, "left_anti")
    grown = evidence.withColumn("promoted", F.lit(False)).select(*EVIDENCE).unionByName(own.withColumn("promoted", F.lit(True)).select(*EVIDENCE))
    said = [c for c in FACTS if c not in ("platform", "rule", "category")]
    last = items.groupBy("platform", "rule").agg(F.max_by("category", "seq").alias("category"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in said])
    f, i = facts.alias("f"), last.alias("i")
    default = {"score": F.lit(50), "level": F.lit("medium")}
    there = F.col("f.platform").isNotNull()
    both = f.join(i, (F.col("f.platform") == F.col("i.platform")) & (F.col("f.rule") == F.col("i.rule")), "full")
    new = lambda c: F.coalesce(F.col(f"i.{c}"), F.when(there, F.col(f"f.{c}")).otherwise(default.get(c, F.lit(None))))
    return grown, both.select(F.coalesce("f.platform", "i.platform").alias("platform"), F.coalesce("f.rule", "i.rule").alias("rule"), F.coalesce("f.category", "i.category").alias("category"), *[new(c).alias(c) for c in said])
