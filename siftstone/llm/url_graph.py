"""URL filters: rules by host and path, then trust and distrust spread over the host graph. DataFrame functions only.

The longest rule that fits a url decides. Hosts start with trust (the share of their pages that a rule allows)
and distrust (the share that a rule blocks). Trust flows along the links between hosts, distrust against them
(a page that links to a blocked host is suspect), both as personalised PageRank. Pages that no rule fits get the
verdict of their host: block if its distrust is over `block_ratio` times its trust, else allow.

Rounds end when all scores together move by less than `tolerance` (the rest of the sum is then below tolerance * damping /
(1 - damping), far less than a host's score that could turn a verdict), or after `max_rounds`.

Nulls: a null url, or one without ://, has an empty host and path; a null html has no links. Urls without any
rule or links are allowed. Of rules of equal length only equal ones can fit one url, of which the last stands. Repeated pages count
again, urls of any length are read whole. An empty table gives an empty result. Extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import lookup_join, materialize, release

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"""(?i)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

#: (rule, verdict); a rule is a host, then the start of a path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def _rest(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*(/[^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. The rules are a parameter, tried longest first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """src, dst, links: absolute links between different hosts. Pre-aggregated before the shuffle, so a hot host is split."""
    found = F.transform(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(HREF), F.lit(0)), lambda m: F.regexp_replace(m, r"""(?is)^href\s*=\s*["']?|["']$""", ""))
    absolute = F.filter(F.transform(found, lambda u: F.when(u.startswith("//"), F.concat(F.lit("http:"), u)).otherwise(u)), lambda u: F.instr(u, "://") > 0)
    links = pages.select(F.col(host).alias("src"), F.explode(absolute).alias("u")).select("src", host_of(F.col("u")).alias("dst"))
    return links.filter("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, max_rounds: int = 60) -> DataFrame:
    """host, trust, distrust. seeds: host, trust0, distrust0. Each round is two joins at host level and ends in a table."""
    out = edges.groupBy("src").agg(F.sum("links").alias("__out"))
    into = edges.groupBy("dst").agg(F.sum("links").alias("__in"))
    weighed = materialize(edges.join(out, "src").join(into, "dst").select("src", "dst", (F.col("links") / F.col("__out")).alias("forward"), (F.col("links") / F.col("__in")).alias("back")), "edges")
    hosts = weighed.select(F.col("src").alias("host")).union(weighed.select(F.col("dst").alias("host"))).union(seeds.select("host")).distinct()
    start = materialize(hosts.join(seeds, "host", "left").select("host", F.coalesce("trust0", F.lit(0.0)).alias("trust0"), F.coalesce("distrust0", F.lit(0.0)).alias("distrust0")), "seeds")
    now = start.select("host", "trust0", "distrust0", ((1 - damping) * F.col("trust0")).alias("trust"), ((1 - damping) * F.col("distrust0")).alias("distrust"))
    if weighed.isEmpty():
        return now.select("host", "trust", "distrust")
    for _ in range(max_rounds):
        ahead = weighed.join(now, weighed["src"] == now["host"]).select(F.col("dst").alias("h"), (F.col("forward") * F.col("trust")).alias("t"), F.lit(0.0).alias("d"))
        against = weighed.join(now, weighed["dst"] == now["host"]).select(F.col("src").alias("h"), F.lit(0.0).alias("t"), (F.col("back") * F.col("distrust")).alias("d"))
        flow = ahead.unionByName(against).groupBy("h").agg(F.sum("t").alias("__t"), F.sum("d").alias("__d"))
        step = now.join(flow, now["host"] == flow["h"], "left").select(
            "host", "trust0", "distrust0",
            ((1 - damping) * F.col("trust0") + damping * F.coalesce("__t", F.lit(0.0))).alias("trust"),
            ((1 - damping) * F.col("distrust0") + damping * F.coalesce("__d", F.lit(0.0))).alias("distrust"),
            F.col("trust").alias("__t0"), F.col("distrust").alias("__d0"),
        )
        step, former = materialize(step, "ranks"), now
        moved = step.agg(F.sum(F.abs(F.col("trust") - F.col("__t0")) + F.abs(F.col("distrust") - F.col("__d0")))).first()[0] or 0.0
        now = step.drop("__t0", "__d0")
        now.table_path = step.table_path
        release(former)
        if moved < tolerance:
            break
    return now.select("host", "trust", "distrust")


def judge_urls(pages: DataFrame, rules=RULES, block_ratio: float = 2.0, damping: float = 0.85, **limits) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for each row of pages (page_id, url, html)."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = split.withColumn("__m", matched_rule(F.col("host"), F.col("path"), rules))
    share = lambda v: F.avg(F.when(F.col("__m.verdict") == v, 1.0).otherwise(0.0))
    seeds = ruled.filter("host <> ''").groupBy("host").agg(share("allow").alias("trust0"), share("block").alias("distrust0"))
    scores = propagate(materialize(host_edges(split), "links"), materialize(seeds, "host-seeds"), damping, **limits)
    known = materialize(scores, "scores")
    blocked = F.coalesce(F.col("distrust") > block_ratio * F.col("trust"), F.lit(False))
    return lookup_join(ruled.drop("html"), known, "host").select("page_id", "host", "path", F.col("__m.rule").alias("rule"), F.coalesce(F.col("__m.verdict"), F.when(blocked, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
