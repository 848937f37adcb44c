"""Results as files: appended findings, recon and flow tables, payloads, counters, baselines and review rules."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.operators import match, recon, review
from siftstone.plans.lineage import materialize, only_missing


def append_findings(rows: DataFrame, path: str, fmt: str = "json") -> None:
    """Findings or suppressed rows beside those of earlier calls; each call writes files of its own, so a lost task writes its own again."""
    rows.write.mode("append").format(fmt).save(path)


def write_evidence(hits: DataFrame, rules: list[match.Rule], path: str) -> None:
    """Findings with their evidence: one row for each rule and part of a list."""
    found = match.findings(hits, rules).select("rule_seq", "rule_id", "rule", "category", "issue_scope", "score", "level")
    append_findings(match.nested(hits).join(F.broadcast(found), "rule_seq"), path)  # as many as rules


def write_path_findings(matches: DataFrame, path: str) -> None:
    """rule_seq, n, score, level and the paths of each, in parts of a thousand."""
    part = F.pmod(F.xxhash64("path"), F.greatest(F.ceil(F.col("n") / 1000), F.lit(1)))
    scored = match.path_findings(matches)
    lists = matches.join(F.broadcast(scored), "rule_seq").groupBy("rule_seq", "n", "score", "level", part.alias("part")).agg(F.sort_array(F.collect_list("path")).alias("filepath"))
    lists.write.mode("overwrite").json(path)


def write_recon(found: DataFrame, path: str) -> None:
    """Two tables: files by category and technology with their confidence, partitioned by category; and the summary."""
    rows = materialize(found, "recon")
    rows.select("category", "name", "path", F.expr(recon.LABEL).alias("confidence")).write.mode("overwrite").partitionBy("category").json(f"{path}/files")
    recon.summary(rows).write.mode("overwrite").json(f"{path}/summary")


def write_flows(flows: DataFrame, path: str) -> None:
    """Ranked flows in a folder for each platform."""
    flows.write.mode("overwrite").partitionBy("platform").parquet(path)


def write_payload(targets: DataFrame, path: str) -> None:
    """A row for each target and one for all: sums, and the mean risk."""
    total = targets.agg(F.lit("summary").alias("target"), F.sum("flows").alias("flows"), F.sum("confirmed").alias("confirmed"), F.bround(F.avg("risk"), 0).cast("int").alias("risk"))
    targets.select("target", "flows", "confirmed", "risk").unionByName(total).write.mode("overwrite").json(path)


def write_paths(files: DataFrame, path: str, count_lines: bool = False) -> None:
    """The clean list of paths, with effective lines if asked for."""
    rows = files.select("path", recon.effective_lines(F.col("content")).alias("loc")) if count_lines else files.select("path")
    rows.distinct().write.mode("overwrite").json(path)


#: Keys whose values are sets and are united.
UNITED = "identified_extensions"


def merged_summary(old: DataFrame, new: DataFrame) -> DataFrame:
    """key (a dotted path), value (array of strings): new values replace old ones; those of extensions are united and sorted."""
    o, n = old.select(F.col("key"), F.col("value").alias("was")), new.select(F.col("key"), F.col("value").alias("now"))
    union = F.sort_array(F.array_union(F.coalesce("was", F.array().cast("array<string>")), F.coalesce("now", F.array().cast("array<string>"))))
    return o.join(n, "key", "full").select("key", F.when(F.contains("key", F.lit(UNITED)), union).otherwise(F.coalesce("now", "was")).alias("value"))


def upsert_summary(spark: SparkSession, path: str, new: DataFrame) -> DataFrame:
    """Merge new values into the summary at path, each version beside the last: readers of the last one are not disturbed."""
    versions = f"{path}/version="
    try:
        all_ = spark.read.schema("key string, value array<string>, version int").parquet(path)
        last = all_.agg(F.max("version")).first()[0]
    except AnalysisException as error:  # the first
        only_missing(error)
        last = None
    old = spark.createDataFrame([], "key string, value array<string>") if last is None else all_.filter(F.col("version") == last).drop("version")
    merged_summary(old, new).coalesce(1).write.mode("overwrite").parquet(f"{versions}{(last or 0) + 1}")
    return spark.read.schema("key string, value array<string>").parquet(f"{versions}{(last or 0) + 1}")


def nested_summary(rows: DataFrame) -> DataFrame:
    """depth, parent, key: the tree that dotted keys make, parents included."""
    parts = F.split("key", r"\.")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i - 1), ".").alias("parent"), F.array_join(F.slice(parts, F.lit(1), i), ".").alias("key")))
    return rows.select(F.explode(steps).alias("s")).select("s.*").distinct()


def write_baseline(hits: DataFrame, path: str) -> None:
    """The suppression entries that hide what was found."""
    review.baseline(hits).withColumnRenamed("rule", "rule_title").write.mode("overwrite").json(path)


def write_review(source: DataFrame, paths: DataFrame, analyzer: DataFrame, path: str) -> None:
    """Review rules of the findings that a person hid, by kind."""
    every = None
    for kind, rows in (("source", source), ("path", paths), ("analyzer", analyzer)):
        own = rows.filter(F.col("status").isin(*review.HIDING)).withColumn("kind", F.lit(kind))
        every = own if every is None else every.unionByName(own, allowMissingColumns=True)
    every.write.mode("overwrite").partitionBy("kind").json(path)


def copy_summary(spark: SparkSession, path: str, to: str) -> None:
    """The summary's last version as JSON."""
    all_ = spark.read.schema("key string, value array<string>, version int").parquet(path)
    last = all_.agg(F.max("version").alias("version"))
    all_.join(F.broadcast(last), "version").select("key", "value").coalesce(1).write.mode("overwrite").json(to)


def page(title: str, headings: list[str], cells: list[Column]) -> Column:
    """A row of an HTML report, escaped; reports are such rows between a head and a foot."""
    from siftstone.functions.text import html_escape

    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), html_escape(F.coalesce(c.cast("string"), F.lit(""))), F.lit("</td>")) for c in cells], F.lit("</tr>"))
    head = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{title}</title></head><body><table><tr>" + "".join(f"<th>{h}</th>" for h in headings) + "</tr>"
    return F.struct(F.lit(head).alias("head"), row.alias("row"), F.lit("</table></body></html>").alias("foot"))


def write_html(rows: DataFrame, title: str, columns: list[str], path: str) -> None:
    """A report as text: each file is a page of its own, so its size is bounded by that of a partition."""
    html = rows.select(page(title, columns, [F.col(c) for c in columns]).alias("p")).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    pages = html.groupBy("part").agg(F.first("p.head").alias("head"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "p.row"))), lambda x: x["row"]), "\n").alias("rows"), F.first("p.foot").alias("foot"))
    pages.select(F.concat_ws("\n", "head", "rows", "foot").alias("value")).write.mode("overwrite").text(path)
