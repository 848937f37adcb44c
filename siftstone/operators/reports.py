"""Rollups of findings and runs: counters, bars, top lists, dashboards, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counters(findings: DataFrame) -> DataFrame:
    """Counts by platform, by category, by rule and in all, in one pass."""
    return findings.groupingSets([["platform"], ["category"], ["rule"], []], "platform", "category", "rule").agg(
        F.when(F.grouping("platform") == 0, "platform").when(F.grouping("category") == 0, "category").when(F.grouping("rule") == 0, "rule").otherwise("all").alias("scope"),
        F.count("*").alias("n"),
    ).select("scope", F.coalesce(F.col("platform"), F.col("category"), F.col("rule"), F.lit("all")).alias("label"), "n")


def bars(counts: DataFrame, label: str, value: str, top: int) -> DataFrame:
    """The top labels by value, ties by label, with their width against the largest (2 digits) and their share among them (1 digit)."""
    kept = counts.orderBy(F.desc(value), label).limit(top)
    whole = Window.partitionBy()  # at most `top` rows
    width = F.bround(F.col(value) / F.max(value).over(whole) * 100, 2)
    share = F.bround(F.col(value) / F.sum(value).over(whole) * 100, 1)
    return kept.select(label, value, width.alias("width"), share.alias("share"))


def top_files(findings: DataFrame, per_rule: int, top: int) -> DataFrame:
    """Files by hits, counting the first files of each rule only."""
    files = findings.groupBy("rule_seq", "path").agg(F.min("file_seq").alias("file_seq"))
    first = files.withColumn("place", F.row_number().over(Window.partitionBy("rule_seq").orderBy("file_seq", "path"))).filter(F.col("place") <= per_rule)
    return first.groupBy("path").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "path").limit(top)


def daily_activity(runs: DataFrame, time: str, days: int = 7) -> DataFrame:
    """Runs on each of the last days, zero where there were none. The last day is that of the last run."""
    last = runs.agg(F.to_date(F.max(time)).alias("d"))
    calendar = last.select(F.explode(F.sequence(F.date_sub("d", days - 1), F.col("d"), F.expr("interval 1 day"))).alias("day"))
    counts = runs.groupBy(F.to_date(time).alias("day")).agg(F.count("*").alias("n"))
    return F.broadcast(calendar).join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("runs"))


def latest(runs: DataFrame, order: list, project: Column | None = None, most: int = 50) -> DataFrame:
    """The last runs, of one project (a condition) if it is given."""
    return (runs if project is None else runs.filter(project)).orderBy(*order).limit(most)


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """base with updates: new values where given, else the old ones; new keys added."""
    b, u = base.alias("b"), updates.alias("u")
    joined = b.join(u, [F.col(f"b.{k}") == F.col(f"u.{k}") for k in keys], "full")
    return joined.select(*[F.coalesce(f"b.{k}", f"u.{k}").alias(k) for k in keys], *[F.coalesce(f"u.{v}", f"b.{v}").alias(v) for v in values])


def share_of_success(ok, n):
    return F.round(F.when(n > 0, ok * 100.0 / n).otherwise(0.0), 2)
