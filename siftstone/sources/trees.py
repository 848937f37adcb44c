"""Trees of files as a relation: path, size, content as bytes, decoded by the reader that a use needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions.text import basename, glob_regex, suffix

RECON_BYTES, MARKER_BYTES = 1 << 20, 200_000
#: Suffixes of what a run leaves for people.
ARTIFACTS = (".html", ".pdf", ".json", ".log", ".txt")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path below root, size, modified, raw of all files that aren't empty (Spark's reader has no rows for those). Contents are read only where a plan uses them."""
    base = root.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    below = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/*", "/")
    prefix = "/" + base.split("://")[-1].lstrip("/") + "/"
    return rows.select(F.when(below.startswith(prefix), F.substring(below, len(prefix) + 1, 1_000_000)).otherwise(below).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.col("content").alias("raw"))


def scanner_text(raw: Column, latin: bool = True) -> Column:
    """All bytes as Latin-1, which fits any; or as UTF-8 with invalid bytes replaced."""
    return F.decode(raw, "ISO-8859-1") if latin else F.make_valid_utf8(raw.cast("string"))


def recon_text(raw: Column) -> Column:
    """The first mebibyte as UTF-8 if it is valid, else as Latin-1; null if it is empty or holds a zero byte."""
    head = F.substring(raw, 1, RECON_BYTES)
    text = F.when(F.is_valid_utf8(head.cast("string")), head.cast("string")).otherwise(F.decode(head, "ISO-8859-1"))
    return F.when((F.length(head) > 0) & ~F.contains(head, F.lit(bytearray(1))), text)


def marker_text(raw: Column) -> Column:
    """The first 200,000 bytes as UTF-8 without invalid ones."""
    return F.regexp_replace(F.make_valid_utf8(F.substring(raw, 1, MARKER_BYTES).cast("string")), "�", "")


def discovered(paths: DataFrame, globs: list[tuple[str, str]], every: bool = False) -> DataFrame:
    """path, platform: a row for each (platform, glob) whose glob fits the file's name, so a file can be there twice. every: all names with a dot, for each platform."""
    pairs = [(p, "*.*") for p in dict.fromkeys(p for p, _ in globs)] if every else globs
    name = basename(F.col("path"))
    each = [F.when(name.rlike(glob_regex(g)), F.lit(p)) for p, g in pairs]
    return paths.select("path", F.explode(F.array_compact(F.array(*each))).alias("platform"))


def discovery_counts(paths: DataFrame, found: DataFrame) -> DataFrame:
    """One row: files in all, and found (with repeats)."""
    tagged = paths.select(F.lit(1).alias("f"), F.lit(0).alias("g")).unionByName(found.select(F.lit(0).alias("f"), F.lit(1).alias("g")))
    return tagged.agg(F.sum("f").alias("files"), F.sum("g").alias("found"))


def extensions_of(paths: DataFrame) -> DataFrame:
    """extension, files: those of a tree."""
    return paths.select(suffix(F.col("path")).alias("extension")).filter("extension <> ''").groupBy("extension").agg(F.count("*").alias("files"))


def artifacts(tree: DataFrame) -> DataFrame:
    """Distinct paths of what a run left, in order."""
    fits = F.lit(False)
    for s in ARTIFACTS:
        fits = fits | F.lower("path").endswith(s)
    return tree.filter(fits).select("path").distinct().orderBy("path")


def log_tail(raw: Column, chars: int = 120_000) -> Column:
    """The last characters of a log."""
    return F.right(F.make_valid_utf8(raw.cast("string")), F.lit(chars))
