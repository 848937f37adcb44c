"""The driver's tables in the roles of the engine's relations, and small catalogs of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, platform, content, file_seq from documents."""
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return d.select(path.alias("path"), F.col("lang").alias("platform"), F.col("text").alias("content"), F.col("doc_id").alias("file_seq"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content, file_seq from pages; path is the url without its scheme."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"), F.col("html").alias("content"), F.col("page_id").alias("file_seq"))


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A catalog: as many rows as its literal."""
    return spark.createDataFrame(rows, schema)
