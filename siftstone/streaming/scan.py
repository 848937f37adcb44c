"""Streaming forms of the engine: files scanned as they arrive, runs counted in windows, the latest status of each key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions.text import strip_terminal
from siftstone.operators import match
from siftstone.plans.lineage import shared_dir


def folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the rows of a parquet table; only new files are read when it starts again from its checkpoint.

    The path is given as a pattern, as a table may be a folder or one file.
    """
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 4).parquet(f"{path[:-1]}[{path[-1]}]")


def scan_arriving(spark: SparkSession, path: str, rules: list[match.Rule], to: str | None = None) -> DataFrame:
    """Evidence of all rules in documents that arrived since the last call with the same folder. Rows are appended once."""
    to = to or folder(spark)
    d = arriving(spark, path)
    files = d.select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.col("lang").alias("platform"), F.col("text").alias("content"), F.col("doc_id").alias("file_seq"))
    hits = match.evidence(files, rules)
    query = hits.writeStream.format("parquet").option("path", f"{to}/out").option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(hits.schema).parquet(f"{to}/out")


def run_windows(spark: SparkSession, path: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, event_type, n: runs by status and window of time. The watermark ends the state of windows that no late run can change any more."""
    counts = arriving(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return _updated(spark, counts.select(F.col("window.start").alias("start"), "event_type", "n"), ["start", "event_type"])


def last_status(spark: SparkSession, path: str) -> DataFrame:
    """The latest status of each project; the state is one row a project."""
    latest = arriving(spark, path).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("runs"))
    return _updated(spark, latest, ["user_id"])


def _updated(spark: SparkSession, df: DataFrame, keys: list[str]) -> DataFrame:
    """Run to the end of what is there. A batch writes what it changed into a folder of its own, again if it is repeated; of a key the last batch's row counts."""
    to = folder(spark)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{to}/out/batch={number}")

    query = df.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, batch int").parquet(f"{to}/out")
    rest = [c for c in df.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")


def log_lines(spark: SparkSession, path: str, to: str | None = None) -> DataFrame:
    """seq, line: the lines of arriving log files, without terminal codes, each once; a further call with the same folder goes on where the last one ended."""
    to = to or folder(spark)
    raw = spark.readStream.format("text").load(path)
    lines = raw.select(strip_terminal(F.col("value")).alias("line"), F.col("_metadata.file_path").alias("file"))
    query = lines.writeStream.format("parquet").option("path", f"{to}/out").option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("line string, file string").parquet(f"{to}/out")
