"""Tables in the session's shared folder. They cut long lineages, so that jobs survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def shared_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Without it a temporary folder, but on a local master only, whose tasks all see this machine's disk."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return tempfile.mkdtemp(prefix="siftstone-")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder; it goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = f"{shared_base(spark)}/siftstone-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session has ended; the shared folder is then swept by its owner
        pass


def only_missing(error: AnalysisException) -> None:
    """Raise an error again unless it says that a path isn't there: what can't be read isn't empty."""
    if "PATH_NOT_FOUND" not in (error.getCondition() or "") and "Path does not exist" not in str(error):
        raise error


#: Rows for which a table whose number of rows is bounded has a file.
FILE_ROWS = 4096


def materialize(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back. Cuts the lineage and outlives lost executors.

    rows: as many as df has at most, if that is known; then no more tasks write it than these rows need. A small table that a shuffle deals
    over hundreds of partitions is hundreds of files otherwise, for each of which a local disk's writer starts processes.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex[:12]}"
    (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete tables that materialize made and that no plan reads any more. Other DataFrames are left alone."""
    for t in tables:
        path = getattr(t, "table_path", None)
        if path:
            _remove(t.sparkSession, path)


def release_all(spark: SparkSession) -> None:
    """Delete all tables of the application: for long sessions, when no earlier result is read any more."""
    _remove(spark, shared_dir(spark))


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint()
