"""Scan runs: fingerprints and resuming, progress, bundles of a run's results, and lists for people."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from siftstone.plans.lineage import only_missing

#: Statuses of a run that can go on, and the stages in their order.
RESUMABLE = ("running", "failed", "interrupted")
STAGES = ("discovery", "pattern_matching", "path_analysis", "reporting")
#: Seconds: a run's state is first kept after, then every, and never more often than.
FIRST_KEPT, EVERY, LEAST = 300, 30, 5


def fingerprint(*settings: Column) -> Column:
    """Of the settings of a run: equal settings, equal fingerprint."""
    return F.sha2(F.to_json(F.struct(*settings)), 256)


def resumable(runs: DataFrame, wanted: str | Column) -> DataFrame:
    """The last run (by seq) with this fingerprint, if it can go on."""
    own = runs.filter(F.col("fingerprint") == wanted)
    last = own.groupBy("fingerprint").agg(F.max_by(F.struct(*[c for c in runs.columns if c != "fingerprint"]), "seq").alias("r"))
    return last.select("fingerprint", "r.*").filter(F.col("status").isin(*RESUMABLE))


def stages_left(states: DataFrame) -> DataFrame:
    """run, stage of the stages that a run hasn't completed. states: run, stage, status, seq; the last status of a stage counts."""
    last = states.groupBy("run", "stage").agg(F.max_by("status", "seq").alias("status"))
    every = states.select("run").distinct().withColumn("stage", F.explode(F.array(*[F.lit(s) for s in STAGES])))
    return every.join(last.filter("status = 'completed'"), ["run", "stage"], "left_anti")


def to_scan(platforms: DataFrame, done: DataFrame) -> DataFrame:
    """Platforms of a run that aren't completed yet."""
    return platforms.join(done, "platform", "left_anti")


def kept_every(first: int = FIRST_KEPT, every: int = EVERY) -> dict[str, str]:
    """The trigger of a stream whose state is kept in these steps."""
    return {"processingTime": f"{max(every, LEAST)} seconds"} if first >= 0 else {"availableNow": True}  # type: ignore[dict-item]


def with_progress(hits: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """hits, and what was seen of them once they are written: rows, rules and files, without a further scan."""
    seen = Observation(name)
    return hits.observe(seen, F.count(F.lit(1)).alias("matches"), F.approx_count_distinct("rule_seq").alias("rules"), F.approx_count_distinct("path").alias("files"), F.max("file_seq").alias("cursor")), seen


class Heartbeat(StreamingQueryListener):
    """Keeps the last sign of life of each stream: time, rows and batch."""

    def __init__(self) -> None:
        self.beats: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        self.beats[str(event.id)] = {"at": event.timestamp, "status": "running", "rows": 0, "batch": -1}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        beat = self.beats.setdefault(str(p.id), {"rows": 0})
        beat |= {"at": p.timestamp, "status": "running", "rows": beat["rows"] + p.numInputRows, "batch": p.batchId}

    def onQueryIdle(self, event) -> None:
        self.beats.setdefault(str(event.id), {"rows": 0})["at"] = event.timestamp

    def onQueryTerminated(self, event) -> None:
        self.beats.setdefault(str(event.id), {"rows": 0})["status"] = "failed" if event.exception else "completed"


BUNDLE = ("source_findings", "path_findings", "analysis", "suppressed", "summary", "recon", "reviews")


def bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The data sets of a run; one that isn't there is empty."""
    found = {}
    for name in BUNDLE:
        try:
            found[name] = spark.read.json(f"{folder}/{name}")
        except AnalysisException as error:  # not written
            only_missing(error)
            found[name] = spark.createDataFrame([], "missing string")
    return found


def analysis_results(flows: DataFrame, fallback: DataFrame, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """(taint, fallback) results for reports: at most `most` of each platform by rank, with defaults for what is missing."""
    filled = flows.select("platform", "rank", F.coalesce("title", F.lit("Data flow")).alias("title"), F.coalesce("severity", F.lit("Low")).alias("severity"), F.coalesce("risk", F.lit(0)).alias("risk")).filter(F.col("rank") <= most)
    return filled, fallback.join(filled.select("platform").distinct(), "platform", "left_anti")


def vulnerability_order() -> list[Column]:
    return [F.desc("risk"), F.asc("kind"), F.asc("file"), F.asc("line")]


def mitigation_families(items: DataFrame) -> DataFrame:
    """kind, title, platform: number of places, files (some of them), first line of each family."""
    return items.groupBy("kind", "title", "platform").agg(F.count("*").alias("places"), F.count_distinct("path").alias("files"), F.min(F.struct("path", "line")).alias("first")).select("kind", "title", "platform", "places", "files", F.col("first.path").alias("path"), F.col("first.line").alias("line"))


def rule_index(hits: DataFrame) -> DataFrame:
    """rule, n: most hits first, ties by name."""
    return hits.groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule")


def file_index(hits: DataFrame) -> DataFrame:
    return hits.groupBy("path").agg(F.count("*").alias("n"), F.count_distinct("rule_seq").alias("rules")).orderBy(F.desc("n"), "path")


def now_in(zone: str | None) -> Column:
    """The present time in a zone; that of the session where none is given or it isn't known."""
    from zoneinfo import ZoneInfo

    try:
        return F.convert_timezone(None, F.lit(str(ZoneInfo(zone or ""))), F.current_timestamp().cast("timestamp_ntz"))
    except (KeyError, ValueError, OSError):
        return F.current_timestamp().cast("timestamp_ntz")


def scan_options(options: dict) -> dict:
    """Options of a scan with defaults: what isn't given, or isn't of its type, falls back; lists are cut at commas."""
    defaults: dict = {"rules": ["auto"], "recon": False, "estimate": False, "review": True, "resume": False, "loc": True, "baseline": None, "formats": ["html"]}
    out = {}
    for key, value in defaults.items():
        own = options.get(key, value)
        if isinstance(value, list):
            own = [x.strip() for x in own.split(",") if x.strip()] if isinstance(own, str) else own if isinstance(own, list) and own else value
        elif isinstance(value, bool):
            own = own if isinstance(own, bool) else str(own).strip().lower() in ("1", "true", "yes")
        out[key] = own
    return out


def options_text(options: dict) -> str:
    return json.dumps(scan_options(options), sort_keys=True)
