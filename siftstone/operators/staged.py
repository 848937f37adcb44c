"""Batch scans that survive being killed and repeated: stages that are committed once, and rescans of what has changed only.

Rows of a stage's part (a platform, say) are written into a folder of their own attempt, and count from when a row of the manifest names that attempt.
A manifest row is a file that appears whole or not at all, so a killed attempt leaves nothing that readers see; of attempts that were
committed twice the first counts. Readers join what is there with the manifest; which parts are left follows from it, too.

A rescan keeps, for each file's digest, the digests of the rules that it was scanned with, and the evidence by both. Files that are new or
changed are scanned with all rules, others with the rules that are new or changed; evidence of files and rules that are gone is left behind.
"""

from __future__ import annotations

import uuid
from dataclasses import astuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.operators import match, runs
from siftstone.plans.lineage import only_missing

COMMIT = "run string, stage string, part string, attempt string, seq bigint"
RUN = "fingerprint string, run string, seq bigint, status string"
#: Manifest rows up to this number are broadcast to readers.
BROADCAST_COMMITS = 100_000


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What is at path; nothing where it isn't yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        only_missing(error)
        return spark.createDataFrame([], schema)


class Stages:
    """Stages of one run in a folder. Several runs may share the folder."""

    def __init__(self, spark: SparkSession, folder: str, run: str) -> None:
        self.spark, self.folder, self.run = spark, folder.rstrip("/"), run

    @classmethod
    def resume(cls, spark: SparkSession, folder: str, fingerprint: str) -> Stages:
        """The last run with this fingerprint, if it wasn't completed; else a new one."""
        known = _read(spark, f"{folder.rstrip('/')}/runs", RUN)
        own = runs.resumable(known, fingerprint).first()
        out = cls(spark, folder, own["run"] if own else uuid.uuid4().hex)
        out.fingerprint = fingerprint
        out._note("running")
        return out

    def _note(self, status: str) -> None:
        known = _read(self.spark, f"{self.folder}/runs", RUN)
        seq = (known.agg(F.max("seq")).first()[0] or 0) + 1
        self.spark.createDataFrame([(self.fingerprint, self.run, seq, status)], RUN).coalesce(1).write.mode("append").parquet(f"{self.folder}/runs")

    def complete(self) -> None:
        self._note("completed")

    def fail(self, interrupted: bool = False) -> None:
        self._note("interrupted" if interrupted else "failed")

    def commits(self) -> DataFrame:
        """run, stage, part, attempt: one row for each part that is done."""
        found = _read(self.spark, f"{self.folder}/commits", COMMIT).filter(F.col("run") == self.run)
        return found.groupBy("run", "stage", "part").agg(F.min_by("attempt", F.struct("seq", "attempt")).alias("attempt"))

    def latest(self, stage: str) -> str | None:
        """The part of a stage that was committed last."""
        found = _read(self.spark, f"{self.folder}/commits", COMMIT).filter((F.col("run") == self.run) & (F.col("stage") == stage))
        return found.agg(F.max_by("part", "seq").alias("part")).first()["part"]

    def left(self, stage: str, parts: list[str]) -> list[str]:
        """Parts of a stage that aren't done, in their order."""
        done = {r["part"] for r in self.commits().filter(F.col("stage") == stage).select("part").collect()}  # as many as the caller has named
        return [p for p in parts if p not in done]

    def write(self, stage: str, part: str, rows: DataFrame) -> None:
        """Write the rows of a part, and commit them; nothing is done if the part is."""
        if not self.left(stage, [part]):
            return
        attempt = uuid.uuid4().hex
        rows.write.mode("overwrite").parquet(f"{self.folder}/data/{stage}/run={self.run}/attempt={attempt}")
        self.commit(stage, part, attempt)

    def commit(self, stage: str, part: str, attempt: str) -> None:
        seq = _read(self.spark, f"{self.folder}/commits", COMMIT).count()
        self.spark.createDataFrame([(self.run, stage, part, attempt, seq)], COMMIT).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def read(self, stage: str, schema: str) -> DataFrame:
        """part and the rows of a stage, of committed attempts."""
        rows = _read(self.spark, f"{self.folder}/data/{stage}", f"{schema}, run string, attempt string").filter(F.col("run") == self.run)
        done = self.commits().filter(F.col("stage") == stage).select("attempt", "part")
        side = F.broadcast(done) if done.limit(BROADCAST_COMMITS + 1).count() <= BROADCAST_COMMITS else done
        return rows.join(side, "attempt").drop("run", "attempt")


EVIDENCE = "path string, platform string, file_seq bigint, rule_seq int, line int, code string, pass_no int"


def scan(stages: Stages, files: DataFrame, rules: list[match.Rule], platforms: list[str], each=None) -> DataFrame:
    """Evidence of the files of some platforms, a platform a part; done ones aren't scanned again. each: called before a platform is scanned."""
    for platform in stages.left("pattern_matching", platforms):
        if each:
            each(platform)
        own = files.filter(F.col("platform") == platform)
        stages.write("pattern_matching", platform, _cast(match.evidence(own, rules)))
    return stages.read("pattern_matching", EVIDENCE).drop("part")


def _cast(evidence: DataFrame) -> DataFrame:
    return evidence.select(*[F.col(n).cast(kind).alias(n) for n, kind in (x.split(" ") for x in EVIDENCE.split(", "))])


def rule_digest(rule: match.Rule) -> str:
    """Of all that decides what a rule finds; not of its number."""
    import hashlib

    return hashlib.sha256(repr(astuple(rule)[1:]).encode()).hexdigest()


def file_digest() -> Column:
    """Of a file's path (gates may read it), platform and content."""
    return F.sha2(F.concat_ws("\u0000", "path", "platform", F.coalesce("content", F.lit("\u0001"))), 256)


SEEN = "digest string, rules array<string>"
KEPT = "digest string, rule string, line int, code string, pass_no int"


def rescan(spark: SparkSession, files: DataFrame, rules: list[match.Rule], folder: str) -> DataFrame:
    """Evidence of all files (path, platform, content, file_seq; a column `digest`, if there is one, stands for their own) and rules, of which only
    pairs that the folder's last state doesn't have are scanned. The state is written anew, as a version that counts once it is committed."""
    states = Stages(spark, folder, "state")
    last = states.latest("state")
    old = states.read("seen", SEEN).filter(F.col("part") == F.lit(last)), states.read("kept", KEPT).filter(F.col("part") == F.lit(last))
    digests = {rule_digest(r): r.seq for r in rules}
    if len(digests) < len(rules):
        raise ValueError("two rules are the same")
    wanted = F.array(*[F.lit(d) for d in sorted(digests)]).cast("array<string>")
    named = files if "digest" in files.columns else files.withColumn("digest", file_digest())

    seen = old[0].groupBy("digest").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules"))  # one row each; copies of a file are one
    todo = named.join(seen, "digest", "left").withColumn("missing", F.array_except(wanted, F.coalesce("rules", F.array().cast("array<string>")))).filter(F.size("missing") > 0).drop("rules")
    of_rule = F.map_from_arrays(F.array(*[F.lit(d) for d in digests]), F.array(*[F.lit(s) for s in digests.values()])) if digests else F.create_map().cast("map<string,int>")
    distinct = todo.dropDuplicates(["digest"])
    fresh = match.evidence(distinct.withColumn("only", F.transform("missing", lambda d: of_rule[d])), rules, also=("digest",))
    by_seq = F.map_from_arrays(F.array(*[F.lit(s) for s in digests.values()]), F.array(*[F.lit(d) for d in digests])) if digests else F.create_map().cast("map<int,string>")
    fresh = fresh.select("digest", by_seq[F.col("rule_seq")].alias("rule"), F.col("line").cast("int").alias("line"), "code", F.col("pass_no").cast("int").alias("pass_no"))

    current = named.select("digest").distinct()
    held = old[1].drop("part").filter(F.array_contains(wanted, F.col("rule"))).join(current, "digest", "left_semi")
    version = uuid.uuid4().hex  # what a killed rescan has written has another name, and no state
    states.write("kept", version, held.unionByName(fresh))
    states.write("seen", version, current.withColumn("rules", wanted))
    states.write("state", version, spark.createDataFrame([(version,)], "version string"))
    kept = states.read("kept", KEPT).filter(F.col("part") == version)
    return named.select("digest", "path", "platform", "file_seq").join(kept, "digest").select("path", "platform", "file_seq", of_rule[F.col("rule")].alias("rule_seq"), "line", "code", "pass_no")
