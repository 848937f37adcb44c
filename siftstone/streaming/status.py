"""The status of runs as keyed state: a machine of legal transitions over events that may come late, twice and out of order.

Events of a run wait in its state until the watermark has passed them, and are then taken in the order of their time (ties by id), so
that the result doesn't depend on the order in which they came. A transition that isn't legal is told, and changes nothing; a final status stays. A
run that is going on and gives no sign for longer than the timeout has failed, at that moment; timers see to it, without further events.

Most runs have few events, and each call of the state store costs more than such a run's transitions. So runs are dealt over buckets by their hash, and a
bucket is a key of the state: its runs' states are one value, the events that a batch brings one entry of a list, and it has a timer for the next moment
at which something may happen to any of its runs. A bucket holds one run in 4,096, and nothing is shared between buckets.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The statuses of a run, and those that may follow each ("" is a run of which nothing is known).
LEGAL = {"": ("queued", "running"), "queued": ("running", "stopped", "failed"), "running": ("running", "success", "failed", "stopped"), "success": (), "failed": (), "stopped": ()}
#: Statuses that end by themselves when nothing is heard.
GOING_ON = ("queued", "running")
#: Keys of the state. A stream that goes on from its checkpoint needs the number that it began with.
BUCKETS = 1 << 12
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRANSITION = "run string, seq bigint, at timestamp, was string, status string, legal boolean, timed_out boolean"


def step(state: tuple[str, float, int], at: float, status: str, timeout: float) -> tuple[tuple[str, float, int], list[tuple]]:
    """(the state after an event: status, time of the last sign, transitions told so far; what is told of it). Signs of a run that goes on are told only if they change its status."""
    was, last, n = state
    told = []
    if was in GOING_ON and at - last > timeout:
        told.append((n, last + timeout, was, "failed", True, True))
        was, last, n = "failed", last + timeout, n + 1
    legal = status in LEGAL[was]
    if not legal or status != was:
        told.append((n, at, was, status, legal, False))
        n += 1
    return ((status, at, n) if legal else (was, last, n)), told


class Machine(StatefulProcessor):
    """A bucket's runs. runs: pickled {run: state as in `step`}; waiting: for each batch, pickled [(run, at, id, status)]."""

    def __init__(self, timeout: float) -> None:
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getValueState("runs", "rows binary")
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [x for frame in rows for x in zip(*(frame[c].tolist() for c in ("run", "at", "id", "status")), strict=True)]
        if new:
            self.waiting.appendValue((pickle.dumps(new),))
            self.handle.registerTimer(math.ceil(min(x[1] for x in new) * 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) / 1000  # no event before comes any more
        runs = pickle.loads(self.runs.get()[0]) if self.runs.exists() else {}
        waiting = {x for batch in self.waiting.get() for x in pickle.loads(batch[0])} if self.waiting.exists() else set()
        told, moments = [], []
        for run, at, _, status in sorted(x for x in waiting if x[1] <= due):
            runs[run], more = step(runs.get(run, ("", 0.0, 0)), at, status, self.timeout)
            told += [(run, *t) for t in more]
        left = [x for x in waiting if x[1] > due]
        for run, (status, last, n) in runs.items():
            if status in GOING_ON and due - last > self.timeout:
                told.append((run, n, last + self.timeout, status, "failed", True, True))
                runs[run] = ("failed", last + self.timeout, n + 1)
            elif status in GOING_ON:
                moments.append(math.ceil((last + self.timeout) * 1000) + 1)
        if left:
            moments.append(math.ceil(min(x[1] for x in left) * 1000))
        if len(left) < len(waiting):
            self.waiting.put([(pickle.dumps(left),)]) if left else self.waiting.clear()
        if told or len(left) < len(waiting):
            self.runs.update((pickle.dumps(runs),))
        if moments:
            self.handle.registerTimer(min(moments))
        if told:
            run, n, at, was, status, legal, timed_out = zip(*told, strict=True)
            moment = pd.to_datetime(np.rint(np.array(at) * 1e6).astype("datetime64[us]"))
            yield pd.DataFrame({"run": run, "seq": n, "at": moment, "was": was, "status": status, "legal": legal, "timed_out": timed_out})

    def close(self) -> None:
        pass


def transitions(events: DataFrame, timeout: timedelta, late: str) -> DataFrame:
    """run, seq, at, was, status, legal, timed_out of a stream of events (run, ts, id, status). late: how late events may come (a watermark).

    The session's state store must be RocksDB's (`with_state_store`).
    """
    rows = events.withWatermark("ts", late).select(F.col("run").cast("string").alias("run"), "ts", F.unix_micros("ts").cast("double").alias("at"), F.col("id").cast("long").alias("id"), "status")
    rows = rows.withColumn("at", F.col("at") / 1e6)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("run"), F.lit(BUCKETS)).cast("int"))
    return rows.groupBy("bucket").transformWithStateInPandas(Machine(timeout.total_seconds()), TRANSITION, outputMode="append", timeMode="eventTime")


def with_state_store(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def finished(spark, events: DataFrame, timeout: timedelta, late: str, folder: str) -> DataFrame:
    """The transitions of what is there: the stream runs to its end, or goes on from where it ended in this folder."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with_state_store(spark)
    try:
        query = transitions(events, timeout, late).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(TRANSITION).parquet(f"{folder}/out")
