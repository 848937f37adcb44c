"""Growing logs and the status of runs, as streams that stop and start again."""

import os
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from siftstone.streaming import status, tail


def run(spark, folder, to):
    query = tail.growing(spark, str(folder)).writeStream.format("parquet").option("path", f"{to}/out").option("checkpointLocation", f"{to}/state").trigger(once=True).start()
    query.awaitTermination()
    rows = spark.read.schema(tail.SCHEMA).parquet(f"{to}/out").collect()
    return sorted((os.path.basename(r["file"]), r["at"], r["line"], r["done"]) for r in rows if r["line"] is not None), sorted(os.path.basename(r["file"]) for r in rows if r["done"])


def test_each_line_once(spark, tmp_path):
    logs, to = tmp_path / "logs", tmp_path / "run"
    logs.mkdir()
    (logs / "a.log").write_text("one\ntwo\nhalf")
    (logs / "b.txt").write_text("not a log\n")
    assert run(spark, logs, to) == ([("a.log", 0, "one", False), ("a.log", 4, "two", False)], [])
    with (logs / "a.log").open("a") as f:
        f.write(" a line\nthree\n")
    (logs / "c.log").write_text("né\n\n")
    after = [("a.log", 0, "one", False), ("a.log", 4, "two", False), ("a.log", 8, "half a line", False), ("a.log", 20, "three", False), ("c.log", 0, "né", False), ("c.log", 4, "", False)]
    assert run(spark, logs, to) == (after, [])
    assert run(spark, logs, to) == (after, [])  # nothing new
    # rotated: shorter, and as long but another file
    (logs / "a.log").write_text("x\n")
    (logs / "c.log").write_text("other\nlines\nhere")
    (logs / "c.log.done").write_text("")
    lines, done = run(spark, logs, to)
    assert lines == sorted([*after, ("a.log", 0, "x", False), ("c.log", 0, "other", False), ("c.log", 6, "lines", False), ("c.log", 12, "here", False)]) and done == ["c.log"]
    assert run(spark, logs, to) == (lines, done)


@pytest.mark.parametrize(("piece", "look"), [(8, 3), (1, 1), (1 << 20, 1 << 16)])
def test_pieces_at_line_ends(tmp_path, monkeypatch, piece, look):
    monkeypatch.setattr(tail, "PIECE", piece)
    monkeypatch.setattr(tail, "LOOK", look)
    text = "a\n\nlonger line here\nbb\nccc\n" * 5 + "open"
    (tmp_path / "x.log").write_text(text)
    reader = tail.TailReader({"path": str(tmp_path)})
    pieces = reader.partitions(reader.initialOffset(), reader.latestOffset())
    got = [row for p in pieces for row in reader.read(p)]
    assert [r[2] for r in got] == text.split("\n")[:-1] and all(text.encode()[at:].startswith(line.encode()) for _, at, line, _ in got)
    assert (len(pieces) > 1) == (piece < 100)
    assert reader.partitions(reader.latestOffset(), reader.latestOffset()) == []
    assert tail.TailReader({"path": str(tmp_path / "none")}).latestOffset() == {"files": "{}"}


def test_done_is_the_end(spark, tmp_path):
    (tmp_path / "a.log").write_text("x\n")
    (tmp_path / "a.log.done").write_text("")
    assert run(spark, tmp_path, tmp_path / "to")[1] == ["a.log"]
    assert tail.growing(spark, str(tmp_path)).filter(F.col("done")).isStreaming


HOUR = 3600.0


def brute(events, timeout, until):
    out = {}
    for run_, rows in events.items():
        state, told = ("", 0.0, 0), []
        for at, _, s in sorted(set(rows)):
            state, more = status.step(state, at, s, timeout)
            told += more
        if state[0] in status.GOING_ON and until - state[1] > timeout:
            told.append((state[2], state[1] + timeout, state[0], "failed", True, True))
        out[run_] = told
    return out


def test_steps():
    walk = lambda *events: [t[2:] for t in brute({"r": [(h * HOUR, i, s) for i, (h, s) in enumerate(events)]}, 2 * HOUR, 0)["r"]]
    assert walk((0, "queued"), (1, "running"), (2, "running"), (3, "success"), (4, "failed")) == [("", "queued", True, False), ("queued", "running", True, False), ("running", "success", True, False), ("success", "failed", False, False)]
    assert walk((0, "running"), (3, "success")) == [("", "running", True, False), ("running", "failed", True, True), ("failed", "success", False, False)]
    assert walk((0, "success"), (1, "queued"), (2, "stopped"), (3, "success")) == [("", "success", False, False), ("", "queued", True, False), ("queued", "stopped", True, False), ("stopped", "success", False, False)]


def test_runs_out_of_order(spark, tmp_path):
    rng = random.Random(3)
    events = {f"r{k}": [(round(rng.uniform(0, 40), 2) * HOUR, i, rng.choice(["queued", "running", "running", "success", "failed", "stopped"])) for i in range(8)] for k in range(12)}
    every = [(r, a, i, s) for r, rows in events.items() for a, i, s in rows]
    every += rng.sample(every, 10)  # twice
    rng.shuffle(every)
    source, to = tmp_path / "events", tmp_path / "to"
    schema = "run string, ts timestamp, id long, status string"
    put = lambda rows, n: spark.createDataFrame([(r, a, i, s) for r, a, i, s in rows], "run string, at double, id long, status string").select("run", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")).alias("ts"), "id", "status").coalesce(1).write.mode("append").parquet(str(source))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    status.with_state_store(spark)

    def go():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        query = status.transitions(stream, timedelta(hours=6), "50 hours").writeStream.format("parquet").option("path", f"{to}/out").option("checkpointLocation", f"{to}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()

    try:
        put(every[:40], 0)
        go()
        put(every[40:], 1)
        go()  # a restart
        put([("end", 200 * HOUR, 0, "queued")], 2)  # time goes on for all
        go()
        put([("end", 400 * HOUR, 1, "running")], 3)
        go()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {}
    for r in spark.read.schema(status.TRANSITION).parquet(f"{to}/out").orderBy("seq").select("*", (F.unix_micros("at") / 1e6).alias("x")).collect():
        got.setdefault(r["run"], []).append((r["seq"], round(r["x"], 3), r["was"], r["status"], r["legal"], r["timed_out"]))
    wanted = brute(events, 6 * HOUR, 300 * HOUR)
    assert {r: [(n, round(a, 3), *rest) for n, a, *rest in told] for r, told in wanted.items() if told} == {k: v for k, v in got.items() if k != "end"}
    assert got["end"] == [(0, 200 * HOUR, "", "queued", True, False), (1, 206 * HOUR, "queued", "failed", True, True)]


def test_many_runs_share_a_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(status, "BUCKETS", 3)
    rng = random.Random(7)
    events = {f"r{k}": [(round(rng.uniform(0, 40), 2) * HOUR, i, rng.choice(["queued", "running", "running", "success", "stopped"])) for i in range(5)] for k in range(60)}
    every = [(r, a, i, s) for r, rows in events.items() for a, i, s in rows]
    rng.shuffle(every)
    source, to = str(tmp_path / "events"), str(tmp_path / "to")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    status.with_state_store(spark)
    try:
        for rows in (every[:150], every[150:], [("end", 200 * HOUR, 0, "success")]):  # each in a start of its own
            spark.createDataFrame(rows, "run string, at double, id long, status string").select("run", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")).alias("ts"), "id", "status").write.mode("append").parquet(source)
            stream = spark.readStream.schema("run string, ts timestamp, id long, status string").parquet(source)
            query = status.transitions(stream, timedelta(hours=6), "50 hours").writeStream.format("parquet").option("path", f"{to}/out").option("checkpointLocation", f"{to}/state").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
        held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {}
    for r in spark.read.schema(status.TRANSITION).parquet(f"{to}/out").orderBy("seq").select("*", (F.unix_micros("at") / 1e6).alias("x")).collect():
        got.setdefault(r["run"], []).append((r["seq"], round(r["x"], 3), r["was"], r["status"], r["legal"], r["timed_out"]))
    assert got == {r: [(n, round(a, 3), *rest) for n, a, *rest in told] for r, told in brute(events, 6 * HOUR, 150 * HOUR).items() if told}
    assert held <= 3 * 6  # of buckets, not of 60 runs
