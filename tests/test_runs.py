"""Markers, runs, summaries and streams on small tables."""

import pytest
from pyspark.sql import functions as F

from siftstone.functions import classify
from siftstone.functions import text as T
from siftstone.operators import flows, markers, match, runs
from siftstone.operators.markers import Marker
from siftstone.operators.match import Rule
from siftstone.plans import lineage
from siftstone.streaming import scan

FILES = [
    ("p", "src/App.json", '{"dependencies": {"React-Native": "1"}, "scripts": {"vue": "x"}}'), ("p", "a.c", ""), ("q", "Pubspec.yaml", "x\n flutter :\n"), ("q", "b.cpp", ""), ("q", "c.JS", "x"), ("q", "d.js", "x"), ("r", "package.json", "{broken"), ("r", "e.swift", None),
]
MARKERS = [Marker("native", "dep", "*.json", "react-native"), Marker("vue", "dep", "*", "vue"), Marker("flutter", "content", "pubspec.yaml", r"(?m)^\s*flutter\s*:"), Marker("c", "name", "*.c*"), Marker("web", "count", ".js .ts", least=2), Marker("web3", "count", ".js", least=3)]


def test_markers(spark):
    files = spark.createDataFrame(FILES, "project string, path string, content string")
    got = lambda **k: {tuple(r) for r in markers.detected(files, MARKERS, **k).collect()}
    assert got() == {("p", "native"), ("q", "flutter"), ("p", "c"), ("q", "c"), ("q", "web")}
    assert got(implied={"flutter": ("android", "ios")}, retracted=(("c", ".c", ".cpp .cc"),)) == {("p", "native"), ("q", "flutter"), ("q", "android"), ("q", "ios"), ("p", "c"), ("q", "web")}
    auto = markers.auto_detected(files, [("swift", "*.swift"), ("flutter", "*.cpp")], ("flutter",), markers.detected(files, MARKERS[2:3]))
    assert {tuple(r) for r in auto.collect()} == {("r", "swift"), ("q", "flutter")}
    assert markers.detected(files.limit(0), MARKERS).count() == 0 and markers.detected(files, []).count() == 0
    paths = spark.createDataFrame([("a", "ios", "X/kit.xml", ["*.m"]), ("b", "ios", "x/KIT.xml", ["*.h", "*.m"]), ("c", "ios", "y.xml", [])], "framework string, platform string, pack string, globs array<string>")
    found = spark.createDataFrame([("p", "a"), ("p", "b")], "project string, platform string")
    assert [(r["names"], r["globs"]) for r in markers.packs(found, paths).collect()] == [(["a", "b"], ["*.h", "*.m"])]
    rows = spark.createDataFrame([("Android", 2, 2), ("android", 1, 2), ("ts", 0, 0), ("odd", 0, 0), ("java", 0, 0)], "p string, k int, j int")
    assert [r["e"] for r in rows.select(markers.engine(F.col("p"), {"ts": "js"}, ("kotlin", "java", "js"), F.col("k"), F.col("j")).alias("e")).collect()] == ["kotlin", "java", "js", None, "java"]


def test_runs(spark):
    rows = spark.createDataFrame([("f", 1, "failed", "a"), ("f", 2, "running", "b"), ("g", 1, "completed", "c"), ("h", 3, "interrupted", "d")], "fingerprint string, seq int, status string, note string")
    assert runs.resumable(rows, "f").first()["note"] == "b" and runs.resumable(rows, "g").count() == 0 and runs.resumable(rows, "none").count() == 0
    print_ = lambda *v: spark.range(1).select(runs.fingerprint(*[F.lit(x) for x in v]).alias("x")).first()["x"]
    assert print_("a", 1) == print_("a", 1) != print_("a", 2)
    states = spark.createDataFrame([(1, "discovery", "running", 1), (1, "discovery", "completed", 2), (1, "reporting", "failed", 3)], "run int, stage string, status string, seq int")
    assert {r["stage"] for r in runs.stages_left(states).collect()} == set(runs.STAGES) - {"discovery"}
    assert runs.to_scan(spark.createDataFrame([("a",), ("b",)], "platform string"), spark.createDataFrame([("a",)], "platform string")).first()["platform"] == "b"
    assert runs.kept_every(every=1) == {"processingTime": "5 seconds"} and runs.kept_every() == {"processingTime": "30 seconds"}
    assert runs.scan_options({"rules": "php, java,", "recon": "yes", "formats": 3}) == {"rules": ["php", "java"], "recon": True, "estimate": False, "review": True, "resume": False, "loc": True, "baseline": None, "formats": ["html"]}
    assert spark.range(1).select(runs.now_in("Asia/Tokyo").alias("a"), runs.now_in("no/where").alias("b")).first()["a"] > spark.range(1).select(runs.now_in("UTC").alias("a")).first()["a"]
    assert flows.Profile().with_own({"base": 1, "buckets": (("x", 1),), "odd": 2}) == flows.Profile(base=1, buckets=(("x", 1),))


def test_bundle_and_progress(spark, tmp_path):
    spark.createDataFrame([(1,)], "a int").write.json(str(tmp_path / "summary"))
    got = runs.bundle(spark, str(tmp_path))
    assert set(got) == set(runs.BUNDLE) and got["summary"].count() == 1 and got["recon"].count() == 0
    hits, seen = runs.with_progress(match.evidence(spark.createDataFrame([("a", "p", "x\nx", 4)], "path string, platform string, content string, file_seq long"), [Rule(1, "c", "x", "x")]), "seen")
    hits.write.parquet(str(tmp_path / "hits"))
    assert seen.get["matches"] == 2 and seen.get["cursor"] == 4


def test_streams(spark, tmp_path):
    logs, to = tmp_path / "logs", str(tmp_path / "run")
    logs.mkdir()
    (logs / "a.log").write_text("\x1b[31mone\x1b[0m\r\ntwo\n")
    assert sorted(r["line"] for r in scan.log_lines(spark, str(logs), to).collect()) == ["one", "two"]
    (logs / "b.log").write_text("three\n")
    assert sorted(r["line"] for r in scan.log_lines(spark, str(logs), to).collect()) == ["one", "three", "two"]
    table = str(tmp_path / "events.parquet")
    rows = [(i, f"2024-01-{1 + i % 9:02d} 10:00:00", i % 3, "click" if i % 2 else "error") for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp")).repartition(7).write.parquet(table)
    windows = {(str(r["start"])[:10], r["event_type"]): r["n"] for r in scan.run_windows(spark, table, late="20 days").collect()}
    assert sum(windows.values()) == 60 and len(windows) == 18
    beat = runs.Heartbeat()
    spark.streams.addListener(beat)
    try:
        assert {r["user_id"]: r["runs"] for r in scan.last_status(spark, table).collect()} == {0: 20, 1: 20, 2: 20}
    finally:
        spark.streams.removeListener(beat)


def test_tables_are_freed(spark):
    t = lineage.materialize(spark.range(5), "freed")
    assert t.count() == 5
    lineage.release(t, None, spark.range(1))
    with pytest.raises(Exception):  # noqa: B017
        t.count()


def test_classes(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(classify.kinds(F.lit("SQL in a command"))) == ["sql_injection", "command_injection"] and len(classify.KINDS) == 26 and len(classify.HINTS) == 15
    assert one(classify.blocked(F.lit("xss"), F.lit("x = shell_exec(y)"))) and not one(classify.blocked(F.lit("ssrf"), F.lit("shell_exec("))) and not one(classify.blocked(F.lit("odd"), F.lit("realpath")))
    s = one(classify.input_surface(F.array(F.lit("$x = $_POST['name']; call('/api/save')"))))
    assert (s["channel"], s["methods"], s["uris"], s["params"], s["examples"]) == ("api", ["POST"], ["/api/save"], ["name"], ["POST /api/save body: name"])
    assert one(classify.input_surface(F.array(F.lit("data = socket.recv(9)"))))["channel"] == "network-app" and one(classify.input_surface(F.array(F.lit("x"))))["channel"] == "code-path"
    path = lambda *steps: F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("code")) for r, c in steps])
    assert one(classify.attack_vectors(path(("source", "request cookie x"), ("sink", "getenv [session]")), F.lit("web-app"), F.lit(""))) == ["endpoint", "user_input", "session_state", "cookie_input", "environment"]
    assert one(classify.attack_vectors(path(("assign", "x")), F.lit("code-path"), F.lit(""))) == ["code_path"]
    assert one(classify.display_name(F.lit("DOTNET"))) == ".NET" and one(classify.display_name(F.lit("my_kit"))) == "My Kit"
    assert one(T.norm_text(F.lit("\u00a0\t A\n"))) == "a"
