"""Graphs of flows, families and promotion, against plain Python."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from siftstone.operators import flows, reports, review

STEPS = ["handle(q)", "svc.save(name, x)", "x = request.q", "run(x)", "", "a.b.load(y) + save(z)"]


def names(text):
    return {w for w in re.findall("[A-Za-z_][A-Za-z0-9_]*", text or "") if len(w) >= 3}


def brute_graph(path, xref):
    """One reference after the other, with counters for each step."""
    called = [[c.split(".")[-1] for c in re.findall(r"([a-z_][\w.]*)\s*\(", s[3].lower())] if s[2] == "call" else [] for s in path]
    used, out, related = Counter(), [], 0
    for i, (kind, resolved, symbol, context, _, _) in enumerate(xref):
        role = (kind or "xref").lower()
        anchors = [k for k, c in enumerate(called) if resolved and resolved.lower() in c]
        if not anchors:
            tail = [k for k in range(max(0, len(path) - 5), len(path)) if names(path[k][3]) & names(" ".join([resolved, symbol, context]))]
            anchors = tail[:1]
        free = lambda a: used[a, role] < {"callsite": 6, "definition": 4}.get(role, 3) and len(out) < 18
        at = next((a for a in anchors if free(a)), None)
        if at is not None:
            out.append((f"p{at}", f"x{i}", "xref", role))
        elif path and related < 2 and free(len(path) - 1):
            at, related = len(path) - 1, related + 1
            out.append((f"p{at}", f"x{i}", "xref_related", "related"))
        else:
            continue
        used[at, role] += 1
    return [(f"p{k - 1}", f"p{k}", "path", f"step {k}") for k in range(1, len(path))] + out


def test_graph_references(spark):
    rng, rows = random.Random(6), []
    for seq in range(120):
        path = [(f"d/f{k % 3}.py", k, rng.choice(["call", "assign", "source", "sink"]), rng.choice(STEPS), "") for k in range(rng.randint(0, 8))]
        xref = [(rng.choice(["callsite", "definition", "Other", ""]), rng.choice(["save", "handle", "Load", "", "nothing"]), rng.choice(["", "svc.save"]), rng.choice(["", "request of it", "zzz"]), "lib/x.py", i) for i in range(rng.choice([0, 3, 40]))]
        rows.append((seq, path, xref))
    df = spark.createDataFrame(rows, f"flow_seq int, path {flows.PATH}, xref array<{flows.REFERENCE}>")
    found = {r["flow_seq"]: r for r in flows.path_graph(df).collect()}
    wanted = {seq: brute_graph(path, xref) for seq, path, xref in rows}
    assert {k: [tuple(e) for e in r["edges"]] for k, r in found.items()} == wanted
    assert {e[2] for w in wanted.values() for e in w} == {"path", "xref", "xref_related"} and max(sum(e[2] != "path" for e in w) for w in wanted.values()) == 18
    for seq, path, _ in rows:
        hung = [e for e in wanted[seq] if e[2] != "path"]
        assert len(found[seq]["steps"]) == max(0, len(path) - 1) + min(8, len(hung)) and None not in found[seq]["steps"]
        assert found[seq]["narrative"].startswith("Trace, from left to right: " + (" -> ".join(s[2].upper() for s in path) or "NO PATH")) and f"related: {sum(e[2] == 'xref_related' for e in hung)})" in found[seq]["narrative"]


def test_graph_words(spark):
    path = [("a/main.py", 2, "source", "x = request.q", "x"), ("a/main.py", 3, "call", "svc.save(x)", "x"), ("b.py", 9, "sink", "run(x)", "x")]
    df = spark.createDataFrame([(1, path, [("definition", "save", "svc.save", "", "lib/svc.py", 4), ("", "", "odd", "", "c.py", 1)])], f"flow_seq int, path {flows.PATH}, xref array<{flows.REFERENCE}>")
    assert flows.path_graph(df).first()["steps"] == [
        "Data goes from SOURCE (main.py:2) to CALL SAVE (main.py:3).", "Data goes from CALL SAVE (main.py:3) to SINK (b.py:9).", "CALL SAVE (main.py:3) has the definition save (svc.py:4).", "Beside SINK: odd (c.py:1).",
    ]


def test_families_and_vectors(spark):
    rng = random.Random(7)
    rows = [(i, f"k{i % 3}", rng.choice(["confirmed", "open"]), rng.choice(["Complete", "partial"]), f"f{rng.randrange(5)}", rng.choice([*flows.SEVERITIES, "odd"]), rng.randrange(100), rng.choices(["form", "header", "path"], k=rng.randrange(3))) for i in range(200)]
    df = spark.createDataFrame(rows, "rank int, family string, status string, trace_status string, file string, severity string, risk int, vectors array<string>")
    got = {(r["family"], r["status"]): (r["flows"], r["complete"], r["files"], r["severity"], r["risk"], r["vectors"]) for r in flows.families(df).collect()}
    worst = lambda rs: min((flows.SEVERITIES.index(r[5]) if r[5] in flows.SEVERITIES else 4 for r in rs))
    for key in {r[1:3] for r in rows}:
        own = [r for r in rows if r[1:3] == key]
        assert got[key] == (len(own), sum(r[3] == "Complete" for r in own), len({r[4] for r in own}), flows.SEVERITIES[min(worst(own), 3)], max(r[6] for r in own), dict(Counter(v for r in own for v in set(r[7]))))
    assert sum(r["flows"] for r in flows.family_files(df).collect()) == 200
    assert {(r["vector"], r["flows"], r["example"]) for r in flows.vector_counts(df).collect()} == {(v, sum(v in r[7] for r in rows), min(r[0] for r in rows if v in r[7])) for v in ("form", "header", "path")}
    assert flows.families(df.limit(0)).count() == 0


def test_promotion(spark):
    evidence = spark.createDataFrame([("py", "r", "a", 1, "x"), ("py", "r", "b", 2, "y")], "platform string, rule string, file string, line int, code string")
    facts = spark.createDataFrame([("py", "r", "c", 70, "high", "High", None, "old"), ("js", "q", "c", 10, "low", None, None, None)], "platform string, rule string, category string, score int, level string, severity string, rating string, note string")
    items = spark.createDataFrame(
        [(1, "py", "r", "c", "a", 1, "again", None, None, None, None, "n1"), (2, "py", "r", "c", "c", 3, "new", 90, None, None, None, None), (3, "py", "r", "c", "c", 3, "twice", None, None, "Low", None, "n2"), (4, "go", "s", "d", "e", 5, "z", None, None, None, "r", None)],
        "seq int, platform string, rule string, category string, file string, line int, code string, score int, level string, severity string, rating string, note string",
    )
    grown, after = review.promoted(evidence, facts, items)
    assert {tuple(r) for r in grown.collect()} == {("py", "r", "a", 1, "x", False), ("py", "r", "b", 2, "y", False), ("py", "r", "c", 3, "new", True), ("go", "s", "e", 5, "z", True)}
    assert {tuple(r) for r in after.collect()} == {("py", "r", "c", 90, "high", "Low", None, "n2"), ("js", "q", "c", 10, "low", None, None, None), ("go", "s", "d", 50, "medium", None, "r", None)}
    runs = spark.createDataFrame([(i, i % 2) for i in range(9)], "id int, project int")
    assert [r["id"] for r in reports.latest(runs, [F.desc("id")], F.col("project") == 1, 2).collect()] == [7, 5] and reports.latest(runs, [F.desc("id")]).count() == 9
