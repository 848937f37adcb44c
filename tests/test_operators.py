"""Operators on literal fixtures with hand-made expectations."""

import re

import pytest
from pyspark.sql import functions as F

from siftstone.functions import scoring
from siftstone.functions import text as T
from siftstone.operators import extract, flows, match, recon, reports, review
from siftstone.operators.match import Rule
from siftstone.streaming import scan


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\r\nb\rc\n\nd", "a\x0bb\x0cc\x1cd\x1ee", "a\u0085b\u2028c\u2029d", "\n", "\n\n"])
def test_lines_are_those_of_splitlines(spark, text):
    assert one(spark, T.lines_of(F.lit(text))) == text.splitlines()


@pytest.mark.parametrize(("glob", "path"), [("*.py", "a/b.py"), ("a?c", "abc"), ("[!x]*", "yes"), ("[a-c]z", "bz"), ("x.y", "xzy"), ("*", ""), ("(a)+", "(a)+"), ("a/*", "a/b/c")])
def test_globs(spark, glob, path):
    from fnmatch import fnmatchcase

    assert one(spark, T.matches_glob(F.lit(path), glob)) == fnmatchcase(path, glob)


def test_small_functions(spark):
    assert one(spark, T.truncated(F.lit("x" * 301))) == "x" * 75 + ".." and one(spark, T.truncated(F.lit("x" * 300))) == "x" * 300
    assert one(spark, T.named_counts(F.lit("a b[3], c, d[10]"))) == [("a b", 3), ("d", 10)]
    assert one(spark, T.elapsed(F.lit(3_723_004))) == "01Hr:02Min:03s:004ms"
    assert one(spark, T.host_path(F.lit("C:\\a\\b"))) == "/host/c/a/b" and one(spark, T.slug(F.lit("--"))) == "item"
    assert T.safe_pattern("(") is None and T.safe_pattern("(?P<a_b>x)") == "(?<ab>x)"
    assert one(spark, scoring.half_even(F.lit(2.5))) == 2 and one(spark, scoring.half_even(F.lit(3.5))) == 4
    assert [one(spark, scoring.path_confidence(F.lit(n))) for n in (0, 1, 2, 5, 6, 40)] == [50, 56, 62, 80, 86, 86]
    assert one(spark, recon.normalised_extensions(F.array(*map(F.lit, ("PY", " .Js ", "*", ""))))) == [".py", ".js", "*"]


FILES = "path string, platform string, content string, file_seq long"
RULES = [Rule(1, "c", "run", r"run\(", gate="WHEN PRESENT get_input"), Rule(2, "c", "none", r"run\(", gate="WHEN MISSING get_input"), Rule(3, "d", "x", "x", exclude="skip")]


def code(spark):
    return spark.createDataFrame([("a.py", "py", "a = get_input()\nrun(a)\nRUN(a)\nx skip\nX\n" + "x" * 501, 1), ("b.py", "py", "x\nx\n", 2), ("e.py", "py", "", 3), ("n.py", "py", None, 4)], FILES)


def test_evidence(spark):
    got = sorted((r["path"], r["rule_seq"], r["line"], r["pass_no"]) for r in match.evidence(code(spark), RULES).collect())
    assert got == [("a.py", 1, 2, 0), ("a.py", 1, 3, 1), ("b.py", 3, 1, 0), ("b.py", 3, 2, 0)]
    scores = {r["rule_seq"]: (r["n"], r["score"]) for r in match.findings(match.evidence(code(spark), RULES), RULES).collect()}
    # 28 + 2n + 2 files + regex 8 + gate 6 + text 2, and 10 less, as no line has taint and a sink
    assert scores == {1: (2, 28 + 4 + 2 + 8 + 6 + 2 - 10), 3: (2, 28 + 4 + 2 + 8 + 2 - 10)}
    assert [r["rule_seq"] for r in match.unmatched(RULES, match.evidence(code(spark), RULES)).collect()] == [2]
    assert match.evidence(code(spark).limit(0), RULES).count() == 0


def test_scores_of_findings_without_a_direct_line(spark):
    rules = [Rule(1, "c", "plain", "hello", has_text=False), Rule(2, "c", "direct", "exec"), Rule(3, "c", "sinks", "token"), Rule(4, "c", "by file", "hello", aggregate="file", has_text=False)]
    lines = lambda n, x: "\n".join([x] * n)
    score = lambda text: {r["rule_seq"]: r["score"] for r in match.findings(match.evidence(spark.createDataFrame([("a", "p", text, 1)], FILES), rules), rules).collect()}
    assert score(lines(3, "hello world")) == {1: 28 + 6 + 2 + 8 - 10, 4: 28 + 2 + 2 + 8 - 10}
    assert score(lines(11, "hello")) == {1: 28 + 10 + 2 + 8 - 10, 4: 30} and score(lines(12, "hello")) == {1: 28 + 10 + 2 + 8 - 10 - 6, 4: 30}
    # a direct line: 12, its taint 4, its dynamic sink 4; sinks alone with a plain variable: 4 off each, and 8 if all are
    assert score("exec(request + 1)") == {2: 28 + 2 + 2 + 8 + 2 + 12 + 4 + 4} and score("exec(request)") == {2: 28 + 2 + 2 + 8 + 2 + 12 + 4}
    assert score("token($a)") == {3: 28 + 2 + 2 + 8 + 2 + 4 - 4 - 10 - 8}


def test_evidence_of_a_file_is_whole(spark):
    hits = match.evidence(spark.createDataFrame([("a", "p", "\n".join(["x"] * 120), 1)], FILES), [Rule(1, "c", "x", "x")])
    row = match.by_file(hits).first()
    assert row["matches"] == 120 and row["lines"] == list(range(1, 121)) and row["codes"][0] == "x"


def test_gates_without_patterns(spark):
    rules = [Rule(1, "c", "anchored", "", gate="WHEN PRESENT run"), Rule(2, "c", "bare", "", gate="WHEN EXPR PRESENT:run"), Rule(3, "c", "failing", "x", gate="WHEN PRESENT nothing")]
    f = spark.createDataFrame([("a", "p", "RUN\nx\nX", 1), ("e", "p", "", 2)], FILES)
    assert sorted((r["rule_seq"], r["line"], r["pass_no"]) for r in match.evidence(f, rules[:1]).collect()) == [(1, 1, 1)]
    assert [tuple(r) for r in match.placeholders(f, [Rule(2, "c", "bare", "", gate="WHEN EXPR PRESENT:RUN"), rules[0]]).collect()] == [("a", 2, 1, "[condition holds]")]
    assert sorted((r["rule_seq"], r["line"], r["pass_no"], r["reason"]) for r in match.gate_suppressed(f, rules).collect()) == [(3, 2, 0, "required pattern is absent"), (3, 3, 1, "required pattern is absent")]


def test_path_rules(spark):
    paths = spark.createDataFrame([("src/A.py",), ("lib/b.js",)], "path string")
    rules = [Rule(1, "p", "py", r"\.PY$"), Rule(2, "p", "gate", "never", gate="WHEN PRESENT /^.src/"), Rule(3, "p", "all", ".", exclude="lib"), Rule(4, "p", "none", "")]
    assert sorted((r["path"], r["rule_seq"]) for r in match.path_matches(paths, rules).collect()) == [("src/A.py", 1), ("src/A.py", 2), ("src/A.py", 3)]
    assert sorted(r["rule_seq"] for r in match.path_misses(paths, rules).collect()) == [1, 2, 3, 4]


def test_score_bounds(spark):
    grid = spark.createDataFrame([(n, f, d, t, s, b, p, o) for n in (0, 3, 40) for f in (0, 9) for d in (0, 2) for t in (0, 9) for s in (0, 4) for b in (0, 4) for p in (0, 9) for o in (0, 4)], "n int, f int, d int, t int, s int, b int, p int, o int")
    yes = F.lit(True)
    score = scoring.source_confidence(*[F.col(c) for c in "nfdtsbpo"], yes, yes, yes)
    rows = grid.select("n", "d", score.alias("x")).collect()
    assert all(10 <= r["x"] <= 96 for r in rows) and all(r["x"] <= 74 for r in rows if r["d"] == 0) and all(r["x"] <= 68 for r in rows if r["d"] == 0 and r["n"] >= 12)


def test_context_and_whole_file(spark):
    rules = [Rule(1, "c", "b", "^b$", before=2, after=5)]
    f = spark.createDataFrame([("f", "p", "a\nb\nc\nb", 1)], FILES)
    assert sorted((r["line"], r["before"], r["after"]) for r in match.with_context(f, rules).collect()) == [(2, ["a"], ["c", "b"]), (4, ["b", "c"], [])]
    g = spark.createDataFrame([("f", "p", "x\nbegin\nk=1\nend\nbegin k=2 end", 1)], FILES)
    got = sorted((r["line"], r["code"], r["groups"]["v"]) for r in match.file_matches(g, r"begin.*?k=(?<v>\d).*?end", ("v",)).collect())
    assert got == [(2, "begin", "1"), (5, "begin k=2 end", "2")]


ENTRY = "platform string, rule string, category string, file string, line int, path_regex string, code_regex string"


def test_suppression(spark):
    hits = match.evidence(code(spark), RULES).withColumn("rule", F.concat(F.lit("R"), F.col("rule_seq").cast("string"))).withColumn("category", F.lit("C"))
    keep = lambda *e: review.active(hits, spark.createDataFrame([e], ENTRY)).count()
    assert keep(None, None, None, None, None, None, None) == 0
    assert keep("PY", "r1", None, None, None, None, None) == 2 and keep(None, None, None, ".\\B.PY", None, None, None) == 4 and keep(None, None, None, "B.PY", None, None, None) == 2
    assert keep(None, None, None, None, 2, None, None) == 2 and keep(None, None, None, None, None, "A[.]", "^run") == 2
    base = review.baseline(hits.unionByName(hits.withColumn("rule", F.lower("rule"))))
    assert base.count() == 4 and review.active(hits, review.as_entries(base)).count() == 0


def test_many_entries_meet_by_key(spark, monkeypatch):
    hits = match.evidence(code(spark), RULES).withColumn("rule", F.concat(F.lit("R"), F.col("rule_seq").cast("string"))).withColumn("category", F.lit("C"))
    entries = spark.createDataFrame([(None, "r1", None, None, 2, None, None), (None, None, None, "b.py", 1, None, None), (None, None, None, None, 3, None, None)], ENTRY)
    few = (sorted(map(repr, review.active(hits, entries).collect())), sorted(map(repr, review.suppressed(hits, entries).collect())))
    monkeypatch.setattr(review, "BROADCAST_ENTRIES", 1)
    assert few == (sorted(map(repr, review.active(hits, entries).collect())), sorted(map(repr, review.suppressed(hits, entries).collect())))
    assert (len(few[0]), len(few[1])) == (1, 3)
    with pytest.raises(ValueError):
        review.active(hits, entries.filter("rule is null and file is null").unionByName(entries.filter("line = 3")))


def test_invalid_patterns_are_no_constraint(spark):
    hits = match.evidence(code(spark), RULES).withColumn("rule", F.lit("R")).withColumn("category", F.lit("C"))
    entries = spark.createDataFrame([("py", None, None, None, 2, "(", None), (None, None, None, "b.py", None, None, "[")], ENTRY)
    assert sorted((r["path"], r["line"]) for r in review.active(hits, entries).collect()) == [("a.py", 3)]
    odd = spark.createDataFrame([(None, "  R\u00a0", "\tc", None, None, None, None)], ENTRY)
    assert review.active(hits, odd).count() == 0  # white space of any kind


def test_reviews_of_all_kinds(spark):
    found = spark.createDataFrame([("k1", "A", "x", "c"), ("k2", "b", "y", "c"), ("k3", "b", "z", "d")], "finding string, platform string, rule string, category string")
    evidence = spark.createDataFrame([("k1", "S\\a.py", 3), ("k1", "s/b.py", 9), ("k2", "s/a.py", 4), ("k3", "q", 1)], "finding string, path string, line int")
    rule = "seq int, status string, platform string, rule string, category string, file string, line string"
    got = lambda *rules: {r["finding"]: r["status"] for r in review.source_status(found, evidence, spark.createDataFrame(list(rules), rule)).collect()}
    assert got((2, "confirmed", "", "", "C", "", None), (1, "suppressed", "", "", "", "s/A.py ", "3"), (3, "false_positive", "", "z", "", "", "x")) == {"k1": "suppressed", "k2": "confirmed", "k3": "false_positive"}
    assert got((1, "confirmed", "", "", "", "", "4"), (2, "suppressed", "b", "", "", "", None)) == {"k1": "pending", "k2": "confirmed", "k3": "suppressed"}
    paths = spark.createDataFrame([("k1", "x/one.py"), ("k1", "two.js"), ("k2", "three.md")], "finding string, path string")
    named = found.filter("finding <> 'k3'").select("finding", "rule")
    prule = "seq int, status string, rule string, path string, path_regex string"
    pgot = lambda *rules: {r["finding"]: r["status"] for r in review.path_status(named, paths, spark.createDataFrame(list(rules), prule)).collect()}
    assert pgot((3, "confirmed", "", "", ""), (2, "suppressed", "", "", "TWO"), (1, "false_positive", "Y", "x/one.py", "")) == {"k1": "suppressed", "k2": "confirmed"}
    assert pgot((1, "suppressed", "x", "X\\One.py", ""), (2, "confirmed", "y", "", "(")) == {"k1": "suppressed", "k2": "confirmed"}
    a = spark.createDataFrame([("k1", "t", "T", "High", "s", "u", "f.py", "7")], "finding string, target string, title string, severity string, sink string, source string, file string, line string")
    arule = "seq int, status string, target string, title string, severity string, sink string, source string, file string, line string"
    agot = lambda *rules: review.analyzer_status(a, spark.createDataFrame(list(rules), arule)).first()["status"]
    assert agot((1, "confirmed", "other", "", "", "", "", "", None), (2, "suppressed", "T", "t", "high", "S", "", "F.py", "7")) == "suppressed" and agot((1, "confirmed", "", "", "", "", "", "", "8")) == "pending"
    assert [tuple(r) for r in review.path_rules_from(spark.createDataFrame([("r", "b"), ("r", "a")], "rule string, path string")).collect()] == [("r", "a", "", "pending")]
    t = spark.createDataFrame([("t", "T", "s", None, "High", "", 0, [("g.py", 4)])], "target string, title string, sink string, source string, severity string, file string, line int, trace array<struct<file:string,line:int>>")
    assert review.analyzer_rules_from(t).first().asDict() == {"target": "t", "title": "T", "sink": "s", "source": "", "severity": "High", "file": "g.py", "line": 4, "status": "pending"}


def test_first_rule_wins(spark):
    f = spark.createDataFrame([("k1", "A", "x"), ("k2", "b", "y"), ("k3", "c", "z")], "key string, platform string, rule string")
    r = spark.createDataFrame([(2, "confirmed", "", ""), (1, "FALSE_POSITIVE", "a", ""), (3, "suppressed", "b", "y")], "seq int, status string, platform string, rule string")
    got = {x["key"]: x["status"] for x in review.first_status(f, r, ["platform", "rule"], "key").collect()}
    assert got == {"k1": "false_positive", "k2": "confirmed", "k3": "confirmed"}
    assert review.breakdown(review.first_status(f, r.limit(0), ["platform", "rule"], "key")).first().asDict() == {"pending": 3, "confirmed": 0, "false_positive": 0, "suppressed": 0}


def test_line_counts(spark):
    count = lambda *lines: one(spark, recon.effective_lines(F.lit("\n".join(lines))))
    text = ["x = 1", "", "# c", "/* open", "inside", "close */", "y = 2 /* both */", "z", '"""doc"""', "w", "'''", "in", "'''", "v"]
    assert count(*text) == len(["x", "z", "w", "in", "v"])  # a triple quote opens and closes on its own line
    assert count("a */ b", "* note", "\t \u00a0", "-- c", "x") == 2  # a closer without an opener means nothing
    assert count("/* a", "", "<!-- b", "c -->", "x", "/* open", "y") == 1 and one(spark, recon.effective_lines(F.lit("a\r\nb\rc\n"))) == 3 and one(spark, recon.effective_lines(F.lit(None).cast("string"))) == 0

    def brute(lines):
        n, inside = 0, False
        for line in map(str.strip, lines):
            if not line:
                continue
            inside = inside or any(x in line for x in ("/*", '"""', "'''", "<!--"))
            if inside:
                inside = not any(x in line for x in ("*/", '"""', "'''", "-->"))
                continue
            n += not line.startswith(("#", "//", "--", "*"))
        return n

    import random

    rng = random.Random(1)
    for _ in range(30):
        lines = ["".join(rng.choice(["x", "/*", "*/", "<!--", "-->", '"""', " ", "#", "*", "\t"]) for _ in range(rng.randrange(4))) for _ in range(12)]
        assert count(*lines) == brute(lines), lines


def test_effort_bands(spark):
    bands = spark.createDataFrame([("b", 1, 10, 0.5, 1.0), ("b", 11, 40, 1.0, 2.0)], "kind string, lo int, hi int, min_days double, max_days double")
    counts = lambda n: spark.createDataFrame([("t", n, "b")], "tech string, files int, kind string")
    assert [tuple(recon.effort(counts(n), bands).first())[2:] for n in (10, 11, 40)] == [(0.5, 1.0), (1.0, 2.0), (1.0, 2.0)]
    with pytest.raises(Exception, match="no band for t"):
        recon.effort(counts(0), bands).collect()


def test_intervals(spark):
    f = spark.createDataFrame([("a", [], [("p", 20)]), ("b", ["a"], [("p", 40)]), ("c", [], [("q", 20)]), ("d", [], [("p", 0)]), ("e", ["b"], [("x", 1), ("p", None)]), ("f", [], [("w", 500)]), ("g", [], []), ("h", [], [("p", 45)])], "finding string, kinds array<string>, places array<struct<path:string,line:int>>")
    g = spark.createDataFrame([(["b"], 2, [("p", 32)]), (["b"], 1, [("p", 8), ("z", 1)]), (["b"], 0, [("p", 7)]), ([], 5, [("p", 53)]), (["a"], 6, [("w", None)]), ([], 7, [("v", 1), ("w", 488)])], "kinds array<string>, rank int, points array<struct<path:string,line:int>>")
    # 12 lines away, 13 lines away; kinds that don't overlap; no line in the finding, none in the flow
    assert {r["finding"]: r["rank"] for r in flows.nearest_flow(f, g).collect()} == {"a": 1, "d": 0, "e": 0, "f": 6, "h": 5} or {r["finding"]: r["rank"] for r in flows.nearest_flow(f, g).collect()} == {"a": 1, "d": 0, "e": 0, "f": 6, "h": 5, "b": 5}


def test_numbers_of_a_global_order(spark):
    rows = [(i * 7919 % 1000, i) for i in range(1000)]
    got = flows.numbered(spark.createDataFrame(rows, "a int, b int").repartition(4), [F.desc("a"), F.asc("b")]).collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["rank"])] == sorted(rows, key=lambda x: (-x[0], x[1])) and {r["rank"] for r in got} == set(range(1, 1001))
    assert flows.numbered(spark.createDataFrame([], "a int"), [F.asc("a")]).count() == 0


def test_block_depth(spark):
    assert tuple(one(spark, flows.block_depth(F.array(*map(F.lit, ("a {", "b { {", "} }", "}", "c")))))) == (3, 3) and tuple(one(spark, flows.block_depth(F.array(F.lit("{"))))) == (1, None)


def test_reachable(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(3, 0), (0, 5)], "a int, b int")
    got = {r["node"]: r["depth"] for r in flows.reachable(edges, spark.createDataFrame([(0,)], "node int"), 7).collect()}
    assert got == {0: 0, 1: 1, 5: 1, 2: 2, 6: 2, 3: 3, 7: 3, 4: 4, 8: 4, 9: 5, 10: 6, 11: 7}


def test_bars(spark):
    c = spark.createDataFrame([("x", 3), ("y", 1), ("z", 1)], "k string, n int")
    assert [tuple(r) for r in reports.bars(c, "k", "n", 2).collect()] == [("x", 3, 100.0, 75.0), ("y", 1, 33.33, 25.0)]


def test_extraction():
    text = "def f(a, b=1, *c):\n  x = request.q\n  y = x\n  exec(g(y), 'a(b', [1, 2])\n  x = 1\n  exec(x)\ndef g(): pass"
    assert extract.functions(text) == [("f", 1, 6, ["a", "b", "c"]), ("g", 7, 7, [])] and extract.functions("")[0][0] == "<file>"
    assert extract.calls("exec(g(y), 'a(b', [1, 2])") == [("exec", ["g(y)", "'___'", "[1, 2]"]), ("g", ["y"])]


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    rows = [(i, f"run({i}) get_input\nx", "en", f"s{i % 2}", 1) for i in range(20)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    table = str(tmp_path / "docs.parquet")
    spark.createDataFrame(rows[:12], schema).repartition(3).write.parquet(table)
    to = str(tmp_path / "run")
    assert scan.scan_arriving(spark, table, RULES, to).count() == 24
    spark.createDataFrame(rows[12:], schema).write.mode("append").parquet(table)
    got = scan.scan_arriving(spark, table, RULES, to)
    f = spark.read.parquet(table).select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.col("lang").alias("platform"), F.col("text").alias("content"), F.col("doc_id").alias("file_seq"))
    assert got.count() == 40 and got.exceptAll(match.evidence(f, RULES)).count() == 0


def test_patterns_are_safe_for_java():
    assert all(re.compile(r.regex) for r in RULES)


def test_nested_lists_hold_all_hits_of_many_ranges(spark):
    hits = spark.range(40_000).select(F.when(F.col("id") < 39_000, 1).otherwise(2).alias("rule_seq"), (F.col("id") % 4000).alias("file_seq"), F.concat(F.lit("p"), (F.col("id") % 4000).cast("string")).alias("path"), F.lit(0).alias("pass_no"), (F.col("id") / 4000).cast("int").alias("line"), F.concat(*[F.sha2(F.concat_ws("-", "id", F.lit(k)), 256) for k in range(3)]).alias("code"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        lists = match.nested(hits, 50).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for rule in (1, 2):
        parts = [[(int(e["file"][1:]), e["line"]) for e in r["evidence"]] for r in sorted(lists, key=lambda r: r["part"]) if r["rule_seq"] == rule]
        entries = [x for p in parts for x in p]
        assert entries == sorted(entries) and len(entries) == (39_000, 1000)[rule - 1] and max(map(len, parts)) <= 50
