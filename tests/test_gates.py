"""The gate language: parsing, compilation against an interpreter, first failing gate."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftstone.plans import gates

TEXTS = ["", "a", "B b", "call(x) and token", "line one\nline two", "x = f(a) && g", "[a-z]", "GNU license", "Licensed under"]


def test_parse():
    p = gates.parse("# note\nreport as Title here\nwhen present /a/i\nWHEN nothing x\nTRACE one\nTRACE two\nFAIL_REASON no\nREASON yes\nOBSERVE PROJECT_HAS_GLOB *.x AS label\nUNLESS CURRENT_FILE_MATCHES b")
    assert p.gates == [("WHEN PRESENT", "/a/i"), ("UNLESS CURRENT_FILE_MATCHES", "b")] and p.title == "Title here"
    assert (p.reason, p.fail_reason, p.trace, p.observes, p.anchor) == ("yes", "no", ["one", "two"], [("*.x", "label")], "/a/i")
    assert gates.parse("").gates == []


def test_token_patterns():
    assert gates.token_pattern("/a.b/is") == "(?is)a.b" and gates.token_pattern("/a/") == "a" and gates.token_pattern("raw") == "(?im)raw"
    assert gates.token_pattern("") is None and gates.token_pattern("/[/") is None and gates.token_pattern("//") is None


def test_split_modes():
    operators = lambda expr, strict: [(m, d) for m, _, d in gates.marks(expr, strict) if m in ("||", "&&")]
    expr = r"PRESENT:f\( && PRESENT:g"
    assert operators(expr, True) == [("&&", 0)] and operators(expr, False) == [("&&", 1)]
    assert operators("(a && b) || c", False) == [("&&", 1), ("||", 0)]
    assert operators("PRESENT:[(] && PRESENT:g", True) == [("&&", 0)] and operators("PRESENT:[(] && PRESENT:g", False) == [("&&", 1)]
    assert operators("PRESENT:a\\) && (b || c)", False) == [("&&", 0), ("||", 1)]


@pytest.mark.parametrize(
    ("expr", "text", "want"),
    [
        (r"MISSING://\s*safe", "x = 1", True), (r"MISSING://\s*safe", "x = 1 // SAFE", False), ("PRESENT:/api/", "an api", False), ("PRESENT:/api/", "GET /API/x", True), ("PRESENT:/a/i", "a", False),
        ("PRESENT:^b$", "a\nb", True), ("(PRESENT:a)", "a", True), ("((PRESENT:a) && !(PRESENT:b))", "a", True), ("(PRESENT:a) PRESENT:b", "ab", False), ("!PRESENT:a || PRESENT:b", "a", False),
        ("PRESENT:a && PRESENT:b || PRESENT:c", "c", True), ("PRESENT:a && (PRESENT:b || PRESENT:c)", "c", False), ("!!PRESENT:a", "a", True), ("PRESENT:", "a", False), ("", "a", False), ("(PRESENT:a", "a", False), ("exists : A", "a", True), (r"PRESENT:f\( && PRESENT:zzz", "f(", False),
    ],
)
def test_raw_patterns(spark, expr, text, want):
    assert gates.interpret(expr, text) is want
    assert spark.createDataFrame([(text,)], "t string").select(gates.expression(expr, F.col("t")).alias("x")).first()["x"] is want


leaf = st.sampled_from(["PRESENT:a", "MISSING:b$", "EXISTS:line", "PRESENT:f\\(", "PRESENT:[", "nonsense", "MISSING:gnu", "PRESENT:/a/"])
exprs = st.recursive(leaf, lambda e: st.one_of(st.tuples(e, st.sampled_from([" && ", " || "]), e).map("".join), e.map(lambda x: f"({x})"), e.map(lambda x: f"!({x})")), max_leaves=6)


def test_compiled_equals_interpreted(spark):
    rng = random.Random(1)
    found: list[str] = []

    @settings(max_examples=60, database=None, deadline=None)
    @given(exprs)
    def collect(e):
        found.append(e)

    collect()
    chosen = rng.sample(sorted(set(found)), min(40, len(set(found))))
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", *[gates.expression(e, F.col("t")).alias(f"c{i}") for i, e in enumerate(chosen)])
    for row in df.collect():
        for i, e in enumerate(chosen):
            assert row[f"c{i}"] == gates.interpret(e, row["t"]), (e, row["t"])


@pytest.mark.parametrize(
    ("script", "text", "want"),
    [("", "x", (True, None)), ("WHEN PRESENT a\nWHEN PRESENT b", "b", (False, 1)), ("WHEN PRESENT a\nWHEN MISSING b", "ab", (False, 2)), ("WHEN MISSING", "x", (True, None)), ("WHEN EXPR", "x", (False, 1)), ("WHEN FILE_NAME_IS f.txt\nWHEN FILE_PATH_MATCHES d*/*.txt", "", (True, None)), ("WHEN FILE_NAME_IS F.txt", "", (False, 1)), ("UNLESS CURRENT_FILE_MATCHES X", "x", (False, 1))],
)
def test_verdicts(spark, script, text, want):
    v = spark.createDataFrame([(text, "dir/f.txt")], "t string, p string").select(gates.verdict(gates.parse(script), F.col("t"), F.col("p")).alias("v")).first()["v"]
    assert (v["passed"], v["failed_at"]) == want
