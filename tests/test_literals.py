"""What patterns require, against matches of random texts, and scans with and without."""

import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from siftstone.functions import literals
from siftstone.operators import match
from siftstone.operators.match import Rule


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("Password", ("password",)), (r"\bexec\s*\(", ("exec",)), ("(?i)eval|system", ("eval", "system")), (r"(foo|bar)baz", ("baz",)), ("a[bB]cd+", ("abc",)), (r"x{0,3}token=", ("token=",)), ("(?:secret)?key_id", ("key_id",)),
        (r"(ab)+cdef", ("cdef",)), (r"[0-9]{3}\.[0-9]{3}", ()), ("ab|cd", ()), ("foo|.", ()), ("", ()), ("[", ()), (r"(?<=pre)fix", ("fix",)), ("(?=look)a", ("look",)), ("(?!never)thing", ("thing",)), ("naïve", ()), ("(abc)?", ()),
        ("(?>atomic)x", ("atomic",)), ("(a|b|longer)", ()), ("select.+from", ("select",)), (r"(?P<n>name)(?P=n)", ("name",)),
    ],
)
def test_required(pattern, want):
    assert literals.required(pattern) == want


def test_no_match_without_them():
    rng = random.Random(2)

    def pattern(depth):
        r = rng.random()
        if depth == 0 or r < 0.4:
            return "".join(rng.choice(["a", "b", "C", r"\s", ".", "[ab]", "[bB]", "é"]) for _ in range(rng.randint(1, 5)))
        if r < 0.6:
            return f"({'|'.join(pattern(depth - 1) for _ in range(rng.randint(1, 3)))})"
        return f"(?:{pattern(depth - 1)}){rng.choice(['', '?', '+', '*', '{2}'])}{pattern(depth - 1)}"

    asked = 0
    for _ in range(1500):
        p = pattern(3)
        options = literals.required(p)
        asked += bool(options)
        for _ in range(20):
            text = "".join(rng.choices("abcABC é\n", k=rng.randint(0, 30)))
            if re.search(p, text, re.I | re.M):
                assert not options or any(o in text.lower() for o in options), (p, options, text)
    assert asked > 150


RULES = [Rule(1, "c", "word", r"stone\b", gate="WHEN PRESENT e"), Rule(2, "c", "either", "(sieve|SAND)", exclude="quick"), Rule(3, "c", "none", "[0-9]+"), Rule(4, "c", "anchored", "", gate="WHEN PRESENT Gravel"), Rule(5, "c", "gone", "nowhere", gate="WHEN MISSING stone"), Rule(6, "c", "loose", "x|.y")]


def test_scan_finds_the_same(spark, monkeypatch):
    rng = random.Random(4)
    words = ["stone", "STONE", "stones", "sieve", "Sand", "quicksand", "7", "gravel", "Gravel", "xy", "e", ""]
    rows = [(f"p{i}", "x", i, "\n".join(" ".join(rng.choices(words, k=3)) for _ in range(rng.randint(0, 4)))) for i in range(200)] + [("null", "x", 900, None), ("long", "x", 901, "stone e " * 100)]
    files = spark.createDataFrame(rows, "path string, platform string, file_seq int, content string")
    found = lambda: sorted(map(tuple, match.evidence(files, RULES).select("path", "rule_seq", "line", "pass_no").collect()))
    with_literals = found()
    monkeypatch.setattr(match.literals, "may_match", lambda *a: None)
    assert with_literals == found() and len(with_literals) > 300
    plain = []
    for path, _, _, content in rows:
        for rule in RULES:
            gate = {1: "e" in (content or "").lower(), 4: "gravel" in (content or "").lower(), 5: "stone" not in (content or "").lower()}.get(rule.seq, True)
            for n, line in enumerate((content or "").split("\n"), 1):
                anchor = rule.regex or "Gravel"
                exact = bool(re.search(anchor, line)) and bool(rule.regex) and not (rule.exclude and re.search(rule.exclude, line, re.I))
                loose = bool(rule.gate) and bool(re.search(anchor, line, re.I))
                if content and gate and len(line) <= 500 and (exact or loose):
                    plain.append((path, rule.seq, n, 0 if exact else 1))
    assert with_literals == sorted(plain)


def test_patterns_stand_once_in_the_plan(spark):
    files = spark.createDataFrame([("p", "x", 1, "stone")], "path string, platform string, file_seq int, content string")
    ungated = [replace(r, gate="", regex=r.regex or "gravel", exclude="") for r in RULES]
    plan = match.evidence(files, ungated)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == len(ungated)
    assert match.evidence(files.filter(F.lit(True)), [ungated[4]]).count() == 0
