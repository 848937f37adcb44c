"""Catalogs, trees and sinks on files in a temporary folder."""

import json

import pytest
from pyspark.sql import functions as F

from siftstone import sinks
from siftstone.operators import match, recon, review
from siftstone.operators.match import Rule
from siftstone.sources import catalogs, trees

RULES = """<root>
<category name="Run"><rule><name>Runs input</name><regex>run\\(</regex><rdl_ref>logic/run.rdl</rdl_ref><rule_desc>d</rule_desc><scan_config><context_lines_before>1</context_lines_before><context_lines_after>x</context_lines_after><aggregate>file</aggregate><highlight_enabled>no</highlight_enabled><marks><mark color="blue">all</mark><mark/></marks></scan_config></rule>
<rule><name>Bad</name><regex>(</regex></rule><rule><regex>nameless</regex></rule></category>
<category name="Text"><rule><name>Plain x</name><regex>x</regex><exclude>[</exclude></rule></category></root>"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "packs").mkdir()
    (tmp_path / "packs" / "own.xml").write_text(RULES)
    (tmp_path / "gates" / "logic").mkdir(parents=True)
    (tmp_path / "gates" / "logic" / "run.rdl").write_text("WHEN PRESENT get_input\nTRACE note\n")
    return tmp_path


FILES = "path string, platform string, content string, file_seq long"


def test_rule_packs(spark, folder):
    rows = catalogs.read_rules(spark, str(folder / "packs"))
    got = [(r["seq"], r["category"], r["name"], r["regex"], r["exclude"], r["bad_regex"], r["bad_exclude"]) for r in rows.orderBy("seq").collect()]
    assert got == [(1, "Run", "Runs input", r"run\(", "", False, False), (2, "Run", "Bad", "", "", True, False), (3, "Text", "Plain x", "x", "", False, True)]
    scan = rows.filter("seq = 1").first()["scan"]
    assert (scan["context_type"], scan["context_lines_before"], scan["context_lines_after"], scan["context_depth"], scan["aggregate"], scan["highlight_enabled"], scan["match_mode"]) == ("lines", 1, 0, 10, "file", False, "line")
    assert [tuple(m) for m in scan["marks"]] == [("blue", "all"), ("red", "match")]
    assert rows.filter("seq = 3").first()["scan"]["context_type"] == "none"
    gates = catalogs.read_gates(spark, str(folder / "gates"))
    assert [(r["gate_ref"], r["script"][:4]) for r in gates.collect()] == [("logic/run.rdl", "WHEN")]
    rules = catalogs.as_rules(rows, gates)
    literal = [Rule(1, "Run", "Runs input", r"run\(", gate="WHEN PRESENT get_input", platform="own", aggregate="file", has_text=True), Rule(3, "Text", "Plain x", "x", platform="own", has_text=False)]
    files = spark.createDataFrame([("a", "p", "get_input\nrun(1)\nRUN(2) x", 1), ("b", "p", "run(x)", 2)], FILES)
    rows_of = lambda rs: sorted((r["rule_id"], r["rule"], r["n"], r["score"]) for r in match.findings(match.evidence(files, rs), rs).collect())
    assert rows_of(rules) == rows_of(literal) and [r[:3] for r in rows_of(rules)] == [("own-1", "Runs input", 1), ("own-2", "Plain x", 2)]
    assert catalogs.read_rules(spark, str(folder / "none")).count() == 0 and catalogs.read_gates(spark, str(folder / "none")).count() == 0


def test_registries(spark, tmp_path):
    (tmp_path / "r.xml").write_text("<root><rule><platform>web</platform><path>/web/web.xml</path><platform_ftypes>*.js, *.js,*.ts</platform_ftypes></rule><rule><platform>py</platform><path>/py/py.xml</path></rule><rule><platform> </platform></rule></root>")
    (tmp_path / "f.xml").write_text('<root><framework><name>Kit</name><platform>web</platform><rule_file>kit.xml</rule_file><markers><file>Kit.json</file><dep file="package.json">kit</dep><regex>kit\\.use</regex><regex>(</regex></markers><scan_ftypes>*.kt, *.js</scan_ftypes></framework><framework><name>x</name></framework></root>')
    registry, frameworks = catalogs.read_registry(spark, str(tmp_path / "r.xml")), catalogs.read_frameworks(spark, str(tmp_path / "f.xml"))
    assert [(r["seq"], r["platform"], r["globs"]) for r in registry.orderBy("seq").collect()] == [(1, "web", ["*.js", "*.ts"]), (2, "py", [])]
    assert catalogs.platform_entry(registry, "py").first()["path"] == "/py/py.xml"
    assert {r["platform"] for r in catalogs.platforms(registry, ("py",)).collect()} == {"web"}
    assert sorted((r["kind"], r["target"], r["value"]) for r in frameworks.collect()) == [("dep", "package.json", "kit"), ("file", "kit.json", "kit.json"), ("regex", "*", "kit\\.use")]
    assert [tuple(r) for r in catalogs.pack_path(registry, frameworks).collect()] == [("kit", "web", "web/framework/kit.xml")]
    assert [(r["platform"], r["frameworks"], r["filetypes"]) for r in catalogs.rule_listing(registry, frameworks).orderBy("seq").collect()] == [("web", "kit", "*.js, *.ts"), ("py", "-", "")]
    assert catalogs.read_registry(spark, str(tmp_path / "no.xml")).count() == 0 and catalogs.read_frameworks(spark, str(tmp_path / "no.xml")).count() == 0


def test_json_catalogs(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"Backend": [{"name": "Py", "regexFlag": "0", "fileExtensions": ["PY"]}, {"name": "Dj", "regex": "django", "fileExtensions": []}, {"regex": "nameless"}], "Odd": [{"name": "bad", "regex": "("}]}))
    (tmp_path / "f.json").write_text(json.dumps({"Py": [{"name": "Fl", "regex": "Flask", "fileExtensions": [".py"]}]}))
    tech, frames, none = catalogs.read_catalog(spark, str(tmp_path / "t.json")), catalogs.read_catalog(spark, str(tmp_path / "f.json")), catalogs.read_catalog(spark, str(tmp_path / "no.json"))
    specs = catalogs.as_specs(tech, frames, none)
    assert [(s.category, s.name, s.kind, s.extensions, s.regex, s.language) for s in specs] == [("Backend", "Dj", "tech", ("*",), "(?i)django", ""), ("Backend", "Py", "tech", (".py",), "", ""), ("Framework", "Fl", "framework", (".py",), "(?i)Flask", "Py")]
    files = spark.createDataFrame([("a.py", "from flask import Flask # Django"), ("b.txt", "django Flask"), (".git/c.py", "x")], "path string, content string")
    found = {(r["name"], r["path"], r["rank"]) for r in recon.detections(files, specs).collect()}
    assert found == {("Py", "a.py", 2), ("Dj", "a.py", 2), ("Fl", "a.py", 3), ("Dj", "b.txt", 2)}
    assert {(r["extension"], r["by_extension"], tuple(r["names"])) for r in catalogs.by_extension(tech).collect()} == {(".py", True, ("Py",)), ("*", False, ("Dj", "bad"))}


def test_contents_count_in_known_extensions_only(spark):
    specs = [recon.Spec("B", "kit", "tech", (".py",), "kit"), recon.Spec("O", "mail", "other", regex="@"), recon.Spec("M", "app", "manifest", regex="app.json", content="expo|native")]
    files = spark.createDataFrame([("a.py", "kit @"), ("b.zig", "kit @"), ("x/APP.json", "EXPO"), ("y/app.json", "none")], "path string, content string")
    assert {(r["name"], r["path"]) for r in recon.detections(files, specs).collect()} == {("kit", "a.py"), ("mail", "a.py"), ("app", "x/APP.json")}
    frames = [recon.Spec("F", "one", "framework", (".js",), "kit", "L"), recon.Spec("F", "two", "framework", ("*",), "kit", "L")]
    assert {tuple(r) for r in recon.first_framework(files, frames, "L").collect()} == {("a.py", "two"), ("b.zig", "two")}


def test_taint_and_review_settings(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"platform": "PHP", "sources": ["_GET", "("], "sinks": [{"name": "run", "description": "runs", "pattern": "run\\("}], "safe_callees": ["log"], "globs": ["*.php"]}, {"platform": "own", "globs": ["*.own"], "mode": "indent"}]))
    assert sorted((r["platform"], r["kind"], r["name"], r["pattern"]) for r in catalogs.read_taint_settings(spark, str(tmp_path / "a.json")).collect()) == [("php", "safe", "log", ""), ("php", "sink", "run", "run\\("), ("php", "source", "", "_GET")]
    assert {(r["platform"], r["mode"]) for r in catalogs.platform_specs(spark, str(tmp_path / "a.json"), [("php", ["*.php"], "brace")]).collect()} == {("php", "brace"), ("own", "indent")}
    (tmp_path / "r.json").write_text(json.dumps({"rules": {"source": [{"rule_title": "A", "line": 3, "status": "Suppressed"}, {"rule_title": "B", "status": "confirmed"}], "path": [{"path": "p", "status": "false_positive"}]}}))
    rules = catalogs.read_review(spark, str(tmp_path / "r.json"))
    assert sorted((r["kind"], r["seq"], r["rule"] or "", r["status"]) for r in rules.collect()) == [("path", 0, "", "false_positive"), ("source", 0, "A", "Suppressed"), ("source", 1, "B", "confirmed")]
    assert [(r["rule"], r["line"]) for r in review.suppressions_of(rules.filter("kind = 'source'")).collect()] == [("A", "3")]
    assert catalogs.read_review(spark, str(tmp_path / "no.json")).count() == 0
    (tmp_path / "s.json").write_text(json.dumps({"suppressions": [{"rule_title": "A", "line": 4, "code_regex": "("}]}))
    assert [(r["rule"], r["line"], r["code_regex"]) for r in review.read_entries(spark, str(tmp_path / "s.json")).collect()] == [("A", 4, "(")]
    assert review.read_entries(spark, str(tmp_path / "no.json")).count() == 0


def test_trees(spark, tmp_path):
    (tmp_path / "src" / "deep").mkdir(parents=True)
    for name, raw in {"a.py": b"x = 1\xe9\n", "deep/b.py": "é".encode(), "deep/Makefile": b"", "z.bin": b"a\x00b", "r.html": b"<p>"}.items():
        (tmp_path / "src" / name).write_bytes(raw)
    tree = trees.read_tree(spark, str(tmp_path / "src"))
    got = {r["path"]: r for r in tree.select("path", "size", trees.scanner_text(F.col("raw")).alias("s"), trees.recon_text(F.col("raw")).alias("r"), trees.marker_text(F.col("raw")).alias("m"), trees.log_tail(F.col("raw"), 3).alias("t")).collect()}
    assert set(got) == {"a.py", "deep/b.py", "z.bin", "r.html"}
    assert got["a.py"]["s"] == got["a.py"]["r"] == "x = 1é\n" and got["a.py"]["m"] == "x = 1\n" and got["deep/b.py"]["s"] == "Ã©" and got["deep/b.py"]["r"] == "é" and got["r.html"]["t"] == "<p>"
    assert got["z.bin"]["r"] is None
    found = trees.discovered(tree, [("py", "*.py"), ("py", "a*"), ("web", "*.html")])
    assert sorted(tuple(r) for r in found.collect()) == [("a.py", "py"), ("a.py", "py"), ("deep/b.py", "py"), ("r.html", "web")]
    assert trees.discovered(tree, [("x", "*.q"), ("x", "*.r")], every=True).count() == 4 and tuple(trees.discovery_counts(tree, found).first()) == (4, 4)
    assert {tuple(r) for r in trees.extensions_of(tree).collect()} == {(".py", 2), (".bin", 1), (".html", 1)} and [r["path"] for r in trees.artifacts(tree.unionByName(tree)).collect()] == ["r.html"]


def test_sinks(spark, tmp_path):
    rules = [Rule(1, "c", "x", "x", platform="own")]
    files = spark.createDataFrame([("a", "p", "x\nx", 1), ("b", "p", "x", 2)], FILES)
    hits = match.evidence(files, rules)
    out = str(tmp_path / "findings")
    sinks.write_evidence(hits, rules, out)
    sinks.write_evidence(hits, rules, out)
    rows = spark.read.json(out).collect()
    assert [(r["rule_id"], [(e["file"], e["line"], e["code"]) for e in r["evidence"]]) for r in rows] == [("own-1", [("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x")])] * 2
    assert match.nested(hits, 2).count() >= 2 and match.nested(hits, 2).select(F.explode("evidence")).count() == 3
    sinks.write_path_findings(match.path_matches(files.select("path"), [Rule(1, "p", "a", "a")]), str(tmp_path / "paths"))
    assert [(r["n"], r["filepath"]) for r in spark.read.json(str(tmp_path / "paths")).collect()] == [(1, ["a"])]
    found = spark.createDataFrame([("B", "Py", "a.py", 3), ("B", "Py", "b.py", 2)], "category string, name string, path string, rank int")
    sinks.write_recon(found, str(tmp_path / "recon"))
    assert {(r["category"], r["confidence"]) for r in spark.read.json(str(tmp_path / "recon" / "files")).collect()} == {("B", "high"), ("B", "medium")} and spark.read.json(str(tmp_path / "recon" / "summary")).first()["dominant"] == "high"
    new = lambda *rows: spark.createDataFrame(list(rows), "key string, value array<string>")
    s = str(tmp_path / "summary")
    sinks.upsert_summary(spark, s, new(("run.name", ["a"]), ("identified_extensions.py", ["b", "a"])))
    got = {r["key"]: r["value"] for r in sinks.upsert_summary(spark, s, new(("run.name", ["z"]), ("identified_extensions.py", ["c"]))).collect()}
    assert got == {"run.name": ["z"], "identified_extensions.py": ["a", "b", "c"]}
    assert {tuple(r) for r in sinks.nested_summary(new(("a.b.c", []), ("a.d", []))).collect()} == {(1, "", "a"), (2, "a", "a.b"), (3, "a.b", "a.b.c"), (2, "a", "a.d")}
    sinks.copy_summary(spark, s, str(tmp_path / "copy"))
    assert spark.read.json(str(tmp_path / "copy")).count() == 2
    sinks.write_baseline(hits.withColumn("rule", F.lit("x")).withColumn("category", F.lit("c")), str(tmp_path / "base"))
    assert review.active(hits.withColumn("rule", F.lit("x")).withColumn("category", F.lit("c")), review.read_entries(spark, str(tmp_path / "base"))).count() == 0
    sinks.write_payload(spark.createDataFrame([("a", 1, 1, 50), ("b", 2, 0, 61)], "target string, flows int, confirmed int, risk int"), str(tmp_path / "payload"))
    assert {(r["target"], r["flows"], r["risk"]) for r in spark.read.json(str(tmp_path / "payload")).collect()} == {("a", 1, 50), ("b", 2, 61), ("summary", 3, 56)}
    sinks.write_paths(files, str(tmp_path / "list"), count_lines=True)
    assert {(r["path"], r["loc"]) for r in spark.read.json(str(tmp_path / "list")).collect()} == {("a", 2), ("b", 1)}
    sinks.write_html(files.coalesce(1), "T", ["path", "content"], str(tmp_path / "html"))
    assert "<td>a</td>" in "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "html")).collect())
    rows = spark.createDataFrame([("A", "f", "suppressed"), ("B", "g", "pending")], "rule string, file string, status string")
    sinks.write_review(rows, rows, rows, str(tmp_path / "review"))
    assert sorted((r["kind"], r["rule"]) for r in spark.read.json(str(tmp_path / "review")).collect()) == [("analyzer", "A"), ("path", "A"), ("source", "A")]
    sinks.write_flows(spark.createDataFrame([("p", 1)], "platform string, rank int"), str(tmp_path / "flows"))
    assert spark.read.parquet(str(tmp_path / "flows")).first()["platform"] == "p"
