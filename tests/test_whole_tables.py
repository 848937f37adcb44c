"""Queries go over the whole of their tables: results on small tables against brute force."""

import pytest

from siftstone import queries as core


@pytest.fixture
def run(spark, tmp_path):
    def query(name, **tables):
        for table, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
        return core.queries()[name](spark, str(tmp_path))

    return query


def test_taint_reachability_follows_every_edge(run):
    orders = {i: [(3 * i + k * k) % 60 for k in range(4)] for i in range(40)} | {40: [1, 100, 101, 102, 103, 104, 105, 106, 107, 108]}
    rows = [(o, n, s) for o, nodes in orders.items() for n, s in enumerate(nodes, 1)]
    edges = {(a, b) for nodes in orders.values() for a, b in zip(nodes, nodes[1:]) if a != b}
    want = {s: 0 for s in range(3)}
    for depth in range(1, 8):
        want |= {b: depth for a, b in edges if want.get(a) == depth - 1 and b not in want}
    got = run("taint_reachability", lineitem=(rows, "l_orderkey long, l_linenumber int, l_suppkey long"), supplier=([(s, -1.0 if s < 3 else 5.0) for s in range(110)], "s_suppkey long, s_acctbal double"))
    assert {r["node"]: r["depth"] for r in got.collect()} == want and want[106] == 7 and 107 not in want


def test_scalar_math_takes_every_order(run):
    rows = [(o, n, 1.0 * (o % 50), 10.0 * n) for o in (1, 2999, 3000, 3001, 90_000) for n in (1, 2)]
    got = run("scalar_math", lineitem=(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double")).collect()
    assert sorted((r["l_orderkey"], r["l_linenumber"], r["clamped"]) for r in got) == [(o, n, min(40, max(10, o % 50))) for o, n, *_ in rows]


def test_scalar_json_takes_every_event(run):
    rows = [(i, 100 + i, "click", f'{{"k": {i}}}') for i in range(25)]
    got = run("scalar_json", events=(rows, "event_id long, user_id long, event_type string, props string")).collect()
    assert sorted((r["event_id"], r["k"], r["n"], r["total"]) for r in got) == [(i, i if i % 10 else -1, 2, 102 + i) for i in range(25)]


def test_latest_runs_takes_every_project(run):
    rows = [(i, i % 7, "click", i // 4) for i in range(60)]
    got = run("latest_runs", events=(rows, "event_id long, user_id long, event_type string, ts long")).collect()
    assert [tuple(r) for r in got] == [(i, i % 7, "click") for i in range(59, 9, -1)]


def test_form_field_lookup_takes_every_page(run):
    urls = {3: "https://a/853", 59: "https://b/x", 60: "https://b/853", 4000: "https://blog.ththan.example.net/en/960", 9000: "https://c/960"}
    got = run("form_field_lookup", pages=([(i, u, "") for i, u in urls.items()], "page_id long, url string, html string")).collect()
    assert {r["file_seq"]: r["v"] for r in got} == {3: "early", 60: "early", 4000: "whole", 9000: "base"}


CODE = [
    ("a.py", "def handle(request, n=1):\n    q = request.args\n    run(q)\n    q = clean(q)\n    run(q)\n\ndef other():\n    run('x')\n"),
    ("b.js", "function send(req) {\n  let v = req.query;\n  let w = v + 1;\n  exec(w, \"a(b\");\n}\n"),
    ("c.txt", "x = request.body\nexec(fmt(x, 1), [1, 2])\n"),
    ("d.txt", ""),
]


@pytest.fixture
def sources(run):
    """The files of CODE, in turn as documents and as pages, by path."""
    docs = [(i, t, "en", p) for i, (p, t) in enumerate(CODE) if i % 2 == 0]
    pages = [(i, f"https://{p}", t) for i, (p, t) in enumerate(CODE) if i % 2]
    tables = {"documents": (docs, "doc_id long, text string, lang string, source string"), "pages": (pages, "page_id long, url string, html string")}
    return lambda name: sorted((r["path"].split("/")[0], *list(r)[1:]) for r in run(name, **tables).collect())


def test_extraction_reads_documents_and_pages(sources):
    assert sources("extract_functions") == [("a.py", "handle", 1, 5, "request,n"), ("a.py", "other", 7, 8, ""), ("b.js", "send", 1, 5, "req"), ("c.txt", "<file>", 1, 2, ""), ("d.txt", "<file>", 1, 1, "")]


def test_calls_of_documents_and_pages(sources):
    assert sources("extract_calls") == [("a.py", 3, "run", 1), ("a.py", 4, "clean", 1), ("a.py", 5, "run", 1), ("a.py", 8, "run", 1), ("b.js", 4, "exec", 2), ("c.txt", 2, "exec", 2), ("c.txt", 2, "fmt", 2)]


def test_flows_of_documents_and_pages(sources):
    found = [x for x in sources("trace_flows") if x[5] == "complete"]
    assert [x[:5] for x in found] == [("a.py", "handle", "run", 3, "q"), ("b.js", "send", "exec", 4, "w"), ("c.txt", "<file>", "exec", 2, "x")]
