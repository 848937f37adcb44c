"""Values through functions and files, on small sources with known flows, and the graph's loops against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from siftstone.operators import dataflow, extract, flows
from siftstone.operators.dataflow import Settings
from siftstone.sources import catalogs

OURS = Settings(r"request\.|\$_(?:GET|POST|REQUEST)\b", ("run", "query"), ("clean",), safe=("print",))
SOURCES = {
    "web/routes/a.py": "def handle(q):\n    return ask(q)\n\ndef other(x):\n    y = clean(x)\n    run(y)\n",
    "lib/store.py": "class Store:\n    def ask(self, text):\n        sql = 'select ' + text\n        return self.fetch(sql)\n\n    def fetch(self, s):\n        return query(s)\n",
    "main.py": "import x\nv = request.args\nw = handle(v)\nprint(v)\nsend(v)\nother(v)\n",
    "in.php": "<?php\n$_SESSION['name'] = $_POST['name'];\n?>",
    "out.php": "<?php\nfunction show() {\n  $n = $_SESSION['name'];\n  foreach ($n as $k => $part) {\n    query(\"select $part\");\n  }\n}\n",
    "multi.java": "class C {\n  @GetMapping\n  public String go(\n      String id,\n      int n) {\n    String s = id;\n    run(s);\n    return s;\n  }\n}\n",
    "kill.py": "def f():\n    a = request.q\n    a = 1\n    run(a)\n    b = request.q\n    b += 'x'\n    run(b)\n    run(request.z)\n    run(clean(request.z))\n",
}


@pytest.fixture(scope="module")
def graph(spark):
    files = spark.createDataFrame(list(SOURCES.items()), "path string, content string").repartition(3)
    return dataflow.graph(files, OURS)


def test_flows(graph):
    found = {(r["file"], r["function"], r["sink"], r["line"]): r for r in dataflow.traced(graph).collect()}
    complete = {k: [(s["role"], s["file"], s["line"]) for s in r["path"]] for k, r in found.items() if r["trace_status"] == "complete"}
    assert complete == {
        # from main.py through three functions in two files; the second step is a parameter in another file
        ("lib/store.py", "fetch", "query", 7): [("source", "main.py", 2), ("handoff", "web/routes/a.py", 1), ("handoff", "lib/store.py", 2), ("assign", "lib/store.py", 3), ("call", "lib/store.py", 6), ("sink", "lib/store.py", 7)],
        ("out.php", "show", "query", 5): [("source", "in.php", 2), ("assign", "out.php", 3), ("assign", "out.php", 4), ("sink", "out.php", 5)],
        ("multi.java", "go", "run", 7): [("source", "multi.java", 3), ("assign", "multi.java", 6), ("sink", "multi.java", 7)],
        ("kill.py", "f", "run", 7): [("source", "kill.py", 5), ("assign", "kill.py", 6), ("sink", "kill.py", 7)],
        ("kill.py", "f", "run", 8): [("source", "kill.py", 8), ("sink", "kill.py", 8)],
    }
    partial = {k: r for k, r in found.items() if r["trace_status"] == "partial"}
    assert ("main.py", "<file>", "send", 5) in partial and not any(k[2] == "print" for k in partial)
    assert [tuple(e) for e in partial["main.py", "<file>", "send", 5]["ends"]] == [("main.py", 5, "unresolved_callee", "send(v)", "send")]
    assert found["lib/store.py", "fetch", "query", 7]["confidence"] == "high"


def test_summaries(graph):
    got = {(r["alias"], r["start"], r["kind"], r["target"]) for r in dataflow.summaries(graph).collect()}
    sink = "lib/store.py#fetch#7#query"
    assert {("fetch", "0", "sink", sink), ("Store.ask", "0", "sink", sink), ("handle", "0", "sink", sink), ("go", "0", "return", ""), ("show", "session:name", "sink", "out.php#show#5#query"), ("f", "source", "sink", "kill.py#f#7#run")} <= got
    assert not any(alias == "other" for alias, *_ in got)


def test_reach_against_brute_force(spark):
    rng = random.Random(3)
    for n, m in ((40, 45), (40, 70), (300, 310), (12, 40)):
        edges = sorted({(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)})
        sources = ["n1", "n2"]
        found, new = set(sources), set(sources)
        while new := {b for a, b in edges if a in new and b not in found}:
            found |= new
        tree = dataflow.reached(spark.createDataFrame(edges, "a string, b string"), spark.createDataFrame([(x,) for x in sources], "node string"))
        pred = {r["node"]: r["pred"] for r in tree.collect()}
        assert set(pred) == found and all(p is None if x in sources else (p, x) in edges for x, p in pred.items())
        steps = dataflow.ways(tree, tree.select("node")).collect()
        by = {}
        for r in steps:
            by.setdefault(r["node"], {})[r["place"]] = r["step"]
        for x in found:
            assert len(by[x]) == max(by[x]) + 1
            way = [by[x][k] for k in range(len(by[x]))]
            assert way[0] == x and way[-1] in sources and all((b, a) in edges for a, b in itertools.pairwise(way))


def test_long_chains(spark):
    chain = "def f():\n    a0 = request.q\n" + "".join(f"    a{i + 1} = a{i}\n" for i in range(2000)) + "    run(a2000)\n"
    deep = "v = request.q\ng0(v)\n" + "".join(f"def g{i}(x):\n    g{i + 1}(x)\n\n" for i in range(60)) + "def g60(x):\n    run(x)\n"
    wide = "def f():\n    a = request.q" + " + 1" * 2000 + "\n    run(" + "'x', " * 1000 + "a)\n"
    files = spark.createDataFrame([("chain.py", chain), ("deep.py", deep), ("wide.py", wide)], "path string, content string")
    found = {r["file"]: r for r in dataflow.traced(dataflow.graph(files, OURS)).collect() if r["trace_status"] == "complete"}
    assert {k: len(r["path"]) for k, r in found.items()} == {"chain.py": 2002, "deep.py": 63, "wide.py": 2}
    assert [s["line"] for s in found["chain.py"]["path"]] == [*range(2, 2003), 2003]


def test_statements_and_forms_of_functions():
    kinds = lambda text: [(s["function"], s["kind"], s["target"], [r["name"] for r in s["reads"]]) for s in extract.statements(text)]
    assert kinds("foreach ($rows as $k => $v) {") == [("<file>", "assign", "v", ["rows"]), ("<file>", "assign", "k", ["rows"])]
    assert kinds("for x in items:\n  f(x)")[0] == ("<file>", "assign", "x", ["items"]) and kinds("const {a} = req.body") == [("<file>", "assign", "a", ["req"])]
    assert kinds("String s = t + u;") == [("<file>", "assign", "s", ["t", "u"])] and kinds("x := y") == [("<file>", "assign", "x", ["y"])] and kinds("$a .= \"b $c\";") == [("<file>", "assign", "a", ["c", "a"])]
    assert kinds("if (a == b) {") == [] and kinds("// x = y") == [] and kinds("return a + f(b)")[0][1:] == ("return", "", ["a", "b"])
    spans = lambda code: [(c["name"], [code[a["from"] : a["to"]].strip() for a in c["args"]]) for c in extract.call_spans(code)]
    assert spans("run(a, g(b, [c, d]), 'x,y(')") == [("run", ["a", "g(b, [c, d])", "'x,y('"]), ("g", ["b", "[c, d]"])] and spans("f(); g(x") == [("f", []), ("g", ["x"])]
    assert extract.functions("func f(b int, c string) error {\n}")[0] == ("f", 1, 2, ["b", "c"]) and extract.functions("func (s *T) g(b, c int) {\n}")[0][3] == ["b", "c"]
    name = lambda text: [f[0] for f in extract.functions(text)]
    for text, want in {
        "const f = (a, b) => {\n}": "f", "exports.g = function (x) {\n}": "g", "h: async (x) => {\n}": "h", "  method(a) {\n  }": "method", "app.get('/x', (req, res) => {\n})": "route_get_1", "func (s *T) Go(a int) error {\n}": "Go", "def r(a)\n  1\nend": "r", "async def p(\n    a,\n    b,\n):\n    return a": "p", "public async Task<int> Do(int a)\n{\n}": "<file>",
    }.items():
        assert name(text) == [want], text
    assert extract.functions("async def p(\n    a,\n    b,\n):\n    return a\nx = 1")[0] == ("p", 1, 5, ["a", "b"])
    assert extract.container(["class A:", "  x", "  def f(self):"], 3) == "A"


def test_aliases(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(dataflow.owner_aliases(F.lit("_user_service"))) == ["_user_service", "user_service", "UserService", "User", "UserRepository"] or "UserService" in one(dataflow.owner_aliases(F.lit("_userService")))
    assert one(dataflow.call_aliases(F.lit("$this->repo.find")))[:3] == ["this->repo.find", "this.repo.find", "this::repo::find"] and "find" in one(dataflow.call_aliases(F.lit("a.find")))
    fns = spark.createDataFrame([("lib/user.py", "find", 1, 2, [], "UserService"), ("x.py", "<file>", 1, 1, [], "")], "path string, name string, start int, end int, params array<string>, container string")
    got = {r["alias"] for r in dataflow.function_aliases(fns).collect()}
    assert {"find", "user", "user.find", "UserService.find", "User.find", "UserRepository.find", "UserService::find"} <= got
    calls = spark.createDataFrame([("m.py", "f", 1, 0, "svc.user.find"), ("m.py", "f", 2, 0, "nothing")], "path string, function string, line int, at int, raw string")
    assert {r["line"]: r["alias"] for r in dataflow.resolved_calls(calls, dataflow.function_aliases(fns)).collect()} == {1: "user.find", 2: None}


def test_forms(spark):
    html = '<p><form action="save.php" method="post" enctype="multipart/form-data"><input name="a"><textarea name=b></textarea></form>\n<form><select name="c"></select></form>'
    files = spark.createDataFrame([("site/form.php", html), ("site/save.php", "<?php ?>")], "path string, content string")
    got = dataflow.forms(files)
    assert sorted((r["target"], r["method"], r["field"]) for r in got.collect()) == [("form.php", "GET", "c"), ("save.php", "POST", "a"), ("save.php", "POST", "b")]
    reads = spark.createDataFrame([(1, "site/save.php", "POST", "a"), (2, "site/save.php", "FILES", "b"), (3, "site/save.php", "GET", "a"), (4, "site/form.php", "REQUEST", "c")], "row int, path string, scope string, field string")
    assert {r["row"]: r["form"] for r in dataflow.declared_fields(reads, got).collect()} == {1: "site/form.php", 2: "site/form.php", 3: None, 4: "site/form.php"}


FLOW = f"flow_seq int, flow_kind string, trace_status string, file string, function string, line int, sink string, description string, explanation string, confidence string, platform string, path {flows.PATH}, ends {flows.ENDS}"


def flow(seq, sink="exec", line=9, path=(), status="complete", file="a.py", confidence="low", platform="py", ends=()):
    return (seq, "sink", status, file, "f", line, sink, "", "", confidence, platform, [tuple(p) for p in path], [tuple(e) for e in ends])


SOURCE, SINK = ("a.py", 1, "source", "v = request.x", "v"), ("a.py", 9, "sink", "exec(v)", "v")


def test_ranking(spark):
    rows = [
        flow(1, path=[SOURCE, SINK]), flow(2, path=[SOURCE, SINK]), flow(3, path=[("a.py", 8, "assign", "w", "w"), SINK]), flow(4, path=[SINK], status="partial"),
        flow(5, "render", 20, [SOURCE, ("b.py", 2, "call", "f(v)", "v"), ("b.py", 20, "sink", "render(v)", "v")]), flow(6, "odd", 30, [], status="Partial", ends=[("a.py", 30, "unresolved_callee", "g()", "g")]),
    ]
    got = flows.ranked_flows(spark.createDataFrame(rows, FLOW)).orderBy("rank").collect()
    # 1 and 2 are one, 3 has an inferred source at the same sink, 4 is partial at the same sink
    assert [(r["flow_seq"], r["rank"], r["risk"], r["severity"], r["cross_file"]) for r in got] == [(1, 1, 35 + 40 + 8 + 4, "Critical", False), (5, 2, 35 + 16 + 15 + 8 + 5 + 6, "Critical", True), (6, 3, 35 + 8 + 8 + 2, "Medium", False)]
    assert got[2]["path"][0]["code"].startswith(flows.INFERRED)
    texts = spark.createDataFrame(rows, FLOW).filter("flow_seq = 6").select(flows.end_texts().alias("t"), flows.sink_fingerprint().alias("s"), flows.trace_status(F.col("trace_status")).alias("x")).first()
    assert texts["t"] == ["unresolved callee at a.py:30 via g"] and tuple(texts["s"]) == ("odd", "a.py", 30) and texts["x"] == "partial"


RULES = [(2, "py", "exec", "code_injection", "late", ""), (1, "PY", "Exec", "command_injection", "runs", "CWE-78"), (3, "py", "render", "xss", "shows", "CWE-79")]


def test_inventory_and_reviews(spark):
    path = lambda file, sink, code: [(file, 1, "source", "v", "v"), (file, 9, "sink", code, "v")]
    rows = [flow(1, path=path("a.py", "exec", "exec(v)"), file="a.py"), flow(2, "render", path=path("a.py", "render", "render(v)"), file="a.py"), flow(3, "render", path=path("b.py", "render", "render(htmlspecialchars(v))"), file="b.py"), flow(4, "render", path=path("c.py", "render", "render(v)"), file="c.py"), flow(5, path=path("d.py", "exec", "exec(v)"), file="src/d.py"), flow(6, "render", path=path("e.py", "render", "render(v)"), file="e.py")]
    ranked = flows.ranked_flows(spark.createDataFrame(rows, FLOW)).cache()
    rules = spark.createDataFrame(RULES, "seq int, platform string, sink string, kind string, title string, cwe string")
    mitigated = spark.createDataFrame([("command_injection", "lib/d.py", 3)], "kind string, path string, line int")
    files = spark.createDataFrame([("c.py", "Content-Type: text/plain"), ("e.py", "x")], "path string, content string")
    got = {(r["kind"], r["sink_file"], r["title"]) for r in flows.inventory(ranked, rules, mitigated, files).collect()}
    # b says that it is escaped, c answers in plain text, a's source feeds a command, d has a mitigation by its base name
    assert got == {("command_injection", "a.py", "runs"), ("xss", "e.py", "shows")}
    finding = lambda name, kinds, *places: (name, list(kinds), list(places))
    found = spark.createDataFrame([finding("near", ["command_injection"], ("a.py", 21)), finding("far", ["command_injection"], ("a.py", 22)), finding("any", ["xss"], ("e.py", 0)), finding("other", ["ssrf"], ("a.py", 9)), finding("none", [], ("z.py", 9)), finding("safe", ["command_injection"], ("lib/d.py", 70)), finding("wild", [], ("a.py", None))], "finding string, kinds array<string>, places array<struct<path:string,line:int>>")
    status = {r["finding"]: (r["status"], r["rationale"]) for r in flows.reviewed(found, ranked, rules, mitigated).collect()}
    assert {k: v[0] for k, v in status.items()} == {"near": "confirmed_vulnerability", "far": "suppressed_false_positive", "any": "confirmed_vulnerability", "other": "suppressed_false_positive", "none": "manual_review_recommended", "safe": "suppressed_false_positive", "wild": "confirmed_vulnerability"}
    assert status["safe"][1] == "dealt with at lib/d.py:3" and status["other"][1] == "no flow of this kind was found" and status["far"][1] == "flows of this kind end elsewhere"
    assert {r["status"] for r in flows.reviewed(found.filter("finding = 'far'"), ranked, rules, mitigated, supported=False).collect()} == {"manual_review_recommended"}


def test_mitigated_paths_match_as_texts(spark):
    names = ["lib/myauth.py", "auth.py", "./lib/auth.py", "x/other.py", "other.py", "z.py", ""]
    rows = list(itertools.product(names, ["k"]))
    for known in names:
        left = {r["path"] for r in flows.not_mitigated(spark.createDataFrame(rows, "path string, kind string"), spark.createDataFrame([(known, "k")], "path string, kind string"), "kind").collect()}
        bare = lambda x: x.lstrip("./")
        met = lambda a: a and known and (bare(a).endswith(bare(known)) or bare(known).endswith(bare(a)) or bare(a).split("/")[-1] == bare(known).split("/")[-1])
        assert left == {n for n in names if not met(n)}, known


def test_mitigations_take_the_first_free_line(spark):
    files = spark.createDataFrame([("a", "py", "x = 1\nescape(a); escape(b)\nescape(c) # safe\n"), ("b", "py", "escape(x)"), ("c", "js", "escape(x) safe")], "path string, platform string, content string")
    rules = [flows.Mitigation("py", "k", "first", r"escape\(", ("safe",)), flows.Mitigation("PY", "k", "second", "escape", ()), flows.Mitigation("py", "other", "third", "escape")]
    got = {(r["path"], r["title"], r["line"]) for r in flows.mitigations(files, rules).collect()}
    assert got == {("a", "first", 2), ("a", "second", 3), ("a", "third", 2), ("b", "second", 1), ("b", "third", 1)}
    long = spark.createDataFrame([("l", "py", "a" * 200 + "escape(" + "b" * 300)], "path string, platform string, content string")
    text = flows.mitigations(long, rules[1:2]).first()["evidence"]
    assert text == "a" * 80 + "escape" + ("(" + "b" * 300)[:80]


def test_graph_nodes(spark):
    f = spark.createDataFrame([flow(1, path=[SOURCE, SINK])], FLOW)
    xref = spark.createDataFrame([(1, "call", f"c{i}", i) for i in range(6)] + [(1, "definition", f"d{i}", i) for i in range(9)], "flow_seq int, kind string, symbol string, seq int")
    got = [(r["place"], r["kind"], r["label"]) for r in flows.graph_nodes(f, xref).orderBy("place").collect()]
    assert got[:2] == [(0, "source", "v = request.x"), (1, "sink", "exec(v)")] and [g[2] for g in got[2:]] == ["c0", "c1", "c2", "c3", "d0", "d1", "d2", "d3", "d4", "d5"]
    assert flows.graph_nodes(f, xref, most=5).count() == 7


class Program:
    """A random program of a few functions (each calls later ones only) in three languages, and what it does on every way through it."""

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)
        self.functions = [(f"f{k}", [f"p{i}" for i in range(self.rng.randint(0, 2))], None) for k in range(3)]
        self.functions = [(n, p, self.block(k, 2, [*p, "a", "b"])) for k, (n, p, _) in enumerate(self.functions)]

    def value(self, names):
        r = self.rng.random()
        return ("source",) if r < 0.2 else ("const",) if r < 0.35 else ("clean", self.rng.choice(names)) if r < 0.45 else ("read", self.rng.choice(names))

    def block(self, k, depth, names):
        out = []
        for _ in range(self.rng.randint(1, 4)):
            r = self.rng.random()
            if r < 0.2 and depth:
                out.append(("if", self.block(k, depth - 1, names), self.block(k, depth - 1, names) if self.rng.random() < 0.6 else None))
            elif r < 0.3 and depth:
                out.append(("while", self.block(k, depth - 1, names)))
            elif r < 0.5:
                out.append(("sink", self.value(names)))
            elif r < 0.65 and k < 2:
                callee = self.rng.randint(k + 1, 2)
                out.append(("call", self.rng.choice(["a", "b"]), callee, [self.value(names) for _ in self.functions[callee][1]]))
            elif r < 0.72:
                out.append(("return", self.value(names)))
                break
            else:
                out.append(("set", self.rng.choice(["a", "b"]), self.value(names)))
        return out

    # as text

    def show(self, v):
        return {"source": "request.q", "const": "1"}.get(v[0]) or (f"clean({v[1]})" if v[0] == "clean" else v[1])

    def text(self, style):
        self.lines, self.where = [], {}
        for name, params, body in self.functions:
            self.put(0, {"py": f"def {name}({', '.join(params)}):", "js": f"function {name}({', '.join(params)}) {{", "rb": f"def {name}({', '.join(params)})"}[style])
            self.write(body, 1, style)
            self.put(0, {"py": "", "js": "}", "rb": "end"}[style])
        return "\n".join(self.lines) + "\n"

    def put(self, depth, line):
        self.lines.append("    " * depth + line)

    def write(self, block, d, style):
        end = {"py": "", "js": ";", "rb": ""}[style]
        head = lambda word: {"py": f"{word} x:", "js": f"{word} (x) {{", "rb": f"{word} x"}[style]
        close = {"py": None, "js": "}", "rb": "end"}[style]
        for s in block:
            if s[0] in ("if", "while"):
                self.put(d, head(s[0]))
                self.write(s[1], d + 1, style)
                if s[0] == "if" and s[2] is not None:
                    self.put(d, {"py": "else:", "js": "} else {", "rb": "else"}[style])
                    self.write(s[2], d + 1, style)
                if close:
                    self.put(d, close)
                continue
            if s[0] == "sink":
                self.where[id(s)] = len(self.lines) + 1
            self.put(d, {"sink": lambda: f"run({self.show(s[1])})", "set": lambda: f"{s[1]} = {self.show(s[2])}", "return": lambda: f"return {self.show(s[1])}", "call": lambda: f"{s[1]} = f{s[2]}({', '.join(map(self.show, s[3]))})"}[s[0]]() + end)

    # what it does: all ways, loops up to three times

    def holds(self, v, env):
        return v[0] == "source" or (v[0] == "read" and v[1] in env)

    def run(self, block, env, hit):
        """Ways out of a block: (names that hold a source's value, None or whether a return gives one)."""
        ways = {(env, None)}
        for s in block:
            after = set()
            for e, out in ways:
                if out is not None:
                    after.add((e, out))
                elif s[0] == "if":
                    after |= self.run(s[1], e, hit) | (self.run(s[2], e, hit) if s[2] is not None else {(e, None)})
                elif s[0] == "while":
                    front, seen = {(e, None)}, {(e, None)}
                    while front:
                        front = {w for x, o in front if o is None for w in self.run(s[1], x, hit)} - seen
                        seen |= front
                    after |= seen
                elif s[0] == "sink":
                    if self.holds(s[1], e):
                        hit.add(id(s))
                    after.add((e, None))
                elif s[0] == "return":
                    after.add((e, self.holds(s[1], e)))
                else:
                    gives = {self.holds(s[2], e)} if s[0] == "set" else self.call(s[2], tuple(self.holds(v, e) for v in s[3]), hit)
                    after |= {((e | {s[1]}) if g else (e - {s[1]}), None) for g in gives}
            ways = after
        return ways

    def call(self, k, args, hit):
        name, params, body = self.functions[k]
        return {bool(out) for _, out in self.run(body, frozenset(p for p, x in zip(params, args, strict=True) if x), hit)}

    def sinks(self):
        hit = set()
        for k, (_, params, _) in enumerate(self.functions):
            self.call(k, (False,) * len(params), hit)
        return {self.where[x] for x in hit}


def test_flows_against_all_ways(spark):
    wanted, files = {}, []
    for seed in range(120):
        program, style = Program(seed), ("py", "js", "rb")[seed % 3]
        text = program.text(style).replace("f0(", f"s{seed}f0(").replace("f1(", f"s{seed}f1(").replace("f2(", f"s{seed}f2(")
        path = f"p{seed}.{style}"
        files.append((path, text))
        wanted[path] = program.sinks()
    flows_ = dataflow.traced(dataflow.graph(spark.createDataFrame(files, "path string, content string"), OURS)).filter("trace_status = 'complete'").collect()
    got = {p: {r["line"] for r in flows_ if r["file"] == p} for p, _ in files}
    wrong = {p: (got[p], wanted[p], t) for p, t in files if got[p] != wanted[p]}
    assert sum(map(len, wanted.values())) > 100
    assert not wrong, "\n".join(map(str, (len(wrong), *next(iter(wrong.items()))[1])))


SPANS = {
    "apart.py": "log(request.x); run('ls')\n",
    "inside.py": "run(clean(a), request.x)\n",
    "cleaned.py": "run(clean(request.x))\n",
    "one_cleaned.py": "y = clean(z); run(request.q)\n",
    "long.py": "x = request.q" + " + 'filler filler filler'" * 200 + "; run(x)\n",
    "two_names.js": "function f() {\n  a = request.q;\n}\nfunction f() {\n  run(a);\n}\n",
    "early.py": "def f(b):\n    a = request.q\n    if b:\n        a = 1\n        return a\n    run(a)\n",
    "both.java": "class C {\n  void go(boolean b) {\n    String a = request.q;\n    if (b) { a = one; } else { a = two; }\n    run(a);\n  }\n}\n",
    "one.java": "class D {\n  void go(boolean b) {\n    String a = request.q;\n    if (b) a = one;\n    run(a);\n  }\n}\n",
    "loop.go": "func loop(n int) {\n    a := one\n    for i := 0; i < n; i++ {\n        run(a)\n        a = request.q\n    }\n}\n",
    "param.go": "func outer() {\n    inner(request.q, 2)\n}\nfunc inner(b string, c int) {\n    run(b)\n}\n",
    "switch.js": "function g(k) {\n  let a = request.q;\n  switch (k) {\n    case 1: a = 1; break;\n    case 2: run(a);\n    default: a = 2;\n  }\n  run(a);\n}\n",
    "lib/a.py": "def save(v):\n    keep(1)\n",
    "lib/b.py": "def save(v):\n    run(v)\n",
    "caller.py": "save(request.q)\n",
    "two_callers.py": "def give(v):\n    return v\n\ndef first():\n    x = give(request.q)\n    keep(x)\n\ndef second():\n    y = give(1)\n    run(y)\n",
}


def test_spans_branches_and_aliases(spark):
    files = spark.createDataFrame(list(SPANS.items()), "path string, content string").repartition(3)
    g = dataflow.graph(files, OURS)
    got = {(r["file"], r["line"]) for r in dataflow.traced(g).filter("trace_status = 'complete'").collect()}
    assert got == {("inside.py", 1), ("one_cleaned.py", 1), ("long.py", 1), ("early.py", 6), ("one.java", 5), ("loop.go", 4), ("param.go", 5), ("switch.js", 5), ("lib/b.py", 2)}
    facts = {(r["alias"], r["start"], r["kind"]) for r in dataflow.summaries(g).collect()}
    assert {("save", "0", "sink"), ("give", "0", "return"), ("inner", "0", "sink")} <= facts and ("second", "source", "sink") not in facts


FORMS = {
    "site/pages/form.html": '<html>\n<form action="../save.php"\n  method="post">\n  <input type=text name="name">\n  <input type="text"\n    name="mail">\n</form>',
    "site/save.php": "<?php\n$n = $_POST['name'];\nrun($n);\nrun($_POST['mail']);\nrun($_POST['other']);\nrun(clean($_POST['name']));\n",
    "other/save.php": "<?php\nrun($_POST['name']);\n",
}


def test_form_fields_in_flows(spark):
    files = spark.createDataFrame(list(FORMS.items()), "path string, content string")
    found = {(r["file"], r["line"]): [(s["role"], s["file"], s["line"]) for s in r["path"]] for r in dataflow.traced(dataflow.graph(files, OURS)).filter("trace_status = 'complete'").collect()}
    form = "site/pages/form.html"
    assert found == {
        ("site/save.php", 3): [("source", form, 4), ("assign", "site/save.php", 2), ("sink", "site/save.php", 3)],
        ("site/save.php", 4): [("source", form, 5), ("read", "site/save.php", 4), ("sink", "site/save.php", 4)],
        ("site/save.php", 5): [("source", "site/save.php", 5), ("sink", "site/save.php", 5)],
        # by its base name alone: no form names this file
        ("other/save.php", 2): [("source", form, 4), ("read", "other/save.php", 2), ("sink", "other/save.php", 2)],
    }


def test_resolved_paths(spark):
    rows = [("site/pages", "../save.php", "site/save.php"), ("site", "save.php", "site/save.php"), ("a/b", "/c/./d", "c/d"), ("", "x", "x"), ("a", "../../x", "x"), ("a/b", "../../c/../d", "d")]
    df = spark.createDataFrame(rows, "f string, t string, w string")
    assert all(r["x"] == r["w"] for r in df.select("w", dataflow.resolved_path(F.col("f"), F.col("t")).alias("x")).collect())


def test_settings_of_a_catalog(spark, tmp_path):
    (tmp_path / "taint.json").write_text('[{"platform": "Py", "sources": ["request\\\\."], "sinks": [{"name": "db", "description": "d", "pattern": "\\\\bexecute\\\\("}], "sanitizers": ["\\\\bescape\\\\("], "safe_callees": ["note"]}]')
    settings = catalogs.as_settings(catalogs.read_taint_settings(spark, str(tmp_path / "taint.json")), "py")
    files = spark.createDataFrame([("a.py", "q = request.args\ndb.execute(q)\ndb.execute(escape(q))\nnote(q)\nsend(q)\n")], "path string, content string")
    assert {(r["line"], r["trace_status"]) for r in dataflow.traced(dataflow.graph(files, settings)).collect()} == {(2, "complete"), (5, "partial")}
    assert catalogs.as_settings(catalogs.read_taint_settings(spark, str(tmp_path / "none.json")), "py").sink_pattern == ""


def test_more_rules_than_lines_of_a_block(spark):
    """Rules of one kind take a line each, however many; lines with many matches count once."""
    text = "escape(a); escape(b)\n" * 90
    rules = [flows.Mitigation("py", "k", f"r{i}", r"escape\(") for i in range(70)]
    found = flows.mitigations(spark.createDataFrame([("a", "py", text), ("b", "py", "escape(x)"), ("c", "py", "")], "path string, platform string, content string"), rules).collect()
    assert sorted((r["path"], r["line"], r["title"]) for r in found) == sorted([("a", i + 1, f"r{i}") for i in range(70)] + [("b", 1, "r0")])


def test_lines_that_recur_are_read_once(monkeypatch):
    read = []
    spans = extract.call_spans
    monkeypatch.setattr(extract, "call_spans", lambda code: read.append(code) or spans(code))
    text = "def f(x):\n" + "".join(f"    if x:\n        v{k % 3} = recurring(x)\n    w = recurring_too(v{k % 3})\n" for k in range(200))
    rows = [s for _ in range(5) for s in extract.statements(text, "a.py")]
    assert len(rows) == 5 * 401 and len(read) <= 7  # the statements and the condition
    assert [r["target"] for r in rows[:4]] == ["x", "v0", "w", "v1"] and rows[1]["calls"][0]["name"] == "recurring" and [r["name"] for r in rows[2]["reads"]] == ["v0"]


def test_fields_of_statements(spark):
    files = spark.createDataFrame([("a.py", "def f(x):\n    if x:\n        y = run(x)\n    return y\n"), ("b.js", "function g(a) { go(a); }")], "path string, content string")
    whole = extract.read_files(files).selectExpr("path", "transform(statements, s -> struct(s.line, s.kind, s.blocks)) AS s").collect()
    some = extract.read_files(files, ("line", "kind", "blocks"))
    assert some.columns == ["path", "statements"] and [tuple(map(str, r)) for r in some.collect()] == [tuple(map(str, r)) for r in whole]


def test_what_is_in_a_file_is_contracted_there(spark, monkeypatch):
    """No tables of doubled chains for chains within files; and the same is reached as by brute force where files lead to each other."""
    written = []
    materialize = dataflow.materialize
    monkeypatch.setattr(dataflow, "materialize", lambda df, label, *rest: written.append(label) or materialize(df, label, *rest))
    rng = random.Random(11)
    inner = [(f"f{f}.py#{i}", f"f{f}.py#{i + 1}") for f in range(3) for i in range(40)]
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    sources = [("f0.py#0",)]
    left, gone = dataflow.contract(frame(inner, ("a", "b")), frame(sources, ("node",)))
    assert "chains" not in written and left.count() == 0
    assert {(r["node"], r["root"], r["pred"]) for r in gone.collect()} == {(b, b.split("#")[0] + "#0", a) for a, b in inner}
    across = [(f"f{rng.randrange(3)}.py#{rng.randrange(41)}", rng.choice([f"f{rng.randrange(3)}.py#{rng.randrange(41)}", "d:alias#x#0", "session:k"])) for _ in range(9)] + [("d:alias#x#0", "f2.py#7"), ("session:k", "f1.py#0"), ("f1.py#0", "session:k")]
    edges = [(a, b) for a, b in inner + across if not (a.startswith("f1") and b == "f1.py#20" and a.endswith("#19"))]
    tree = {r["node"]: r["pred"] for r in dataflow.reached(frame(edges, ("a", "b")), frame(sources, ("node",))).collect()}
    met, front = {"f0.py#0"}, ["f0.py#0"]
    while front:
        at = front.pop()
        new = {b for a, b in edges if a == at} - met
        met |= new
        front += new
    assert set(tree) == met and tree.pop("f0.py#0") is None and set((p, n) for n, p in tree.items()) <= set(edges)
    for node in tree:  # each way leads back to the source
        seen = set()
        while node != "f0.py#0":
            assert node not in seen
            seen.add(node)
            node = tree[node]


def test_graphs_write_nodes_for_traces_alone(spark, monkeypatch):
    written = []
    materialize = dataflow.materialize
    monkeypatch.setattr(dataflow, "materialize", lambda df, label, *rest: written.append(label) or materialize(df, label, *rest))
    files = spark.createDataFrame([("a.py", "def give(x):\n    return x\n"), ("b.py", "def f():\n    v = give(request.q)\n    run(v)\n")], "path string, content string")
    g = dataflow.graph(files, OURS)
    assert ("give", "0", "return") in {(r["alias"], r["start"], r["kind"]) for r in dataflow.summaries(g).collect()} and "nodes" not in written
    found = dataflow.traced(g).filter("trace_status = 'complete'").collect()
    assert [(r["file"], r["line"], r["variable"]) for r in found] == [("b.py", 3, "v")] and written.count("nodes") == 1
