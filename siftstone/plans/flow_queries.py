"""Queries of data flows, extraction and streams, with their SQL. Orders and line items stand for call edges and flows."""

from __future__ import annotations

from dataclasses import replace
from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftstone.functions import scoring
from siftstone.functions import text as T
from siftstone.operators import dataflow, extract, flows, match, staged
from siftstone.plans import scan_queries as S
from siftstone.sources.tables import files, page_files, small, table
from siftstone.streaming import scan, status


def _flows(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    return i.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_suppkey").alias("file"), F.col("l_returnflag").alias("sink"), F.col("l_linestatus").alias("status"), F.col("l_quantity").cast("int").alias("risk"), F.col("l_linenumber").alias("line"))


def flow_rank_dedupe(spark, sf_dir):
    best = flows.best_of_key(_flows(spark, sf_dir), ["file", "sink", "status"], "risk", "seq")
    left = flows.without_twins(best, F.col("status") == "O", ["file", "sink"])
    return flows.ranked(left, [F.desc("risk"), "file", "sink", "status", "seq"]).select("file", "sink", "status", "risk", "seq", "rank")


def flow_risk(spark, sf_dir):
    f = files(spark, sf_dir)
    words = F.lower("content")
    score = scoring.risk_score(words, F.col("file_seq") % 3, words.contains("token"), words.contains("mail"), F.size(T.lines_of(F.col("content"))), (("idiot|stupid", 40), ("password|akia", 28), ("licen", 16)))
    return f.select("path", score.alias("risk"), scoring.severity(score).alias("severity"))


def flow_confidence(spark, sf_dir):
    n = F.col("l_linenumber")
    label = lambda parity: scoring.flow_confidence(F.col("l_returnflag") == "R", F.col("l_linestatus") == "F", n, F.col("l_quantity") > 20, parity)
    return table(spark, sf_dir, "lineitem").groupBy(label(True).alias("parity"), label(False).alias("full")).agg(F.count("*").alias("n"))


def _interval(spark, sf_dir):
    """Hits of some rules as findings, those on every fifth line with any line; those of others as flows of two points, every seventh line unknown."""
    h = S.written_hits(spark, sf_dir)
    kinds = lambda c: F.when(F.col("line") % 2 == 0, F.array(F.lit(c))).otherwise(F.array().cast("array<string>"))
    at = lambda c: F.struct(F.col("path").alias("path"), c.cast("int").alias("line"))
    finding = F.concat_ws("|", "path", F.col("line").cast("string"), "rule")
    found = h.filter("rule_seq in (1, 2, 5)").select("path", "line", "rule", finding.alias("finding"), kinds("a").alias("kinds"), F.array(at(F.when(F.col("line") % 5 == 0, 0).otherwise(F.col("line")))).alias("places"))
    other = h.filter("rule_seq in (3, 6)").select(kinds("b").alias("kinds"), (F.col("line") * 10 + F.col("rule_seq")).alias("rank"), F.array(at(F.when(F.col("line") % 7 != 0, F.col("line"))), at(F.col("line") + 40)).alias("points"))
    return found.join(flows.nearest_flow(found, other), "finding", "left")


def finding_flow_interval_join(spark, sf_dir):
    return _interval(spark, sf_dir).select("path", "line", "rule", F.coalesce("rank", F.lit(0)).alias("rank"), F.when(F.col("rank").isNotNull(), "confirmed").otherwise("manual_review").alias("verdict"))


def inventory_summary(spark, sf_dir):
    v = finding_flow_interval_join(spark, sf_dir)
    return v.groupBy("rule").agg(F.count_if(F.col("verdict") == "confirmed").alias("confirmed"), F.count_if(F.col("verdict") != "confirmed").alias("manual"))


def vulnerability_first_rule(spark, sf_dir):
    f = table(spark, sf_dir, "events").select("event_id", F.lower("event_type").alias("sink"), F.col("props").alias("code"))
    rules = small(spark, [(1, "error", "failed run", ['"k": 1']), (2, "error", "never reached", []), (3, "click", "pressed", ['"k": 2}', '"k": 3}']), (4, "view", "seen", [])], "seq int, sink string, title string, hints array<string>")
    return flows.first_rule(f, rules, "sink").groupBy("title").agg(F.count("*").alias("n"))


def mitigation_suffix_anti(spark, sf_dir):
    p = page_files(spark, sf_dir).withColumn("kind", F.when(F.col("path").contains("/en/"), "x").otherwise("y")).select("path", "kind", "file_seq")
    known = p.filter("file_seq % 5 = 0").select("path", "kind")
    return flows.not_mitigated(p, known, "kind").select("file_seq", "kind")


MITIGATIONS = [flows.Mitigation("en", "contact", "number beside mail", "mail", ("[0-9]{3}-[0-9]{4}",)), flows.Mitigation("fr", "secret", "named token", "token", ("=",)), flows.Mitigation("en", "secret", "kept token", "token")]


def mitigation_discovery(spark, sf_dir):
    """Files that hold all patterns of a mitigation, the line of its main one and the text around it."""
    return flows.mitigations(files(spark, sf_dir), MITIGATIONS)


def cross_kind_filter(spark, sf_dir):
    """Findings of one kind go where their file also has the other kind or is plain."""
    h = S.written_hits(spark, sf_dir).select("path", "rule_seq", "line")
    other = h.filter("rule_seq = 3").select("path").distinct()
    plain = files(spark, sf_dir).filter(F.col("content").startswith("A")).select("path")
    return h.filter("rule_seq = 6").join(other, "path", "left_anti").join(plain, "path", "left_anti").select("path", "line")


def first_key_lookup(spark, sf_dir):
    """The first of a customer's keys that the lookup holds: own name, nation, segment."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("nation"), "c_mktsegment")
    home = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    known = table(spark, sf_dir, "nation").join(home, "n_nationkey", "left_semi").select(F.col("n_name").alias("k"), F.col("n_nationkey").cast("string").alias("v")).unionByName(small(spark, [("Customer#000000007", "seven"), ("BUILDING", "segment")], "k string, v string"))
    return flows.first_key(c, ["c_name", "nation", "c_mktsegment"], known, "k", "v", "c_custkey").select("c_custkey", F.coalesce("v", F.lit("none")).alias("v"))


def analyzer_review_last(spark, sf_dir):
    """The last review of each finding key wins."""
    e = table(spark, sf_dir, "events")
    reviews = e.select(F.concat_ws("::", F.lower("event_type"), (F.col("user_id") % 10).cast("string")).alias("key"), "event_id", F.when(F.col("value") > 20, "confirmed").otherwise("pending").alias("status"))
    return reviews.groupBy("key").agg(F.max_by("status", "event_id").alias("status"))


def xref_capped(spark, sf_dir):
    """At most two definitions and four call sites of each symbol, forty rows a supplier, without self references."""
    i = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    definitions = flows.capped(i.select("l_partkey", "l_suppkey").distinct(), ["l_partkey"], ["l_suppkey"], 2).select("l_partkey", F.col("l_suppkey").alias("definer"))
    sites = flows.capped(i, ["l_partkey"], ["l_orderkey", "l_linenumber"], 4)
    met = sites.join(definitions, "l_partkey").filter("l_suppkey <> definer").select("l_suppkey", "l_partkey", "definer", "l_orderkey", "l_linenumber")
    return flows.capped(met, ["l_suppkey"], ["l_partkey", "definer", "l_orderkey", "l_linenumber"], 40)


def form_field_lookup(spark, sf_dir):
    """The first declaration of each field in its target, by whole path, then by base name."""
    pages = page_files(spark, sf_dir).select("file_seq", "path", T.basename(F.col("path")).alias("base"))
    forms = small(spark, [("853", "late", 2), ("853", "early", 1), ("blog.ththan.example.net/en/960", "whole", 3), ("960", "base", 4)], "k string, v string, seq int")
    first = forms.groupBy("k").agg(F.min_by("v", "seq").alias("v"))
    return flows.first_key(pages, ["path", "base"], first, "k", "v", "file_seq").filter("v is not null").select("file_seq", "v")


def framework_inherit(spark, sf_dir):
    """Frameworks inherit their platform's first twenty findings, else a fallback row."""
    h = S.hits_of(spark, sf_dir).select("platform", "file_seq", "rule_seq", "line")
    first = flows.capped(h, ["platform"], ["file_seq", "line", "rule_seq"], 20).groupBy("platform").agg(F.count("*").alias("n"), F.max("file_seq").alias("last"))
    frames = small(spark, [("nav", "en"), ("fr-kit", "fr"), ("none", "xx")], "framework string, platform string")
    return frames.join(first, "platform", "left").select("framework", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("last", F.lit(-1)).alias("last"))


def _edges(spark, sf_dir):
    """Following suppliers of an order."""
    i = table(spark, sf_dir, "lineitem")
    a, b = (i.select("l_orderkey", (F.col("l_linenumber") + d).alias("n"), F.col("l_suppkey").alias(name)) for d, name in ((1, "a"), (0, "b")))
    return a.join(b, ["l_orderkey", "n"]).select("a", "b").filter("a <> b").distinct()


def taint_reachability(spark, sf_dir):
    sources = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("node"))
    return flows.reachable(_edges(spark, sf_dir), sources)


def flow_graph(spark, sf_dir):
    return flows.path_edges(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


def path_step_context(spark, sf_dir):
    """Each hit's line with the lines before and after."""
    rules = [replace(r, before=1, after=1) for r in S.RULES if r.seq in (3, 5)]
    near = match.with_context(files(spark, sf_dir), rules)
    one = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(""))
    return near.select("path", "line", "rule_seq", one("before").alias("before"), one("after").alias("after"))


def enclosing_label(spark, sf_dir):
    """The nearest heading (a turn of the user) within 32 rows above, with itself."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-31, 0)
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w).alias("heading"))


def block_depth(spark, sf_dir):
    return page_files(spark, sf_dir).select("file_seq", flows.block_depth(F.split("content", ";")).alias("d")).select("file_seq", "d.deepest", "d.first_closed")


def variable_use(spark, sf_dir):
    """Tokens of each turn joined by equality with the capitalised words of the turn before."""
    t = table(spark, sf_dir, "conversations")
    uses = t.select("conv_id", "turn", F.explode(F.array_distinct(T.identifiers(F.col("text")))).alias("token"))
    defined = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{2,}"), F.lit(0)))).alias("token"))
    return uses.join(defined, ["conv_id", "turn", "token"]).groupBy("conv_id", "turn").agg(F.count("*").alias("n"))


def family_rollup(spark, sf_dir):
    """Families by flag and status: worst severity, files, complete traces and the highest risk, by risk."""
    f = _flows(spark, sf_dir).withColumn("severity", scoring.severity(2 * F.col("risk")))
    place = F.when(F.col("severity") == "Critical", 0).when(F.col("severity") == "High", 1).when(F.col("severity") == "Medium", 2).otherwise(3)
    return f.groupBy(F.concat_ws("|", "sink", "status").alias("family")).agg(F.min_by("severity", place).alias("worst"), F.count_distinct("file").alias("files"), F.count_if(F.col("line") > 3).alias("complete"), F.max("risk").alias("max_risk")).orderBy(F.desc("max_risk"), "family")


def endpoint_targets(spark, sf_dir):
    """Per host: methods, up to ten parameters and four examples."""
    u = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "^([a-z]+):", 1).alias("method"))
    args = u.select("host", F.explode(F.regexp_extract_all("url", F.lit("[?&]([a-z_]+)="), F.lit(1))).alias("arg")).distinct()
    some = flows.capped(args, ["host"], ["arg"], 10).groupBy("host").agg(F.array_join(F.sort_array(F.collect_list("arg")), ",").alias("args"))
    examples = flows.capped(u, ["host"], ["page_id"], 4).groupBy("host").agg(F.array_join(F.transform(F.sort_array(F.collect_list("page_id")), lambda x: x.cast("string")), ",").alias("examples"))
    per = u.groupBy("host").agg(F.array_join(F.sort_array(F.collect_set("method")), ",").alias("methods"), F.count("*").alias("flows"))
    return per.join(examples, "host").join(some, "host", "left").select("host", "methods", "flows", F.coalesce("args", F.lit("")).alias("args"), "examples")


def flow_stats(spark, sf_dir):
    f = _flows(spark, sf_dir)
    return f.agg(F.count("*").alias("flows"), F.count_if(F.col("status") == "O").alias("partial"), F.count_if((F.col("status") == "F") & (F.col("risk") > 40)).alias("high"), F.count_distinct("file").alias("files"), F.count_distinct("sink").alias("sinks"))


def summary_merge(spark, sf_dir):
    """Edges of function summaries merged by alias: a distinct union of their parts."""
    o = table(spark, sf_dir, "orders")
    parts = o.select(F.col("o_custkey").alias("alias"), F.lit("sink").alias("kind"), F.col("o_orderstatus").alias("to")).unionByName(o.select(F.col("o_custkey").alias("alias"), F.lit("return").alias("kind"), F.substring("o_orderpriority", 1, 1).alias("to")))
    return parts.distinct().groupBy("alias", "kind").agg(F.count("*").alias("n"))


def _code(spark, sf_dir):
    """All documents and pages."""
    return files(spark, sf_dir).select("path", "content").unionByName(page_files(spark, sf_dir).select("path", "content"))


def extract_functions(spark, sf_dir):
    return extract.extract_functions(_code(spark, sf_dir)).select("path", "name", "start", "end", F.array_join("params", ",").alias("params"))


def extract_calls(spark, sf_dir):
    return extract.extract_calls(_code(spark, sf_dir)).select("path", "line", "name", F.size("args").alias("args"))


TAINT = dataflow.Settings(r"request\.|req\.|\$_(?:GET|POST|REQUEST|COOKIE|FILES)\b|input\(", ("run", "exec", "query", "system"), ("clean", "escape"))


def trace_flows(spark, sf_dir):
    """Flows from sources to sinks, through functions and files, and to calls whose definition isn't known."""
    found = dataflow.traced(dataflow.graph(_code(spark, sf_dir), TAINT))
    return found.select(F.col("file").alias("path"), "function", "sink", "line", "variable", "trace_status", F.size("path").alias("steps"))


def function_aliases(spark, sf_dir):
    return dataflow.function_aliases(extract.extract_functions(_code(spark, sf_dir)))


def function_summaries(spark, sf_dir):
    """What parameters reach: sinks, and what their function returns."""
    return dataflow.summaries(dataflow.graph(_code(spark, sf_dir), TAINT))


def flow_inventory(spark, sf_dir):
    """Ranked flows of all files, and those of them that are vulnerabilities."""
    found = dataflow.traced(dataflow.graph(_code(spark, sf_dir), TAINT)).withColumn("platform", F.lit("any"))
    rules = small(spark, [(1, "any", "run", "command_injection", "runs input", "CWE-78"), (2, "any", "query", "sql_injection", "queries with input", "CWE-89")], "seq int, platform string, sink string, kind string, title string, cwe string")
    ranked = flows.ranked_flows(found)
    listed = flows.inventory(ranked, rules, small(spark, [], "kind string, path string"), _code(spark, sf_dir))
    return listed.select("rank", "kind", "title", "severity", "risk", "sink_file", "line")


def form_declarations(spark, sf_dir):
    """Fields of the forms of all pages."""
    return dataflow.forms(page_files(spark, sf_dir)).select("path", "target", "method", "field", "seq")


def order_code(spark, sf_dir):
    """Source files made of the tables: an order is a function whose variable its line items set, clear or leave, in a branch or not, and hand to a sink
    by the functions of their suppliers, of which some give back what they are given. A line item has four lines."""
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity")
    branch = F.col("l_quantity") > 25
    value = F.when(F.col("l_returnflag") == "R", "v = request.q").when(F.col("l_returnflag") == "N", "v = 1").otherwise("c = 2")
    handed = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("w = give"), F.col("l_suppkey").cast("string"), F.lit("(v)"))).otherwise("w = v")
    lines = F.concat(F.when(branch, "    if c:\n        ").otherwise("    c = 1\n    "), value, F.lit("\n    "), handed, F.when(F.col("l_linestatus") == "F", "\n    run(w)\n").otherwise("\n    print(w)\n"))
    items = i.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", lines.alias("code")))), lambda x: x["code"]), "").alias("code"))  # an order's
    of_orders = items.select(F.concat(F.lit("orders/"), F.col("l_orderkey").cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("def order():\n"), "code").alias("content"))
    s = i.filter("l_suppkey % 2 = 0").select("l_suppkey").distinct()
    body = F.when(F.col("l_suppkey") % 4 == 0, "(x):\n    return x\n").otherwise("(x):\n    return clean(x)\n")
    return of_orders.unionByName(s.select(F.concat(F.lit("suppliers/"), F.col("l_suppkey").cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("def give"), F.col("l_suppkey").cast("string"), body).alias("content")))


def order_flows(spark, sf_dir):
    """Sinks of order_code that a source reaches."""
    found = dataflow.traced(dataflow.graph(order_code(spark, sf_dir), TAINT)).filter("trace_status = 'complete'")
    return found.select(F.col("file").alias("path"), "line", "sink", "variable")


def order_summaries(spark, sf_dir):
    """What the suppliers' functions of order_code do with what they are given."""
    found = dataflow.summaries(dataflow.graph(order_code(spark, sf_dir), TAINT))
    return found.filter("startswith(alias, 'give')").select("alias", "start", "kind", "target")


def order_statements(spark, sf_dir):
    """Statements of order_code by kind and target: assignments and calls, in branches or not."""
    read = extract.read_files(order_code(spark, sf_dir), ("kind", "target", "blocks", "line")).select("path", F.explode("statements").alias("s"))
    return read.groupBy("s.kind", "s.target", (F.size("s.blocks") > 0).alias("in_branch")).agg(F.count("*").alias("n"), F.count_distinct("path").alias("files"), F.sum("s.line").alias("lines"))


#: Statuses that events stand for.
STATUSES = {"signup": "queued", "view": "running", "click": "running", "purchase": "success", "error": "failed"}


def run_transitions(spark, sf_dir):
    """Transitions of runs (the events of a user and day) by the status machine, timeouts of two hours among them."""
    e = table(spark, sf_dir, "events")
    word = F.create_map(*[F.lit(x) for pair in STATUSES.items() for x in pair])[F.col("event_type")]
    rows = e.select(F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "dd")).alias("run"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), word.alias("status"))
    # time goes on, so that the last runs end too
    after = rows.agg((F.max("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts")).select(F.lit("").alias("run"), "ts", F.lit(0).cast("long").alias("id"), F.lit("queued").alias("status"))
    place = scan.folder(spark)
    rows.unionByName(after).write.parquet(f"{place}/events")
    return status.finished(spark, spark.readStream.schema(rows.schema).parquet(f"{place}/events"), timedelta(hours=2), "45 days", place).filter("run <> ''").withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def staged_scan(spark, sf_dir):
    """A scan in parts that is killed in its second part, goes on as the same run, and is then repeated."""
    place, every = scan.folder(spark), sorted(r["lang"] for r in table(spark, sf_dir, "documents").select("lang").distinct().collect())  # languages

    def kill(platform):
        if platform == every[1]:
            raise KeyboardInterrupt

    first = staged.Stages.resume(spark, place, "query")
    try:
        staged.scan(first, files(spark, sf_dir), S.RULES, every, kill)
    except KeyboardInterrupt:
        first.fail(interrupted=True)
    again = staged.Stages.resume(spark, place, "query")
    staged.scan(again, files(spark, sf_dir), S.RULES, every)
    return staged.scan(again, files(spark, sf_dir), S.RULES, every).select("path", "rule_seq", "line", "pass_no")


def incremental_rescan(spark, sf_dir):
    """Evidence after rules have changed, come and gone, and files, too: only what changed is scanned."""
    place = scan.folder(spark)
    before = [replace(r, regex="x" if r.seq == 2 else r.regex) for r in S.RULES if r.seq != 3]
    was = files(spark, sf_dir).filter("file_seq % 3 <> 0").withColumn("content", F.when(F.col("file_seq") % 7 == 0, F.concat("content", F.lit("\ntoken"))).otherwise(F.col("content")))
    staged.rescan(spark, was, before, place)
    return staged.rescan(spark, files(spark, sf_dir), S.RULES, place).select("path", "rule_seq", "line", "pass_no")


def streaming_scan(spark, sf_dir):
    return scan.scan_arriving(spark, f"{sf_dir}/documents.parquet", S.RULES).groupBy("rule_seq", "pass_no").agg(F.count("*").alias("n"))


def streaming_windows(spark, sf_dir):
    return scan.run_windows(spark, f"{sf_dir}/events.parquet").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def streaming_last_status(spark, sf_dir):
    return scan.last_status(spark, f"{sf_dir}/events.parquet")


NAMES = (
    flow_rank_dedupe, flow_risk, flow_confidence, finding_flow_interval_join, inventory_summary, vulnerability_first_rule, mitigation_suffix_anti, mitigation_discovery, cross_kind_filter, first_key_lookup, analyzer_review_last,
    xref_capped, form_field_lookup, framework_inherit, taint_reachability, flow_graph, path_step_context, enclosing_label, block_depth, variable_use, family_rollup, endpoint_targets, flow_stats, summary_merge,
    extract_functions, extract_calls, trace_flows, function_aliases, function_summaries, flow_inventory, form_declarations, streaming_scan, streaming_windows, streaming_last_status,
    order_flows, order_summaries, order_statements, run_transitions, staged_scan, incremental_rescan,
)


def queries():
    return {f.__name__: f for f in NAMES}


def oracle_sql():
    H = f"WITH {S.HITS}"
    fl = "f AS (SELECT l_orderkey * 10 + l_linenumber AS seq, l_suppkey AS file, l_returnflag AS sink, l_linestatus AS status, CAST(trunc(l_quantity) AS INTEGER) AS risk, l_linenumber AS line FROM lineitem)"
    pages = "p AS (SELECT page_id AS file_seq, regexp_replace(url, '^[a-z]+://', '') AS path, html AS content FROM pages)"
    docs = "d AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, text AS content, doc_id AS file_seq FROM documents)"
    near = f"""{H}, a AS (SELECT path, line, rule, CASE WHEN line % 2 = 0 THEN 1 ELSE 0 END AS known, CASE WHEN line % 5 = 0 THEN 0 ELSE line END AS fl FROM hits WHERE rule_seq IN (1, 2, 5)),
b AS (SELECT path, CASE WHEN line % 2 = 0 THEN 1 ELSE 0 END AS known, line * 10 + rule_seq AS rank, unnest([CASE WHEN line % 7 = 0 THEN 0 ELSE line END, line + 40]) AS pl FROM hits WHERE rule_seq IN (3, 6)),
v AS (SELECT a.path, a.line, a.rule, min(b.rank) AS rank FROM a LEFT JOIN b ON b.path = a.path AND (fl = 0 OR pl = 0 OR abs(fl - pl) <= 12) AND NOT (a.known = 1 AND b.known = 1) GROUP BY ALL)"""
    assign = "CASE WHEN l_returnflag = 'R' THEN 'low' WHEN l_linestatus = 'F' AND l_linenumber >= 3 AND l_quantity > 20 THEN 'high' WHEN l_linestatus = 'F' AND l_linenumber >= 2 THEN 'medium' WHEN l_linestatus <> 'F' AND l_linenumber >= 2 AND l_quantity > 20 THEN 'medium' ELSE 'low' END"
    return {
        "flow_rank_dedupe": f"WITH {fl}, k AS (SELECT *, row_number() OVER (PARTITION BY file, sink, status ORDER BY risk DESC, seq) AS i FROM f), b AS (SELECT * FROM k WHERE i = 1), l AS (SELECT * FROM b WHERE status <> 'O' OR NOT EXISTS (SELECT 1 FROM b c WHERE c.status <> 'O' AND c.file = b.file AND c.sink = b.sink)) SELECT file, sink, status, risk, seq, CAST(row_number() OVER (ORDER BY risk DESC, file, sink, status, seq) AS INTEGER) AS rank FROM l",
        "flow_risk": f"""WITH {docs}, s AS (SELECT path, lower(content) AS c, file_seq, CASE WHEN content = '' THEN 0 WHEN content[-1] = chr(10) THEN len(string_split(content, chr(10))) - 1 ELSE len(string_split(content, chr(10))) END AS n FROM d),
r AS (SELECT path, CAST(least(100, 35 + CASE WHEN regexp_matches(c, 'idiot|stupid') THEN 40 WHEN regexp_matches(c, 'password|akia') THEN 28 WHEN regexp_matches(c, 'licen') THEN 16 ELSE 8 END + CASE WHEN file_seq % 3 > 1 THEN 15 ELSE 0 END + CASE WHEN contains(c, 'token') THEN 8 ELSE 0 END + CASE WHEN contains(c, 'mail') THEN 5 ELSE 0 END + 2 * least(n, 5)) AS INTEGER) AS risk FROM s)
SELECT path, risk, CASE WHEN risk >= 85 THEN 'Critical' WHEN risk >= 70 THEN 'High' WHEN risk >= 50 THEN 'Medium' ELSE 'Low' END AS severity FROM r""",
        "flow_confidence": f"SELECT CASE WHEN l_returnflag = 'R' THEN 'low' WHEN l_linestatus = 'F' AND l_linenumber >= 2 THEN 'medium' ELSE 'low' END AS parity, {assign} AS \"full\", count(*) AS n FROM lineitem GROUP BY ALL",
        "finding_flow_interval_join": f"{near} SELECT path, CAST(line AS INTEGER) AS line, rule, CAST(coalesce(rank, 0) AS INTEGER) AS rank, CASE WHEN rank IS NOT NULL THEN 'confirmed' ELSE 'manual_review' END AS verdict FROM v",
        "inventory_summary": f"{near} SELECT rule, count(*) FILTER (rank IS NOT NULL) AS confirmed, count(*) FILTER (rank IS NULL) AS manual FROM v GROUP BY rule",
        "vulnerability_first_rule": "SELECT CASE event_type WHEN 'error' THEN 'failed run' WHEN 'click' THEN 'pressed' ELSE 'seen' END AS title, count(*) AS n FROM events WHERE (event_type = 'error' AND NOT contains(props, '\"k\": 1')) OR (event_type = 'click' AND NOT contains(props, '\"k\": 2}') AND NOT contains(props, '\"k\": 3}')) OR event_type = 'view' GROUP BY 1",
        "mitigation_suffix_anti": f"WITH {pages}, q AS (SELECT file_seq, path, CASE WHEN contains(path, '/en/') THEN 'x' ELSE 'y' END AS kind FROM p) SELECT file_seq, kind FROM q WHERE NOT EXISTS (SELECT 1 FROM q k WHERE k.file_seq % 5 = 0 AND k.kind = q.kind AND (k.path = q.path OR ends_with(k.path, q.path) OR ends_with(q.path, k.path) OR string_split(k.path, '/')[-1] = string_split(q.path, '/')[-1]))",
        "mitigation_discovery": """WITH d AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, text AS content, lang AS platform FROM documents),
r AS (SELECT path, content, 'contact' AS kind, 'number beside mail' AS title, strpos(content, 'mail') - 1 AS w, 4 AS n FROM d WHERE platform = 'en' AND contains(content, 'mail') AND regexp_matches(content, '[0-9]{3}-[0-9]{4}')
  UNION ALL SELECT path, content, 'secret', 'named token', strpos(content, 'token') - 1, 5 FROM d WHERE platform = 'fr' AND contains(content, 'token') AND contains(content, '=') UNION ALL SELECT path, content, 'secret', 'kept token', strpos(content, 'token') - 1, 5 FROM d WHERE platform = 'en' AND contains(content, 'token'))
SELECT kind, title, path, CAST(1 + length(substr(content, 1, w)) - length(replace(substr(content, 1, w), chr(10), '')) AS INTEGER) AS line, substr(regexp_replace(replace(substr(content, greatest(w - 80, 0) + 1, w - greatest(w - 80, 0) + n + 80), chr(10), ' '), '^\\s+|\\s+$', '', 'g'), 1, 240) AS evidence FROM r""",
        "cross_kind_filter": f"{H} SELECT h.path, CAST(line AS INTEGER) AS line FROM hits h WHERE rule_seq = 6 AND NOT EXISTS (SELECT 1 FROM hits o WHERE o.rule_seq = 3 AND o.path = h.path) AND NOT EXISTS (SELECT 1 FROM files f WHERE f.path = h.path AND starts_with(f.content, 'A'))",
        "first_key_lookup": "SELECT c_custkey, CASE WHEN c_name = 'Customer#000000007' THEN 'seven' WHEN c_nationkey IN (SELECT s_nationkey FROM supplier) THEN CAST(c_nationkey AS VARCHAR) WHEN c_mktsegment = 'BUILDING' THEN 'segment' ELSE 'none' END AS v FROM customer",
        "analyzer_review_last": "SELECT event_type || '::' || (user_id % 10) AS key, arg_max(CASE WHEN value > 20 THEN 'confirmed' ELSE 'pending' END, event_id) AS status FROM events GROUP BY 1",
        "xref_capped": """WITH d AS (SELECT l_partkey, l_suppkey AS definer, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS i FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)), s AS (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS i FROM lineitem),
m AS (SELECT l_suppkey, s.l_partkey, definer, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY s.l_partkey, definer, l_orderkey, l_linenumber) AS j FROM s JOIN d ON s.l_partkey = d.l_partkey WHERE s.i <= 4 AND d.i <= 2 AND l_suppkey <> definer) SELECT l_suppkey, l_partkey, definer, l_orderkey, l_linenumber FROM m WHERE j <= 40""",
        "form_field_lookup": f"WITH {pages} SELECT file_seq, CASE WHEN path = 'blog.ththan.example.net/en/960' THEN 'whole' WHEN string_split(path, '/')[-1] = '853' THEN 'early' ELSE 'base' END AS v FROM p WHERE (path = 'blog.ththan.example.net/en/960' OR string_split(path, '/')[-1] IN ('853', '960'))",
        "framework_inherit": f"{H}, k AS (SELECT platform, file_seq, row_number() OVER (PARTITION BY platform ORDER BY file_seq, line, rule_seq) AS i FROM hits), g AS (SELECT platform, count(*) AS n, max(file_seq) AS last FROM k WHERE i <= 20 GROUP BY platform) SELECT framework, coalesce(n, 0) AS n, coalesce(last, -1) AS last FROM (VALUES ('nav', 'en'), ('fr-kit', 'fr'), ('none', 'xx')) AS t(framework, platform) LEFT JOIN g ON t.platform = g.platform",
        "taint_reachability": "WITH RECURSIVE e AS (SELECT DISTINCT x.l_suppkey AS a, y.l_suppkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1 WHERE x.l_suppkey <> y.l_suppkey), r(node, depth) AS (SELECT s_suppkey, 0 FROM supplier WHERE s_acctbal < 0 UNION SELECT b, depth + 1 FROM r JOIN e ON e.a = r.node WHERE depth < 7) SELECT node, min(depth) AS depth FROM r GROUP BY node",
        "flow_graph": "WITH w AS (SELECT conv_id, turn AS src, lead(turn) OVER o AS dst, CASE WHEN role = lead(role) OVER o THEN 'same' ELSE 'handoff' END AS kind FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)) SELECT * FROM w WHERE dst IS NOT NULL",
        "path_step_context": f"{H} SELECT h.path, CAST(line AS INTEGER) AS line, rule_seq, coalesce(l[line - 1], '') AS before, coalesce(l[line + 1], '') AS after FROM hits h JOIN listed s ON h.path = s.path WHERE rule_seq IN (3, 5)",
        "enclosing_label": "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) AS heading FROM conversations",
        "block_depth": "WITH s AS (SELECT page_id AS file_seq, string_split(html, ';') AS l FROM pages), u AS (SELECT file_seq, unnest(range(0, len(l))) AS pos, unnest(l) AS c FROM s), w AS (SELECT file_seq, pos, CAST(sum(length(replace(c, '}', '')) - length(replace(c, '{', ''))) OVER (PARTITION BY file_seq ORDER BY pos) AS BIGINT) AS depth FROM u) SELECT file_seq, max(depth) AS deepest, CAST(min(pos) FILTER (depth <= 0) AS INTEGER) AS first_closed FROM w GROUP BY file_seq",
        "variable_use": "WITH u AS (SELECT conv_id, turn, unnest(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), lambda t: length(t) >= 3))) AS token FROM conversations), d AS (SELECT conv_id, turn + 1 AS turn, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{2,}'))) AS token FROM conversations) SELECT conv_id, turn, count(*) AS n FROM u JOIN d USING (conv_id, turn, token) GROUP BY conv_id, turn",
        "family_rollup": f"WITH {fl} SELECT sink || '|' || status AS family, CASE WHEN 2 * max(risk) >= 85 THEN 'Critical' WHEN 2 * max(risk) >= 70 THEN 'High' WHEN 2 * max(risk) >= 50 THEN 'Medium' ELSE 'Low' END AS worst, count(DISTINCT file) AS files, count(*) FILTER (line > 3) AS complete, max(risk) AS max_risk FROM f GROUP BY sink, status",
        "endpoint_targets": """WITH u AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^([a-z]+):', 1) AS method FROM pages), a AS (SELECT DISTINCT host, unnest(regexp_extract_all(url, '[?&]([a-z_]+)=', 1)) AS arg FROM u), ak AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY arg) AS i FROM a), aa AS (SELECT host, string_agg(arg, ',' ORDER BY arg) AS args FROM ak WHERE i <= 10 GROUP BY host),
x AS (SELECT host, page_id, row_number() OVER (PARTITION BY host ORDER BY page_id) AS i FROM u), xx AS (SELECT host, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) AS examples FROM x WHERE i <= 4 GROUP BY host) SELECT u.host, string_agg(DISTINCT method, ',' ORDER BY method) AS methods, count(*) AS flows, coalesce(any_value(args), '') AS args, any_value(examples) AS examples FROM u LEFT JOIN aa ON u.host = aa.host JOIN xx ON u.host = xx.host GROUP BY u.host""",
        "flow_stats": f"WITH {fl} SELECT count(*) AS flows, count(*) FILTER (status = 'O') AS partial, count(*) FILTER (status = 'F' AND risk > 40) AS high, count(DISTINCT file) AS files, count(DISTINCT sink) AS sinks FROM f",
        "summary_merge": "SELECT o_custkey AS alias, 'sink' AS kind, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY o_custkey UNION ALL SELECT o_custkey, 'return', count(DISTINCT o_orderpriority[1]) FROM orders GROUP BY o_custkey",
        "streaming_scan": f"{H} SELECT rule_seq, pass_no, count(*) AS n FROM hits GROUP BY rule_seq, pass_no",
        "streaming_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
        "order_flows": """WITH d AS (SELECT *, last_value(CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'N' AND l_quantity <= 25 THEN 0 END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) AS held FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) AS k FROM d)
SELECT 'orders/' || l_orderkey || '.py' AS path, CAST(1 + 4 * k AS INTEGER) AS line, 'run' AS sink, 'w' AS variable FROM n WHERE held = 1 AND l_linestatus = 'F' AND (l_suppkey % 2 = 1 OR l_suppkey % 4 = 0)""",
        "order_summaries": "SELECT DISTINCT 'give' || l_suppkey AS alias, '0' AS start, 'return' AS kind, '' AS target FROM lineitem WHERE l_suppkey % 4 = 0",
        "order_statements": """WITH i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) AS k FROM lineitem), o AS (SELECT 'orders/' || l_orderkey AS path, l_suppkey AS supp, l_returnflag AS flag, l_quantity > 25 AS branch, 4 * k - 2 AS line FROM i),
s AS (SELECT path, line, 'assign' AS kind, 'c' AS target, false AS in_branch FROM o WHERE NOT branch UNION ALL SELECT path, line + 1, 'assign', CASE WHEN flag IN ('R', 'N') THEN 'v' ELSE 'c' END, branch FROM o
  UNION ALL SELECT path, line + 2, 'assign', 'w', false FROM o UNION ALL SELECT path, line + 3, 'call', '', false FROM o
  UNION ALL SELECT DISTINCT 'suppliers/' || supp, k.line, k.kind, k.target, false FROM o, (VALUES (1, 'param', 'x'), (2, 'return', '')) k(line, kind, target) WHERE supp % 2 = 0)
SELECT kind, target, in_branch, count(*) AS n, count(DISTINCT path) AS files, CAST(sum(line) AS BIGINT) AS lines FROM s GROUP BY ALL""",
        "run_transitions": f"""WITH RECURSIVE e AS (SELECT user_id || '-' || strftime(ts, '%d') AS run, epoch_us(ts) AS moment, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUSES.items())} END AS status, row_number() OVER (PARTITION BY user_id || '-' || strftime(ts, '%d') ORDER BY ts, event_id) AS k FROM events),
m AS (SELECT run, CAST(0 AS BIGINT) AS k, '' AS s, CAST(0 AS BIGINT) AS last, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS moment, '' AS was, '' AS status, false AS t, false AS legal, false AS told, CAST(0 AS BIGINT) AS prev, '' AS old FROM (SELECT DISTINCT run FROM e)
  UNION ALL SELECT run, k, CASE WHEN legal THEN status ELSE was END, CASE WHEN legal THEN moment WHEN t THEN last + 7200000000 ELSE last END, n + CAST(t AS BIGINT) + CAST(NOT legal OR status <> was AS BIGINT), moment, was, status, t, legal, NOT legal OR status <> was, last, old
  FROM (SELECT *, (was = '' AND status IN ('queued', 'running')) OR (was = 'queued' AND status IN ('running', 'stopped', 'failed')) OR (was = 'running' AND status IN ('running', 'success', 'failed', 'stopped')) AS legal
    FROM (SELECT m.run, e.k, m.last, m.n, e.moment, e.status, m.s AS old, m.s IN ('queued', 'running') AND e.moment - m.last > 7200000000 AS t, CASE WHEN m.s IN ('queued', 'running') AND e.moment - m.last > 7200000000 THEN 'failed' ELSE m.s END AS was FROM m JOIN e ON e.run = m.run AND e.k = m.k + 1))),
ends AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY run ORDER BY k DESC) = 1),
out AS (SELECT run, n - CAST(told AS BIGINT) - 1 AS seq, prev + 7200000000 AS moment, old AS was, 'failed' AS status, true AS legal, true AS timed_out FROM m WHERE t UNION ALL SELECT run, n - 1, moment, was, status, legal, false FROM m WHERE told
  UNION ALL SELECT run, n, last + 7200000000, s, 'failed', true, true FROM ends WHERE s IN ('queued', 'running'))
SELECT run, seq, strftime(make_timestamp(moment), '%Y-%m-%d %H:%M:%S.%f') AS at, was, status, legal, timed_out FROM out""",
        "staged_scan": f"{H} SELECT path, rule_seq, CAST(line AS INTEGER) AS line, pass_no FROM hits",
        "incremental_rescan": f"{H} SELECT path, rule_seq, CAST(line AS INTEGER) AS line, pass_no FROM hits",
        "streaming_last_status": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS runs FROM events GROUP BY user_id",
    }
