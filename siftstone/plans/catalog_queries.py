"""Queries of classification, markers, reviews of all kinds, runs and lists, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftstone import sinks
from siftstone.functions import classify
from siftstone.functions import text as T
from siftstone.operators import dataflow, flows, markers, match, review, runs
from siftstone.operators.markers import Marker
from siftstone.plans import scan_queries as S
from siftstone.sources import trees
from siftstone.sources.tables import files, page_files, small, table
from siftstone.streaming import scan


def finding_kinds(spark, sf_dir):
    """All of 26 kinds whose words a text has, in their order."""
    return files(spark, sf_dir).select("path", F.array_join(classify.kinds(F.col("content")), ",").alias("kinds"))


HINTED = tuple(classify.HINTS)


def flows_blocked(spark, sf_dir):
    """Whether the code of a flow says that its kind is dealt with; kinds are dealt out over the files."""
    kind = F.element_at(F.array(*[F.lit(k) for k in HINTED]), (F.col("file_seq") % len(HINTED) + 1).cast("int"))
    code = F.concat("content", F.when(F.col("file_seq") % 4 == 0, F.lit(" escape_filter( realpath system( ")).otherwise(""))
    return files(spark, sf_dir).select("path", kind.alias("kind"), classify.blocked(kind, code).alias("blocked"))


def flow_groups(spark, sf_dir):
    """Group, source profile and changes of values of a text as code."""
    c = F.col("content")
    return files(spark, sf_dir).select("path", classify.flow_group(F.col("path"), F.col("content")).alias("group"), classify.source_profile(F.col("content")).alias("profile"), F.array_join(classify.transformations(F.array(c)), ",").alias("changes"))


def flow_vectors(spark, sf_dir):
    """Attack vectors of conversations as flows: turns are steps, the user's are sources."""
    t = table(spark, sf_dir, "conversations")
    step = F.struct(F.when(F.col("role") == "user", "source").otherwise("assign").alias("role"), F.col("text").alias("code"), "turn")
    per = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(step), lambda a, b: (a["turn"] - b["turn"]).cast("int")).alias("path"))
    surface = classify.input_surface(F.transform(F.filter("path", lambda s: s["role"] == "source"), lambda s: s["code"]))
    found = classify.attack_vectors(F.col("path"), surface["channel"], F.lit(""))
    return per.select("conv_id", surface["channel"].alias("channel"), F.array_join(found, ",").alias("vectors"))


def display_names(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    raw = F.when(F.col("n_nationkey") % 5 == 0, "DotNet ").when(F.col("n_nationkey") % 5 == 1, "ios").otherwise(F.lower("n_name"))
    return n.select("n_nationkey", classify.display_name(raw).alias("shown"))


def artifact_listing(spark, sf_dir):
    """Distinct paths of results, in order, with their type."""
    return trees.artifacts(page_files(spark, sf_dir)).select("path", classify.artifact_type(F.col("path")).alias("type"))


def log_tails(spark, sf_dir):
    """What a viewer shows of long logs: the end."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.length(F.right("text", F.lit(5000))).alias("shown"), F.md5(F.right("text", F.lit(5000))).alias("digest"))


MARKERS = [
    Marker("named", "name", "7.txt"), Marker("tens", "name", "1?.txt"), Marker("secret", "content", "*1.txt", "password|token = "), Marker("french", "count", ".txt", least=60), Marker("rude", "content", "*", "idiot"), Marker("empty", "name", "nothing"),
]


def _projects(spark, sf_dir):
    return files(spark, sf_dir).withColumn("project", F.substring_index("path", "/", 1))


def marker_detection(spark, sf_dir):
    """Platforms of projects by names, contents and numbers of files, what they imply, and one that others retract."""
    return markers.detected(_projects(spark, sf_dir), MARKERS, {"secret": ("kept", "named"), "tens": ("kept",)}, (("tens", ".md", ".txt"),))


def auto_detection(spark, sf_dir):
    """Platforms by globs, but for one that needs a marker."""
    f = _projects(spark, sf_dir)
    return markers.auto_detected(f, [("sevens", "7*.txt"), ("rude", "*.txt"), ("none", "*.md")], ("rude",), markers.detected(f, MARKERS[4:5]))


def manifest_keys(spark, sf_dir):
    """Dependencies of manifests made of events, by section, broken ones without any."""
    e = table(spark, sf_dir, "events")
    manifest = F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(F.concat(F.lit('{"dependencies": {"'), F.initcap("event_type"), F.lit('": "1"}, "devDependencies": {"u'), (F.col("user_id") % 7).cast("string"), F.lit('": "2"}, "scripts": {"no": "x"}}')))
    return e.select(F.explode(markers.dependency_keys(manifest)).alias("dependency")).groupBy("dependency").agg(F.count("*").alias("n"))


def engine_choice(spark, sf_dir):
    """Engines by alias, by name, and of a mobile platform by the language with more files."""
    per = _projects(spark, sf_dir).groupBy("project").agg(F.count_if(F.col("platform") == "fr").alias("fr"), F.count_if(F.col("platform") == "de").alias("de"))
    platform = F.when(F.length("project") % 2 == 0, "android").when(F.col("project").endswith("1"), "typescript").when(F.col("project").endswith("3"), "cobol").otherwise("java")
    return per.select("project", markers.engine(platform, {"typescript": "javascript"}, ("java", "kotlin", "javascript"), F.col("fr"), F.col("de")).alias("engine"))


def _found(spark, sf_dir):
    hits = S.written_hits(spark, sf_dir).withColumn("finding", F.concat_ws("::", "platform", "rule"))
    return hits, hits.select("finding", "platform", "rule", "category").distinct()


SOURCE_RULES = [(1, "false_positive", "en", "symbols", "", "", "3"), (2, "confirmed", "", "", "network", "", None), (3, "suppressed", "", "", "", "SRC1\\EN\\21.txt ", None), (4, "confirmed", "fr", "", "", "", "1"), (5, "odd", "", "insult", "", "", None)]


def review_sources(spark, sf_dir):
    """Statuses of findings: the first rule whose fields fit, and whose file and line any evidence has."""
    hits, found = _found(spark, sf_dir)
    rules = small(spark, SOURCE_RULES, "seq int, status string, platform string, rule string, category string, file string, line string")
    return review.source_status(found, hits.select("finding", "path", "line"), rules).select("finding", "status")


PATH_REVIEWS = [(1, "suppressed", "page suffix", "", "\\.html$"), (2, "confirmed", "language folder", "", ""), (3, "false_positive", "", "no/such/path", ""), (4, "confirmed", "", "", "(")]


def review_paths(spark, sf_dir):
    """Statuses of path findings: by path or pattern, without these all of a rule; an invalid pattern is none."""
    m = match.path_matches(page_files(spark, sf_dir).select("path"), S.PATH_RULES)
    facts = small(spark, [(r.seq, r.name) for r in S.PATH_RULES], "rule_seq int, rule string")
    named = m.join(F.broadcast(facts), "rule_seq").select(F.col("rule").alias("finding"), "rule", "path")
    rules = small(spark, PATH_REVIEWS, "seq int, status string, rule string, path string, path_regex string")
    return review.path_status(named.select("finding", "rule").distinct(), named.select("finding", "path"), rules).select("finding", "status")


ANALYZER_REVIEWS = [(1, "false_positive", "", "symbols", "", "", "", "", "2"), (2, "confirmed", "en", "", "", "", "", "", None), (3, "suppressed", "", "", "high", "", "", "", None)]


def review_analyzer(spark, sf_dir):
    """Statuses of analyzer findings, here one for each hit: the first rule whose fields are all equal or empty, counted."""
    h = S.hits_of(spark, sf_dir)
    found = h.select(F.xxhash64("path", "rule", "line").alias("finding"), F.col("platform").alias("target"), F.col("rule").alias("title"), F.when(F.col("line") > 5, "High").otherwise("low").alias("severity"), F.lit("").alias("sink"), F.lit("").alias("source"), F.col("path").alias("file"), F.col("line").cast("string").alias("line"))
    rules = small(spark, ANALYZER_REVIEWS, "seq int, status string, target string, title string, severity string, sink string, source string, file string, line string")
    return review.analyzer_status(found, rules).groupBy("status").agg(F.count("*").alias("n"))


def review_recounted(spark, sf_dir):
    """What review leaves."""
    return review.recounted(review_sources(spark, sf_dir))


def review_suppressions(spark, sf_dir):
    """Hits left when the rules that hide findings are suppressions."""
    rules = small(spark, SOURCE_RULES, "seq int, status string, platform string, rule string, category string, file string, line string")
    left = review.active(S.hits_of(spark, sf_dir), review.suppressions_of(rules))
    return left.groupBy("rule").agg(F.count("*").alias("n"))


def baseline_by_file(spark, sf_dir):
    """A baseline of findings whose evidence is by file: entries without a line, which hide their files."""
    hits = S.written_hits(spark, sf_dir)
    base = review.baseline(hits.withColumn("aggregate", F.when(F.col("rule_seq") == 6, "file").otherwise("none")))
    left = review.active(hits, review.as_entries(base))
    return base.groupBy("rule").agg(F.count("*").alias("entries"), F.count("line").alias("lines")).join(left.groupBy("rule").agg(F.count("*").alias("left_over")), "rule", "left").select("rule", "entries", "lines", F.coalesce("left_over", F.lit(0)).alias("left_over"))


def review_normalised(spark, sf_dir):
    """Reviews of labelled documents with unknown statuses as pending."""
    rows = table(spark, sf_dir, "labels")
    status = F.when(F.col("toxic") == 1, " False_Positive").when(F.col("quality") == 1, "CONFIRMED").otherwise(F.when(F.col("doc_id") % 2 == 0, "odd"))
    r = review.normalised_review(F.struct(status.alias("status"), F.lit(" x ").alias("note"), F.lit(None).cast("string").alias("updated_at")))
    return rows.select("doc_id", r.alias("r")).select("doc_id", "r.*")


def rule_index(spark, sf_dir):
    return runs.rule_index(S.hits_of(spark, sf_dir))


def file_index(spark, sf_dir):
    return runs.file_index(S.hits_of(spark, sf_dir))


def vulnerability_order(spark, sf_dir):
    """Findings with their place in report order."""
    i = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("risk"), F.col("l_returnflag").alias("kind"), F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("line"), "l_linenumber")
    return flows.numbered(i, [*runs.vulnerability_order(), F.asc("l_linenumber")], "place").select("place", "risk", "kind", "file", "line")


def mitigation_families(spark, sf_dir):
    found = flows.mitigations(files(spark, sf_dir), [flows.Mitigation(p, "contact", "mail", "mail") for p in ("en", "fr", "de")]).withColumn("platform", F.element_at(F.split("path", "/"), 2))
    return runs.mitigation_families(found)


def summary_merged(spark, sf_dir):
    """Counters of suppliers' nations over those of customers: values replaced, sets of extensions united."""
    key = lambda prefix, c: F.concat(F.lit(prefix), (F.col(c) % 5).cast("string"))
    old = table(spark, sf_dir, "nation").groupBy(key("identified_extensions.", "n_nationkey").alias("key")).agg(F.collect_set("n_name").alias("value"))
    new = table(spark, sf_dir, "nation").groupBy(key("identified_extensions.", "n_regionkey").alias("key")).agg(F.collect_set("n_name").alias("value"))
    name = lambda df, c: df.select(key("run.", c).alias("key"), F.array(F.col(c).cast("string")).alias("value"))
    region = table(spark, sf_dir, "region")
    merged = sinks.merged_summary(old.unionByName(name(region, "r_regionkey")), new.unionByName(name(region.filter("r_regionkey > 2").select((F.col("r_regionkey") + 5).alias("k")), "k")))
    return merged.select("key", F.array_join("value", ",").alias("value"))


def summary_tree(spark, sf_dir):
    """Dotted keys as a tree with its parents."""
    e = table(spark, sf_dir, "events")
    return sinks.nested_summary(e.select(F.concat_ws(".", F.lit("runs"), "event_type", (F.col("user_id") % 3).cast("string")).alias("key")))


def run_resume(spark, sf_dir):
    """Users as fingerprints: the last run of each that can go on, counted by status."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "running").otherwise("completed")
    r = e.select(F.col("user_id").alias("fingerprint"), F.struct("ts", "event_id").alias("seq"), status.alias("status"))
    return runs.resumable(r, F.col("fingerprint")).groupBy("status").agg(F.count("*").alias("runs"))


def stages_left(spark, sf_dir):
    """Stages that are left of each user's run."""
    e = table(spark, sf_dir, "events")
    stage = F.element_at(F.array(*[F.lit(s) for s in runs.STAGES]), (F.col("event_id") % 4 + 1).cast("int"))
    states = e.select(F.col("user_id").alias("run"), stage.alias("stage"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), F.col("event_id").alias("seq"))
    return runs.stages_left(states).groupBy("stage").agg(F.count("*").alias("runs"))


def analysis_results(spark, sf_dir):
    """The first fifty results of each platform, and fallback rows of those without."""
    h = S.written_hits(spark, sf_dir)
    numbered = h.select("platform", "path", "line", "rule_seq", "rule").withColumn("rank", F.row_number().over(Window.partitionBy("platform").orderBy("path", "line", "rule_seq")))
    taint, fallback = runs.analysis_results(numbered.select("platform", "rank", F.when(F.col("rule_seq") != 3, F.col("rule")).alias("title"), F.lit(None).cast("string").alias("severity"), F.lit(None).cast("int").alias("risk")), small(spark, [("en", 1), ("xx", 2)], "platform string, score int"))
    per = taint.groupBy("platform", "title", "severity", "risk").agg(F.count("*").alias("n"))
    return per.unionByName(fallback.select("platform", F.lit("fallback").alias("title"), F.lit("").alias("severity"), F.col("score").alias("risk"), F.lit(1).cast("long").alias("n")))


def path_projection(spark, sf_dir):
    """Paths that rules fit, short, with the rule's level."""
    m = match.path_matches(page_files(spark, sf_dir), S.PATH_RULES)
    return m.join(F.broadcast(match.path_findings(m)), "rule_seq").select("rule_seq", "level", "path", T.short_path(F.col("path")).alias("short"))


def call_aliases(spark, sf_dir):
    """Aliases of call names, made of parts and brands, in the order in which they are tried."""
    p = table(spark, sf_dir, "part")
    raw = F.concat_ws(".", F.lit("svc"), F.regexp_replace("p_brand", "#", ""), F.regexp_replace("p_name", " ", "_"))
    return p.select("p_partkey", F.element_at(dataflow.call_aliases(raw), 1).alias("first"), F.array_contains(dataflow.call_aliases(raw), F.element_at(F.split(raw, r"\."), -1)).alias("leaf"), F.size(dataflow.call_aliases(raw)).alias("n"))


def progress_counts(spark, sf_dir):
    """What a scan tells of itself while it is written."""
    hits, seen = runs.with_progress(match.evidence(files(spark, sf_dir), S.RULES))
    hits.write.format("noop").mode("overwrite").save()
    got = seen.get
    return small(spark, [(got["matches"], got["cursor"])], "matches long, cursor long")


def log_lines(spark, sf_dir):
    """Lines of arriving logs, here the texts of conversations written as files."""
    to = scan.folder(spark)
    table(spark, sf_dir, "conversations").select(F.concat(F.lit("\x1b[1m"), F.regexp_replace("text", "[\r\n]", " "), F.lit("\x1b[0m")).alias("value")).write.text(f"{to}/logs")
    return scan.log_lines(spark, f"{to}/logs", f"{to}/run").groupBy(F.md5("line").alias("line")).agg(F.count("*").alias("n"))


NAMES = (
    finding_kinds, flows_blocked, flow_groups, flow_vectors, display_names, artifact_listing, log_tails, marker_detection, auto_detection, manifest_keys, engine_choice, review_sources, review_paths, review_analyzer, review_recounted,
    review_suppressions, baseline_by_file, review_normalised, rule_index, file_index, vulnerability_order, mitigation_families, summary_merged, summary_tree, run_resume, stages_left, analysis_results, path_projection, call_aliases, progress_counts, log_lines,
)


def queries():
    return {f.__name__: f for f in NAMES}


def _q(text: str) -> str:
    return text.replace("'", "''")


def _labels(rules, text: str, flag: str = "") -> str:
    """A comma list of the labels of all (label, pattern) that fit."""
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches({text}, '{_q(p)}'{flag}) THEN '{k}' END" for k, p in rules) + "], lambda x: x IS NOT NULL), ',')"


def _first(rules, text: str, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{_q(p)}') THEN '{k}'" for p, k in rules) + f" ELSE '{default}' END"


def oracle_sql():
    H = f"WITH {S.HITS}"
    docs = "d AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, text AS content, lang AS platform, doc_id AS file_seq, source AS project, doc_id || '.txt' AS base FROM documents)"
    kind = "CASE file_seq % 15 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(HINTED)) + " END"
    hints = "CASE kind " + " ".join("WHEN '" + k + "' THEN " + " OR ".join(f"contains(c, '{_q(h)}')" for h in (*hs, *(classify.SHELL_CALLS if k == "xss" else ()))) for k, hs in classify.HINTS.items()) + " END"
    paths = "p AS (SELECT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)"
    reviewed = "s AS (SELECT DISTINCT platform || '::' || rule AS finding, platform, rule, category FROM hits), r AS (SELECT finding, CASE WHEN platform = 'en' AND rule = 'symbols' AND EXISTS (SELECT 1 FROM hits h WHERE h.platform = s.platform AND h.rule = s.rule AND line = 3) THEN 'false_positive' WHEN category = 'network' THEN 'confirmed' WHEN EXISTS (SELECT 1 FROM hits h WHERE h.platform = s.platform AND h.rule = s.rule AND lower(path) = 'src1/en/21.txt') THEN 'suppressed' WHEN platform = 'fr' AND EXISTS (SELECT 1 FROM hits h WHERE h.platform = s.platform AND h.rule = s.rule AND line = 1) THEN 'confirmed' ELSE 'pending' END AS status FROM s)"
    return {
        "finding_kinds": f"WITH {docs} SELECT path, {_labels(classify.KINDS, 'content', ', ' + chr(39) + 'i' + chr(39))} AS kinds FROM d",
        "flows_blocked": f"WITH {docs}, k AS (SELECT path, {kind} AS kind, lower(content) || CASE WHEN file_seq % 4 = 0 THEN ' escape_filter( realpath system( ' ELSE '' END AS c FROM d) SELECT path, kind, {hints} AS blocked FROM k",
        "flow_groups": f"WITH {docs}, k AS (SELECT path, content, lower(path || ' ' || content) AS g, lower(content) AS s FROM d) SELECT path, {_first(classify.GROUPS, 'g', 'other')} AS \"group\", {_first(classify.PROFILES, 's', 'unknown')} AS profile, {_labels(classify.CHANGES, 'content')} AS changes FROM k",
        "display_names": "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN '.NET' WHEN n_nationkey % 5 = 1 THEN 'iOS' ELSE 'Nation ' || string_split(n_name, '_')[2] END AS shown FROM nation",
        "artifact_listing": f"WITH {paths} SELECT DISTINCT path, CASE WHEN regexp_matches(lower(path), '\\.html?$') THEN 'report' WHEN ends_with(lower(path), '.pdf') THEN 'document' WHEN ends_with(lower(path), '.json') THEN 'data' ELSE 'log' END AS type FROM p WHERE regexp_matches(lower(path), '\\.(html|pdf|json|log|txt)$') ORDER BY path",
        "log_tails": "SELECT doc_id, CAST(length(right(text, 5000)) AS INTEGER) AS shown, md5(right(text, 5000)) AS digest FROM documents",
        "marker_detection": f"""WITH {docs}, m AS (SELECT project, 'named' AS platform FROM d WHERE base = '7.txt' UNION SELECT project, 'tens' FROM d WHERE regexp_matches(base, '^1.\\.txt$') UNION SELECT project, 'secret' FROM d WHERE ends_with(base, '1.txt') AND regexp_matches(content, 'password|token = ', 'i') UNION SELECT project, 'french' FROM d GROUP BY project HAVING count(*) >= 60 UNION SELECT project, 'rude' FROM d WHERE regexp_matches(content, 'idiot', 'i')),
a AS (SELECT * FROM m UNION SELECT project, 'kept' FROM m WHERE platform IN ('secret', 'tens') UNION SELECT project, 'named' FROM m WHERE platform = 'secret') SELECT * FROM a WHERE platform <> 'tens'""",
        "auto_detection": f"WITH {docs} SELECT DISTINCT project, 'sevens' AS platform FROM d WHERE regexp_matches(base, '^7.*\\.txt$') UNION SELECT project, 'rude' FROM d WHERE regexp_matches(content, 'idiot', 'i')",
        "manifest_keys": "SELECT k AS dependency, count(*) AS n FROM (SELECT event_type AS k FROM events WHERE event_id % 10 <> 0 UNION ALL SELECT 'u' || (user_id % 7) FROM events WHERE event_id % 10 <> 0) GROUP BY k",
        "engine_choice": f"WITH {docs}, p AS (SELECT project, count(*) FILTER (platform = 'fr') AS fr, count(*) FILTER (platform = 'de') AS de FROM d GROUP BY project) SELECT project, CASE WHEN length(project) % 2 = 0 THEN CASE WHEN fr >= de THEN 'kotlin' ELSE 'java' END WHEN ends_with(project, '1') THEN 'javascript' WHEN ends_with(project, '3') THEN NULL ELSE 'java' END AS engine FROM p",
        "review_sources": f"{H}, {reviewed} SELECT finding, status FROM r",
        "review_paths": f"WITH {paths}, m AS (SELECT path, 'spam hosts' AS finding FROM p WHERE regexp_matches('/' || path, 'spam|pills', 'i') UNION ALL SELECT path, 'language folder' FROM p WHERE regexp_matches('/' || path, '/(de|fr)/', 'i') AND NOT regexp_matches(path, 'page=2', 'i') UNION ALL SELECT path, 'page suffix' FROM p WHERE regexp_matches('/' || path, '\\.html', 'i')) SELECT finding, CASE WHEN finding = 'page suffix' AND bool_or(regexp_matches(lower(path), '\\.html$')) THEN 'suppressed' ELSE 'confirmed' END AS status FROM m GROUP BY finding",
        "review_analyzer": f"{H} SELECT CASE WHEN rule = 'symbols' AND line = 2 THEN 'false_positive' WHEN platform = 'en' THEN 'confirmed' WHEN line > 5 THEN 'suppressed' ELSE 'pending' END AS status, count(*) AS n FROM hits GROUP BY 1",
        "review_recounted": f"{H}, {reviewed} SELECT count(*) AS found, count(*) FILTER (status NOT IN ('false_positive', 'suppressed')) AS \"left\", count(*) FILTER (status IN ('false_positive', 'suppressed')) AS hidden FROM r",
        "review_suppressions": f"{H} SELECT rule, count(*) AS n FROM hits WHERE NOT (platform = 'en' AND rule = 'symbols' AND line = 3) AND lower(path) <> 'src1/en/21.txt' GROUP BY rule",
        "baseline_by_file": f"{H}, b AS (SELECT DISTINCT platform, rule, path, CASE WHEN rule_seq = 6 THEN NULL ELSE line END AS line FROM hits) SELECT rule, count(*) AS entries, count(line) AS \"lines\", CAST(0 AS BIGINT) AS left_over FROM b GROUP BY rule",
        "review_normalised": "SELECT doc_id, CASE WHEN toxic = 1 THEN 'false_positive' WHEN quality = 1 THEN 'confirmed' ELSE 'pending' END AS status, 'x' AS note, '' AS updated_at FROM labels",
        "rule_index": f"{H} SELECT rule, count(*) AS n FROM hits GROUP BY rule",
        "file_index": f"{H} SELECT path, count(*) AS n, count(DISTINCT rule_seq) AS rules FROM hits GROUP BY path",
        "vulnerability_order": "WITH k AS (SELECT CAST(trunc(l_quantity) AS INTEGER) AS risk, l_returnflag AS kind, l_suppkey AS file, l_orderkey AS line, l_linenumber FROM lineitem), n AS (SELECT CAST(row_number() OVER (ORDER BY risk DESC, kind, file, line, l_linenumber) AS INTEGER) AS place, risk, kind, file, line FROM k) SELECT * FROM n",
        "mitigation_families": f"WITH {docs}, m AS (SELECT platform, path, 1 + length(substr(content, 1, strpos(content, 'mail') - 1)) - length(replace(substr(content, 1, strpos(content, 'mail') - 1), chr(10), '')) AS line FROM d WHERE platform IN ('en', 'fr', 'de') AND contains(content, 'mail')) SELECT 'contact' AS kind, 'mail' AS title, platform, count(*) AS places, count(DISTINCT path) AS files, min(path) AS path, CAST(arg_min(line, path) AS INTEGER) AS line FROM m GROUP BY platform",
        "summary_merged": "WITH a AS (SELECT 'identified_extensions.' || (n_nationkey % 5) AS key, n_name AS v FROM nation UNION SELECT 'identified_extensions.' || (n_regionkey % 5), n_name FROM nation) SELECT key, string_agg(v, ',' ORDER BY v) AS value FROM a GROUP BY key UNION ALL SELECT 'run.' || r_regionkey, CASE WHEN r_regionkey > 2 THEN CAST(r_regionkey + 5 AS VARCHAR) ELSE CAST(r_regionkey AS VARCHAR) END FROM region",
        "summary_tree": "WITH k AS (SELECT DISTINCT event_type AS e, user_id % 3 AS u FROM events) SELECT 1 AS depth, '' AS parent, 'runs' AS key UNION SELECT 2, 'runs', 'runs.' || e FROM k UNION SELECT 3, 'runs.' || e, 'runs.' || e || '.' || u FROM k",
        "run_resume": "WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS e FROM events GROUP BY user_id) SELECT CASE WHEN e = 'error' THEN 'failed' ELSE 'running' END AS status, count(*) AS runs FROM l WHERE e IN ('error', 'click') GROUP BY 1",
        "stages_left": "WITH s AS (SELECT user_id, event_id % 4 AS k, arg_max(event_type, event_id) AS e FROM events GROUP BY 1, 2), every AS (SELECT DISTINCT user_id, k FROM events, (VALUES (0), (1), (2), (3)) AS x(k)) SELECT ['discovery', 'pattern_matching', 'path_analysis', 'reporting'][every.k + 1] AS stage, count(*) AS runs FROM every LEFT JOIN s ON every.user_id = s.user_id AND every.k = s.k WHERE e IS NULL OR e = 'error' GROUP BY 1",
        "analysis_results": f"{H}, k AS (SELECT platform, CASE WHEN rule_seq <> 3 THEN rule ELSE 'Data flow' END AS title, row_number() OVER (PARTITION BY platform ORDER BY path, line, rule_seq) AS rank FROM hits) SELECT platform, title, 'Low' AS severity, 0 AS risk, count(*) AS n FROM k WHERE rank <= 50 GROUP BY platform, title UNION ALL SELECT 'xx', 'fallback', '', 2, 1",
        "path_projection": f"WITH {paths}, m AS (SELECT path, 1 AS rule_seq FROM p WHERE regexp_matches('/' || path, 'spam|pills', 'i') UNION ALL SELECT path, 2 FROM p WHERE regexp_matches('/' || path, '/(de|fr)/', 'i') AND NOT regexp_matches(path, 'page=2', 'i') UNION ALL SELECT path, 3 FROM p WHERE regexp_matches('/' || path, '\\.html', 'i')), c AS (SELECT rule_seq, greatest(35, least(96, 50 + least(36, 6 * count(*)))) AS score FROM m GROUP BY rule_seq) SELECT m.rule_seq, CASE WHEN score >= 80 THEN 'high' WHEN score >= 60 THEN 'medium' ELSE 'low' END AS level, path, array_to_string(string_split(path, '/')[-2:], '/') AS short FROM m JOIN c ON m.rule_seq = c.rule_seq",
        "progress_counts": f"{H} SELECT count(*) AS matches, max(file_seq) AS cursor FROM hits",
        "log_lines": "SELECT md5(regexp_replace(text, '[\\r\\n]', ' ', 'g')) AS line, count(*) AS n FROM conversations GROUP BY 1",
    }
