"""Queries of reports, runs, dashboards, set operations and scalar functions, with their SQL.

Events stand for scan runs: user_id is the project, event_type the status, value the duration.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from siftstone.functions import scoring
from siftstone.functions import text as T
from siftstone.operators import flows, match, reports, review
from siftstone.plans import scan_queries as S
from siftstone.sources.tables import files, page_files, small, table


def report_counters(spark, sf_dir):
    return reports.counters(S.hits_of(spark, sf_dir))


def chart_bars(spark, sf_dir):
    counts = S.hits_of(spark, sf_dir).groupBy("rule").agg(F.count("*").alias("n"))
    return reports.bars(counts, "rule", "n", 4)


def top_files(spark, sf_dir):
    return reports.top_files(S.hits_of(spark, sf_dir), 8, 15)


def file_heat(spark, sf_dir):
    return S.hits_of(spark, sf_dir).groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(15)


def code_viewer_rows(spark, sf_dir):
    """Lines to show of each file: matches and the lines beside them, each once, a match first."""
    near = match.with_context(files(spark, sf_dir), [replace(r, before=1, after=1) for r in S.RULES], whole=True)
    row = lambda line, beside, code: F.struct(line.alias("line"), F.lit(beside).alias("beside"), code.alias("code"))
    shown = F.array_compact(F.array(row(F.col("line"), 0, F.col("code")), *[F.when(F.size(c) > 0, row(F.col("line") + d, 1, F.get(c, F.lit(0)))) for c, d in (("before", -1), ("after", 1))]))
    lines = near.select("path", F.explode(shown).alias("m")).groupBy("path", "m.line").agg(F.min("m.beside").alias("beside"), F.first("m.code").alias("code"))
    return lines.select("path", "line", "beside", F.substring("code", 1, 240).alias("code"))


def hot_tokens(spark, sf_dir):
    words = files(spark, sf_dir).select("path", "platform", F.explode(T.identifiers(F.col("content"), ("the", "and", "der", "les"), 4)).alias("token"))
    per = words.groupBy("token").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("platform")), ",").alias("platforms"))
    return per.orderBy(F.desc("n"), "token").limit(12)


def report_order(spark, sf_dir):
    """Findings in report order: noise last, then platform, then the lower-cased title."""
    per = S.hits_of(spark, sf_dir).groupBy("platform", "category", "rule").agg(F.count("*").alias("n"))
    placed = flows.numbered(per, [F.when(F.col("category") == "noise", 1).otherwise(0), F.col("platform"), F.lower("rule")], "place")
    return placed.select(F.col("place").cast("long").alias("place"), "platform", "rule", "n")


def dashboard_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ok, n = F.count_if(F.col("event_type") == "purchase"), F.count("*")
    return e.agg(n.alias("runs"), ok.alias("succeeded"), F.count_if(F.col("event_type") == "error").alias("failed"), reports.share_of_success(ok, n).alias("success_percent"), F.round(F.avg(F.when(F.col("value") > 0, F.col("value"))), 2).alias("mean_duration"), F.count_distinct("user_id").alias("projects"))


def daily_activity(spark, sf_dir):
    return reports.daily_activity(table(spark, sf_dir, "events"), "ts").select(F.col("day").cast("string").alias("day"), "runs")


def project_rollup(spark, sf_dir):
    """Projects and runs: both sides kept."""
    runs = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("runs"), F.count_if(F.col("event_type").isin("click", "view")).alias("running"), F.count_if(F.col("event_type") == "error").alias("failed"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_status"))
    projects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return projects.join(runs, "id", "full").select("id", "c_name", zero("runs"), zero("running"), zero("failed"), "last_status")


def latest_runs(spark, sf_dir):
    return reports.latest(table(spark, sf_dir, "events"), [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id", "event_type")


def run_detail(spark, sf_dir):
    """Rows as the detail view shows them: text flags as booleans, JSON as values."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", F.col("event_type").isin("purchase", "error").alias("finished"), k.alias("k"), F.when(k % 2 == 0, "true").otherwise("false").cast("boolean").alias("even"))


def promote_upsert(spark, sf_dir):
    """Suppressed findings promoted: evidence added to a finding that is there, unless it has it, else a new finding."""
    hits = S.written_hits(spark, sf_dir).withColumnRenamed("path", "file")
    there = hits.filter("rule_seq NOT IN (1, 6) AND pass_no = 0").select("platform", "rule", "category", "file", "line", "code")
    facts = there.select("platform", "rule", "category").distinct().withColumns({"score": F.lit(70), "level": F.lit("high"), "severity": F.lit("High"), "rating": F.lit(None).cast("string"), "note": F.lit("seen")})
    says = lambda kind, value: F.when(F.col("line") == 2, F.lit(value)).otherwise(F.lit(None).cast(kind))
    items = hits.filter("rule_seq IN (1, 3, 6) AND line <= 5").withColumns({"seq": F.xxhash64("file", "line", "rule"), "score": says("int", 90), "level": F.lit(None).cast("string"), "severity": F.lit(None).cast("string"), "rating": says("string", "two"), "note": says("string", "looked at")})
    evidence, after = review.promoted(there, facts, items)
    counts = evidence.groupBy("platform", "rule").agg(F.count("*").alias("evidence"), F.count_if("promoted").alias("promoted"))
    return counts.join(after, ["platform", "rule"]).select("platform", "rule", "evidence", "promoted", "score", "level", "severity", "rating", "note")


def project_upsert(spark, sf_dir):
    base = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), F.lit(None).cast("string").alias("note"))
    new = table(spark, sf_dir, "region").select(F.concat(F.lit("NATION_"), (F.col("r_regionkey") * 10).cast("string")).alias("name"), F.col("r_regionkey").alias("region"), F.col("r_name").alias("note"))
    return reports.upsert(base, new, ["name"], ["region", "note"])


def project_delete(spark, sf_dir):
    """Runs left after projects are deleted; a project whose last run is active is refused."""
    e = table(spark, sf_dir, "events")
    wanted = e.select("user_id").distinct().filter("user_id % 4 = 0")
    active = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last")).filter("last in ('click', 'view')")
    gone = wanted.join(active, "user_id", "left_anti")
    return e.join(gone, "user_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("runs"))


def schema_evolution(spark, sf_dir):
    """Old rows without a column, new ones with it: the union fills it, and empty keys are replaced."""
    old = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("").alias("project_key"))
    new = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("project_key"), F.lit(1).alias("version"))
    rows = old.unionByName(new, allowMissingColumns=True)
    return rows.select("id", F.coalesce(F.nullif("project_key", F.lit("")), F.concat(F.lit("legacy-"), "id")).alias("project_key"), F.coalesce("version", F.lit(0)).alias("version"))


def suppressed_update(spark, sf_dir):
    rows = S.suppressed_findings(spark, sf_dir).groupBy("rule_seq").agg(F.count("*").alias("n"))
    edits = small(spark, [(3, "checked", None), (4, None, "legal")], "rule_seq int, status string, owner string")
    return rows.join(F.broadcast(edits), "rule_seq", "left").select("rule_seq", "n", F.coalesce("status", F.lit("suppressed")).alias("status"), F.coalesce("owner", F.lit("nobody")).alias("owner"))


def set_operations(spark, sf_dir):
    """Union, intersection and differences of the words of sources and hosts, with bag counts."""
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    poor = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_acctbal").alias("least")).filter("least < -900").select("k")
    tag = lambda df, name: df.groupBy("k").agg(F.count("*").alias("n")).select(F.lit(name).alias("operation"), "k", "n")
    out = tag(a.unionByName(b), "union all")
    for df, name in ((a.unionByName(b).distinct(), "union"), (a.intersect(b), "intersect"), (a.exceptAll(b), "except all"), (a.subtract(b), "except"), (b.distinct().join(poor, "k", "left_anti"), "anti")):
        out = out.unionByName(tag(df, name))
    return out


def ordered_distinct(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: x["o_orderstatus"]), ",").alias("s")).select("o_custkey", F.array_join(T.ordered_distinct(F.col("s")), ",").alias("statuses"))


def scalar_text(spark, sf_dir):
    c = F.concat(F.lit(" "), F.col("p_name"), F.lit("/A-"), F.col("p_type"), F.lit("<b>&\"x' "))
    return table(spark, sf_dir, "part").select(
        "p_partkey", T.norm_text(c).alias("norm"), T.slug(c).alias("slug"), T.pascal_case(F.col("p_name")).alias("pascal"), T.html_escape(F.trim(c)).alias("escaped"), T.truncated(F.repeat("p_name", 40)).alias("short"),
        T.last_segment(F.concat_ws("->", "p_type", F.concat_ws("::", "p_brand", "p_name"))).alias("segment"), F.array_join(T.identifiers(F.col("p_name"), ("ring",)), ",").alias("tokens"), T.valid_name(F.col("p_name")).alias("valid"),
        T.parameter_name(F.concat(F.lit("final "), F.lower("p_type"), F.lit(" $x[] = 1"))).alias("parameter"), T.strip_terminal(F.concat(F.lit("\x1b[31m"), "p_name", F.lit("\x1b[0m\r"))).alias("plain"),
    )


def scalar_path(spark, sf_dir):
    p = F.col("path")
    return page_files(spark, sf_dir).select(
        "file_seq", T.basename(p).alias("base"), T.dirname(p).alias("folder"), T.suffix(p).alias("suffix"), T.stem(p).alias("stem"), T.short_path(p).alias("short"), T.relative_to(p, "/en/").alias("relative"),
        T.host_path(F.concat(F.lit("C:\\src\\"), p)).alias("host"), T.inside_any(p, ("blog.tionsh.example.net", "m.ththth.example.net/en")).alias("inside"), T.matches_glob(p, "*.example.???/[de][en]/*").alias("fits"), T.line_of_offset(F.lit("a\nb\nc"), F.col("file_seq") % 6).alias("line"),
    )


def scalar_math(spark, sf_dir):
    n = F.col("l_quantity").cast("int")
    i = table(spark, sf_dir, "lineitem")
    return i.select(
        "l_orderkey", "l_linenumber", scoring.clamp(n, 10, 40).alias("clamped"), scoring.half_even(n / 2).alias("half"), scoring.confidence_level(2 * n).alias("level"), scoring.severity(2 * n).alias("severity"), scoring.flow_severity(2 * n).alias("flow"),
        scoring.path_confidence(n % 9).alias("path_score"), scoring.fallback_source_confidence(n % 15, n % 4).alias("fallback"), T.elapsed((F.col("l_extendedprice") * 100).cast("long")).alias("elapsed"),
    ).distinct()


def scalar_json(spark, sf_dir):
    """Values of JSON, null where it can't be read; named counts."""
    e = table(spark, sf_dir, "events")
    odd = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.col("props"))
    listed = T.named_counts(F.concat_ws(", ", F.concat("event_type", F.lit("["), F.col("user_id").cast("string"), F.lit("]")), F.lit("bad"), F.lit("x[2]")))
    return e.select("event_id", F.coalesce(F.get_json_object(odd, "$.k").cast("int"), F.lit(-1)).alias("k"), F.size(listed).alias("n"), F.aggregate(listed, F.lit(0), lambda a, x: a + x["count"]).alias("total"))


SCOPES = (("secret|token", "credentials"), ("network|address", "network"), ("licen", "legal"))


def classify_scope(spark, sf_dir):
    """First scope whose words the category or rule has."""
    hay = F.lower(F.concat_ws(" ", "category", "rule"))
    scope = F.lit("general")
    for pattern, name in reversed(SCOPES):
        scope = F.when(hay.rlike(pattern), name).otherwise(scope)
    label = F.when(F.col("path").rlike("/(de|fr)/") & (F.col("category") != "noise"), "configuration").otherwise("source")
    return S.hits_of(spark, sf_dir).groupBy(scope.alias("scope"), label.alias("label")).agg(F.count("*").alias("n"))


KINDS = (("token", "secret"), ("idiot|stupid", "tone"), ("[0-9]{3}-[0-9]{4}", "phone"), ("(?i)licen", "licence"), ("@", "mail"))


def classify_kinds(spark, sf_dir):
    """All kinds whose pattern a text fits, in order of declaration."""
    kinds = F.array_compact(F.array(*[F.when(F.col("content").rlike(p), F.lit(k)) for p, k in KINDS]))
    return files(spark, sf_dir).select("path", F.array_join(kinds, ",").alias("kinds"))


def input_surface(spark, sf_dir):
    """Channel, method and query parameters of urls; first rule that fits decides the channel."""
    u = table(spark, sf_dir, "pages")
    channel = F.when(F.col("url").rlike(r"[?&]ref="), "referral").when(F.col("url").rlike("utm_"), "campaign").when(F.col("url").contains("#"), "anchor").otherwise("direct")
    params = F.array_distinct(F.regexp_extract_all("url", F.lit(r"[?&]([a-z_]+)="), F.lit(1)))
    return u.select("page_id", channel.alias("channel"), F.when(F.col("url").startswith("https"), "secure").otherwise("plain").alias("method"), F.array_join(F.slice(params, 1, 10), ",").alias("parameters"))


def attack_vectors(spark, sf_dir):
    """Labels of each url (a default where none fits), counted, with the first example."""
    u = table(spark, sf_dir, "pages")
    labels = F.array_compact(F.array(F.when(F.col("url").contains("?"), "query"), F.when(F.col("url").contains("#"), "fragment"), F.when(F.col("url").startswith("http:"), "cleartext"), F.when(F.col("url").rlike("pills|spam"), "spam")))
    each = u.select("page_id", "url", F.explode(F.when(F.size(labels) == 0, F.array(F.lit("code_path"))).otherwise(labels)).alias("vector"))
    return each.groupBy("vector").agg(F.count("*").alias("n"), F.min_by("url", "page_id").alias("example"))


def artifact_types(spark, sf_dir):
    p = F.lower("path")
    kind = F.when(p.endswith(".html"), "report").when(p.endswith("/"), "folder").when(p.contains("?"), "query").when(p.contains("#"), "part").otherwise("other")
    return page_files(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.min("path").alias("first"))


def guidance_lookup(spark, sf_dir):
    """Guidance of each rule by title, without case; an empty one gives way to the category's, then to a default."""
    per = S.hits_of(spark, sf_dir).groupBy("rule", "category").agg(F.count("*").alias("n"))
    by_rule = small(spark, [("SYMBOLS", "remove"), ("insult", ""), ("mail address", "mask")], "title string, text string").select(F.lower("title").alias("rule"), F.nullif("text", F.lit("")).alias("a"))
    by_category = small(spark, [("wording", "soften"), ("contact", "unused")], "category string, b string")
    return per.join(F.broadcast(by_rule), "rule", "left").join(F.broadcast(by_category), "category", "left").select("rule", "n", F.coalesce("a", "b", F.lit("review")).alias("guidance"))


def analyzer_summary(spark, sf_dir):
    """Sums over targets and the fallback score of platforms without flows, rounded half to even."""
    per = S.hits_of(spark, sf_dir).groupBy("platform").agg(F.count("*").alias("n"))
    score = F.least(F.lit(75), 45 + 3 * F.col("n"))
    return per.agg(F.sum("n").alias("findings"), F.count("*").alias("targets"), F.bround(F.avg(score), 0).cast("int").alias("overall"), F.max("n").alias("largest"))


NAMES = (
    report_counters, chart_bars, top_files, file_heat, code_viewer_rows, hot_tokens, report_order, dashboard_metrics, daily_activity, project_rollup, latest_runs, run_detail, promote_upsert, project_upsert, project_delete,
    schema_evolution, suppressed_update, set_operations, ordered_distinct, scalar_text, scalar_path, scalar_math, scalar_json, classify_scope, classify_kinds, input_surface, attack_vectors, artifact_types, guidance_lookup, analyzer_summary,
)


def queries():
    return {f.__name__: f for f in NAMES}


def oracle_sql():
    H = f"WITH {S.HITS}"
    pages = "p AS (SELECT page_id AS file_seq, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)"
    docs = "d AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, text AS content, lang AS platform FROM documents)"
    covered = "(platform = 'en' AND rule = 'symbols') OR (rule = 'address literal' AND lower(path) = 'src1/en/21.txt') OR (category = 'contact' AND regexp_matches(path, '/de/', 'i')) OR regexp_matches(code, 'license|licence', 'i') OR (rule = 'insult' AND line = 3)"
    even = lambda x, d: f"round_even({x}, {d})"
    return {
        "report_counters": f"{H} SELECT 'platform' AS scope, platform AS label, count(*) AS n FROM hits GROUP BY platform UNION ALL SELECT 'category', category, count(*) FROM hits GROUP BY category UNION ALL SELECT 'rule', rule, count(*) FROM hits GROUP BY rule UNION ALL SELECT 'all', 'all', count(*) FROM hits",
        "chart_bars": f"{H}, c AS (SELECT rule, count(*) AS n FROM hits GROUP BY rule ORDER BY n DESC, rule LIMIT 4) SELECT rule, n, {even('n / (SELECT max(n) FROM c) * 100', 2)} AS width, {even('n / (SELECT sum(n) FROM c) * 100', 1)} AS share FROM c",
        "top_files": f"{H}, g AS (SELECT rule_seq, path, min(file_seq) AS file_seq FROM hits GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY rule_seq ORDER BY file_seq, path) AS i FROM g) SELECT path, count(*) AS hits FROM k WHERE i <= 8 GROUP BY path ORDER BY hits DESC, path LIMIT 15",
        "file_heat": f"{H} SELECT path, count(*) AS n FROM hits GROUP BY path ORDER BY n DESC, path LIMIT 15",
        "code_viewer_rows": f"{H}, m AS (SELECT path, line + d AS line, CASE WHEN d = 0 THEN 0 ELSE 1 END AS beside FROM hits, (VALUES (0), (-1), (1)) AS x(d) ), s AS (SELECT path, line, min(beside) AS beside FROM m GROUP BY path, line) SELECT s.path, CAST(s.line AS INTEGER) AS line, beside, code[1:240] AS code FROM s JOIN lines l ON s.path = l.path AND s.line = l.line",
        "hot_tokens": f"WITH {docs}, w AS (SELECT platform, unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*')) AS token FROM d) SELECT token, count(*) AS n, string_agg(DISTINCT platform, ',' ORDER BY platform) AS platforms FROM w WHERE length(token) >= 4 AND lower(token) NOT IN ('the', 'and', 'der', 'les') GROUP BY token ORDER BY n DESC, token LIMIT 12",
        "report_order": f"{H}, per AS (SELECT platform, category, rule, count(*) AS n FROM hits GROUP BY ALL) SELECT row_number() OVER (ORDER BY CASE WHEN category = 'noise' THEN 1 ELSE 0 END, platform, lower(rule)) AS place, platform, rule, n FROM per",
        "dashboard_metrics": "SELECT count(*) AS runs, count(*) FILTER (event_type = 'purchase') AS succeeded, count(*) FILTER (event_type = 'error') AS failed, round(count(*) FILTER (event_type = 'purchase') * 100.0::DOUBLE / count(*), 2) AS success_percent, round(avg(value) FILTER (value > 0), 2) AS mean_duration, count(DISTINCT user_id) AS projects FROM events",
        "daily_activity": "WITH c AS (SELECT CAST(max(ts) AS DATE) - CAST(i AS INTEGER) AS day FROM events, range(7) AS r(i) GROUP BY i), n AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) SELECT CAST(c.day AS VARCHAR) AS day, coalesce(n, 0) AS runs FROM c LEFT JOIN n ON c.day = n.day",
        "project_rollup": "WITH r AS (SELECT user_id AS id, count(*) AS runs, count(*) FILTER (event_type IN ('click', 'view')) AS running, count(*) FILTER (event_type = 'error') AS failed, arg_max(event_type, (ts, event_id)) AS last_status FROM events GROUP BY user_id), p AS (SELECT c_custkey AS id, c_name FROM customer) SELECT coalesce(p.id, r.id) AS id, c_name, coalesce(runs, 0) AS runs, coalesce(running, 0) AS running, coalesce(failed, 0) AS failed, last_status FROM p FULL JOIN r ON p.id = r.id",
        "latest_runs": "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
        "run_detail": "SELECT event_id, event_type IN ('purchase', 'error') AS finished, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 AS even FROM events",
        "promote_upsert": f"""{H}, a AS (SELECT DISTINCT platform, rule, path, line FROM hits WHERE rule_seq NOT IN (1, 6) AND pass_no = 0), b AS (SELECT DISTINCT platform, rule, path, line FROM hits WHERE rule_seq IN (1, 3, 6) AND line <= 5),
u AS (SELECT *, 0 AS promoted FROM a UNION ALL SELECT *, 1 FROM (SELECT * FROM b EXCEPT SELECT * FROM a)), said AS (SELECT platform, rule, bool_or(line = 2) AS two FROM b GROUP BY platform, rule), was AS (SELECT DISTINCT platform, rule FROM a)
SELECT u.platform, u.rule, count(*) AS evidence, CAST(sum(promoted) AS BIGINT) AS promoted, CASE WHEN any_value(two) THEN 90 WHEN any_value(was.rule) IS NOT NULL THEN 70 ELSE 50 END AS score, CASE WHEN any_value(was.rule) IS NOT NULL THEN 'high' ELSE 'medium' END AS level,
  CASE WHEN any_value(was.rule) IS NOT NULL THEN 'High' END AS severity, CASE WHEN any_value(two) THEN 'two' END AS rating, CASE WHEN any_value(two) THEN 'looked at' WHEN any_value(was.rule) IS NOT NULL THEN 'seen' END AS note
FROM u LEFT JOIN said ON said.platform = u.platform AND said.rule = u.rule LEFT JOIN was ON was.platform = u.platform AND was.rule = u.rule GROUP BY u.platform, u.rule""",
        "project_upsert": "WITH u AS (SELECT 'NATION_' || (r_regionkey * 10) AS name, r_regionkey AS region, r_name AS note FROM region) SELECT coalesce(n_name, u.name) AS name, coalesce(u.region, n_regionkey) AS region, u.note FROM nation FULL JOIN u ON n_name = u.name",
        "project_delete": "WITH last AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS s FROM events GROUP BY user_id) SELECT e.user_id, count(*) AS runs FROM events e JOIN last USING (user_id) WHERE NOT (e.user_id % 4 = 0 AND s NOT IN ('click', 'view')) GROUP BY e.user_id",
        "schema_evolution": "SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'legacy-' || n_nationkey END AS project_key, 0 AS version FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name, 1 FROM region",
        "suppressed_update": f"{H} SELECT rule_seq, count(*) AS n, CASE WHEN rule_seq = 3 THEN 'checked' ELSE 'suppressed' END AS status, CASE WHEN rule_seq = 4 THEN 'legal' ELSE 'nobody' END AS owner FROM hits WHERE {covered} GROUP BY rule_seq",
        "set_operations": """WITH a AS (SELECT c_nationkey AS k FROM customer), b AS (SELECT s_nationkey AS k FROM supplier)
SELECT 'union all' AS operation, k, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY k UNION ALL SELECT 'union', k, count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY k UNION ALL SELECT 'intersect', k, count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) GROUP BY k
UNION ALL SELECT 'except all', k, count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY k UNION ALL SELECT 'except', k, count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) GROUP BY k UNION ALL SELECT 'anti', k, count(*) FROM (SELECT DISTINCT k FROM b WHERE k NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal < -900)) GROUP BY k""",
        "ordered_distinct": "WITH f AS (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS i FROM orders GROUP BY 1, 2) SELECT o_custkey, string_agg(o_orderstatus, ',' ORDER BY i) AS statuses FROM f GROUP BY o_custkey",
        "scalar_text": """WITH c AS (SELECT *, ' ' || p_name || '/A-' || p_type || '<b>&"x'' ' AS c FROM part)
SELECT p_partkey, lower(trim(c, ' ')) AS norm, regexp_replace(regexp_replace(lower(c), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[1:80] AS slug, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '') AS pascal,
replace(replace(replace(replace(replace(trim(c, ' '), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped, CASE WHEN length(p_name) * 40 > 300 THEN trim(repeat(p_name, 40)[1:75] || '..', ' ') ELSE repeat(p_name, 40) END AS short,
p_name AS segment, array_to_string(list_filter(regexp_extract_all(p_name, '[A-Za-z_][A-Za-z0-9_]*'), lambda t: length(t) >= 3 AND lower(t) <> 'ring'), ',') AS tokens, regexp_matches(p_name, '^[A-Za-z0-9 _.-]+$') AND length(p_name) <= 64 AS valid, 'x' AS parameter, p_name AS plain FROM c""",
        "scalar_path": f"""WITH {pages} SELECT file_seq, string_split(path, '/')[-1] AS base, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, lower(regexp_extract(string_split(path, '/')[-1], '^.+(\\.[^.]+)$', 1)) AS suffix,
CASE WHEN regexp_matches(string_split(path, '/')[-1], '^.+\\.[^.]*$') THEN regexp_extract(string_split(path, '/')[-1], '^(.+)\\.[^.]*$', 1) ELSE string_split(path, '/')[-1] END AS stem, array_to_string(string_split(path, '/')[-2:], '/') AS short,
CASE WHEN strpos(path, '/en/') > 0 THEN substr(path, strpos(path, '/en/')) ELSE path END AS relative, '/host/c/src/' || path AS host, path = 'blog.tionsh.example.net' OR starts_with(path, 'blog.tionsh.example.net/') OR path = 'm.ththth.example.net/en' OR starts_with(path, 'm.ththth.example.net/en/') AS inside,
regexp_matches(path, '^.*\\.example\\..../[de][en]/.*$') AS fits, CAST(CASE WHEN file_seq % 6 < 2 THEN 1 WHEN file_seq % 6 < 4 THEN 2 ELSE 3 END AS INTEGER) AS line FROM p""",
        "scalar_math": """WITH i AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS n, CAST(trunc(l_extendedprice * 100) AS BIGINT) AS ms FROM lineitem)
SELECT DISTINCT l_orderkey, l_linenumber, greatest(least(n, 40), 10) AS clamped, CAST(round_even(n / 2, 0) AS INTEGER) AS half, CASE WHEN 2 * n >= 80 THEN 'high' WHEN 2 * n >= 60 THEN 'medium' ELSE 'low' END AS level,
CASE WHEN 2 * n >= 85 THEN 'Critical' WHEN 2 * n >= 70 THEN 'High' WHEN 2 * n >= 50 THEN 'Medium' ELSE 'Low' END AS severity, CASE WHEN 2 * n >= 85 THEN 'critical' WHEN 2 * n >= 65 THEN 'high' WHEN 2 * n >= 40 THEN 'medium' WHEN 2 * n >= 20 THEN 'low' ELSE 'info' END AS flow,
CAST(CASE WHEN n % 9 > 0 THEN greatest(35, least(96, 50 + least(36, 6 * (n % 9)))) ELSE 50 END AS INTEGER) AS path_score, CAST(greatest(20, least(74, 35 + least(14, 2 * (n % 15)) + least(8, 2 * (n % 4)) - CASE WHEN n % 15 >= 12 THEN 4 ELSE 0 END)) AS INTEGER) AS fallback,
lpad(CAST(ms // 3600000 AS VARCHAR), 2, '0') || 'Hr:' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || 'Min:' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || 's:' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') || 'ms' AS elapsed FROM i""",
        "scalar_json": "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k, 2 AS n, CAST(user_id + 2 AS INTEGER) AS total FROM events",
        "classify_scope": f"{H} SELECT CASE WHEN regexp_matches(lower(category || ' ' || rule), 'secret|token') THEN 'credentials' WHEN regexp_matches(lower(category || ' ' || rule), 'network|address') THEN 'network' WHEN regexp_matches(lower(category || ' ' || rule), 'licen') THEN 'legal' ELSE 'general' END AS scope, CASE WHEN regexp_matches(path, '/(de|fr)/') AND category <> 'noise' THEN 'configuration' ELSE 'source' END AS label, count(*) AS n FROM hits GROUP BY ALL",
        "classify_kinds": f"WITH {docs} SELECT path, array_to_string(list_filter([CASE WHEN regexp_matches(content, 'token') THEN 'secret' END, CASE WHEN regexp_matches(content, 'idiot|stupid') THEN 'tone' END, CASE WHEN regexp_matches(content, '[0-9]{{3}}-[0-9]{{4}}') THEN 'phone' END, CASE WHEN regexp_matches(content, 'licen', 'i') THEN 'licence' END, CASE WHEN contains(content, '@') THEN 'mail' END], lambda x: x IS NOT NULL), ',') AS kinds FROM d",
        "input_surface": "SELECT page_id, CASE WHEN regexp_matches(url, '[?&]ref=') THEN 'referral' WHEN contains(url, 'utm_') THEN 'campaign' WHEN contains(url, '#') THEN 'anchor' ELSE 'direct' END AS channel, CASE WHEN starts_with(url, 'https') THEN 'secure' ELSE 'plain' END AS method, array_to_string(regexp_extract_all(url, '[?&]([a-z_]+)=', 1), ',') AS parameters FROM pages",
        "attack_vectors": "WITH v AS (SELECT page_id, url, 'query' AS vector FROM pages WHERE contains(url, '?') UNION ALL SELECT page_id, url, 'fragment' FROM pages WHERE contains(url, '#') UNION ALL SELECT page_id, url, 'cleartext' FROM pages WHERE starts_with(url, 'http:') UNION ALL SELECT page_id, url, 'spam' FROM pages WHERE regexp_matches(url, 'pills|spam') UNION ALL SELECT page_id, url, 'code_path' FROM pages WHERE NOT (contains(url, '?') OR contains(url, '#') OR starts_with(url, 'http:') OR regexp_matches(url, 'pills|spam'))) SELECT vector, count(*) AS n, arg_min(url, page_id) AS example FROM v GROUP BY vector",
        "artifact_types": f"WITH {pages} SELECT CASE WHEN ends_with(lower(path), '.html') THEN 'report' WHEN ends_with(path, '/') THEN 'folder' WHEN contains(path, '?') THEN 'query' WHEN contains(path, '#') THEN 'part' ELSE 'other' END AS kind, count(*) AS n, min(path) AS first FROM p GROUP BY 1",
        "guidance_lookup": f"{H} SELECT rule, count(*) AS n, CASE WHEN rule = 'symbols' THEN 'remove' WHEN rule = 'mail address' THEN 'mask' WHEN category = 'wording' THEN 'soften' ELSE 'review' END AS guidance FROM hits GROUP BY rule, category",
        "analyzer_summary": f"{H}, per AS (SELECT platform, count(*) AS n FROM hits GROUP BY platform) SELECT CAST(sum(n) AS BIGINT) AS findings, count(*) AS targets, CAST(round_even(avg(least(75, 45 + 3 * n)), 0) AS INTEGER) AS overall, max(n) AS largest FROM per",
    }
