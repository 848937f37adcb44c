"""Queries of scanning, gates, findings, suppression and review, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from siftstone.functions import text as T
from siftstone.operators import match, review
from siftstone.operators.match import Rule
from siftstone.plans import gates
from siftstone.plans.lineage import materialize
from siftstone.sources.tables import files, page_files, small, table

RULES = [
    Rule(1, "secrets", "token assignment", r'token\s*=\s*"[0-9a-f]{8,}', gate="WHEN PRESENT /token/"),
    Rule(2, "contact", "mail address", r"[a-z]+\.[0-9]+@mail[0-9]", exclude="mail0"),
    Rule(3, "network", "address literal", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", before=1, after=2),
    Rule(4, "licensing", "licence notice", r"license", gate="WHEN EXPR PRESENT:licen[cs]e && !PRESENT:GNU", before=2, after=1),
    Rule(5, "wording", "insult", r"(stupid|idiot)", gate="WHEN MISSING /Apache/\nUNLESS CURRENT_FILE_MATCHES /password/", has_text=False),
    Rule(6, "noise", "symbols", r"[#*$%&]{3}"),
]
PATH_RULES = [Rule(1, "paths", "spam hosts", "spam|pills"), Rule(2, "paths", "language folder", "/(de|fr)/", exclude="page=2"), Rule(3, "paths", "page suffix", r"\.html"), Rule(4, "paths", "never", "no-such-thing")]
GATES = [
    ("plain", "report as Licence\nWHEN PRESENT /licen[cs]e/i\nWHEN MISSING /GNU/\nREASON looks free"),
    ("mixed", "WHEN FILE_PATH_MATCHES src1*/en/*\nWHEN CURRENT_FILE_MATCHES the\nUNLESS CURRENT_FILE_MATCHES /token/\nFAIL_REASON out of scope"),
    ("logic", r"WHEN EXPR (PRESENT:stupid || EXISTS:idiot) && MISSING://[a-z]+\.example || !PRESENT:e"),
    ("name", "WHEN FILE_NAME_IS 7.txt\n# comment\nNOSUCH command"),
]
ENTRIES = [
    ("en", "symbols", None, None, None, None, None),
    (None, "address literal", "", "SRC1\\en\\21.txt", None, "", ""),
    (None, None, "Contact", None, None, "/de/", None),
    ("", "", "", "", None, "", "license|licence"),
    (None, "insult", None, None, 3, None, None),
]
ENTRY_SCHEMA = "platform string, rule string, category string, file string, line int, path_regex string, code_regex string"

FILES = """files AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, lang AS platform, text AS content, doc_id AS file_seq FROM documents),
split AS (SELECT *, string_split(content, chr(10)) AS l0 FROM files),
listed AS (SELECT path, platform, content, file_seq, CASE WHEN l0[len(l0)] = '' THEN l0[1:len(l0) - 1] ELSE l0 END AS l FROM split),
lines AS (SELECT path, platform, content, file_seq, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS code FROM listed)"""
HITS = (
    FILES
    + """,
passed AS (SELECT *, regexp_matches(content, 'token') AS g1, regexp_matches(content, 'licen[cs]e', 'i') AND NOT regexp_matches(content, 'GNU', 'i') AS g4, NOT regexp_matches(content, 'Apache') AND NOT regexp_matches(content, 'password') AS g5 FROM lines WHERE length(code) <= 500),
hits AS (
  SELECT path, platform, file_seq, 1 AS rule_seq, 'token assignment' AS rule, 'secrets' AS category, line, code, CASE WHEN regexp_matches(code, 'token\\s*=\\s*"[0-9a-f]{8,}') THEN 0 ELSE 1 END AS pass_no FROM passed WHERE g1 AND regexp_matches(code, 'token\\s*=\\s*"[0-9a-f]{8,}', 'i')
  UNION ALL SELECT path, platform, file_seq, 2, 'mail address', 'contact', line, code, 0 FROM passed WHERE regexp_matches(code, '[a-z]+\\.[0-9]+@mail[0-9]') AND NOT regexp_matches(code, 'mail0', 'i')
  UNION ALL SELECT path, platform, file_seq, 3, 'address literal', 'network', line, code, 0 FROM passed WHERE regexp_matches(code, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}')
  UNION ALL SELECT path, platform, file_seq, 4, 'licence notice', 'licensing', line, code, CASE WHEN regexp_matches(code, 'license') THEN 0 ELSE 1 END FROM passed WHERE g4 AND regexp_matches(code, 'license', 'i')
  UNION ALL SELECT path, platform, file_seq, 5, 'insult', 'wording', line, code, CASE WHEN regexp_matches(code, '(stupid|idiot)') THEN 0 ELSE 1 END FROM passed WHERE g5 AND regexp_matches(code, '(stupid|idiot)', 'i')
  UNION ALL SELECT path, platform, file_seq, 6, 'symbols', 'noise', line, code, 0 FROM passed WHERE regexp_matches(code, '[#*$%&]{3}')
)"""
)
SCORED = """counts AS (
  SELECT rule_seq, any_value(rule) AS rule, any_value(category) AS category, count(*) AS n, count(DISTINCT path) AS files,
    count(*) FILTER (regexp_matches(lower(code), 'input|param|request|user') AND regexp_matches(lower(code), 'token|password|exec|query')) AS direct,
    count(*) FILTER (regexp_matches(lower(code), 'input|param|request|user')) AS taint, count(*) FILTER (regexp_matches(lower(code), 'token|password|exec|query')) AS sink,
    count(*) FILTER (regexp_matches(lower(code), 'token|password|exec|query') AND regexp_matches(lower(code), '[$+%]|\\{')) AS both_,
    count(*) FILTER (regexp_matches(lower(code), 'token|password|exec|query') AND NOT regexp_matches(lower(code), 'input|param|request|user') AND regexp_matches(lower(code), '\\([^)]*\\$[a-z_]')) AS sink_only
  FROM hits GROUP BY rule_seq
), raw AS (
  SELECT *, 28 + least(10, 2 * n) + least(6, 2 * files) + 8 + CASE WHEN rule_seq IN (1, 4, 5) THEN 6 ELSE 0 END + CASE WHEN rule_seq = 5 THEN 0 ELSE 2 END
    + least(28, 12 * direct) + least(16, 4 * taint) + least(12, 4 * both_) - least(18, 4 * sink_only) AS s FROM counts
), capped AS (
  SELECT *, CASE WHEN direct = 0 THEN least(s - 10, 74) - CASE WHEN n >= 12 THEN 6 ELSE 0 END ELSE s END - CASE WHEN sink > 0 AND sink_only >= sink THEN 8 ELSE 0 END AS t FROM raw
), scored AS (
  SELECT rule_seq, category, rule, n, files, CAST(greatest(10, least(96, t)) AS INTEGER) AS score FROM capped
)"""
LEVEL = "CASE WHEN score >= 80 THEN 'high' WHEN score >= 60 THEN 'medium' ELSE 'low' END AS level"


def hits_of(spark, sf_dir):
    facts = small(spark, [(r.seq, r.name, r.category) for r in RULES], "rule_seq int, rule string, category string")
    return match.evidence(files(spark, sf_dir), RULES).join(F.broadcast(facts), "rule_seq")


def written_hits(spark, sf_dir):
    """hits_of for a plan that reads them more than once: files are scanned once."""
    return materialize(hits_of(spark, sf_dir), "hits")


def line_explode_stats(spark, sf_dir):
    lines = files(spark, sf_dir).select("path", F.explode(T.lines_of(F.col("content"))).alias("code"))
    return lines.groupBy("path").agg(F.count("*").alias("n_lines"), F.count_if(F.length("code") > 500).alias("n_long"), F.max(F.length("code")).alias("longest"))


def rule_line_matches(spark, sf_dir):
    return hits_of(spark, sf_dir).select("path", "rule_seq", "line", "pass_no")


def rule_rescan_counts(spark, sf_dir):
    return hits_of(spark, sf_dir).groupBy("rule").agg(F.count_if(F.col("pass_no") == 0).alias("cased"), F.count_if(F.col("pass_no") == 1).alias("added"))


def gate_verdicts(spark, sf_dir):
    f = files(spark, sf_dir)
    each = [F.struct(F.lit(name).alias("gate"), gates.verdict(gates.parse(script), F.col("content"), F.col("path")).alias("v")) for name, script in GATES]
    return f.select("path", F.explode(F.array(*each)).alias("x")).select("path", "x.gate", "x.v.passed", F.coalesce("x.v.failed_at", F.lit(0)).alias("failed_at"), "x.v.reason")


def gate_verdict_metadata(spark, sf_dir):
    """Per gate: files that pass, first reasons by path in order, distinct."""
    v = gate_verdicts(spark, sf_dir)
    reasons = v.filter("reason is not null").groupBy("gate", "reason").agg(F.min("path").alias("p"))
    merged = reasons.groupBy("gate").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "reason"))), lambda x: x["reason"]).alias("reasons"))
    return v.groupBy("gate").agg(F.count_if("passed").alias("passed"), F.min(F.nullif("failed_at", F.lit(0))).alias("first_failed")).join(merged, "gate", "left").select("gate", "passed", "first_failed", F.array_join("reasons", "; ").alias("reasons"))


def gate_project_observation(spark, sf_dir):
    program = gates.parse("OBSERVE PROJECT_HAS_GLOB *1/fr AS french\nOBSERVE PROJECT_HAS_GLOB *9.txt\nOBSERVE PROJECT_HAS_GLOB src0/*/1?.txt AS tens")
    return gates.observed(files(spark, sf_dir), program).select("label", "n", F.array_join("entries", ",").alias("entries"))


def rule_reference_lint(spark, sf_dir):
    """Parts stand for rules (type: pattern, brand: logic file), large ones for logic files (their maker: anchor, type: tokens)."""
    part = table(spark, sf_dir, "part")
    rules = part.select(F.col("p_partkey").alias("seq"), F.when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_type")).alias("regex"), F.concat_ws("/", "p_brand", (F.col("p_size") % 5).cast("string")).alias("logic"))
    logic = part.filter("p_size > 40").groupBy(F.concat_ws("/", "p_brand", (F.col("p_size") % 5).cast("string")).alias("logic")).agg(F.min("p_type").alias("anchor"), F.max("p_name").alias("tokens"))
    joined = rules.join(logic, "logic", "left")
    problems = F.array_compact(F.array(
        F.when(F.coalesce("regex", F.lit("")) == "", "missing pattern"), F.when(F.col("logic").isNotNull() & F.col("anchor").isNull(), "missing logic"),
        F.when(F.col("anchor").isNotNull() & (F.coalesce("regex", F.lit("")) != F.col("anchor")), "anchor differs"), F.when(F.col("tokens").rlike("(?i)ring|bolt"), "names a mitigation"),
    ))
    return joined.select("seq", F.explode(problems).alias("problem"))


def findings_scored(spark, sf_dir):
    found = match.findings(match.evidence(files(spark, sf_dir), RULES), RULES)
    return found.select("rule_seq", "category", "rule", "n", "files", "score", "level")


#: Rules of packs, one of which has its evidence by file.
PACKED = [replace(r, platform="office" if r.seq < 4 else "prose", aggregate="file" if r.seq == 6 else "none") for r in RULES]


def findings_numbered(spark, sf_dir):
    """Findings with their number in the pack and scope, evidence of one rule by file."""
    found = match.findings(match.evidence(files(spark, sf_dir), PACKED), PACKED)
    return found.select("rule_id", "rule", "issue_scope", F.col("n").cast("long").alias("n"), "score")


def findings_nested(spark, sf_dir):
    """Evidence lists in parts of 50: entries of each rule and the first and last of all, by file and line."""
    parts = match.nested(hits_of(spark, sf_dir), 50).select("rule_seq", F.explode("evidence").alias("e"), (F.size("evidence") <= 50).alias("bounded"))
    at = F.struct("e.file", "e.line")
    return parts.groupBy("rule_seq").agg(F.count("*").alias("n"), F.min("bounded").alias("bounded"), F.min(at).alias("a"), F.max(at).alias("z")).select("rule_seq", "n", "bounded", F.col("a.file").alias("first_file"), F.col("a.line").alias("first_line"), F.col("z.file").alias("last_file"), F.col("z.line").alias("last_line"))


def gate_suppressed_rows(spark, sf_dir):
    """What rules find in files that their gates reject."""
    return match.gate_suppressed(files(spark, sf_dir), RULES).select("path", "rule_seq", "line", "pass_no", "reason")


MODES = r"PRESENT:the\( && PRESENT:e || PRESENT:le\s"


def gate_expression_modes(spark, sf_dir):
    """An expression with an unbalanced parenthesis in a pattern, where all parentheses count and where only those of the expression do."""
    text = F.col("content")
    parity, strict = (gates.expression(MODES, text, mode) for mode in (False, True))
    return files(spark, sf_dir).select("path", parity.alias("parity"), strict.alias("strict"))


def gate_traces(spark, sf_dir):
    """What is told of each gate of a program, and merged over all files."""
    program = gates.parse(GATES[0][1] + "\nTRACE read as licence")
    v = gates.verdict(program, F.col("content"), F.col("path"))
    told = files(spark, sf_dir).select("path", F.lit(1).alias("rule_seq"), v.alias("v")).select("path", "rule_seq", "v.reason", gates.trace(program, F.col("v.failed_at")).alias("trace"))
    return match.merged_metadata(materialize(told, "traces")).select("rule_seq", "reason", F.array_join("trace", " | ").alias("trace"))


def findings_aggregate_file(spark, sf_dir):
    return match.by_file(hits_of(spark, sf_dir)).select("rule_seq", "path", "matches", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


def placeholder_evidence(spark, sf_dir):
    rules = [Rule(1, "gate", "free", "", gate=GATES[0][1]), Rule(2, "gate", "logic", "", gate=GATES[2][1])]
    return match.placeholders(files(spark, sf_dir), rules)


def context_window(spark, sf_dir):
    rows = match.with_context(files(spark, sf_dir), [r for r in RULES if r.before or r.after])
    return rows.select("path", "rule_seq", "line", "code", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"))


def backward_label(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return match.backward_label(t, "conv_id", "turn", "text", "([A-Z])[a-z]+", 2, "[.]").select("conv_id", "turn", "label")


def path_rules(spark, sf_dir):
    m = match.path_matches(page_files(spark, sf_dir), PATH_RULES)
    return match.path_findings(m).select("rule_seq", "n", "score", "level")


GATED_PATHS = [Rule(1, "paths", "gated", "never used", gate="WHEN PRESENT /spam|blog/\nWHEN MISSING /page=/"), Rule(2, "paths", "plain", "/en/", exclude="ref=")]


def path_rules_gated(spark, sf_dir):
    """Path rules whose gates read the path instead of a pattern."""
    return match.path_findings(match.path_matches(page_files(spark, sf_dir), GATED_PATHS)).select("rule_seq", "n", "score")


def path_rule_misses(spark, sf_dir):
    """Rules that some path doesn't fit: all of them, though some also match."""
    return match.path_misses(page_files(spark, sf_dir), PATH_RULES)


def path_rules_unmatched(spark, sf_dir):
    return match.unmatched(PATH_RULES, match.path_matches(page_files(spark, sf_dir), PATH_RULES))


def file_mode_groups(spark, sf_dir):
    found = match.file_matches(page_files(spark, sf_dir), '<a href="/(?<target>[a-z]+)">(?<label>[a-z]+)</a>', ("target", "label"), exclude="/de")
    return found.select("path", "line", "code", F.col("groups")["target"].alias("target"), F.col("groups")["label"].alias("label"))


def active_findings(spark, sf_dir):
    return review.active(hits_of(spark, sf_dir), small(spark, ENTRIES, ENTRY_SCHEMA)).select("path", "rule_seq", "line")


def suppressed_findings(spark, sf_dir):
    return review.suppressed(hits_of(spark, sf_dir), small(spark, ENTRIES, ENTRY_SCHEMA)).select("path", "rule_seq", "line")


def suppressed_summary(spark, sf_dir):
    s = review.suppressed(hits_of(spark, sf_dir), small(spark, ENTRIES, ENTRY_SCHEMA))
    return s.agg(F.count("*").alias("total"), F.count_distinct("rule").alias("conditions"), F.count_if(F.col("pass_no") == 1).alias("promoted"))


def baseline_entries(spark, sf_dir):
    return review.baseline(hits_of(spark, sf_dir))


def baseline_idempotent(spark, sf_dir):
    """Nothing is left when findings are suppressed by their own baseline."""
    hits = written_hits(spark, sf_dir)
    left = review.active(hits, review.as_entries(review.baseline(hits)))
    return left.agg(F.count("*").alias("left_over"))


def _review_rules(spark):
    rows = [(1, "false_positive", "fr", "", ""), (2, "confirmed", "", "symbols", ""), (3, "Suppressed ", None, "address literal", None), (4, "odd", "de", "", ""), (5, "confirmed", "", "", "contact")]
    return small(spark, rows, "seq int, status string, platform string, rule string, category string")


def _per_rule(spark, sf_dir):
    per = hits_of(spark, sf_dir).groupBy("platform", "rule", "category").agg(F.count("*").alias("n"))
    return per.withColumn("key", F.concat_ws("::", "platform", "rule"))


def review_first_match(spark, sf_dir):
    return review.first_status(_per_rule(spark, sf_dir), _review_rules(spark), ["platform", "rule", "category"], "key").select("key", "n", "status")


def review_breakdown(spark, sf_dir):
    return review.breakdown(review.first_status(_per_rule(spark, sf_dir), _review_rules(spark), ["platform", "rule", "category"], "key"))


def review_filtered(spark, sf_dir):
    return review.kept(review.first_status(_per_rule(spark, sf_dir), _review_rules(spark), ["platform", "rule", "category"], "key")).select("key", "n")


def review_rules_from_findings(spark, sf_dir):
    return review.rules_from(hits_of(spark, sf_dir))


def finding_search(spark, sf_dir):
    """Platform and text filters of the findings list."""
    h = hits_of(spark, sf_dir)
    hay = F.lower(F.concat_ws(" ", "rule", "category", "path"))
    return h.filter((F.lower("platform") == F.lower(F.lit("EN"))) & (F.instr(hay, "src1") > 0) & (F.col("category") != "noise")).select("path", "rule", "line")


def queries():
    return {f.__name__: f for f in (
        line_explode_stats, rule_line_matches, rule_rescan_counts, gate_verdicts, gate_verdict_metadata, gate_project_observation, rule_reference_lint, findings_scored, findings_numbered, findings_nested, gate_suppressed_rows, gate_expression_modes, gate_traces, path_rules_gated, path_rule_misses, findings_aggregate_file, placeholder_evidence,
        context_window, backward_label, path_rules, path_rules_unmatched, file_mode_groups, active_findings, suppressed_findings, suppressed_summary, baseline_entries, baseline_idempotent,
        review_first_match, review_breakdown, review_filtered, review_rules_from_findings, finding_search,
    )}


def oracle_sql():
    path_hits = """paths AS (SELECT page_id AS file_seq, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages),
m AS (SELECT path, 1 AS rule_seq FROM paths WHERE regexp_matches('/' || path, 'spam|pills', 'i') UNION ALL SELECT path, 2 FROM paths WHERE regexp_matches('/' || path, '/(de|fr)/', 'i') AND NOT regexp_matches(path, 'page=2', 'i')
  UNION ALL SELECT path, 3 FROM paths WHERE regexp_matches('/' || path, '\\.html', 'i'))"""
    verdicts = (
        FILES
        + """, v AS (
  SELECT path, 'plain' AS gate, CASE WHEN NOT regexp_matches(content, 'licen[cs]e', 'i') THEN 1 WHEN regexp_matches(content, 'GNU') THEN 2 END AS failed_at, CASE WHEN NOT regexp_matches(content, 'licen[cs]e', 'i') THEN 'required pattern is absent' WHEN regexp_matches(content, 'GNU') THEN 'forbidden pattern is there' ELSE 'looks free' END AS reason FROM files
  UNION ALL SELECT path, 'mixed', CASE WHEN NOT regexp_matches(path, '^src1.*/en/.*$') THEN 1 WHEN NOT regexp_matches(content, 'the', 'i') THEN 2 WHEN regexp_matches(content, 'token') THEN 3 END, NULL FROM files
  UNION ALL SELECT path, 'logic', CASE WHEN ((regexp_matches(content, 'stupid', 'i') OR regexp_matches(content, 'idiot', 'i')) AND NOT regexp_matches(content, '//[a-z]+[.]example', 'i')) OR NOT regexp_matches(content, 'e', 'i') THEN NULL ELSE 1 END, NULL FROM files
  UNION ALL SELECT path, 'name', CASE WHEN string_split(path, '/')[3] = '7.txt' THEN NULL ELSE 1 END, NULL FROM files
), verdicts AS (SELECT path, gate, failed_at IS NULL AS passed, CAST(coalesce(failed_at, 0) AS INTEGER) AS failed_at,
  CASE gate WHEN 'plain' THEN reason WHEN 'mixed' THEN CASE WHEN failed_at IS NOT NULL THEN 'out of scope' END WHEN 'logic' THEN CASE WHEN failed_at IS NOT NULL THEN 'condition does not hold' END ELSE CASE WHEN failed_at IS NOT NULL THEN 'file has another name' END END AS reason FROM v)"""
    )
    covered = """(regexp_matches(lower(platform), '^en$') AND rule = 'symbols') OR (rule = 'address literal' AND lower(path) = 'src1/en/21.txt') OR (category = 'contact' AND regexp_matches(path, '/de/', 'i')) OR regexp_matches(code, 'license|licence', 'i') OR (rule = 'insult' AND line = 3)"""
    per_rule = """, per AS (SELECT platform || '::' || rule AS key, platform, rule, category, count(*) AS n FROM hits GROUP BY platform, rule, category),
reviewed AS (SELECT key, n, CASE WHEN platform = 'fr' THEN 'false_positive' WHEN rule = 'symbols' THEN 'confirmed' WHEN rule = 'address literal' THEN 'suppressed' WHEN platform = 'de' THEN 'pending' WHEN category = 'contact' THEN 'confirmed' ELSE 'pending' END AS status FROM per)"""
    return {
        "line_explode_stats": f"WITH {FILES} SELECT path, count(*) AS n_lines, count(*) FILTER (length(code) > 500) AS n_long, CAST(max(length(code)) AS INTEGER) AS longest FROM lines GROUP BY path",
        "rule_line_matches": f"WITH {HITS} SELECT path, rule_seq, CAST(line AS INTEGER) AS line, pass_no FROM hits",
        "rule_rescan_counts": f"WITH {HITS} SELECT rule, count(*) FILTER (pass_no = 0) AS cased, count(*) FILTER (pass_no = 1) AS added FROM hits GROUP BY rule",
        "gate_verdicts": f"WITH {verdicts} SELECT * FROM verdicts",
        "gate_verdict_metadata": f"WITH {verdicts}, r AS (SELECT gate, reason, min(path) AS p FROM verdicts WHERE reason IS NOT NULL GROUP BY gate, reason), t AS (SELECT gate, string_agg(reason, '; ' ORDER BY p) AS reasons FROM r GROUP BY gate) SELECT v.gate, count(*) FILTER (passed) AS passed, min(nullif(failed_at, 0)) AS first_failed, any_value(reasons) AS reasons FROM verdicts v LEFT JOIN t ON v.gate = t.gate GROUP BY v.gate",
        "gate_project_observation": f"""WITH {FILES}, entries AS (SELECT DISTINCT e FROM (SELECT path AS e FROM files UNION ALL SELECT source || '/' || lang FROM documents UNION ALL SELECT source FROM documents)),
t AS (SELECT 'french' AS label, e FROM entries WHERE regexp_matches(e, '^.*1/fr$') UNION ALL SELECT '*9.txt', e FROM entries WHERE regexp_matches(e, '^.*9\\.txt$') UNION ALL SELECT 'tens', e FROM entries WHERE regexp_matches(e, '^src0/.*/1.\\.txt$')),
k AS (SELECT label, e, row_number() OVER (PARTITION BY label ORDER BY e) AS i FROM t) SELECT label, count(*) AS n, string_agg(e, ',' ORDER BY e) FILTER (i <= 8) AS entries FROM k GROUP BY label""",
        "rule_reference_lint": """WITH r AS (SELECT p_partkey AS seq, CASE WHEN p_size % 7 = 0 THEN '' ELSE p_type END AS regex, p_brand || '/' || (p_size % 5) AS logic FROM part), l AS (SELECT p_brand || '/' || (p_size % 5) AS logic, min(p_type) AS anchor, max(p_name) AS tokens FROM part WHERE p_size > 40 GROUP BY 1), j AS (SELECT seq, regex, anchor, tokens FROM r LEFT JOIN l ON r.logic = l.logic)
SELECT seq, 'missing pattern' AS problem FROM j WHERE regex = '' UNION ALL SELECT seq, 'missing logic' FROM j WHERE anchor IS NULL UNION ALL SELECT seq, 'anchor differs' FROM j WHERE anchor IS NOT NULL AND regex <> anchor UNION ALL SELECT seq, 'names a mitigation' FROM j WHERE regexp_matches(tokens, 'ring|bolt', 'i')""",
        "findings_numbered": f"""WITH {HITS}, {SCORED}, whole AS (SELECT rule_seq, CAST(files AS BIGINT) AS n, 28 + least(10, 2 * files) + least(6, 2 * files) + 10 - 10 - CASE WHEN files >= 12 THEN 6 ELSE 0 END AS score FROM counts WHERE rule_seq = 6),
k AS (SELECT *, CASE WHEN rule_seq < 4 THEN 'office' ELSE 'prose' END AS pack FROM scored)
SELECT pack || '-' || row_number() OVER (PARTITION BY pack ORDER BY k.rule_seq) AS rule_id, rule, 'source' AS issue_scope, CASE WHEN k.rule_seq = 6 THEN w.n ELSE k.n END AS n, CAST(CASE WHEN k.rule_seq = 6 THEN greatest(10, least(74, w.score)) ELSE k.score END AS INTEGER) AS score FROM k LEFT JOIN whole w ON k.rule_seq = w.rule_seq""",
        "findings_nested": f"WITH {HITS} SELECT rule_seq, count(*) AS n, true AS bounded, min((path, line)).path AS first_file, CAST(arg_min(line, (path, line)) AS INTEGER) AS first_line, max(path) AS last_file, CAST(arg_max(line, (path, line)) AS INTEGER) AS last_line FROM hits GROUP BY rule_seq".replace("min((path, line)).path", "min(path)"),
        "gate_suppressed_rows": f"""WITH {FILES}, t AS (SELECT *, regexp_matches(content, 'token') AS g1, regexp_matches(content, 'licen[cs]e', 'i') AND NOT regexp_matches(content, 'GNU', 'i') AS g4, regexp_matches(content, 'Apache') AS apache, NOT regexp_matches(content, 'Apache') AND NOT regexp_matches(content, 'password') AS g5 FROM lines WHERE length(code) <= 500)
SELECT path, 1 AS rule_seq, CAST(line AS INTEGER) AS line, CASE WHEN regexp_matches(code, 'token\\s*=\\s*"[0-9a-f]{{8,}}') THEN 0 ELSE 1 END AS pass_no, 'required pattern is absent' AS reason FROM t WHERE NOT g1 AND regexp_matches(code, 'token\\s*=\\s*"[0-9a-f]{{8,}}', 'i')
UNION ALL SELECT path, 4, CAST(line AS INTEGER), CASE WHEN regexp_matches(code, 'license') THEN 0 ELSE 1 END, 'condition does not hold' FROM t WHERE NOT g4 AND regexp_matches(code, 'license', 'i')
UNION ALL SELECT path, 5, CAST(line AS INTEGER), CASE WHEN regexp_matches(code, '(stupid|idiot)') THEN 0 ELSE 1 END, CASE WHEN apache THEN 'forbidden pattern is there' ELSE 'file matches an exemption' END FROM t WHERE NOT g5 AND regexp_matches(code, '(stupid|idiot)', 'i')""",
        "gate_expression_modes": f"WITH {FILES} SELECT path, true AS parity, (regexp_matches(content, 'the[(]', 'i') AND regexp_matches(content, 'e', 'i')) OR regexp_matches(content, 'le\\s', 'i') AS strict FROM files",
        "gate_traces": f"WITH {verdicts}, p AS (SELECT * FROM verdicts WHERE gate = 'plain'), t AS (SELECT path, 0 AS place, 'WHEN PRESENT /licen[cs]e/i: holds' AS told FROM p WHERE failed_at <> 1 UNION ALL SELECT path, 0, 'WHEN PRESENT /licen[cs]e/i: required pattern is absent' FROM p WHERE failed_at = 1 UNION ALL SELECT path, 1, 'WHEN MISSING /GNU/: holds' FROM p WHERE failed_at = 0 UNION ALL SELECT path, 1, 'WHEN MISSING /GNU/: forbidden pattern is there' FROM p WHERE failed_at = 2 UNION ALL SELECT path, 2, 'read as licence' FROM p WHERE failed_at = 0), m AS (SELECT told, min(path || '#' || place) AS w FROM t GROUP BY told) SELECT 1 AS rule_seq, (SELECT arg_min(reason, path) FROM p WHERE reason IS NOT NULL) AS reason, (SELECT string_agg(told, ' | ' ORDER BY w) FROM m) AS trace",
        "path_rules_gated": "WITH p AS (SELECT '/' || regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), m AS (SELECT 1 AS rule_seq FROM p WHERE regexp_matches(path, 'spam|blog') AND NOT contains(path, 'page=') UNION ALL SELECT 2 FROM p WHERE regexp_matches(path, '/en/', 'i') AND NOT regexp_matches(path, 'ref=', 'i')), c AS (SELECT rule_seq, count(*) AS n FROM m GROUP BY rule_seq) SELECT rule_seq, n, CAST(greatest(35, least(96, 50 + least(36, 6 * n))) AS INTEGER) AS score FROM c",
        "path_rule_misses": "SELECT * FROM (VALUES (1), (2), (3), (4)) AS x(rule_seq)",
        "findings_scored": f"WITH {HITS}, {SCORED} SELECT rule_seq, category, rule, n, files, score, {LEVEL} FROM scored",
        "findings_aggregate_file": f"WITH {HITS}, k AS (SELECT *, row_number() OVER (PARTITION BY rule_seq, path ORDER BY pass_no, line) AS i FROM hits) SELECT rule_seq, path, count(*) AS matches, string_agg(CAST(line AS VARCHAR), ',' ORDER BY i) AS lines FROM k GROUP BY rule_seq, path",
        "placeholder_evidence": f"WITH {verdicts} SELECT v.path, 2 AS rule_seq, 1 AS line, '[condition holds]' AS code FROM verdicts v JOIN files f ON v.path = f.path WHERE gate = 'logic' AND passed AND content <> ''",
        "context_window": f"""WITH {HITS} SELECT h.path, rule_seq, CAST(line AS INTEGER) AS line, trim(CASE WHEN length(code) > 300 THEN code[1:75] || '..' ELSE code END, ' ') AS code,
array_to_string(l[greatest(line - CASE rule_seq WHEN 3 THEN 1 ELSE 2 END, 1):line - 1], '|') AS before, array_to_string(l[line + 1:least(line + CASE rule_seq WHEN 3 THEN 2 ELSE 1 END, len(l))], '|') AS after FROM hits h JOIN listed s ON h.path = s.path WHERE rule_seq IN (3, 4)""",
        "backward_label": """WITH t AS (SELECT *, CASE WHEN regexp_matches(text, '[A-Z][a-z]+') THEN regexp_extract(text, '([A-Z])[a-z]+', 1) END AS f FROM conversations), w AS (SELECT *, coalesce(lag(f, 1) OVER o, lag(f, 2) OVER o) AS label FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, label FROM w WHERE regexp_matches(text, '[.]')""",
        "path_rules": f"WITH {path_hits}, c AS (SELECT rule_seq, count(*) AS n FROM m GROUP BY rule_seq), s AS (SELECT *, CAST(greatest(35, least(96, 50 + least(36, 6 * n))) AS INTEGER) AS score FROM c) SELECT rule_seq, n, score, {LEVEL} FROM s",
        "path_rules_unmatched": f"WITH {path_hits} SELECT * FROM (VALUES (1, 'spam hosts'), (2, 'language folder'), (3, 'page suffix'), (4, 'never')) AS r(rule_seq, rule) WHERE rule_seq NOT IN (SELECT rule_seq FROM m)",
        "file_mode_groups": """WITH p AS (SELECT regexp_replace(url, '^[a-z]+://', '') AS path, html, regexp_extract_all(html, '<a href="/([a-z]+)">([a-z]+)</a>') AS m, regexp_split_to_array(html, '<a href="/[a-z]+">[a-z]+</a>') AS s FROM pages),
k AS (SELECT path, m, s, unnest(range(1, len(m) + 1)) AS i FROM p)
SELECT path, CAST(1 + length(array_to_string(s[1:i], '')) - length(replace(array_to_string(s[1:i], ''), chr(10), '')) AS INTEGER) AS line, m[i] AS code, regexp_extract(m[i], '<a href="/([a-z]+)">', 1) AS target, regexp_extract(m[i], '>([a-z]+)</a>', 1) AS label FROM k WHERE NOT regexp_matches(m[i], '/de', 'i')""",
        "active_findings": f"WITH {HITS} SELECT path, rule_seq, CAST(line AS INTEGER) AS line FROM hits WHERE NOT ({covered})",
        "suppressed_findings": f"WITH {HITS} SELECT path, rule_seq, CAST(line AS INTEGER) AS line FROM hits WHERE {covered}",
        "suppressed_summary": f"WITH {HITS} SELECT count(*) AS total, count(DISTINCT rule) AS conditions, count(*) FILTER (pass_no = 1) AS promoted FROM hits WHERE {covered}",
        "baseline_entries": f"WITH {HITS} SELECT DISTINCT platform, rule, category, path AS file, CAST(line AS INTEGER) AS line FROM hits",
        "baseline_idempotent": f"WITH {HITS}, b AS (SELECT DISTINCT platform, rule, category, path, line FROM hits) SELECT count(*) AS left_over FROM hits h WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.platform = h.platform AND b.rule = h.rule AND b.category = h.category AND b.path = h.path AND b.line = h.line)",
        "review_first_match": f"WITH {HITS}{per_rule} SELECT key, n, status FROM reviewed",
        "review_breakdown": f"WITH {HITS}{per_rule} SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'false_positive') AS false_positive, count(*) FILTER (status = 'suppressed') AS suppressed FROM reviewed",
        "review_filtered": f"WITH {HITS}{per_rule} SELECT key, n FROM reviewed WHERE status NOT IN ('false_positive', 'suppressed')",
        "review_rules_from_findings": f"WITH {HITS}, k AS (SELECT *, row_number() OVER (PARTITION BY platform, rule ORDER BY file_seq, line) AS i FROM hits) SELECT platform, rule, path AS file, CAST(line AS INTEGER) AS line, 'pending' AS status FROM k WHERE i = 1",
        "finding_search": f"WITH {HITS} SELECT path, rule, CAST(line AS INTEGER) AS line FROM hits WHERE platform = 'en' AND strpos(lower(rule || ' ' || category || ' ' || path), 'src1') > 0 AND category <> 'noise'",
    }
