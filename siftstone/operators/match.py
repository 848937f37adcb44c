"""Rules against lines: one scan of the files for all rules, patterns as literals.

What a pattern requires (`functions.literals`) and its gate are tested once per file and rule, before lines are made; each line then tries the rules that are
left, again after the literals, in one expression, and only hits are exploded. Nothing is shuffled until hits are aggregated.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.functions import classify, literals, scoring
from siftstone.functions.text import lines_of, strip, truncated
from siftstone.plans import gates
from siftstone.plans.lineage import materialize

MAX_LINE = 500


@dataclass(frozen=True)
class Rule:
    """mode: line or file. context: none, lines, named_groups or backward. aggregate: none or file (a file's matches are one entry of evidence)."""

    seq: int
    category: str
    name: str
    regex: str
    exclude: str = ""
    gate: str = ""
    has_text: bool = True
    before: int = 0
    after: int = 0
    platform: str = ""
    mode: str = "line"
    context: str = "none"
    label: str = ""
    depth: int = 10
    aggregate: str = "none"

    @property
    def anchor(self) -> str:
        """What lines are searched for: the pattern, or that of the gate if there is none."""
        return self.regex or (gates.parse(self.gate).anchor or "" if self.gate else "")


def scanned(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """files with passed (seqs of rules that may find something: their gate holds, or they have none, and the literals that their pattern requires are there) and lines.

    Literals are looked for once a file, before gates are tried or lines are made; files without rules that may find something are left out.
    """
    low = F.lower("content")
    ok = []
    for r in rules:
        may = literals.may_match(low, r.anchor)
        gate = gates.verdict(gates.parse(r.gate), F.col("content"), F.col("path"))["passed"] if r.gate else None
        told = F.lit(True) if may is None and gate is None else gate if may is None else may if gate is None else may & gate
        ok.append(F.when(told, F.lit(r.seq)))
    passed = F.array_compact(F.array(*ok))
    passed = F.array_intersect(passed, "only") if "only" in files.columns else passed
    return files.withColumn("passed", passed).filter(F.size("passed") > 0).withColumn("lines", lines_of(F.col("content")))


def gate_verdicts(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """path, rule_seq, passed, failed_at, reason for each file and gated rule."""
    each = [F.struct(F.lit(r.seq).alias("rule_seq"), gates.verdict(gates.parse(r.gate), F.col("content"), F.col("path")).alias("v")) for r in rules if r.gate]
    return files.select("path", F.explode(F.array(*each)).alias("x")).select("path", "x.rule_seq", "x.v.passed", "x.v.failed_at", "x.v.reason")


def _hit(rule: Rule, line: Column, flags: str = "") -> Column:
    found = line.rlike(flags + rule.anchor)
    return found & ~line.rlike("(?i)" + rule.exclude) if rule.exclude else found


def _pass(rule: Rule, line: Column, low: Column, twice: bool) -> Column:
    """0 for a line that a rule hits, 1 (only if tried twice) for one that it hits without case alone, else null. Patterns are tried on lines that hold their literals;
    a line that isn't hit without case isn't hit with it, and so is tried once."""
    exact = F.when(_hit(rule, line), 0)
    kind = F.when(_hit(rule, line, "(?i)"), F.coalesce(exact, F.lit(1)) if rule.regex else F.lit(1)) if twice else exact
    may = literals.may_match(low, rule.anchor)
    return kind if may is None else F.when(may, kind)


def evidence(files: DataFrame, rules: list[Rule], also: tuple[str, ...] = ()) -> DataFrame:
    """path, platform, file_seq, rule_seq, line, code, pass_no of each line that a rule hits, once, in files whose gate holds.

    A column `only` of files, if there is one, names the rules (seqs) that are tried on each; also: further columns of files to keep.
    pass 0 is case-sensitive; rules with a gate are tried again without case, which adds lines as pass 1. Each pattern stands once in the plan.
    """
    lines = scanned(files, rules).select("path", "platform", "file_seq", *also, "passed", F.posexplode("lines").alias("pos", "code"))
    lines = lines.filter(F.length("code") <= MAX_LINE)
    code, low = F.col("code"), F.lower("code")
    kinds = F.array(*[F.when(F.array_contains("passed", r.seq), _pass(r, code, low, bool(r.gate))) for r in rules])
    seqs = F.array(*[F.lit(r.seq) for r in rules])
    hits = F.filter(F.transform(kinds, lambda k, i: F.struct(F.get(seqs, i).alias("rule_seq"), k.alias("pass_no"))), lambda h: h["pass_no"].isNotNull())
    hit = lines.select("path", "platform", "file_seq", *also, (F.col("pos") + 1).alias("line"), "code", F.explode(hits).alias("hit"))
    return hit.select("path", "platform", "file_seq", *also, "hit.rule_seq", "line", "code", "hit.pass_no")


def gate_suppressed(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """path, platform, file_seq, rule_seq, line, code, pass_no, reason, gate of what gated rules find (without case too) in files whose gate fails."""
    gated = [r for r in rules if r.gate and r.anchor]
    verdicts = {r.seq: gates.verdict(gates.parse(r.gate), F.col("content"), F.col("path")) for r in gated}
    failed = F.array_compact(F.array(*[F.when(~v["passed"], F.struct(F.lit(seq).alias("rule_seq"), v["reason"].alias("reason"))) for seq, v in verdicts.items()]))
    rows = files.withColumn("failed", failed).filter(F.size("failed") > 0)
    lines = rows.select("path", "platform", "file_seq", "failed", F.posexplode(lines_of(F.col("content"))).alias("pos", "code")).filter(F.length("code") <= MAX_LINE)
    hits = []
    of_rule = lambda seq: F.filter("failed", lambda x: x["rule_seq"] == seq)
    for r in gated:
        own = of_rule(r.seq)
        kind = F.when(_hit(r, F.col("code")) if r.regex else F.lit(False), 0).when(_hit(r, F.col("code"), "(?i)"), 1)
        hits.append(F.when((F.size(own) > 0) & kind.isNotNull(), F.struct(F.lit(r.seq).alias("rule_seq"), kind.alias("pass_no"), F.get(own, F.lit(0))["reason"].alias("reason"), F.lit(r.gate).alias("gate"))))
    hit = lines.select("path", "platform", "file_seq", (F.col("pos") + 1).alias("line"), truncated(F.col("code")).alias("code"), F.explode(F.array_compact(F.array(*hits))).alias("h"))
    return hit.select("path", "platform", "file_seq", "h.rule_seq", "line", "code", "h.pass_no", "h.reason", "h.gate")


def placeholders(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """path, rule_seq, line, code for gated rules without any pattern: the gate itself is the evidence of a file that isn't empty."""
    bare = [r for r in rules if r.gate and not r.anchor]
    each = [F.when(gates.verdict(gates.parse(r.gate), F.col("content"), F.col("path"))["passed"], F.lit(r.seq)) for r in bare]
    found = files.filter("content <> ''").select("path", F.explode(F.array_compact(F.array(*each))).alias("rule_seq"))
    return found.withColumn("line", F.lit(1)).withColumn("code", F.lit("[condition holds]"))


#: Signals in lower-cased code.
TAINT, SINK, DYNAMIC = "input|param|request|user", "token|password|exec|query", r"[$+%]|\{"
PLAIN_CALL = r"\([^)]*\$[a-z_]"


def findings(hits: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per rule with hits: counts, files, score and level. Counts are sums of flags, so partial sums do the work.

    n counts entries of evidence. Entries of rules that aggregate by file are files, and have no code that could be a signal.
    """
    low = F.lower(strip(F.col("code")))
    alone = ~F.col("rule_seq").isin([r.seq for r in rules if r.aggregate == "file"]) if any(r.aggregate == "file" for r in rules) else F.lit(True)
    held = F.col("code") == "[condition holds]"
    taint, sink, dynamic = low.rlike(TAINT), low.rlike(SINK), low.rlike(DYNAMIC)
    flag = lambda c: F.count_if(c & ~held & alone)
    counts = hits.groupBy("rule_seq").agg(
        F.count("*").alias("matches"), F.count_distinct("path").alias("files"), flag(taint & sink).alias("direct"), flag(taint).alias("taint"), flag(sink).alias("sink"),
        flag(sink & dynamic).alias("both"), F.count_if(held & alone).alias("placeholder"), flag(sink & ~taint & low.rlike(PLAIN_CALL)).alias("sink_only"),
    )
    facts = hits.sparkSession.createDataFrame(
        [(r.seq, r.category, r.name, r.platform, r.aggregate == "file", bool(r.regex), bool(r.gate), r.has_text) for r in rules],
        "rule_seq int, category string, rule string, pack string, whole boolean, has_regex boolean, has_gate boolean, has_text boolean",
    )
    scored = counts.join(F.broadcast(facts), "rule_seq")  # as many rows as rules
    scored = scored.withColumn("n", F.when(F.col("whole"), F.col("files")).otherwise(F.col("matches")))
    score = scoring.source_confidence(*[F.col(c) for c in ("n", "files", "direct", "taint", "sink", "both", "placeholder", "sink_only", "has_regex", "has_gate", "has_text")])
    scored = scored.withColumn("score", score).withColumn("level", scoring.confidence_level(F.col("score")))
    # a number in the pack for each rule with hits, in order of the rules; as many rows as rules
    number = F.row_number().over(Window.partitionBy("pack").orderBy("rule_seq"))
    return scored.withColumn("rule_id", F.concat_ws("-", F.nullif("pack", F.lit("")), number.cast("string"))).withColumn("issue_scope", classify.issue_scope(F.col("category"), F.col("pack")))


def nested(hits: DataFrame, most: int = 1000) -> DataFrame:
    """rule_seq, part, evidence: array of (file, line, code), in order of files, passes and lines. Long lists go on in further parts of `most`
    entries, so that no row holds all of a hot rule. Places come from ranges of files, so no task orders all hits of a rule. They are written, as
    they are read twice, and a plan that made them twice might join ranges otherwise the second time."""
    slim = hits.select("rule_seq", "file_seq", "path", "pass_no", "line", truncated(F.col("code")).alias("code"))
    placed = slim.repartitionByRange("rule_seq", "file_seq", "path").sortWithinPartitions("rule_seq", "file_seq", "path", "pass_no", "line")
    placed = materialize(placed.withColumn("range", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "placed")
    first = placed.groupBy("range", "rule_seq").agg(F.min("row").alias("first"))
    whole = placed.join(F.broadcast(first), ["range", "rule_seq"])  # a row for each range and rule
    part = F.struct("range", F.floor((F.col("row") - F.col("first")) / most).cast("int").alias("chunk"))
    entry = F.struct("row", F.col("path").alias("file"), "line", "code")
    lists = whole.groupBy("rule_seq", part.alias("part")).agg(F.array_sort(F.collect_list(entry)).alias("evidence"))
    return lists.withColumn("evidence", F.transform("evidence", lambda e: F.struct(e["file"].alias("file"), e["line"].alias("line"), e["code"].alias("code"))))


def merged_metadata(verdicts: DataFrame) -> DataFrame:
    """rule_seq, reason, trace: of the verdicts of all files the first reason, and the lines of all traces once, in order of files."""
    reason = verdicts.filter("reason is not null").groupBy("rule_seq").agg(F.min_by("reason", "path").alias("reason"))
    told = verdicts.select("rule_seq", "path", F.posexplode("trace").alias("place", "told")).groupBy("rule_seq", "told").agg(F.min(F.struct("path", "place")).alias("at"))
    lists = told.groupBy("rule_seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "told"))), lambda x: x["told"]).alias("trace"))  # as many as programs have lines
    return verdicts.select("rule_seq").distinct().join(reason, "rule_seq", "left").join(lists, "rule_seq", "left")


def by_file(hits: DataFrame) -> DataFrame:
    """One entry per rule and file: all its matches, in order of pass and line. A file's matches are bounded by its lines."""
    listed = F.array_sort(F.collect_list(F.struct("pass_no", "line", "code")))
    found = hits.groupBy("rule_seq", "path").agg(F.count("*").alias("matches"), listed.alias("entries"))
    return found.withColumn("lines", F.transform("entries", lambda x: x["line"])).withColumn("codes", F.transform("entries", lambda x: truncated(x["code"]))).drop("entries")


def with_context(files: DataFrame, rules: list[Rule], whole: bool = False) -> DataFrame:
    """path, rule_seq, line, code (cut short if long, unless whole), before, after: lines around each hit, clipped at the file's ends, from the file's own row."""
    rows = scanned(files, rules)

    def around(r: Rule) -> Column:
        found = lambda line: _hit(r, line, "(?i)") if r.gate else _hit(r, line)  # noqa: E731  with a gate also without case
        at = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: (F.length(F.element_at("lines", i)) <= MAX_LINE) & found(F.element_at("lines", i)))

        def take(i: Column) -> Column:
            before = F.slice("lines", F.greatest(i - r.before, F.lit(1)), F.least(F.lit(r.before), i - 1))
            return F.struct(F.lit(r.seq).alias("rule_seq"), i.alias("line"), F.element_at("lines", i).alias("code"), before.alias("before"), F.slice("lines", i + 1, F.lit(r.after)).alias("after"))

        return F.when(F.array_contains("passed", r.seq) & (F.size("lines") > 0), F.transform(at, take)).otherwise(F.array())

    hits = [around(r) for r in rules]
    return rows.select("path", F.explode(F.flatten(F.array(*hits))).alias("h")).select("path", "h.*").withColumn("code", F.col("code") if whole else truncated(F.col("code")))


def backward_label(rows: DataFrame, key: str, order: str, text: str, pattern: str, depth: int, start: str) -> DataFrame:
    """rows where `start` matches, with label: what `pattern` found last among the `depth` rows before."""
    groups = 1 if re.compile(pattern).groups else 0  # the first group, if there is one
    found = F.when(F.col(text).rlike(pattern), F.regexp_extract(text, pattern, groups))
    label = F.last(found, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(-depth, -1))
    return rows.withColumn("label", label).filter(F.col(text).rlike(start))


def unmatched(rules: list[Rule], hits: DataFrame) -> DataFrame:
    every = hits.sparkSession.createDataFrame([(r.seq, r.name) for r in rules], "rule_seq int, rule string")
    return every.join(hits.select("rule_seq").distinct(), "rule_seq", "left_anti")


def _path_tests(paths: DataFrame, rules: list[Rule]) -> list[Column]:
    """For each rule whether a path ("/" before it) isn't excluded, and its gate holds or, without a gate, its pattern fits without case."""
    p = F.concat(F.lit("/"), F.ltrim(F.col("path"), F.lit("/")))
    tests = []
    for r in rules:
        ok = gates.verdict(gates.parse(r.gate), p, p)["passed"] if r.gate else p.rlike("(?i)" + r.regex) if r.regex else F.lit(False)
        tests.append(ok & ~F.col("path").rlike("(?i)" + r.exclude) if r.exclude else ok)
    return tests


def path_matches(paths: DataFrame, rules: list[Rule]) -> DataFrame:
    """path_seq, path, rule_seq of the paths that a rule fits."""
    each = [F.when(ok, F.lit(r.seq)) for r, ok in zip(rules, _path_tests(paths, rules), strict=True)]
    return paths.select(*paths.columns, F.explode(F.array_compact(F.array(*each))).alias("rule_seq"))


def path_misses(paths: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule_seq of the rules that some path doesn't fit: so a rule can be among these and among those that match."""
    each = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(r.seq)) for r, ok in zip(rules, _path_tests(paths, rules), strict=True)]
    return paths.select(F.explode(F.array_compact(F.array(*each))).alias("rule_seq")).distinct()


def path_findings(matches: DataFrame) -> DataFrame:
    counts = matches.groupBy("rule_seq").agg(F.count("*").alias("n"))
    return counts.withColumn("score", scoring.path_confidence(F.col("n"))).withColumn("level", scoring.confidence_level(F.col("score")))


def file_matches(files: DataFrame, regex: str, names: tuple[str, ...] = (), exclude: str = "") -> DataFrame:
    """path, line, code, groups: whole-file matches (. crosses lines, ^ and $ stand at lines), their first line and named groups.

    The text before a match is found by cutting at matches, so no Python is needed for offsets.
    """
    pattern = "(?ms)" + regex
    # the pieces between matches; the k-th match begins after the first k pieces and k - 1 matches
    each = [F.regexp_extract_all("content", F.lit(pattern), F.lit(i + 1)) for i in range(len(names))]  # with what stands around a match, and in the matches' order
    rows = files.select("path", F.regexp_extract_all("content", F.lit(pattern), F.lit(0)).alias("found"), F.split("content", pattern).alias("between"), F.array(*each).cast("array<array<string>>").alias("each"))
    breaks = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    placed = rows.select("path", F.posexplode("found").alias("k", "match"), "found", "between", "each")
    upto = F.aggregate(F.slice("between", F.lit(1), F.col("k") + 1), F.lit(0), lambda a, x: a + breaks(x)) + F.aggregate(F.slice("found", F.lit(1), F.col("k")), F.lit(0), lambda a, x: a + breaks(x))
    groups = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.transform("each", lambda g: F.get(g, F.col("k")))) if names else F.create_map().cast("map<string,string>")
    out = placed.select("path", (upto + 1).cast("int").alias("line"), F.regexp_extract("match", r"^[^\n]*", 0).alias("code"), groups.alias("groups"))
    return out.filter(~F.col("code").rlike("(?i)" + exclude)) if exclude else out
