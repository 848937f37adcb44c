"""Data flows: ranking, validation against findings, reachability, cross references."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.functions import classify
from siftstone.functions.text import basename, identifiers, norm_text, strip
from siftstone.plans.lineage import cut


def best_of_key(flows: DataFrame, key: list[str], score: str, seq: str) -> DataFrame:
    """One flow per key: the highest score, the first on ties."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(score), seq))
    return flows.withColumn("__place", place).filter("__place = 1").drop("__place")


def without_twins(flows: DataFrame, weak: Column, keys: list[str]) -> DataFrame:
    """Weak flows (partial, inferred) go where a strong one has the same keys."""
    strong = flows.filter(~weak).select(*keys).distinct()
    return flows.filter(~weak).unionByName(flows.filter(weak).join(strong, keys, "left_anti"))


def numbered(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """rows with their places, from 1, in a global order: ranges of the order are numbered on their own, then shifted by the sizes of those before."""
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()))
    parts = ranged.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    before = F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")  # as many rows as partitions
    offsets = parts.select("__part", "__first", before.alias("__before"))
    placed = ranged.join(F.broadcast(offsets), "__part").withColumn(name, (F.col("__before") + F.col("__row") - F.col("__first") + 1).cast("int"))
    return placed.drop("__part", "__row", "__n", "__first", "__before")


ranked = numbered


def nearest_flow(findings: DataFrame, flows: DataFrame, reach: int = 12) -> DataFrame:
    """finding, rank of the first flow by rank that has a point in a file and at most `reach` lines from a place of the finding, and kinds that overlap or aren't known.

    findings: finding, kinds, places (array of path, line); flows: rank, kinds, points (array of path, line). A line that is 0 or null is any line of its file.
    Lines are dealt to bands of reach + 1, so that a place meets its own and the neighbouring bands by equality, not every
    point of the file. Points are first reduced to the lowest rank of each place and kinds, and a file's to that of its kinds for places without a line.
    """
    width = reach + 1
    band = lambda c: F.floor(F.col(c) / width)
    places = findings.select("finding", "kinds", F.explode("places").alias("p")).select("finding", "kinds", "p.path", F.coalesce("p.line", F.lit(0)).alias("line")).filter("path <> ''").distinct()
    points = flows.select(F.col("kinds").alias("flow_kinds"), "rank", F.explode("points").alias("p")).select("flow_kinds", "rank", "p.path", F.coalesce("p.line", F.lit(0)).alias("flow_line"))
    points = cut(points.groupBy("path", "flow_line", "flow_kinds").agg(F.min("rank").alias("rank")))
    alike = (F.size("kinds") == 0) | (F.size("flow_kinds") == 0) | F.arrays_overlap("kinds", "flow_kinds")
    lined = places.filter("line <> 0").withColumn("__band", F.explode(F.array(band("line") - 1, band("line"), band("line") + 1)))
    exact = lined.join(points.filter("flow_line <> 0").withColumn("__band", band("flow_line")), ["path", "__band"]).filter(F.abs(F.col("line") - F.col("flow_line")) <= reach)
    whole = points.groupBy("path", "flow_kinds").agg(F.min("rank").alias("rank"))
    anywhere = points.filter("flow_line = 0").groupBy("path", "flow_kinds").agg(F.min("rank").alias("rank"))
    met = None
    for found in (exact, places.filter("line = 0").join(whole, "path"), places.filter("line <> 0").join(anywhere, "path")):
        found = found.filter(alike).select("finding", "rank")
        met = found if met is None else met.unionByName(found)
    return met.groupBy("finding").agg(F.min("rank").alias("rank"))


def first_rule(flows: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """The first rule (by seq) of each flow's key decides; if one of its hints is in the flow's code, nothing is left."""
    first = rules.groupBy(key).agg(F.min_by(F.struct("title", "hints"), "seq").alias("r"))
    met = flows.join(F.broadcast(first) if first.limit(10_001).count() <= 10_000 else first, key)
    return met.filter(~F.exists("r.hints", lambda h: F.instr(F.col("code"), h) > 0)).withColumn("title", F.col("r.title")).drop("r")


def bare_path(c: Column) -> Column:
    """A path without dots and slashes before it."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "^[./]+", "")


def _suffixes(c: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.right(c, n))


def not_mitigated(items: DataFrame, known: DataFrame, kind: str) -> DataFrame:
    """items without a known path of their kind that is equal, ends with theirs or theirs with it (character by character), or has the same base name.

    Each of these is an equality: of base names, of an item's path with an ending of a known one, or of an ending of it with a known path.
    """
    k = known.select(F.col(kind), bare_path(F.col("path")).alias("__path")).filter("__path <> ''").distinct().withColumn("__base", basename(F.col("__path")))
    rows = items.withColumn("__own", bare_path(F.col("path")))
    own = rows.select(kind, "__own").distinct().filter("__own <> ''").withColumn("__base", basename(F.col("__own")))
    by_base = own.join(k.select(kind, "__base").distinct(), [kind, "__base"], "left_semi")
    longer = own.join(k.select(kind, F.explode(_suffixes(F.col("__path"))).alias("__own")).distinct(), [kind, "__own"], "left_semi")
    shorter = own.withColumn("__path", F.explode(_suffixes(F.col("__own")))).join(k.select(kind, "__path"), [kind, "__path"], "left_semi")
    met = by_base.select(kind, "__own").unionByName(longer.select(kind, "__own")).unionByName(shorter.select(kind, "__own")).distinct()
    return rows.join(met, [kind, "__own"], "left_anti").select(*items.columns)


def first_key(rows: DataFrame, keys: list[str], lookup: DataFrame, key: str, value: str, row: str) -> DataFrame:
    """rows with the value of the first of their keys that the lookup holds."""
    tried = rows.select(row, F.posexplode(F.array(*keys)).alias("place", key)).join(lookup, key)
    hit = tried.groupBy(row).agg(F.min_by(value, "place").alias(value))
    return rows.join(hit, row, "left")


def reachable(edges: DataFrame, sources: DataFrame, passes: int = 7) -> DataFrame:
    """node, depth: least number of steps from a source, at most `passes`. Stops when a pass finds nothing new. Edges are computed once, and a pass writes once."""
    edges = cut(edges)
    found = cut(sources.select("node").distinct().withColumn("depth", F.lit(0)))
    for step in range(1, passes + 1):
        front = found.filter(F.col("depth") == step - 1).select(F.col("node").alias("a"))
        new = edges.join(front, "a").select(F.col("b").alias("node")).distinct().join(found, "node", "left_anti")
        found = cut(found.unionByName(new.withColumn("depth", F.lit(step))))
        if found.filter(F.col("depth") == step).isEmpty():
            break
    return found


def capped(rows: DataFrame, key: list[str], order: list, most: int) -> DataFrame:
    return rows.withColumn("__place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("__place") <= most).drop("__place")


def path_edges(steps: DataFrame, flow: str, order: str, label: str) -> DataFrame:
    """flow, src, dst, kind: edges between following steps of a flow."""
    w = Window.partitionBy(flow).orderBy(order)
    out = steps.select(flow, F.col(order).alias("src"), F.lead(order).over(w).alias("dst"), F.when(F.col(label) == F.lead(label).over(w), "same").otherwise("handoff").alias("kind"))
    return out.filter("dst is not null")


def block_depth(parts: Column) -> Column:
    """struct(deepest, first_closed) of the open braces after each part of an array, and the first part after which none is open; counted in the row."""
    braces = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    start = F.struct(F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("deepest"), F.lit(None).cast("int").alias("closed"), F.lit(0).alias("at"))

    def step(s: Column, part: Column) -> Column:
        depth = (s["depth"] + braces(part, "{") - braces(part, "}")).cast("long")
        return F.struct(depth.alias("depth"), F.greatest(s["deepest"], depth).alias("deepest"), F.coalesce(s["closed"], F.when(depth <= 0, s["at"])).alias("closed"), (s["at"] + 1).alias("at"))

    return F.aggregate(parts, start, step, lambda s: F.struct(s["deepest"].alias("deepest"), s["closed"].alias("first_closed")))


# Accessors of flows: rows with sink, file, line, function, description, explanation, platform, trace_status, confidence,
# path (array of file, line, role, code, symbol) and ends (array of file, line, reason, code, symbol).

PATH = "array<struct<file:string,line:int,role:string,code:string,symbol:string>>"
ENDS = "array<struct<file:string,line:int,reason:string,code:string,symbol:string>>"
INFERRED = "[inferred]"


def of_role(path: Column, *roles: str) -> Column:
    return F.filter(path, lambda s: F.lower(s["role"]).isin(*roles))


def trace_status(status: Column) -> Column:
    low = norm_text(status)
    return F.when(low.isin("complete", "partial"), low).otherwise("complete")


def sink_fingerprint() -> Column:
    """struct(sink, file, line) of the last sink step, else of the flow."""
    last = F.try_element_at(of_role(F.col("path"), "sink"), F.lit(-1))
    return F.struct(strip(F.coalesce("sink", F.lit(""))).alias("sink"), F.coalesce(last["file"], F.col("file"), F.lit("")).alias("file"), F.when(last.isNotNull(), F.coalesce(last["line"], F.lit(0))).otherwise(F.coalesce("line", F.lit(0))).alias("line"))


def source_fingerprint() -> Column:
    """struct(symbol, code) of the first source or parameter step, else empty."""
    first = F.get(of_role(F.col("path"), "source", "param"), F.lit(0))
    return F.struct(F.coalesce(first["symbol"], F.lit("")).alias("symbol"), strip(F.coalesce(first["code"], F.lit(""))).alias("code"))


def locations() -> Column:
    """struct(source_file, source_line, sink_file, sink_line)."""
    source, sink = F.get(of_role(F.col("path"), "source"), F.lit(0)), F.try_element_at(of_role(F.col("path"), "sink"), F.lit(-1))
    return F.struct(F.coalesce(source["file"], F.lit("")).alias("source_file"), source["line"].alias("source_line"), F.coalesce(sink["file"], F.col("file"), F.lit("")).alias("sink_file"), F.coalesce(sink["line"], F.col("line")).alias("sink_line"))


def code_text() -> Column:
    return F.array_join(F.transform("path", lambda s: F.coalesce(s["code"], F.lit(""))), "\n")


def points() -> Column:
    """Places of a flow: its steps and its own."""
    steps = F.transform("path", lambda s: F.struct(s["file"].alias("path"), F.coalesce(s["line"], F.lit(0)).alias("line")))
    return F.filter(F.array_distinct(F.concat(steps, F.array(F.struct(F.col("file").alias("path"), F.coalesce("line", F.lit(0)).alias("line"))))), lambda p: p["path"] != "")


def end_texts() -> Column:
    """What each end of a partial flow says."""
    reason = lambda n: F.replace(F.coalesce(n["reason"], F.lit("unresolved")), F.lit("_"), F.lit(" "))
    place = lambda n: F.concat(F.coalesce(n["file"], F.lit("-")), F.when(F.coalesce(n["line"], F.lit(0)) != 0, F.concat(F.lit(":"), n["line"].cast("string"))).otherwise(""))
    via = lambda n: F.when(F.coalesce(n["symbol"], F.lit("")) != "", F.concat(F.lit(" via "), n["symbol"])).otherwise("")
    return F.transform("ends", lambda n: F.concat(reason(n), F.lit(" at "), place(n), via(n)))


def with_source_step() -> Column:
    """The path, with an inferred source before it if it has none."""
    first = F.get(F.col("path"), F.lit(0))
    told = F.when(F.lower(first["role"]) == "param", F.concat(F.lit(INFERRED + " value reaches parameter "), F.coalesce(first["code"], F.lit("")))).when(first.isNull(), F.lit(INFERRED + " no source was found")).otherwise(F.lit(INFERRED + " value reaches the flow"))
    step = F.struct(F.coalesce(first["file"], F.col("file")).alias("file"), F.coalesce(first["line"], F.col("line")).alias("line"), F.lit("source").alias("role"), told.alias("code"), F.lit("").alias("symbol"))
    return F.when(F.size(of_role(F.col("path"), "source")) > 0, F.col("path")).otherwise(F.concat(F.array(step), F.col("path")))


@dataclass(frozen=True)
class Profile:
    """How flows are ranked: a base, points for the first bucket whose words a flow has, bonuses and thresholds; by platform where given."""

    base: int = 35
    buckets: tuple[tuple[str, int], ...] = (("exec|command|shell|eval|deserial", 40), ("sql|query|traversal|ssrf|upload", 28), ("xss|redirect|render|html|log", 16))
    low: int = 8
    cross_file: int = 15
    source_role: int = 8
    call_role: int = 5
    steps: int = 5
    each_step: int = 2
    critical: int = 85
    high: int = 70
    medium: int = 50

    def with_own(self, own: dict) -> Profile:
        """This profile with a platform's own values; lists are replaced whole."""
        return replace(self, **{k: v for k, v in own.items() if k in {f.name for f in fields(self)}})


def scored(flows: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """flows with risk, severity and cross_file, and a source step in each path."""
    f = flows.withColumn("path", with_source_step())
    text = F.lower(F.concat_ws(" ", "sink", "description", "explanation"))
    bucket = F.lit(profile.low)
    for pattern, score in reversed(profile.buckets):
        bucket = F.when(text.rlike(pattern), score).otherwise(bucket)
    files = F.size(F.array_distinct(F.filter(F.transform("path", lambda s: s["file"]), lambda x: x.isNotNull() & (x != ""))))
    has = lambda role: F.exists("path", lambda s: s["role"] == role)
    risk = F.lit(profile.base) + bucket + F.when(files > 1, profile.cross_file).otherwise(0) + F.when(has("source"), profile.source_role).otherwise(0) + F.when(has("call"), profile.call_role).otherwise(0) + profile.each_step * F.least(F.size("path"), F.lit(profile.steps))
    f = f.withColumn("risk", F.least(F.lit(100), risk).cast("int")).withColumn("cross_file", files > 1)
    return f.withColumn("severity", F.when(F.col("risk") >= profile.critical, "Critical").when(F.col("risk") >= profile.high, "High").when(F.col("risk") >= profile.medium, "Medium").otherwise("Low"))


def ranked_flows(flows: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """flows (with flow_seq) scored, the best of each key, without partial twins of complete ones and inferred twins of real ones, and with their rank."""
    f = scored(flows, profile).withColumn("status", trace_status(F.col("trace_status")))
    steps = F.transform("path", lambda s: F.struct(s["file"], s["line"], s["role"], strip(s["code"])))
    ends = F.transform("ends", lambda n: F.struct(n["file"], n["line"], n["reason"], strip(n["code"])))
    f = f.withColumn("key", F.sha2(F.to_json(F.struct("flow_kind", "status", "sink", "file", "function", "line", steps.alias("steps"), ends.alias("ends"))), 256))
    best = f.groupBy("key").agg(F.min_by(F.struct(*f.columns), F.struct(-F.col("risk"), "flow_seq")).alias("f")).select("f.*")
    best = cut(best.withColumn("sink_at", sink_fingerprint()).withColumn("source_at", source_fingerprint()).withColumn("inferred", F.lower("source_at.code").startswith(INFERRED)))
    complete = best.filter("status = 'complete'")
    left = best.filter("status <> 'partial'").unionByName(best.filter("status = 'partial'").join(complete.select("sink_at").distinct(), "sink_at", "left_anti").select(*best.columns))
    weak = (F.col("status") == "complete") & F.col("inferred")
    real = complete.filter(~F.col("inferred")).select("sink_at").distinct()
    left = left.filter(~weak).unionByName(left.filter(weak).join(real, "sink_at", "left_anti").select(*best.columns))
    confidence = F.when(F.lower("confidence") == "high", 2).when(F.lower("confidence") == "medium", 1).otherwise(0)
    order = [F.desc("risk"), confidence.desc(), F.desc("cross_file"), F.size("path").desc(), F.asc("file"), F.asc("line"), F.asc("flow_seq")]
    return numbered(left, order).drop("key", "sink_at", "source_at", "inferred")


def confirmed(ranked_: DataFrame, rules: DataFrame) -> DataFrame:
    """ranked flows with kind, title and cwe of the first rule (seq, platform, sink, kind, title, cwe) of their platform and sink, unless their code says that the kind is dealt with."""
    first = rules.groupBy(F.lower("platform").alias("__p"), F.lower("sink").alias("__s")).agg(F.min_by(F.struct("kind", "title", "cwe"), "seq").alias("__r"))
    met = ranked_.join(F.broadcast(first) if first.limit(10_001).count() <= 10_000 else first, (F.lower("platform") == F.col("__p")) & (F.lower(strip(F.col("sink"))) == F.col("__s")))
    found = met.withColumn("kind", F.col("__r.kind")).withColumn("title", F.col("__r.title")).withColumn("cwe", F.col("__r.cwe")).drop("__p", "__s", "__r")
    return found.filter(~classify.blocked(F.col("kind"), code_text()))


def candidate_kinds(ranked_: DataFrame, rules: DataFrame) -> DataFrame:
    """ranked flows with kinds: the confirmed one, else all that their text fits."""
    own = confirmed(ranked_, rules).select("rank", F.col("kind").alias("__kind"))
    text = F.concat_ws(" ", "sink", "description", "explanation", code_text())
    return ranked_.join(own, "rank", "left").withColumn("kinds", F.when(F.col("__kind").isNotNull(), F.array("__kind")).otherwise(classify.kinds(text))).drop("__kind")


@dataclass(frozen=True)
class Mitigation:
    """primary: the pattern whose place is told; required: all others that a file must have."""

    platform: str
    kind: str
    title: str
    primary: str
    required: tuple[str, ...] = ()


def mitigations(files: DataFrame, rules: list[Mitigation]) -> DataFrame:
    """kind, title, path, line, evidence: files of a rule's platform that hold all its patterns. Of each kind and line of a file one stands: a rule takes its
    first match whose line no earlier rule of the kind took; evidence is what stands up to 80 characters around it, 240 at most."""
    text = F.col("content")
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))

    def places(r: Mitigation) -> Column:
        """(line, evidence) of the first match on each line, in order: of as many lines as the kind has rules, since earlier ones take a line each at most."""
        found, between = F.regexp_extract_all(text, F.lit(r.primary), F.lit(0)), F.split(text, r.primary, -1)
        enough = sum(x.kind == r.kind for x in rules)
        none = F.array().cast("array<struct<line:int,start:int,size:int>>")
        begun = F.struct(F.lit(0).alias("at"), F.lit(1).alias("line"), none.alias("out"))

        def step(state: Column, k: Column) -> Column:
            gap, match = F.get(between, k), F.get(found, k)
            start, line = state["at"] + F.length(gap), state["line"] + breaks(gap)
            new = (F.size(state["out"]) < enough) & (F.coalesce(F.try_element_at(state["out"], F.lit(-1))["line"], F.lit(0)) != line)
            out = F.when(new, F.array_append(state["out"], F.struct(line.alias("line"), start.alias("start"), F.length(match).alias("size")))).otherwise(state["out"])
            return F.struct((start + F.length(match)).alias("at"), (line + breaks(match)).alias("line"), out.alias("out"))

        def told(p: Column) -> Column:
            low = F.greatest(p["start"] - 80, F.lit(0))
            near = F.substring(text, low + 1, p["start"] - low + p["size"] + 80)
            return F.struct(p["line"].alias("line"), F.substring(strip(F.replace(near, F.lit("\n"), F.lit(" "))), 1, 240).alias("evidence"))

        walked = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), begun, step)["out"]
        return F.transform(F.when(F.size(found) > 0, walked).otherwise(none), told)

    each = []
    for i, r in enumerate(rules):
        holds = (F.lower("platform") == r.platform.lower()) & classify.contains_all(text, [r.primary, *r.required])
        each.append(F.when(holds, F.struct(F.lit(i).alias("seq"), F.lit(r.kind).alias("kind"), F.lit(r.title).alias("title"), places(r).alias("places"))))
    rows = files.select("path", F.array_compact(F.array(*each)).alias("found")).filter(F.size("found") > 0)

    def take(state: Column, rule: Column) -> Column:
        taken = F.filter(state, lambda x: x["kind"] == rule["kind"])
        free = F.filter(rule["places"], lambda p: ~F.exists(taken, lambda x: x["line"] == p["line"]))
        one = F.transform(F.slice(free, 1, 1), lambda p: F.struct(rule["kind"].alias("kind"), rule["title"].alias("title"), p["line"].alias("line"), p["evidence"].alias("evidence")))
        return F.concat(state, one)

    none = F.array().cast("array<struct<kind:string,title:string,line:int,evidence:string>>")
    return rows.select("path", F.explode(F.aggregate("found", none, take)).alias("m")).select("m.kind", "m.title", "path", "m.line", "m.evidence")


def inventory(ranked_: DataFrame, rules: DataFrame, mitigated: DataFrame, files: DataFrame) -> DataFrame:
    """Vulnerabilities: confirmed flows, but those whose sink's or own file has a mitigation of the kind, copies of (kind, file, line, sink, symbol), and
    cross-site flows whose source file also feeds a command or answers in plain text. mitigated: kind, path; files: path, content."""
    at = confirmed(ranked_, rules).withColumn("at", locations()).withColumn("source_symbol", source_fingerprint()["symbol"])
    found = at.select("rank", "kind", "title", "cwe", "severity", "risk", "sink", "function", "source_symbol", F.col("file").alias("own_file"), F.col("at.sink_file").alias("path"), F.col("at.sink_line").alias("line"), F.col("at.source_file").alias("source_file"))
    found = not_mitigated(found, mitigated, "kind").withColumnRenamed("path", "sink_file").withColumnRenamed("own_file", "path")
    found = not_mitigated(found, mitigated, "kind").withColumnRenamed("path", "own_file")
    key = ["kind", "sink_file", "line", "sink", "source_symbol"]
    found = cut(found.groupBy(*key).agg(F.min_by(F.struct(*[c for c in found.columns if c not in key]), "rank").alias("x")).select(*key, "x.*"))
    commands = found.filter("kind = 'command_injection'").select("source_file").distinct()
    plain = files.filter(F.contains(F.lower("content"), F.lit("content-type: text/plain"))).select(F.col("path").alias("source_file")).distinct()
    cross = found.filter("kind = 'xss'").join(commands, "source_file", "left_anti").join(plain, "source_file", "left_anti")
    return found.filter("kind <> 'xss'").unionByName(cross.select(*found.columns))


def reviewed(findings: DataFrame, ranked_: DataFrame, rules: DataFrame, mitigated: DataFrame, supported: bool = True) -> DataFrame:
    """finding, status, kind, rank, rationale of scanner findings (finding, kinds, places): confirmed by a flow near them, else left to a person if
    they have no kind or the platform no engine, else hidden as false positives; the rationale says why. mitigated: kind, path, line."""
    flows = cut(candidate_kinds(ranked_, rules))
    met = nearest_flow(findings, flows.select("rank", "kinds", points().alias("points")))
    own = findings.join(met, "finding", "left")
    places = findings.select("finding", "kinds", F.explode("places").alias("p")).select("finding", "kinds", "p.path")
    near = places.join(mitigated.select("path", F.col("kind").alias("mitigated"), "line"), "path").filter((F.size("kinds") == 0) | F.array_contains("kinds", F.col("mitigated")))
    near = near.groupBy("finding").agg(F.min(F.struct("path", "line")).alias("defence"))
    same = findings.select("finding", F.explode("kinds").alias("kind")).join(flows.select(F.explode("kinds").alias("kind")).distinct(), "kind").select("finding").distinct().withColumn("same", F.lit(True))
    row = own.join(near, "finding", "left").join(same, "finding", "left")
    confirmed_, manual = F.col("rank").isNotNull(), F.lit(not supported) | (F.size("kinds") == 0)
    status = F.when(confirmed_, "confirmed_vulnerability").when(manual, "manual_review_recommended").otherwise("suppressed_false_positive")
    why = (
        F.when(confirmed_, F.concat(F.lit("flow "), F.col("rank").cast("string"), F.lit(" reaches this place")))
        .when(F.lit(not supported), "no engine analyses this platform").when(manual, "no kind is known for this rule")
        .when(F.col("defence").isNotNull(), F.concat(F.lit("dealt with at "), F.col("defence.path"), F.lit(":"), F.col("defence.line").cast("string")))
        .when(F.col("same"), "flows of this kind end elsewhere").otherwise("no flow of this kind was found")
    )
    return row.select("finding", status.alias("status"), F.coalesce(F.get("kinds", F.lit(0)), F.lit("")).alias("kind"), "rank", why.alias("rationale"))


def graph_nodes(flows: DataFrame, xref: DataFrame, caps: dict[str, int] | None = None, most: int = 18) -> DataFrame:
    """flow_seq, place, kind, label of a flow's graph: its steps in order, then references (flow_seq, kind, symbol, seq), so many of each kind, `most` in all."""
    caps = caps or {"definition": 6, "call": 4, "other": 3}
    steps = flows.select("flow_seq", F.posexplode("path").alias("place", "s")).select("flow_seq", "place", F.col("s.role").alias("kind"), F.col("s.code").alias("label"))
    cap = F.lit(0)
    for kind, n in caps.items():
        cap = F.when(F.col("kind") == kind, n).otherwise(cap)
    few = xref.withColumn("i", F.row_number().over(Window.partitionBy("flow_seq", "kind").orderBy("seq"))).filter(F.col("i") <= cap)
    some = few.withColumn("j", F.row_number().over(Window.partitionBy("flow_seq").orderBy("kind", "i"))).filter(F.col("j") <= most)
    return steps.unionByName(some.select("flow_seq", (F.lit(999) + F.col("j")).alias("place"), "kind", F.col("symbol").alias("label")))


#: References that a step of a graph may have, by kind, and a graph in all; references of no step that are shown beside the sink; steps at the end that share names.
STEP_REFERENCES, OTHER_REFERENCES, MOST_REFERENCES, MOST_RELATED, TAIL = {"callsite": 6, "definition": 4}, 3, 18, 2, 5
REFERENCE = "struct<kind:string,resolved:string,symbol:string,context:string,file:string,line:int>"
#: Steps of references that are put into words.
TOLD_REFERENCES = 8


def path_graph(rows: DataFrame) -> DataFrame:
    """flow_seq, edges (from, to, kind, label), narrative, steps of flows (flow_seq, path as PATH, xref as array of REFERENCE, in their order).

    A step of the path is p0, p1, ...; a reference x0, x1, ... hangs on the first step, with room for its kind, that calls it by name, or else on the first of the last steps
    that shares a name with it; up to two that hang nowhere are shown beside the sink. References are as few as `xref_capped` leaves, so that one
    fold in the row goes over them.
    """
    called = lambda c: F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z_][\w.]*)\s*\("), F.lit(1)), lambda n: F.element_at(F.split(n, r"\."), -1))
    base_of = lambda c: basename(c["file"])
    place = lambda s: F.concat(base_of(s), F.lit(":"), F.coalesce(s["line"].cast("string"), F.lit("")))
    n = F.size("path")
    facts = rows.withColumns({
        "__calls": F.transform("path", lambda s: F.when(s["role"] == "call", called(s["code"])).otherwise(F.array().cast("array<string>"))),
        "__names": F.transform("path", lambda s: identifiers(s["code"])),
        "__labels": F.transform("path", lambda s: F.upper(F.when((s["role"] == "call") & (F.size(called(s["code"])) > 0), F.concat(F.lit("call "), F.substring(F.get(called(s["code"]), F.lit(0)), 1, 20))).otherwise(s["role"]))),
        "__places": F.transform("path", place),
    })
    every = lambda low: F.when(n > 0, F.sequence(low, n - 1)).otherwise(F.array().cast("array<int>"))

    def anchors(x: Column) -> Column:
        own = F.filter(every(F.lit(0)), lambda i: F.array_contains(F.get("__calls", i), F.lower(x["resolved"])))
        names = identifiers(F.concat_ws(" ", x["resolved"], x["symbol"], x["context"]))
        near = F.filter(every(F.greatest(n - TAIL, F.lit(0))), lambda i: F.arrays_overlap(F.get("__names", i), names))
        return F.when((x["resolved"] != "") & (F.size(own) > 0), own).otherwise(F.slice(near, 1, 1))

    edge = "struct<at:int,x:int,kind:string,label:string,role:string>"
    begun = F.array().cast(f"array<{edge}>")
    cap = lambda role: F.when(role == "callsite", STEP_REFERENCES["callsite"]).when(role == "definition", STEP_REFERENCES["definition"]).otherwise(OTHER_REFERENCES)
    free = lambda edges, at, role: (F.size(F.filter(edges, lambda e: (e["at"] == at) & (e["role"] == role))) < cap(role)) & (F.size(edges) < MOST_REFERENCES)

    def take(edges: Column, i: Column) -> Column:
        x = F.get("xref", i)
        role = F.lower(F.coalesce(F.nullif(x["kind"], F.lit("")), F.lit("xref")))
        first = F.get(F.filter(anchors(x), lambda a: free(edges, a, role)), F.lit(0))
        beside = (n > 0) & (F.size(F.filter(edges, lambda e: e["kind"] == "xref_related")) < MOST_RELATED) & free(edges, n - 1, role)
        made = lambda at, kind, label: F.array_append(edges, F.struct(at.cast("int").alias("at"), i.cast("int").alias("x"), F.lit(kind).alias("kind"), label.alias("label"), role.alias("role")))
        return F.when(first.isNotNull(), made(first, "xref", role)).when(beside, made(n - 1, "xref_related", F.lit("related"))).otherwise(edges)

    count = F.size(F.coalesce("xref", F.array().cast(f"array<{REFERENCE}>")))
    hung = facts.withColumn("__hung", F.when(count > 0, F.aggregate(F.sequence(F.lit(0), count - 1), begun, take)).otherwise(begun))
    between = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    step = lambda i: F.concat(F.lit("p"), i.cast("string"))
    made = lambda a, b, kind, label: F.struct(a.alias("from"), b.alias("to"), kind.alias("kind"), label.alias("label"))
    edges = F.concat(
        F.transform(between, lambda i: made(step(i - 1), step(i), F.lit("path"), F.concat(F.lit("step "), i.cast("string")))),
        F.transform("__hung", lambda e: made(step(e["at"]), F.concat(F.lit("x"), e["x"].cast("string")), e["kind"], e["label"])),
    )
    number = lambda kind: F.size(F.filter("__hung", kind)).cast("string")
    chain = F.when(n > 0, F.array_join(F.transform("path", lambda s: F.upper(s["role"])), " -> ")).otherwise("NO PATH")
    narrative = F.concat(
        F.lit("Trace, from left to right: "), chain, F.lit(". References: "), F.size("__hung").cast("string"), F.lit(" (definitions: "), number(lambda e: e["role"] == "definition"), F.lit(", callsites: "), number(lambda e: e["role"] == "callsite"),
        F.lit(", related: "), number(lambda e: e["kind"] == "xref_related"), F.lit(")."),
    )
    name = lambda x: F.coalesce(F.nullif(x["resolved"], F.lit("")), F.nullif(x["symbol"], F.lit("")), F.lit("xref"))

    def told(e: Column) -> Column:
        x, at = F.get("xref", e["x"]), e["at"]
        there = F.concat(name(x), F.lit(" ("), place(x), F.lit(")"))
        return F.when(e["kind"] == "xref_related", F.concat(F.lit("Beside "), F.get("__labels", at), F.lit(": "), there, F.lit("."))).otherwise(F.concat(F.get("__labels", at), F.lit(" ("), F.get("__places", at), F.lit(") has the "), e["label"], F.lit(" "), there, F.lit(".")))

    moves = F.transform(between, lambda i: F.concat(F.lit("Data goes from "), F.get("__labels", i - 1), F.lit(" ("), F.get("__places", i - 1), F.lit(") to "), F.get("__labels", i), F.lit(" ("), F.get("__places", i), F.lit(").")))
    return hung.select("flow_seq", edges.alias("edges"), narrative.alias("narrative"), F.concat(moves, F.transform(F.slice("__hung", 1, TOLD_REFERENCES), told)).alias("steps"))


#: Severities from the worst.
SEVERITIES = ("Critical", "High", "Medium", "Low")


def families(rows: DataFrame) -> DataFrame:
    """family, status, flows, complete, files, severity (the worst), risk (the highest), vectors (name -> flows): of flows with family, status, trace_status, file, severity, risk, vectors.

    Counts are pre-aggregated; a family's files are counted, and listed by `family_files`, since they may be many.
    """
    place = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity")), F.lit(0))
    key = ["family", "status"]
    rank = F.when(place > 0, place).otherwise(len(SEVERITIES))
    whole = rows.groupBy(*key).agg(F.count("*").alias("flows"), F.count_if(F.lower("trace_status") == "complete").alias("complete"), F.count_distinct("file").alias("files"), F.min(rank).alias("worst"), F.max("risk").alias("risk"))
    per = rows.select(*key, F.explode(F.array_distinct("vectors")).alias("vector")).groupBy(*key, "vector").agg(F.count("*").alias("n"))
    mapped = per.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("vector", "n")))).alias("vectors"))  # as many as kinds of vectors
    severity = F.get(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("worst").cast("int") - 1)
    return whole.join(mapped, key, "left").select(*key, "flows", "complete", "files", severity.alias("severity"), "risk", F.coalesce("vectors", F.create_map().cast("map<string,bigint>")).alias("vectors"))


def family_files(rows: DataFrame) -> DataFrame:
    """family, status, file, flows."""
    return rows.groupBy("family", "status", "file").agg(F.count("*").alias("flows"))


def vector_counts(rows: DataFrame) -> DataFrame:
    """vector, flows, example (the flow of the lowest rank): of flows with rank and vectors; a flow counts once for each of its vectors."""
    return rows.select("rank", F.explode(F.array_distinct("vectors")).alias("vector")).groupBy("vector").agg(F.count("*").alias("flows"), F.min("rank").alias("example"))
