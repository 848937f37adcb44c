"""Catalogs as DataFrames: rule packs and registries from XML, technologies and suppressions from JSON, gate programs from text files.

A catalog that can't be read is empty, rows without what they need are left out, and so are invalid patterns: one bad rule never
stops a scan. Catalogs are what people write, so plans may hold them as literals; `as_rules` checks their number before it does.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from siftstone.functions.text import basename, dirname, strip, with_safe_patterns
from siftstone.operators import dataflow
from siftstone.operators.match import Rule
from siftstone.operators.recon import Spec, normalised_extensions
from siftstone.plans.lineage import only_missing

#: Rules or specs that a plan may hold as literals.
MOST_LITERALS = 20_000

#: Fields of a rule's scan settings with their defaults; what isn't a number or a truth value falls back to its default.
SCAN_TEXTS = {"match_mode": "line", "context_type": "", "context_pattern": "", "aggregate": "none", "report_format": "default", "highlight_target": "match", "highlight_groups": "", "highlight_pattern": "", "highlight_color": "red"}
SCAN_NUMBERS = {"context_lines_before": 0, "context_lines_after": 0, "context_depth": 10}
SCAN_FIELDS = (*SCAN_TEXTS, *SCAN_NUMBERS, "highlight_enabled")
RULE_TEXTS = ("name", "regex", "rdl_ref", "exclude", "rule_desc", "vuln_desc", "developer", "reviewer")
MARK = "array<struct<_color:string,_VALUE:string>>"
RULE_SCHEMA = ",".join(f"{f}:string" for f in RULE_TEXTS) + ",scan_config:struct<" + ",".join(f"{f}:string" for f in SCAN_FIELDS) + f",marks:struct<mark:{MARK}>>"


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame | None:
    try:
        rows = spark.read.format("xml").option("rowTag", tag).option("mode", "DROPMALFORMED").schema(schema).load(path)
        rows.limit(1).count()
        return rows
    except AnalysisException as error:  # no such file
        only_missing(error)
        return None


def _text(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit(""))


def scan_settings(raw: Column) -> Column:
    """A struct of all scan settings. Context is of lines where only line counts are given."""
    texts = {f: F.when(_text(raw[f]) == "", F.lit(d)).otherwise(_text(raw[f])) for f, d in SCAN_TEXTS.items()}
    numbers = {f: F.coalesce(_text(raw[f]).try_cast("int"), F.lit(d)) for f, d in SCAN_NUMBERS.items()}
    lines = (numbers["context_lines_before"] > 0) | (numbers["context_lines_after"] > 0)
    texts["context_type"] = F.when(texts["context_type"] != "", texts["context_type"]).when(lines, "lines").otherwise("none")
    enabled = ~F.lower(_text(raw["highlight_enabled"])).isin("false", "0", "no")
    marks = F.transform(F.coalesce(raw["marks"]["mark"], F.array().cast(MARK)), lambda m: F.struct(F.coalesce(m["_color"], F.lit("red")).alias("color"), F.when(_text(m["_VALUE"]) == "", "match").otherwise(_text(m["_VALUE"])).alias("spec")))
    return F.struct(*[c.alias(f) for f, c in (texts | numbers).items()], enabled.alias("highlight_enabled"), marks.alias("marks"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """pack (name of the file), seq, category, name, regex, gate_ref, exclude, texts, scan (settings) of the rules of all packs under path, in the order of packs and rules.

    A rule without a name is left out; an invalid pattern or exclusion becomes empty, which bad_regex and bad_exclude tell.
    """
    raw = _xml(spark, path, "category", f"_name string, rule array<struct<{RULE_SCHEMA}>>")
    if raw is None:
        raw = spark.createDataFrame([], f"_name string, rule array<struct<{RULE_SCHEMA}>>").withColumn("pack", F.lit("")).withColumn("at", F.lit(0).cast("long"))
    else:
        raw = raw.withColumn("pack", basename(F.input_file_name())).withColumn("at", F.monotonically_increasing_id())
    rules = raw.select("pack", "at", F.coalesce("_name", F.lit("")).alias("category"), F.posexplode("rule").alias("place", "r")).filter(_text(F.col("r.name")) != "")
    rows = rules.select("pack", "at", "place", "category", *[_text(F.col(f"r.{f}")).alias(f) for f in RULE_TEXTS], scan_settings(F.col("r.scan_config")).alias("scan"))
    safe = with_safe_patterns(rows.withColumns({"own_regex": F.col("regex"), "own_exclude": F.col("exclude")}), "regex", "exclude")
    safe = safe.withColumns({"bad_regex": F.col("regex").isNull(), "bad_exclude": F.col("exclude").isNull(), "regex": F.coalesce("regex", F.lit("")), "exclude": F.coalesce("exclude", F.lit(""))}).drop("own_regex", "own_exclude")
    order = Window.orderBy("pack", "at", "place")  # a catalog
    return safe.withColumn("seq", F.row_number().over(order)).withColumnRenamed("rdl_ref", "gate_ref").drop("at", "place")


def read_gates(spark: SparkSession, path: str) -> DataFrame:
    """gate_ref (the file's path below `path`), script of the gate programs under a folder. None, if there is none: then no rule is gated."""
    root = path.rstrip("/")
    try:
        raw = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], "gate_ref string, script string")
    return raw.select(F.regexp_replace(F.input_file_name(), r"^.*?" + root.replace("\\", "/").lstrip("/").replace(".", r"\.") + "/", "").alias("gate_ref"), F.col("value").alias("script"))


def as_rules(rules: DataFrame, gates: DataFrame | None = None, pack: str | None = None) -> list[Rule]:
    """Rules of a plan, with the programs that they name (a missing one gates nothing). Rules with an invalid pattern are left out."""
    rows = rules.filter(~F.col("bad_regex"))
    rows = rows if pack is None else rows.filter(F.col("pack") == pack)
    rows = rows.join(gates, "gate_ref", "left") if gates is not None else rows.withColumn("script", F.lit(None).cast("string"))
    found = rows.orderBy("seq").limit(MOST_LITERALS + 1).collect()
    if len(found) > MOST_LITERALS:
        raise ValueError(f"more than {MOST_LITERALS} rules: scan pack by pack")
    return [
        Rule(r["seq"], r["category"], r["name"], r["regex"], r["exclude"], r["script"] or "", bool(r["rule_desc"] or r["vuln_desc"]), r["scan"]["context_lines_before"] if r["scan"]["context_type"] == "lines" else 0,
             r["scan"]["context_lines_after"] if r["scan"]["context_type"] == "lines" else 0, r["pack"].rsplit(".", 1)[0], "file" if r["scan"]["match_mode"] == "file" else "line", r["scan"]["context_type"], r["scan"]["context_pattern"], r["scan"]["context_depth"], r["scan"]["aggregate"])
        for r in found
    ]


def _globs(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(_text(c), ","), strip), lambda x: x != ""))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """seq, platform, path, globs, config_globs, common_globs of the platforms of a registry."""
    names = ("platform", "path", "platform_ftypes", "project_config_ftypes", "common_ftypes")
    raw = _xml(spark, path, "rule", ", ".join(f"{n} string" for n in names))
    raw = spark.createDataFrame([], ", ".join(f"{n} string" for n in names)) if raw is None else raw
    rows = raw.withColumn("at", F.monotonically_increasing_id()).filter(_text(F.col("platform")) != "")
    return rows.select(F.row_number().over(Window.orderBy("at")).alias("seq"), _text(F.col("platform")).alias("platform"), _text(F.col("path")).alias("path"), *[_globs(F.col(n)).alias(a) for n, a in zip(names[2:], ("globs", "config_globs", "common_globs"), strict=True)])


def platform_entry(registry: DataFrame, platform: str) -> DataFrame:
    """The first entry of a platform."""
    return registry.filter(F.col("platform") == platform).orderBy("seq").limit(1)


def platforms(registry: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    return registry.filter(~F.col("platform").isin(*excluded)).select("platform").distinct() if excluded else registry.select("platform").distinct()


FRAMEWORK_SCHEMA = "name string, platform string, rule_file string, scan_ftypes string, markers struct<file:array<string>,dep:array<struct<_file:string,_VALUE:string>>,regex:array<struct<_file:string,_VALUE:string>>>"


def read_frameworks(spark: SparkSession, path: str) -> DataFrame:
    """seq, framework, platform, rule_file, globs, kind (file, dep or regex), target, value: a row for each marker of a framework, and for one without markers a row with nulls.
    Frameworks without a name, platform or rule file are left out, and invalid patterns are no markers."""
    raw = _xml(spark, path, "framework", FRAMEWORK_SCHEMA)
    raw = spark.createDataFrame([], FRAMEWORK_SCHEMA) if raw is None else raw
    low = lambda c: F.lower(_text(c))
    rows = raw.withColumn("at", F.monotonically_increasing_id()).select("at", low(F.col("name")).alias("framework"), low(F.col("platform")).alias("platform"), _text(F.col("rule_file")).alias("rule_file"), _globs(F.col("scan_ftypes")).alias("globs"), "markers")
    rows = rows.filter("framework <> '' and platform <> '' and rule_file <> ''").withColumn("seq", F.row_number().over(Window.orderBy("at"))).drop("at")
    marker = lambda kind, target, value: F.struct(F.lit(kind).alias("kind"), target.alias("target"), value.alias("value"))
    where = lambda m: F.when(_text(m["_file"]) == "", "*").otherwise(low(m["_file"]))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    pair = "array<struct<_file:string,_VALUE:string>>"
    every = F.concat(
        F.transform(none(F.col("markers.file"), "array<string>"), lambda m: marker("file", low(m), low(m))),
        F.transform(none(F.col("markers.dep"), pair), lambda m: marker("dep", where(m), low(m["_VALUE"]))),
        F.transform(none(F.col("markers.regex"), pair), lambda m: marker("regex", where(m), _text(m["_VALUE"]))),
    )
    found = rows.select("seq", "framework", "platform", "rule_file", "globs", F.explode_outer(F.filter(every, lambda m: m["value"] != "")).alias("m")).select("seq", "framework", "platform", "rule_file", "globs", "m.*")
    checked = with_safe_patterns(found.withColumn("pattern", F.when(F.col("kind") == "regex", F.col("value"))), "pattern")
    return checked.filter((F.col("kind") != "regex") | F.col("kind").isNull() | F.col("pattern").isNotNull()).drop("pattern")


def pack_path(registry: DataFrame, frameworks: DataFrame) -> DataFrame:
    """framework, platform, pack: the pack of a framework, in the folder of its platform's."""
    folder = registry.groupBy("platform").agg(F.min_by("path", "seq").alias("path")).select("platform", dirname(F.regexp_replace("path", "^/", "")).alias("folder")).filter("folder <> ''")
    return frameworks.select("framework", "platform", "rule_file").distinct().join(folder, "platform").select("framework", "platform", F.concat_ws("/", "folder", F.lit("framework"), "rule_file").alias("pack"))


def rule_listing(registry: DataFrame, frameworks: DataFrame) -> DataFrame:
    """platform, frameworks, filetypes: as lists for people."""
    per = frameworks.groupBy("platform").agg(F.array_join(F.sort_array(F.collect_set("framework")), ", ").alias("frameworks"))  # a catalog
    return registry.join(per, "platform", "left").select("seq", "platform", F.coalesce("frameworks", F.lit("-")).alias("frameworks"), F.array_join("globs", ", ").alias("filetypes"))


ENTRY = "array<struct<name:string,regex:string,regexFlag:string,fileExtensions:array<string>>>"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """group, name, regex, flag, extensions of a JSON object of lists: technologies by category, frameworks by language, or others by category."""
    try:
        raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{ENTRY}>").alias("m"))
        raw.limit(1).count()
    except AnalysisException as error:  # no such file
        only_missing(error)
        raw = spark.createDataFrame([], f"m map<string,{ENTRY}>")
    rows = raw.select(F.explode("m").alias("group", "entries")).select("group", F.explode("entries").alias("e")).filter(_text(F.col("e.name")) != "")
    extensions = F.coalesce(normalised_extensions(F.col("e.fileExtensions")), F.array().cast("array<string>"))
    found = rows.select("group", F.col("e.name").alias("name"), _text(F.col("e.regex")).alias("regex"), F.coalesce("e.regexFlag", F.lit("1")).alias("flag"), F.when(F.size(extensions) == 0, F.array(F.lit("*"))).otherwise(extensions).alias("extensions"))
    return with_safe_patterns(found, "regex").withColumn("regex", F.coalesce("regex", F.lit("")))


def as_specs(technologies: DataFrame, frameworks: DataFrame, others: DataFrame) -> list[Spec]:
    """Specs of a plan. Technologies whose flag is 0 count by extension alone, others by pattern; frameworks and others need a pattern."""
    out = []
    for kind, rows in (("tech", technologies), ("framework", frameworks), ("other", others)):
        found = rows.orderBy("group", "name").limit(MOST_LITERALS + 1).collect()
        if len(found) > MOST_LITERALS:
            raise ValueError(f"more than {MOST_LITERALS} specs")
        for r in found:
            regex = "(?i)" + r["regex"] if r["regex"] else ""
            if kind == "tech" and (r["flag"] == "0" or regex):
                out.append(Spec(r["group"], r["name"], "tech", tuple(r["extensions"]), "" if r["flag"] == "0" else regex))
            elif kind == "framework" and regex:
                out.append(Spec("Framework", r["name"], "framework", tuple(r["extensions"]), regex, r["group"]))
            elif kind == "other" and regex:
                out.append(Spec(r["group"], r["name"], "other", regex=regex))
    return out


def by_extension(specs: DataFrame) -> DataFrame:
    """extension, flag, names: the specs to try for each extension; those of "*" for all."""
    return specs.select(F.explode("extensions").alias("extension"), (F.col("flag") == "0").alias("by_extension"), "name").groupBy("extension", "by_extension").agg(F.sort_array(F.collect_set("name")).alias("names"))  # a catalog


#: Fields of a platform's taint settings: patterns of sources and cleaners, sinks (name, description, pattern), callees that pass nothing on.
TAINT_SCHEMA = "array<struct<platform:string,sources:array<string>,sinks:array<struct<name:string,description:string,pattern:string>>,sanitizers:array<string>,safe_callees:array<string>,globs:array<string>,mode:string,function_def:string>>"


def read_taint_settings(spark: SparkSession, path: str) -> DataFrame:
    """platform, kind (source, sink, sanitizer, safe), name, description, pattern of a JSON list of platforms. Invalid patterns are left out."""
    try:
        raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", TAINT_SCHEMA)).alias("p")).select("p.*")
        raw.limit(1).count()
    except AnalysisException as error:  # no such file
        only_missing(error)
        raw = spark.createDataFrame([], TAINT_SCHEMA[len("array<struct<") : -2])
    row = lambda kind, name, description, pattern: F.struct(F.lit(kind).alias("kind"), name.alias("name"), description.alias("description"), pattern.alias("pattern"))
    none = lambda c, kind="array<string>": F.coalesce(F.col(c), F.array().cast(kind))
    empty = F.lit("")
    rows = F.concat(
        F.transform(none("sources"), lambda p: row("source", empty, empty, p)), F.transform(none("sanitizers"), lambda p: row("sanitizer", empty, empty, p)), F.transform(none("safe_callees"), lambda p: row("safe", p, empty, empty)),
        F.transform(none("sinks", "array<struct<name:string,description:string,pattern:string>>"), lambda s: row("sink", s["name"], s["description"], s["pattern"])),
    )
    found = raw.select(F.lower("platform").alias("platform"), F.explode(rows).alias("r")).select("platform", "r.*")
    return with_safe_patterns(found, "pattern").filter("pattern is not null")


def as_settings(rows: DataFrame, platform: str, base: dataflow.Settings | None = None) -> dataflow.Settings:
    """A platform's rows of read_taint_settings as settings of the flow analysis; base (without it the defaults) gives what rows don't say."""
    own = rows.filter(F.lower("platform") == platform.lower()).limit(MOST_LITERALS + 1).collect()  # what people write
    if len(own) > MOST_LITERALS:
        raise ValueError(f"more than {MOST_LITERALS} rows of settings for {platform}")
    patterns = {kind: "|".join(f"(?:{p})" for p in sorted({r["pattern"] for r in own if r["kind"] == kind and r["pattern"]})) for kind in ("source", "sink", "sanitizer")}
    base = base or dataflow.Settings(r"(?!)", ())
    safe = tuple(sorted({r["name"] for r in own if r["kind"] == "safe"}))
    return replace(base, sources=patterns["source"] or base.sources, sink_pattern=patterns["sink"] or base.sink_pattern, cleaner_pattern=patterns["sanitizer"] or base.cleaner_pattern, safe=safe or base.safe)


def platform_specs(spark: SparkSession, path: str, built_in: list[tuple[str, list[str], str]]) -> DataFrame:
    """platform, globs, mode: the built-in ones, and those that only the settings name."""
    own = spark.createDataFrame(built_in, "platform string, globs array<string>, mode string")
    try:
        given = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", TAINT_SCHEMA)).alias("p")).select(F.lower("p.platform").alias("platform"), "p.globs", F.coalesce("p.mode", F.lit("brace")).alias("mode")).filter("globs is not null")
        given.limit(1).count()
    except AnalysisException as error:  # no such file
        only_missing(error)
        return own
    return own.unionByName(given.join(own, "platform", "left_anti"))


REVIEW_FIELDS = "platform:string,rule_title:string,category:string,file:string,line:string,path:string,path_regex:string,code_regex:string,target:string,title:string,severity:string,sink:string,source:string,status:string,note:string"


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """kind (source, path or analyzer), seq and all fields of the rules of a review file; rule_title as rule."""
    kinds = ("source", "path", "analyzer")
    lists = ",".join(f"{k}:array<struct<{REVIEW_FIELDS}>>" for k in kinds)
    try:
        raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<rules:struct<{lists}>>").alias("c"))
        raw.limit(1).count()
    except AnalysisException as error:  # no such file
        only_missing(error)
        raw = spark.createDataFrame([], f"c struct<rules:struct<{lists}>>")
    rows = None
    for k in kinds:
        own = raw.select(F.lit(k).alias("kind"), F.posexplode(f"c.rules.{k}").alias("seq", "r")).select("kind", "seq", "r.*")
        rows = own if rows is None else rows.unionByName(own)
    return rows.withColumnRenamed("rule_title", "rule")
