"""Platforms and frameworks of projects from markers: names, contents, dependencies and numbers of files, as one scan and small joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.text import basename, glob_regex, suffix
from siftstone.sources.catalogs import MOST_LITERALS

#: Sections of a JSON manifest whose keys are dependencies.
SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies", "require", "require-dev")


@dataclass(frozen=True)
class Marker:
    """kind: name (a file's), content (value: a pattern), dep (value: a key of a JSON manifest) in files that target, a glob without case, names; or count: at least
    `least` files of the suffixes in target."""

    platform: str
    kind: str
    target: str
    value: str = ""
    least: int = 1


def dependency_keys(content: Column) -> Column:
    """The dependencies that a JSON manifest names, in lower case; none if it isn't JSON."""
    parsed = F.from_json(content, "struct<" + ",".join(f"`{s}`:map<string,string>" for s in SECTIONS) + ">")
    keys = [F.coalesce(F.map_keys(parsed[s]), F.array().cast("array<string>")) for s in SECTIONS]
    return F.array_distinct(F.transform(F.concat(*keys), lambda k: F.lower(k)))


def _test(m: Marker, deps: Column) -> Column:
    name = F.lower(basename(F.col("path")))
    if m.kind == "count":
        return suffix(F.col("path")).isin(*m.target.split())
    named = F.lit(True) if m.target == "*" else name.rlike(glob_regex(m.target.lower())) if any(c in m.target for c in "*?[") else name == m.target.lower()
    if m.kind == "content":
        return named & F.col("content").rlike("(?i)" + m.value)
    if m.kind == "dep":
        return named & F.array_contains(deps, m.value.lower())
    return named


def marker_hits(files: DataFrame, markers: list[Marker]) -> DataFrame:
    """project, seq (of the marker), files that it fits. files: project, path, content."""
    if len(markers) > MOST_LITERALS:
        raise ValueError(f"more than {MOST_LITERALS} markers")
    deps = F.when(F.lower("path").endswith(".json"), dependency_keys(F.col("content")))
    rows = files.withColumn("__deps", deps) if any(m.kind == "dep" for m in markers) else files.withColumn("__deps", F.array().cast("array<string>"))
    each = [F.when(_test(m, F.col("__deps")), F.lit(i)) for i, m in enumerate(markers)]
    return rows.select("project", F.explode(F.array_compact(F.array(*each))).alias("seq")).groupBy("project", "seq").agg(F.count("*").alias("files"))


def detected(files: DataFrame, markers: list[Marker], implied: dict[str, tuple[str, ...]] | None = None, retracted: tuple[tuple[str, str, str], ...] = ()) -> DataFrame:
    """project, platform: those with a marker that enough files fit, and what they imply, but for retractions: (platform, suffixes that it needs, suffixes that
    say another is meant), where files have the second but none of the first."""
    extra = [Marker("", "count", s) for _, *pair in retracted for s in pair]
    hits = marker_hits(files, [*markers, *extra])
    facts = files.sparkSession.createDataFrame([(i, m.platform, m.least) for i, m in enumerate(markers)] or [(-1, "", 1)], "seq int, platform string, least int")
    found = hits.join(F.broadcast(facts), "seq").filter("files >= least").select("project", "platform").distinct()  # as many facts as markers
    pairs = [(k, v) for k, vs in (implied or {}).items() for v in vs]
    if pairs:
        more = files.sparkSession.createDataFrame(pairs, "platform string, also string")
        found = found.unionByName(found.join(F.broadcast(more), "platform").select("project", F.col("also").alias("platform"))).distinct()
    for k, (platform, _, _) in enumerate(retracted):
        needed, other = len(markers) + 2 * k, len(markers) + 2 * k + 1
        both = hits.filter(F.col("seq").isin(needed, other)).groupBy("project").agg(F.max(F.col("seq") == needed).alias("has"), F.max(F.col("seq") == other).alias("other"))
        gone = both.filter("other and not has").select("project", F.lit(platform).alias("platform"))
        found = found.join(gone, ["project", "platform"], "left_anti")
    return found


def auto_detected(files: DataFrame, globs: list[tuple[str, str]], validated: tuple[str, ...], by_markers: DataFrame) -> DataFrame:
    """project, platform: platforms with a file that a glob fits, but for validated ones, which need a marker; and all that have one."""
    name = basename(F.col("path"))
    each = [F.when(name.rlike(glob_regex(g)), F.lit(p)) for p, g in globs if p not in validated]
    by_glob = files.select("project", F.explode(F.array_compact(F.array(*each) if each else F.array(F.lit(None).cast("string")))).alias("platform"))
    return by_glob.unionByName(by_markers.select("project", "platform")).distinct()


def as_markers(frameworks: DataFrame, platforms: tuple[str, ...] = ()) -> list[Marker]:
    """Markers of a registry's frameworks (of some platforms, or all)."""
    rows = frameworks.filter("kind is not null")
    rows = rows.filter(F.col("platform").isin(*platforms)) if platforms else rows
    found = rows.orderBy("seq", "kind", "target", "value").limit(MOST_LITERALS + 1).collect()
    return [Marker(r["framework"], {"file": "name", "dep": "dep", "regex": "content"}[r["kind"]], r["target"], r["value"]) for r in found]


def packs(found: DataFrame, paths: DataFrame) -> DataFrame:
    """platform, pack, names, globs: the packs of frameworks found (framework), each once though several name it, names and globs as sorted sets. paths: framework, platform, pack, globs."""
    met = paths.join(found.select(F.col("platform").alias("framework")).distinct(), "framework", "left_semi")
    grouped = met.groupBy("platform", F.lower("pack").alias("key")).agg(F.min("pack").alias("pack"), F.sort_array(F.collect_set("framework")).alias("names"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("globs")))).alias("globs"))  # a catalog
    return grouped.select("platform", "pack", "names", "globs")


def engine(platform: Column, aliases: dict[str, str], engines: tuple[str, ...], kotlin_files: Column, java_files: Column) -> Column:
    """The engine that analyses a platform: its alias, itself, or for Android that of the language with more files (Kotlin at a tie); null if none does."""
    p = F.lower(platform)
    named = F.coalesce(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])[p], p) if aliases else p
    mobile = F.when(kotlin_files >= java_files, F.lit("kotlin")).otherwise("java")
    chosen = F.when((p == "android") & ~named.isin(*engines), mobile).otherwise(named)
    return F.when(chosen.isin(*engines), chosen)
