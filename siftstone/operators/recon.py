"""Technology detection: files against catalogs by extension, manifest name, and patterns on path or content."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.text import basename, dirname, glob_regex, strip, suffix

RANKS = {"low": 1, "medium": 2, "high": 3}
STRICT_HIGH = ("Framework", "Mobile Platforms", "Frontend", "Backend")
LABEL = "CASE rank WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END"
#: Folders and suffixes that a walk leaves out. A catalog of one's own is a parameter.
SKIPPED_FOLDERS = (
    ".git", ".hg", ".svn", "node_modules", "vendor", ".venv", "venv", "__pycache__", ".mypy_cache", ".pytest_cache", ".idea", ".vscode", "dist", "build", "target", ".next", ".nuxt",
)
SKIPPED_SUFFIXES = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".ico", ".tiff", ".zip", ".svg", ".ttf", ".woff", ".woff2")
READ_CHARS = 1 << 20


@dataclass(frozen=True)
class Spec:
    """kind: tech (extension, with a pattern if it has one), framework (of a language), other (pattern), manifest (regex: name or glob; content: a pattern of its text)."""

    category: str
    name: str
    kind: str
    extensions: tuple[str, ...] = ()
    regex: str = ""
    language: str = ""
    content: str = ""


def normalised_extensions(raw: Column) -> Column:
    kept = F.filter(F.transform(raw, lambda e: F.lower(strip(e))), lambda e: e != "")
    return F.transform(kept, lambda e: F.when((e == "*") | e.startswith("."), e).otherwise(F.concat(F.lit("."), e)))


def walked(files: DataFrame, folders: tuple[str, ...] = SKIPPED_FOLDERS, suffixes: tuple[str, ...] = SKIPPED_SUFFIXES) -> DataFrame:
    """files without pruned folders and binary suffixes, content cut to what is read; null if empty or binary."""
    kept = files.filter(~F.concat(F.lit("/"), "path").rlike("/(" + "|".join(map(re.escape, folders)) + ")/") & ~suffix(F.col("path")).isin(*suffixes))
    head = F.substring("content", 1, READ_CHARS)
    return kept.withColumn("content", F.when((head != "") & ~F.contains(head, F.lit("\x00")), head))


def detections(files: DataFrame, specs: list[Spec]) -> DataFrame:
    """category, name, path, rank: the best confidence of each. All specs are tested in one scan; extensions before patterns.

    Contents count only in files of a known extension: one that a technology or framework names, or any where one names "*"; but manifests of all files are read.
    """
    known = {e for s in specs if s.kind in ("tech", "framework") for e in s.extensions}
    ext, path, whole = F.col("ext"), F.col("path"), F.col("content")
    rows = walked(files).withColumn("ext", suffix(path))
    content = whole if "*" in known else F.when(ext.isin(*known), whole)

    def fits(s: Spec) -> Column:
        return F.lit(True) if not s.extensions or "*" in s.extensions else ext.isin(*s.extensions)

    found = []
    for s in specs:
        if s.kind == "manifest":
            named = basename(path).rlike(glob_regex(s.regex)) | path.rlike(glob_regex(s.regex)) if "*" in s.regex else F.lower(basename(path)) == s.regex.lower()
            rank = F.when(named & whole.rlike("(?i)" + s.content) if s.content else named, 3)
        elif s.kind == "tech":
            rank = F.when(fits(s), F.when(content.rlike(s.regex), 2).when(path.rlike(s.regex), 1) if s.regex else F.lit(2))
        elif s.kind == "other":
            rank = F.when(content.rlike(s.regex), 1)
        else:
            continue
        found.append(F.when(rank.isNotNull(), F.struct(F.lit(s.category).alias("category"), F.lit(s.name).alias("name"), rank.cast("int").alias("rank"))))
    rows = rows.withColumn("found", F.array_compact(F.array(*found)))
    names = F.transform("found", lambda x: x["name"])
    framed = [F.when(F.array_contains(names, s.language) & fits(s) & content.rlike(s.regex), F.struct(F.lit(s.category).alias("category"), F.lit(s.name).alias("name"), F.lit(3).alias("rank"))) for s in specs if s.kind == "framework"]
    every = F.concat("found", F.array_compact(F.array(*framed))) if framed else F.col("found")
    return rows.select("path", F.explode(every).alias("d")).groupBy("d.category", "d.name", "path").agg(F.max("d.rank").alias("rank"))


def tuned(found: DataFrame, skip_globs: tuple[str, ...], skip_names: tuple[tuple[str, str], ...], overrides: dict[tuple[str, str], str]) -> DataFrame:
    for g in skip_globs:
        found = found.filter(~F.lower("path").rlike(glob_regex(g.lower())))
    for category, name in skip_names:
        found = found.filter(~((F.col("category") == category) & (F.col("name") == name)))
    rank = F.col("rank")
    for (category, name), level in overrides.items():
        rank = F.when((F.col("category") == category) & (F.col("name") == name), RANKS[level]).otherwise(rank)
    return found.withColumn("rank", rank)


def strict(found: DataFrame) -> DataFrame:
    return found.filter(F.when(F.col("category").isin(*STRICT_HIGH), F.col("rank") == 3).otherwise(F.col("rank") >= 2))


def summary(found: DataFrame) -> DataFrame:
    """Per category and name: files, counts by confidence, the dominant one (ties to the higher)."""
    n = {k: F.count_if(F.col("rank") == v) for k, v in RANKS.items()}
    out = found.groupBy("category", "name").agg(F.count("*").alias("files"), n["high"].alias("high"), n["medium"].alias("medium"), n["low"].alias("low"))
    best = F.greatest(*[F.struct(F.col(k).alias("n"), F.lit(v).alias("rank")) for k, v in RANKS.items()])
    return out.withColumn("dominant", F.when(best["rank"] == 3, "high").when(best["rank"] == 2, "medium").otherwise("low"))


def totals(found: DataFrame) -> DataFrame:
    """One row: files, technologies and categories in all."""
    return found.agg(F.count_distinct("path").alias("files"), F.count_distinct("category", "name").alias("technologies"), F.count_distinct("category").alias("categories"))


def by_folder(found: DataFrame) -> DataFrame:
    """folder, files, names: most files first; ties by name."""
    return found.groupBy(dirname(F.col("path")).alias("folder")).agg(F.count_distinct("path").alias("files"), F.count_distinct("name").alias("names")).orderBy(F.desc("files"), "folder")


def commonest_folder(files: DataFrame) -> DataFrame:
    counts = files.groupBy(dirname(F.col("path")).alias("folder")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "folder").limit(1)


def first_framework(files: DataFrame, specs: list[Spec], language: str) -> DataFrame:
    """path, framework: the first of a language's frameworks whose pattern a file's content fits."""
    own = [s for s in specs if s.kind == "framework" and s.language == language]
    ext = suffix(F.col("path"))
    fits = lambda s: F.lit(True) if not s.extensions or "*" in s.extensions else ext.isin(*s.extensions)
    hit = F.coalesce(F.lit(None).cast("string"), *[F.when(fits(s) & F.col("content").rlike(s.regex), F.lit(s.name)) for s in own])
    return files.select("path", hit.alias("framework")).filter("framework is not null")


#: Comment marks of the line counter.
OPENERS, CLOSERS, TRIPLE = (r"/\*", "<!--"), (r"\*/", "-->"), ('"""', "'''")
SINGLE = ("#", "//", "--", "*")


def effective_lines(content: Column) -> Column:
    """Lines of a text that aren't blank or comments, counted in its own row.

    A line with an opener sets the state; while it is set, lines are skipped, and one with a closer clears it, the opening line too.
    A closer elsewhere means nothing.
    """
    lines = F.transform(F.split(F.coalesce(content, F.lit("")), r"\r\n|\n|\r"), strip)

    def step(state: Column, line: Column) -> Column:
        opens, closes = line.rlike("|".join(OPENERS + TRIPLE)), line.rlike("|".join(CLOSERS + TRIPLE))
        inside = state["inside"] | opens
        single = F.lit(False)
        for s in SINGLE:
            single = single | line.startswith(s)
        counts = (line != "") & ~inside & ~single
        return F.struct(F.when(line == "", state["inside"]).otherwise(inside & ~closes).alias("inside"), (state["n"] + counts.cast("long")).alias("n"))

    start = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(lines, start, step, lambda s: s["n"])


def effort(counts: DataFrame, bands: DataFrame) -> DataFrame:
    """tech, files, min_days, max_days: the first band that holds the number of files; without one the query fails."""
    met = counts.join(F.broadcast(bands) if bands.limit(10_001).count() <= 10_000 else bands, (counts["kind"] == bands["kind"]) & F.col("files").between(F.col("lo"), F.col("hi")), "left")
    first = met.groupBy("tech", "files").agg(F.min_by(F.struct("min_days", "max_days"), "lo").alias("b"))
    known = F.when(F.col("b").isNull(), F.raise_error(F.concat(F.lit("no band for "), "tech"))).otherwise(F.col("b.min_days"))
    return first.select("tech", "files", known.alias("min_days"), F.col("b.max_days").alias("max_days"))
