"""Queries of technology detection, project markers, effort and line counts, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftstone.functions import text as T
from siftstone.operators import recon
from siftstone.operators.recon import Spec
from siftstone.sources.tables import files, page_files, small, table

SPECS = [
    Spec("Backend", "plain text", "tech", (".txt",)),
    Spec("Backend", "licensed text", "tech", (".txt",), "license|Licensed"),
    Spec("Frontend", "hypertext", "tech", ("*",), "<html|html$"),
    Spec("Other", "mail", "other", regex="@mail"),
    Spec("Framework", "navigation kit", "framework", ("*",), "<nav>", "hypertext"),
    Spec("Framework", "token kit", "framework", (".txt",), "token = ", "plain text"),
    Spec("Build", "seven", "manifest", regex="7.TXT"),
    Spec("Build", "english nines", "manifest", regex="*/en/*9.txt"),
]
BANDS = [("text", 1, 10, 0.5, 1.0), ("text", 11, 40, 1.0, 2.0), ("text", 41, 200, 2.0, 5.0), ("text", 201, 1_000_000, 5.0, 12.5)]


def _files(spark, sf_dir):
    return files(spark, sf_dir).select("path", "content").unionByName(page_files(spark, sf_dir).select("path", "content"))


def _found(spark, sf_dir):
    return recon.detections(_files(spark, sf_dir), SPECS)


def recon_detections(spark, sf_dir):
    return _found(spark, sf_dir).select("category", "name", "path", F.expr(recon.LABEL).alias("confidence"))


def recon_strict(spark, sf_dir):
    return recon.strict(_found(spark, sf_dir)).groupBy("category", "name").agg(F.count("*").alias("files"))


def recon_tuned(spark, sf_dir):
    found = recon.tuned(_found(spark, sf_dir), ("SRC1*/fr/*",), (("Other", "mail"),), {("Backend", "plain text"): "high", ("Framework", "token kit"): "low"})
    return recon.summary(found)


def recon_summary(spark, sf_dir):
    return recon.summary(_found(spark, sf_dir))


def recon_totals(spark, sf_dir):
    return recon.totals(_found(spark, sf_dir))


def recon_folders(spark, sf_dir):
    return recon.by_folder(_found(spark, sf_dir))


def recon_first_files(spark, sf_dir):
    order = Window.partitionBy("category", "name").orderBy("path")
    return _found(spark, sf_dir).withColumn("place", F.row_number().over(order)).filter("place <= 5").select("category", "name", "place", "path")


def commonest_folder(spark, sf_dir):
    return recon.commonest_folder(files(spark, sf_dir))


def first_framework(spark, sf_dir):
    specs = [Spec("Framework", "first", "framework", regex="token", language="x"), Spec("Framework", "second", "framework", regex="idiot|token", language="x"), Spec("Framework", "else", "framework", regex="mail", language="x")]
    return recon.first_framework(files(spark, sf_dir), specs, "x")


def marker_semi_join(spark, sf_dir):
    """Projects (sources) with a marker: a file name, a key in a manifest-like line, or a pattern in any file."""
    f = files(spark, sf_dir).withColumn("project", F.substring_index("path", "/", 1))
    projects = f.select("project").distinct()
    named = f.filter(T.matches_glob(T.basename(F.col("path")), "1?.txt")).select("project")
    keyed = f.filter(F.col("content").rlike('password=[0-9a-f]+')).select("project")
    held = f.filter(F.col("content").rlike("GNU General")).select("project")
    hits = named.unionByName(keyed).unionByName(held)
    return projects.join(hits, "project", "left_semi")


def marker_implications(spark, sf_dir):
    """Platforms of each project from markers, with what they imply, and one that needs 20 files."""
    f = files(spark, sf_dir).withColumn("project", F.substring_index("path", "/", 1))
    per = f.groupBy("project").agg(F.count_if(F.col("platform") == "en").alias("en"), F.count_if(F.col("platform") == "fr").alias("fr"), F.max(F.col("content").contains("idiot")).alias("rude"))
    direct = per.select("project", F.explode(F.array_compact(F.array(F.when(F.col("en") >= 30, "english"), F.when(F.col("fr") >= 1, "french"), F.when(F.col("rude"), "rude")))).alias("platform"))
    implied = small(spark, [("english", "latin"), ("french", "latin"), ("french", "accents")], "platform string, implies string")
    return direct.unionByName(direct.join(F.broadcast(implied), "platform").select("project", F.col("implies").alias("platform"))).distinct()


def framework_pack_dedupe(spark, sf_dir):
    """Packs that share a rule path, without case: names and globs as sorted sets."""
    packs = table(spark, sf_dir, "nation").select(F.concat(F.lit("Packs/"), F.col("n_regionkey").cast("string"), F.lit(".XML")).alias("rule_path"), F.col("n_name").alias("name"), F.concat(F.lit("*."), F.lower(F.substring("n_name", 1, 1))).alias("glob"))
    return packs.groupBy(F.lower("rule_path").alias("rule_path")).agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("names"), F.array_join(F.sort_array(F.collect_set("glob")), ",").alias("globs"))


def platform_extensions(spark, sf_dir):
    """Extensions per platform in order of first sight; platforms without any are left out."""
    f = _files(spark, sf_dir).select(F.element_at(F.split("path", "/"), 2).alias("platform"), T.suffix(F.col("path")).alias("ext"), "path")
    first = f.filter("ext <> ''").groupBy("platform", "ext").agg(F.min("path").alias("p"))
    listed = first.groupBy("platform").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "ext"))), lambda x: x["ext"]).alias("exts"))
    return listed.select("platform", F.array_join("exts", ",").alias("extensions"))


def framework_target_filter(spark, sf_dir):
    p = F.col("path")
    return files(spark, sf_dir).filter(T.matches_glob(T.basename(p), "?2.txt") | T.matches_glob(p, "src[0-2]/e*/*[!0-7].txt")).select("path")


def discover_files(spark, sf_dir):
    """Files by platform globs, once for each glob that fits: a bag."""
    globs = small(spark, [("english", "*/en/*"), ("english", "*1.txt"), ("any", "*.*")], "platform string, glob string")
    each = [F.when(F.col("path").rlike(T.glob_regex(g)), F.lit(p)) for p, g in (tuple(r) for r in globs.collect())]  # the catalog's literal
    return files(spark, sf_dir).select("path", F.explode(F.array_compact(F.array(*each))).alias("platform"))


def effort_estimate(spark, sf_dir):
    counts = files(spark, sf_dir).groupBy(F.col("platform").alias("tech")).agg(F.count("*").alias("files")).withColumn("kind", F.lit("text"))
    return recon.effort(counts, small(spark, BANDS, "kind string, lo int, hi int, min_days double, max_days double"))


def effort_totals(spark, sf_dir):
    e = effort_estimate(spark, sf_dir)
    return e.groupBy().agg(F.sum("files").alias("files"), F.sum("min_days").alias("min_days"), F.sum("max_days").alias("max_days"))


def loc_effective(spark, sf_dir):
    return page_files(spark, sf_dir).select("file_seq", recon.effective_lines(F.col("content")).alias("loc"))


def loc_page(spark, sf_dir):
    """The second page of ten of the line-count table, most lines first."""
    return loc_effective(spark, sf_dir).orderBy(F.desc("loc"), "file_seq").offset(10).limit(10)


def manifest_dependency_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    keys = F.map_keys(F.from_json("props", "map<string,string>"))
    return e.select(F.explode(keys).alias("k")).groupBy(F.lower("k").alias("dependency")).agg(F.count("*").alias("n"))


def engine_resolution(spark, sf_dir):
    """Engine of each platform: alias, else the name; a project is kotlin if it has as many French as German files."""
    f = files(spark, sf_dir).withColumn("project", F.substring_index("path", "/", 1))
    per = f.groupBy("project").agg(F.count_if(F.col("platform") == "fr").alias("fr"), F.count_if(F.col("platform") == "de").alias("de"))
    return per.select("project", F.when(F.col("fr") + F.col("de") == 0, "none").when(F.col("fr") >= F.col("de"), "first").otherwise("second").alias("engine"))


def rule_counts(spark, sf_dir):
    """Rules and categories of each pack; packs without rules count zero."""
    packs = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("pack"), "r_name")
    rules = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("pack"), F.substring("n_name", 1, 1).alias("category"))
    per = rules.groupBy("pack").agg(F.count("*").alias("rules"), F.count_distinct("category").alias("categories"))
    return packs.join(per, "pack", "left").select("r_name", F.coalesce("rules", F.lit(0)).alias("rules"), F.coalesce("categories", F.lit(0)).alias("categories"))


NAMES = (
    recon_detections, recon_strict, recon_tuned, recon_summary, recon_totals, recon_folders, recon_first_files, commonest_folder, first_framework, marker_semi_join, marker_implications, framework_pack_dedupe,
    platform_extensions, framework_target_filter, discover_files, effort_estimate, effort_totals, loc_effective, loc_page, manifest_dependency_keys, engine_resolution, rule_counts,
)


def queries():
    return {f.__name__: f for f in NAMES}


def oracle_sql():
    both = """docs AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, text AS content, lang AS platform, source AS project, CAST(doc_id AS VARCHAR) || '.txt' AS base FROM documents),
pgs AS (SELECT regexp_replace(url, '^[a-z]+://', '') AS path, html AS content FROM pages),
f AS (SELECT path, content FROM docs UNION ALL SELECT path, content FROM pgs),
x AS (SELECT path, content, lower(regexp_extract(string_split(path, '/')[-1], '^.+(\\.[^.]+)$', 1)) AS ext FROM f)"""
    found = (
        both
        + """, d AS (
  SELECT 'Backend' AS category, 'plain text' AS name, path, 2 AS rank FROM x WHERE ext = '.txt'
  UNION ALL SELECT 'Backend', 'licensed text', path, CASE WHEN regexp_matches(content, 'license|Licensed') THEN 2 ELSE 1 END FROM x WHERE ext = '.txt' AND (regexp_matches(content, 'license|Licensed') OR regexp_matches(path, 'license|Licensed'))
  UNION ALL SELECT 'Frontend', 'hypertext', path, CASE WHEN regexp_matches(content, '<html|html$') THEN 2 ELSE 1 END FROM x WHERE regexp_matches(content, '<html|html$') OR regexp_matches(path, '<html|html$')
  UNION ALL SELECT 'Other', 'mail', path, 1 FROM x WHERE regexp_matches(content, '@mail')
  UNION ALL SELECT 'Framework', 'navigation kit', path, 3 FROM x WHERE (regexp_matches(content, '<html|html$') OR regexp_matches(path, '<html|html$')) AND regexp_matches(content, '<nav>')
  UNION ALL SELECT 'Framework', 'token kit', path, 3 FROM x WHERE ext = '.txt' AND regexp_matches(content, 'token = ')
  UNION ALL SELECT 'Build', 'seven', path, 3 FROM x WHERE lower(string_split(path, '/')[-1]) = '7.txt'
  UNION ALL SELECT 'Build', 'english nines', path, 3 FROM x WHERE regexp_matches(path, '^.*/en/.*9\\.txt$')
), found AS (SELECT category, name, path, CAST(max(rank) AS INTEGER) AS rank FROM d GROUP BY category, name, path)"""
    )
    summary = """SELECT category, name, count(*) AS files, count(*) FILTER (rank = 3) AS high, count(*) FILTER (rank = 2) AS medium, count(*) FILTER (rank = 1) AS low,
CASE WHEN count(*) FILTER (rank = 3) >= greatest(count(*) FILTER (rank = 2), count(*) FILTER (rank = 1)) THEN 'high' WHEN count(*) FILTER (rank = 2) >= count(*) FILTER (rank = 1) THEN 'medium' ELSE 'low' END AS dominant"""
    effort = """c AS (SELECT lang AS tech, count(*) AS files FROM documents GROUP BY lang), e AS (SELECT tech, files, CASE WHEN files <= 10 THEN 0.5::DOUBLE WHEN files <= 40 THEN 1.0 WHEN files <= 200 THEN 2.0 ELSE 5.0 END AS min_days, CASE WHEN files <= 10 THEN 1.0::DOUBLE WHEN files <= 40 THEN 2.0 WHEN files <= 200 THEN 5.0 ELSE 12.5 END AS max_days FROM c)"""
    loc = """p AS (SELECT page_id AS file_seq, string_split(html, chr(10)) AS l FROM pages),
ln AS (SELECT file_seq, unnest(range(1, len(l) + 1)) AS i, regexp_replace(unnest(l), '^\\s+|\\s+$', '', 'g') AS c FROM p),
ev AS (SELECT *, regexp_matches(c, '\\*/|-->|"\"\"|''''''') AS closes, regexp_matches(c, '/\\*|<!--|"\"\"|''''''') AS opens FROM ln),
st AS (SELECT *, coalesce(last_value(CASE WHEN closes THEN 0 WHEN opens THEN 1 END IGNORE NULLS) OVER (PARTITION BY file_seq ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM ev),
loc AS (SELECT file_seq, count(*) FILTER (NOT (inside = 1 OR opens OR starts_with(c, '//') OR starts_with(c, '#') OR starts_with(c, '--') OR starts_with(c, '*') OR c = '')) AS loc FROM st GROUP BY file_seq)"""
    return {
        "recon_detections": f"WITH {found} SELECT category, name, path, {recon.LABEL} AS confidence FROM found",
        "recon_strict": f"WITH {found} SELECT category, name, count(*) AS files FROM found WHERE CASE WHEN category IN ('Framework', 'Mobile Platforms', 'Frontend', 'Backend') THEN rank = 3 ELSE rank >= 2 END GROUP BY category, name",
        "recon_tuned": f"WITH {found}, t AS (SELECT category, name, path, CASE WHEN name = 'plain text' THEN 3 WHEN name = 'token kit' THEN 1 ELSE rank END AS rank FROM found WHERE NOT regexp_matches(lower(path), '^src1.*/fr/.*$') AND name <> 'mail') {summary} FROM t GROUP BY category, name",
        "recon_summary": f"WITH {found} {summary} FROM found GROUP BY category, name",
        "recon_totals": f"WITH {found} SELECT count(DISTINCT path) AS files, count(DISTINCT (category, name)) AS technologies, count(DISTINCT category) AS categories FROM found",
        "recon_folders": f"WITH {found} SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, count(DISTINCT path) AS files, count(DISTINCT name) AS names FROM found GROUP BY 1",
        "recon_first_files": f"WITH {found}, k AS (SELECT category, name, path, CAST(row_number() OVER (PARTITION BY category, name ORDER BY path) AS INTEGER) AS place FROM found) SELECT category, name, place, path FROM k WHERE place <= 5",
        "commonest_folder": "SELECT source || '/' || lang AS folder, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, folder LIMIT 1",
        "first_framework": f"WITH {both} SELECT path, CASE WHEN regexp_matches(content, 'token') THEN 'first' WHEN regexp_matches(content, 'idiot|token') THEN 'second' WHEN regexp_matches(content, 'mail') THEN 'else' END AS framework FROM docs WHERE regexp_matches(content, 'token|idiot|mail')",
        "marker_semi_join": f"WITH {both} SELECT DISTINCT project FROM docs WHERE regexp_matches(base, '^1.\\.txt$') OR regexp_matches(content, 'password=[0-9a-f]+') OR regexp_matches(content, 'GNU General')",
        "marker_implications": f"""WITH {both}, per AS (SELECT project, count(*) FILTER (platform = 'en') AS en, count(*) FILTER (platform = 'fr') AS fr, bool_or(contains(content, 'idiot')) AS rude FROM docs GROUP BY project),
d AS (SELECT project, 'english' AS platform FROM per WHERE en >= 30 UNION ALL SELECT project, 'french' FROM per WHERE fr >= 1 UNION ALL SELECT project, 'rude' FROM per WHERE rude)
SELECT project, platform FROM d UNION SELECT project, 'latin' FROM d WHERE platform IN ('english', 'french') UNION SELECT project, 'accents' FROM d WHERE platform = 'french'""",
        "framework_pack_dedupe": "SELECT 'packs/' || n_regionkey || '.xml' AS rule_path, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS names, string_agg(DISTINCT '*.' || lower(n_name[1]), ',' ORDER BY '*.' || lower(n_name[1])) AS globs FROM nation GROUP BY n_regionkey",
        "platform_extensions": f"WITH {both}, g AS (SELECT string_split(path, '/')[2] AS platform, ext, min(path) AS p FROM x WHERE ext <> '' GROUP BY 1, 2) SELECT platform, string_agg(ext, ',' ORDER BY p) AS extensions FROM g GROUP BY platform",
        "framework_target_filter": f"WITH {both} SELECT path FROM docs WHERE regexp_matches(base, '^.2\\.txt$') OR regexp_matches(path, '^src[0-2]/e.*/.*[^0-7]\\.txt$')",
        "discover_files": f"WITH {both} SELECT path, 'english' AS platform FROM docs WHERE regexp_matches(path, '^.*/en/.*$') UNION ALL SELECT path, 'english' FROM docs WHERE regexp_matches(path, '^.*1\\.txt$') UNION ALL SELECT path, 'any' FROM docs WHERE regexp_matches(path, '^.*\\..*$')",
        "effort_estimate": f"WITH {effort} SELECT tech, files, min_days, max_days FROM e",
        "effort_totals": f"WITH {effort} SELECT CAST(sum(files) AS BIGINT) AS files, sum(min_days) AS min_days, sum(max_days) AS max_days FROM e",
        "loc_effective": f"WITH {loc} SELECT file_seq, loc FROM loc",
        "loc_page": f"WITH {loc} SELECT file_seq, loc FROM loc ORDER BY loc DESC, file_seq LIMIT 10 OFFSET 10",
        "manifest_dependency_keys": "SELECT lower(k) AS dependency, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY 1",
        "engine_resolution": "WITH per AS (SELECT source AS project, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de FROM documents GROUP BY source) SELECT project, CASE WHEN fr + de = 0 THEN 'none' WHEN fr >= de THEN 'first' ELSE 'second' END AS engine FROM per",
        "rule_counts": "SELECT r_name, count(n_nationkey) AS rules, count(DISTINCT n_name[1]) AS categories FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name",
    }
