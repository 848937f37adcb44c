"""Queries of the corpus operators, and their SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from siftstone.llm import chunk_bpe, html_blocks, lattice_neardup, manifest, mixing, packing, pii, quality_rules, repair_ids, setsketch_dedup, sharding, spelling, url_graph
from siftstone.llm.common import read_table

#: Key of surrogates where the session sets none: for trials only, as it is no secret.
TRIAL_KEY = b"surrogates of the trial queries"
#: Rounds of propagation, in the query and in its SQL.
URL_ROUNDS = 25
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op1_quality_rules(spark, sf_dir):
    judged = quality_rules.judge(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 9).alias("host_rate"), "host_failed")


def op2_sharding(spark, sf_dir):
    return sharding.place(read_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op3_embeddings(spark, sf_dir):
    return lattice_neardup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def surrogate_key(spark) -> bytes:
    return (spark.conf.get("spark.siftstone.surrogate.key", None) or "").encode() or TRIAL_KEY


def op4_pii(spark, sf_dir):
    return pii.anonymize(read_table(spark, sf_dir, "documents"), surrogate_key(spark), count="n_entities").select("doc_id", "text", "n_entities")


def op5_minhash(spark, sf_dir):
    return setsketch_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), setsketch_dedup.Shingles(words=2))


def op6_url_filters(spark, sf_dir):
    judged = url_graph.judge_urls(read_table(spark, sf_dir, "pages"), tolerance=0.0, max_rounds=URL_ROUNDS)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("trust", 6).alias("trust"), F.round("distrust", 6).alias("distrust"))


def op7_mixing(spark, sf_dir):
    return mixing.taken_words(read_table(spark, sf_dir, "documents"))


def mixing_targets(spark, sf_dir):
    """What of the mix SQL can express: all but the seeded choice of documents."""
    return mixing.taken_words(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def op8_html(spark, sf_dir):
    return html_blocks.extract(read_table(spark, sf_dir, "pages"))


def op9_bpe(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunk_bpe.encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False).drop("text")


def op10_token_files(spark, sf_dir):
    return repair_ids.token_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_packing(spark, sf_dir):
    packed = packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_manifest(spark, sf_dir):
    """Each fifth document, by the crc32 of its id, is found with its text's A-Z lowered."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    now = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", upper, lower)).otherwise(F.col("text"))
    checked = manifest.verified(read_table(spark, sf_dir, "documents"), now)
    return checked.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_spelling(spark, sf_dir):
    words = spelling.word_counts(read_table(spark, sf_dir, "documents"), typo_every=31)
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def queries():
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_sharding": op2_sharding,
        "op3_embeddings": op3_embeddings,
        "op4_pii": op4_pii,
        "op5_minhash": op5_minhash,
        "op6_url_filters": op6_url_filters,
        "op7_mixing": op7_mixing,
        "mixing_targets": mixing_targets,
        "op8_html": op8_html,
        "op9_bpe": op9_bpe,
        "op10_token_files": op10_token_files,
        "op11_packing": op11_packing,
        "op12_manifest": op12_manifest,
        "op13_spelling": op13_spelling,
    }


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + d) AS n FROM repeated, (VALUES (0), (1), (2)) AS x(d) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM words) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), base AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM judged GROUP BY source
), totals AS (
  SELECT sum(n) AS n, sum(f) / sum(n) AS m, count(*) AS k FROM hosts
), prior AS (
  SELECT m, (SELECT sum(h.n * pow(h.f / h.n - m, 2)) FROM hosts h) / n - m * (1 - m) * k / n AS v FROM totals
), strength AS (
  SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 0.01), 1e6) ELSE 1e6 END AS s FROM prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (f + m * s) / (n + s) <= 0.8 AS kept,
  round((f + m * s) / (n + s), 9) AS host_rate, (f + m * s) / (n + s) > 0.8 AS host_failed
FROM judged JOIN hosts ON judged.source IS NOT DISTINCT FROM hosts.source, strength
"""

#: Forward trust and backward distrust over the links between hosts, as many rounds as the query has.
OP6_ROUND = """, r{k} AS MATERIALIZED (
  SELECT s.host, 0.15 * s.trust0 + 0.85 * coalesce(f.x, 0) AS trust, 0.15 * s.distrust0 + 0.85 * coalesce(b.x, 0) AS distrust
  FROM seeds s LEFT JOIN (SELECT dst AS host, sum(forward * trust) AS x FROM edges JOIN r{j} ON src = r{j}.host GROUP BY dst) f ON s.host = f.host
    LEFT JOIN (SELECT src AS host, sum(back * distrust) AS x FROM edges JOIN r{j} ON dst = r{j}.host GROUP BY src) b ON s.host = b.host
)"""
OP6_SQL = (
    r"""
WITH split AS (
  SELECT page_id, coalesce(html, '') AS html, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM split
), rules(rule, name, start, verdict) AS (
  VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')
), fits AS (
  SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS place
  FROM parts JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)
), ruled AS (
  SELECT p.page_id, p.host, p.path, f.rule, f.verdict FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND f.place = 1
), found AS (
  SELECT host AS src, regexp_replace(unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+)')), '(?i)^href\s*=\s*["'']?|["'']$', '', 'g') AS u FROM parts
), absolute AS (
  SELECT src, CASE WHEN starts_with(u, '//') THEN 'http:' || u ELSE u END AS u FROM found
), links AS (
  SELECT src, translate(regexp_extract(substr(u, strpos(u, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM absolute WHERE strpos(u, '://') > 0
), counted AS (
  SELECT src, dst, count(*) AS n FROM links WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst
), edges AS MATERIALIZED (
  SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS forward, n / sum(n) OVER (PARTITION BY dst) AS back FROM counted
), hosts AS (
  SELECT host, avg(CASE WHEN verdict = 'allow' THEN 1.0 ELSE 0.0 END) AS trust0, avg(CASE WHEN verdict = 'block' THEN 1.0 ELSE 0.0 END) AS distrust0 FROM ruled WHERE host <> '' GROUP BY host
), seeds AS MATERIALIZED (
  SELECT a.host, coalesce(trust0, 0) AS trust0, coalesce(distrust0, 0) AS distrust0 FROM (SELECT src AS host FROM edges UNION SELECT dst FROM edges UNION SELECT host FROM hosts) a LEFT JOIN hosts h ON a.host = h.host
), r0 AS MATERIALIZED (SELECT host, 0.15 * trust0 AS trust, 0.15 * distrust0 AS distrust FROM seeds)"""
    + "".join(OP6_ROUND.format(k=k, j=k - 1) for k in range(1, URL_ROUNDS + 1))
    + f"""
SELECT page_id, ruled.host, path, rule, coalesce(verdict, CASE WHEN distrust > 2 * trust THEN 'block' ELSE 'allow' END) AS verdict, round(trust, 6) AS trust, round(distrust, 6) AS distrust
FROM ruled LEFT JOIN r{URL_ROUNDS} r ON ruled.host = r.host
"""
)

#: All pairs; components by the smallest id that links reach.
REACHED = """reached(a, b) AS (
  SELECT a, b FROM ways UNION SELECT r.a, l.b FROM reached r JOIN ways l ON r.b = l.a
), smallest AS (
  SELECT a, min(b) AS b FROM reached GROUP BY a
)"""
OP3_SQL = f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), sound AS (
  SELECT vec_id, v, len(v) AS n FROM vectors WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), ways AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y ON x.n = y.n AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.95
), {REACHED}, counted AS (
  SELECT a, count(*) AS n FROM ways GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(b, vec_id)) AS kept
FROM vectors LEFT JOIN counted ON vec_id = counted.a LEFT JOIN smallest ON vec_id = smallest.a
"""
OP5_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)
), ways AS MATERIALIZED (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), {REACHED}
SELECT words.doc_id, coalesce(n, 0) AS n_shingles, least(words.doc_id, coalesce(b, words.doc_id)) AS component_id, words.doc_id = least(words.doc_id, coalesce(b, words.doc_id)) AS kept
FROM words LEFT JOIN sizes ON words.doc_id = sizes.doc_id LEFT JOIN smallest ON words.doc_id = smallest.a
"""
#: Sources that are capped are those with the fewest words for their weight: the first of this order, as many as leave the next one below its cap.
TARGETS_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size) AS DOUBLE) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sizes GROUP BY source
), weighed AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM sources
), ordered AS (
  SELECT *, row_number() OVER o AS k, 1.5 * sum(n) OVER () AS total, coalesce(sum(2 * n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM weighed WINDOW o AS (ORDER BY 2 * n / w, rank)
), level AS (
  SELECT arg_min((total - capped) / open, k) AS level FROM ordered WHERE (total - capped) / open * w <= 2 * n
)
SELECT doc_id, size, source_size, round(least(2 * n, w * level), 3) AS target
FROM sizes JOIN ordered ON sizes.source IS NOT DISTINCT FROM ordered.source, level
"""


#: crc32 of strings as bytes: eight shifts for each of 256 table entries, then one step a byte.
CRC_TABLE = """crc_table AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b)
)"""
CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({x})), '..'), lambda y: CAST('0x' || y AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295)"
#: One level of runs of 16 nodes: parents of groups that have several, members in order; groups with one node are done.
OP12_LEVEL = """, {p}{k} AS MATERIALIZED (
  SELECT g, r // 16 AS r, sha256(string_agg(d, '' ORDER BY r)) AS d, list(d ORDER BY r) AS members FROM {p}{j} WHERE g IN (SELECT g FROM {p}{j} GROUP BY g HAVING count(*) > 1) GROUP BY g, r // 16
)"""
#: A step up: the siblings are those of the parent's members that the row isn't; the fold has the row's digest among them. Groups at their root stay.
OP12_STEP = """, s{t} AS (
  SELECT s.* EXCLUDE (r, d, proof), s.r // 16 AS r, CASE WHEN n.g IS NULL THEN s.d ELSE sha256(array_to_string(list_concat(n.members[:s.r % 16], [s.d], n.members[s.r % 16 + 2:]), '')) END AS d,
    CASE WHEN n.g IS NULL THEN s.proof ELSE s.proof || array_to_string(list_concat(n.members[:s.r % 16], n.members[s.r % 16 + 2:]), '') END AS proof
  FROM s{u} s LEFT JOIN {p}{k} n ON n.g = s.g AND n.r = s.r // 16
)"""
OP12_FIELDS = "||".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in manifest.FIELDS)
#: Five levels: up to a million rows a source and a million sources.
OP12_LEVELS = 5
OP12_SQL = (
    f"""
WITH {CRC_TABLE}, hashed AS (
  SELECT doc_id, coalesce('s' || source, '') AS g, source, sha256({OP12_FIELDS}) AS leaf,
    CASE WHEN {CRC.format(x="CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN sha256({OP12_FIELDS.replace("(text ", "(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ")}) END AS other
  FROM documents, crc_table
), leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM hashed
), a0 AS MATERIALIZED (SELECT g, r, leaf AS d FROM leaves)"""
    + "".join(OP12_LEVEL.format(p="a", k=k, j=k - 1) for k in range(1, OP12_LEVELS + 1))
    + ", subroots AS MATERIALIZED (SELECT g, d AS subroot, row_number() OVER (ORDER BY g) - 1 AS r FROM ("
    + " UNION ALL ".join(f"SELECT g, d FROM a{k} WHERE g IN (SELECT g FROM a{k} GROUP BY g HAVING count(*) = 1)" for k in range(OP12_LEVELS + 1))
    + ")), b0 AS MATERIALIZED (SELECT '' AS g, r, subroot AS d FROM subroots)"
    + "".join(OP12_LEVEL.format(p="b", k=k, j=k - 1) for k in range(1, OP12_LEVELS + 1))
    + ", whole AS (SELECT d AS root FROM ("
    + " UNION ALL ".join(f"SELECT d FROM b{k} WHERE (SELECT count(*) FROM b{k}) = 1" for k in range(OP12_LEVELS + 1))
    + """)), s0 AS (
  SELECT doc_id, leaf, subroot, subroots.r AS place, leaves.g, leaves.r, coalesce(other, leaf) AS d, '' AS proof FROM leaves JOIN subroots ON leaves.g = subroots.g
)"""
    + "".join(OP12_STEP.format(t=k, u=k - 1, p="a", k=k) for k in range(1, OP12_LEVELS + 1))
    + f", s{OP12_LEVELS + 1} AS (SELECT * EXCLUDE (g, r, place), '' AS g, place AS r FROM s{OP12_LEVELS})"
    + "".join(OP12_STEP.format(t=OP12_LEVELS + 1 + k, u=OP12_LEVELS + k, p="b", k=k) for k in range(1, OP12_LEVELS + 1))
    + f" SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, d AS folded_root, d = root AS verified FROM s{2 * OP12_LEVELS + 1}, whole"
)
#: Distances count bytes, so letters from U+00C0 on stand as single characters of ASCII that no word has.
LATIN, ASCII = "".join(map(chr, range(0xC0, 0x100))), "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.islower() and c not in "\'\\")[:64]
OP13_SQL = rf"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents
), counted AS (
  SELECT doc_id, w, count(*) AS n FROM runs WHERE length(w) >= 7 GROUP BY doc_id, w
), hashed AS (
  SELECT w, n, {CRC.format(x="CAST(doc_id AS VARCHAR) || ':' || w")} AS h FROM counted, crc_table
), words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n, translate(word, '{LATIN}', '{ASCII}') AS x
  FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), halves AS (
  SELECT word, n, x, side, CASE side WHEN 0 THEN left(x, 3) ELSE right(x, 3) END AS k FROM words, (VALUES (0), (1)) AS s(side)
), near AS (
  SELECT DISTINCT a.word, b.word AS near, b.n FROM halves a JOIN halves b ON a.side = b.side AND a.k = b.k AND a.word <> b.word AND abs(length(a.x) - length(b.x)) <= 1 WHERE levenshtein(a.x, b.x) = 1
), best AS (
  SELECT word, CAST(count(*) AS BIGINT) AS n_near, arg_max(near, (n, -rank)) AS form, max(n) AS form_n FROM (SELECT *, row_number() OVER (ORDER BY near) AS rank FROM near) GROUP BY word
), forms AS MATERIALIZED (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * words.n THEN form END AS form, CASE WHEN form_n >= 10 * words.n THEN form_n END AS form_n
  FROM words LEFT JOIN best ON words.word = best.word
), ways(word, place, steps) AS (
  SELECT word, word, 0 FROM forms UNION ALL SELECT ways.word, forms.form, steps + 1 FROM ways JOIN forms ON ways.place = forms.word WHERE form IS NOT NULL
)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(place, steps) AS root FROM ways GROUP BY word) r ON forms.word = r.word
"""


def oracle_sql():
    return {"op1_quality_rules": OP1_SQL, "op3_embeddings": OP3_SQL, "op5_minhash": OP5_SQL, "op6_url_filters": OP6_SQL, "mixing_targets": TARGETS_SQL, "op12_manifest": OP12_SQL, "op13_spelling": OP13_SQL}
