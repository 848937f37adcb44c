"""Cases at the edges that the operators' docstrings name: ties, repeats, nulls, long texts, empty tables and clashing columns."""

from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from siftstone.llm import lattice_neardup, mixing, quality_rules, repair_ids, url_graph
from siftstone.llm.word_table import load

GOOD = " ".join(f"word{i}" for i in range(60))


def test_a_host_at_the_limit_stays(spark):
    # one host: its shrunken rate is its own, exactly 0.8
    rows = [(i, GOOD if i < 2 else "few words", "h") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    judged = quality_rules.judge(df).collect()
    assert {r["host_rate"] for r in judged} == {0.8} and not any(r["host_failed"] for r in judged)
    assert sorted(r["doc_id"] for r in quality_rules.filtered(df).collect()) == [0, 1]
    worse = df.unionByName(spark.createDataFrame([(10, "few", "h")], df.schema))
    assert quality_rules.filtered(worse).count() == 0


def test_vectors_repeated_unnamed_and_long(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=4096), rng.normal(size=4096)
    rows = [(1, a), (1, a), (2, a * 2), (3, b), (None, a), (None, b), (4, a[:2048]), (5, np.concatenate([a, [0.0]]))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>").selectExpr("*", "1 AS component", "2 AS a", "3 AS n_links")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in lattice_neardup.near_duplicates(df).collect())
    assert {k: v for k, v in got.items() if k[0] is not None} == {(1, 2, 1): 2, (2, 2, 1): 1, (3, 0, 3): 1, (4, 0, 4): 1, (5, 0, 5): 1}
    assert {(n, c) for (i, n, c) in got if i is None} == {(0, None)} and sum(v for (i, *_), v in got.items() if i is None) == 2


def test_pages_repeated_long_and_clashing(spark):
    page = '<a href="http://bad.com/x">x</a>'
    rows = [(1, "http://a.org/x", page), (1, "http://a.org/x", page), (2, "http://bad.com/de/1", ""), (3, "http://long.net/" + "p/" * 50_000, "y" * 300_000 + '<a href="http://bad.com/de/2">z</a>'), (4, None, None), (5, "no scheme", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'h' AS host", "'r' AS rule", "1 AS trust", "'v' AS verdict")
    got = Counter((r["page_id"], r["host"], r["rule"], r["verdict"]) for r in url_graph.judge_urls(df).collect())
    assert got == {(1, "a.org", "org/", "allow"): 2, (2, "bad.com", "com/de/", "block"): 1, (3, "long.net", None, "block"): 1, (4, "", None, "allow"): 1, (5, "", None, "allow"): 1}
    assert url_graph.judge_urls(df.limit(0)).count() == 0


def test_mix_of_unnamed_and_long_documents(spark):
    rows = [(None, "a b c", "s"), (None, "a b c", "s"), (1, "w " * 40_000, "s"), (2, None, "t"), (3, "x y", None), (4, " \n", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "'h' AS h", "2 AS rank")
    got = mixing.taken_words(df).collect()
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in got) == {(None, 3, 40_006): 2, (1, 40_000, 40_006): 1, (2, 0, 0): 1, (3, 2, 2): 1, (4, 0, 0): 1}
    assert len({r["taken"] for r in got if r["doc_id"] is None}) == 1 and all(r["taken"] <= 2 * r["size"] for r in got)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and not any(r["doc_id"] in (2, 4) for r in mixed.collect()) and mixing.mix(df.limit(0)).count() == 0


def test_a_document_longer_than_a_shard(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "short"), (2, "the long text goes on " * 900), (3, None), (4, "and ends")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    repair_ids.write_shards(df, path, str(tmp_path / "s"), shard_tokens=1000)
    got = {r["doc_id"]: (r["start"], r["n_tokens"]) for r in repair_ids.read_shards(spark, str(tmp_path / "s")).collect()}
    at = 0
    for doc_id, text in rows:
        n = len(load(path).encode(text or "", add_special_tokens=False).ids) + 1
        assert got[doc_id] == (at, n)
        at += n


def test_pipeline_keeps_clashing_columns(spark, tmp_path):
    rows = [(i, GOOD + f" and number {i} of them " + " ".join(f"own{i}x{k}" for k in range(60)), "en", "s", 9, i) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens long")
    docs = docs.withColumns({"ids": F.lit("i"), "__h": F.lit("h"), "__failed": F.lit("f"), "component_id": F.lit(7)})
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        assert after.count() >= 6, k
        if k < 4:
            assert after.columns == docs.columns and {(r["n_tokens"] == r["doc_id"], r["ids"], r["__h"], r["__failed"]) for r in after.collect()} == {(True, "i", "h", "f")}, k
        docs = after
    assert {r["__failed"] for r in docs.collect()} == {"f"} and all(r["n_tokens"] > 60 for r in docs.collect())
