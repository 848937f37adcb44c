"""The pipeline's stages on a small corpus, each against brute force on its own input."""

import random
import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from siftstone.llm import pii

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    words = [f"word{i}" for i in range(900)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60, 200))) for _ in range(60)]
    texts += [t + " more" for t in texts[:15]] + texts[:10]
    texts += [f"{t} mail me at jo.{i}@mail{i}.example.com or 10.1.2.{i}" for i, t in enumerate(texts[20:30])]
    texts += [None, "", "too short", "a b c " * 60, " ".join(rng.choice(words) for _ in range(30_000))]
    rows = [(i, t, "en", f"s{i % 5}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[40] + " tail", "en", "s1", 1)]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{d}/documents.parquet")
    return d


def failed(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    covered = {i + d for i, g in enumerate(grams) if count[g] > 1 for d in range(3)}
    return len(w) < 50 or 100 * len(covered) > 50 * len(w)


def shingles(text):
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    results = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        results.append([r.asDict() for r in docs.collect()])
        if k < 4:
            assert docs.columns == COLUMNS
    start = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    quality, unique, private, mixed, encoded = results

    key = lambda rows: Counter((r["doc_id"], r["text"], r["source"]) for r in rows)
    assert key(quality) == key([r for r in start if not failed(r["text"])])

    sets = {r["doc_id"]: shingles(r["text"]) for r in quality if r["doc_id"] is not None}
    near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    stay = [r for r in unique if r["doc_id"] is not None]
    assert len({r["doc_id"] for r in stay}) == len(stay)
    assert not any(near(sets[a["doc_id"]], sets[b["doc_id"]]) for i, a in enumerate(stay) for b in stay[:i])
    for i, s in sets.items():
        assert any(near(s, sets[r["doc_id"]]) for r in stay), i

    by = {r["doc_id"]: r["text"] for r in private}
    assert len(private) == len(unique)
    for r in unique:
        spans = pii.find(r["text"])
        assert (by[r["doc_id"]] == r["text"]) == (not spans)
        assert not any(r["text"][s:e] in by[r["doc_id"]] for s, e, _ in spans)

    copies = Counter(r["doc_id"] for r in mixed)
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in private}
    total = sum(size[r["doc_id"]] for r in private)
    assert set(copies) <= set(by) and max(copies.values()) <= 2
    assert abs(sum(size[i] * n for i, n in copies.items()) - 1.5 * total) < 0.1 * total + 30_000

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert len(encoded) == len(mixed)
    assert all(r["ids"] == tokenizer.encode(r["text"], add_special_tokens=False).ids for r in encoded)


def test_run_equals_stages_and_handles_empty(spark, sf_dir, tmp_path):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == [*COLUMNS, "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and got.count() > 40
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
