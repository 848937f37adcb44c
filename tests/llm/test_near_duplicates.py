"""Documents and embeddings near-duplicates against brute force, with large groups, ties, nulls and copies."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from siftstone.llm import components, lattice_neardup, setsketch_dedup
from siftstone.plans import lineage
from siftstone.llm.setsketch_dedup import Shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_sets(texts, k):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(UPPER))
        out.append(frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


def brute_components(ids, sets, linked):
    parent = {i: i for i in ids if i is not None}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for (i, a), (j, b) in itertools.combinations(zip(ids, sets, strict=True), 2):
        if i is not None and j is not None and linked(a, b):
            p, q = top(i), top(j)
            parent[max(p, q)] = min(p, q)
    return {i: top(i) for i in parent}


def jaccard(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "  \n", "One", "one", "one two", "ONE  two", "one two three", "É é", "é é"]
    base = [rng.choice(words) for _ in range(120)]
    for n in range(150):  # a large group of near copies, some of them linked by others only
        copy = base[:]
        for _ in range(rng.choice([0, 1, 2, 4, 6, 9, 12])):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    for _ in range(40):  # chains: each is near the one before
        chain = [rng.choice(words) for _ in range(60)]
        for _ in range(3):
            texts.append(" ".join(chain))
            chain = chain[3:] + [rng.choice(words) for _ in range(3)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.randrange(10, 40))) for _ in range(60)]  # a passage in common
    texts += ["same text here again " * 3] * 50
    texts.append(" ".join(rng.choice(words) for _ in range(50_000)))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("k", [2, 5])
def test_documents(spark, k):
    texts = corpus()
    ids = list(range(1000, 1000 + len(texts)))
    random.Random(5).shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").selectExpr("*", "1 AS node", "'x' AS digest").repartition(5)
    got = {r["doc_id"]: r for r in setsketch_dedup.near_duplicates(df, Shingles(words=k)).collect()}
    sets = brute_sets(texts, k)
    want = brute_components(ids, sets, jaccard)
    assert len(got) == len(ids)
    for i, s in zip(ids, sets, strict=True):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(s), want[i], want[i] == i)


def test_documents_edges(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (1, a), (2, a), (None, a), (None, None), (3, b), (3, a), (4, b), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in setsketch_dedup.near_duplicates(df, Shingles(2)).collect())
    assert len(got) == len(rows)
    assert [x for x in got if x[0] == 5] == [(5, 0, 5, True)] and [x[2] for x in got if x[0] == 2] == [1]
    # row 3 has both texts, so all of 1, 2, 3 and 4 are one group
    assert {(x[0], x[2]) for x in got if x[0]} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)}
    left = setsketch_dedup.deduplicated(df.selectExpr("*", "'y' AS kept")).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == [(0, ""), (0, a), (1, a), (5, "")]
    assert setsketch_dedup.near_duplicates(df.limit(0)).count() == 0 and setsketch_dedup.deduplicated(df.limit(0)).count() == 0


def test_repeated_ids_against_brute_force(spark):
    rng = random.Random(7)
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdefghij"] + [None, ""]
    rows = [(rng.randrange(30), rng.choice(texts)) for _ in range(60)] + [(1, texts[0]), (3, texts[1]), (3, texts[0]), (4, texts[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids = sorted({i for i, _ in rows})
    parent = {i: i for i in ids}
    for i, t in rows:
        for j, u in rows:
            if t and t == u:
                p, q = sorted((brute_top(parent, i), brute_top(parent, j)))
                parent[q] = p
    want = {i: brute_top(parent, i) for i in ids}
    got = setsketch_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows) and {r["doc_id"]: r["component_id"] for r in got} == want and all(r["kept"] == (want[r["doc_id"]] == r["doc_id"]) for r in got)
    left = [tuple(r) for r in setsketch_dedup.deduplicated(df).collect()]
    assert sorted(i for i, _ in left) == sorted(set(want.values())) and set(left) <= set(rows)
    assert sorted(left, key=str) == sorted((tuple(r) for r in setsketch_dedup.deduplicated(df.repartition(2)).collect()), key=str)


def brute_top(parent, v):
    while parent[v] != v:
        v = parent[v]
    return v


def test_crowded_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(setsketch_dedup, "CROWD", 2)
    texts = [t for t in corpus() if t and len(t) < 1000][:90]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_components(list(range(len(texts))), brute_sets(texts, 2), jaccard)
    assert {r["doc_id"]: r["component_id"] for r in setsketch_dedup.near_duplicates(df, Shingles(2)).collect()} == want


def test_signs_leave_room_for_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    apart = lambda y: np.bitwise_count(lattice_neardup.signs(x) ^ lattice_neardup.signs(y)).sum(1)
    assert apart(0.95 * x + math.sqrt(1 - 0.95**2) * z).max() <= lattice_neardup.most_apart(0.95) < 40 < apart(z).min()


def test_bands_keep_their_recall():
    for rows in (0, 1, 10**6, 10**8, 10**10):
        plan = setsketch_dedup.Bands.of(rows, 0.8)
        assert (1 - 0.8**plan.width) ** plan.n <= setsketch_dedup.MISS and rows * 0.1**plan.width <= max(setsketch_dedup.STRANGERS, rows / 10**4)
    x = np.random.default_rng(3).integers(0, 9, (5, 64)).astype(np.uint16)
    plan = setsketch_dedup.Bands(4, 16)
    plain, other = setsketch_dedup.band_keys(x, plan), setsketch_dedup.band_keys(x, plan, regrouped=True)
    x[0, 5] += 1
    assert (setsketch_dedup.band_keys(x, plan)[0] != plain[0]).nonzero()[0].tolist() == [1] and (setsketch_dedup.band_keys(x, plan, True)[0] != other[0]).nonzero()[0].tolist() == [5]


def test_word_hashes_follow_words():
    texts = pa.array(["Ab c", None, "", "c ab", "x" * 70_000, "ab C"])
    found = dict((i, set(s.tolist())) for i, s in setsketch_dedup.shingle_sets(texts, 1))
    assert set(found) == {0, 3, 4, 5} and found[0] == found[3] == found[5] and len(found[4]) == 1
    assert set(dict(setsketch_dedup.shingle_sets(texts.slice(3), 1))) == {0, 1, 2}


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.unique(x[:2000]), np.unique(x[1000:])
    ra, rb, union = setsketch_dedup.sketches([a, b, np.unique(x)])
    assert (np.maximum(ra, rb) == union).all()
    equal = np.mean([(ra == rb).mean()])
    assert 0.1 < equal < 0.6
    for shared, ok in ((1.0, True), (0.8, True), (0.2, False)):
        y = np.unique(np.concatenate([x[: int(2000 * shared)], rng.integers(0, 2**63, 2000 - int(2000 * shared), dtype=np.uint64)]))
        r, s = setsketch_dedup.sketches([np.unique(x[:2000]), y])
        verdict = setsketch_dedup.plausible(np.array([(r > s).sum()]), np.array([(r < s).sum()]), np.array([2000]), np.array([len(y)]), 0.6)
        assert bool(verdict[0]) == ok


def test_components_of_odd_edges(spark, monkeypatch):
    rows = [(1, None), (None, 2), (None, None), (3, 3), (5, 4), (5, 4)]
    assert {tuple(r) for r in components.components(spark.createDataFrame(rows, "a long, b long")).collect()} == {(4, 4), (5, 4)}
    assert components.components(spark.createDataFrame(rows[:4], "a long, b long")).count() == 0
    with pytest.raises(RuntimeError):
        components.components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long"), max_rounds=1)
    monkeypatch.setattr(components, "BROADCAST_ROWS", 0)
    assert {r["component"] for r in components.components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")).collect()} == {0}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 500 + i) for i in range(1, 60)]
    want = brute_components(list({x for e in edges for x in e}), [{x} for x in {x for e in edges for x in e}], lambda a, b: any(set(e) == a | b for e in edges))
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if any(k in e for e in edges if e[0] != e[1])}


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=32)
    rows = [rng.normal(size=32) for _ in range(150)]
    rows += [centre + rng.normal(size=32) * 0.16 for _ in range(80)]
    for r in rows[:40]:  # pairs about the threshold
        z = rng.normal(size=32)
        z -= z @ r / (r @ r) * r
        z *= np.linalg.norm(r) / np.linalg.norm(z)
        c = rng.uniform(0.93, 0.97)
        rows.append(3 * (c * r + math.sqrt(1 - c * c) * z))
    rows += [rows[0]] * 5
    vectors = [v.astype(np.float32).tolist() for v in rows] + [None, [], [0.0] * 32, [float("nan")] * 32, [float("inf")] + [1.0] * 31, [1.0, 2.0], [2.0, 4.0], [1.0] * 31 + [None], [1e30] * 32, [2e30] * 32]
    ids = [3 * i + 1 for i in range(len(vectors))]
    df = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<float>").selectExpr("*", "1 AS size", "2 AS cell").repartition(4)
    got = {r["vec_id"]: r for r in lattice_neardup.near_duplicates(df).collect()}

    def unit(v):
        if not v or None in v or not np.isfinite(v).all() or not np.any(v):
            return None
        x = np.array(v, float)
        return x / np.linalg.norm(x)

    units = [unit(v) for v in vectors]
    linked = lambda a, b: a is not None and b is not None and len(a) == len(b) and float(a @ b) >= 0.95
    want = brute_components(ids, units, linked)
    assert len(got) == len(ids)
    for i, u in zip(ids, units, strict=True):
        assert got[i]["n_links"] == sum(j != i and linked(u, v) for j, v in zip(ids, units, strict=True)), i
        assert (got[i]["component_id"], got[i]["kept"]) == (want[i], want[i] == i)
    assert lattice_neardup.near_duplicates(df.limit(0)).count() == 0


def test_e8_points_are_nearest():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 8)) * 2
    best, other, _ = lattice_neardup.e8_nearest(x)
    for points in (best, other):
        whole = points % 2 == 0
        assert ((whole.all(1)) | (~whole).all(1)).all() and (points.sum(1) % 4 == 0).all()
    # the minimal vectors: no neighbour of the point found is nearer
    steps = [s for s in itertools.product((-1, 0, 1), repeat=8) if sum(map(abs, s)) == 2] + [tuple(v / 2 for v in s) for s in itertools.product((-1, 1), repeat=8) if s.count(-1) % 2 == 0]
    steps = np.array(steps)
    assert len(steps) == 240
    near = ((x - best / 2) ** 2).sum(1)
    around = ((x[:, None] - best[:, None] / 2 - steps[None]) ** 2).sum(2).min(1)
    assert (near <= around + 1e-9).all()


def test_tables_of_few_rows_are_few_files(spark, monkeypatch):
    rng, made = random.Random(4), {}
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(60)) for _ in range(150)]
    texts += [f"{t} x y" for t in texts]

    def counted(df, label, *rows):
        out = lineage.materialize(df, label, *rows)
        made.setdefault(label, len(out.inputFiles()))
        return out

    monkeypatch.setattr(setsketch_dedup, "materialize", counted)
    monkeypatch.setattr(components, "materialize", counted)
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert setsketch_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).filter("kept").count() == 150
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {made[x] for x in ("classes", "pairs", "wanted", "stars", "edges", "large", "small", "components", "labelled")} <= {1, 2}
