"""Packing, manifest and spelling variants, against brute force and the library on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from siftstone.llm import manifest, packing, spelling
from siftstone.llm.word_table import load
from siftstone.plans import lineage

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


# packing


@pytest.mark.parametrize("n", [1, 7, 8, 9, 16, 17, 100])
def test_cut_points(n):
    cuts = packing.cut_points(n, 8)
    assert sum(m for _, m in cuts) == n and [s for s, _ in cuts] == [sum(m for _, m in cuts[:k]) for k in range(len(cuts))]
    assert all(m == 8 for _, m in cuts[1:]) and len(cuts) == -(-n // 8)


def valid(bins, lengths, most):
    return sorted(i for b in bins for i in b) == list(range(len(lengths))) and all(0 < lengths[b].sum() <= most for b in bins)


@pytest.mark.parametrize("seed", range(8))
def test_search_saves_bins(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(240, 380, 600)  # threes that seldom fill a bin: best fit leaves room in all
    begun = packing.best_fit(lengths, 1024)
    after = packing.Search(lengths, begun, 1024).run()
    assert valid(begun, lengths, 1024) and valid(after, lengths, 1024)
    assert packing.least_bins(lengths, 1024) <= len(after) < len(begun)
    assert sum(int(lengths[b].sum()) ** 2 for b in after) > sum(int(lengths[b].sum()) ** 2 for b in begun)


@pytest.mark.parametrize("lengths", [[], [5], [10] * 7, [6] * 7, [1] * 95, [9, 1, 9, 1, 8, 2], [4, 4, 4, 6, 6, 6, 3, 3, 4]])
def test_small_packings(lengths):
    x = np.array(lengths, np.int64)
    bins = packing.Search(x, packing.best_fit(x, 10), 10).run()
    assert valid(bins, x, 10)
    assert len(bins) == packing.least_bins(x, 10)


@pytest.mark.parametrize(
    ("lengths", "bins", "after"),
    [
        ([6, 2, 5, 4], [[0, 1], [2, 3]], [7, 10]),  # one for one: 6 for 5
        ([4, 4, 7, 2], [[0, 1], [2, 3]], [7, 10]),  # two for one: 4 + 4 for 7
        ([8, 3, 4, 2], [[0], [1, 2, 3]], [7, 10]),  # one for two: 8 for 3 + 4
        ([3, 3, 7], [[0, 1], [2]], [3, 10]),  # a move
    ],
)
def test_exchanges(lengths, bins, after):
    search = packing.Search(np.array(lengths), bins, 10)
    assert search._step(0)
    assert sorted(search.fill.tolist()) == after
    assert not search._step(int(np.argmin(search.fill)))


def test_pack_documents(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["stone", "sieve", "naïve", "x"], k=rng.choice([0, 3, 40, 900, 2300, 5000]))), 7) for i in range(60)]
    rows += [(60, None, 7), (60, "", 7), (None, "a row without an id", 7), (5, rows[5][1], 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int").selectExpr("*", "1 AS bin", "2 AS row")
    got = packing.pack_documents(docs, BYTE_BPE).collect()
    wanted = Counter()
    for doc_id, text, _ in rows:
        ids = [*load(BYTE_BPE).encode(text or "", add_special_tokens=False).ids, 0]
        for k, (s, n) in enumerate(packing.cut_points(len(ids), 2048)):
            wanted[doc_id, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == wanted
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for placed in by.values():
        placed.sort()
        assert [o for o, _ in placed] == [sum(n for _, n in placed[:k]) for k in range(len(placed))] and sum(n for _, n in placed) <= 2048
    lengths = np.array([r.length for r in got])
    assert len(by) == packing.least_bins(lengths, 2048)
    assert packing.pack_documents(docs.limit(0), BYTE_BPE).count() == 0


def test_pieces_are_few_files(spark, monkeypatch):
    made = {}

    def counted(df, label):
        out = lineage.materialize(df, label)
        made[label] = len(out.inputFiles())
        return out

    monkeypatch.setattr(packing, "materialize", counted)
    docs = spark.createDataFrame([(i, f"a text of its own, {i} " * (i % 50)) for i in range(400)], "doc_id long, text string").repartition(16)
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = lineage.materialize(packing.pack_documents(docs, BYTE_BPE), "packing")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got.select("doc_id").distinct().count() == got.count() == 400
    assert (made["pieces"], len(got.inputFiles())) == (1, 1)


def test_rounds_join_groups(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(int(n), i) for i, n in enumerate(rng.integers(1, 100, 900))], "length long, doc int")
    lengths = np.array([r.length for r in rows.collect()])
    got = packing.pack(rows, 100, group_pieces=60).collect()
    assert sorted(r.doc for r in got) == list(range(900))
    fills = Counter()
    for r in got:
        fills[r.sequence_id] += r.length
    assert max(fills.values()) <= 100
    alone = sum(len(packing.best_fit(lengths[k::15], 100)) for k in range(15))
    assert packing.least_bins(lengths, 100) <= len(fills) < alone  # groups apart leave a bin with room each


def test_sequences(spark):
    docs = spark.createDataFrame([(i, f"the text of document {i} " * (i * 40)) for i in range(12)], "doc_id long, text string")
    found = packing.sequences(docs, BYTE_BPE).collect()
    pieces = Counter()
    for r in found:
        ids = np.frombuffer(bytes(r.ids), "<u2")
        assert len(ids) == r.n_tokens <= 2048
        for doc, s, e in zip(r.doc_ids, r.starts, [*r.starts[1:], r.n_tokens], strict=True):
            pieces[doc] += e - s
    assert pieces == {i: len(load(BYTE_BPE).encode(f"the text of document {i} " * (i * 40), add_special_tokens=False).ids) + 1 for i in range(12)}


# manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(fields):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields])


def climb(nodes, at):
    """(root, siblings by level) of the node at `at`, by lists of digests."""
    ways = []
    while len(nodes) > 1:
        run = at // 16 * 16
        ways.append((nodes[run:at], nodes[at + 1 : run + 16]))
        nodes, at = [h(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)], at // 16
    return nodes[0], ways


def brute_manifest(rows, now):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, brute_leaf(r), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda x: x[:3])
    subroots = [climb([x[2] for x in by[s]], 0)[0] for s in order]
    out = []
    for i, s in enumerate(order):
        root, top = climb(subroots, i)
        for k, (_, _, own, r) in enumerate(by[s]):
            ways = climb([x[2] for x in by[s]], k)[1] + top
            fold = brute_leaf((*r[:4], now(r)))
            for before, after in ways:
                fold = h(*before, fold, *after)
            out.append((r[0], own, subroots[i], root, h(*[d for b, a in ways for d in b + a]), fold, fold == root))
    return sorted(out, key=repr)


MANIFEST_COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def changed(r):
    hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
    return re.sub("[A-Z]", lambda m: m[0].lower(), r[4]) if hit and r[4] is not None else r[4]


@pytest.mark.parametrize("sizes", [{}, {"a": 1}, {"a": 17}, {"a": 300, "b": 16, None: 1, "é": 33, "": 2}, {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_manifest(spark, sizes):
    rng, rows = random.Random(5), []
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((len(rows), source, rng.choice([None, "en", "de"]), rng.choice([None, 12]), rng.choice([None, "", "Text Ä", "lower", "X" * 3000])))
    if len(rows) > 20:
        rows += [rows[3], rows[3], (rows[3][0], rows[3][1], "other", 1, "Row"), (None, rows[3][1], None, None, "No Id"), (None, rows[3][1], None, None, "No Id either")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string").selectExpr("*", "'x' AS way", "1 AS lo", "2 AS digest")
    now = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    got = manifest.verified(docs, now)
    assert set(MANIFEST_COLUMNS) <= set(got.columns)
    assert sorted([tuple(r[c] for c in MANIFEST_COLUMNS) for r in got.collect()], key=repr) == brute_manifest(rows, changed)


def test_ways_are_siblings(spark):
    rows = [(i, "s", None, None, str(i)) for i in range(40)]
    got = manifest.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")).collect()
    nodes = [brute_leaf(r) for r in rows]
    for r in got:
        assert r.leaf_rank == r.doc_id and r.leaf == r.leaf_now == nodes[r.doc_id] and r.root == r.subroot
        assert [(w.before, w.after) for w in r.way] == [("".join(b), "".join(a)) for b, a in climb(nodes, r.doc_id)[1]]


# spelling variants


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else (a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :])


def test_acceptor_is_minimal():
    words = sorted({"".join(random.Random(i).choices("ab", k=1 + i % 5)) for i in range(40)})
    made = spelling.Acceptor(words)
    assert list(made.endings(made.root)) == words
    endings = {tuple(sorted(w[len(p) :] for w in words if w.startswith(p))) for w in words for p in (w[:k] for k in range(len(w) + 1))}
    assert len(made.states) == len(endings)  # a state for each set of endings, and no more


@pytest.mark.parametrize("seed", range(6))
def test_one_edit_pairs(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choices("abé"[: 2 + seed % 2], k=rng.randint(1, 7))) for _ in range(120)})
    got = [tuple(sorted(p)) for p in spelling.OneEdit(spelling.Acceptor(words)).pairs()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


def brute_variants(counts):
    out = {}
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize("part_words", [spelling.PART_WORDS, 12, 2])
def test_variants(spark, part_words):
    rng, counts = random.Random(part_words), {}
    for _ in range(500):  # few letters: large parts of words with one beginning or end
        counts["".join(rng.choices("abc", k=4 if rng.random() < 0.8 else 6)).join(rng.choice([("aaa", "bb"), ("abc", "cc"), ("c", "aaab"), ("éa", "ab"), ("aaaa", "a")]))] = rng.choice([2, 3, 30, 30, 400, 4000, 50_000])
    counts = {w: n for w, n in counts.items() if len(w) >= 7}
    words = spark.createDataFrame([(w, n, 1) for w, n in counts.items()], "word string, n long, form int")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(words, part_words=part_words).collect()}
    wanted = brute_variants(counts)
    assert any(v[1] != v[0] and v[0] for v in wanted.values())  # forms of forms
    assert got == wanted


def test_word_counts(spark):
    long_text = "Sifting Stones " * 3000
    rows = [(1, "Überaus überaus ÜBERAUS grainstones, grainstones' GrainStones_x short", 0), (2, None, 0), (None, "grainstones", 0), (3, "", 0), (4, long_text, 0), (4, long_text, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")

    def brute(every):
        counts = Counter()
        for doc_id, text, _ in rows:
            for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
                w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
                k = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
                if every and k % every == 0:
                    w = w[: k % len(w)] + w[k % len(w) + 1 :]
                if len(w) >= 7:
                    counts[w] += 1
        return {w: n for w, n in counts.items() if n >= 2}

    for every in (None, 1, 2, 3):
        assert {r.word: r.n for r in spelling.word_counts(docs, typo_every=every).collect()} == brute(every)
    empty = spelling.word_counts(docs.limit(0))
    assert empty.count() == 0 and spelling.variants(empty).count() == 0
