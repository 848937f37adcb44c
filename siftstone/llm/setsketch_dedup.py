"""Near-duplicate documents by SetSketch registers.

A document's set holds its distinct word shingles as 64-bit hashes. Register i of its sketch is the smallest of
exponentially distributed values that a hash gives the elements, on a truncated logarithmic scale: registers of
unions are maxima (sketches merge), and two sets agree in a register with about their Jaccard similarity.

1. Equal sets form classes; from here on one document stands for its class.
2. Registers are banded. In each bucket the smallest id is the leader, and each document is compared with the
   leader it shares most bands with: a star, so that a group of thousands of copies gives as many pairs, not squares.
3. Pairs pass a joint likelihood test on their registers, then are confirmed on full sets.
4. Buckets that still hold several components are searched whole, in units of two bounded blocks (blocks of the
   largest component meet only blocks of the others): the likelihood
   test picks the members that may have a partner in another component; their full sets are brought to the unit
   and compared, and the unit returns the links of a spanning forest. No pair of a bucket goes unexamined. A
   crowded bucket is cut into smaller ones first, by bands of its members' registers in another grouping.
5. Components of all links.

The width of bands grows with the logarithm of the rows, so that buckets keep few strangers, and their number follows from
the width, so that the share of pairs at the threshold that meet stays the same (1 - MISS).

Nulls and empties: a text without words has an empty set and links with nothing; rows with a null doc_id
link with nothing and lend copies no id. Rows that share a doc_id are one node, whatever their texts: what one of them links to, all
do. Equal sets are ties: the smallest doc_id stands for them. Texts are read whole. Empty tables give empty
results; extra columns don't matter.
"""

from __future__ import annotations

import functools
import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import is_small, lookup_join, materialize, pieces, release, released, sheltering
from siftstone.llm.components import components
from siftstone.llm.hashing import U, mix, range_hashes, slices

#: Base of the scale, rate and highest register value.
BASE, RATE, TOP = 1.001, 20.0, 65_535
#: Share of pairs at the threshold that may meet in no bucket.
MISS = 2.2e-4
#: Bands are as wide as keeps strangers of this similarity that share a bucket below this number.
STRANGE, STRANGERS = 0.1, 2000
#: Rows of a block; a unit of work holds two.
BLOCK = 256
#: Members of a bucket, beside its largest component, from which on it is cut into smaller ones.
CROWD = 4096
#: A pair is dropped if a similarity of the threshold or more is e**SLACK times less likely than the best one.
SLACK = 10.0


@dataclass(frozen=True)
class Bands:
    """Registers in a band, and bands."""

    width: int
    n: int

    @property
    def registers(self) -> int:
        return self.width * self.n

    @classmethod
    def of(cls, rows: int, threshold: float) -> Bands:
        width = max(4, math.ceil(math.log(max(rows, 1) / STRANGERS) / -math.log(STRANGE)))
        return cls(width, math.ceil(math.log(MISS) / math.log(1 - threshold**width)))


@dataclass(frozen=True)
class Shingles:
    words: int = 5
    percent: int = 80


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words of each text) of UTF-8 texts that end at bounds[1:] in data."""
    data = _LOWER[data]
    gap = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    inside = ~gap
    starts = np.flatnonzero(inside & (np.concatenate([[True], gap[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(inside & (np.concatenate([gap[1:], [True]]) | edge[1:])) + 1
    return range_hashes(data, starts, ends), np.diff(np.searchsorted(starts, bounds))


def shingle_sets(texts: pa.Array, k: int):
    """Yields (row, sorted distinct shingle hashes) of each text with words, reading about a megabyte at a time."""
    texts = texts.cast(pa.large_string())
    if not len(texts) or texts.buffers()[2] is None:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    for at, to in slices(offsets):
        bounds = offsets[at : to + 1] - offsets[at]
        if bounds[-1]:
            words, counts = word_hashes(data[offsets[at] : offsets[to]], bounds)
            mixed = words.copy()
            for i in range(1, k):  # mixed[j]: words j..j+k-1, where they are of one text
                mixed[: len(words) - i] = mix(mixed[: len(words) - i] * U(0xD6E8FEB86659FD93) + words[i:])
            first = np.concatenate([[0], np.cumsum(counts)])
            for row in range(to - at):
                s, n = int(first[row]), int(counts[row])
                if n >= k:
                    yield at + row, np.unique(mixed[s : s + n - k + 1])
                elif n:
                    whole = words[s : s + 1]
                    for w in words[s + 1 : s + n]:
                        whole = mix(whole * U(0xA24BAED4963EE407) + w)
                    yield at + row, whole + U(n)


@functools.cache
def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(55).integers(1, 2**63, n, dtype=np.uint64) | U(1)


def sketches(sets: list[np.ndarray], registers: int = 64) -> np.ndarray:
    """Registers (sets x registers, 16 bit) of sets that aren't empty."""
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), registers), np.uint16)
    for i, m in enumerate(_multipliers(registers)):
        least = np.minimum.reduceat(flat * m, starts)
        value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
        out[:, i] = np.clip(np.floor(1 - np.log(np.maximum(value, 1e-300)) / np.log(BASE)), 0, TOP)
    return out


def band_keys(registers: np.ndarray, bands: Bands, regrouped: bool = False) -> np.ndarray:
    """Keys (sets x bands). regrouped: bands of registers that stand as far apart as they can, instead of side by side."""
    parts = registers.reshape(len(registers), bands.width, bands.n).transpose(0, 2, 1) if regrouped else registers.reshape(len(registers), bands.n, bands.width)
    keys = np.broadcast_to(np.arange(1, bands.n + 1, dtype=U) * U(0x9E3779B97F4A7C15), parts.shape[:2])
    for k in range(bands.width):
        keys = mix(keys * U(0xD6E8FEB86659FD93) + parts[:, :, k])
    return keys.view(np.int64)


def plausible(greater: np.ndarray, less: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, threshold: float, registers: int = 64) -> np.ndarray:
    """True where the registers' joint likelihood leaves room for a Jaccard similarity of threshold or more.

    greater, less: registers in which x is over and under y. The likelihood of a similarity comes from the chances
    that a register of x exceeds one of y, the reverse, or neither, given the set sizes.
    """
    n_x, n_y = n_x.astype(float)[..., None], n_y.astype(float)[..., None]
    u, v = n_x / (n_x + n_y), n_y / (n_x + n_y)
    most = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 51)
    spread = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def score(j):
        up, down = np.maximum(spread(u - v * j), 1e-12), np.maximum(spread(v - u * j), 1e-12)
        return greater[..., None] * np.log(up) + less[..., None] * np.log(down) + (registers - greater - less)[..., None] * np.log(np.maximum(1 - up - down, 1e-12))

    best = score(most * grid).max(-1)
    near = score(np.minimum(most, threshold) + np.maximum(most - threshold, 0) * np.linspace(0, 1, 11)).max(-1)
    return (best - near <= SLACK) & (most[..., 0] >= threshold - 1e-9)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    both = len(x) + len(y)
    merged = np.concatenate([x, y])
    merged.sort(kind="stable")
    shared = int((merged[1:] == merged[:-1]).sum())
    return 100 * shared >= percent * (both - shared)


def sketched(docs: DataFrame, shingles: Shingles, plan: Bands) -> DataFrame:
    """doc_id, n_shingles, digest (of the set), registers, bands; nulls in the last three for empty sets."""
    k = shingles.words

    def run(batches):
        for batch in pieces(batches):
            found = list(shingle_sets(batch.column("text"), k))
            n = batch.num_rows
            sizes, digests, registers, keys = [0] * n, [None] * n, [None] * n, [None] * n
            for at in range(0, len(found), 512):
                part = found[at : at + 512]
                regs = sketches([s for _, s in part], plan.registers)
                bands = band_keys(regs, plan)
                for (row, s), r, b in zip(part, regs, bands, strict=True):
                    sizes[row], digests[row], registers[row], keys[row] = len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), r.tobytes(), b
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(registers, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "registers", "bands"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(released(run), "doc_id bigint, n_shingles bigint, digest binary, registers binary, bands array<bigint>")


def full_sets(docs: DataFrame, nodes: DataFrame, shingles: Shingles, rows: int) -> DataFrame:
    """node, hashes: the full sets of the documents in nodes (node), as bytes of sorted hashes. rows: of docs."""
    k = shingles.words

    def run(batches):
        for batch in pieces(batches):
            found = [(row, s.tobytes()) for row, s in shingle_sets(batch.column("text"), k)]
            ids = batch.column("node")
            yield pa.RecordBatch.from_arrays([ids.take(pa.array([x[0] for x in found], pa.int64())), pa.array([x[1] for x in found], pa.binary())], names=["node", "hashes"])

    nodes = materialize(nodes.select("node").distinct(), "wanted", rows)
    side = F.broadcast(nodes) if is_small(nodes) else nodes
    wanted = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")).join(side, "node", "left_semi")
    return materialize(wanted.mapInArrow(released(run), "node bigint, hashes binary"), "sets")


def _groups(batches, keys: list[str]):
    """Tables of the rows of each group, from batches sorted by keys."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            if s == e:
                continue
            key = tuple(c[s] for c in columns)
            if held and key != current:
                yield pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _registers(column) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<u2").reshape(len(raw), -1)


def _open_pairs(group: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of a unit that may be linked and are of different components. In a unit of two blocks only pairs across."""
    regs, n = _registers(group.column("registers")), group.column("n_shingles").to_numpy()
    label, block = group.column("label").to_numpy(), group.column("block").to_numpy()
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    single = i == j
    low, high = np.flatnonzero(block == i), np.flatnonzero(block == j)
    xs, ys = [], []
    for at in range(0, len(low), 32):  # bounded temporaries
        rows = low[at : at + 32]
        open_ = label[rows][:, None] != label[high][None, :]
        if single:
            open_ &= rows[:, None] < high[None, :]
        a, b = np.nonzero(open_)
        if not len(a):
            continue
        x, y = rows[a], high[b]
        for s in range(0, len(x), 8192):
            p, q = x[s : s + 8192], y[s : s + 8192]
            ok = plausible((regs[p] > regs[q]).sum(1), (regs[p] < regs[q]).sum(1), n[p], n[q], threshold, regs.shape[1])
            xs.append(p[ok])
            ys.append(q[ok])
    empty = np.empty(0, np.int64)
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (empty, empty)


def star_links(buckets: DataFrame, nodes: DataFrame, docs: DataFrame, shingles: Shingles, rows: int) -> DataFrame:
    """a, b: confirmed links between documents and the leaders of their buckets."""
    threshold, percent = shingles.percent / 100, shingles.percent
    leaders = buckets.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = buckets.join(leaders, "bucket").filter("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("bands"))
    best = shared.groupBy("node").agg(F.min_by("leader", F.struct(-F.col("bands"), "leader")).alias("leader"))
    theirs = nodes.select(F.col("node").alias("leader"), F.col("registers").alias("leader_registers"), F.col("n_shingles").alias("leader_n"))

    def test(batches):
        for batch in pieces(batches):
            if batch.num_rows:
                x, y = _registers(batch.column("registers")), _registers(batch.column("leader_registers"))
                ok = plausible((x > y).sum(1), (x < y).sum(1), batch.column("n_shingles").to_numpy(), batch.column("leader_n").to_numpy(), threshold, x.shape[1])
                yield batch.select(["node", "leader"]).filter(pa.array(ok))

    pairs = materialize(best.join(nodes, "node").join(theirs, "leader").select("node", "leader", "registers", "leader_registers", "n_shingles", "leader_n").mapInArrow(released(test), "node bigint, leader bigint").distinct(), "pairs", rows)
    sets = full_sets(docs, pairs.select("node").union(pairs.select(F.col("leader").alias("node"))), shingles, rows)

    def confirm(batches):
        for batch in pieces(batches, 200):
            ok = [linked(np.frombuffer(x, U), np.frombuffer(y, U), percent) for x, y in zip(batch.column("hashes").to_pylist(), batch.column("leader_hashes").to_pylist(), strict=True)]
            yield batch.select(["node", "leader"]).filter(pa.array(ok, pa.bool_()))

    theirs = sets.select(F.col("node").alias("leader"), F.col("hashes").alias("leader_hashes"))
    both = pairs.join(sets, "node").join(theirs, "leader").select("node", "leader", "hashes", "leader_hashes")
    return both.mapInArrow(released(confirm), "node bigint, leader bigint").toDF("a", "b")


def _mixed(labelled: DataFrame) -> DataFrame:
    """bucket, main (its largest component), mains, rests (members of it and of all others) of the buckets with several components."""
    parts = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("bucket").agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("main")).filter("labels > 1")
    return mixed.select("bucket", F.col("main.label").alias("main"), F.col("main.n").alias("mains"), (F.col("n") - F.col("main.n")).alias("rests"))


def _cut_buckets(labelled: DataFrame, nodes: DataFrame, plan: Bands) -> DataFrame:
    """labelled with the members of crowded buckets in smaller ones instead, by bucket and a band of another grouping of their registers."""
    crowded = materialize(_mixed(labelled).filter(F.col("rests") > CROWD).select("bucket"), "crowded")
    if crowded.isEmpty():
        return labelled

    def rekey(batches):
        for batch in pieces(batches):
            if batch.num_rows:
                keys = band_keys(_registers(batch.column("registers")), plan, regrouped=True).view(U)
                own = batch.column("bucket").to_numpy().view(U)[:, None]
                at = pa.array(np.repeat(np.arange(batch.num_rows), plan.n))
                yield pa.RecordBatch.from_arrays([pa.array(mix(keys ^ own).reshape(-1).view(np.int64)), batch.column("node").take(at), batch.column("label").take(at)], names=["bucket", "node", "label"])

    inside = labelled.join(crowded, "bucket", "left_semi").join(nodes.select("node", "registers"), "node").select("bucket", "node", "label", "registers")
    smaller = inside.mapInArrow(released(rekey), "bucket bigint, node bigint, label bigint")
    return materialize(labelled.join(crowded, "bucket", "left_anti").select("bucket", "node", "label").unionByName(smaller), "recut")


def other_links(buckets: DataFrame, nodes: DataFrame, found: DataFrame, docs: DataFrame, shingles: Shingles, plan: Bands, rows: int) -> DataFrame | None:
    """a, b: links that join different components of `found` (id, component) within a bucket; None if no bucket is open."""
    threshold, percent = shingles.percent / 100, shingles.percent
    labels = nodes.select("node").distinct().join(found.withColumnRenamed("id", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("label"))
    labelled = _cut_buckets(materialize(buckets.join(labels, "node").select("bucket", "node", "label"), "labelled", rows * plan.n), nodes, plan)
    # members of a bucket's largest component only meet the others; so its blocks cost what the rest is large, not their square
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int").alias(c)
    mixed = _mixed(labelled).select("bucket", "main", blocks("mains"), blocks("rests"))
    members = labelled.join(mixed, "bucket").withColumn("in_main", F.col("label") == F.col("main"))
    members = members.withColumn("block", F.when(F.col("in_main"), F.pmod(F.xxhash64("node"), F.col("mains"))).otherwise(F.col("mains") + F.pmod(F.xxhash64("node"), F.col("rests"))).cast("int"))
    partners = F.sequence(F.when(F.col("in_main"), F.col("mains")).otherwise(0), F.col("mains") + F.col("rests") - 1)
    units = members.withColumn("k", F.explode(partners)).select("bucket", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "block", "node", "label")
    keys = ["bucket", "i", "j"]

    def by_unit(df: DataFrame) -> DataFrame:
        return df.repartition(*keys).sortWithinPartitions(*keys)

    def screen(batches):
        for group in _groups(pieces(batches, 2000), keys):
            x, y = _open_pairs(group, threshold)
            if len(x):
                yield from group.take(np.unique(np.concatenate([x, y]))).to_batches()

    columns = "bucket bigint, i int, j int, block int, node bigint, label bigint, registers binary, n_shingles bigint"
    wide = by_unit(units.join(nodes.select("node", "registers", "n_shingles"), "node").select(*[c.split()[0] for c in columns.split(", ")]))
    flagged = materialize(wide.mapInArrow(released(screen), columns), "flagged")
    if flagged.isEmpty():
        return None
    sets = full_sets(docs, flagged, shingles, rows)

    def confirm(batches):
        for group in _groups(pieces(batches, 2000), keys):
            x, y = _open_pairs(group, threshold)
            node, label = group.column("node").to_pylist(), group.column("label").to_pylist()
            hashes = [np.frombuffer(h, U) for h in group.column("hashes").to_pylist()]
            root = {v: v for v in label}

            def top(v):
                while root[v] != v:
                    root[v] = root[root[v]]
                    v = root[v]
                return v

            a, b = [], []
            for p, q in zip(x.tolist(), y.tolist(), strict=True):
                s, t = top(label[p]), top(label[q])
                if s != t and linked(hashes[p], hashes[q], percent):
                    root[max(s, t)] = min(s, t)
                    a.append(node[p])
                    b.append(node[q])
            if a:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return by_unit(flagged.join(sets, "node").select(*[c.split()[0] for c in columns.split(", ")], "hashes")).mapInArrow(released(confirm), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingles: Shingles = Shingles()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    n = docs.count()
    plan = Bands.of(n, shingles.percent / 100)
    rows = materialize(sketched(docs, shingles, plan), "sketches")
    classes = rows.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"), F.first("bands").alias("bands"))
    nodes = materialize(classes, "classes", n)
    named = nodes.filter(F.col("node").isNotNull())
    buckets = materialize(named.select("node", F.explode("bands").alias("bucket")), "buckets")
    stars = materialize(star_links(buckets, named, docs, shingles, n), "stars", n)
    met = components(stars, most=n)
    others = other_links(buckets, named, met, docs, shingles, plan, n)
    links = stars if others is None else stars.unionByName(others)
    shared = _shared_ids(rows, nodes)
    found = components(materialize(links if shared is None else links.unionByName(shared), "found"))
    release(buckets, stars, met)
    labels = nodes.select("digest", "node").join(found, nodes["node"] == found["id"], "left").select("digest", F.coalesce("component", "node").alias("__label"))
    joined = rows.select("doc_id", "n_shingles", "digest").join(labels, "digest", "left")
    label = F.when(F.col("doc_id").isNotNull(), F.coalesce("__label", "doc_id"))
    if shared is not None:  # rows without words that share their id with others
        joined = lookup_join(joined, materialize(found.join(shared.select(F.col("a").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("doc_id"), F.col("component").alias("__own")), "shared"), "doc_id")
        label = F.when(F.col("doc_id").isNotNull(), F.coalesce("__own", "__label", "doc_id"))
    return joined.select("doc_id", "n_shingles", label.alias("component_id"), F.col("doc_id").eqNullSafe(label).alias("kept"))


def _shared_ids(rows: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """a, b: a doc_id whose rows have different sets, and the nodes of these; None if there is no such id."""
    several = materialize(rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y"), F.count_if(F.col("digest").isNull()).alias("z")).filter("x <> y or (x is not null and z > 0)").select("doc_id"), "several")
    if several.isEmpty():
        return None
    own = rows.filter("digest is not null").join(F.broadcast(several) if is_small(several) else several, "doc_id", "left_semi")
    return materialize(own.select("doc_id", "digest").distinct().join(nodes.select("digest", "node"), "digest").select(F.col("doc_id").alias("a"), F.col("node").alias("b")), "shared-ids")


@sheltering
def deduplicated(docs: DataFrame, shingles: Shingles = Shingles()) -> DataFrame:
    """The rows of docs that stay: one row of each group.

    That is the row of the group's smallest doc_id; of several rows with this id the one with the smallest hash of its text (then of
    the whole row), so that reruns agree. Rows without a doc_id stay, as they can't be told apart by it.
    """
    verdicts = materialize(near_duplicates(docs, shingles).select("doc_id", "kept"), "verdicts")
    rows = verdicts.count()
    gone = materialize(verdicts.filter(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__gone")).distinct(), "gone", rows)
    left = docs.join(F.broadcast(gone) if is_small(gone) else gone, docs["doc_id"] == F.col("__gone"), "left_anti")
    repeated = materialize(verdicts.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__id")), "repeated", rows)
    release(verdicts)
    if repeated.isEmpty():
        return left
    side = F.broadcast(repeated) if is_small(repeated) else repeated
    key = docs["doc_id"] == F.col("__id")
    whole = F.struct(F.xxhash64("text").alias("t"), F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))).alias("r"))
    least = left.join(side, key, "left_semi").withColumn("__row", whole)
    best = materialize(least.groupBy("doc_id").agg(F.min("__row").alias("__least")), "best")
    one = lookup_join(least, best, "doc_id").filter("__row = __least").dropDuplicates(["doc_id"]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return left.join(side, key, "left_anti").unionByName(one)
