"""Near-duplicate embeddings by E8 lattice hashing.

Vectors are normalised and projected by random orthonormal rows; groups of eight coordinates are decoded to points of
the E8 lattice. A table's code is the points of its groups, so that close vectors often share a cell. Each vector
also probes neighbouring cells: those that its runner-up lattice points make. Vectors that meet in a cell
are compared by 128 signs of random projections first: cells ship these and ids, no vectors. Only members with a partner whose signs leave
room for the threshold get their vectors, and are compared by cosine in double precision. All comparisons are
between blocks of bounded size.

Equal vectors form classes first, of which one is compared. Cells give edges that span what is linked in them, so
a large group of copies gives few rows; from all edges come the components. Every link lies within a
component, so numbers of links are counted there, again in blocks, each pair once. The number of tables is set from
a simulation of pairs at the threshold, for the wanted recall; groups per table grow with the logarithm of the
input over CELL, so that cells hold some CELL strangers at every size, whose signs are compared for next to nothing.

Nulls: a vector that is null, empty or zero, or that holds a null or non-finite component, links with nothing. Vectors
of different lengths never link. A cosine of exactly the threshold links. Rows that share a vec_id are one node of components, and count as links by row; rows without one
link with nothing and have no component. Vectors of any length are taken whole. Empty tables give empty results; extra
columns are left out.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import materialize, pieces, release, released
from siftstone.llm.components import components
from siftstone.llm.hashing import U, mix
from siftstone.llm.setsketch_dedup import _groups

#: Share of pairs at the threshold that should meet.
RECALL = 0.9995
#: Difference of a projected pair at the threshold, in units in which the lattice's nearest points are sqrt(2) apart.
SPREAD = 0.45
#: Neighbouring cells that a vector probes in each table.
PROBES = 4
#: Strangers in a cell.
CELL = 256
#: Signs of random projections, and the share of pairs at the threshold that they may lose.
SIGNS, LOST = 128, 1e-6
#: Rows of a block; a unit of work holds two. Rows of a strip, which is compared at a time.
BLOCK, STRIP = 768, 256
#: Single-precision cosines nearer to the threshold than this are checked again.
MARGIN = 4e-6


def _d8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest point of D8, index of its least sure coordinate, step that flips the parity there)."""
    near = np.rint(x)
    off = x - near
    k = np.abs(off).argmax(-1)
    rows = np.arange(len(x))
    step = np.where(off[rows, k] >= 0, 1.0, -1.0)
    odd = near.sum(-1) % 2 != 0
    near[rows[odd], k[odd]] += step[odd]
    return near, k, step


def e8_nearest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest E8 point, the best point of the other coset of D8, squared distance between their errors), doubled to integers."""
    a = _d8(x)[0]
    b = _d8(x - 0.5)[0] + 0.5
    da, db = ((x - a) ** 2).sum(-1), ((x - b) ** 2).sum(-1)
    first = da <= db
    best, other = np.where(first[:, None], a, b), np.where(first[:, None], b, a)
    return (2 * best).astype(np.int64), (2 * other).astype(np.int64), np.abs(da - db)


def _second(x: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a neighbour in the same coset: the two least sure coordinates moved to their other side, its added squared distance)."""
    off = x - best / 2
    order = np.argsort(-np.abs(off), -1)[:, :2]
    rows = np.arange(len(x))[:, None]
    step = np.where(off[rows, order] >= 0, 1, -1)
    out = best.copy()
    out[rows, order] += 2 * step
    return out, ((x - out / 2) ** 2).sum(-1) - (off**2).sum(-1)


def _code(points: np.ndarray) -> np.ndarray:
    h = np.full(len(points), U(0x243F6A8885A308D3))
    for c in range(points.shape[1]):
        h = mix(h * U(0x9E3779B97F4A7C15) + points[:, c].astype(np.uint64))
    return h


class Lattice:
    def __init__(self, dim: int, tables: int, groups: int, threshold: float, seed: int = 8) -> None:
        rng = np.random.default_rng(seed)
        self.tables, self.groups = tables, groups
        width = 8 * groups
        rows = []
        for _ in range(tables):  # orthonormal rows, as many at a time as there are dimensions
            q = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-width // dim))]
            rows.append(np.concatenate(q)[:width])
        self.rows = np.concatenate(rows)
        gap = math.sqrt(2 - 2 * threshold)
        # eight of dim coordinates hold 8 / dim of a squared difference
        self.scale = SPREAD / (gap * math.sqrt(8 / max(dim, 8)))

    def cells(self, x: np.ndarray, probes: int = PROBES) -> np.ndarray:
        """Codes (vectors x tables x (1 + probes)): the own cell, then its nearest neighbours."""
        out = np.empty((len(x), self.tables, 1 + probes), U)
        projected = x @ self.rows.T * self.scale
        for t in range(self.tables):
            own, options, costs = [], [], []
            for g in range(self.groups):
                at = 8 * (t * self.groups + g)
                y = projected[:, at : at + 8]
                best, other, far = e8_nearest(y)
                twin, more = _second(y, best)
                own.append(_code(best))
                options += [(g, _code(other)), (g, _code(twin))]
                costs += [far, more]
            salt = U((t + 1) * 0xD1B54A32D192ED03 % 2**64)

            def joined(codes, salt=salt):
                h = np.full(len(x), salt)
                for c in codes:
                    h = mix(h ^ c) * U(0x9E3779B97F4A7C15)
                return h

            out[:, t, 0] = joined(own)
            # single moves, then pairs of moves in different groups, by cost
            moves, price = [], []
            for a in range(len(options)):
                moves.append(joined([options[a][1] if g == options[a][0] else own[g] for g in range(self.groups)]))
                price.append(costs[a])
                for b in range(a + 1, len(options)):
                    if options[a][0] != options[b][0]:
                        swap = {options[a][0]: options[a][1], options[b][0]: options[b][1]}
                        moves.append(joined([swap.get(g, own[g]) for g in range(self.groups)]))
                        price.append(costs[a] + costs[b])
            moves_, order = np.stack(moves, 1), np.argsort(np.stack(price, 1), 1, kind="stable")[:, :probes]
            for p in range(probes):
                out[:, t, 1 + p] = moves_[np.arange(len(x)), order[:, min(p, order.shape[1] - 1)]]
        return out


def meeting_chance(dim: int, groups: int, threshold: float, samples: int = 4000) -> float:
    """Simulated share of pairs at the threshold that meet in one table: own cells equal, or one probes the other's."""
    rng = np.random.default_rng(80)
    x = rng.normal(size=(samples, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=(samples, dim))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = threshold * x + math.sqrt(1 - threshold**2) * z
    lattice = Lattice(dim, 1, groups, threshold)
    a, b = lattice.cells(x)[:, 0], lattice.cells(y)[:, 0]
    return float(((a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)).mean())


@functools.cache
def plan(dim: int, vectors: int, threshold: float) -> tuple[int, int]:
    """(groups of a table, tables). A group tells some 300 unrelated vectors apart; cells hold CELL of them. Tables reach RECALL."""
    groups = max(1, math.ceil(math.log(max(vectors / CELL, 2), 324)))
    chance = min(max(meeting_chance(dim, groups, threshold), 0.01), 0.9999)
    return groups, max(2, math.ceil(math.log(1 - RECALL) / math.log(1 - chance)))


@functools.lru_cache(maxsize=4)
def lattice_of(dim: int, vectors: int, threshold: float) -> Lattice:
    groups, tables = plan(dim, vectors, threshold)
    return Lattice(dim, tables, groups, threshold)


def signs(x: np.ndarray) -> np.ndarray:
    """The signs of SIGNS random projections (vectors x 2, 64 bit)."""
    rows = np.random.default_rng(128).normal(size=(SIGNS, x.shape[1]))
    return np.packbits(x @ rows.T > 0, 1).view(U)


def most_apart(threshold: float) -> int:
    """As many signs as differ in pairs at the threshold, but for LOST of these."""
    p = math.acos(min(threshold, 1.0)) / math.pi
    tail, k = 1.0, -1
    while tail > LOST:
        k += 1
        tail -= math.comb(SIGNS, k) * p**k * (1 - p) ** (SIGNS - k)
    return k


def normalised(df: DataFrame, vector: str, key: str) -> DataFrame:
    """node, digest, unit (bytes of doubles), dim; nulls in the last three for vectors that can't link."""

    def run(batches):
        for batch in pieces(batches):
            digests, units, dims = [], [], []
            for v in batch.column("v").to_pylist():
                unit = None
                if v and None not in v:
                    x = np.array(v, float)
                    x /= np.abs(x).max() if np.isfinite(x).all() and x.any() else np.nan
                    if np.isfinite(x).all():
                        unit = np.ascontiguousarray(x / np.sqrt((x * x).sum()))
                digests.append(None if unit is None else hashlib.blake2b(unit.tobytes(), digest_size=16).digest())
                units.append(None if unit is None else unit.tobytes())
                dims.append(None if unit is None else len(unit))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(digests, pa.binary()), pa.array(units, pa.binary()), pa.array(dims, pa.int32())], names=["node", "digest", "unit", "dim"])

    return df.select(F.col(key).cast("long").alias("node"), F.col(vector).alias("v")).mapInArrow(released(run), "node bigint, digest binary, unit binary, dim int")


def _units(column, kind=np.float64) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1)


def _in_units(rows: DataFrame, cell: str, by: str, busy: DataFrame) -> DataFrame:
    """rows (cell, by, ...) of the cells in busy (cell, n), dealt to units (cell, i, j) of two blocks each."""
    placed = rows.join(busy.select(cell, F.ceil(F.col("n") / BLOCK).cast("int").alias("__blocks")), cell).withColumn("block", F.pmod(F.xxhash64(by), F.col("__blocks")).cast("int"))
    dealt = placed.withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return dealt.withColumns({"i": F.least("block", "__k"), "j": F.greatest("block", "__k")}).drop("__k", "__blocks")


def _sorted(units: DataFrame, cell: str) -> DataFrame:
    return units.repartition(cell, "i", "j").sortWithinPartitions(cell, "i", "j")


def _halves(group: pa.Table) -> tuple[np.ndarray, np.ndarray, bool] | None:
    """(rows of block i, rows of block j, whether these are one block), or None if one of two blocks is empty."""
    block = group.column("block").to_numpy()
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    low, high = np.flatnonzero(block == i), np.flatnonzero(block == j)
    return (low, high, i == j) if len(low) and len(high) else None


def _spanning(near: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """The least row that each of n rows reaches over near (low x high)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        for at in range(0, len(low), STRIP):
            part, own = near[at : at + STRIP], low[at : at + STRIP]
            label[own] = np.minimum(label[own], np.where(part, label[high][None, :], n).min(1))
            label[high] = np.minimum(label[high], np.where(part, label[own][:, None], n).min(0))
        if (label == before).all():
            return label


def cells_of(classes: DataFrame, vectors: int, threshold: float) -> DataFrame:
    """node, cell, member (else it only probes), s, t (signs): a row for each cell that a vector stands in or probes."""

    def run(batches):
        for batch in pieces(batches):
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                lattice, x = lattice_of(dim, vectors, threshold), _units(part.column("unit"))
                # cells of vectors of different lengths are different cells
                cells = mix(lattice.cells(x) ^ U(dim)).reshape(-1).view(np.int64)
                own, member = signs(x).view(np.int64), pa.array([True, *[False] * PROBES] * lattice.tables)
                at = pa.array(np.repeat(np.arange(part.num_rows), lattice.tables * (1 + PROBES)))
                yield pa.RecordBatch.from_arrays([part.column("node").take(at), pa.array(cells), pa.concat_arrays([member] * part.num_rows), pa.array(own[:, 0]).take(at), pa.array(own[:, 1]).take(at)], names=["node", "cell", "member", "s", "t"])

    return classes.select("node", "unit", "dim").mapInArrow(released(run), "node bigint, cell bigint, member boolean, s bigint, t bigint")


def meeting_edges(classes: DataFrame, vectors: int, threshold: float) -> DataFrame:
    """a, b, sure: edges that span what is linked among the vectors that meet in a cell.

    Cells compare single-precision vectors; pairs too close to the threshold to tell are returned with sure = false.
    """
    stands = materialize(cells_of(classes, vectors, threshold), "cells")
    # probes of cells that no vector calls its own meet nobody
    busy = stands.groupBy("cell").agg(F.count("*").alias("n"), F.max("member").alias("owned")).filter("n > 1 and owned")
    units = _in_units(stands, "cell", "node", busy)
    apart = most_apart(threshold)

    def screen(batches):
        for group in _groups(pieces(batches, 8192), ["cell", "i", "j"]):
            halves = _halves(group)
            own = group.column("member").to_numpy(zero_copy_only=False)
            if halves is None or not own.any():
                continue
            low, high, _ = halves
            # unsigned: bits of a negative number are counted in its absolute value
            s, t, node = group.column("s").to_numpy().view(U), group.column("t").to_numpy().view(U), group.column("node").to_numpy()
            some = np.zeros(len(s), bool)
            for at in range(0, len(low), STRIP):
                rows = low[at : at + STRIP]
                near = np.bitwise_count(s[rows][:, None] ^ s[high][None, :]) + np.bitwise_count(t[rows][:, None] ^ t[high][None, :]) <= apart
                near &= (own[rows][:, None] | own[high][None, :]) & (node[rows][:, None] != node[high][None, :])
                some[rows] |= near.any(1)
                some[high] |= near.any(0)
            if some.any():
                yield from group.filter(pa.array(some)).select(["cell", "i", "j", "block", "node", "member"]).to_batches()

    flagged = materialize(_sorted(units, "cell").select("cell", "i", "j", "block", "node", "member", "s", "t").mapInArrow(released(screen), "cell bigint, i int, j int, block int, node bigint, member boolean"), "flagged")

    def narrow(batches):
        for batch in pieces(batches):
            small = [np.frombuffer(x, np.float64).astype(np.float32).tobytes() for x in batch.column("unit").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(small, pa.binary())], names=["node", "unit"])

    wanted = classes.select("node", "unit").join(flagged.select("node").distinct(), "node", "left_semi")
    vectors_ = wanted.mapInArrow(released(narrow), "node bigint, unit binary")

    def compare(batches):
        for group in _groups(pieces(batches, 8192), ["cell", "i", "j"]):
            halves = _halves(group)
            if halves is None:
                continue
            low, high, _ = halves
            own, x, node = group.column("member").to_numpy(zero_copy_only=False), _units(group.column("unit"), np.float32), group.column("node").to_numpy()
            near, edges = np.zeros((len(low), len(high)), bool), []
            for at in range(0, len(low), STRIP):
                rows = low[at : at + STRIP]
                cosine = x[rows] @ x[high].T
                can = (own[rows][:, None] | own[high][None, :]) & (node[rows][:, None] != node[high][None, :])
                near[at : at + STRIP] = can & (cosine >= threshold + MARGIN)
                p, q = np.nonzero(can & (np.abs(cosine - threshold) < MARGIN))
                edges += [(a, b, False) for a, b in zip(node[rows[p]].tolist(), node[high[q]].tolist(), strict=True)]
            if near.any():
                edges += [(int(node[k]), int(node[v]), True) for k, v in enumerate(_spanning(near, low, high, len(node)).tolist()) if k != v]
            if edges:
                a, b, c = zip(*edges, strict=True)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sure": pa.array(c)})

    met = materialize(_sorted(flagged.join(vectors_, "node"), "cell").select("cell", "i", "j", "block", "node", "member", "unit").mapInArrow(released(compare), "a bigint, b bigint, sure boolean"), "met")
    release(stands, flagged)
    return met


def confirmed(edges: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """a, b of the edges that hold in double precision."""

    def run(batches):
        for batch in pieces(batches):
            ok = [float(np.frombuffer(x, np.float64) @ np.frombuffer(y, np.float64)) >= threshold for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x, y = (classes.select(F.col("node").alias(n), F.col("unit").alias(v)) for n, v in (("a", "x"), ("b", "y")))
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(released(run), "a bigint, b bigint")


def link_counts(classes: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """digest, links: members of other classes that a class links to. Links lie within components, whose members are compared in blocks."""
    members = classes.join(parts, classes["node"] == parts["id"]).select("component", "digest", "size", "unit")

    def count(batches):
        for group in _groups(pieces(batches, 8192), ["component", "i", "j"]):
            halves = _halves(group)
            if halves is None:
                continue
            low, high, one = halves
            x, size, links = _units(group.column("unit")), group.column("size").to_numpy(), np.zeros(group.num_rows, np.int64)
            for at in range(0, len(low), STRIP):
                rows = low[at : at + STRIP]
                near = (x[rows] @ x[high].T >= threshold) & (rows[:, None] != high[None, :])
                links[rows] += near @ size[high]
                if not one:
                    links[high] += size[rows] @ near
            yield pa.RecordBatch.from_pydict({"digest": pa.array(group.column("digest").to_pylist(), pa.binary()), "links": pa.array(links)})

    busy = parts.groupBy("component").agg(F.count("*").alias("n"))
    units = _in_units(members, "component", "digest", busy).select("component", "i", "j", "block", "digest", "size", "unit")
    return _sorted(units, "component").mapInArrow(released(count), "digest binary, links bigint").groupBy("digest").agg(F.sum("links").alias("links"))


def near_duplicates(df: DataFrame, threshold: float = 0.95, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key, n_links, component_id, kept for each row of df."""
    rows = materialize(normalised(df, vector, key), "units")
    grouped = rows.filter("digest is not null and node is not null").groupBy("digest")
    classes = materialize(grouped.agg(F.min("node").alias("node"), F.count("*").alias("size"), F.first("unit").alias("unit"), F.first("dim").alias("dim")), "vectors")
    met = meeting_edges(classes, classes.count(), threshold)
    edges = materialize(met.filter("sure").select("a", "b").unionByName(confirmed(met.filter("not sure"), classes, threshold)), "edges")
    parts = components(edges)
    counts = link_counts(classes, parts, threshold)
    known = classes.join(counts, "digest", "left").join(parts, classes["node"] == parts["id"], "left")
    known = materialize(known.select("digest", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("__n"), F.coalesce("component", "node").alias("__component")), "known")
    release(met, edges, classes, parts)
    out = rows.select("node", "digest").join(known, "digest", "left")
    # rows without an id are nobody's link
    component = F.when(F.col("node").isNotNull(), F.coalesce("__component", "node"))
    n = F.when(F.col("node").isNotNull(), F.coalesce("__n", F.lit(0))).otherwise(0).cast("long")
    return out.select(F.col("node").alias(key), n.alias("n_links"), component.alias("component_id"), F.col("node").eqNullSafe(component).alias("kept"))
