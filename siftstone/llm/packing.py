"""Packing of documents into sequences of a fixed number of tokens, by best fit and local search with exchanges.

Documents are encoded where they are read; only the lengths of their pieces go on. A document longer than a sequence is cut into
pieces of a sequence each, of which the first may be shorter; pieces of full length are sequences at once. The others are dealt, by a hash, to
groups of bounded size, each packed on its own: best fit, longest pieces first, then a local search among the bins that
have room. A step exchanges pieces between two of them (a piece moves, or changes places with a shorter one; two for one, or one for two) so that the sum
of the squared fills grows; it looks for the step that fills a bin most, emptying the emptiest bins first, until one is empty or no step is left. A
group ends when the room in its bins couldn't take the emptiest of them. Bins with room are then dealt anew, whole, and searched in
further rounds, for as long as that saves sequences.

Nulls: a null text is empty, so its document is the end id alone; a null doc_id is packed like any other. Rows with the same doc_id are documents of their
own. Ties of lengths go by the row's number, which is written once, so that reruns of tasks agree. Empty tables give no rows. Other columns are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import materialize, pieces, released
from siftstone.llm.repair_ids import words

SEQUENCE_TOKENS = 2048
#: Pieces of a group. Groups are that large on average; a task holds one at a time.
GROUP_PIECES = 1 << 15
#: Exchanges (and bins given up) of a group's search in a round.
SEARCH_STEPS = 10_000
#: Rounds end when one saves less than this part of the sequences with room.
LEAST_GAIN = 0.001
#: Rows for which a table of pieces has a file.
FILE_PIECES = 1 << 14


def cut_points(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones but for the first, which has the rest."""
    if n <= most:
        return [(0, n)]
    first = n % most or most
    return [(0, first), *((at, most) for at in range(first, n, most))]


def encoded_pieces(docs: DataFrame, path: str, most: int = SEQUENCE_TOKENS, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (16-bit little-endian bytes), of every document's ids and the end id."""
    end = np.array([end_id], "<u2").tobytes()
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids

    def run(batches):
        table = words(path)
        for batch in pieces(batches):
            rows = []
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), table.batch(batch.column("text")), strict=True):
                own += end
                wide = np.frombuffer(own, "<u2").astype("<u4").tobytes()
                for k, (at, n) in enumerate(cut_points(len(own) // 2, most)):
                    rows.append((doc_id, k, at, n, zlib.crc32(wide[4 * at : 4 * (at + n)]), own[2 * at : 2 * (at + n)]))
            doc_ids, numbers, starts, lengths, crcs, ids = zip(*rows, strict=True) if rows else ((),) * 6
            made = {"doc_id": pa.array(doc_ids, pa.int64()), "piece": pa.array(numbers, pa.int32()), "start": pa.array(starts, pa.int64()), "length": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())}
            yield pa.RecordBatch.from_pydict(made | ({"ids": pa.array(ids, pa.binary())} if with_ids else {}))

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(released(run), schema)


def best_fit(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Bins (lists of places in lengths) by best fit, longest first: each into the bin with the least room that has enough."""
    with_room: list[list[int]] = [[] for _ in range(most + 1)]
    some = 0  # bit r: some bin has room r
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = some >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                some &= ~(1 << room)
        else:
            room, b = most, len(bins)
            bins.append([])
        bins[b].append(i)
        left = room - n
        with_room[left].append(b)
        some |= 1 << left
    return bins


def least_bins(sizes: np.ndarray, most: int) -> int:
    """A number of bins that no packing can do without: for each k, pieces over half a bin have bins of their own, in which only those
    of at most most - k leave room for pieces of k or more."""
    if not len(sizes):
        return 0
    counts = np.bincount(sizes, minlength=most + 1)
    total = np.cumsum(counts), np.cumsum(counts * np.arange(most + 1))
    half, k = most // 2, np.arange(most // 2 + 1)
    alone = int(total[0][most] - total[0][half])
    below = np.maximum(k - 1, 0)
    small = np.where(k > 0, total[1][half] - total[1][below], total[1][half])
    shared, shared_sum = total[0][most - k] - total[0][half], total[1][most - k] - total[1][half]
    return int((alone + np.maximum(0, -(-(small - (shared * most - shared_sum)) // most))).max())


class Search:
    """Local search over bins with room. lengths: of all pieces; bins: lists of places in it."""

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], most: int) -> None:
        self.lengths, self.most = lengths, most
        self.full = [b for b in bins if int(lengths[b].sum()) == most]
        loose = [b for b in bins if int(lengths[b].sum()) < most]
        self.fill = np.array([int(lengths[b].sum()) for b in loose], np.int64)
        self.places = np.array([i for b in loose for i in b], np.int64)
        self.size = lengths[self.places].astype(np.int64)
        self.bin = np.repeat(np.arange(len(loose)), [len(b) for b in loose])

    def run(self, steps: int = SEARCH_STEPS) -> list[list[int]]:
        """Bins after the search, which ends when as few are left as their pieces need, no exchange is left, or after so many exchanges."""
        given_up, needed = np.zeros(len(self.fill), bool), least_bins(self.size, self.most)
        while steps > 0 and int((self.fill > 0).sum()) > needed:
            open_ = np.flatnonzero((self.fill > 0) & ~given_up)
            if not len(open_):
                break
            donor = int(open_[np.argmin(self.fill[open_])])
            while self.fill[donor] and steps > 0 and self._step(donor):
                steps -= 1
            given_up[donor] = self.fill[donor] > 0
            steps -= 1
        order = np.argsort(self.bin, kind="stable")
        found = np.split(self.places[order], np.flatnonzero(np.diff(self.bin[order])) + 1) if len(order) else []
        return self.full + [b.tolist() for b in found]

    def _step(self, donor: int) -> bool:
        """The exchange between the donor and a fuller bin that moves most tokens out of the donor; False if there is none.

        A net move of d > 0 tokens into a bin that is as full at least, and has room d, makes the sum of squares larger.
        """
        own = np.flatnonzero(self.bin == donor)
        room = np.where((self.fill >= self.fill[donor]) & (self.fill > 0), self.most - self.fill, -1)
        room[donor] = -1
        sizes = self.size[own]
        # a move: the longest own piece that fits anywhere, into the bin with the least room for it
        for k in np.argsort(-sizes, kind="stable"):
            fits = np.flatnonzero(room >= sizes[k])
            if len(fits):
                self._move(own[[k]], int(fits[np.argmin(room[fits])]))
                return True
        others = np.flatnonzero((self.bin != donor) & (room[self.bin] > 0))
        if not len(others):
            return False
        there, theirs = room[self.bin[others]], self.size[others]
        best = (0, None, None)
        # one own piece, or two, for one of theirs
        for mine in self._ones_and_twos(own):
            gain = int(self.size[mine].sum()) - theirs
            gain[gain > there] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (int(gain[k]), mine, others[[k]])
        # one own piece for two of theirs: the two shortest of a bin, and neighbours in size
        if best[0] < int(there.max()):
            first, second, room_of = self._their_twos(others, room)
            for k in range(len(own)) if len(first) else ():
                gain = sizes[k] - self.size[first] - self.size[second]
                gain[gain > room_of] = 0
                j = int(np.argmax(gain))
                if gain[j] > best[0]:
                    best = (int(gain[j]), own[[k]], np.array([first[j], second[j]]))
        if best[1] is None:
            return False
        target = int(self.bin[best[2][0]])
        self._move(best[1], target)
        self._move(best[2], donor)
        return True

    def _ones_and_twos(self, own: np.ndarray):
        """Own pieces and pairs of them, of each size or pair of sizes one."""
        sizes, index, counts = np.unique(self.size[own], return_index=True, return_counts=True)
        for k, i in enumerate(index):
            yield own[[i]]
            if counts[k] > 1:
                yield own[self.size[own] == sizes[k]][:2]
            for j in index[k + 1 :]:
                yield own[[i, j]]

    def _their_twos(self, others: np.ndarray, room: np.ndarray):
        """Pairs of pieces that are neighbours by size in one bin."""
        order = others[np.lexsort((self.size[others], self.bin[others]))]
        same = self.bin[order[1:]] == self.bin[order[:-1]]
        first, second = order[:-1][same], order[1:][same]
        return first, second, room[self.bin[first]]

    def _move(self, which: np.ndarray, to: int) -> None:
        total = int(self.size[which].sum())
        self.fill[self.bin[which[0]]] -= total
        self.fill[to] += total
        self.bin[which] = to


def pack_group(frame: pd.DataFrame, most: int) -> pd.DataFrame:
    """Rows of a group (row, bin or null, length) with their bin, the row of its first piece, and whether it has room left. Longer pieces stand first."""
    frame = frame.sort_values("row", ignore_index=True)
    lengths = frame["length"].to_numpy()
    bins = best_fit(lengths, most) if frame["bin"].isna().any() else [x.tolist() for x in frame.groupby("bin").indices.values()]
    bins = Search(lengths, bins, most).run()
    rows = frame["row"].to_numpy()
    for b in bins:
        b.sort(key=lambda i: (-lengths[i], i))
    order = np.array([i for b in bins for i in b], np.int64)
    n = np.array([len(b) for b in bins], np.int64)
    at = np.cumsum(lengths[order]) - lengths[order]
    first = np.repeat(np.cumsum(n) - n, n)
    out = frame.iloc[order].reset_index(drop=True)
    out["bin"], out["offset"] = rows[order][first], at - at[first]
    out["has_room"] = np.repeat([int(lengths[b].sum()) < most for b in bins], n)
    return out


def _files(rows: int) -> int:
    return max(1, -(-rows // FILE_PIECES))


def pack(rows: DataFrame, most: int = SEQUENCE_TOKENS, group_pieces: int = GROUP_PIECES, about: int | None = None) -> DataFrame:
    """rows (with a column length, 1..most, and whatever else) with sequence_id and offset, in as few sequences of at most `most` tokens as the search finds.

    about: how many rows there are, roughly, if they are narrow. They are then shuffled into as few files as that needs, which other tasks write than
    those that encode texts: for each file on a local disk the JVM starts processes, and while one starts it counts as the JVM's memory again.
    """
    others = [c for c in rows.columns if c != "row"]
    named = rows.select(*others).withColumn("row", F.monotonically_increasing_id())
    numbered = materialize(named if about is None else named.repartition("row").coalesce(_files(about)), "pieces")
    schema = "row bigint, bin bigint, length bigint, offset bigint, has_room boolean"
    done = [numbered.filter(F.col("length") == most).select("row", F.col("row").alias("bin"), F.lit(0).cast("long").alias("offset"))]
    left = numbered.filter(F.col("length") < most).select("row", F.lit(None).cast("long").alias("bin"), F.col("length").cast("long").alias("length"))
    before, turn = None, 0
    while True:
        n = left.count()
        if not n:
            break
        groups = -(-n // group_pieces)
        key = F.coalesce("bin", "row")  # a bin stays together
        dealt = left.withColumn("group", F.pmod(F.xxhash64(key, F.lit(turn)), F.lit(groups)))
        packed = materialize(dealt.groupBy("group").applyInPandas(lambda frame: pack_group(frame.drop(columns="group"), most), schema), "packed")
        now = packed.filter("has_room").agg(F.count_distinct("bin")).first()[0]
        gained = before is None or before - now >= LEAST_GAIN * before
        if groups == 1 or not gained:
            done.append(packed.select("row", "bin", "offset"))
            break
        done.append(packed.filter("NOT has_room").select("row", "bin", "offset"))
        left, before, turn = packed.filter("has_room").select("row", "bin", "length"), now, turn + 1
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    return numbered.join(placed.withColumnRenamed("bin", "sequence_id"), "row").drop("row").coalesce(_files(numbered.count()))


def pack_documents(docs: DataFrame, path: str, most: int = SEQUENCE_TOKENS, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. path: the tokenizer's file, on every machine."""
    return pack(encoded_pieces(docs, path, most, end_id), most, about=docs.count())


def sequences(docs: DataFrame, path: str, most: int = SEQUENCE_TOKENS, end_id: int = 0) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens, doc_ids, starts (of the documents' pieces in the sequence) and ids (16-bit little-endian bytes)."""
    packed = pack(encoded_pieces(docs, path, most, end_id, with_ids=True), most)
    piece = F.struct("offset", "doc_id", "piece", "ids")
    grouped = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(piece)).alias("p"))  # at most `most` pieces
    ids = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x.ids)), ""))
    return grouped.select("sequence_id", "n_tokens", F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts"), ids.alias("ids"))
