"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last 16 bytes cuts texts where its high bits are zero, within words as well as between them, so that passages
that documents share are cut alike. A chunk is encoded whole, as if it were a text, the first time that a worker meets its content; each
further one, in any document and task of the worker, takes over the ids and isn't even split into words.

Where two chunks of a text meet, the ids may be wrong: a word goes on in the next chunk. The join is repaired by encoding a
window again. It begins with the loose ends of both chunks, from their white space next to the join, and grows by whole chunks
until it has white space at both ends. White space is a hard boundary of the tokenizer (no normaliser rule, pre-token or merge reaches
across it), so from there on the chunks' ids agree exactly with those of the whole text; in the window the new ids stand.

The memos of words and chunks are bounded (the oldest chunks go); texts are taken whole, whatever their length.

Nulls: a null text is an empty one, with no ids. Repeated rows give repeated results. Special tokens in a text are
recognised, as the library does by default. Empty tables give empty results. Other columns pass through; columns with the names of
the results are replaced.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftstone.llm.common import pieces, released
from siftstone.llm.hashing import U, range_hashes, slices
from siftstone.llm.word_table import Encoder, WordTable

WINDOW = 16
#: Mean bytes of a chunk, a power of two.
CHUNK = 256
CHUNKS_KEPT, WORDS_KEPT = 50_000, 600_000
_GAP = np.zeros(256, bool)
_GAP[[10, 32]] = True


def _gear() -> np.ndarray:
    return np.random.default_rng(16).integers(0, 2**32, 256, dtype=np.uint32)


GEAR = _gear()


def cut_flags(data: np.ndarray) -> np.ndarray:
    """True at i where a chunk may end after byte i: a hash of bytes i-15..i has zero low bits, and a character ends."""
    h = GEAR[data]
    span = 1
    while span < WINDOW:
        shifted = np.zeros_like(h)
        shifted[span:] = h[:-span]
        # an odd multiplier to the power of the span makes it a polynomial over the window
        h = h + shifted * np.uint32(pow(0x9E3779B1, span, 2**32))
        span *= 2
    flags = (h >> np.uint32(32 - CHUNK.bit_length() + 1)) == 0
    flags[:-1] &= (data[1:] & 0xC0) != 0x80
    return flags


class Chunk(NamedTuple):
    """Ids of a chunk (16-bit bytes), and bytes and bytes of ids of its loose ends: what stands before its first and after its last white space.

    A chunk without white space is loose as a whole, at both ends."""

    ids: bytes
    head: int
    head_ids: int
    tail: int
    tail_ids: int


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of texts that end at bounds[1:] in data."""
    gap = _GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    starts = np.flatnonzero(~gap & (np.concatenate([[True], gap[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(~gap & (np.concatenate([gap[1:], [True]]) | edge[1:])) + 1
    return starts, ends


class ChunkCodec:
    """reuse: whether chunks are taken over; without it all are encoded. counts: bytes and bytes encoded in chunks, chunks, joins and repairs."""

    def __init__(self, path: str, reuse: bool = True) -> None:
        encoder = Encoder(path, lower=True)
        self.table = WordTable(lambda words: [encoder.piece(w) for w in words], WORDS_KEPT)
        vocabulary = encoder.tokenizer.get_vocab_size(with_added_tokens=True)
        self.tokens = [encoder.tokenizer.id_to_token(i) or "" for i in range(vocabulary)]
        self.reuse, self.counts = reuse, Counter()
        self.chunks: dict[int, Chunk] = {}

    def decode(self, ids: np.ndarray) -> str:
        """As the library without a decoder: tokens joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))

    def batch(self, texts: pa.Array):
        """Yields the ids (16-bit) of each text of an Arrow array; nulls as empty texts."""
        texts = texts.cast(pa.large_string())
        if not len(texts) or texts.buffers()[2] is None:
            yield from [np.empty(0, np.uint16)] * len(texts)
            return
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)
        for at, to in slices(offsets):
            for ids in self.encode(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]):
                yield np.frombuffer(ids, np.uint16)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Ids (16-bit bytes) of UTF-8 texts that end at bounds[1:] in data."""
        if not len(data):
            return [b""] * (len(bounds) - 1)
        # chunks end at cuts, not near a text's start, where the window holds another text, and at texts' ends
        cuts = np.flatnonzero(cut_flags(data)) + 1
        text = np.searchsorted(bounds, cuts, "right") - 1
        cuts = cuts[(cuts < len(data)) & (cuts - bounds[text] >= WINDOW)]
        low = np.unique(np.concatenate([bounds[:-1][bounds[:-1] < bounds[1:]], cuts]))
        high = np.append(low[1:], len(data))
        keys = range_hashes(data, low, high).tolist()
        chunks = self._chunks(data, low, high, keys)

        first = np.searchsorted(low, bounds).tolist()
        parts, windows, stale = self._joined(chunks, low.tolist(), high.tolist(), first)
        fresh = self._again(data, windows)
        self.counts.update(joins=len(windows), repaired=sum(a != b for a, b in zip(fresh, stale, strict=True)))
        return [b"".join([fresh[p] if type(p) is int else p for p in own]) for own in parts]

    def _chunks(self, data: np.ndarray, low: np.ndarray, high: np.ndarray, keys: list[int]) -> list[Chunk]:
        """The chunk of each range, of which those whose content is new are encoded."""
        known = self.chunks if self.reuse else {}
        place = {}
        for c, key in enumerate(keys):
            if key not in known:
                place.setdefault(key if self.reuse else c, c)
        new = np.fromiter(place.values(), np.int64, len(place))
        sizes = high - low
        self.counts.update(chunks=len(keys), bytes=len(data), bytes_encoded=int(sizes[new].sum()))
        made = self._encoded(data, low[new], high[new]) if len(new) else []
        if not self.reuse:
            return made
        known.update(zip(place, made, strict=True))
        found = [known[key] for key in keys]
        if len(known) > CHUNKS_KEPT:
            for key in list(known)[: len(known) - CHUNKS_KEPT // 2]:
                del known[key]
        return found

    def _encoded(self, data: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[Chunk]:
        """Each range encoded as a text of its own."""
        sizes = high - low
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        if bounds[-1] < len(data):
            data = data[np.repeat(low - bounds[:-1], sizes) + np.arange(bounds[-1])]
        starts, ends = word_bounds(data, bounds)
        places = self.table.places(data, range_hashes(data, starts, ends) | U(1), starts, ends)
        edges = np.searchsorted(starts, bounds)
        ids, at = self.table.gather(places, edges)
        n_ids = self.table.starts[places + 1] - self.table.starts[places]
        some = edges[:-1] < edges[1:]
        one, last = np.minimum(edges[:-1], max(len(starts) - 1, 0)), np.maximum(edges[1:] - 1, 0)
        if not len(starts):
            return [Chunk(b"", 0, 0, 0, 0)] * len(low)
        has_head, has_tail = some & (starts[one] == bounds[:-1]), some & (ends[last] == bounds[1:])
        head, head_ids = np.where(has_head, ends[one] - bounds[:-1], 0), np.where(has_head, 2 * n_ids[one], 0)
        tail, tail_ids = np.where(has_tail, bounds[1:] - starts[last], 0), np.where(has_tail, 2 * n_ids[last], 0)
        raw, at = ids.tobytes(), (2 * at).tolist()
        return [Chunk(raw[s:e], *x) for s, e, *x in zip(at[:-1], at[1:], head.tolist(), head_ids.tolist(), tail.tolist(), tail_ids.tolist(), strict=True)]

    def _joined(self, chunks: list[Chunk], low: list[int], high: list[int], first: list[int]) -> tuple[list[list], list[tuple[int, int]], list[bytes]]:
        """(parts of each text: ids, or the number of a window; windows as (start, end); the chunks' ids of each window)."""
        parts, windows, stale = [], [], []
        for f, to in zip(first[:-1], first[1:], strict=True):
            own, start, held = [], None, []
            for c in range(f, to):
                ids, head, head_ids, tail, tail_ids = chunks[c]
                goes_on = c + 1 < to and tail and chunks[c + 1].head
                begin, whole = 0, head == high[c] - low[c]
                if start is not None:
                    held.append(ids[:head_ids])
                    if whole and goes_on:
                        continue  # no white space in all of this chunk: the window grows
                    own.append(len(windows))
                    windows.append((start, low[c] + head))
                    stale.append(b"".join(held))
                    begin, start, held = head_ids, None, []
                    if whole:
                        continue
                if goes_on:
                    start, held = high[c] - tail, [ids[len(ids) - tail_ids :]]
                    own.append(ids[begin : len(ids) - tail_ids])
                else:
                    own.append(ids[begin:])
            parts.append(own)
        return parts, windows, stale

    def _again(self, data: np.ndarray, windows: list[tuple[int, int]]) -> list[bytes]:
        if not windows:
            return []
        starts, ends = np.array(windows).T
        places = self.table.places(data, range_hashes(data, starts, ends) | U(1), starts, ends)
        ids, at = self.table.gather(places, np.arange(len(windows) + 1))
        raw, at = ids.tobytes(), (2 * at).tolist()
        return [raw[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]


@functools.lru_cache(maxsize=2)
def codec(path: str) -> ChunkCodec:
    """One for each worker, so that chunks are reused in all of its tasks."""
    return ChunkCodec(path)


def encode_texts(df: DataFrame, path: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """df with n_tokens, ids (array<int>, if with_ids), ids_sha256 and decoded_sha256, replacing columns of these names.

    path: the tokenizer's file, on every machine.
    """
    added = ["n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"]
    kept = df.select(*[c for c in df.columns if c not in added or c == text])
    out = [c for c in kept.columns if c not in added]

    def run(batches):
        own = codec(path)
        for batch in pieces(batches):
            lengths, ids, shas, decoded_shas = [], [], [], []
            for found in own.batch(batch.column(text)):
                lengths.append(len(found))
                if with_ids:
                    ids.append(found)
                shas.append(hashlib.sha256(found.astype("<u4").tobytes()).hexdigest())
                decoded_shas.append(hashlib.sha256(own.decode(found).encode()).hexdigest())
            lengths = np.array(lengths, np.int64)
            columns = [batch.column(c) for c in out] + [pa.array(lengths)]
            if with_ids:
                starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate([*ids, np.empty(0, np.uint16)]).astype(np.int32))))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(shas, pa.string()), pa.array(decoded_shas, pa.string())], names=[*out, *added])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in out]
    schema = ", ".join([*fields, "n_tokens bigint", *["ids array<int>"] * with_ids, "ids_sha256 string", "decoded_sha256 string"])
    return kept.mapInArrow(released(run), schema)
