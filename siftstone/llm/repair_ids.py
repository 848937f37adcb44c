"""Token ids in files, compressed by Re-Pair grammars.

Documents are range-partitioned in ascending order of doc_id, encoded by a byte-level BPE, and cut into shards of
whole documents. In a shard the most frequent neighbouring ids are replaced by nonterminals, round after round:
each round takes frequent pairs that can't overlap each other, and replaces every occurrence (of overlapping ones in a
run of equal ids every second), until no pair is found often enough for its rule to pay.
A shard file holds the ids in use, the rules, the length of each nonterminal's expansion, the compressed sequence and the
documents' ids and lengths, all as numbers of just as many bits as their largest needs. With the expansion lengths any range of tokens
is decoded without the rest. A shard whose ids don't repeat is written as it is, so that no file is larger than its ids.

Files are rows of binary payloads that Spark's writers place in the shared folder, so any store works and a lost
executor costs only its tasks.

Nulls: a null text is empty, so its document has the end id alone; a null doc_id sorts first. Repeated doc_ids are
ordered by a hash of their text and then the text. Empty tables give no files. A document longer than a shard's
target makes a shard of its own. Extra columns, whatever their names, are left out.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftstone.llm.common import is_small, pieces, released, shared_dir
from siftstone.llm.hashing import U, range_hashes, slices
from siftstone.llm.word_table import TRAILING, Encoder, WordTable

MAGIC = b"RPG2"
SHARD_TOKENS = 1 << 18
#: Pairs found less often are left; rounds end when no pair is as frequent. A rule costs two symbols and a length, some 2.7 symbols
#: together, saves one symbol at each place, and widens all; files of text are smallest with rules for pairs found MIN_COUNT times.
MIN_COUNT, RULES_PER_ROUND = 6, 8192
#: Ids are below; nonterminals begin here.
FIRST_FREE = 1 << 16
#: Symbols have 24 bits in memory.
SYMBOL_BITS = np.uint64(24)
SYMBOLS = 1 << 24
SYMBOL = np.uint64(SYMBOLS - 1)
BIN_BITS = 18
BINS = 1 << BIN_BITS
#: Words of the table of a worker.
WORDS_KEPT = 2_000_000
#: New words that are encoded together.
WORDS_TOGETHER = 4096
#: A single space between characters that aren't white space: a pre-token ends before it and one begins with it.
ODD_CUT = re.compile(r"(?<=\S)(?= \S)")


_GAP = np.zeros(256, bool)
_GAP[[10, 32]] = True
_ODD = np.zeros(256, bool)
_ODD[[9, 11, 12, 13, 28, 29, 30, 31]] = True
#: First two bytes of all other white space in UTF-8.
_WIDE = np.zeros(1 << 16, bool)
_WIDE[[0xC285, 0xC2A0, 0xE19A, 0xE280, 0xE281, 0xE380]] = True
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Second bytes in UTF-8 of the letters U+00C0 to U+00FF.
_LATIN = np.zeros(256, bool)
_LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
_TRAILING = np.zeros(256, bool)
_TRAILING[list(TRAILING.encode())] = True


def after_letters(data: np.ndarray) -> np.ndarray:
    """True where one of TRAILING follows a letter (ASCII or U+00C0 to U+00FF): a pre-token of letters ends there."""
    found = np.zeros(len(data), bool)
    at = np.flatnonzero(_TRAILING[data[1:]]) + 1
    found[at] = _LETTER[data[at - 1]] | (_LATIN[data[at - 1]] & (data[np.maximum(at - 2, 0)] == 0xC3))
    return found


class ShardEncoder:
    """Ids of whole batches of texts. Words are found with the space or line feed before them, where pre-tokens begin, and end where
    letters meet the marks after them, so that a word is encoded once whatever mark follows it."""

    def __init__(self, path: str) -> None:
        self.encoder = Encoder(path, lower=False)
        tokenizer, lead = self.encoder.tokenizer, self.encoder.shown_lead
        #: Whether an id's token begins with a space.
        self.begins = np.array([(tokenizer.id_to_token(i) or "").startswith(lead) for i in range(tokenizer.get_vocab_size(with_added_tokens=True))])
        self.table = WordTable(self._words, WORDS_KEPT)
        #: The character that stands for each byte.
        self.shown = dict(enumerate(self.encoder.alphabet))
        # a mark within an added token doesn't end a word
        self.marks_end = not any(after_letters(np.frombuffer(t.content.encode(), np.uint8)).any() for t in tokenizer.get_added_tokens_decoder().values())

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of new words. Those of letters after a space, nearly all, are one pre-token each, which the model encodes. Others after a space
        are encoded together as a text: a pre-token begins at each space, and only its first token with one."""
        encoder = self.encoder
        model, lead, shown = encoder.model, encoder.shown_lead, self.shown
        out: list[bytes | None] = [None] * len(words)
        after = []
        for i, w in enumerate(words):
            if w[0] == " " and len(w) > 1:
                if encoder.plain(body := w[1:]):
                    out[i] = array("H", [t.id for t in model(lead + (body if body.isascii() else body.encode().decode("latin-1").translate(shown)))]).tobytes()
                else:
                    after.append(i)
        for at in range(0, len(after), WORDS_TOGETHER):
            part = after[at : at + WORDS_TOGETHER]
            text = "".join([words[i] for i in part])
            raw = np.array(self.encoder.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2").tobytes()
            starts = np.flatnonzero(self.begins[np.frombuffer(raw, "<u2")])
            if len(starts) == len(part):
                ends = [*(2 * starts[1:]).tolist(), len(raw)]
                for i, s, e in zip(part, (2 * starts).tolist(), ends, strict=True):
                    out[i] = raw[s:e]
        return [self._word(w) if ids is None else ids for w, ids in zip(words, out, strict=True)]

    def _word(self, word: str) -> bytes:
        """A space, line feed or nothing, and a word."""
        if word[:1] == " ":
            return self.encoder.piece(word[1:], " ") if len(word) > 1 else self.encoder.kept(word)
        if word[:1] == "\n":
            return self.encoder.kept("\n") + (self.encoder.piece(word[1:]) if len(word) > 1 else b"")
        return self.encoder.piece(word)

    def batch(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text, as 16-bit bytes; of nulls none."""
        texts = texts.cast(pa.large_string())
        out: list[bytes] = []
        if not len(texts) or texts.buffers()[2] is None:
            return [b""] * len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)
        for at, to in slices(offsets):
            out += self._slice(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        return out

    def _slice(self, data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        if not len(data):
            return [b""] * (len(bounds) - 1)
        gap = _GAP[data]
        # texts with any white space but single spaces and line feeds between words are encoded whole
        odd = _ODD[data]
        wide = np.flatnonzero(_LEAD[data[:-1]])
        odd[wide] |= _WIDE[(data[wide].astype(np.int64) << 8) | data[wide + 1]]
        odd[1:] |= gap[1:] & gap[:-1]
        full = bounds[:-1] < bounds[1:]
        odd[bounds[:-1][full]] |= gap[bounds[:-1][full]]
        odd[bounds[1:][full] - 1] |= gap[bounds[1:][full] - 1]
        strange = np.diff(np.concatenate([[0], np.cumsum(odd)])[bounds]) > 0

        cut = gap
        cut[bounds[:-1][full]] = True
        if self.marks_end:
            cut |= after_letters(data)
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        edges = np.searchsorted(starts, bounds)
        plain = ~np.repeat(strange, np.diff(edges))
        hashes = range_hashes(data, starts, ends) | U(1)
        places = np.full(len(starts), -1, np.int64)
        places[plain] = self.table.places(data, hashes[plain], starts[plain], ends[plain])
        ids, at = self.table.gather(places, edges)
        raw, at = ids.tobytes(), (2 * at).tolist()
        out = [raw[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]
        for i in np.flatnonzero(strange).tolist():
            out[i] = self.odd_text(bytes(data[bounds[i] : bounds[i + 1]]).decode())
        return out

    def odd_text(self, text: str) -> bytes:
        """Ids of a text with other white space: cut before spaces that words follow and that no white space precedes."""
        parts = ODD_CUT.split(text)
        return b"".join([self.encoder.kept(p) if len(p) < 40 else self.encoder.whole(p) for p in parts])


@functools.cache
def words(path: str) -> ShardEncoder:
    return ShardEncoder(path)


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, how often each is there) of sorted values."""
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)])
    return ordered[starts], np.diff(np.append(starts, len(ordered)))


def _frequent(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, exact counts) of the pairs found MIN_COUNT times at least. Keys in light bins can't be among them."""
    if len(keys) >= BINS // 8:
        bins = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BIN_BITS)).astype(np.int64)
        keys = keys[(np.bincount(bins, minlength=BINS) >= MIN_COUNT)[bins]]
    values, counts = _runs(np.sort(keys))
    often = counts >= MIN_COUNT
    return values[often], counts[often]


def _unequal(seq: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys of the pairs that begin at `at`, but for those of equal ids."""
    first, last = seq[at], seq[at + 1]
    other = first != last
    return (first[other].astype(np.uint64) << SYMBOL_BITS) | last[other]


def _beside(hits: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n pairs have an id among the `width` ids at each hit, each once. Hits are sorted and don't overlap."""
    before = hits[np.concatenate([[True], np.diff(hits) > width])[: len(hits)]] - 1
    found = np.concatenate([before, hits] + [hits + 1] * (width == 2))
    return found[(found >= 0) & (found < n)]


def _twins(seq: np.ndarray) -> np.ndarray:
    """Where pairs of equal ids begin; in a run every second one, as the others overlap them."""
    where = np.flatnonzero(seq[1:] == seq[:-1])
    if len(where):
        start = np.concatenate([[0], np.flatnonzero(np.diff(where) > 1) + 1])
        within = np.arange(len(where)) - np.repeat(start, np.diff(np.append(start, len(where))))
        where = where[within % 2 == 0]
    return where


def _chosen(pairs: np.ndarray, counts: np.ndarray, base: int) -> np.ndarray:
    """Sorted frequent pairs that can't overlap each other: one at least, if there are any.

    An id has one role: the first of pairs, the last of pairs, or both ids of its pair with itself. It keeps the role in which it is
    most frequent; at a tie of first and last the one of its most frequent pair.
    """
    order = np.argsort(-counts, kind="stable")[:RULES_PER_ROUND]
    pairs, counts = pairs[order], counts[order]
    a, b = (pairs >> SYMBOL_BITS).astype(np.int64), (pairs & SYMBOL).astype(np.int64)
    twin = a == b
    as_twin = np.zeros(base)
    as_twin[a[twin]] = counts[twin]
    as_first, as_last = np.bincount(a, counts, base) - as_twin, np.bincount(b, counts, base) - as_twin
    both = (as_twin > 0) & (as_twin >= as_first) & (as_twin >= as_last)
    rank = np.arange(len(pairs))
    top_first, top_last = np.full(base, len(pairs)), np.full(base, len(pairs))
    single = np.flatnonzero(~twin)[::-1]
    top_first[a[single]], top_last[b[single]] = rank[single], rank[single]  # the best rank of each id in either role
    first = ~both & ((as_first > as_last) | ((as_first == as_last) & (top_first < top_last)))
    last = ~both & ((as_last > as_first) | ((as_first == as_last) & (top_last < top_first)))
    return np.sort(pairs[np.where(twin, both[a], first[a] & last[b])])


def compress(ids: np.ndarray, first_free: int = FIRST_FREE) -> tuple[np.ndarray, list[np.ndarray]]:
    """(sequence, rules by round as pairs). Nonterminals are numbered from first_free on; a round's rules use earlier symbols only.

    Rounds end when no pair is found MIN_COUNT times. Counts are exact: a round only takes away from the pairs of earlier symbols,
    and all pairs with its new symbols stand beside its hits.
    """
    seq, rounds, size = ids.astype(np.uint32), [], first_free
    if len(seq) < MIN_COUNT:
        return seq, rounds
    pairs, counts = _frequent(_unequal(seq, np.arange(len(seq) - 1)))
    while size < SYMBOLS:
        equal = _twins(seq)
        doubled, n_doubled = _frequent(seq[equal].astype(np.uint64) * np.uint64(SYMBOLS + 1))
        if not len(pairs) + len(doubled):
            break
        best = _chosen(np.concatenate([pairs, doubled]), np.concatenate([counts, n_doubled]), size)[: SYMBOLS - size]
        a, b = best >> SYMBOL_BITS, best & SYMBOL
        is_first, is_last, is_both = np.zeros((3, size), bool)
        is_first[a[a != b]], is_last[b[a != b]], is_both[a[a == b]] = True, True, True
        hits = np.flatnonzero(is_first[seq[:-1]])
        hits = hits[is_last[seq[hits + 1]]]
        if len(doubled):
            hits = np.sort(np.concatenate([hits, equal[is_both[seq[equal]]]]))
        keys = (seq[hits].astype(np.uint64) << SYMBOL_BITS) | seq[hits + 1]
        rule = np.searchsorted(best, keys)
        rule[rule == len(best)] = 0
        taken = best[rule] == keys
        hits, rule = hits[taken], rule[taken]

        gone, n_gone = _runs(np.sort(_unequal(seq, _beside(hits, 2, len(seq) - 1))))
        if len(gone) and len(pairs):
            at = np.searchsorted(gone, pairs)
            at[at == len(gone)] = 0
            counts = counts - np.where(gone[at] == pairs, n_gone[at], 0)

        seq[hits] = (size + rule).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[hits + 1] = False
        seq = seq[keep]
        hits -= np.arange(len(hits))
        fresh, n_fresh = _frequent(_unequal(seq, _beside(hits, 1, len(seq) - 1)))
        often = counts >= MIN_COUNT
        pairs, counts = np.concatenate([pairs[often], fresh]), np.concatenate([counts[often], n_fresh])
        rounds.append(np.stack([a, b], 1).astype(np.uint32))
        size += len(best)
    return seq, rounds


def expansion_lengths(rounds: list[np.ndarray], first_free: int = FIRST_FREE) -> np.ndarray:
    """Tokens that each symbol stands for."""
    lengths = np.ones(first_free + sum(map(len, rounds)), np.uint32)
    at = first_free
    for pairs in rounds:
        lengths[at : at + len(pairs)] = lengths[pairs[:, 0]] + lengths[pairs[:, 1]]
        at += len(pairs)
    return lengths


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size], one after the other."""
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


class Expansions:
    """What each symbol stands for, one after the other: ids themselves, then rules, of which each round's are put together from those before."""

    def __init__(self, rounds: list[np.ndarray], first_free: int = FIRST_FREE) -> None:
        self.sizes = expansion_lengths(rounds, first_free).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.empty(int(self.sizes.sum()), np.uint32)
        self.flat[:first_free] = np.arange(first_free)
        at = first_free
        for pairs in rounds:
            both = pairs.reshape(-1)
            start = self.starts[at]
            made = _gathered(self.flat, self.starts[both], self.sizes[both])
            self.flat[start : start + len(made)] = made
            at += len(pairs)

    def of(self, symbols: np.ndarray) -> np.ndarray:
        return _gathered(self.flat, self.starts[symbols], self.sizes[symbols])


def expand(symbols: np.ndarray, rounds: list[np.ndarray], first_free: int = FIRST_FREE) -> np.ndarray:
    return Expansions(rounds, first_free).of(symbols)


def to_bits(values: np.ndarray, width: int) -> bytes:
    """Unsigned values of `width` bits each, one after the other."""
    out = []
    for at in range(0, len(values), 1 << 16):  # a multiple of 8 values, so that pieces end at bytes
        part = values[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        out.append(np.packbits(np.unpackbits(part, axis=1)[:, 64 - width :]).tobytes())
    return b"".join(out)


def from_bits(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    for at in range(0, n, 1 << 16):
        k = min(n - at, 1 << 16)
        bits = np.zeros((k, 64), np.uint8)
        bits[:, 64 - width :] = np.unpackbits(raw[at * width // 8 : (at + k) * width // 8 + 1], count=k * width).reshape(k, width)
        out[at : at + k] = np.packbits(bits).view(">u8")
    return out


class Writer:
    """Arrays of unsigned numbers, each with its length and width."""

    def __init__(self) -> None:
        self.parts = [MAGIC]

    def put(self, values) -> None:
        values = np.asarray(values, np.uint64)
        width = int(values.max()).bit_length() if len(values) else 0
        self.parts += [struct.pack("<IB", len(values), width), to_bits(values, width) if width else b""]

    def rising(self, values: np.ndarray) -> None:
        """Rising 64-bit values (signed or not) as a first one and steps."""
        values = np.asarray(values).astype(np.uint64)
        self.put(values[:1])
        self.put(np.diff(values))


class Reader:
    def __init__(self, payload: bytes) -> None:
        if payload[:4] != MAGIC:
            raise ValueError("not a shard file")
        self.raw, self.at = np.frombuffer(payload, np.uint8), 4

    def get(self) -> np.ndarray:
        n, width = struct.unpack_from("<IB", self.raw, self.at)
        size = -(-n * width // 8)
        start, self.at = self.at + 5, self.at + 5 + size
        return from_bits(self.raw[start : start + size], n, width) if width else np.zeros(n, np.uint64)

    def rising(self) -> np.ndarray:
        first = self.get()
        return np.cumsum(np.concatenate([first, self.get()]), dtype=np.uint64)


def pack(doc_ids: list[int | None], doc_tokens: list[bytes]) -> bytes:
    """A shard file: documents without an id, ids and lengths of documents, sizes of rounds, ids in use, rules by round (first and
    second symbols), expansion lengths of rules, sequence. In rules and sequence, ids in use are numbered from 0 on and rules after them."""
    ids = np.frombuffer(b"".join(doc_tokens), "<u2")
    seq, rounds = compress(ids)
    pairs = np.concatenate(rounds) if rounds else np.empty((0, 2), np.uint32)
    both = np.concatenate([pairs.reshape(-1), seq])
    used = np.unique(both[both < FIRST_FREE])
    dense = np.where(both < FIRST_FREE, np.searchsorted(used, both), both.astype(np.int64) - FIRST_FREE + len(used))
    n_null = sum(x is None for x in doc_ids)

    def file(rules, sizes, terminals, symbols) -> bytes:
        out = Writer()
        out.put([n_null])
        out.rising(np.array(doc_ids[n_null:], np.int64))
        out.put([len(x) // 2 for x in doc_tokens])
        out.put(sizes)
        out.rising(terminals)
        out.put(rules[0::2])
        out.put(rules[1::2])
        out.put(expansion_lengths(rounds if len(sizes) else [])[FIRST_FREE:])
        out.put(symbols)
        return b"".join(out.parts)

    made = file(dense[: 2 * len(pairs)], [len(x) for x in rounds], used, dense[2 * len(pairs) :])
    return made if len(made) < 2 * len(ids) else min(made, file(both[:0], [], used[:0], ids), key=len)


class Shard:
    """Random access to a shard file."""

    def __init__(self, payload: bytes) -> None:
        file = Reader(payload)
        n_null = int(file.get()[0])
        self.doc_ids = [None] * n_null + file.rising().astype(np.int64).tolist()
        self.n_tokens = file.get().astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.n_tokens)])
        sizes, used = file.get().astype(np.int64), file.rising().astype(np.uint32)
        pairs = np.stack([file.get(), file.get()], 1)
        lengths, seq = file.get(), file.get()
        if len(used):  # without, numbers are ids
            names = np.concatenate([used, np.arange(FIRST_FREE, FIRST_FREE + len(pairs), dtype=np.uint32)])
            pairs, seq = names[pairs.astype(np.int64)], names[seq.astype(np.int64)]
        self.rounds = np.split(pairs.astype(np.uint32), np.cumsum(sizes)[:-1]) if len(sizes) else []
        self.expansions = Expansions(self.rounds)
        self.lengths = np.concatenate([np.ones(FIRST_FREE, np.uint32), lengths.astype(np.uint32)])
        self.seq = seq.astype(np.uint32)
        self.ends = np.cumsum(self.lengths[self.seq], dtype=np.int64)

    def all_tokens(self) -> np.ndarray:
        return self.expansions.of(self.seq)

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Tokens start..end of the shard, expanding only the symbols that cover them, found by the lengths of expansions."""
        if end <= start:
            return np.empty(0, np.uint32)
        i, j = int(np.searchsorted(self.ends, start, "right")), int(np.searchsorted(self.ends, end, "left")) + 1
        skipped = start - (int(self.ends[i - 1]) if i else 0)
        return self.expansions.of(self.seq[i:j])[skipped : skipped + end - start]

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))


def write_shards(docs: DataFrame, path: str, to: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write shard files of docs (doc_id, text) under `to`. path: the tokenizer's file, on every machine.

    A hot doc_id is dealt over several ranges by the hash of its texts. Rows of the table: part and seq give the
    order of shards; n_docs, n_tokens, payload.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = slim.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").withColumn("part", F.spark_partition_id())
    end = np.array([end_id], "<u2").tobytes()

    def run(batches):
        table, ids, tokens, size, seq, part = words(path), [], [], 0, 0, None

        def shard():
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([size], pa.int64()), "payload": pa.array([pack(ids, tokens)], pa.binary())})

        for batch in pieces(batches):
            for doc_id, own, part in zip(batch.column("doc_id").to_pylist(), table.batch(batch.column("text")), batch.column("part").to_pylist(), strict=True):
                own += end
                ids.append(doc_id)
                tokens.append(own)
                size += len(own) // 2
                if size >= shard_tokens:
                    yield shard()
                    ids, tokens, size, seq = [], [], 0, seq + 1
        if ids:
            yield shard()

    ordered.mapInArrow(released(run), "part int, seq int, n_docs bigint, n_tokens bigint, payload binary").write.parquet(to)


def read_shards(spark, path: str) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, decoded from the files.

    Starts of shards come from sums by part (as many as write tasks) and running sums within parts.
    """
    files = spark.read.schema("part int, seq int, n_docs bigint, n_tokens bigint, payload binary").parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = files.select("part", "seq", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).alias("within"))
    bases = within.join(before, "part").select("part", "seq", (F.col("before") + F.col("within")).alias("base"))
    bases = F.broadcast(bases) if is_small(files.select("part")) else bases

    def run(batches):
        for batch in pieces(batches, 8):
            for base, payload in zip(batch.column("base").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                shard = Shard(payload)
                whole = shard.all_tokens().astype("<u4")
                crcs = [zlib.crc32(whole[s:e].tobytes()) for s, e in zip(shard.starts[:-1], shard.starts[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(shard.doc_ids, pa.int64()), "start": pa.array(base + shard.starts[:-1], pa.int64()), "n_tokens": pa.array(shard.n_tokens, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    return files.join(bases, ["part", "seq"]).select("base", "payload").mapInArrow(released(run), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, path: str, label: str = "tokens") -> DataFrame:
    import uuid

    to = f"{shared_dir(docs.sparkSession)}/{label}-{uuid.uuid4().hex[:12]}"
    write_shards(docs, path, to)
    return read_shards(docs.sparkSession, to)
