"""Words of whole batches of texts, found by vectorised hashes; only new ones are encoded.

A 64-bit hash stands for a word. The table is bounded: when full it is emptied (generation counts that), and one batch with more
distinct words than it holds enlarges it for that batch.
"""

from __future__ import annotations

import functools
from array import array

import numpy as np

from siftstone.llm.hashing import U

STEMS_KEPT = 60_000
#: Runs of these after a letter are pre-tokens of their own.
TRAILING = ".,!?;:%*&#$"


@functools.cache
def load(path: str):
    """The tokenizer of a file, without truncation and padding; one for each worker."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16:
        raise ValueError("ids must fit into 16 bits")
    return tokenizer


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 itself, others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def stem_shown(stem: str, alphabet: list[str]) -> str:
    """Letters as the vocabulary shows their bytes; ASCII ones show themselves."""
    return stem if stem.isascii() else "".join([alphabet[b] for b in stem.encode()])


class Encoder:
    """Ids (16-bit bytes) of short pieces. Letters are one pre-token, so the model encodes them without the pipeline around it.

    lower: the vocabulary is of lower-case words; letters below U+0250 are then normalised by lower() alone, but for U+0130.
    """

    def __init__(self, path: str, lower: bool) -> None:
        self.tokenizer, self.lower = load(path), lower
        self.model, self.alphabet = self.tokenizer.model.tokenize, byte_alphabet()
        self.shown_lead = self.alphabet[0x20]
        self.stems: dict[str, bytes] = {}
        self.short: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def kept(self, text: str) -> bytes:
        found = self.short.get(text)
        if found is None:
            if len(self.short) >= 20_000:
                self.short.clear()
            self.short[text] = found = self.whole(text)
        return found

    def plain(self, stem: str) -> bool:
        return stem.isalpha() and (stem.isascii() or (max(stem) < "ɐ" and not (self.lower and "İ" in stem)))

    def stem(self, stem: str, lead: str) -> bytes:
        """Ids of letters after a lead (a space or nothing)."""
        key = lead + stem
        found = self.stems.get(key)
        if found is None:
            if len(self.stems) >= STEMS_KEPT:
                self.stems.clear()
            text = (lead + stem).lower() if self.lower else lead + stem
            shown = (self.shown_lead if lead else "") + stem_shown(text[len(lead):], self.alphabet)
            self.stems[key] = found = array("H", [t.id for t in self.model(shown)]).tobytes()
        return found

    def piece(self, word: str, lead: str = "") -> bytes:
        """Ids of a word without white space after its lead."""
        body = word.rstrip(TRAILING)
        if not self.plain(body):
            return self.kept(lead + word)
        own = self.stem(body, lead)
        return own if len(body) == len(word) else own + self.kept(word[len(body):])


class WordTable:
    def __init__(self, encode, words: int) -> None:
        """encode: list of words (as they stand in the text) -> list of their ids as 16-bit bytes. words: how many are kept."""
        self.encode, self.words, self.generation = encode, words, 0
        self.reset(words)

    def reset(self, words: int) -> None:
        self.generation += 1
        self.most, self.bits = words, max(10, int(words * 1.6).bit_length())
        self.keys = np.zeros(1 << self.bits, U)
        self.place = np.zeros(1 << self.bits, np.int32)
        self.flat, self.starts, self.n = np.empty(4 * words, np.uint16), np.zeros(words + 1, np.int64), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word, -1 for new ones. Hashes aren't 0, which marks an empty slot."""
        slot = (hashes >> U(64 - self.bits)).astype(np.int64)
        held = self.keys[slot]
        out = np.where(held == hashes, self.place[slot], -1)
        left = np.flatnonzero((out < 0) & (held != 0))
        step = 0
        while len(left):
            step += 1
            at = (slot[left] + step) & ((1 << self.bits) - 1)
            held = self.keys[at]
            hit = held == hashes[left]
            out[left[hit]] = self.place[at[hit]]
            left = left[~hit & (held != 0)]
        return out

    def add(self, hashes: np.ndarray, ids: list[bytes]) -> None:
        """Put in distinct new words."""
        sizes = np.array([len(x) // 2 for x in ids], np.int64)
        used, total = int(self.starts[self.n]), int(sizes.sum())
        if used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[:used], np.empty(max(total, used), np.uint16)])
        self.flat[used : used + total] = np.frombuffer(b"".join(ids), "<u2")
        self.starts[self.n + 1 : self.n + len(ids) + 1] = used + np.cumsum(sizes)
        number = np.arange(self.n, self.n + len(ids), dtype=np.int32)
        self.n += len(ids)
        slot, left = (hashes >> U(64 - self.bits)).astype(np.int64), np.arange(len(hashes))
        while len(left):
            at = slot[left] & ((1 << self.bits) - 1)
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[left[free]]  # of several for one slot the last stays
            put = free & (self.keys[at] == hashes[left])
            self.place[at[put]] = number[left[put]]
            left = left[~put]
            slot[left] += 1

    def places(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Place of each word data[s:e]; new words are encoded and put in. Earlier places are void if the generation changed."""
        out = self.find(hashes)
        new = np.flatnonzero(out < 0)
        if not len(new):
            return out
        unique, index = np.unique(hashes[new], return_index=True)
        if self.n + len(unique) > self.most:
            self.reset(max(self.words, 2 * len(np.unique(hashes))))
            return self.places(data, hashes, starts, ends)
        raw = data.tobytes()
        first, last = starts[new[index]].tolist(), ends[new[index]].tolist()
        self.add(unique, self.encode([raw[s:e].decode() for s, e in zip(first, last, strict=True)]))
        return self.find(hashes)

    def gather(self, places: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after the other, where in them each of edges, places between words, lies). Negative places have no ids."""
        known = np.maximum(places, 0)
        begin = self.starts[known]
        sizes = np.where(places < 0, 0, self.starts[known + 1] - begin)
        total = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[np.repeat(begin - total[:-1], sizes) + np.arange(total[-1])], total[edges]
