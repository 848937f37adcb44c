"""Spelling variants: words of a vocabulary that differ by one letter, and the common word that a rare one stands for.

The vocabulary's minimised acceptor is composed with a transducer of exactly one edit and with the acceptor again; the
composition's accepted pairs are the near words. It is never built whole. Each pair has a first position at which its
words differ, and its parts by initial state share what stands before or after that position: words that begin with
the same letters are one part (the pairs that differ later), words that end alike another (the pairs that differ
within these first letters). A part with too many words is split by length, then by halves of the window in which its
pairs may differ, until the window is a single position; a part is then no larger than the alphabet lets it be. Each pair is accepted in
one part only, and no part is cut short.

Nulls: a null text has no words; a null doc_id counts as an empty one in the planted typos. Repeated rows count as often as they stand.
Ties of frequency go to the word that is first in code-point order. Empty tables give no rows; other columns aren't read.
Texts of any length are read whole; a worker holds the counts of a bounded number of words at a time.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import is_small, materialize, pieces, release, released

LETTERS = "A-Za-zÀ-ÿ"
#: Letters that the words of a part have in common at first: before the differing position, or after it.
HEAD = 3
#: Words of a part that one acceptor holds; larger parts are split.
PART_WORDS = 4000
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000
#: A form is so many times as frequent as its word.
FORM_RATIO = 10
PART = ("l", "a", "z", "h", "key")
NO_BOUND = 1 << 30
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def word_counts(docs: DataFrame, min_length: int = 7, min_count: int = 2, typo_every: int | None = None) -> DataFrame:
    """word, n: runs of letters with A-Z lowered, of min_length code points and min_count occurrences at least.

    typo_every plants typos, for trials: where it divides h, the crc32 of `<doc_id>:<word>`, the code point at h modulo the length is left out.
    """
    found = re.compile(f"[{LETTERS}]{{{min_length},}}")  # a shorter run has no place in the result, with a letter less neither

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})

    def run(batches):
        counts: Counter = Counter()
        for batch in pieces(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = Counter(found.findall((text or "").translate(_LOWER)))
                if typo_every:
                    own = _with_typos(own, "" if doc_id is None else doc_id, typo_every, min_length)
                counts.update(own)
            if len(counts) > COUNTED:
                yield rows(counts)
                counts = Counter()
        yield rows(counts)

    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(released(run), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _with_typos(own: Counter, doc_id: str, every: int, min_length: int) -> Counter:
    start, out = zlib.crc32(f"{doc_id}:".encode()), Counter()
    for word, n in own.items():
        h = zlib.crc32(word.encode(), start)
        if h % every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < min_length:
                continue
        out[word] += n
    return out


class Acceptor:
    """The minimal deterministic acceptor of sorted distinct words. A state is (whether it accepts, its arcs as (letter, state)); equal states are one."""

    def __init__(self, words: list[str]) -> None:
        register: dict = {}
        path: list[list] = [[False, []]]  # states of the last word, whose arcs may still grow
        last = ""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                accepts, arcs = path.pop()
                path[-1][1].append((last[len(path) - 1], register.setdefault((accepts, tuple(arcs)), len(register))))

        for word in words:
            same = 0
            for x, y in zip(last, word, strict=False):
                if x != y:
                    break
                same += 1
            close(same)
            path.extend([False, []] for _ in range(len(word) - same))
            path[-1][0] = True
            last = word
        close(0)
        self.root = register.setdefault((path[0][0], tuple(path[0][1])), len(register))
        self.states = list(register)

    def endings(self, state: int) -> Iterator[str]:
        accepts, arcs = self.states[state]
        if accepts:
            yield ""
        for letter, then in arcs:
            for rest in self.endings(then):
                yield letter + rest


class OneEdit:
    """The acceptor composed with a transducer of one edit and the acceptor: pairs of words that differ by one letter put in, left out or replaced.

    Before the edit both sides are in one state; after it in two, from which the same endings must be accepted. An edit stands at the first
    differing position, so that each pair has one way through.
    """

    def __init__(self, acceptor: Acceptor) -> None:
        self.acceptor, self.states = acceptor, acceptor.states
        self.after: dict = {}
        self.edits: dict[int, list] = {}

    def both(self, p: int, q: int):
        """The state (p, q) after the edit, without arcs that lead nowhere: (accepts, arcs); None if nothing is accepted from it. For p = q the state itself."""
        if p == q:
            return p
        key = (p, q) if p < q else (q, p)
        if key not in self.after:
            self.after[key] = self._trimmed(self.states[p], self.states[q], "")
        return self.after[key]

    def _trimmed(self, one, other, skipped: str):
        arcs, theirs = [], dict(other[1])
        for letter, then in one[1]:
            if letter in theirs and letter != skipped and (rest := self.both(then, theirs[letter])) is not None:
                arcs.append((letter, rest))
        return (one[0] and other[0], arcs) if arcs or (one[0] and other[0]) else None

    def endings(self, state) -> Iterator[str]:
        if isinstance(state, int):
            yield from self.acceptor.endings(state)
            return
        accepts, arcs = state
        if accepts:
            yield ""
        for letter, then in arcs:
            for rest in self.endings(then):
                yield letter + rest

    def at(self, state: int) -> list:
        """Edits in a state: (letter of one side, letter of the other or none, state after it)."""
        if state not in self.edits:
            found, arcs = [], self.states[state][1]
            for i, (letter, then) in enumerate(arcs):
                for other, there in arcs[i + 1 :]:
                    if (rest := self.both(then, there)) is not None:
                        found.append((letter, other, rest))
                # what is left out isn't followed by itself on the other side: the words would differ later
                if (rest := self._trimmed(self.states[state], self.states[then], letter)) is not None:
                    found.append((letter, "", rest))
            self.edits[state] = found
        return self.edits[state]

    def pairs(self, differ_before: int = NO_BOUND) -> Iterator[tuple[str, str]]:
        """All pairs, each once, whose first differing position is below differ_before."""
        todo = [(self.acceptor.root, "")]
        while todo:
            state, head = todo.pop()
            for letter, other, rest in self.at(state):
                for tail in self.endings(rest):
                    yield head + letter + tail, head + other + tail
            if len(head) + 1 < differ_before:
                todo += [(then, head + letter) for letter, then in self.states[state][1]]


def _part(words: list[tuple[str, int]], length: int, differ_before: int) -> Iterator[tuple[str, str, int]]:
    """(word, near word, its n), both ways."""
    if len(words) < 2:
        return
    counts = dict(words)
    for one, other in OneEdit(Acceptor(sorted(counts))).pairs(differ_before):
        if not length or min(len(one), len(other)) == length:
            yield one, other, counts[other]
            yield other, one, counts[one]


def _keyed(rows: DataFrame, l, a, z, h) -> DataFrame:
    """Rows with their part: words of length l or one more (0: any), alike in their first a and last z letters, that differ before h."""
    placed = rows.withColumns({"l": l.cast("int"), "a": a.cast("int"), "z": z.cast("int"), "h": h.cast("int")})
    ends = F.concat(F.expr("left(word, a)"), F.lit("\u0000"), F.when(F.col("z") > 0, F.expr("right(word, z)")).otherwise(""))
    return placed.select("word", "n", "l", "a", "z", "h", ends.alias("key"))


def _split(rows: DataFrame, min_length: int) -> DataFrame:
    """Rows of parts that are too large, in smaller parts, two for each row. Parts of any length are split by the shorter word's."""
    size = F.char_length("word")
    lengths = F.explode(F.filter(F.array(size, size - 1), lambda x: x >= min_length))
    anew = rows.filter("l = 0").select("word", "n", "a", "z", "h", lengths.alias("l"))
    by_length = _keyed(anew, F.col("l"), F.col("a"), F.when(F.col("z") > 0, F.col("l") - HEAD).otherwise(0), F.col("h"))
    middle = F.col("a") + F.floor((F.col("l") - F.col("a") - F.col("z")) / 2).cast("int")
    halves = rows.filter("l > 0").withColumn("middle", middle)
    later = _keyed(halves, F.col("l"), F.col("middle"), F.col("z"), F.col("h"))
    sooner = _keyed(halves, F.col("l"), F.col("a"), F.col("l") - F.col("middle"), F.col("middle"))
    return by_length.unionByName(later).unionByName(sooner)


def near_pairs(words: DataFrame, min_length: int = 7, part_words: int = PART_WORDS) -> DataFrame:
    """word, near, near_n: for each word of words (word, n) all words at one edit, both ways. words: distinct, of min_length (over HEAD + 1) letters at least.

    Words of a part come together by a shuffle on the part's letters. Which parts are too large is counted before; these are few, as
    each holds over part_words rows, and only their rows are dealt anew.
    """
    if min_length <= HEAD + 1:
        raise ValueError(f"words need more than {HEAD + 1} letters")
    one = F.lit(0)
    begun = _keyed(words, one, F.lit(HEAD), one, F.lit(NO_BOUND)).unionByName(_keyed(words, one, one, F.lit(min_length - HEAD), F.lit(HEAD)))
    whole, rows = [], begun
    while True:
        large = rows.groupBy(*PART).count().filter((F.col("count") > part_words) & ((F.col("l") == 0) | (F.col("l") - F.col("a") - F.col("z") > 1)))
        large = materialize(large.select(*PART), "large-parts")
        if large.isEmpty():
            whole.append(rows)
            release(large)
            break
        side = F.broadcast(large) if is_small(large) else large
        whole.append(rows.join(side, list(PART), "left_anti"))
        rows = materialize(_split(rows.join(side, list(PART), "left_semi"), min_length), "parts")
    parts = whole[0]
    for more in whole[1:]:
        parts = parts.unionByName(more)

    def run(batches):
        part, held = None, []
        out: list = []

        def table():
            words_, near, n = zip(*out, strict=True) if out else ((), (), ())
            return pa.RecordBatch.from_pydict({"word": pa.array(words_, pa.string()), "near": pa.array(near, pa.string()), "near_n": pa.array(n, pa.int64())})

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*PART, "word", "n")]
            for l, a, z, h, key, word, n in zip(*columns, strict=True):
                if (now := (l, a, z, h, key)) != part:
                    if part:
                        for row in _part(held, part[0], part[3]):
                            out.append(row)
                            if len(out) >= 50_000:
                                yield table()
                                out.clear()
                    part, held = now, []
                held.append((word, n))
        if part:
            out.extend(_part(held, part[0], part[3]))
        yield table()

    return parts.repartition(*PART).sortWithinPartitions(*PART).mapInArrow(released(run), "word string, near string, near_n bigint")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: where forms (word, form) lead. Each step at least multiplies the frequency, so that ways end; each round doubles what it goes."""
    now = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not now.filter("moved").isEmpty():
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = F.broadcast(ahead) if is_small(now) else ahead
        after = now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        before, now = now, materialize(after, "roots")
        release(before)
    return now.drop("moved")


def variants(words: DataFrame, min_length: int = 7, ratio: int = FORM_RATIO, part_words: int = PART_WORDS) -> DataFrame:
    """word, n, n_near, form, form_n, root for words (word, n): how many words are near, the commonest of them if it is ratio times as
    frequent at least, and where forms of forms end."""
    words = materialize(words.select("word", "n"), "words")
    near = near_pairs(words, min_length, part_words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("top"))
    judged = words.join(near, "word", "left").withColumn("form_n", -F.col("top.less"))
    takes = F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False))
    judged = materialize(
        judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("top.near")).alias("form"), F.when(takes, F.col("form_n")).alias("form_n")), "forms"
    )
    roots = _roots(judged.filter("form IS NOT NULL"))
    return judged.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
