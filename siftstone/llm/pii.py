"""Personal data and secrets replaced by surrogates.

Detected entities (e-mail addresses, phone numbers, payment cards, IPv4 and IPv6 addresses, IBANs, social security numbers,
credentials, and names after a title) get keyed replacements of the same type and format. Formats with letters and
digits go through a keyed Feistel permutation that keeps each character's class (a digit stays a digit of its script, a lower-case letter
a lower-case letter of its script, an octet an octet of the same width, card and IBAN check digits stay right), so that equal entities
always get equal surrogates and different ones different surrogates. Names are made from syllables or characters of the same
script (from letters of the same script where it has no table here), given names by the gender of the title, part by part where
a hyphen or apostrophe joins them; given and family names are replaced on their own, and a name known from a title is replaced
wherever the text says it again, so that a person stays the same with and without title or given name.

All distinct entities of the corpus then pass a collision check: entities that share a surrogate, or got their own
value, are renamed by further attempts until all differ (if they never do, that is an error). These exceptions are applied in the second pass.

The key is the caller's: who knows it can link surrogates to guessed values.

Nulls: a null text stays null with no entities. Texts are searched whole; clean texts come back unchanged. Of overlapping entities
the first stands, at a tie the longest (of an address behind a number, what is left of it stands too). Repeated
rows get equal results. Empty tables give empty results; extra columns pass through; one with the name of the count is replaced.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache
from ipaddress import AddressValueError, IPv6Address

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftstone.llm.common import is_small, materialize, pieces, release, released, sheltering

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Junk that may stand between the groups of a number.
GAP = r"[ .\-/#*$%&!]{0,5}"
NUMBER = re.compile(
    rf"(?<![\w.])(?P<ip>\d{{1,3}}(?:\.\d{{1,3}}){{3}})(?!\w|\.\d)"
    rf"|(?P<phone>\+\d{{1,3}}{GAP}\(?\d{{1,4}}\)?(?:{GAP}\d{{2,4}}){{2,4}}(?!\d)|(?<![\w.])\(\d{{3}}\){GAP}\d{{3}}{GAP}\d{{4}}(?!\d)|(?<![\w.-])\d{{3}}-\d{{3}}-\d{{4}}(?![\w-])|(?<![\w.-])[2-9]\d{{2}}(?P<sep>[ .])[2-9]\d{{2}}(?P=sep)\d{{4}}(?![\w-]|\.\d))"
    rf"|(?<![\w.-])(?P<ssn>\d{{3}}-\d{{2}}-\d{{4}})(?![\w-])"
    rf"|(?<![\w.-])(?P<card>\d(?:[ -]?\d){{12,18}})(?![\w-])"
    rf"|(?<!\w)(?P<iban>[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?!\w)"
)
#: Ten digits alone are a phone number where a word before them says so.
TEN_DIGITS = re.compile(r"(?<![\w.+-])\d{10}(?![\w-])")
CALLED = re.compile(r"(?i)(?<![a-z])(?:phone|tel|telephone|call|mobile|cell|fax|ring|dial|sms)\b[^\w+]{0,3}(?:(?:me|us|at|on|is|number|no)\b[^\w+]{0,3}){0,3}\Z")
IPV6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{6,39}(?![\w:])")
ACCESS_KEY = re.compile(r"(?<!\w)(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})(?!\w)")
#: What must be in a text for the patterns to be tried.
KEY_STARTS, SECRET_WORDS = ("AKIA", "ASIA", "_", "sk-", "xox"), ("passw", "pwd", "secret", "token", "key")
DIGITS_AT = re.compile(r"\d+")
GOES_ON = re.compile(r"[-.]\d")
AFTER_CARD = re.compile(r"[\w-]")
#: A value after a secret's name: with a digit after any sign; without one if it is quoted, or follows an equals sign and isn't code.
SECRET = re.compile(
    r"""(?i)(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)["']?(?:"""
    r"""\s{0,3}[:=]\s{0,3}["']?(?=[^\s"']*\d)([A-Za-z0-9_+/=.~-]{8,})|\s{0,3}[:=]\s{0,3}(["'])([^\s"']{8,})\2|\s?=\s?([A-Za-z_+/~-]{8,})(?![\w.(\[]))"""
)
TITLES = ("Dr", "Doctor", "Docteur", "Doktor", "Prof", "Professor", "Professeur", "Доктор", "Профессор", "Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Господин", "Госпожа", "Κύριος", "Κυρία")
FEMALE = {"mrs", "ms", "miss", "frau", "madame", "mme", "señora", "sra", "госпожа", "κυρία"}
#: A letter or a mark that belongs to one, and a word of them.
LETTER = r"(?:[^\W\d_]|[\u0300-\u036f\u0591-\u05c7\u064b-\u065f\u0670\u0900-\u0dff\u0e31\u0e34-\u0e4e])"
NAMED = rf"{LETTER}+(?:['’-]{LETTER}+)*"
NAME = re.compile(rf"(?<!\w)({'|'.join(sorted({*TITLES, *map(str.upper, TITLES)}, key=len, reverse=True))})(?!\w)\.? ({NAMED})(?:((?: (?:von|van|de|der|den|del|di|da|la|le|bin|al|ten|zu))*) ({NAMED}))?")
ALL_TITLES = tuple(sorted({*TITLES, *map(str.upper, TITLES)}))
LOCAL, DOMAIN = re.compile(r"[\w.+%-]+\Z"), re.compile(r"[^\W_][\w-]*(?:\.[^\W_][\w-]*)+")
#: Consonants and vowels that make syllables, by the script's name in Unicode.
SYLLABLES = {
    "LATIN": ("bcdfghklmnprstvz", "aeiou"),
    "CYRILLIC": ("бвгдзклмнпрст", "аеиоу"),
    "GREEK": ("βγδζκλμνπρστφ", "αειου"),
    "ARMENIAN": ("բգդզթլխկհմնպռսվտրքֆ", "աեիոու"),
    "GEORGIAN": ("ბგდვზთკლმნპრსტფქღშჩც", "აეიოუ"),
    "ARABIC": ("بتثجحخدذرزسشصضطعغفقكلمنه", "اوي"),
    "HEBREW": ("בגדהזחטכלמנספצקרשת", "אוי"),
    "DEVANAGARI": ("कखगघचछजझटठडढतथदधनपफबभमयरलवशसह", "ािीुूेो"),
    "BENGALI": ("কখগঘচছজঝটঠডঢতথদধনপফবভমযরলশসহ", "ািীুূেো"),
    "THAI": ("กขคงจชซดตถทธนบปผพฟมยรลวสหอ", "ะาิีุู"),
    "HIRAGANA": ("かきくけこさしすせそたちつてとなにぬねのはひふへほまみむめも", "やゆよらりるれろわ"),
    "KATAKANA": ("カキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモ", "ヤユヨラリルレロワ"),
}
#: Scripts whose names are made of as many characters as they had.
CHARACTERS = {
    "CJK": "王李张刘陈杨黄赵吴周徐孙马朱胡林郭何高罗郑梁谢宋唐许邓冯韩曹曾彭萧蔡潘田董袁于余叶蒋杜苏魏程吕丁沈任姚卢傅钟姜崔谭廖范汪陆金石戴贾韦夏邱方侯邹熊孟秦白江阎薛尹段雷",
    "HANGUL": "가나다라마바사아자차카타하강건경광규기길남도동민병상서석성세수승시영용우운원유은인일재정종주준지진찬창철충태한해혁현형호홍환희",
}
ENDINGS = {("LATIN", "f"): "a", ("LATIN", "m"): "n", ("CYRILLIC", "f"): "а", ("CYRILLIC", "m"): "н", ("GREEK", "f"): "α", ("GREEK", "m"): "ς"}
#: Letters beyond ASCII that are permuted among themselves: first and last of runs of one script and case.
RUNS = ("àö", "øþ", "ÀÖ", "ØÞ", "αρ", "ΑΡ", "ая", "АЯ", "աֆ", "ԱՖ", "את", "ثغ", "فه", "कह", "কহ", "กอ", "აჰ", "ぁん", "ァヶ", "一龥", "가힣")


def luhn(digits: str) -> int:
    """The sum modulo 10; 0 for a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _card(text: str, start: int) -> tuple[int, int]:
    """(digits, end) of the longest valid card number that begins at start and ends with a group of digits; zeros if there is none."""
    digits, at, found = "", start, (0, 0)
    while len(digits) < 19 and (run := DIGITS_AT.match(text, at)):
        digits, at = digits + run[0], run.end()
        more = text[at : at + 1] in (" ", "-") and DIGITS_AT.match(text, at + 1)
        if 13 <= len(digits) <= 19 and (more or not AFTER_CARD.match(text, at)) and not luhn(digits):
            found = len(digits), at
        if not more:
            break
        at += 1
    return found


def _card_within(text: str, start: int, end: int) -> tuple[int, int]:
    """(start, end) of the card in a match from start to end: all of it if it is valid, else the longest that begins with one of its groups."""
    if not luhn("".join(filter(str.isdigit, text[start:end]))):
        return start, end
    tried = [(*_card(text, run.start()), run.start()) for run in DIGITS_AT.finditer(text, start, end)]
    size, to, at = max(tried, key=lambda x: x[0])
    return (at, to) if size else (0, 0)


def _iban(value: str) -> int:
    """How long the longest valid IBAN at the beginning of value is, up to a space or the end; 0 if there is none."""
    end = len(value)
    while end > 0:
        bare = value[:end].replace(" ", "")
        if 15 <= len(bare) <= 34 and mod97(bare) == 1:
            return end
        end = value.rfind(" ", 0, end)
    return 0


def _accepted(text: str, m: re.Match) -> tuple[int, int]:
    """(start, end) of the entity at a match of NUMBER, zeros if it is none. Cards and IBANs may be a part of the match."""
    kind, value = m.lastgroup, m.group()
    if kind == "card":
        return _card_within(text, *m.span())
    if kind == "iban":
        size = _iban(value)
        return (m.start(), m.start() + size) if size else (0, 0)
    if kind == "ip" and any(int(x) > 255 or (x[0] == "0" and x != "0") for x in value.split(".")):
        return 0, 0
    if kind == "phone":  # as many groups as have 15 digits at most, not up to within another number
        runs = list(DIGITS_AT.finditer(text, *m.span()))
        if sum(map(str.isdigit, value)) > 15 and value[0] == "+" and text[runs[1].start() - 1] in " -" and _card(text, runs[1].start())[0]:
            return 0, 0  # a card, after another number
        n = end = 0
        for run in runs:
            n += run.end() - run.start()
            if 7 < n < 16 and not GOES_ON.match(text, run.end()):
                end = run.end()
        return (m.start(), end) if end else (0, 0)
    return m.span()


def _numbers(text: str, runs: list[tuple[int, int]]):
    """(start, end, kind) of numbers, runs: where digits stand. They begin at a run of digits, or one or two characters before it, so only there NUMBER is tried."""
    end = tried = 0
    for at, _ in runs:
        for start in (at - 1, at - 2, at):
            if start < end or (m := NUMBER.match(text, start)) is None or (m.lastgroup == "card" and start < tried):
                continue
            first, to = _accepted(text, m)
            if to:
                yield first, to, m.lastgroup
                end, tried = to, 0
                break
            if m.lastgroup == "card":
                tried = m.end()  # no card begins before


def _emails(text: str):
    at = text.find("@")
    while at >= 0:
        back = 64
        while True:  # as far back as the local part goes
            left = LOCAL.search(text, max(0, at - back), at)
            if left is None or left.start() > at - back or left.start() == 0:
                break
            back *= 4
        right = DOMAIN.match(text, at + 1)
        if left and right:
            yield left.start(), right.end(), "email"
        at = text.find("@", at + 1)


def _is_ipv6(value: str) -> bool:
    try:
        IPv6Address(value)
    except (AddressValueError, ValueError):
        return False
    groups = [g for g in value.split(":") if g]
    return len(groups) > 2 or any(len(g) > 2 and not g.isalpha() for g in groups)


def _said_again(text: str, known: dict[str, str]):
    """(start, end, kind) of the known names wherever they stand as words."""
    forms = {form: kind for value, kind in known.items() for form in (value, value.upper()) if len(value) > 1}
    for m in re.finditer(rf"(?<!\w)(?:{'|'.join(re.escape(x) for x in sorted(forms, key=len, reverse=True))})(?!{LETTER}|\d)", text) if forms else ():
        yield *m.span(), forms[m.group()]


def _begins_name(word: str) -> bool:
    """No lower-case letter where the script has capitals in use."""
    return not word[0].islower() or "ა" <= word[0] <= "ჿ"


def _names(text: str):
    known: dict[str, str] = {}
    for m in NAME.finditer(text):
        if not _begins_name(m[2]):
            continue
        second = m[4] if m[4] and _begins_name(m[4]) else None
        if second:
            known.setdefault(m[2], f"given-{'f' if m[1].lower() in FEMALE else 'm'}")
        known.setdefault(second or m[2], "family")
    yield from _said_again(text, known)


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text, in order, without overlaps."""
    found: list[tuple[int, int, str]] = list(_emails(text))
    runs = [m.span() for m in DIGITS_AT.finditer(text)]
    found += _numbers(text, runs)
    if text.find(":") >= 0:
        found += [(*m.span(), "ipv6") for m in IPV6.finditer(text) if _is_ipv6(m.group())]
    if any([x in text for x in KEY_STARTS]):
        found += [(*m.span(), "key") for m in ACCESS_KEY.finditer(text)]
    low = text.lower()
    if any([x in low for x in SECRET_WORDS]):
        found += [(*m.span(next(g for g in (1, 3, 4) if m[g])), "secret") for m in SECRET.finditer(text)]
    found += [(s, e, "phone") for s, e in runs if e - s == 10 and TEN_DIGITS.match(text, s) and CALLED.search(text, max(0, s - 60), s)]
    if any([x in text for x in ALL_TITLES]):
        found += _names(text)
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str]] = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
        elif x[2] == "email" and out[-1][1] < x[1] and text.find("@", out[-1][1], x[1]) > out[-1][1]:
            out.append((out[-1][1], x[1], "email"))
    return out


def _stream(key: bytes, *parts: object) -> bytes:
    return hashlib.blake2b(repr(parts).encode(), key=key[:64], digest_size=64).digest()


def permute(values: list[int], sizes: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed permutation of mixed-radix numbers of one shape: a Feistel network over even and odd places."""
    values = list(values)
    for r in range(6):
        moved, other = range(r % 2, len(values), 2), tuple(values[(r + 1) % 2 :: 2])
        raw, block = b"", 0
        for n, i in enumerate(moved):
            if 4 * n + 4 > len(raw):
                raw += _stream(key, tweak, tuple(sizes), r, block, other)
                block += 1
            values[i] = (values[i] + int.from_bytes(raw[4 * n : 4 * n + 4], "little")) % sizes[i]
    return values


def _alphabet(c: str) -> tuple[int, int] | None:
    """(first code, number) of the characters that may stand for c; None if it stays."""
    if c.isdecimal():
        return ord(c) - int(c), 10
    if c.isascii():
        return (ord("a"), 26) if c.islower() else (ord("A"), 26) if c.isupper() else None
    return next(((ord(x), ord(y) - ord(x) + 1) for x, y in RUNS if x <= c <= y), None)


def _alike(value: str, key: bytes, tweak: str, fixed=(), hexes: bool = False) -> str:
    """value with letters and digits permuted within their classes; places in fixed stay. hexes: letters are digits of base 16, as in long words of these."""
    word = "".join(filter(str.isalnum, value))
    hexes = hexes or bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", word)) and len(word) > 12 and not word.isdigit()
    alphabets = {i: a for i, c in enumerate(value) if i not in fixed and (a := _alphabet(c))}
    if hexes:
        alphabets = {i: (a, 6 if n == 26 else n) for i, (a, n) in alphabets.items()}
    new = permute([ord(value[i]) - a for i, (a, _) in alphabets.items()], [n for _, n in alphabets.values()], key, tweak)
    out = list(value)
    for (i, (a, _)), v in zip(alphabets.items(), new, strict=True):
        out[i] = chr(a + v)
    return "".join(out)


def _name(value: str, key: bytes, kind: str, attempt: int) -> str:
    """A name of the same script and case; parts that a hyphen or apostrophe joins are named on their own, prefixes of a letter or two stay."""
    parts = re.split("(['’-])", value)
    return "".join(part if not part or part in "'’-" or (len(parts) > 1 and len(part) < 3) else _part(part, key, kind, attempt) for part in parts)


def _part(value: str, key: bytes, kind: str, attempt: int) -> str:
    script = unicodedata.name(value[0], "LATIN").split()[0]
    raw = _stream(key, kind, value.casefold(), attempt)
    if script in CHARACTERS:
        return "".join(CHARACTERS[script][raw[i] % len(CHARACTERS[script])] for i in range(len(value) + attempt % 12))
    if script not in SYLLABLES:
        return _alike(value, key, f"{kind}/{attempt}") if _alphabet(value[0]) else "".join(_neighbour(c, raw[i % 64]) for i, c in enumerate(value))
    first, vowels = SYLLABLES[script]
    out = "".join(first[raw[2 * i] % len(first)] + vowels[raw[2 * i + 1] % len(vowels)] for i in range(4 + attempt % 12))
    out += ENDINGS.get((script, kind[-1]), "") if kind.startswith("given") else first[raw[63] % len(first)]
    return out.upper() if value.isupper() and len(value) > 1 else out.capitalize()


def _neighbour(c: str, n: int) -> str:
    """A letter of the same script and category for a letter of a script without a table; marks stay."""
    if not c.isalpha():
        return c
    block, kind = ord(c) & ~0x3F, unicodedata.category(c)
    script = unicodedata.name(c, "").split(" ")[0]
    near = [x for x in map(chr, range(block, block + 64)) if unicodedata.category(x) == kind and unicodedata.name(x, "").split(" ")[0] == script]
    return near[(near.index(c) + 1 + n % max(1, len(near) - 1)) % len(near)]


@lru_cache(maxsize=50_000)
def surrogate(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    tweak = f"{kind}/{attempt}" if attempt else kind
    if kind == "family" or kind.startswith("given"):
        return _name(value, key, kind, attempt)
    if kind == "ipv6":
        return _alike(value, key, tweak, hexes=True)
    if kind == "ip" and value.isascii():
        octets = [int(x) for x in value.split(".")]
        bands = [(0, 10) if x < 10 else (10, 90) if x < 100 else (100, 156) for x in octets]
        new = permute([x - b[0] for x, b in zip(octets, bands, strict=True)], [b[1] for b in bands], key, tweak)
        return ".".join(str(x + b[0]) for x, b in zip(new, bands, strict=True))
    if kind == "card":
        places = [i for i, c in enumerate(value) if c.isdigit()]
        out = list(_alike(value, key, tweak, fixed={places[0], places[-1]}))
        zero = ord(value[places[-1]]) - int(value[places[-1]])
        out[places[-1]] = chr(zero)
        out[places[-1]] = chr(zero + -luhn("".join(filter(str.isdigit, out))) % 10)
        return "".join(out)
    if kind == "iban":
        out = _alike(value, key, tweak, fixed=range(4))
        bare = out.replace(" ", "")
        return out[:2] + f"{98 - mod97(bare[:2] + '00' + bare[4:]):02d}" + out[4:]
    if kind == "phone":
        # of the digits alone, whatever stands between them, so that a number in another format stays the same number; 555 of a made-up one stays
        country = re.match(r"\+\d{1,3}(?!\d)", value)
        places = [i for i, c in enumerate(value) if c.isdecimal() and i >= (country.end() if country else 0)]
        zeros = [ord(value[i]) - int(value[i]) for i in places]
        digits = [int(value[i]) for i in places]
        kept = range(3, 6) if len(digits) == 10 and digits[3:6] == [5, 5, 5] else range(0)
        free = [k for k in range(len(digits)) if k not in kept]
        for k, v in zip(free, permute([digits[k] for k in free], [10] * len(free), key, tweak), strict=True):
            digits[k] = v
        out = list(value)
        for i, zero, v in zip(places, zeros, digits, strict=True):
            out[i] = chr(zero + v)
        return "".join(out)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        labels = domain.split(".")
        own = ".".join(labels[:-2]) or labels[0]
        return _alike(local, key, tweak) + "@" + _alike(own, key, tweak + "/domain") + domain[len(own):]
    if kind == "key":
        return _alike(value, key, tweak, fixed=range(re.match("AKIA|ASIA|[a-z]+[_-]", value).end()))
    return _alike(value, key, tweak)


def replaced(text: str, spans: list[tuple[int, int, str]], key: bytes, renamed: dict[tuple[str, str], str]) -> str:
    out, at = [], 0
    for s, e, kind in spans:
        value = text[s:e]
        out += [text[at:s], renamed.get((kind, value)) or surrogate(kind, value, key)]
        at = e
    return "".join([*out, text[at:]])


def entities(docs: DataFrame, text: str, row: str | None = None) -> DataFrame:
    """(row,) kind, value of the entities; distinct within a batch."""

    def run(batches):
        for batch in pieces(batches):
            rows = batch.column(row).to_pylist() if row else [0] * batch.num_rows
            found = {(r, kind, t[s:e]) for r, t in zip(rows, batch.column(text).to_pylist(), strict=True) if t for s, e, kind in find(t)}
            yield pa.RecordBatch.from_pydict(({row: pa.array([x[0] for x in found], pa.int64())} if row else {}) | {"kind": pa.array([x[1] for x in found], pa.string()), "value": pa.array([x[2] for x in found], pa.string())})

    return docs.select(*[row] * bool(row), text).mapInArrow(released(run), f"{f'{row} bigint, ' if row else ''}kind string, value string")


def collisions(found: DataFrame, key: bytes, max_attempts: int = 24) -> DataFrame:
    """kind, value, surrogate of the entities that can't keep their first surrogate. found: distinct kind, value.

    All work is grouped by surrogate. In each round the smallest holder keeps a shared surrogate, the others try again.
    """

    def propose(df: DataFrame, attempt: int) -> DataFrame:
        def run(batches):
            for batch in pieces(batches):
                made = [surrogate(k, v, key, attempt) for k, v in zip(batch.column("kind").to_pylist(), batch.column("value").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("value"), pa.array(made, pa.string())], names=["kind", "value", "surrogate"])

        return df.select("kind", "value").mapInArrow(released(run), "kind string, value string, surrogate string").withColumn("attempt", F.lit(attempt))

    held = materialize(propose(found, 0), "surrogates")
    for attempt in range(1, max_attempts + 1):
        holders = Window.partitionBy("kind", "surrogate")
        ranked = held.withColumn("__first", F.min(F.struct("attempt", "value")).over(holders))
        bad = (F.col("value") != F.col("__first.value")) | (F.col("value") == F.col("surrogate"))
        loose = materialize(ranked.filter(bad).select("kind", "value"), "collided")
        if loose.isEmpty():
            return held.filter("attempt > 0").select("kind", "value", "surrogate")
        held = materialize(held.join(loose, ["kind", "value"], "left_anti").unionByName(propose(loose, attempt)), "surrogates")
    raise RuntimeError(f"surrogates still collide after {max_attempts} attempts")


@sheltering
def anonymize(docs: DataFrame, key: bytes, text: str = "text", count: str | None = None) -> DataFrame:
    """docs with surrogates in text; key: a secret of the caller's; count: a column to add with the number of entities replaced."""
    if not key:
        raise ValueError("give a secret key")
    found = materialize(entities(docs, text).distinct(), "entities")
    exceptions = materialize(collisions(found, key), "renamed")
    release(found)
    columns = [c for c in docs.columns if c != count]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in columns) + (f", `{count}` bigint" if count else "")
    shared: dict[tuple[str, str], str] = {}
    if is_small(exceptions):  # measured; else each row gets its own exceptions by a join
        shared = {(r["kind"], r["value"]): r["surrogate"] for r in exceptions.collect()}
        source, own = docs.select(*[F.col(f"`{c}`") for c in columns]), None
    else:
        own, row = "__renamed", "__row"
        rows = materialize(docs.select(*[F.col(f"`{c}`") for c in columns]).withColumn(row, F.monotonically_increasing_id()), "rows")
        named = entities(rows, text, row).join(exceptions, ["kind", "value"]).groupBy(row).agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias(own))
        source = rows.join(named, row, "left").drop(row)

    def run(batches):
        for batch in pieces(batches):
            texts, counts = [], []
            maps = batch.column(own).to_pylist() if own else [None] * batch.num_rows
            for t, m in zip(batch.column(text).to_pylist(), maps, strict=True):
                spans = find(t) if t else []
                renamed = shared if not m else {(x["kind"], x["value"]): x["surrogate"] for x in m}
                texts.append(replaced(t, spans, key, renamed) if spans else t)
                counts.append(len(spans))
            arrays = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(counts, pa.int64())] if count else []), names=columns + ([count] if count else []))

    return source.mapInArrow(released(run), schema)
