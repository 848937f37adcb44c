"""What a text must hold for a pattern to be found in it: literals, read off the parsed pattern, that are cheap to look for.

A pattern's requirement is a set of lower-case literals of which one must be there, in any case. It is exact in one direction: a text without any of
them has no match; with one it may. Patterns of which nothing is known (short or no literals, or what this reader doesn't follow) require nothing.
"""

from __future__ import annotations

import re
import warnings
from re import _constants as C
from re import _parser

from pyspark.sql import Column

#: Literals of fewer characters are in most texts, and more alternatives cost more than they save.
SHORTEST, MOST_ALTERNATIVES = 3, 12


def required(pattern: str) -> tuple[str, ...]:
    """Lower-case literals, one of which every match holds; none if that isn't known."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            parsed = _parser.parse(pattern)
    except (re.error, RecursionError, OverflowError):
        return ()
    best = _best(_runs(list(parsed)))
    return tuple(sorted(best)) if best else ()


def _good(options: frozenset[str]) -> bool:
    return bool(options) and len(options) <= MOST_ALTERNATIVES and min(map(len, options)) >= SHORTEST


def _best(choices: list[frozenset[str]]) -> frozenset[str]:
    """Of several requirements the one with the longest shortest literal, then the fewest literals."""
    good = [c for c in choices if _good(c)]
    return max(good, key=lambda c: (min(map(len, c)), -len(c), sorted(c)), default=frozenset())


def _runs(items: list) -> list[frozenset[str]]:
    """Requirements of a sequence: each run of characters that stand together, and those of its parts."""
    out, run = [], ""

    def end() -> None:
        nonlocal run
        if run:
            out.append(frozenset([run]))
        run = ""

    for op, value in items:
        if op is C.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if op is C.IN and (one := _one_letter(value)):
            run += one
            continue
        if op is C.SUBPATTERN:
            inner = list(value[-1])
            if all(o is C.LITERAL and v < 128 for o, v in inner):
                run += "".join(chr(v) for _, v in inner).lower()
                continue
        end()
        if op is C.SUBPATTERN:
            out += _runs(list(value[-1]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] > 0:
            out += _runs(list(value[2]))
        elif op is C.ATOMIC_GROUP:
            out += _runs(list(value))
        elif op is C.BRANCH:
            each = [_best(_runs(list(branch))) for branch in value[1]]
            if all(each):
                out.append(frozenset().union(*each))
        elif op is C.ASSERT and value[0] > 0:
            out += _runs(list(value[1]))
    end()
    return out


def _one_letter(options: list) -> str:
    """The letter of a class that holds it in both cases and nothing else."""
    if any(op is not C.LITERAL or value >= 128 for op, value in options):
        return ""
    letters = {chr(value).lower() for _, value in options}
    return letters.pop() if len(letters) == 1 else ""


def may_match(lowered: Column, pattern: str) -> Column | None:
    """Whether a lower-cased text holds what the pattern requires; None if it requires nothing."""
    options = required(pattern)
    if not options:
        return None
    out = lowered.contains(options[0])
    for text in options[1:]:
        out = out | lowered.contains(text)
    return out
