"""The gate language: programs that decide whether a rule holds for a file, compiled to Columns.

A program is read line by line; # begins a comment; keywords are case-insensitive, unknown commands are ignored.
`WHEN PRESENT|MISSING|EXPR|CURRENT_FILE_MATCHES|FILE_NAME_IS|FILE_PATH_MATCHES x` and `UNLESS CURRENT_FILE_MATCHES x` are gates, in order;
`REPORT AS`, `REASON`, `FAIL_REASON` and `TRACE` are metadata; `OBSERVE PROJECT_HAS_GLOB x [AS label]` counts entries without gating.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.functions.text import basename, glob_regex

GATES = ("WHEN PRESENT", "WHEN MISSING", "WHEN EXPR", "WHEN CURRENT_FILE_MATCHES", "WHEN FILE_NAME_IS", "WHEN FILE_PATH_MATCHES", "UNLESS CURRENT_FILE_MATCHES")
DEFAULTS = {
    "WHEN PRESENT": "required pattern is absent",
    "WHEN MISSING": "forbidden pattern is there",
    "WHEN EXPR": "condition does not hold",
    "WHEN CURRENT_FILE_MATCHES": "file does not match",
    "WHEN FILE_NAME_IS": "file has another name",
    "WHEN FILE_PATH_MATCHES": "file lies elsewhere",
    "UNLESS CURRENT_FILE_MATCHES": "file matches an exemption",
}


@dataclass
class Program:
    gates: list[tuple[str, str]] = field(default_factory=list)
    observes: list[tuple[str, str]] = field(default_factory=list)
    title: str | None = None
    reason: str | None = None
    fail_reason: str | None = None
    trace: list[str] = field(default_factory=list)

    @property
    def anchor(self) -> str | None:
        """The first pattern that must be there, as written."""
        return next((x for k, x in self.gates if k in ("WHEN PRESENT", "WHEN CURRENT_FILE_MATCHES")), None)


def parse(script: str) -> Program:
    out = Program()
    for raw in script.splitlines():
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        upper = " ".join(line.upper().split())
        words = line.split(None, 2)
        command = " ".join(upper.split()[:2])
        if command in GATES:
            out.gates.append((command, words[2].strip() if len(words) > 2 else ""))
        elif command == "OBSERVE PROJECT_HAS_GLOB" and len(words) > 2:
            m = re.match(r"(\S+)(?:\s+AS\s+(.+))?$", words[2].strip(), re.I)
            if m:
                out.observes.append((m[1], m[2] or m[1]))
        elif command == "REPORT AS" and len(words) > 2:
            out.title = words[2].strip()
        else:
            head, _, rest = line.partition(" ")
            if head.upper() == "REASON":
                out.reason = rest.strip()
            elif head.upper() == "FAIL_REASON":
                out.fail_reason = rest.strip()
            elif head.upper() == "TRACE":
                out.trace.append(rest.strip())
    return out


def token_pattern(token: str) -> str | None:
    """A Java pattern with inline flags: /p/ims, or a raw token, which is case-insensitive and multi-line. None if empty or invalid."""
    token = token.strip()
    flags = "im"
    if token.startswith("/") and token.count("/") >= 2:
        end = token.rindex("/")
        token, flags = token[1:end], "".join(c for c in "ims" if c in token[end + 1 :].lower())
    if not token:
        return None
    try:
        re.compile(token)
    except re.error:
        return None
    return (f"(?{flags})" if flags else "") + token


MARKS = re.compile(r"\|\||&&|[()]")
STRICT_MARKS = re.compile(r"\\.|\|\||&&|[()\[\]]")
PREDICATE = re.compile(r"(PRESENT|EXISTS|MISSING)\s*:(.*)", re.I | re.S)


def marks(expr: str, strict: bool = False) -> list[tuple[str, int, int]]:
    """(mark, where it begins, depth around it) of operators and parentheses. All parentheses count, those in patterns too, so that an unbalanced one
    swallows what follows, as programs rely on; one too many closes nothing. strict: those that are escaped or in a class don't count, nor operators there."""
    out, depth, in_class = [], 0, False
    for m in (STRICT_MARKS if strict else MARKS).finditer(expr):
        mark = m[0]
        if mark[0] == "\\" or (in_class and mark != "]"):
            continue
        if mark in "[]":
            in_class = mark == "["
            continue
        if mark == ")":
            if depth:
                depth -= 1
                out.append((mark, m.start(), depth))
            continue
        out.append((mark, m.start(), depth))
        depth += mark == "("
    return out


class _Parser:
    """Precedence over the marks of an expression: || below && below !; a term is a parenthesis with an expression, or a predicate up to the next operator."""

    def __init__(self, expr: str, strict: bool) -> None:
        self.expr, self.marks = expr, marks(expr, strict)

    def binary(self, start: int, end: int, depth: int, ops=(("||", "or"), ("&&", "and"))):
        if not ops:
            return self.term(start, end, depth)
        (op, name), rest = ops[0], ops[1:]
        cuts = [at for mark, at, d in self.marks if mark == op and d == depth and start <= at < end]
        bounds = [start, *[x for at in cuts for x in (at, at + 2)], end]
        parts = [self.binary(i, j, depth, rest) for i, j in zip(bounds[::2], bounds[1::2], strict=True)]
        return parts[0] if len(parts) == 1 else (name, parts)

    def term(self, start: int, end: int, depth: int):
        text = self.expr[start:end]
        start, end = start + len(text) - len(text.lstrip()), start + len(text.rstrip())
        if self.expr.startswith("!", start, end):
            return "not", self.term(start + 1, end, depth)
        if self.expr.startswith("(", start, end):
            closing = next((at for mark, at, d in self.marks if mark == ")" and d == depth and at > start), None)
            return self.binary(start + 1, closing, depth + 1) if closing == end - 1 else None
        m = PREDICATE.fullmatch(self.expr[start:end])
        pattern = raw_pattern(m[2]) if m else None
        return None if pattern is None else ("missing" if m[1].upper() == "MISSING" else "present", pattern)


def raw_pattern(text: str) -> str | None:
    """A Java pattern of an expression's predicate: the text as it stands, slashes too, case-insensitive and multi-line. None if empty or invalid."""
    text = text.strip()
    try:
        re.compile(text)
    except re.error:
        return None
    return "(?im)" + text if text else None


def _tree(expr: str, strict: bool):
    """('or'|'and', parts), ('not', part), ('present'|'missing', pattern) or None for what never holds."""
    return _Parser(expr, strict).binary(0, len(expr), 0)


def expression(expr: str, text: Column, strict: bool = False) -> Column:
    def build(node) -> Column:
        if node is None:
            return F.lit(False)
        kind, value = node
        if kind in ("or", "and"):
            out = build(value[0])
            for v in value[1:]:
                out = out | build(v) if kind == "or" else out & build(v)
            return out
        if kind == "not":
            return ~build(value)
        return text.rlike(value) if kind == "present" else ~text.rlike(value)

    return build(_tree(expr, strict)) if expr.strip() else F.lit(False)


def interpret(expr: str, text: str, strict: bool = False) -> bool:
    """The same on a Python string; for tests."""

    def run(node) -> bool:
        if node is None:
            return False
        kind, value = node
        if kind == "or":
            return any([run(v) for v in value])
        if kind == "and":
            return all([run(v) for v in value])
        if kind == "not":
            return not run(value)
        return (re.search(value, text) is not None) == (kind == "present")

    return run(_tree(expr, strict)) if expr.strip() else False


def gate_column(kind: str, arg: str, text: Column, path: Column, strict: bool = False) -> Column:
    if kind == "WHEN EXPR":
        return expression(arg, text, strict)
    if kind == "WHEN FILE_NAME_IS":
        return basename(path) == arg
    if kind == "WHEN FILE_PATH_MATCHES":
        return path.rlike(glob_regex(arg)) | basename(path).rlike(glob_regex(arg))
    pattern = token_pattern(arg)
    found = text.rlike(pattern) if pattern else F.lit(False)
    return ~found if kind in ("WHEN MISSING", "UNLESS CURRENT_FILE_MATCHES") else found


def verdict(program: Program, text: Column, path: Column, strict: bool = False) -> Column:
    """struct(passed, failed_at, reason): failed_at is the place of the first gate that fails, from 1, or null. Each gate is evaluated once, up to the first that fails."""
    failed_at, reasons = F.lit(None).cast("int"), [program.fail_reason or DEFAULTS[kind] for kind, _ in program.gates]
    for i, (kind, arg) in reversed(list(enumerate(program.gates, 1))):
        failed_at = F.when(~F.coalesce(gate_column(kind, arg, text, path, strict), F.lit(False)), i).otherwise(failed_at)

    def told(at: Column) -> Column:
        reason = F.get(F.array(*[F.lit(r) for r in reasons]), at - 1) if reasons else F.lit(None).cast("string")
        return F.struct(at.isNull().alias("passed"), at.alias("failed_at"), F.coalesce(reason, F.lit(program.reason)).alias("reason"))

    return F.transform(F.array(failed_at), told)[0]


def trace(program: Program, failed_at: Column) -> Column:
    """What is told of each gate, in order: those before the first that fails hold, later ones aren't tried; then notes of the program, if all hold."""
    told = F.array(*[F.lit(f"{kind} {arg}: holds") for kind, arg in program.gates]).cast("array<string>")
    failed = F.get(F.array(*[F.lit(f"{kind} {arg}: {program.fail_reason or DEFAULTS[kind]}") for kind, arg in program.gates]).cast("array<string>"), failed_at - 1)
    whole = F.concat(told, F.array(*[F.lit(t) for t in program.trace]).cast("array<string>"))
    return F.when(failed_at.isNull(), whole).otherwise(F.concat(F.slice(told, F.lit(1), failed_at - 1), F.array(failed)))


def metadata(program: Program) -> dict[str, str | None]:
    return {"title": program.title, "reason": program.reason, "fail_reason": program.fail_reason}


def observed(files: DataFrame, program: Program, kept: int = 8) -> DataFrame:
    """label, n, entries: project entries (files and their folders) of each observed glob, the first few by name."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    entries = files.select(F.explode(folders).alias("entry")).distinct()
    tags = F.array_compact(F.array(*[F.when(F.col("entry").rlike(glob_regex(g)) | basename(F.col("entry")).rlike(glob_regex(g)), F.lit(label)) for g, label in program.observes]))
    tagged = entries.select(F.explode(tags).alias("label"), "entry")
    place = F.row_number().over(Window.partitionBy("label").orderBy("entry"))
    first = tagged.withColumn("place", place).filter(F.col("place") <= kept).groupBy("label").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    return tagged.groupBy("label").agg(F.count("*").alias("n")).join(first, "label")


def glob_match(path: str, glob: str) -> bool:
    return fnmatchcase(path, glob)
