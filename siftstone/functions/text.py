"""Text and path functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Line separators of the scanner.
NEWLINE = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


#: White space of all scripts, as a regex class.
SPACE = r"[\s\u000b\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def norm_text(c: Column) -> Column:
    """Stripped lower case; null as the empty string, which means any or unknown."""
    return F.coalesce(F.lower(strip(c)), F.lit(""))


def norm_path(c: Column) -> Column:
    return norm_text(F.replace(c, F.lit("\\"), F.lit("/")))


def lines_of(text: Column) -> Column:
    """The lines of a text without a trailing empty one."""
    parts = F.split(text, NEWLINE)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def slug(c: Column, default: str = "item", size: int = 80) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(bare, 1, size), F.lit("")), F.lit(default))


def pascal_case(c: Column) -> Column:
    """First letters raised, the rest as it is."""
    words = F.filter(F.split(c, "[^A-Za-z0-9]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), "")


def html_escape(c: Column, quotes: bool = True) -> Column:
    """The ampersand first."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#x27;")) if quotes else ())):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def suffix(path: Column) -> Column:
    """The extension with its dot, in lower case; empty without one."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def short_path(path: Column, segments: int = 2) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - segments + 1, F.lit(1)), F.lit(segments)), "/")


def relative_to(path: Column, root: str) -> Column:
    """From the first place where root stands, else unchanged."""
    found = F.instr(path, root)
    return F.when(found > 0, F.substring(path, found, F.length(path))).otherwise(path)


def glob_regex(glob: str) -> str:
    """An anchored regex of a shell pattern; * crosses slashes, matching is case-sensitive."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := glob.find("]", i + 1)) > 0:
            inside = glob[i:end].replace("\\", "\\\\")
            out.append("[" + ("^" + inside[1:] if inside.startswith("!") else inside) + "]")
            i = end + 1
        else:
            out.append(re.escape(c) if c in "\\.+^$(){}|[]" else c)
    return "(?s)^" + "".join(out) + "$"


def matches_glob(c: Column, glob: str) -> Column:
    return c.rlike(glob_regex(glob))


def strip_terminal(c: Column) -> Column:
    """Without escape sequences, carriage returns and backspaces."""
    return F.regexp_replace(F.regexp_replace(c, "\\x1b\\[[0-9;?]*[A-Za-z]", ""), "[\r\b]", "")


def identifiers(c: Column, noise: tuple[str, ...] = (), least: int = 3) -> Column:
    """Identifier tokens of a size, without noise words."""
    found = F.regexp_extract_all(c, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= least) & ~F.lower(t).isin(*noise) if noise else F.length(t) >= least)


def last_segment(c: Column) -> Column:
    """The last name of a dotted, arrow or scope call chain."""
    return F.element_at(F.split(c, r"->|::|\."), -1)


def parameter_name(c: Column) -> Column:
    """A parameter without its default, type, sigils and brackets."""
    bare = strip(F.regexp_replace(F.regexp_replace(c, "=.*$", ""), ":.*$", ""))
    return F.regexp_replace(F.element_at(F.split(bare, r"\s+"), -1), r"^[&*$.]+|\[\]$", "")


def host_path(c: Column, mount: str = "/host") -> Column:
    """A drive path below the mount; other paths with forward slashes."""
    forward = F.replace(c, F.lit("\\"), F.lit("/"))
    drive = F.lower(F.regexp_extract(forward, "^([A-Za-z]):/", 1))
    return F.when(drive != "", F.concat(F.lit(mount + "/"), drive, F.substring(forward, 3, 1_000_000))).otherwise(forward)


def inside_any(path: Column, roots: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for root in roots:
        out = out | (path == root) | path.startswith(root.rstrip("/") + "/")
    return out


def valid_name(c: Column, most: int = 64) -> Column:
    return F.coalesce(c.rlike("^[A-Za-z0-9 _.-]+$") & (F.length(c) <= most), F.lit(False))


def valid_path(c: Column, most: int = 255) -> Column:
    return F.coalesce(c.rlike("^[A-Za-z0-9_./: -]+$") & (F.length(c) <= most), F.lit(False))


def truncated(c: Column, most: int = 300, kept: int = 75) -> Column:
    return strip(F.when(F.length(c) > most, F.concat(F.substring(c, 1, kept), F.lit(".."))).otherwise(c))


def ordered_distinct(c: Column) -> Column:
    """A comma list with each name once, in order of first sight."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), strip), lambda x: x != ""))


def named_counts(c: Column) -> Column:
    """array<struct<name,count>> of a list like a[3], b[1]."""
    items = F.filter(F.split(c, r"\s*,\s*"), lambda x: x.rlike(r"^.+\[\d+\]$"))
    return F.transform(items, lambda x: F.struct(F.regexp_extract(x, r"^(.+)\[(\d+)\]$", 1).alias("name"), F.regexp_extract(x, r"^(.+)\[(\d+)\]$", 2).cast("int").alias("count")))


def line_of_offset(text: Column, offset: Column) -> Column:
    """1 for offset 0 (characters before the place)."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def elapsed(ms: Column) -> Column:
    part = lambda v, n: F.lpad(v.cast("string"), n, "0")
    whole = lambda v: F.floor(v).cast("long")
    return F.concat(part(whole(ms / 3_600_000), 2), F.lit("Hr:"), part(whole(ms / 60_000) % 60, 2), F.lit("Min:"), part(whole(ms / 1000) % 60, 2), F.lit("s:"), part(ms % 1000, 3), F.lit("ms"))


def java_pattern(pattern: str) -> str:
    """Named groups as Java has them."""
    return re.sub(r"\(\?P<([A-Za-z]\w*)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)


def safe_pattern(pattern: str | None) -> str | None:
    """None, which means no constraint, for an empty or invalid pattern. Spark fails a whole query on an invalid one."""
    if not pattern:
        return None
    try:
        re.compile(pattern)
    except re.error:
        return None
    return java_pattern(pattern)


def with_safe_patterns(df: DataFrame, *columns: str) -> DataFrame:
    """df with invalid patterns in its columns as null: no constraint. Patterns are tried on the driver, one distinct one at a time; only invalid ones are kept."""
    compiler = df.sparkSession._jvm.java.util.regex.Pattern
    for name in columns:
        wrong = []
        for row in df.select(name).filter(F.col(name) != "").distinct().toLocalIterator():
            try:
                compiler.compile(java_pattern(row[0]))
            except Exception:  # what the compiler throws comes as an error of the bridge
                wrong.append(row[0])
        df = df.withColumn(name, F.when(~F.col(name).isin(wrong), F.col(name)) if wrong else F.col(name))
    return df
