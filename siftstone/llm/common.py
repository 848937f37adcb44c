"""Shared plumbing of the corpus operators: tables, checked broadcasts, Arrow batches in small pieces."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.plans.lineage import materialize, release, shared_dir

__all__ = ["WORD", "count_words", "is_small", "let", "lookup_join", "materialize", "pieces", "read_table", "release", "released", "shared_dir", "sheltering"]

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Lookup sides are broadcast up to this many rows and characters; larger ones are shuffle-joined.
BROADCAST_ROWS, BROADCAST_CHARS = 100_000, 32 << 20
#: Rows and bytes that a Python task works on at a time.
PIECE_ROWS, PIECE_BYTES = 1000, 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, chars: int = BROADCAST_CHARS) -> bool:
    """Whether df has few rows, and these few characters in their text and binary columns. Should be materialised."""
    wide = [F.coalesce(F.length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    size = sum(wide[1:], wide[0]) if wide else F.lit(0)
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(size.cast("long")).alias("chars")).first()
    return found["n"] <= rows and (found["chars"] or 0) <= chars


def lookup_join(facts: DataFrame, lookup: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join facts to a lookup with unique keys, nulls equal. lookup should be materialised.

    The lookup is broadcast if it is measured to be small; otherwise both sides are shuffled, and
    adaptive execution splits hot keys, as the lookup has one row for each.
    """
    renamed = lookup.withColumnRenamed(key, "__key")
    side = F.broadcast(renamed) if is_small(lookup) else renamed
    return facts.join(side, facts[key].eqNullSafe(F.col("__key")), how).drop("__key")


def let(value: Column, body) -> Column:
    """Bind value once for use in body, also inside lambdas, where plain reuse would evaluate it again and again."""
    return F.transform(F.array(value), body)[0]


def sheltering(operate):
    """operate(rows, ...) for an operator whose result has the rows' columns: those that begin with two underscores, as the operators' own do, have other
    names meanwhile, so that none is taken for another."""

    @functools.wraps(operate)
    def wrapped(rows: DataFrame, *args, **options) -> DataFrame:
        names: dict[str, str] = {}
        for c in rows.columns:
            if c.startswith("__"):
                name = f"sheltered{len(names)}"
                while name in rows.columns:
                    name += "_"
                names[c] = name
        if not names:
            return operate(rows, *args, **options)
        out = operate(rows.withColumnsRenamed(names), *args, **options)
        return out.withColumnsRenamed({name: c for c, name in names.items()})

    return wrapped


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pieces(batches, rows: int = PIECE_ROWS, size: int = PIECE_BYTES):
    """Arrow batches (Spark bounds their bytes) in slices of few rows and about `size` bytes, so that what is made of them stays small."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def released(run):
    """run for mapInArrow, giving its freed memory back when a task ends: workers live on and serve other stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    return wrapped


def _release() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass
