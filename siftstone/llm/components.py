"""Connected components by alternating large and small stars; every step is a join or an aggregate over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import BROADCAST_ROWS, materialize, release


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60, most: int | None = None) -> DataFrame:
    """id, component (the smallest id that edges reach) for every id in edges (a, b: bigint).

    Loops, repeats and edges with a null end are ignored; without edges the result is empty. Minima are pre-aggregated, so a
    node with many edges is no hot task there. Where edges meet minima, these have one row for each node: few of them (bounded by
    the edges counted before) are broadcast, so a hub's edges stay where they are; many are shuffled, and adaptive
    execution splits a hub's side. The rounds grow with the logarithm of the paths' length; not to be done after max_rounds is an error.
    most: as many edges as there are at most, if that is known.
    """
    valid = edges.filter("a <> b")  # null ends give null, which is no match
    now = materialize(valid.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", most)
    before = _state(now)
    if not before[0]:
        return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        few = 2 * before[0] <= BROADCAST_ROWS  # a round never adds edges
        side = F.broadcast if few else (lambda df: df)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = materialize(both.filter("b > a").join(side(lowest), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large", before[0])
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(side(lowest), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialize(tied.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), "small", before[0])
        state = _state(after)
        release(now, large)
        now = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    stars = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    out = materialize(stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct()), "components", 2 * before[0])
    release(now)
    return out
