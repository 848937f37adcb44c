"""Mixing sources to target weights by Sainte-Laguë apportionment. DataFrame functions only.

1. Weights by rank of the source share `share` of all words; a target stops at `epochs` times its source's
   words, and the excess is reshared by weight until no target is above (water-filling by a few aggregates).
2. The total is cut into blocks of `block_words`; seats go to sources by highest quotients target / (2k - 1).
   The divisor is found by a search whose every step is one aggregate over the sources, so no seat is listed.
3. A source's documents are put in a seeded order, dealt out over ranges of that order (shards). A source's seats are
   spent on whole passes over the source, then on the first blocks of the seeded order, which gives each shard an integer quota
   of blocks: all that it has before the cut, some at the cut, none behind it. The quotas select the documents: a shard whose quota covers its words is
   taken whole, one with a smaller quota up to the document whose middle lies within its blocks, one without a quota not at all. So a source misses
   its seats by half a document and a block at most; then the one document that comes nearest to closing this gap changes sides.

Nulls: a null text has no words and takes none, like any text without words: `mix` leaves it out. A null source is a source of
its own and comes last; null ids share one place in the order, as repeated ids do (all or none of them are taken). Ties of
quotients go to the source that ranks first, ties of the order to the smaller hash. Empty tables give empty results; extra
columns pass through `mix`, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftstone.llm.common import WORD, count_words, is_small, lookup_join, materialize, release, sheltering

SEED = 20_231
BLOCK_WORDS = 64
#: Fewest rows of a range of the seeded order. A range has about the square root of the rows, so that a hot source's ranges, and
#: the rows of each, are both far fewer than its rows.
RANGE_ROWS = 64


def _order_hash(seed: int):
    return F.xxhash64(F.lit(seed), F.col("doc_id"))


def ranked_sources(sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """source, source_size, n_docs, rank, weight. Ranks by code point, null last, from range partitions and their offsets."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranged = materialize(totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("__part", F.spark_partition_id()), "sources")
    parts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    offsets = parts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(F.col("source").asc_nulls_last()))
    rank = (F.col("__before") + within - 1).cast("long")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    return materialize(ranged.join(offsets, "__part").withColumn("rank", rank).withColumn("weight", weight).drop("__part", "__before"), "ranked")


def with_targets(sources: DataFrame, share: float, epochs: float) -> DataFrame:
    """Adds target. Each round is one aggregate; a round that caps no further source is the last."""
    cap = F.col("source_size") * F.lit(epochs)
    total, level, capped = None, 0.0, -1
    while True:
        over = cap < F.col("weight") * F.lit(level)
        row = sources.agg(F.sum("source_size").alias("words"), F.sum(F.when(over, cap).otherwise(0.0)).alias("fixed"), F.sum(F.when(~over, F.col("weight")).otherwise(0.0)).alias("open"), F.count_if(over).alias("n")).first()
        if not row["words"] or row["n"] == capped or not row["open"]:
            break
        total = row["words"] * share if total is None else total
        level, capped = (total - row["fixed"]) / row["open"], row["n"]
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)).cast("double"))


def with_quotas(sources: DataFrame, block_words: int) -> DataFrame:
    """Adds blocks: seats of a source among round(sum of targets / block_words), by highest quotients, ties by rank."""
    facts = sources.agg(F.sum("target").alias("t"), F.max("target").alias("m"), F.count_if(F.col("target") > 0).alias("n"), F.max("rank").alias("last")).first()
    seats = round((facts["t"] or 0.0) / block_words)
    above = lambda d: F.when(F.col("target") > 0, F.greatest(F.ceil(F.col("target") / F.lit(d) + 0.5) - 1, F.lit(0))).otherwise(0).cast("long")  # noqa: E731  seats with a quotient over d
    if not seats:
        return sources.withColumn("blocks", F.lit(0).cast("long"))
    low, n_high = facts["t"] / (seats + facts["n"] / 2 + 1), 0
    high = 2 * facts["m"] + 1  # no seat above
    for _ in range(16):
        if n_high == seats or math.nextafter(low, high) >= high:
            break
        tries = [low + (high - low) * k / 32 for k in range(1, 32)]
        counts = sources.agg(*[F.sum(above(d)).alias(f"c{k}") for k, d in enumerate(tries)]).first()
        enough = [d for k, d in enumerate(tries) if counts[k] > seats]
        few = [(d, counts[k]) for k, d in enumerate(tries) if counts[k] <= seats]
        low = max([low, *enough])
        if few:
            high, n_high = min(few)
    sure = sources.withColumn("__sure", above(high)).withColumn("__more", above(low) - above(high))
    if n_high == seats:
        return sure.withColumn("blocks", F.col("__sure")).drop("__sure", "__more")
    # quotients that no double separates are ties: the sources that rank first take the seats left. The rank where they run out
    # is searched by aggregates, so that many equal sources meet in no task
    left, low, below, high = seats - n_high, 0, 0, facts["last"] + 1
    while high - low > 1:
        tries = list(range(low + max(1, (high - low) // 32), high, max(1, (high - low) // 32)))
        counts = sure.agg(*[F.sum(F.when(F.col("rank") < r, F.col("__more")).otherwise(0)).alias(f"c{k}") for k, r in enumerate(tries)]).first()
        low, below = max([(low, below), *[(r, counts[k]) for k, r in enumerate(tries) if counts[k] <= left]])
        high = min([high, *[r for k, r in enumerate(tries) if counts[k] > left]])
    won = F.when(F.col("rank") < low, F.col("__more")).when(F.col("rank") == low, F.least(F.col("__more"), F.lit(left - below))).otherwise(0)
    return sure.withColumn("blocks", (F.col("__sure") + won).cast("long")).drop("__sure", "__more")


def shard_quotas(sizes: DataFrame, sources: DataFrame, block_words: int, range_rows: int) -> tuple[DataFrame, DataFrame]:
    """(sources with passes and cut: a document is taken passes times, once more if its order hash is <= cut, but for swap;
    quotas of each source and shard: words, words_before, rest, blocks)."""
    rows = sources.agg(F.sum("n_docs").alias("n")).first()["n"] or 0
    n_ranges = max(1, math.ceil(rows / max(range_rows, math.isqrt(rows))))
    spend = F.least(F.col("blocks") * F.lit(block_words), F.col("source_size") * 2)
    passes = F.when(F.col("source_size") > 0, F.floor(spend / F.col("source_size"))).otherwise(0).cast("long")
    plan = materialize(sources.withColumn("passes", passes).withColumn("rest", (spend - passes * F.col("source_size")).cast("long")), "plan")

    shard = F.floor((F.col("h") / F.lit(2.0**64) + F.lit(0.5)) * F.lit(n_ranges)).cast("long")
    sharded = sizes.withColumn("shard", shard)
    sums = sharded.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.max("h").alias("last_h"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quotas = materialize(lookup_join(sums.withColumn("words_before", before), plan.select("source", "rest"), "source").withColumn("blocks", F.ceil(F.greatest(F.lit(0), F.least("words", F.col("rest") - F.col("words_before"))) / F.lit(block_words)).cast("long")), "quotas")

    allotted = F.col("blocks") * F.lit(block_words)
    whole = quotas.filter((F.col("words") > 0) & (allotted >= F.col("words"))).groupBy("source").agg(F.max("last_h").alias("cut"))
    some = quotas.filter((F.col("blocks") > 0) & (allotted < F.col("words")))
    edge = materialize(some.select(F.col("source").alias("__s"), F.col("shard").alias("__k"), allotted.alias("__allotted")), "edge")
    edge = F.broadcast(edge) if is_small(edge) else edge  # one row a source at most
    at_edge = sharded.join(edge, F.col("source").eqNullSafe(F.col("__s")) & (F.col("shard") == F.col("__k")))
    upto = F.sum("size").over(Window.partitionBy("source", "shard").orderBy("h"))
    own = F.sum("size").over(Window.partitionBy("source", "shard", "h"))
    partly = at_edge.withColumn("middle", upto - own / 2).filter("middle < __allotted").groupBy("source").agg(F.max("h").alias("cut"))
    cuts = materialize(whole.unionByName(partly).groupBy("source").agg(F.max("cut").alias("cut")), "cuts")
    return _swapped(sizes, materialize(lookup_join(plan, cuts, "source"), "cut-plan")), quotas


def _swapped(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds swap: the order hash of the one document per source whose change of side leaves the smallest gap to the quota."""
    groups = materialize(lookup_join(sizes.groupBy("source", "h").agg(F.sum("size").alias("size")), plan.select("source", "rest", "cut"), "source").withColumn("__in", F.coalesce(F.col("h") <= F.col("cut"), F.lit(False))), "groups")
    gaps = materialize(groups.groupBy("source").agg((F.first("rest") - F.sum(F.when(F.col("__in"), F.col("size")).otherwise(0))).alias("gap")), "gaps")
    left = F.abs(F.col("gap") + F.when(F.col("__in"), F.col("size")).otherwise(-F.col("size")))
    best = lookup_join(groups.filter("rest > 0"), gaps, "source").withColumn("__left", left).filter("__left < abs(gap)").groupBy("source").agg(F.min_by("h", F.struct("__left", "h")).alias("swap"))
    return materialize(lookup_join(plan, materialize(best, "swaps"), "source"), "mix")


def plan_mix(docs: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, epochs: float = 2.0, block_words: int = BLOCK_WORDS, seed: int = SEED, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes: doc_id, source, size, h; sources with target, blocks, passes, cut; quotas by source and shard)."""
    sizes = materialize(docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), _order_hash(seed).alias("h")), "sizes")
    sources = with_targets(ranked_sources(sizes, weights), share, epochs)
    sources = materialize(with_quotas(sources, block_words), "seats")
    sources, quotas = shard_quotas(sizes, sources, block_words, range_rows)
    return sizes, sources, quotas


def _copies():
    first = F.coalesce(F.col("__h") <= F.col("__cut"), F.lit(False))
    return F.col("__passes") + (first != F.coalesce(F.col("__h") == F.col("__swap"), F.lit(False))).cast("int")


def _with_plan(rows: DataFrame, sources: DataFrame) -> DataFrame:
    side = sources.select("source", F.col("passes").alias("__passes"), F.col("cut").alias("__cut"), F.col("swap").alias("__swap"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    return lookup_join(rows, side, "source")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    sizes, sources, _ = plan_mix(docs, **options)
    rows = _with_plan(sizes.withColumnRenamed("h", "__h"), sources)
    return rows.select("doc_id", "size", F.col("__source_size").cast("long").alias("source_size"), F.col("__target").alias("target"), (_copies() * F.col("size")).cast("long").alias("taken"))


@sheltering
def mix(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it. The plan reaches the rows by a checked broadcast, so texts aren't shuffled."""
    columns = docs.columns
    _, sources, _ = plan_mix(docs, **options)
    worded = docs.filter(F.coalesce(F.regexp(F.col("text"), F.lit(WORD)), F.lit(False)))
    rows = _with_plan(worded.withColumn("__h", _order_hash(options.get("seed", SEED))), sources)
    return rows.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), _copies().cast("int")))).select(*[F.col(f"`{c}`") for c in columns])
