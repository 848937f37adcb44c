"""Merkle manifest of a dataset: a digest for each row, source and the whole, and proofs that single rows belong to it.

Rows are leaves; each source has a tree, in which 16 consecutive nodes have one parent until a single node remains, and
the sources' roots, in order, have such a tree again. A node is labelled by the interval of leaf ranks that it covers. A
level's intervals start at multiples of 16^level, so the parent of a node is found by an equality (source and interval start in the
parent's bucket) and containment; its siblings are the parent's interval less its own. Each level has a sixteenth of the rows of the
one below, and only the parents of leaves carry the ways to the root; leaves read them inside their parent's row.

Ranks come from ranges: rows are range-partitioned by source and id, counted by partition and source, and placed by sums of these
counts, so that no source, however large, is numbered in one task.

Nulls: every field may be null and is then `-`; null sources are one source, before all others; null ids come first. Rows with the
same id are ordered by their digest; equal rows have the same leaf, and each its place. Empty tables have no rows (and no root).
Long texts are hashed whole, where they are read; digests alone are shuffled. Extra columns aren't part of leaves and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.llm.common import is_small, lookup_join, materialize

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(fields: list[Column]) -> Column:
    """The digest of a row's fields, each with its length in bytes before it."""
    texts = [c.cast("string") for c in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with lo, their rank (from 0) in their group, and hi, one more. Null groups are one. The result is written, so that ranks stay as they are."""
    placed = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("__row", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("__part", F.shiftright("__row", 33)), "ranked")
    # a group is contiguous in each partition that has rows of it; there are as many pairs as partitions and groups together, at most
    runs = placed.groupBy("__part", group).agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(group).orderBy("__part")) - F.col("__n")
    runs = materialize(runs.select(F.col("__part").alias("__p"), F.col(group).alias("__g"), (before - F.col("__first")).alias("__shift")), "runs")
    side = F.broadcast(runs) if is_small(runs) else runs
    rank = F.col("__row") + F.col("__shift")
    found = placed.join(side, (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g")))
    return found.select(*rows.columns, rank.alias("lo"), (rank + 1).alias("hi"))


def _parents(nodes: DataFrame, group: str, level: int) -> DataFrame:
    """The nodes of a level: interval lo..hi of leaf ranks, digest, and the members below, at most FAN, in order."""
    member = F.struct("lo", "hi", "digest", *[c for c in nodes.columns if c not in (group, "lo", "hi", "digest")])
    runs = nodes.groupBy(group, _bucket("lo", level).alias("bucket")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    joined = F.array_join(F.transform("members", lambda m: m.digest), "")
    return runs.select(group, F.col("members")[0].lo.alias("lo"), F.element_at("members", -1).hi.alias("hi"), digest(joined).alias("digest"), "members")


def _bucket(lo: str, level: int) -> Column:
    return F.floor(F.col(lo) / F.lit(FAN**level)).cast("long")


def tree(leaves: DataFrame, group: str) -> tuple[list[DataFrame], DataFrame]:
    """(levels, roots) of leaves: group, lo, hi, digest and what else they carry.

    levels: from the leaves' parents up, each with the nodes of the groups that still had several; written. roots: group, lo, hi, digest.
    """
    levels: list[DataFrame] = []
    roots, nodes = [], leaves
    while True:
        # ranks begin at 0, so a group has several nodes if one begins later
        several = materialize(nodes.groupBy(group).agg((F.max("lo") > 0).alias("__several")), "groups")
        marked = lookup_join(nodes, several, group)
        roots.append(marked.filter(~F.col("__several")).select(group, "lo", "hi", "digest"))
        if several.filter("__several").isEmpty():
            break
        levels.append(materialize(_parents(marked.filter("__several").drop("__several"), group, len(levels) + 1), "level"))
        nodes = levels[-1].drop("members")
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return levels, materialize(out, "roots")


def _beside(members: Column, lo: Column, hi: Column) -> Column:
    """The siblings of lo..hi: what the parent's interval has before and after it, as digests in order."""
    before = F.array_join(F.transform(F.filter(members, lambda m: m.hi <= lo), lambda m: m.digest), "")
    after = F.array_join(F.transform(F.filter(members, lambda m: m.lo >= hi), lambda m: m.digest), "")
    return F.array(F.struct(before.alias("before"), after.alias("after")))


def _to_group(nodes: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """Nodes that are their group's root, with what groups (group, n: its leaves, and more) say."""
    side = F.broadcast(groups) if _small(groups) else groups
    side = side.withColumnRenamed(group, "__g")
    return nodes.join(side, F.col(group).eqNullSafe(F.col("__g")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n"))).drop("__g", "n")


def _small(table: DataFrame) -> bool:
    """is_small, nested columns included."""
    return is_small(table.select(F.to_json(F.struct(*table.columns)).alias("row")))


def with_ways(levels: list[DataFrame], groups: DataFrame, group: str) -> DataFrame:
    """The parents of leaves (the first of levels: group, lo, hi, members) with what groups say of their group (group, n, way and more). way becomes the
    siblings on the way up, the node's own first: pairs of what stands before and after.

    From the top level down each node meets its parent: the node one level up whose bucket its interval begins in and whose interval holds its own.
    """
    above = None
    for level in range(len(levels), 0, -1):
        nodes = levels[level - 1].select(group, "lo", "hi", "members")
        found = _to_group(nodes, groups, group)
        if above is not None:
            parents = above.select(F.col(group).alias("__g"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), F.col("members").alias("__members"), "way", *[c for c in groups.columns if c not in (group, "n", "way")])
            parents = parents.withColumn("__bucket", _bucket("__lo", level + 1))
            inside = (F.col("lo") >= F.col("__lo")) & (F.col("hi") <= F.col("__hi"))
            below = nodes.join(parents, F.col(group).eqNullSafe(F.col("__g")) & (_bucket("lo", level + 1) == F.col("__bucket")) & inside)
            way = F.concat(_beside(F.col("__members"), F.col("lo"), F.col("hi")), "way")
            found = found.unionByName(below.withColumn("way", way).select(*found.columns))
        above = found
    return above


def _leaf_rows(parents: DataFrame, carried: list[str], group: str, extra: list[str]) -> DataFrame:
    """Leaves out of their parents' rows, with their ways. What is wide stays in the row until results are made of it."""
    member = F.explode("members").alias("m")
    rows = parents.select(group, *extra, "members", "way", member)
    way = F.concat(_beside(F.col("members"), F.col("m.lo"), F.col("m.hi")), "way")
    return rows.select(group, *extra, F.col("m.lo").alias("lo"), F.col("m.digest").alias("digest"), *[F.col(f"m.{c}").alias(c) for c in carried], way.alias("way"))


def fold(leaf_digest: Column, way: Column) -> Column:
    """The root that a leaf and its way give."""
    return F.aggregate(way, leaf_digest, lambda below, s: digest(F.concat(s.before, below, s.after)))


def proof_digest(way: Column) -> Column:
    return digest(F.array_join(F.transform(way, lambda s: F.concat(s.before, s.after)), ""))


_NO_WAY = "CAST(array() AS array<struct<before: string, after: string>>)"


def manifest(docs: DataFrame, text_now: Column | None = None) -> DataFrame:
    """One row for each of docs (doc_id, source, lang, n_chars, text): doc_id, source, leaf_rank, leaf, subroot, root, way and leaf_now.

    way: the siblings on the way from leaf to root, as pairs of the digests before and after. text_now: the text as it is found now, of which
    leaf_now is the leaf; without it, or where it is as it was, leaf_now is the leaf.
    """
    fields = [F.col(c) for c in FIELDS]
    now = leaf([*fields[:-1], text_now]) if text_now is not None else F.lit(None).cast("string")
    changed = ~F.col("text").eqNullSafe(text_now) if text_now is not None else F.lit(False)
    slim = docs.select("doc_id", "source", leaf(fields).alias("digest"), F.when(changed, now).alias("now"))
    leaves = ranked(materialize(slim, "leaves"), "source", ["doc_id", "digest"])
    levels, subroots = tree(leaves, "source")

    numbered = ranked(subroots.select("source", F.col("hi").alias("n"), F.col("digest"), F.lit(0).alias("all")), "all", ["source"])
    top_levels, top = tree(numbered, "all")
    root = top.first()  # a single row, or none
    whole = top.select("all", F.col("hi").alias("n"), F.expr(_NO_WAY).alias("way"))
    if top_levels:
        sources = _leaf_rows(with_ways(top_levels, whole, "all"), ["source", "n"], "all", []).select("source", "n", F.col("digest").alias("subroot"), "way")
    else:
        sources = numbered.select("source", "n", F.col("digest").alias("subroot"), F.expr(_NO_WAY).alias("way"))
    sources = materialize(sources, "sources")

    columns = ["source", "subroot", "lo", "digest", "doc_id", "now", "way"]
    rows = _to_group(leaves, sources, "source").select(*columns)  # sources of one row
    if levels:
        rows = rows.unionByName(_leaf_rows(with_ways(levels, sources, "source"), ["doc_id", "now"], "source", ["subroot"]).select(*columns))
    return rows.select(
        "doc_id", "source", F.col("lo").alias("leaf_rank"), F.col("digest").alias("leaf"), "subroot", F.lit(root.digest if root else None).cast("string").alias("root"), "way", F.coalesce("now", "digest").alias("leaf_now")
    )


def verified(docs: DataFrame, text_now: Column | None = None) -> DataFrame:
    """manifest's rows with the digest of their proof instead of the proof, the root that leaf_now and the proof give, and whether it is the root."""
    found = manifest(docs, text_now).withColumn("proof_sha256", proof_digest(F.col("way"))).withColumn("folded_root", fold(F.col("leaf_now"), F.col("way")))
    return found.drop("way").withColumn("verified", F.col("folded_root") == F.col("root"))
