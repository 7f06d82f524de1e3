"""Linking within buckets and connected groups, without pairing a bucket's members off.

Nothing here is gathered: a hot bucket or a node with very many links is spread over tasks by
partial aggregation and by joins that Spark may split.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.lineage import stored
from scriptorium.llm.membership import present

#: Members of a bucket that are compared with each other in one task.
TILE = 256


#: Rows of a few integers that are sent to all tasks rather than shuffled.
BROADCAST_ROWS = 1 << 19


def sent(rows: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``keyed``, of which few rows go to all tasks and many are shuffled."""
    return rows.join(F.broadcast(keyed) if keyed.count() <= BROADCAST_ROWS else keyed, key)


def sides(pairs: DataFrame, values: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pairs ``(a, b)`` with columns ``names`` of ``values(id, ...)`` for both, as ``x_a`` and ``x_b``.

    Only the values that pairs need are shuffled, by pair.
    """
    keyed = stored(pairs.select(F.explode(F.array("a", "b")).alias("id"), "a", "b"))
    one = lambda n, side: F.max(F.when(F.col("id") == F.col(side), F.col(n))).alias(f"{n}_{side}")
    return sent(values.select("id", *names), keyed, "id").groupBy("a", "b").agg(*[one(n, s) for n in names for s in "ab"])


def tiles(members: DataFrame, heavy: float, weights: DataFrame) -> DataFrame:
    """``(id, root, bucket, one, two)``: buckets cut into tiles, every two of which meet.

    A tile holds about ``TILE`` members and about ``heavy`` of what ``weights(id, n)`` sums up.
    """
    held = stored(members.join(weights, "id"))
    share = F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / F.lit(heavy))).cast("int")
    counts = stored(held.groupBy("bucket").agg(share.alias("tiles")))
    own = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    placed = held.join(counts, "bucket").withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    return stored(
        placed.select("id", "root", "bucket", "own", other.alias("other")).select(
            "id", "root", "bucket", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two")
        )
    )


def _star(links: DataFrame) -> DataFrame:
    """Hang every neighbour of a node that is larger than it under the node's least neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")))
    hung = both.where("b > a").join(least, "a").select(F.col("root").alias("a"), "b").where("a <> b")
    return stored(hung.distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Hang every node and its lesser neighbours under the least of them. Links have a < b."""
    least = stored(links.groupBy("b").agg(F.min("a").alias("root")))
    others = links.join(least, "b").where("a <> root").select(F.col("root").alias("a"), F.col("a").alias("b"))
    return stored(others.unionByName(least.select(F.col("root").alias("a"), "b")).distinct())


def components(links: DataFrame) -> DataFrame:
    """``(id, root)`` for every node of ``links(a, b)``; the root is the group's least node.

    Alternates the two star operations until the links are stars. The rounds grow with the
    logarithm of the longest chain.
    """
    current = stored(
        links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    while not _are_stars(current):
        current = _small_star(_star(current))
    roots = current.select(F.col("b").alias("id"), F.col("a").alias("root"))
    return stored(roots.unionByName(current.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct()))


def _are_stars(links: DataFrame) -> bool:
    """Whether no node hangs under two others, or under one while another hangs under it."""
    parents = links.select(F.col("a").alias("id"), F.lit(1).alias("above"), F.lit(0).alias("below"))
    children = links.select(F.col("b").alias("id"), F.lit(0).alias("above"), F.lit(1).alias("below"))
    roles = parents.unionByName(children).groupBy("id").agg(F.max("above").alias("above"), F.sum("below").alias("below"))
    return roles.where("above + below > 1").isEmpty()


@dataclass(frozen=True)
class Comparison:
    """How candidates are compared.

    ``verify`` turns pairs ``(a, b)``, a < b, into those that hold. ``across`` turns the members
    ``(bucket, id, root)`` of buckets into pairs that hold and join, directly or by others, all
    roots that some pair of a bucket's members joins; without it the pairs are made and verified.
    """

    verify: Callable[[DataFrame], DataFrame]
    across: Callable[[DataFrame], DataFrame] | None = None


def linked(buckets: DataFrame, prepare: Callable[[DataFrame], Comparison]) -> DataFrame:
    """``(id, root)`` of ids that verified pairs connect, for distinct ``(bucket, id)`` pairs.

    First one member of every bucket is compared with the others: the one that meets most others
    over all buckets, which is mostly what the rest was copied from. That joins nearly all of
    what belongs together by a comparison each. Then, in buckets where several groups remain,
    all pairs that lie in different groups are compared, so that no link between groups is lost.

    ``prepare`` gets the ids that share a bucket with another.
    """
    sizes = stored(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    return linked_meeting(stored(present(buckets, "bucket", sizes.select("bucket")).join(sizes, "bucket")), prepare)


def linked_meeting(meeting: DataFrame, prepare: Callable[[DataFrame], Comparison]) -> DataFrame:
    """``linked`` for a stored table ``(bucket, id, n)`` of the buckets that hold several ids, n of them."""
    degree = stored(meeting.groupBy("id").agg(F.sum("n").alias("degree")))
    comparison = prepare(degree.select("id"))
    members = stored(meeting.select("bucket", "id").join(degree, "id"))
    lead = stored(
        members.groupBy("bucket").agg(F.max(F.struct("degree", "id")).alias("lead")).select("bucket", F.col("lead.id").alias("lead"))
    )
    first = members.join(lead, "bucket").where("id <> lead")
    pairs = stored(first.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct())
    roots = components(comparison.verify(pairs).select("a", "b"))
    placed = stored(members.join(roots, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root")))
    # One bucket for each set of members; two members alone have been compared.
    open_ = placed.groupBy("bucket").agg(
        F.min("root").alias("low"),
        F.max("root").alias("high"),
        F.count("*").alias("n"),
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("set"),
    )
    chosen = stored(
        open_.where("low <> high and n > 2").groupBy("n", "set").agg(F.min("bucket").alias("bucket")).select("bucket")
    )
    if chosen.isEmpty():
        return roots
    more = comparison.across(placed.join(chosen, "bucket").select("bucket", "id", "root"))
    known = roots.where("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b"))
    return components(more.unionByName(known))
