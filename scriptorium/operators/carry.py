"""Running sums and per-document lookups that never gather one document in one task.

A document may hold a large share of all rows, so a plain window partitioned by
document would run in one task. The helpers here cut every document into chunks of
consecutive ordinals. Only one small row per chunk is ever windowed over the whole
document; the rows themselves are windowed or joined per (document, chunk).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Consecutive ordinals handled together.
CHUNK = 8192
#: Width, in UTF-16 units, of the buckets of an interval join.
BUCKET = 4096


def chunk_of(order: Column | str, size: int = CHUNK) -> Column:
    """The chunk holding ordinal ``order``."""
    order = F.col(order) if isinstance(order, str) else order
    return F.floor(order / F.lit(size)).cast("int")


def running_sums(
    frame: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Mapping[str, Column],
    totals: Mapping[str, str] | None = None,
    chunk: int | None = CHUNK,
) -> DataFrame:
    """Add exclusive running sums of ``values`` per ``keys`` in ``order``.

    ``totals`` maps a value name to the name of an extra column holding the value's sum
    over the whole key. With ``chunk=None`` one window per key is used,
    so a key's rows meet in one task, which spills what it cannot hold.
    """
    totals = totals or {}
    if chunk is None:
        before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        whole = W.partitionBy(*keys)
        return frame.withColumns(
            {name: F.coalesce(F.sum(v).over(before), F.lit(0)) for name, v in values.items()}
            | {out: F.sum(values[name]).over(whole) for name, out in totals.items()}
        )
    chunked = frame.withColumn("_chunk", chunk_of(order, chunk))
    sums = chunked.groupBy(*keys, "_chunk").agg(
        *[F.sum(v).alias(f"_sum_{name}") for name, v in values.items()]
    )
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    bases = sums.select(
        *keys,
        "_chunk",
        *[
            F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_base_{name}")
            for name in values
        ],
        *[F.sum(f"_sum_{name}").over(whole).alias(out) for name, out in totals.items()],
    )
    local = W.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    joined = chunked.join(bases, [*keys, "_chunk"])
    return joined.withColumns(
        {
            name: F.col(f"_base_{name}") + F.coalesce(F.sum(v).over(local), F.lit(0))
            for name, v in values.items()
        }
    ).drop("_chunk", *[f"_base_{name}" for name in values])


def attach(
    frame: DataFrame,
    per_document: DataFrame,
    keys: Sequence[str],
    order: str,
    count: str,
    how: str = "inner",
    chunk: int = CHUNK,
) -> DataFrame:
    """Join one row per document to the document's rows without skew.

    ``per_document`` holds ``count``, the number of ordinals of the document, so its rows
    can be repeated once per chunk and joined on (document, chunk).
    """
    last = F.greatest(F.lit(0), F.floor((F.col(count) - 1) / F.lit(chunk)).cast("int"))
    spread = per_document.withColumn("_chunk", F.explode(F.sequence(F.lit(0), last)))
    return (
        frame.withColumn("_chunk", chunk_of(order, chunk))
        .join(spread, [*keys, "_chunk"], how)
        .drop("_chunk")
    )


def assemble(
    frame: DataFrame,
    keys: Sequence[str],
    order: str,
    fragment: Column,
    separator: str = "",
    out: str = "text",
    chunk: int = CHUNK,
) -> DataFrame:
    """Concatenate fragments in order, in pieces of at most ``chunk`` ordinals.

    A document of up to ``chunk`` ordinals is one piece (``piece = 0``). The pieces of a
    longer one, concatenated in order, are the whole text, so no group is unbounded.
    """
    cut = frame.select(
        *keys,
        chunk_of(order, chunk).alias("piece"),
        F.struct(F.col(order).alias("o"), fragment.alias("f")).alias("_item"),
    )
    lead = F.when(F.col("piece") > 0, F.lit(separator)).otherwise(F.lit(""))
    return (
        cut.groupBy(*keys, "piece")
        .agg(F.array_sort(F.collect_list("_item")).alias("_items"))
        .select(
            *keys,
            "piece",
            F.concat(lead, F.array_join(F.col("_items.f"), separator)).alias(out),
        )
    )


def overlap_join(
    spans: DataFrame,
    ranges: DataFrame,
    keys: Sequence[str],
    span: tuple[str, str] = ("start", "end"),
    wanted: tuple[str, str] = ("lo", "hi"),
    how: str = "inner",
    bucket: int = BUCKET,
) -> DataFrame:
    """Pairs of spans ``[start, end)`` and ranges ``[lo, hi)`` that overlap.

    Both sides are cut into fixed position buckets and joined on (keys, bucket), so the
    pairs examined stay local and a large document spreads over many tasks. A pair seen in
    several buckets is kept only in the first one they share. An empty range counts as the
    single position ``lo``.
    """
    start, end = (F.col(name) for name in span)
    lo, hi = F.col(wanted[0]), F.greatest(F.col(wanted[1]), F.col(wanted[0]) + 1)

    def buckets(first: Column, stop: Column) -> Column:
        return F.explode(
            F.sequence(
                F.floor(first / bucket).cast("int"),
                F.floor(F.greatest(stop - 1, first) / bucket).cast("int"),
            )
        )

    left = spans.withColumn("_bucket", buckets(start, end))
    right = ranges.withColumn("_bucket", buckets(lo, hi))
    pairs = left.join(right, [*keys, "_bucket"], how)
    first_shared = F.floor(F.greatest(start, lo) / bucket).cast("int")
    return pairs.where((start < hi) & (end > lo) & (F.col("_bucket") == first_shared)).drop(
        "_bucket"
    )
