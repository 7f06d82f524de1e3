"""Character positions: UTF-16 units in the story, one unit per paragraph mark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.operators.carry import CHUNK, assemble, overlap_join, running_sums
from scriptorium.schema import check


def positions(paragraphs: DataFrame, chunk: int | None = CHUNK) -> DataFrame:
    """Add ``start``, exclusive ``end`` and ``story_end`` to every paragraph."""
    width = X.utf16_length(F.col("text")) + 1
    placed = running_sums(
        paragraphs, ["doc_id"], "idx", {"start": width}, {"start": "story_end"}, chunk
    )
    return placed.withColumns(
        {
            "start": F.col("start").cast("int"),
            "end": (F.col("start") + width).cast("int"),
            "story_end": F.col("story_end").cast("int"),
        }
    )


def clip(start: Column, stop: Column) -> Column:
    """The part of a paragraph (with its mark) inside ``[start, stop)`` of the story."""
    return X.utf16_slice(
        F.concat("text", F.lit("\r")),
        F.greatest(start - F.col("start"), F.lit(0)),
        F.least(stop, F.col("end")) - F.col("start"),
    )


def text_slice(
    paragraphs: DataFrame, start: int | None = None, end: int | None = None, chunk: int = CHUNK
) -> DataFrame:
    """Story text between two positions of every document, in ordered pieces.

    A document that is shorter than the range yields one row with a ``reason``.
    """
    check(
        (start is None or start >= 0)
        and (end is None or end >= 0)
        and (start is None or end is None or start <= end),
        "range must satisfy 0 <= start <= end",
    )
    placed = positions(paragraphs, chunk)
    lo = F.lit(start or 0)
    hi = F.col("story_end") if end is None else F.lit(end)
    outside = (hi > F.col("story_end")) | (lo > F.col("story_end"))
    inside = placed.where(~outside & (lo < hi) & (F.col("start") < hi) & (F.col("end") > lo))
    texts = assemble(inside, ["doc_id"], "idx", clip(lo, hi), chunk=chunk).withColumn(
        "reason", F.lit(None).cast("string")
    )
    refused = placed.where((F.col("idx") == 0) & outside).select(
        "doc_id",
        F.lit(0).alias("piece"),
        F.lit(None).cast("string").alias("text"),
        F.lit("range is outside the main story").alias("reason"),
    )
    # A range that covers no unit is empty text, not a missing row.
    empty = placed.where((F.col("idx") == 0) & ~outside & (lo >= hi)).select(
        "doc_id",
        F.lit(0).alias("piece"),
        F.lit("").alias("text"),
        F.lit(None).cast("string").alias("reason"),
    )
    return texts.unionByName(refused).unionByName(empty)


def ranges_text(placed: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Story text of per-document ranges ``[lo, hi)``, keyed by ``keys`` (with doc_id)."""
    pieces = overlap_join(placed, ranges.where("hi > lo"), ["doc_id"]).withColumn(
        "_f", clip(F.col("lo"), F.col("hi"))
    )
    return assemble(pieces, keys, "idx", F.col("_f"))


def paragraph_at(
    paragraphs: DataFrame, points: DataFrame, chunk: int | None = CHUNK
) -> DataFrame:
    """The paragraph holding each position: ``points(doc_id, position)`` gain ``idx``.

    An interval join on (document, position bucket); the end of the story counts as the
    last paragraph, and positions beyond it are left out.
    """
    placed = positions(paragraphs, chunk).select("doc_id", "idx", "start", "end", "story_end")
    # The last paragraph also answers for the position right after its mark.
    closed = F.when(F.col("end") == F.col("story_end"), F.col("end") + 1).otherwise(F.col("end"))
    wanted = points.withColumns({"lo": F.col("position"), "hi": F.col("position") + 1})
    return overlap_join(placed.withColumn("end", closed), wanted, ["doc_id"]).drop(
        "lo", "hi", "end", "story_end"
    )
