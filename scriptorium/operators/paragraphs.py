"""Paragraph listings, joined text, counts, and first-wins views of the hub table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.operators.carry import CHUNK, assemble, attach
from scriptorium.schema import check_page


def page(paragraphs: DataFrame, start: int = 0, limit: int | None = None) -> DataFrame:
    """Paragraphs ``start .. start + limit`` of every document.

    A range predicate on the ordinal, so it is pushed to the scan; no sort, no offset.
    """
    check_page(start, limit)
    kept = paragraphs.where(F.col("idx") >= start)
    return kept if limit is None else kept.where(F.col("idx") < start + limit)


def counts(paragraphs: DataFrame) -> DataFrame:
    """Paragraph and character counts per document; partial aggregation absorbs skew."""
    return paragraphs.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("paragraph_count"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("character_count"),
    )


def info(paragraphs: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Counts per document and, for packages, the part names in archive order."""
    result = counts(paragraphs)
    if parts is None:
        return result
    # The entries of an archive, whose directory one task has read.
    names = parts.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "part"))).alias("_parts")
    )
    return result.join(names, "doc_id", "left").select(
        "doc_id", "paragraph_count", "character_count", F.col("_parts.part").alias("parts")
    )


def listed(paragraphs: DataFrame, start: int = 0, limit: int | None = None) -> DataFrame:
    """A page of paragraphs with the document's total paragraph count."""
    totals = paragraphs.groupBy("doc_id").agg(
        F.count(F.lit(1)).cast("int").alias("total_paragraphs"),
        (F.max("idx") + 1).alias("_ordinals"),
    )
    return attach(page(paragraphs, start, limit), totals, ["doc_id"], "idx", "_ordinals").drop(
        "_ordinals"
    )


def joined_text(
    paragraphs: DataFrame, start: int = 0, limit: int | None = None, chunk: int = CHUNK
) -> DataFrame:
    """The texts of a page of paragraphs joined by line ends, in ordered pieces."""
    kept = page(paragraphs, start, limit).withColumn("_at", F.col("idx") - start)
    return assemble(kept, ["doc_id"], "_at", F.col("text"), "\n", chunk=chunk)


def first_by(frame: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The row with the smallest ``order`` per key, as a partial aggregate."""
    picked = F.min_by(F.struct(*values), F.col(order)).alias("_first")
    return frame.groupBy(*keys).agg(picked).select(*keys, "_first.*")


def escaped_markdown(paragraphs: DataFrame, in_table: bool = False) -> DataFrame:
    return paragraphs.select("doc_id", "idx", X.md_escape(F.col("text"), in_table).alias("text"))


def invalid_texts(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs that XML cannot hold."""
    return paragraphs.where(~X.valid_xml_text(F.col("text"))).select("doc_id", "idx")
