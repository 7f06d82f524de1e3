"""Append-only versions: snapshots, reading as of a version, conflicts, restoring.

A versioned table is a paragraph table with an integer ``version``. Nothing is updated in
place; saving appends, and saving an unchanged document appends nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.carry import attach
from scriptorium.operators.diff import heads
from scriptorium.schema import check


def snapshot(paragraphs: DataFrame, version: int) -> DataFrame:
    """The current paragraphs as rows of a versioned table."""
    check(version >= 0, "version must not be negative")
    return paragraphs.withColumn("version", F.lit(version))


def latest(versioned: DataFrame, version: int | None = None) -> DataFrame:
    """Per document: its newest version (up to ``version``) and the size of that version."""
    seen = versioned if version is None else versioned.where(F.col("version") <= version)
    sizes = seen.groupBy("doc_id", "version").agg((F.max("idx") + 1).alias("size"))
    newest = F.max_by(F.struct("version", "size"), "version").alias("_h")
    return sizes.groupBy("doc_id").agg(newest).select("doc_id", "_h.version", "_h.size")


def as_of(versioned: DataFrame, version: int | None = None) -> DataFrame:
    """Every document as it was at ``version``."""
    wanted = latest(versioned, version)
    seen = versioned if version is None else versioned.where(F.col("version") <= version)
    # The version is part of the join key, so older rows never match.
    return attach(seen, wanted, ["doc_id", "version"], "idx", "size").drop("size")


def save(versioned: DataFrame, edited: DataFrame) -> DataFrame:
    """The rows to append: edited documents that really changed, as their next version."""
    current = as_of(versioned)
    bases = latest(versioned).select("doc_id", F.col("version").alias("_base"))
    changed = (
        heads(current, edited)
        .where("changed and n_new > 0")
        .join(bases, "doc_id", "left")
        .select("doc_id", "n_new", (F.coalesce("_base", F.lit(-1)) + 1).alias("version"))
    )
    plain = edited.drop("version") if "version" in edited.columns else edited
    return attach(plain, changed, ["doc_id"], "idx", "n_new").drop("n_new")


def restore(versioned: DataFrame, version: int) -> DataFrame:
    """The rows to append so that every document is again as it was at ``version``."""
    return save(versioned, as_of(versioned, version).drop("version"))


def conflicts(edits: DataFrame, versioned: DataFrame) -> DataFrame:
    """Edits made on a version (``base_version``) that is no longer the newest one."""
    current = latest(versioned).select("doc_id", F.col("version").alias("current_version"))
    return (
        edits.join(current, "doc_id", "left")
        .where(~F.col("base_version").eqNullSafe(F.col("current_version")))
        .withColumn("reason", F.lit("another version came in between"))
    )


def changed_since(base: DataFrame, current: DataFrame) -> DataFrame:
    """Documents whose content is no longer exactly that of ``base``."""
    return heads(base, current).where("changed").select("doc_id")
