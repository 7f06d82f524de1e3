"""Access to the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.sources import text as T


def spread(frame: DataFrame) -> DataFrame:
    """A scan of fewer splits than cores, dealt out over all cores.

    A small table may sit in one row group, which one task would read and then process
    alone. A scan with enough splits, as any large table has, is left as it is.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a paragraph."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return T.text_paragraphs(spread(documents))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as a paragraph."""
    return T.turn_paragraphs(table(spark, sf_dir, "conversations"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "html"))
