"""Change feed: every new version of a document is compared with its last snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.lineage import removed, scope, stored, swept
from scriptorium.operators.diff import described, hashed, new_places, old_places, places, rounds, texts_of
from scriptorium.sources.text import text_paragraphs


def document_lines(batch: DataFrame) -> DataFrame:
    """Arrived texts as paragraphs: ``(doc_id, version, idx, text)``."""
    keyed = batch.withColumn("_key", F.struct("doc_id", "version"))
    lines = text_paragraphs(keyed, "_key")
    return lines.select("doc_id.doc_id", "doc_id.version", "idx", "text")


def compare_batch(arrived: DataFrame, kept: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Changes of a batch of versions, and ``(doc_id, version)`` of the last version of each document.

    ``arrived(doc_id, version, idx, text)`` may hold several versions of a document; each is
    compared with the one before it, the first with the snapshots ``kept(doc_id, idx, text)``. All pairs
    are compared in one plan, keyed by document and place in the batch. The first version
    ever seen of a document is only stored. Texts take part as hashes; those of what differs are read again.
    """
    hashes = hashed(arrived)
    by_version = W.partitionBy("doc_id").orderBy("version")
    ranked = stored(
        hashes.select("doc_id", "version").distinct().select(
            "doc_id",
            "version",
            F.row_number().over(by_version).alias("_nth"),
            (F.lead("version").over(by_version).isNull()).alias("_last"),
        )
    )
    # One row per paragraph of every version that has arrived.
    own = stored(hashes.join(ranked, ["doc_id", "version"]).select("doc_id", "_nth", "idx", "text"), "zstd")
    before = own.select("doc_id", (F.col("_nth") + 1).alias("_nth"), "idx", "text")
    texts = arrived.select("doc_id", "idx", "text")
    if kept is not None:
        before = before.unionByName(hashed(kept).select("doc_id", F.lit(1).alias("_nth"), "idx", "text"))
        texts = texts.unionByName(kept)
    pairs = before.select("doc_id", "_nth").distinct()
    pair = F.concat_ws(":", "_nth", F.col("doc_id").cast("string"))
    names = stored(ranked.join(pairs, ["doc_id", "_nth"]).select(pair.alias("_pair"), "doc_id", "version"))

    def keyed(side: DataFrame) -> DataFrame:
        wanted = names.select(F.col("_pair").alias("_wanted"))
        return side.join(wanted, pair == F.col("_wanted"), "left_semi").select(pair.alias("doc_id"), "idx", "text")

    placed = places(stored(keyed(before), "zstd"), stored(keyed(own), "zstd"))
    placed = stored(placed.withColumnRenamed("doc_id", "_pair").join(names, "_pair").drop("_pair"), "zstd")
    found = texts_of(texts, old_places(placed).unionByName(new_places(placed)))
    return described(placed, found, found), ranked.where("_last").select("doc_id", "version")


def last_snapshots(snapshots: DataFrame, arrived: DataFrame) -> DataFrame:
    """The newest stored snapshot of each document that arrived."""
    ids = arrived.select("doc_id").distinct()
    newest = stored(snapshots.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("batch").alias("batch")))
    return snapshots.join(newest, ["doc_id", "batch"], "left_semi").select("doc_id", "idx", "text")


def stream_changes(
    arrivals: DataFrame,
    store: str,
    checkpoint: str,
    paragraphs: Callable[[DataFrame], DataFrame] = document_lines,
) -> StreamingQuery:
    """Start the feed over a stream of document versions ``(doc_id, version, ...)``.

    ``paragraphs`` turns a micro-batch into ``(doc_id, version, idx, text)``. Each batch
    writes ``changes/batch=N`` and ``snapshots/batch=N`` below ``store``, overwriting them when
    it is replayed after a failure and reading only earlier batches, so results are exactly
    once. Snapshots are append-only; the newest batch of a document counts. A batch is read
    several times rather than kept, which any source that can be replayed allows.
    """
    doc_type = arrivals.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, idx int, text string, batch bigint"

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with swept(spark), scope(spark) as folder:
            arrived, kept = paragraphs(batch), None
            if batch_id > 0:
                earlier = spark.read.schema(schema).parquet(f"{store}/snapshots").where(F.col("batch") < batch_id)
                kept = stored(last_snapshots(earlier, arrived), "zstd")
            changes, last = compare_batch(arrived, kept)
            changes.write.mode("overwrite").parquet(f"{store}/changes/batch={batch_id}", compression="zstd")
            for number, (own, of) in enumerate(zip(rounds(arrived), rounds(last))):
                snapshots = own.join(of, ["doc_id", "version"], "left_semi").select("doc_id", "idx", "text")
                mode = "append" if number else "overwrite"
                snapshots.write.mode(mode).parquet(f"{store}/snapshots/batch={batch_id}", compression="zstd")
        removed(spark, folder)

    return (
        arrivals.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_changes(spark, store: str, doc_type: str) -> DataFrame:
    """All changes written so far."""
    schema = (
        "type string, index int, old_index int, old_text string, text string, "
        f"doc_id {doc_type}, version int, batch bigint"
    )
    return spark.read.schema(schema).parquet(f"{store}/changes")
