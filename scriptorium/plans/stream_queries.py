"""The change feed over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.lineage import new_folder
from scriptorium.plans.tables import table
from scriptorium.plans.text_queries import LINES_SQL
from scriptorium.streaming.changes import read_changes, stream_changes as start


def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of every document arrive; the second changes and adds a line."""
    work = new_folder(spark)
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    first = documents.withColumn("version", F.lit(0))
    second = documents.select(
        "doc_id", F.concat(F.lit("~"), "text", F.lit("\n~tail~")).alias("text"), F.lit(1).alias("version")
    )
    first.unionByName(second).write.parquet(f"{work}/arrivals", compression="zstd")
    arrivals = spark.readStream.schema("doc_id bigint, text string, version int").parquet(f"{work}/arrivals")
    start(arrivals, f"{work}/store", f"{work}/progress").awaitTermination()
    return read_changes(spark, f"{work}/store", "bigint").drop("batch")


QUERIES = {"stream_changes": stream_changes}

SQL = {
    "stream_changes": f"""WITH {LINES_SQL},
sizes AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n FROM lines GROUP BY doc_id)
SELECT doc_id, CAST(1 AS INTEGER) AS "version", 'changed' AS "type", CAST(0 AS INTEGER) AS "index",
  CAST(0 AS INTEGER) AS old_index, text AS old_text, '~' || text AS text FROM lines WHERE idx = 0
UNION ALL SELECT doc_id, 1, 'inserted', n, NULL, NULL, '~tail~' FROM sizes""",
}
