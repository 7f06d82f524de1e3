"""Token totals kept up to date by signed changes, in batches that commit once.

A change inserts a document's count, deletes it, or revises it. Each becomes a signed row, and
the signed rows of a batch add up, within tasks first, to one delta per (source, language,
tokenizer version). A batch is committed by writing its delta below its own number; writing it
again replaces nothing and adds nothing, because a number that is already committed is skipped
and an unfinished write has no ``_SUCCESS`` mark and is overwritten. Totals are the sum of the
committed deltas, whose size depends on the number of groups and batches, not of documents.

Defined results: a change delivered twice (same ``change_id`` in a batch) counts once. A null
source, language or version is a group of its own. A null count is 0. A null text has 0 tokens,
a deleted document leaves its group even if the total becomes 0. Empty batches commit an empty
delta. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.lineage import new_folder, stored
from scriptorium.llm import tokens
from scriptorium.llm.tables import documents
from scriptorium.llm.words import blocks

GROUP = ("source", "lang", "tokenizer_version")
TOTALS = ("docs", "tokens")
DELTA_SCHEMA = "source string, lang string, tokenizer_version string, docs long, tokens long"
INSERT, DELETE, REVISE = "insert", "delete", "revise"
#: The characters that Unicode calls white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def count_tokens(
    docs: DataFrame, text: str = "text", out: str = "tokens", vocabulary: str = tokens.VOCABULARY
) -> DataFrame:
    """``docs`` with the number of tokens of each text; a null text has none."""
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            sizes = [len(tokens.encode(x, vocabulary)) for x in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes, pa.int64())], names=schema.fieldNames()
            )

    return docs.mapInArrow(count, schema)


def signed(changes: DataFrame) -> DataFrame:
    """Signed rows of changes ``(change_id, action, *GROUP, old_tokens, new_tokens)``."""
    action = F.col("action")
    new = F.coalesce(F.col("new_tokens"), F.lit(0))
    old = F.coalesce(F.col("old_tokens"), F.lit(0))
    return changes.select(
        *GROUP,
        F.when(action == INSERT, 1).when(action == DELETE, -1).otherwise(0).cast("long").alias("docs"),
        F.when(action == INSERT, new).when(action == DELETE, -old).otherwise(new - old).alias("tokens"),
    )


def delta(changes: DataFrame) -> DataFrame:
    """The sum of a batch's changes per group."""
    once = changes.dropDuplicates(["change_id"])
    return signed(once).groupBy(*GROUP).agg(*[F.sum(c).cast("long").alias(c) for c in TOTALS])


class Rollup:
    """Totals in a folder that all executors share: one delta per committed batch."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{new_folder(spark)}/rollup"

    def _path(self, batch: int) -> str:
        return f"{self.folder}/batch={batch:012d}"

    def _exists(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def committed(self, batch: int) -> bool:
        return self._exists(f"{self._path(batch)}/_SUCCESS")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply a batch unless it already is; tells whether it was applied now."""
        if self.committed(batch):
            return False
        delta(changes).coalesce(1).write.mode("overwrite").parquet(self._path(batch))
        return True

    def batches(self) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in system.listStatus(root)] if system.exists(root) else []
        found = sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))
        return [b for b in found if self.committed(b)]

    def totals(self) -> DataFrame:
        """One row per group that ever had a document."""
        paths = [self._path(b) for b in self.batches()]
        if not paths:
            return self.spark.createDataFrame([], DELTA_SCHEMA)
        deltas = self.spark.read.schema(DELTA_SCHEMA).parquet(*paths)
        return deltas.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in TOTALS])


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after loading all documents, correcting white space, and deleting exact copies.

    Batch 1 inserts every document. Batch 2 revises those whose text has white space at its
    ends, which cleaning strips. Batch 3 deletes every copy but the first of a text. Batch 2 is
    then sent again, as after a failed acknowledgement, and changes nothing.

    Rows with the same or a null id are separate documents: changes go by the stored row's number.
    The first copy is that of the least id (null last), then of the least group (nulls first).
    """
    docs = documents(spark, sf_dir).select(
        "doc_id", "text", "source", "lang", F.lit("byte_bpe_50k").alias("tokenizer_version")
    )
    counted = count_tokens(docs)
    cleaned = F.btrim(F.coalesce("text", F.lit("")), F.lit(WHITE))
    state = stored(
        counted.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            *GROUP,
            "tokens",
            F.xxhash64("text").alias("text_hash"),
            F.length("text").alias("n"),
            (F.length(cleaned) < F.length("text")).alias("untrimmed"),
            F.when(F.length(cleaned) < F.length("text"), cleaned).alias("text"),
        )
    )
    base = state.select("row", "doc_id", *GROUP, "tokens", "text_hash", "n")
    revised = stored(
        count_tokens(state.where("untrimmed").select("row", *GROUP, "tokens", "text"), out="new_tokens").drop("text")
    )
    nothing = F.lit(None).cast("long")

    def changes(rows: DataFrame, action: str, old, new) -> DataFrame:
        return rows.select(
            F.concat_ws(":", F.lit(action), F.col("row").cast("string")).alias("change_id"),
            F.lit(action).alias("action"),
            *GROUP,
            old.alias("old_tokens"),
            new.alias("new_tokens"),
        )

    rollup = Rollup(spark)
    rollup.commit(1, changes(base, INSERT, nothing, F.col("tokens")))
    second = changes(revised, REVISE, F.col("tokens"), F.col("new_tokens"))
    rollup.commit(2, second)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *GROUP, "row")
    first = base.groupBy("text_hash", "n").agg(F.min(place).alias("first")).select("text_hash", "n", F.col("first.row").alias("first_row"))
    current = base.join(revised.select("row", "new_tokens"), "row", "left")
    copies = current.join(first, ["text_hash", "n"]).where("row <> first_row")
    rollup.commit(3, changes(copies, DELETE, F.coalesce("new_tokens", "tokens"), nothing))
    rollup.commit(2, second)
    return rollup.totals()
