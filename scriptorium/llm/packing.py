"""Packing documents into fixed-length sequences, shortest pack first over the length histogram.

Every document's ids, ended by one separator, are cut into full pieces and one rest. A piece's
place needs only its length and its rank among the pieces of that length. So the histogram of
lengths, which never has more rows than a sequence has tokens, is packed on the driver: lengths
go longest first, each into the packs with most room, and whole counts of equal packs move
together. The patterns are then joined back to the pieces by rank.

Ranks need no sort. Each tokenising task numbers its pieces of each length as it writes them;
sums of the tasks' counts turn that into a rank over all of them. A length that a third of all
pieces share is therefore never gathered anywhere.

Defined results: a null text is an empty document, which is one separator. Rows with the same or
a null id are separate documents. An empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.lineage import stored
from scriptorium.llm import tokens
from scriptorium.llm.tables import documents
from scriptorium.llm.words import blocks

SEQUENCE_TOKENS = 1024
#: Id after each document.
SEPARATOR = 0
#: Rows of three integers (lengths times tasks) that are sent to all tasks rather than shuffled.
BROADCAST_ROWS = 1 << 20


@dataclass(frozen=True)
class Slot:
    """Pieces of ``length`` with ranks in [first, first + count) start at ``offset`` of the
    sequences from ``sequence`` on, one each."""

    length: int
    first: int
    count: int
    sequence: int
    offset: int


def patterns(histogram: dict[int, int], size: int = SEQUENCE_TOKENS) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths of a sequence's pieces, how many sequences) for a histogram.

    ``open_packs[room]`` lists the patterns so far that have ``room`` tokens left. Pieces of a
    length are dealt to the packs with most room until none of them is left; a pattern whose
    packs outnumber the pieces is split in two.
    """
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(histogram, reverse=True):
        left, grown = histogram[length], []
        for room in sorted((r for r in open_packs if r >= length), reverse=True):
            while left and open_packs[room]:
                pattern, count = open_packs[room].pop()
                used = min(left, count)
                if used < count:
                    open_packs[room].append((pattern, count - used))
                grown.append((room - length, (*pattern, length), used))
                left -= used
            if not open_packs[room]:
                del open_packs[room]
            if not left:
                break
        if left:  # one after the other into new packs, as many to a pack as it holds
            each = size // length
            if full := left // each:
                grown.append((size - each * length, (length,) * each, full))
            if rest := left % each:
                grown.append((size - rest * length, (length,) * rest, 1))
        for room, pattern, count in grown:
            open_packs.setdefault(room, []).append((pattern, count))
    return [pack for packs in open_packs.values() for pack in packs]


def slots(packs: list[tuple[tuple[int, ...], int]]) -> list[Slot]:
    """Where the pieces of each length go, by rank."""
    taken: dict[int, int] = {}
    found, sequence = [], 0
    for pattern, count in packs:
        offset = 0
        for length in pattern:
            first = taken.get(length, 0)
            found.append(Slot(length, first, count, sequence, offset))
            taken[length] = first + count
            offset += length
        sequence += count
    return found


def small_ids(ids: np.ndarray) -> bytes:
    """Ids as little-endian unsigned 16-bit integers; the vocabulary has fewer than 65,536."""
    return ids.astype("<u2").tobytes()


def pieces(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = SEQUENCE_TOKENS,
    vocabulary: str = tokens.VOCABULARY,
    coded: Callable[[np.ndarray], bytes] | None = None,
) -> DataFrame:
    """Tokenised pieces with their rank among the task's pieces of that length, stored.

    ``coded`` adds a column ``ids`` with what it makes of a piece's ids.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[key].dataType),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("task", T.LongType()),
            T.StructField("task_rank", T.LongType()),
            *([T.StructField("ids", T.BinaryType())] if coded else []),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in blocks(batches, "text"):
            rows: list[tuple] = []
            owners: list[int] = []
            for at, value in enumerate(batch.column("text").to_pylist()):
                ids = np.append(tokens.encode(value, vocabulary), np.uint32(SEPARATOR)).astype("<u4")
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    rank = int(seen[len(piece)])
                    seen[len(piece)] += 1
                    row = (start, len(piece), zlib.crc32(piece.data), len(ids), task, rank)
                    rows.append((*row, coded(piece)) if coded else row)
                    owners.append(at)
            columns = [pa.array(c) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owners)), *columns], names=schema.fieldNames()
            )

    read = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return stored(read.mapInArrow(cut, schema))


def place(cut: DataFrame, size: int = SEQUENCE_TOKENS) -> DataFrame:
    """Give every piece its sequence and its offset there."""
    spark = cut.sparkSession
    counts = cut.groupBy("length", "task").agg(F.count("*").alias("pieces"))
    earlier = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select(
        "length", "task", F.coalesce(F.sum("pieces").over(earlier), F.lit(0)).alias("base")
    )
    if counts.count() <= BROADCAST_ROWS:  # else Spark joins by a shuffle
        bases = F.broadcast(bases)
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("pieces").alias("n")).collect()}
    plan = spark.createDataFrame(
        [(s.length, s.first, s.first + s.count, s.sequence, s.offset) for s in slots(patterns(histogram, size))],
        "length long, rank_from long, rank_to long, sequence_from long, offset long",
    )
    ranked = cut.join(bases, ["length", "task"]).withColumn("rank", F.col("base") + F.col("task_rank"))
    # The plan's size depends on the sequence length alone, not on the documents.
    placed = ranked.join(
        F.broadcast(plan),
        (ranked["length"] == plan["length"])
        & (F.col("rank") >= F.col("rank_from"))
        & (F.col("rank") < F.col("rank_to")),
    )
    extra = [ranked["ids"]] if "ids" in cut.columns else []
    return placed.select(
        "doc_id",
        "start",
        ranked["length"],
        "ids_crc32",
        "doc_tokens",
        (F.col("sequence_from") + F.col("rank") - F.col("rank_from")).alias("sequence_id"),
        "offset",
        *extra,
    )


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = SEQUENCE_TOKENS,
    vocabulary: str = tokens.VOCABULARY,
    with_ids: bool = True,
) -> DataFrame:
    """All documents in sequences of at most ``size`` tokens; one row per piece.

    ``with_ids`` adds the pieces' ids as little-endian unsigned 16-bit integers.
    """
    return place(pieces(docs, key, text, size, vocabulary, small_ids if with_ids else None), size)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), with_ids=False)
