"""Importance resampling towards a target distribution: array-scored weights, radix-sorted ranks.

Features are the runs of 1 to ``runs`` consecutive words, each counted in the bucket of its CRC-32.
A bucket's gain is the logarithm of how much likelier the target's features are to fall in it
than the documents' own, in thousandths. A document's weight is the mean gain of its features: the
gains are one array, and buckets index it. Adding a Gumbel draw that depends on seed and key alone,
and taking the highest sums, draws without replacement in proportion to the weights' exponentials.
The order comes from ``radix.places``: no range is sampled, and no task holds the drawn rows.

Bounded and sent to all tasks: the gains, one number a bucket. Counts cover all texts of both tables.

Defined results: null and empty texts, and texts without words, have no features and weight 0. A
null key is drawn as the empty text would be, and comes last among equal scores; rows that repeat a
key are separate documents, and tie in their stored order. Empty tables count nothing: gains are 0
if both are empty. Words of any length are hashed whole. Other columns are not read by ``ranked`` and
passed through by ``resample``, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.lineage import stored
from scriptorium.llm.radix import places
from scriptorium.llm.rows import ROW, numbered
from scriptorium.llm.tables import documents, table
from scriptorium.llm.words import LOWER, blocks, split

BUCKETS = 10_000
#: Words of the longest feature.
RUNS = 1
SEED = 2024
#: Words that a document needs to be drawn, and the percentage of such documents that is drawn.
LEAST_WORDS, PERCENT = 20, 10
BLOCK_BYTES = 1 << 20
#: Bytes up to which words are hashed together, a byte of all at a time.
LONG = 48


def _crc_table() -> np.ndarray:
    """What a byte adds to a CRC-32 state, by the reflected polynomial."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> np.uint32(1)) ^ np.uint32(0xEDB88320), out >> np.uint32(1))
    return out


_STEP = _crc_table()
_ALL = np.uint32(0xFFFFFFFF)


def fed(states: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 states after the bytes from ``starts`` to ``ends`` of ``data``, one state for each."""
    lengths = ends - starts
    order = np.argsort(-np.minimum(lengths, LONG + 1).astype(np.int16), kind="stable")
    sizes, at, out = lengths[order], starts[order], states[order]
    long = int(np.searchsorted(-sizes, -LONG, side="left"))
    for i in range(long):
        out[i] = zlib.crc32(data[at[i] : at[i] + sizes[i]], int(out[i] ^ _ALL)) ^ 0xFFFFFFFF
    begin, sizes, at = out[long:], sizes[long:], at[long:]
    for k in range(int(sizes[0]) if len(sizes) else 0):
        some = int(np.searchsorted(-sizes, -k, side="left"))
        begin[:some] = _STEP[(begin[:some] ^ data[at[:some] + k]) & np.uint32(255)] ^ (begin[:some] >> np.uint32(8))
    states = np.empty_like(out)
    states[order] = out
    return states


def features(texts: pa.Array, runs: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the features of 1, 2, ... ``runs`` words, with the number of the text of each."""
    words = split(texts)
    data, text_of, n = LOWER[words.data], words.text_of, len(words.hashes)
    states, first = np.full(n, _ALL, np.uint32), np.arange(n)
    for size in range(1, runs + 1):
        if size > 1:
            # Runs go on by a blank and the next word, if that is the same text's.
            on = first + size - 1 < n
            on[on] = text_of[first[on] + size - 1] == text_of[first[on]]
            first, states = first[on], states[on]
            states = _STEP[(states ^ np.uint32(ord(" "))) & np.uint32(255)] ^ (states >> np.uint32(8))
        last = first + size - 1
        states = fed(states, data, words.starts[last], words.ends[last])
        yield ((states ^ _ALL) % np.uint32(buckets)).astype(np.int64), text_of[first]


def bucket_counts(texts: DataFrame, text: str, runs: int, buckets: int) -> np.ndarray:
    """Features of all texts in each bucket; every task counts its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in blocks(batches, "text", BLOCK_BYTES):
            for found, _ in features(batch.column("text"), runs, buckets):
                held += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["bucket", "n"])

    counted = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the smoothed ratio of frequencies, rounded down."""
    buckets, total, aimed = len(own), float(own.sum()), float(target.sum())
    ratio = lambda s, t: (t + 1.0) * (total + buckets) / ((s + 1.0) * (aimed + buckets))
    return np.array([math.floor(1000 * math.log(ratio(float(s), float(t)))) for s, t in zip(own, target)], np.int64)


def weighed(docs: DataFrame, key: str, text: str, gain: np.ndarray, runs: int, row: str | None) -> DataFrame:
    """``(row, doc_id, n_words, n_features, weight)`` of all documents, numbered by ``row`` if given."""
    names = ("n_words", "n_features", "weight")
    schema = T.StructType(
        [T.StructField("row", T.LongType()), T.StructField("doc_id", docs.schema[key].dataType)]
        + [T.StructField(n, T.LongType()) for n in names]
    )

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        for batch in blocks(batches, "text", BLOCK_BYTES):
            size = batch.num_rows
            counts, sums, words = np.zeros(size, np.int64), np.zeros(size, np.int64), None
            for found, text_of in features(batch.column("text"), runs, len(gain)):
                held = np.bincount(text_of, minlength=size)
                upto = np.concatenate(([0], np.cumsum(gain[found])))
                ends = np.cumsum(held)
                sums, counts = sums + upto[ends] - upto[ends - held], counts + held
                words = held if words is None else words
            weight = np.where(counts > 0, sums // np.maximum(counts, 1), 0)
            number = batch.column("row") if row else pa.array(np.arange(base, base + size))
            columns = [number, batch.column("doc_id"), pa.array(words), pa.array(counts), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())
            base += size

    number = [F.col(row).alias("row")] if row else []
    read = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), *number)
    return read.mapInArrow(weigh, schema)


def draw(key: str, seed: int) -> Column:
    """A Gumbel draw in thousandths, rounded down, from seed and key alone."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    digits = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((digits + 0.5) / 4294967296))).cast("long")


def ranked(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    runs: int = RUNS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    row: str | None = None,
) -> DataFrame:
    """``(row, doc_id, n_words, n_features, weight, score, rank)`` of every document; undrawn ones have no rank.

    ``key`` is an integer column. Of the documents with ``least_words``, the given percentage is drawn.
    """
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise ValueError(f"{key} must be an integer column: it orders equal scores")
    gain = gains(bucket_counts(docs, text, runs, buckets), bucket_counts(target, target_text, runs, buckets))
    scored = stored(
        weighed(docs, key, text, gain, runs, row).withColumn("score", F.col("weight") + draw("doc_id", seed))
    )
    open_ = scored.where(F.col("n_words") >= least_words)
    # Highest scores first; among equal ones smaller keys, and null after all.
    order = {
        "down": -F.col("score"),
        "none": F.col("doc_id").isNull().cast("long"),
        "key": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)),
    }
    drawn = open_.count() * percent // 100
    placed = places(open_.select("row", *[c.alias(n) for n, c in order.items()]), list(order))
    ranks = placed.where(F.col("place") < drawn).select("row", (F.col("place") + 1).alias("rank"))
    return scored.join(ranks, "row", "left")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The drawn rows of ``docs``, with all their columns; ``options`` as for ``ranked``."""
    table_ = numbered(docs)
    placed = ranked(table_.rows, target, table_.column(key), table_.column(text), row=ROW, **options)
    drawn = placed.where("rank is not null").select(F.col("row").alias(ROW))
    return table_.named(table_.rows.join(stored(drawn), ROW, "left_semi"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranked(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = f"""
WITH RECURSIVE step(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM step WHERE k < 8
),
steps AS MATERIALIZED (SELECT list(c ORDER BY i) AS step FROM step WHERE k = 8),
texts AS (
  SELECT row_number() OVER () AS row, doc_id, FALSE AS aimed, text FROM documents
  UNION ALL SELECT NULL, NULL, TRUE, text FROM benchmark
),
words AS MATERIALIZED (
  SELECT row, aimed, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word
  FROM texts
),
counts AS MATERIALIZED (SELECT row, aimed, word, count(*) AS n FROM words GROUP BY ALL),
hashed AS MATERIALIZED (
  SELECT word, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(word))), lambda k: ('0x' || substr(hex(encode(word)), (2 * k + 1)::INT, 2))::BIGINT)),
    lambda c, b: xor(c // 256, step[(xor(c, b) % 256 + 1)::INT])), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT word FROM counts), steps
),
buckets AS (
  SELECT i AS bucket, coalesce(sum(n) FILTER (WHERE NOT aimed), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE aimed), 0)::DOUBLE AS t
  FROM range({BUCKETS}) b(i) LEFT JOIN (SELECT * FROM counts JOIN hashed USING (word)) c ON c.bucket = i GROUP BY i
),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + {BUCKETS}) / ((s + 1) * (sum(t) OVER () + {BUCKETS}))))::BIGINT AS gain
  FROM buckets
),
sums AS (
  SELECT row, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS total
  FROM counts JOIN hashed USING (word) JOIN gains USING (bucket) WHERE NOT aimed GROUP BY row
),
scored AS (
  SELECT row, doc_id, coalesce(n, 0)::BIGINT AS n_features,
    CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256(concat('{SEED}:', doc_id::VARCHAR)), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS gumbel
  FROM texts LEFT JOIN sums USING (row) WHERE NOT aimed
),
ordered AS (
  SELECT row, row_number() OVER (ORDER BY weight + gumbel DESC, doc_id NULLS LAST, row) AS rank,
    floor({PERCENT} * count(*) OVER () / 100) AS drawn
  FROM scored WHERE n_features >= {LEAST_WORDS}
)
SELECT doc_id, n_features, weight, weight + gumbel AS score, CASE WHEN rank <= drawn THEN rank END AS rank
FROM scored LEFT JOIN ordered USING (row)
"""
