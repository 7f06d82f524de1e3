"""Document fingerprints: one-permutation MinHash with optimal densification, packed low bits.

Each shingle of five words is hashed once. The hash's top bits choose one of ``BINS`` bins and
each bin keeps its least hash. An empty bin borrows from the first filled bin in a fixed random
order of its own, the same for all documents, so that likeness stays unbiased. Of each bin's
hash, salted with the bin's number, ``BITS`` low-order bits are stored, one hexadecimal digit a bin. Two bins with different
hashes agree by chance once in 2**BITS; the estimate is corrected for that.

Defined results: a null text is empty. A text without words has the empty fingerprint; two of
those are alike (1.0), one of them and another text are not (0.0). Rows with the same id follow
each other in the order of their texts; a null id comes first. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.tables import documents
from scriptorium.llm.words import BLOCK_BYTES, blocks, mix, shingles, split

BIN_BITS = 9
BINS = 1 << BIN_BITS
BITS = 4
#: Documents with at most so many filled bins look their donors up in one step.
FEW = 24
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)


@functools.lru_cache(maxsize=1)
def donor_order() -> np.ndarray:
    """For each bin (row) the order in which it asks the bins, a fixed random permutation."""
    draws = np.random.Generator(np.random.PCG64(20240229))
    return np.argsort(draws.random((BINS, BINS)), axis=1).astype(np.int32)


@functools.lru_cache(maxsize=1)
def donor_rank() -> np.ndarray:
    """For each bin (row) the step in which it asks each bin."""
    return np.argsort(donor_order(), axis=1).astype(np.int32)


def densify(bins: np.ndarray) -> np.ndarray:
    """Fill empty bins from the first filled one they ask; rows without any stay empty."""
    out, filled = bins.copy(), bins != _EMPTY
    count = filled.sum(axis=1)
    for row in np.flatnonzero((count > 0) & (count <= FEW)):
        have = np.flatnonzero(filled[row])
        donors = have[np.argmin(donor_rank()[:, have], axis=1)]
        out[row] = np.where(filled[row], bins[row], bins[row, donors])
    rows, cells = np.nonzero(~filled & (count > FEW)[:, None])
    for step in range(BINS):
        if not len(rows):
            break
        donors = donor_order()[cells, step]
        found = filled[rows, donors]
        out[rows[found], cells[found]] = bins[rows[found], donors[found]]
        rows, cells = rows[~found], cells[~found]
    return out


def low_bits(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The stored bits of each text's bins, and whether the text has any word."""
    values, text_of = shingles(split(texts))
    bins = np.full(len(texts) * BINS, _EMPTY, np.uint64)
    np.minimum.at(bins, text_of * BINS + (values >> np.uint64(64 - BIN_BITS)).astype(np.int64), values)
    bins = bins.reshape(len(texts), BINS)
    # Hashed with the bin's number: what agrees by chance in one bin need not in one that borrows.
    salted = mix(densify(bins) ^ mix(np.arange(BINS, dtype=np.uint64), 61), 62)
    return (salted & np.uint64((1 << BITS) - 1)).astype(np.uint8), (bins != _EMPTY).any(axis=1)


def packed(bits: np.ndarray, some: np.ndarray) -> pa.Array:
    """Fingerprints as hexadecimal text; the empty one for texts without words."""
    digits = _DIGITS[bits]
    return pa.array([row.tobytes().decode() if any_ else "" for row, any_ in zip(digits, some)], pa.string())


def likeness(a: np.ndarray, a_some: np.ndarray, b: np.ndarray, b_some: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the shingles, corrected for chance agreement."""
    chance = 1 / (1 << BITS)
    agree = (a == b).mean(axis=1)
    raw = np.clip((agree - chance) / (1 - chance), 0, 1)
    return np.where(a_some & b_some, raw, (a_some == b_some).astype(float))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``' key and the fingerprint of each text."""
    schema = T.StructType([docs.schema[key], T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), packed(*low_bits(batch.column("text")))], names=schema.fieldNames()
            )

    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def with_next(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` dealt out so that each task holds runs of consecutive ids.

    ``run`` numbers ranges of ids. ``ahead`` marks copies of a range's first rows that the range
    before needs as the next documents; the last range's next is the first row of all. Rows come
    sorted by run, ``ahead``, id and text. No range is ever put together beyond its task.
    """
    spark = docs.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / count for i in range(1, count)] or [0.5]
    found = docs.agg(F.percentile_approx("doc_id", shares, 20 * count).alias("bounds")).first()["bounds"]
    bounds = np.unique(np.array(found or [], np.int64))

    def range_of(ids: pa.Array) -> np.ndarray:
        whole = ids.cast(pa.int64())
        numbers = np.searchsorted(bounds, whole.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        return np.where(whole.is_null().to_numpy(zero_copy_only=False), 0, numbers)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            frame = pa.table({"run": pa.array(range_of(ids), pa.int64()), "doc_id": ids.cast(pa.int64())})
            yield from frame.group_by("run").aggregate([("doc_id", "min"), ("doc_id", "count"), ("run", "count")]).select(
                [0, 1, 2, 3]
            ).rename_columns(["run", "first", "known", "n"]).to_batches()

    firsts = {
        r["run"]: (None if r["known"] < r["n"] else r["first"])
        for r in docs.select("doc_id")
        .mapInArrow(least, "run long, first long, known long, n long")
        .groupBy("run")
        .agg(F.min("first").alias("first"), F.sum("known").alias("known"), F.sum("n").alias("n"))
        .collect()
    }
    held = sorted(firsts)
    before = {run: held[i - 1] for i, run in enumerate(held)}
    schema = "doc_id long, text string, run long, ahead boolean"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, runs = batch.column("doc_id").cast(pa.int64()), range_of(batch.column("doc_id"))
            copied = [i for i, x in enumerate(ids.to_pylist()) if x == firsts[int(runs[i])]]
            take = pa.array([*range(len(ids)), *copied], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(take),
                    batch.column("text").take(take),
                    pa.array([*runs.tolist(), *[before[int(runs[i])] for i in copied]], pa.int64()),
                    pa.array([False] * len(ids) + [True] * len(copied)),
                ],
                names=["doc_id", "text", "run", "ahead"],
            )

    return docs.mapInArrow(deal, schema).repartition(count, "run").sortWithinPartitions("run", "ahead", "doc_id", "text")


EDITED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit: the last quarter of its code points replaced
    by as many from the start of the next document, or by all it has. ``key`` is an integer."""

    def described(rows: list[tuple], after: list[str]) -> pa.RecordBatch:
        texts, changed = [t for _, t in rows], []
        for (_, own), other in zip(rows, after):
            quarter = len(own) // 4
            changed.append(own[: len(own) - quarter] + other[:quarter])
        own = low_bits(pa.array(texts, pa.large_string()))
        edited = low_bits(pa.array(changed, pa.large_string()))
        # Within a block the next text's bits are known but for the last one's.
        last = low_bits(pa.array(after[-1:], pa.large_string()))
        following = tuple(np.concatenate([o[1:], e]) for o, e in zip(own, last))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in rows], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                packed(*own),
                packed(*edited),
                pa.array(likeness(*own, *edited)),
                pa.array(likeness(*own, *following)),
            ],
            names=EDITED.fieldNames(),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # consecutive rows of one run
        size, current, closed = 0, None, True
        for batch in blocks(batches, "text"):
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "run", "ahead"))
            for doc_id, value, number, ahead in zip(*columns):
                value = value or ""
                if ahead:
                    if not closed:  # the first of the next range ends this one
                        yield described(held, [*[t for _, t in held[1:]], value])
                        held, size, closed = [], 0, True
                    continue
                if number != current:
                    current, closed = number, False
                if size > BLOCK_BYTES:
                    yield described(held, [*[t for _, t in held[1:]], value])
                    held, size = [], 0
                held.append((doc_id, value))
                size += len(value)

    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return with_next(read).mapInArrow(run, EDITED)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
