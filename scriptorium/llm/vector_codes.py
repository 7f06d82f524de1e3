"""Product codes of vectors: Lloyd's rounds over partition-local cover trees.

A component x becomes the integer floor(1024 * x), and a vector is cut into equal consecutive parts.
Each part position has a codebook of ``ENTRIES`` entries, first that part of the vectors with the
least keys. A round gives every part to its nearest entry and moves the entries to the floored means
of what they were given; an entry that was given nothing stays.

Vectors are put into blocks of ``BLOCK`` rows where they lie, without a shuffle, and a block keeps one
cover tree for each part position, written once. A round reads the trees with the codebooks at hand:
by the triangle inequality whole subtrees go to one entry, their counts and sums taken from
cumulative sums, and only what is ambiguous is compared point by point. Tasks send on one sum for
each entry, so a vector that fills a third of the table is one point of each block.

Everything is computed in integers. Bounded, and sent to all tasks: the codebooks.

Defined results: vectors that are null, or hold a null or non-finite component, are dropped, and so
are those whose length is not the commonest one (the greatest of equally common ones). Rows that
repeat a key are vectors of their own; among equal keys the lesser vector comes first, null keys come
last. Fewer vectors than ``ENTRIES`` make a smaller codebook. A length that the parts don't divide, or
a component beyond ``LARGEST``, is a ``ValueError`` before any vector is coded. An empty table gives
an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.lineage import stored
from scriptorium.llm.cover_tree import CoverTree, assigned, built, entries_of, sums
from scriptorium.llm.tables import table

PARTS, ENTRIES, ROUNDS = 4, 256, 4
SCALE = 1024
#: Vectors of a block.
BLOCK = 1024
#: Integers up to which squared distances of up to 2048 components a part are exact in doubles.
LARGEST = 1 << 20
#: Copies of a label's sum, so that rows of one label meet it in several tasks.
SALTS = 16


@dataclass(frozen=True)
class Codebooks:
    """Of each part position, the entries as rows of integers."""

    parts: tuple[np.ndarray, ...]

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position, comma-joined."""
        numbers = (str(x) for part in self.parts for entry in part.tolist() for x in entry)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()

    def decoded(self, codes: Sequence[str]) -> np.ndarray:
        """The vectors that hexadecimal codes stand for, in the components' own scale."""
        at = np.array([list(bytes.fromhex(c)) for c in codes], np.int64).reshape(len(codes), len(self.parts))
        return np.hstack([part[at[:, i]] for i, part in enumerate(self.parts)]) / SCALE


def kept(vectors: DataFrame, key: str, vector: str, carried: Sequence[str]) -> tuple[DataFrame, int]:
    """``(key, vector, *carried)`` by place as ``k, v, c0, ...`` of usable vectors, and their length."""
    named = vectors.select(
        F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)]
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = named.where(F.col("v").isNotNull() & finite)
    lengths = usable.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"))
    commonest = lengths.orderBy(F.desc("n"), F.desc("size")).first()
    size = commonest["size"] if commonest else 0
    return usable.where(F.size("v") == size), size


def blocks(usable: DataFrame, size: int, parts: int) -> DataFrame:
    """Stored blocks: keys, carried columns and one tree for each part position."""
    carried = [f for f in usable.schema.fields if f.name != "v"]
    schema = T.StructType(
        [T.StructField(f.name, T.ArrayType(f.dataType)) for f in carried] + [T.StructField("trees", T.ArrayType(T.BinaryType()))]
    )

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(begin, BLOCK)
                values = piece.column("v").flatten().to_numpy().reshape(piece.num_rows, size)
                rows = np.floor(values * SCALE).astype(np.int64)
                trees = [built(part).dumped() for part in np.split(rows, parts, axis=1)]
                ends = pa.array([0, piece.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, piece.column(f.name)) for f in carried]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([trees], pa.list_(pa.binary()))], names=schema.fieldNames())

    return stored(usable.mapInArrow(plant, schema))


def first_codebooks(usable: DataFrame, size: int, parts: int, entries: int) -> Codebooks:
    """The parts of the vectors with the least keys, of which the driver gets ``entries``."""
    least = usable.orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).select("v").collect()
    rows = np.floor(np.array([r.v for r in least]).reshape(len(least), size) * SCALE).astype(np.int64)
    return Codebooks(tuple(np.split(rows, parts, axis=1)))


def round_(trees: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round over all blocks."""
    width = books.parts[0].shape[1]
    names = [f"s{i}" for i in range(width)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((len(part), 1 + width), np.int64) for part in books.parts]
        for batch in batches:
            for row in batch.column("trees"):
                for part, cell in enumerate(row):
                    tree, entries = CoverTree.loaded(cell.as_py()), books.parts[part]
                    counts, totals = sums(tree, assigned(tree, entries), len(entries))
                    held[part][:, 0] += counts
                    held[part][:, 1:] += totals
        for part, table_ in enumerate(held):
            some = np.flatnonzero(table_[:, 0])
            columns = [np.full(len(some), part), some, *table_[some].T]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "n", *names])

    schema = ", ".join(f"{n} long" for n in ("part", "entry", "n", *names))
    found = trees.select("trees").mapInArrow(assign, schema).groupBy("part", "entry").agg(*[F.sum(n).alias(n) for n in ("n", *names)])
    moved = [part.copy() for part in books.parts]
    for row in found.collect():
        moved[row["part"]][row["entry"]] = np.array(row[3:], np.int64) // row["n"]
    return Codebooks(tuple(moved))


def coded(trees: DataFrame, books: Codebooks) -> DataFrame:
    """``(k, c0, ..., code, error)`` of every vector of the blocks."""
    carried = [f for f in trees.schema.fields if f.name != "trees"]
    schema = T.StructType(
        [T.StructField(f.name, f.dataType.elementType) for f in carried]
        + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    )

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                codes, error = [], 0
                for part, cell in enumerate(batch.column("trees")[at]):
                    tree, entries = CoverTree.loaded(cell.as_py()), books.parts[part]
                    entry = entries_of(tree, assigned(tree, entries))
                    away = tree.points[tree.place].astype(np.int64) - entries[entry]
                    codes.append(entry.astype(np.uint8))
                    error = error + (away * away).sum(axis=1)
                digits = np.stack(codes, axis=1).tobytes().hex()
                step = 2 * len(codes)
                values = [batch.column(f.name)[at].values for f in carried]
                texts = pa.array([digits[i : i + step] for i in range(0, len(digits), step)], pa.string())
                yield pa.RecordBatch.from_arrays([*values, texts, pa.array(error, pa.int64())], names=schema.fieldNames())

    return trees.mapInArrow(code, schema)


def compress(
    vectors: DataFrame,
    key: str,
    vector: str,
    carried: Sequence[str] = (),
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, Codebooks]:
    """``(k, c0, ..., code, error)``: key, carried columns, code and squared error of each usable vector; the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two digits: from 1 to 256 entries")
    usable, size = kept(vectors, key, vector, carried)
    if size % parts:
        raise ValueError(f"{parts} equal parts do not make up vectors of {size} components")
    greatest = usable.agg(F.max(F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x))))).first()[0] or 0.0
    if greatest * SCALE >= LARGEST:
        raise ValueError(f"components beyond {LARGEST / SCALE:g} are not coded: distances would not be exact")
    trees = blocks(usable, size, parts)
    books = first_codebooks(usable, size, parts, entries)
    if len(books.parts[0]):
        for _ in range(rounds):
            books = round_(trees, books)
    return coded(trees, books), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = compress(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", ["label"])
    found = stored(found.toDF("vec_id", "label", "code", "error"))
    totals = found.groupBy("label").agg(F.sum("error").alias("label_error"))
    spread = totals.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = found.withColumn("own", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    joined = salted.join(spread, F.col("label").eqNullSafe(F.col("of")) & (F.col("own") == F.col("salt")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds written out one after the other."""
    steps = [
        f"""
WITH usable AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
common AS (SELECT len(v) AS size FROM usable GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1),
kept AS MATERIALIZED (
  SELECT r, vec_id, label, v, list_transform(v, lambda x: floor({SCALE} * x)::BIGINT) AS whole, size // {PARTS} AS width
  FROM usable JOIN common ON len(v) = size
),
parts AS MATERIALIZED (SELECT r, p, list_slice(whole, p * width + 1, (p + 1) * width) AS x FROM kept, range({PARTS}) t(p)),
least AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept QUALIFY e < {ENTRIES}),
book0 AS MATERIALIZED (SELECT p, e, x AS y FROM parts JOIN least USING (r))"""
    ]
    away = "list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for n in range(ROUNDS + 1):
        steps.append(
            f"""
near{n} AS MATERIALIZED (
  SELECT r, p, min({{'d': d, 'e': e}}) AS best FROM (SELECT r, p, e, {away} AS d FROM parts JOIN book{n} USING (p)) GROUP BY r, p
)"""
        )
        if n < ROUNDS:
            steps.append(
                f"""
sums{n} AS (
  SELECT p, e, i, sum(c)::BIGINT AS s, count(*) AS n
  FROM (SELECT p, best.e AS e, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM near{n} JOIN parts USING (r, p)) GROUP BY p, e, i
),
book{n + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m, y) AS y
  FROM book{n} LEFT JOIN (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM sums{n} GROUP BY p, e) USING (p, e)
)"""
            )
    steps.append(
        f"""
coded AS (
  SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near{ROUNDS} GROUP BY r
),
digest AS (
  SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(y) AS c, generate_subscripts(y, 1) AS i FROM book{ROUNDS})
)"""
    )
    return ",".join(steps) + """
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), digest
"""


OP11_SQL = _sql()
