"""Near-duplicate documents by BagMinHash signatures of weighted word shingles.

A document is the multiset of its five-word shingles. For weights, every shingle owns a Poisson
process on [0, infinity) for its multiplicity, laid out in dyadic intervals [0,1), [1,2), [2,4),
[4,8) and so on: a document of weight w runs the intervals below w in full and the one that w
cuts with the points beyond w removed. A point has a time and a register, both drawn from
hashes of shingle and interval only. Each register keeps the least time. Two documents agree in
a register with a probability equal to their weighted Jaccard similarity. A shingle stops as
soon as its next time exceeds the greatest register of its document, which most do after one
point; a weight w costs log2(w) processes, not w.

Signatures are cut into bands; documents that agree in a band are candidates, compared on exact
multisets. Documents with the same multiset are one class from the start, and only one
represents them. ``graph.linked`` finds the groups without pairing members off.

Defined results: null texts and texts without words are near no other. A text of fewer than five
words is one shingle. Rows with the same or a null id are separate documents; the class of a
document is the least id in its group, null ids last, and exactly one row of each group has
``keep``. Other columns are passed by ``deduplicate`` and not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.lineage import stored
from scriptorium.llm.graph import Comparison, linked, sent, sides, tiles
from scriptorium.llm.membership import Membership, present
from scriptorium.llm.rows import ROW, numbered
from scriptorium.llm.tables import documents
from scriptorium.llm.words import blocks, lists, mix, shingles, split

#: Registers of a signature, in bands of ROWS. A pair at similarity 0.8 shares no band with a
#: probability of 6e-5, one at 0.9 with 3e-11.
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
SIMILARITY = 0.8
SHINGLE_WORDS = 5
#: Bytes of text handled together: registers and shingles of a block take some hundred times as much.
BLOCK_BYTES = 1 << 20
#: Elements of multisets that a tile of a bucket holds.
TILE_ELEMENTS = 1 << 21
#: Columns of a tile's matrix at a time.
COLUMNS = 1 << 14
_TOP = np.float64(2.0**-53)


def unit(hashes: np.ndarray) -> np.ndarray:
    """Uniform draws in (0, 1) from hashes."""
    return ((hashes >> np.uint64(11)).astype(np.float64) + 0.5) * _TOP


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their multiplicity: text number, hash, weight."""
    values, text_of = shingles(split(texts), SHINGLE_WORDS)
    order = np.lexsort((values, text_of))
    values, text_of = values[order], text_of[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (text_of[1:] != text_of[:-1])
    begins = np.flatnonzero(fresh)
    return text_of[begins], values[begins], np.diff(begins, append=len(values))


def signatures(text_of: np.ndarray, values: np.ndarray, weights: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """Least times of every text's registers; infinite for texts without shingles."""
    intervals = np.ones(len(weights), np.int64)
    heavy = weights > 1
    intervals[heavy] = 1 + np.ceil(np.log2(weights[heavy])).astype(np.int64)
    at = np.repeat(np.arange(len(values)), intervals)
    number = np.arange(len(at)) - np.repeat(np.cumsum(intervals) - intervals, intervals)
    low = np.where(number == 0, 0.0, 2.0 ** (number - 1))
    width = np.where(number == 0, 1.0, low)
    doc, weight = text_of[at], weights[at].astype(np.float64)
    state = mix(values[at] ^ mix(number.astype(np.uint64), 11), 12)
    time = np.zeros(len(at))
    least = np.full(texts * registers, np.inf)
    greatest = np.full(texts, np.inf)
    points = 0
    while len(state):
        points = min(32, points * 2) or 1
        for _ in range(points):
            state = mix(state, 13)
            time = time - np.log(unit(state)) / (width * registers)
            inside = low + width * unit(mix(state, 14)) < weight
            where = doc * registers + (mix(state, 15) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(least, where[inside], time[inside])
        held = np.unique(doc)
        greatest[held] = least.reshape(texts, registers)[held].max(axis=1)
        going = time < greatest[doc]
        state, time, low, width, doc, weight = (x[going] for x in (state, time, low, width, doc, weight))
    return least.reshape(texts, registers)


def elements(text_of: np.ndarray, values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each multiset as a set of (shingle, occurrence) hashes; texts in ascending order."""
    at = np.repeat(np.arange(len(values)), weights)
    occurrence = np.arange(len(at)) - np.repeat(np.cumsum(weights) - weights, weights)
    return text_of[at], mix(values[at] ^ mix(occurrence.astype(np.uint64), 21), 22)


def coded(ascending: np.ndarray) -> bytes:
    """Sorted 64-bit hashes cut to their top 40 bits, as differences, byte planes apart."""
    steps = np.diff(ascending >> np.uint64(24), prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes()


def decoded(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(5, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :5] = planes.T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def described(docs: DataFrame, key: str, text: str, row: str | None = None) -> DataFrame:
    """Rows ``(row, doc_id, copy0, copy1, n, bag, bands)``, stored, with numbers of their own or ``row``'s.

    ``copy0`` and ``copy1`` identify the multiset; they, ``bag`` and ``bands`` are null without words.
    """
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("doc_id", docs.schema[key].dataType),
            T.StructField("copy0", T.LongType()),
            T.StructField("copy1", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("bag", T.BinaryType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        for batch in blocks(batches, "text", BLOCK_BYTES):
            texts = batch.num_rows
            text_of, values, weights = bags(batch.column("text"))
            least = signatures(text_of, values, weights, texts)
            banded = least.view(np.uint64).reshape(texts, BANDS, ROWS)
            keys = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64), 31), (texts, BANDS)).copy()
            for r in range(ROWS):
                keys = mix(keys ^ banded[:, :, r], 32)
            owner, members = elements(text_of, values, weights)
            order = np.lexsort((members, owner))
            members, cuts = members[order], np.searchsorted(owner, np.arange(texts + 1))
            parts = [members[cuts[i] : cuts[i + 1]] for i in range(texts)]
            some = np.diff(cuts) > 0
            digests = b"".join(hashlib.blake2b(p.tobytes(), digest_size=16).digest() for p in parts)
            copies = np.frombuffer(digests, np.int64).reshape(-1, 2)
            column = lists(keys.view(np.int64).ravel(), np.full(texts, BANDS), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row") if row else pa.array(np.arange(base, base + texts)),
                    batch.column("doc_id"),
                    *[pa.array(c, pa.int64(), mask=~some) for c in copies.T],
                    pa.array(np.diff(cuts), pa.int64()),
                    pa.array([coded(p) if len(p) else None for p in parts], pa.binary()),
                    column.filter(pa.array(some)).take(pa.array(np.where(some, np.cumsum(some) - 1, 0), pa.int64(), mask=~some)),
                ],
                names=schema.fieldNames(),
            )
            base += texts

    number = [F.col(row).alias("row")] if row else []
    read = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), *number)
    return stored(read.mapInArrow(run, schema))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of some sets share."""
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, number, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = counts > 1
    column = np.cumsum(several) - 1
    of, column = of[several[number]], column[number[several[number]]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(several.sum()), COLUMNS):
        here = slice(*np.searchsorted(column, [low, low + COLUMNS]))
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[of[here], column[here] - low] = 1
        shared += part @ part.T
    return shared


def spanning(ids: np.ndarray, roots: np.ndarray, links: np.ndarray) -> list[tuple[int, int]]:
    """Of linked pairs of places, enough to join all roots that they join."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    kept = []
    _, first = np.unique(roots[links], axis=0, return_index=True)
    for i, j in links[first].tolist():
        one, other = top(int(roots[i])), top(int(roots[j]))
        if one != other:
            parent[one] = other
            kept.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
    return kept


def compared(rows: DataFrame, ids: DataFrame, threshold: float) -> Comparison:
    """Exact comparison of the multisets of ``ids``."""
    bag = present(rows.select(F.col("row").alias("id"), "n", "bag"), "id", ids)
    bag = stored(bag.join(ids, "id", "left_semi"))
    sizes = bag.select("id", "n")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("bag_a"), batch.column("bag_b")):
                one, other = decoded(x.as_py()), decoded(y.as_py())
                shared = len(np.intersect1d(one, other, assume_unique=True))
                good.append(shared >= threshold * (len(one) + len(other) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def verify(pairs: DataFrame) -> DataFrame:
        near = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(threshold)
        sized = pairs.join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b").where(near)
        close = stored(sized.select("a", "b"))
        both = sides(close, bag, ["bag"])
        return both.mapInArrow(check, "a long, b long")

    def tile(group: pa.Table) -> pa.Table:
        ids_, roots = group.column("id").to_numpy(), group.column("root").to_numpy()
        sets = [decoded(x.as_py()) for x in group.column("bag")]
        shared, count = intersections(sets), np.array([len(x) for x in sets], np.float64)
        good = shared >= threshold * (count[:, None] + count[None, :] - shared)
        links = np.argwhere(good & (roots[:, None] < roots[None, :]))
        kept = spanning(ids_, roots, links)
        return pa.table({k: pa.array([p[i] for p in kept], pa.int64()) for i, k in enumerate("ab")})

    def across(members: DataFrame) -> DataFrame:
        """Buckets in tiles: every two tiles of a bucket meet in a task, and no pair leaves it unless it links."""
        met = tiles(members, TILE_ELEMENTS, sizes)
        return sent(bag.select("id", "bag"), met, "id").groupBy("bucket", "one", "two").applyInArrow(tile, "a long, b long")

    return Comparison(verify, across)


def groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = SIMILARITY, row: str | None = None
) -> DataFrame:
    """``(row, doc_id, class_id, keep)`` for every row of ``docs``, numbered by ``row`` if given."""
    rows = described(docs, key, text, row)
    light = rows.where("copy0 is not null").select("row", "copy0", "copy1")
    copied = stored(light.groupBy("copy0", "copy1").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1"))
    copies = stored(
        present(light, "copy0", copied.select("copy0")).join(copied, ["copy0", "copy1"]).where("row <> first").select("row", "first")
    )
    repeated = Membership(copies.select("row"))
    banded = rows.where("bands is not null").select("row", "bands")
    distinct = repeated.absent(banded, "row").unionByName(
        repeated.present(banded, "row").join(copies.select("row"), "row", "left_anti")
    )
    buckets = distinct.select(F.explode("bands").alias("bucket"), F.col("row").alias("id"))
    roots = linked(buckets, lambda ids: compared(rows, ids, threshold))
    hung = copies.join(roots.withColumnRenamed("id", "first"), "first", "left").select(
        "row", F.coalesce("root", "first").alias("root")
    )
    known = stored(roots.select(F.col("id").alias("row"), "root").unionByName(hung))
    placed = stored(
        rows.select("row", "doc_id").join(known, "row", "left").select("row", "doc_id", F.coalesce("root", "row").alias("root"))
    )
    least = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least"))
    return placed.join(stored(least), "root").select(
        "row",
        "doc_id",
        F.col("least.doc_id").alias("class_id"),
        (F.col("row") == F.col("least.row")).alias("keep"),
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group."""
    table_ = numbered(docs)
    placed = groups(table_.rows, table_.column(key), table_.column(text), threshold, ROW)
    return table_.without(placed.where("not keep").select("row"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir)).select("doc_id", "class_id", "keep")
