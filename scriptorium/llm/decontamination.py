"""Exact and near matches of test texts in documents, by a positional inverted index.

The index is a table of segments. A segment covers whole documents of about ``SEGMENT_WORDS``
words: its sorted terms, their counts, and for each term the ascending positions where it
stands, as differences. Positions number the words of the segment; the documents' first
positions tell where one ends. Segments are built and searched where they lie, without a
shuffle, and a term however frequent never meets itself from elsewhere.

A search takes the test texts in blocks of bounded size. The counts of a block's terms are
summed over all segments, so that each window knows its rarest term. In a segment, windows
with an absent term are set aside at once; for the others the list of the rarest term,
moved back by its place in the window, is intersected with the next rarest, and so on.

Terms are 64-bit hashes of words; two different words of a corpus share one with a probability
of about 3e-4 at 10^8 distinct words, and a wrong match needs that in every word of a window.

Defined results: a null or wordless document has 0 words and no hit. A null or wordless item has
no window. Items with the same id count once; a null id counts as the empty string. Rows with
the same document id are separate documents. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.lineage import stored
from scriptorium.llm.rows import ROW, numbered
from scriptorium.llm.tables import documents, table
from scriptorium.llm.words import blocks, lists, split

WINDOW_WORDS = 13
#: Words of a segment of the index, beyond which the next document starts another.
SEGMENT_WORDS = 1 << 17
#: Words of the test texts searched for at once.
QUERY_WORDS = 200_000


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Segments ``(segment, terms, counts, positions, doc_ids, firsts, n_words)``, stored."""
    schema = T.StructType(
        [
            T.StructField("segment", T.LongType()),
            T.StructField("terms", T.BinaryType()),
            T.StructField("counts", T.BinaryType()),
            T.StructField("positions", T.BinaryType()),
            T.StructField("doc_ids", T.ArrayType(docs.schema[key].dataType)),
            T.StructField("firsts", T.ArrayType(T.LongType())),
            T.StructField("n_words", T.ArrayType(T.LongType())),
        ]
    )

    def segment(number: int, ids: list[pa.Array], hashes: list[np.ndarray], counts: list[np.ndarray]):
        words, sizes = np.concatenate(hashes), np.concatenate(counts)
        order = np.argsort(words, kind="stable")
        ordered = words[order]
        begins = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(words) else order
        steps = np.diff(order, prepend=0)
        steps[begins] = order[begins]
        found = np.diff(begins, append=len(words))
        firsts = np.cumsum(sizes) - sizes
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.array([ordered[begins].tobytes()], pa.binary()),
                pa.array([found.astype("<u4").tobytes()], pa.binary()),
                pa.array([steps.astype("<u4").tobytes()], pa.binary()),
                lists_of(pa.concat_arrays(ids)),
                lists(firsts, np.array([len(sizes)]), pa.int64()),
                lists(sizes, np.array([len(sizes)]), pa.int64()),
            ],
            names=schema.fieldNames(),
        )

    def lists_of(values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, hashes, counts, held = [], [], [], 0
        for batch in blocks(batches, "text", limit=SEGMENT_WORDS * 4):
            words = split(batch.column("text"))
            ids.append(batch.column("doc_id"))
            hashes.append(words.hashes)
            counts.append(words.counts)
            held += len(words.hashes)
            if held >= SEGMENT_WORDS:
                yield segment(number, ids, hashes, counts)
                number += 1
                ids, hashes, counts, held = [], [], [], 0
        if ids:
            yield segment(number, ids, hashes, counts)

    read = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return stored(read.mapInArrow(index, schema))


@dataclass
class Query:
    """Windows of one block of test texts: their terms' numbers, and the items that have them."""

    terms: np.ndarray
    windows: list[np.ndarray]
    items: list[list[str]]


def windows_of(items: list[tuple[str, np.ndarray]], size: int = WINDOW_WORDS) -> Query:
    """All windows of ``size`` consecutive words; a shorter item is one window."""
    terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *[words for _, words in items]]))
    owners: dict[bytes, set[str]] = defaultdict(set)
    for name, words in items:
        numbers = np.searchsorted(terms, words).astype(np.int32)
        for at in range(max(1, len(numbers) - size + 1)):
            if len(numbers):
                owners[numbers[at : at + size].tobytes()].add(name)
    return Query(terms, [np.frombuffer(w, np.int32) for w in owners], [sorted(n) for n in owners.values()])


def query_blocks(items: DataFrame, key: str, text: str, limit: int = QUERY_WORDS) -> Iterator[list[tuple[str, np.ndarray]]]:
    """The items' words in blocks of about ``limit`` words."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            found = split(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), lists(found.hashes.view(np.int64), found.counts, pa.int64())],
                names=["item", "words"],
            )

    read = items.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").alias("text")
    )
    split_items = read.mapInArrow(words, "item string, words array<long>")
    total = split_items.agg(F.sum(F.size("words"))).first()[0] or 0
    count = -(-total // limit)
    for block in range(count):
        rows = split_items.where(F.pmod(F.xxhash64("item", "words"), F.lit(count)) == block).collect()
        yield [(r["item"], np.array(r["words"], np.int64).view(np.uint64)) for r in rows]


def term_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each of ``terms`` stands in the whole index."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(terms), np.int64)
        for batch in batches:
            for held, counts in zip(batch.column("terms"), batch.column("counts")):
                at, found = locate(np.frombuffer(held.as_py(), np.uint64), terms)
                sums[found] += np.frombuffer(counts.as_py(), "<u4")[at[found]]
        kept = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(sums[kept])], names=["term", "n"])

    rows = index.select("terms", "counts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n"))
    out = np.zeros(len(terms), np.int64)
    for term, n in rows.collect():
        out[term] = n
    return out


def locate(held: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each of ``terms`` among the sorted ``held``, and whether it is there."""
    if len(held) == 0:
        return np.zeros(len(terms), np.int64), np.zeros(len(terms), bool)
    at = np.minimum(np.searchsorted(held, terms), len(held) - 1)
    return at, held[at] == terms


class Postings:
    """The posting lists of one segment for the terms of a query."""

    def __init__(self, row: dict, terms: np.ndarray):
        held = np.frombuffer(row["terms"], np.uint64)
        self.counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
        self.at, self.present = locate(held, terms)
        self.begins = np.cumsum(self.counts) - self.counts
        self.steps = np.frombuffer(row["positions"], "<u4")

    def list_of(self, term: int) -> np.ndarray:
        at = self.at[term]
        begin = self.begins[at]
        return np.cumsum(self.steps[begin : begin + self.counts[at]], dtype=np.int64)


def among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Which of ``values`` are among ``ascending``."""
    at = np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)
    return ascending[at] == values


def phrase_starts(postings: Postings, window: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Where the terms of ``window`` follow each other, intersecting from the rarest list."""
    order = np.argsort(rarity[window], kind="stable")
    starts = postings.list_of(window[order[0]]) - order[0]
    for place in order[1:]:
        if not len(starts):
            break
        starts = starts[among(starts + place, postings.list_of(window[place]))]
    return starts[starts >= 0]


def near_anchors(
    postings: Postings, window: np.ndarray, rarity: np.ndarray, reach: int, firsts: np.ndarray, ends: np.ndarray
) -> np.ndarray:
    """Where the rarest term has every other term of ``window`` within ``reach`` words of the same document.

    ``firsts`` and ``ends`` bound the documents of the segment.
    """
    order = np.argsort(rarity[window], kind="stable")
    anchors = postings.list_of(window[order[0]])
    for place in order[1:]:
        if not len(anchors):
            break
        document = np.searchsorted(firsts, anchors, side="right") - 1
        other = np.concatenate([[-1 << 40], postings.list_of(window[place]), [1 << 40]])
        at = np.searchsorted(other, anchors)
        before, after = other[at - 1], other[at]
        near = (before >= firsts[document]) & (anchors - before <= reach)
        near |= (after < ends[document]) & (after - anchors <= reach)
        anchors = anchors[near]
    return anchors


def matches(index: DataFrame, query: Query, proximity: int | None = None) -> DataFrame:
    """Where the windows of a block occur: ``(segment, place, doc_id, item, spans)``.

    ``place`` numbers the documents of a segment. ``spans`` are the joined word ranges, from the
    document's first word, that occurrences of the item's windows cover. With ``proximity``, a
    window also matches where its rarest term has all others within that many words of it in
    the same document, and the span is that term alone.
    """
    rarity = term_counts(index, query.terms)
    used = {f.name: f.dataType for f in index.schema.fields}
    schema = T.StructType(
        [
            T.StructField("segment", T.LongType()),
            T.StructField("place", T.IntegerType()),
            T.StructField("doc_id", used["doc_ids"].elementType),
            T.StructField("item", T.StringType()),
            T.StructField(
                "spans",
                T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])),
            ),
        ]
    )
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    terms, windows, items = query.terms, query.windows, query.items
    sizes = np.array([len(w) for w in windows], np.int64)
    flat = np.concatenate(windows)
    begins = np.cumsum(sizes) - sizes

    def hits(row: dict) -> dict[tuple[int, str], list[tuple[int, int]]]:
        postings, firsts = Postings(row, terms), np.array(row["firsts"], np.int64)
        ends = firsts + np.array(row["n_words"], np.int64)
        found: dict[tuple[int, str], list[tuple[int, int]]] = defaultdict(list)
        for w in np.flatnonzero(np.logical_and.reduceat(postings.present[flat], begins)):
            spans = [(phrase_starts(postings, windows[w], rarity), sizes[w])]
            if proximity is not None:
                spans.append((near_anchors(postings, windows[w], rarity, proximity, firsts, ends), 1))
            for starts, length in spans:
                places = np.searchsorted(firsts, starts, side="right") - 1
                whole = starts + length <= ends[places]
                for start, place in zip(starts[whole].tolist(), places[whole].tolist()):
                    span = (start - int(firsts[place]), start - int(firsts[place]) + int(length))
                    for item in items[w]:
                        found[(place, item)].append(span)
        return found

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                found = hits(row)
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["segment"]] * len(found), pa.int64()),
                            pa.array([place for place, _ in found], pa.int32()),
                            batch.column("doc_ids")[at].values.take(pa.array([place for place, _ in found])),
                            pa.array([item for _, item in found], pa.string()),
                            pa.array([[{"start": s, "end": e} for s, e in joined(x)] for x in found.values()], kind),
                        ],
                        names=schema.fieldNames(),
                    )

    return index.mapInArrow(search, schema)


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of ranges as disjoint ascending ranges."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def find_items(
    index: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", size: int = WINDOW_WORDS,
    proximity: int | None = None,
) -> DataFrame:
    """The matches of all items, block by block."""
    found = None
    for block in query_blocks(items, key, text):
        query = windows_of(block, size)
        if query.windows:
            part = matches(index, query, proximity)
            found = part if found is None else found.unionByName(part)
    if found is None:  # no item has a word
        found = matches(index.limit(0), windows_of([("", np.zeros(1, np.uint64))], size), proximity)
    return found


def contamination(index: DataFrame, found: DataFrame) -> DataFrame:
    """One row per document of the index with the words that occurrences cover.

    ``contaminated`` holds when at least one word and at least a twentieth of them are hit.
    """
    place = F.posexplode(F.arrays_zip("doc_ids", "n_words"))
    base = index.select("segment", place.alias("place", "doc")).select(
        "segment",
        "place",
        F.col("doc.doc_ids").alias("doc_id"),
        F.col("doc.n_words").alias("n_words"),
    )
    hit = found.groupBy("segment", "place").agg(
        F.array_sort(F.collect_set("item")).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    start = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("reach"))
    covered = F.aggregate(
        "spans",
        start,
        lambda a, s: F.struct(
            (a.hit + F.greatest(F.lit(0).cast("long"), s.end - F.greatest(s.start, a.reach))).alias("hit"),
            F.greatest(a.reach, s.end).alias("reach"),
        ),
        lambda a: a.hit,
    )
    rows = base.join(hit, ["segment", "place"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        "segment",
        "place",
    )
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the contaminated ones."""
    table_ = numbered(docs)
    index = build_index(table_.rows, ROW, table_.column(text))
    rows = contamination(index, find_items(index, items, key, item_text))
    return table_.without(rows.where("contaminated").select("doc_id"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(documents(spark, sf_dir))
    rows = contamination(index, find_items(index, table(spark, sf_dir, "benchmark")))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


WORDS_SQL = r"""regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP8_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL.format(text="text")} AS w FROM documents
), tests AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS_SQL.format(text="text")} AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item, least({WINDOW_WORDS}, len(w)) AS k,
         w[i:i + least({WINDOW_WORDS}, len(w)) - 1] AS words
  FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - {WINDOW_WORDS} + 2))) AS i FROM tests WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT k FROM wins
), spots AS (
  SELECT r, i, k, w[i:i + k - 1] AS words
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, sizes WHERE len(w) >= k)
), hits AS (
  SELECT DISTINCT r, i, k, item FROM spots JOIN wins USING (k, words)
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
