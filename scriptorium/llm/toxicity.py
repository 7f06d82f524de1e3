"""Toxicity by two class-conditional Kneser-Ney models over the letters of words.

Each class has a model of how its words are spelt: interpolated Kneser-Ney over n-grams of up to
``ORDER`` bytes within a word, with raw counts at the top order and at word starts and numbers
of distinct left neighbours elsewhere. Below ``SHARED`` bytes both back off to one model counted
over every word of every document, labelled or not; so what neither class has seen costs both
the same. A text's evidence is the difference of its two log-likelihoods divided by its number
of words, and, likewise divided, how far single words go beyond ``STRONG`` nats: what a few
telling words say drowns less in the noise of many others. A logistic curve, fitted on labelled
texts kept out of the counts, turns evidence and length into a score.

The class models are fitted on a bounded sample: the ``SAMPLE_DOCS`` labelled texts of each class
that come first by the hash of their id, of at most ``SAMPLE_BYTES`` each. The shared counts and
the scores cover all documents and whole texts. A word is scored once per block of texts.

Defined results: null, empty and wordless texts have no evidence and get the share of toxic
labels as their score. Labels that are null or that contradict each other for an id are not
learnt from. Without labels of both classes every score is the share of toxic ones, or 0 if
there are none. Rows with the same or a null id are scored one by one. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.lineage import stored
from scriptorium.llm.rows import unused
from scriptorium.llm.tables import documents, remainder, table
from scriptorium.llm.words import Words, blocks, split, text_bytes

#: Longest n-gram in bytes, and the longest that both classes share.
ORDER, SHARED = 7, 3
#: The bound of the sample that the class models and the curve are fitted on.
SAMPLE_DOCS, SAMPLE_BYTES = 4000, 1 << 16
#: Of each class's sample, the share in 64ths that fits the curve instead of the counts.
CURVE_SHARE = 16
SCORE_BYTES = 4 << 20
#: Symbols whose n-grams are looked up together; their arrays take about 300 bytes a symbol.
PIECE = 1 << 17
#: Evidence of a single word, in nats, beyond which it counts as telling.
STRONG = 3.0
#: Symbols: 0 before a word, 1 after it, then the bytes that words have.
_CODE = np.zeros(256, np.int64)
_BYTES = [*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]
_CODE[_BYTES] = np.arange(len(_BYTES)) + 2
_CODE[ord("A") : ord("Z") + 1] = _CODE[ord("a") : ord("z") + 1]
SYMBOLS = len(_BYTES) + 2
_STEP = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Spelling:
    """Distinct words as one run of symbols: 0, the word's, 1; and the place of each word."""

    symbols: np.ndarray
    #: Symbols of the word up to and with each place.
    depth: np.ndarray
    begins: np.ndarray


def distinct(words: Words) -> tuple[np.ndarray, np.ndarray, Spelling]:
    """Each word's number among the distinct ones, how often each of those is there, and them."""
    _, first, number, counts = np.unique(words.hashes, return_index=True, return_inverse=True, return_counts=True)
    return number, counts, spelling(words.data, words.starts[first], words.ends[first])


def spelling(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Spelling:
    lengths = ends - starts + 2
    begins = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    depth = np.arange(total) - np.repeat(begins, lengths)
    inner = np.ones(total, bool)
    inner[begins] = False
    inner[begins + lengths - 1] = False
    symbols = np.zeros(total, np.int64)
    symbols[begins + lengths - 1] = 1
    where = depth - 1 + np.repeat(starts, lengths)
    symbols[inner] = _CODE[data[where[inner]]]
    return Spelling(symbols, depth + 1, begins)


def pieces(words: Spelling) -> Iterator[Spelling]:
    """The words in order, of which some with about ``PIECE`` symbols at a time; a longer word stays whole."""
    ends = np.append(words.begins[1:], len(words.symbols))
    cuts = np.searchsorted(ends, np.arange(PIECE, len(words.symbols), PIECE))
    bounds = np.unique(np.concatenate(([0], cuts, [len(words.begins)])))
    for first, after in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        held = slice(words.begins[first], ends[after - 1])
        yield Spelling(words.symbols[held], words.depth[held], words.begins[first:after] - words.begins[first])


def grams(words: Spelling, order: int) -> list[np.ndarray]:
    """Keys of the n-grams of 1 to ``order`` symbols that end at each place, exact up to SHARED.

    Entry k of place i is only meant where the word has k symbols up to i.
    """
    out, key, factor = [], np.zeros(len(words.symbols), np.uint64), np.uint64(1)
    exact = np.zeros(len(words.symbols), np.uint64)
    for k in range(order):
        shifted = np.zeros(len(words.symbols), np.uint64)
        shifted[k:] = words.symbols[: max(0, len(words.symbols) - k)] + 1
        key = key + shifted * factor
        factor = np.uint64((int(factor) * int(_STEP)) & 0xFFFFFFFFFFFFFFFF)
        if k < SHARED:
            exact = exact + shifted * np.uint64((SYMBOLS + 1) ** k)
        out.append(exact.copy() if k < SHARED else key.copy())
    return out


class Table:
    """Open addressing from 64-bit keys to row numbers, for many keys at a time.

    Only the keys travel; a process lays the table out when it first looks something up.
    """

    def __init__(self, keys: np.ndarray):
        self.rows_of = keys
        self._laid: tuple[np.ndarray, np.ndarray, int] | None = None
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 2 + 1))))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_laid": None}

    def _layout(self) -> tuple[np.ndarray, np.ndarray, int]:
        if self._laid is None:
            keys, rows = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
            left, step = np.arange(len(self.rows_of)), 0
            while len(left):
                place = self._place(self.rows_of[left], step)
                _, chosen = np.unique(np.where(rows[place] < 0, place, -1), return_index=True)
                chosen = chosen[rows[place[chosen]] < 0]
                keys[place[chosen]] = self.rows_of[left[chosen]]
                rows[place[chosen]] = left[chosen]
                lost = np.ones(len(left), bool)
                lost[chosen] = False
                left, step = left[lost], step + 1
            self._laid = keys, rows, step
        return self._laid

    def _place(self, keys: np.ndarray, step: int) -> np.ndarray:
        spread = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return ((spread + np.uint64(step)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 for keys that are not there."""
        held, rows, steps = self._layout()
        out = np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        for step in range(steps):
            if not len(left):
                break
            place = self._place(keys[left], step)
            hit = (rows[place] >= 0) & (held[place] == keys[left])
            out[left[hit]] = rows[place[hit]]
            # Tables are filled step by step, so a key may lie beyond a free place.
            left = left[~hit]
        return out


def adjusted(keys: list[np.ndarray], words: Spelling, counts: np.ndarray, order: int) -> list[tuple[np.ndarray, ...]]:
    """Kneser-Ney counts per order: keys, adjusted counts, keys of contexts (one order less).

    Below the top order an n-gram counts its distinct left neighbours, at a word's start its
    occurrences.
    """
    weight = np.repeat(counts, np.diff(words.begins, append=len(words.symbols)))
    out = []
    for k in range(1, order + 1):
        fits = (words.depth >= k) & (words.depth > 1)
        starts = fits & (words.depth == k)
        if k == order:
            found, at, number = np.unique(keys[k - 1][fits], return_index=True, return_inverse=True)
            sums = np.bincount(number, weight[fits])
        else:
            wider = fits & (words.depth > k)
            _, once = np.unique(keys[k][wider], return_index=True)
            pool = np.concatenate([keys[k - 1][wider][once], keys[k - 1][starts]])
            sizes = np.concatenate([np.ones(len(once)), weight[starts].astype(float)])
            places = np.concatenate([np.flatnonzero(wider)[once], np.flatnonzero(starts)])
            found, at, number = np.unique(pool, return_index=True, return_inverse=True)
            sums, at = np.bincount(number, sizes), places[at]
        at = np.flatnonzero(fits)[at] if k == order else at
        context = keys[k - 2][at - 1] if k > 1 else np.zeros(len(found), np.uint64)
        out.append((found, sums, context))
    return out


def discounted(found: np.ndarray, sums: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Discounted share of each n-gram in its context, and each context's weight for the rest."""
    ones, twos = float((sums == 1).sum()), float((sums == 2).sum())
    discount = min(0.95, max(0.5, ones / (ones + 2 * twos) if ones else 0.75))
    contexts, number = np.unique(context, return_inverse=True)
    total = np.bincount(number, sums)
    share = np.maximum(sums - discount, 0) / total[number]
    rest = np.bincount(number, np.minimum(sums, discount)) / total
    return share, contexts, rest


@dataclass
class Shared:
    """The model of SHARED-grams that both classes back off to."""

    #: Chances of a symbol after another, by their numbers.
    bigram: np.ndarray
    keys: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    rest: np.ndarray


def base_model(counts: dict[int, float]) -> Shared:
    """The shared model from counts of ``SHARED``-grams: Kneser-Ney down to single symbols."""
    size = SYMBOLS + 1
    keys = np.array(sorted(counts), np.int64)
    sums = np.array([counts[k] for k in keys.tolist()], np.float64)
    # Digits of a key: last symbol first. 0 stands for none.
    start = keys // size**2 == 0  # a bigram at a word's start, counted as it is
    one = np.bincount(keys[~start] % size, minlength=size) + 0.5
    pair_keys = np.concatenate([keys[~start] % size**2, keys[start]])
    pair_sums = np.concatenate([np.ones((~start).sum()), sums[start]])
    pairs, number = np.unique(pair_keys, return_inverse=True)
    bigram = np.tile(one / one.sum(), (size, 1))
    if len(pairs):
        share, contexts, rest = discounted(pairs, np.bincount(number, pair_sums), pairs // size)
        bigram[contexts] *= rest[:, None]
        bigram[pairs // size, pairs % size] += share
    keys, sums = keys[~start], sums[~start]
    share, contexts, rest = discounted(keys, sums, keys // size) if len(keys) else (sums, keys, sums)
    return Shared(bigram, keys.astype(np.uint64), share, contexts.astype(np.uint64), rest)


class Model:
    """Both classes' models over the shared one; scores distinct words."""

    def __init__(self, shared: Shared, classes: list[list[tuple[np.ndarray, ...]]]):
        self.bigram = shared.bigram
        self.tables = [(Table(shared.keys), Table(shared.contexts))]
        #: Per order from SHARED on: shares of n-grams and weights of contexts for both classes;
        #: the last row is for those that are not there.
        self.shares = [np.append(shared.share, 0).astype(np.float32)[:, None]]
        self.rests = [np.append(shared.rest, 1).astype(np.float32)[:, None]]
        self._shipped: Broadcast | None = None
        for k in range(SHARED + 1, ORDER + 1):
            per_class = [discounted(*c[k - 1]) for c in classes]
            keys = np.unique(np.concatenate([classes[0][k - 1][0], classes[1][k - 1][0]]))
            share = np.zeros((len(keys) + 1, 2))
            contexts = np.unique(np.concatenate([c[1] for c in per_class]))
            rest = np.ones((len(contexts) + 1, 2))
            for side, (part, known, left) in enumerate(per_class):
                share[np.searchsorted(keys, classes[side][k - 1][0]), side] = part
                rest[np.searchsorted(contexts, known), side] = left
            self.tables.append((Table(keys), Table(contexts)))
            self.shares.append(share.astype(np.float32))
            self.rests.append(rest.astype(np.float32))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_shipped": None}

    def shipped(self, spark: SparkSession) -> Broadcast:
        """The model as a broadcast, made once. Its size is bounded by the sample's."""
        if self._shipped is None:
            self._shipped = spark.sparkContext.broadcast(self)
        return self._shipped

    def evidence(self, words: Spelling) -> np.ndarray:
        """Log-likelihood of each word as toxic less that as ordinary."""
        return np.concatenate([np.zeros(0), *[self._evidence(part) for part in pieces(words)]])

    def _evidence(self, words: Spelling) -> np.ndarray:
        keys = grams(words, ORDER)
        before = np.concatenate([[0], words.symbols[:-1]])
        p = np.repeat(self.bigram[before + 1, words.symbols + 1][:, None], 2, axis=1)
        for k in range(SHARED, ORDER + 1):
            at = np.flatnonzero(words.depth >= k)
            table, contexts = self.tables[k - SHARED]
            share = self.shares[k - SHARED][table.find(keys[k - 1][at])]
            rest = self.rests[k - SHARED][contexts.find(keys[k - 2][at - 1])]
            p[at] = share + rest * p[at]
        ratio = np.log(p[:, 1]) - np.log(p[:, 0])
        ratio[words.depth == 1] = 0
        return np.add.reduceat(ratio, words.begins)


def shared_counts(docs: DataFrame) -> dict[int, float]:
    """Occurrences of SHARED-grams, and of word-starting bigrams, in all texts.

    There are at most SYMBOLS ** SHARED of them, whatever the documents.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((SYMBOLS + 1) ** SHARED)
        for batch in blocks(batches, "text", SCORE_BYTES):
            found = split(batch.column("text"))
            if len(found.hashes):
                _, counts, words = distinct(found)
                keys = grams(words, SHARED)
                weight = np.repeat(counts, np.diff(words.begins, append=len(words.symbols)))
                for k, fits in ((SHARED, words.depth >= SHARED), (2, words.depth == 2)):
                    sums += np.bincount(keys[k - 1][fits].astype(np.int64), weight[fits], minlength=len(sums))
        kept = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(sums[kept].astype(np.int64))], names=["gram", "n"])

    rows = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = rows.toArrow()
    return dict(zip(found.column("gram").to_pylist(), found.column("n").to_pylist()))


def evidence(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """Columns ``keep`` with the evidence and telling evidence per word, and the number of words."""
    names = ("evidence", "telling", "words")
    kinds = (T.DoubleType(), T.DoubleType(), T.LongType())
    schema = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(n, k) for n, k in zip(names, kinds)]])
    shipped = model.shipped(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", SCORE_BYTES):
            found = split(batch.column("text"))
            sums = np.zeros((2, batch.num_rows))
            if len(found.hashes):
                number, _, words = distinct(found)
                each = shipped.value.evidence(words)[number]
                for side, values in enumerate((each, np.maximum(each - STRONG, 0))):
                    sums[side] = np.bincount(found.text_of, values, minlength=batch.num_rows)
            sums /= np.maximum(found.counts, 1)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], *[pa.array(x) for x in sums], pa.array(found.counts, pa.int64())],
                names=schema.fieldNames(),
            )

    return docs.mapInArrow(score, schema)


def features(each: np.ndarray, telling: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Columns of the curve: one, both kinds of evidence, and the effect of length."""
    return np.stack([np.ones(len(words)), each, telling, telling * np.sqrt(words), np.log1p(words)], axis=1)


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton's method."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z, w = x / scale, np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (y - p) - ridge * w
        bend = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w / scale


@dataclass
class Fitted:
    """What scoring needs: both models and the curve; without a model every score is ``share``."""

    model: Model | None
    curve: np.ndarray
    share: float


def class_counts(sample: DataFrame, side: int) -> list[tuple[np.ndarray, ...]]:
    """Adjusted n-gram counts of one class's sampled words; the sample's bound bounds them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            found = split(batch.column("text"))
            _, first, counts = np.unique(found.hashes, return_index=True, return_counts=True)
            spans = zip(found.starts[first].tolist(), found.ends[first].tolist())
            words = pa.array([found.data[s:e].tobytes() for s, e in spans], pa.binary())
            yield pa.RecordBatch.from_arrays([words, pa.array(counts, pa.int64())], names=["word", "n"])

    rows = sample.where(F.col("toxic") == side).select("text").mapInArrow(count, "word binary, n long")
    found = rows.groupBy(F.lower(F.col("word").cast("string")).alias("word")).agg(F.sum("n").alias("n")).toArrow()
    data, offsets = text_bytes(found.column("word").combine_chunks())
    words = spelling(data, offsets[:-1], offsets[1:])
    return adjusted(grams(words, ORDER), words, found.column("n").to_numpy(), ORDER)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Fitted:
    """Learn from ``labels`` (which the caller has cut to the rows to learn from) and all texts."""
    known = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("toxic")).where(
        "id is not null and toxic in (0, 1)"
    )
    sure = known.groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    sizes = {r["toxic"]: r["n"] for r in sure.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, ordinary = sizes.get(1, 0), sizes.get(0, 0)
    share = toxic / max(1, toxic + ordinary)
    if not toxic or not ordinary:
        return Fitted(None, np.zeros(5), share)
    order = F.xxhash64(F.lit("toxicity sample"), F.col("id").cast("string"))
    picks = [sure.where(F.col("toxic") == side).orderBy(order, "id").limit(SAMPLE_DOCS) for side in (0, 1)]
    picked = stored(picks[0].unionByName(picks[1]).withColumn("curve", F.pmod(F.shiftright(order, 20), F.lit(64)) < CURVE_SHARE))
    read = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    # At most 2 * SAMPLE_DOCS rows are broadcast.
    sample = stored(read.where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(picked), "id"))
    counted, kept = sample.where("not curve"), sample.where("curve")
    model = Model(base_model(shared_counts(read)), [class_counts(counted, side) for side in (0, 1)])
    rows = evidence(kept.select("text", "toxic"), model, "toxic").toArrow()
    y = rows.column("toxic").to_numpy().astype(float)
    curve = np.zeros(5)
    if 0 < y.sum() < len(y):
        curve = fit_curve(features(*(rows.column(c).to_numpy() for c in ("evidence", "telling", "words"))), y)
        # The sample has other shares of the classes than the labels.
        curve[0] += np.log(toxic / ordinary) - np.log(y.sum() / (len(y) - y.sum()))
    else:
        curve[:2] = np.log(toxic / ordinary), 10.0
    return Fitted(model, curve, share)


def scores(
    docs: DataFrame, fitted: Fitted, text: str = "text", columns: Sequence[str] | None = None, out: str = "score"
) -> DataFrame:
    """``columns`` of ``docs``, by default all, and the score; a column of its name is replaced."""
    names = [c for c in (columns or docs.columns) if c != out]
    if fitted.model is None:
        return docs.select(*names, F.lit(fitted.share).alias(out))
    # Own names, so that none clashes with those of the evidence.
    own = {n: "text" if n == text else f"c{i}" for i, n in enumerate(names)}
    read = docs.select(*[F.col(n).alias(c) for n, c in own.items() if n != text], F.col(text).cast("string").alias("text"))
    rows = evidence(read, fitted.model, *own.values())
    one, each, telling, long_telling, size = (float(w) for w in fitted.curve)
    raw = (
        F.lit(one)
        + F.col("evidence") * each
        + F.col("telling") * telling
        + F.col("telling") * F.sqrt("words") * long_telling
        + F.log1p("words") * size
    )
    score = F.when(F.col("words") == 0, F.lit(fitted.share)).otherwise(1 / (1 + F.exp(-raw)))
    return rows.select(*[F.col(c).alias(n) for n, c in own.items()], score.alias(out))


def without_toxic(docs: DataFrame, fitted: Fitted, text: str = "text") -> DataFrame:
    """``docs`` without those with a score of 0.5 or more."""
    own = unused(docs.columns, "toxicity")
    return scores(docs, fitted, text, out=own).where(F.col(own) < 0.5).drop(own)


def learnt_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that are learnt from; the others are held out."""
    return table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    fitted = fit(docs, learnt_labels(spark, sf_dir))
    return scores(docs, fitted, columns=["doc_id"]).select(
        "doc_id",
        (remainder("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
