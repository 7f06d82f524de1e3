"""Language identification by compression with one zstandard dictionary per language.

Each language's dictionary is raw content: windows of its labelled texts, joined. A text is cut
into pieces small enough that the dictionary, not the text's own past, explains them; every
piece, lower-cased and with blanks for all but letters, is compressed with every dictionary, and the language with the least sum wins. The margin
is the share by which the second is larger. A narrow one rejects the answer.

The dictionaries are fitted on a bounded sample: at most ``SAMPLE_DOCS`` texts a language, the
first by the hash of their content, with a window of at most ``WINDOW`` characters from each, cut
to ``DICTIONARY_BYTES``. Whole texts are classified.

Defined results: a null text and one without a letter are ``und`` with score 0. Null languages
are not learnt. Without any language to learn everything is ``und``. Ties go to the first
language by name. Rows with the same or a null id are classified one by one. Other columns are
not read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.tables import documents, remainder
from scriptorium.llm.words import blocks

UNKNOWN = "und"
#: The bound of the sample that a dictionary is made of.
SAMPLE_DOCS, WINDOW, DICTIONARY_BYTES = 1000, 300, 128 << 10
#: Bytes of text compressed together.
PIECE = 1024
LEVEL = 6
_NO_LETTERS = re.compile(r"[\W\d_]+")
#: Answers whose margin is below this are rejected.
MARGIN = 0.02


def dictionaries(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Raw-content dictionaries of the languages of ``docs``.

    Only rows that the caller wants learnt should be passed. The sample's rows are chosen by
    the hash of their text; a threshold on it, from the languages' counts, leaves a few more
    than needed, and only those are ranked.
    """
    known = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).alias("lang")).where(
        "text is not null and lang is not null and trim(text) <> ''"
    )
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    shares = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 2 * SAMPLE_DOCS / n) * (1 << 30))])
    at = F.pmod(F.xxhash64(F.lit("window"), "text"), F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1) + 1
    # Equal texts have equal draws: a text that is copied often counts once.
    few = (
        known.where(draw < F.element_at(shares, F.col("lang")))
        .select("lang", draw.alias("draw"), F.substring("text", at.cast("int"), F.lit(WINDOW)).alias("text"))
        .dropDuplicates(["lang", "draw"])
    )
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("draw", "text")))
    rows = ranked.where(F.col("rank") <= SAMPLE_DOCS).orderBy("lang", "rank").collect()
    found: dict[str, list[bytes]] = {}
    for r in rows:
        found.setdefault(r["lang"], []).append(letters(r["text"]))
    return {k: b" ".join(v)[:DICTIONARY_BYTES] for k, v in found.items()}


def letters(text: str) -> bytes:
    """A text's lower-cased letters, with one blank for each run of anything else."""
    return _NO_LETTERS.sub(" ", text.lower()).encode()


@functools.lru_cache(maxsize=2)
def compressors(contents: tuple[bytes, ...]) -> list[zstandard.ZstdCompressor]:
    """A compressor for each dictionary, digested once per process."""
    made = []
    for content in contents:
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=LEVEL)
        made.append(
            zstandard.ZstdCompressor(
                level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False
            )
        )
    return made


def compressed_sizes(text: str, contents: tuple[bytes, ...]) -> np.ndarray:
    """Bytes that a text takes with each dictionary, in pieces of about ``PIECE`` bytes."""
    data = letters(text)
    pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
    return np.array([sum(len(c.compress(p)) for p in pieces) for c in compressors(contents)], np.int64)


def predictions(
    docs: DataFrame, learnt: dict[str, bytes], text: str = "text", columns: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """``columns`` and ``(lang_pred, score, rejected)`` for each row of ``docs``.

    ``lang_pred`` is the likeliest language even if rejected; ``score`` grows from 0.5 towards 1
    with the margin.
    """
    names = sorted(learnt)
    contents = tuple(learnt[n] for n in names)
    schema = T.StructType(
        [
            *[T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(columns)],
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("rejected", T.BooleanType()),
        ]
    )

    def judge(value: str) -> tuple[str, float, bool]:
        sizes = compressed_sizes(value, contents)
        order = np.argsort(sizes, kind="stable")
        best, second = sizes[order[0]], sizes[order[1]] if len(order) > 1 else 2 * sizes[order[0]]
        margin = float(second - best) / float(second)
        return names[order[0]], 0.5 + 0.5 * min(1.0, margin / (margin + MARGIN)), margin < MARGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            lettered = pc.match_substring_regex(batch.column("text"), r"\pL").fill_null(False).to_pylist()
            answers = [
                judge(value) if some and names else (UNKNOWN, 0.0, True)
                for value, some in zip(batch.column("text").to_pylist(), lettered)
            ]
            kinds = (pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(f"c{i}") for i in range(len(columns))],
                    *[pa.array([a[k] for a in answers], kind) for k, kind in enumerate(kinds)],
                ],
                names=schema.fieldNames(),
            )

    read = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.col(text).cast("string").alias("text"))
    out = read.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "lang_pred", "score", "rejected")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    learnt = dictionaries(docs.where(remainder("doc_id", 4) != 2))
    return predictions(docs, learnt).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected"
    )
