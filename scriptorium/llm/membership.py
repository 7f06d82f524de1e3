"""A filter of fixed size for the keys of a join, to keep other rows out of its shuffle."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.words import mix

#: A filter has 2**n bits, about 16 for a key, from n = 16 to n = 26, which is 8 MB.
LEAST_BITS, MOST_BITS = 16, 26


def _cells(values: pa.Array, bits: int) -> np.ndarray:
    hashes = mix(values.to_numpy(zero_copy_only=False).view(np.uint64), 51)
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


class Membership:
    """Which keys may be in the one column of ``wanted``, of non-null 64-bit integers.

    It never misses a key. It also takes some others for present, the more the fuller it is:
    what passes must still be joined, and what it holds for absent surely is. ``wanted`` is
    counted first, so it should be a stored table.
    """

    def __init__(self, wanted: DataFrame):
        size = min(MOST_BITS, max(LEAST_BITS, (16 * wanted.count()).bit_length()))

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = np.unique(_cells(batch.column(0), size))
                words, begins = np.unique(cells >> 5, return_index=True)
                bits = np.bitwise_or.reduceat(np.left_shift(1, cells & 31), begins) if len(words) else words
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(bits)], names=["word", "bits"])

        marks = wanted.mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
        found = marks.toArrow()
        filled = np.zeros(1 << (size - 5), np.uint32)
        filled[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
        self._bits = size
        self._shipped = wanted.sparkSession.sparkContext.broadcast(filled)

    def _where(self, column: str, held: bool) -> Column:
        shipped, size = self._shipped, self._bits

        @F.pandas_udf("boolean")
        def test(keys: pd.Series) -> pd.Series:
            cells = _cells(pa.array(keys), size)
            hit = (shipped.value[cells >> 5] >> (cells & 31).astype(np.uint32)) & np.uint32(1)
            return pd.Series(hit.astype(bool) == held)

        return test(F.col(column))  # only the key leaves the JVM

    def present(self, frame: DataFrame, column: str) -> DataFrame:
        """Rows whose key may be wanted."""
        return frame.where(self._where(column, True))

    def absent(self, frame: DataFrame, column: str) -> DataFrame:
        """Rows whose key surely is not; with ``present`` they make up the frame."""
        return frame.where(self._where(column, False))


def present(frame: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    return Membership(wanted).present(frame, column)
