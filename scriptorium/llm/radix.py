"""Distributed least-significant-digit radix sort: places of rows by composite integer keys.

Every pass is a stable counting sort by one digit of one key. Rows lie in chunks of consecutive
places. A pass counts the digits of every chunk, turns the counts into offsets over all digits
and chunks, and gives each row its destination: its digit's offset in its chunk plus its place
among the chunk's rows of that digit. Destinations make up the next pass's chunks, so each pass
shuffles a row once. A task holds single chunks, whatever the keys: equal keys lie in as many
chunks as any other rows. Passes are needed only for the digits in which a key's values can
differ, and each is written before the next begins.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.lineage import stored

#: Bits of a digit, and rows of a chunk as a power of two.
DIGIT, CHUNK = 11, 15
RADIX, PLACES = 1 << DIGIT, 1 << CHUNK
_SIGN = -(1 << 63)


def destinations(digits: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the rows of a chunk go, in order, if ``offsets`` has the first place of each digit."""
    order = np.argsort(digits.astype(np.uint16), kind="stable")
    ordered = digits[order]
    first = np.searchsorted(ordered, np.arange(RADIX))
    out = np.empty(len(digits), np.int64)
    out[order] = offsets[ordered] + np.arange(len(digits)) - first[ordered]
    return out


def _pass(state: DataFrame, key: str, shift: int) -> DataFrame:
    """``state(row, *keys, chunk, at)`` moved to where a stable sort by one digit puts its rows."""
    schema, names = state.schema, state.columns
    digit = F.shiftrightunsigned(key, shift).bitwiseAND(F.lit(RADIX - 1))
    counts = stored(state.groupBy("chunk", digit.alias("digit")).agg(F.count("*").alias("n")))
    totals = np.zeros(RADIX, np.int64)
    for row in counts.groupBy("digit").agg(F.sum("n").alias("n")).collect():
        totals[row.digit] = row.n
    before = np.cumsum(totals) - totals
    # A digit has one row for each chunk at most, however many rows it has.
    above = Window.partitionBy("digit").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("chunk", "digit", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("offset"))

    def move(rows: pa.Table, starts: pa.Table) -> pa.Table:
        first = before.copy()
        first[starts.column("digit").to_numpy()] += starts.column("offset").to_numpy()
        rows = rows.take(pa.array(np.argsort(rows.column("at").to_numpy())))
        digits = (rows.column(key).to_numpy().view(np.uint64) >> np.uint64(shift)) & np.uint64(RADIX - 1)
        to = destinations(digits.astype(np.int64), first)
        place = {"chunk": pa.array(to >> CHUNK), "at": pa.array(to & (PLACES - 1))}
        return pa.table({n: place.get(n, rows.column(n)) for n in names})

    return stored(state.groupBy("chunk").cogroup(offsets.groupBy("chunk")).applyInArrow(move, schema))


def places(keyed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(row, place)``: places from 0 of ``keyed(row, *keys)`` in ascending order of the keys, the first weighing most.

    ``row`` and the keys are non-null long integers, and rows differ; equal keys are in order of ``row``.
    """
    state = stored(keyed.select("row", *keys))
    bounds = state.agg(*[f(k).alias(f"{f.__name__}_{k}") for k in keys for f in (F.min, F.max)]).first()
    passes = []
    for key in keys:
        low, high = bounds[f"min_{key}"], bounds[f"max_{key}"]
        spread = 0 if low is None else high - low
        # Without their least, keys have few digits; a spread of 64 bits is put in order by the sign alone.
        fit = F.col(key) - F.lit(low) if spread < 1 << 63 else F.col(key).bitwiseXOR(F.lit(_SIGN))
        state = state.withColumn(key, fit)
        passes = [(key, shift) for shift in range(0, spread.bit_length(), DIGIT)] + passes
    # Rows are in order of their numbers, of which a chunk has a range, before the first pass.
    number = F.col("row")
    state = state.withColumn("chunk", F.shiftright(number, CHUNK)).withColumn("at", number.bitwiseAND(F.lit(PLACES - 1)))
    for key, shift in passes or [(keys[-1], 0)]:
        state = _pass(state, key, shift)
    return state.select("row", (F.shiftleft("chunk", CHUNK) + F.col("at")).alias("place"))
