"""Words of texts, split and hashed a block of texts at a time.

A word is a maximal run of ASCII digits, ASCII letters and characters beyond ASCII, with A-Z
lower-cased. In UTF-8 every byte of such a word is a digit, a letter or at least 0x80, so words
are found on the bytes of an Arrow string column without decoding them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled together; the arrays of a block take many times as much.
BLOCK_BYTES = 4 << 20
#: Bytes of words hashed together; a longer word stays whole.
HASH_BYTES = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[ord("0") : ord("9") + 1] = True
_IS_WORD[ord("A") : ord("Z") + 1] = True
_IS_WORD[ord("a") : ord("z") + 1] = True
_IS_WORD[0x80:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit mixing function, bijective for each seed."""
    x = values.astype(np.uint64, copy=True)
    x += np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(count: int) -> np.ndarray:
    """The first ``count`` powers of the hash base, modulo 2**64."""
    out = np.full(max(count, 1), _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """Words of a block of texts in order: hash, byte range, and the first word of each text."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    #: Position of each text's first word; one more than there are texts.
    first: np.ndarray
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset of each; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def split(texts: pa.Array) -> Words:
    """All words of ``texts``. Nulls and texts without words have none."""
    data, offsets = text_bytes(texts)
    inside = _IS_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = edges[edges > 0] - 1
    ends[last] = inside[last]
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(ends) + 1
    lengths = stops - starts
    hashes = np.zeros(len(starts), np.uint64)
    if len(starts):
        base, total = powers(int(lengths.max())), np.cumsum(lengths)
        # A few words at a time, as numbers take many times the room of their bytes.
        bounds = np.unique(np.concatenate(([0], np.searchsorted(total, np.arange(HASH_BYTES, total[-1], HASH_BYTES)), [len(starts)])))
        for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            part = lengths[begin:end]
            at = np.concatenate(([0], np.cumsum(part)[:-1]))
            within = np.arange(int(part.sum()), dtype=np.int64) - np.repeat(at, part)
            held = slice(starts[begin], stops[end - 1])
            values = (LOWER[data[held][inside[held]]].astype(np.uint64) + np.uint64(1)) * base[within]
            hashes[begin:end] = mix(np.add.reduceat(values, at) ^ mix(part.astype(np.uint64), 1))
    return Words(hashes, starts, stops, np.searchsorted(starts, offsets), data)


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and the number of the text that holds each.

    A text of fewer words, but not none, is one shingle of all its words.
    """
    counts, n = words.counts, len(words.hashes)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = (counts > 0) & (counts < size)
    mixed = np.zeros(n, np.uint64)
    room = np.repeat(words.first[1:], counts) - np.arange(n)
    for k in range(size):
        part = mix(words.hashes[k:], k + 2) if k < n else np.zeros(0, np.uint64)
        keep = room[: len(part)] > k
        mixed[: len(part)] += np.where(keep, part, np.uint64(0))
    full = room >= size
    full[words.first[:-1][short]] = True
    return mix(mixed[full]), words.text_of[full]


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each take about ``limit`` bytes; a longer text stays whole."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = text_bytes(batch.column(column))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and the number that belongs to each row."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
