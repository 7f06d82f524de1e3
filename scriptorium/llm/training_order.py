"""Token sequences in training order: a keyed permutation gives every sequence its slot, and
range partitions write shards of fixed stride.

Sequences are numbered from 0 without gaps by ``packing``. A Feistel network over the least even
number of bits that covers them permutes the numbers under a key; a result beyond the last
sequence is permuted again until it falls inside (cycle-walking), which keeps it a permutation.
So the slot of a sequence, and by running the rounds backwards the sequence of a slot, follow
from key and count alone: no shuffle of all rows decides the order, and nothing is stored.

Shard s holds the slots from s * ``SHARD_SEQUENCES`` on, each a record of ``size`` little-endian
unsigned 16-bit ids filled up with the padding id: slot x lies in shard x // SHARD_SEQUENCES at
byte (x % SHARD_SEQUENCES) * 2 * size. A reader resumes at any slot by a seek. Shards are whole in
one partition of a range partitioning, written under a temporary name and moved into place; a
repeated task writes the same bytes.

On their way ids are compressed with a dictionary of ids from a bounded sample of documents. The
sample only affects size.

Defined results: as for packing; an empty table gives no shard. Other columns are not read.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.lineage import new_folder, stored
from scriptorium.llm import packing, tokens
from scriptorium.llm.tables import documents
from scriptorium.llm.words import mix

SHARD_SEQUENCES = 8192
PADDING = 0
ROUNDS = 6
#: The dictionary's sample and size.
DICTIONARY_DOCS, DICTIONARY_BYTES = 200, 64 << 10
LEVEL = 6


def _halves(count: int) -> int:
    return max(1, -(-(max(count, 2) - 1).bit_length() // 2))


def _turn(values: np.ndarray, key: int, bits: int, backwards: bool) -> np.ndarray:
    """One pass of the network over numbers of 2 * bits bits."""
    mask = np.uint64((1 << bits) - 1)
    left, right = values >> np.uint64(bits), values & mask
    for turn in reversed(range(ROUNDS)) if backwards else range(ROUNDS):
        if backwards:
            left, right = right ^ (mix(left, key + turn) & mask), left
        else:
            left, right = right, left ^ (mix(right, key + turn) & mask)
    return (left << np.uint64(bits)) | right


def permuted(numbers: np.ndarray, count: int, key: int, backwards: bool = False) -> np.ndarray:
    """The slots of sequence numbers below ``count``, or with ``backwards`` the numbers of slots."""
    bits, out = _halves(count), numbers.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        out[walking] = _turn(out[walking], key, bits, backwards)
        walking = walking[out[walking] >= count]
    return out.astype(np.int64)


@functools.lru_cache(maxsize=2)
def coder(dictionary: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=content), zstandard.ZstdDecompressor(dict_data=content)


def _placed(system: pafs.FileSystem, path: str, content: bytes) -> None:
    """Write a file under another name, then move it into place."""
    temporary = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(temporary) as stream:
        stream.write(content)
    system.move(temporary, path)


def materialise(
    docs: DataFrame,
    folder: str,
    key: int,
    doc_key: str = "doc_id",
    text: str = "text",
    size: int = packing.SEQUENCE_TOKENS,
    shard_sequences: int = SHARD_SEQUENCES,
    vocabulary: str = tokens.VOCABULARY,
) -> DataFrame:
    """Write ``folder``'s shards; the manifest has one row per sequence.

    ``folder`` is a URI that all executors can write to. The manifest has the slot, the shard and
    the byte where the record starts, the sequence's number, the documents in it in order, how
    many ids it has before padding, and the crc32 of the record.
    """
    spark = docs.sparkSession
    sample = docs.select(F.col(text).cast("string").alias("text")).where("text is not null").limit(DICTIONARY_DOCS)
    ids = [tokens.encode(r["text"][:4096], vocabulary) for r in sample.collect()]
    dictionary = np.concatenate([np.zeros(0, np.uint32), *ids]).astype("<u2").tobytes()[:DICTIONARY_BYTES]

    def coded(piece: np.ndarray) -> bytes:
        return coder(dictionary)[0].compress(packing.small_ids(piece))

    cut = packing.pieces(docs, doc_key, text, size, vocabulary, coded)
    placed = packing.place(cut, size)
    last = placed.agg(F.max("sequence_id")).first()[0]
    count = 0 if last is None else last + 1

    @F.pandas_udf("long")
    def slot_of(numbers):
        import pandas as pd

        return pd.Series(permuted(numbers.to_numpy(), count, key))

    slotted = placed.select("doc_id", "sequence_id", "offset", "ids", slot_of("sequence_id").alias("slot"))
    shards = slotted.withColumn("shard", F.floor(F.col("slot") / shard_sequences))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = shards.repartitionByRange(parts, "shard").sortWithinPartitions("slot", "offset")
    schema = T.StructType(
        [
            T.StructField("slot", T.LongType()),
            T.StructField("shard", T.LongType()),
            T.StructField("byte", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(docs.schema[doc_key].dataType)),
            T.StructField("tokens", T.LongType()),
            T.StructField("record_crc32", T.LongType()),
        ]
    )
    doc_type = pa.int64() if isinstance(docs.schema[doc_key].dataType, T.LongType) else None
    stride = 2 * size

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(folder)
        unpack = coder(dictionary)[1]
        shard, records, rows = None, bytearray(), []

        def finished() -> pa.RecordBatch:
            for row in rows:
                at = row[2]
                filled = bytes(records[at : at + stride])
                row.append(zlib.crc32(filled))
            _placed(system, f"{root}/shard-{shard:010d}.bin", bytes(records))
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.list_(doc_type) if i == 4 and doc_type else None) for i, c in enumerate(columns)],
                names=schema.fieldNames(),
            )

        for batch in batches:
            names = ("doc_id", "sequence_id", "offset", "ids", "slot", "shard")
            for doc_id, sequence, offset, data, slot, number in zip(*(batch.column(c).to_pylist() for c in names)):
                if number != shard:
                    if shard is not None:
                        yield finished()
                    shard, records, rows = number, bytearray(), []
                at = slot % shard_sequences * stride
                if not rows or rows[-1][0] != slot:
                    rows.append([slot, number, at, sequence, [], 0])
                    records.extend(np.full(size, PADDING, "<u2").tobytes())
                raw = unpack.decompress(data)
                records[at + 2 * offset : at + 2 * offset + len(raw)] = raw
                rows[-1][4].append(doc_id)
                rows[-1][5] += len(raw) // 2
        if shard is not None:
            yield finished()

    system, root = pafs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    return stored(ordered.mapInArrow(write, schema))


def read_slots(folder: str, first: int, count: int, size: int = packing.SEQUENCE_TOKENS, shard_sequences: int = SHARD_SEQUENCES) -> Iterator[np.ndarray]:
    """The records from slot ``first`` on, by one seek and sequential reads."""
    system, root = pafs.FileSystem.from_uri(folder)
    stride, slot = 2 * size, first
    while slot < first + count:
        shard, place = divmod(slot, shard_sequences)
        with system.open_input_file(f"{root}/shard-{shard:010d}.bin") as file:
            file.seek(place * stride)
            for _ in range(min(shard_sequences - place, first + count - slot)):
                yield np.frombuffer(file.read(stride), "<u2")
                slot += 1


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(documents(spark, sf_dir), f"{new_folder(spark)}/shards", key=20240229)
