"""Packing: patterns, exact ids, places without gaps."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scriptorium.llm import packing, tokens


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
def test_patterns_place_every_piece_once(histogram):
    packs = packing.patterns(histogram, 64)
    placed = Counter()
    for pattern, count in packs:
        assert sum(pattern) <= 64 and count > 0
        for length in pattern:
            placed[length] += count
    assert placed == Counter(histogram)
    ranks = defaultdict(list)
    for slot in packing.slots(packs):
        ranks[slot.length] += range(slot.first, slot.first + slot.count)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in histogram.items()}


def test_number_of_patterns_does_not_grow_with_the_documents():
    few = {length: 7 + length % 5 for length in range(1, 1025)}
    many = {length: count * 10**6 for length, count in few.items()}
    assert len(packing.patterns(many)) <= 4 * 1024


def test_pieces_hold_the_tokenizers_ids(spark):
    texts = ["Hello wörld", None, "", "a <|endoftext|> b", "many words " * 900, "Hello wörld", "x"]
    rows = [(i if i != 5 else 0, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "no id", "clash", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, offset int")
    got = packing.pack(docs.repartition(3)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for doc_id, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for start in range(0, len(ids), 1024):
            piece = ids[start : start + 1024]
            expected[(doc_id, start, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == expected
    for r in got:
        assert zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) == r.ids_crc32
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, with_ids=False).collect() == []


def test_long_runs_are_encoded_like_the_named_tokenizer():
    named = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in (" " * 1_200_000 + "x", "\n" * 1_000_001, "a\t" + " \n" * 100_000 + "é<|endoftext|>", "y" * 1_000_000, "z" + " " * 99_999 + "!"):
        assert tokens.encode(text).tolist() == named.encode(text, add_special_tokens=False).ids
    for piece in (" ", "\n", "a"):
        assert tokens.encode(piece * 3_000_000).size > 0
