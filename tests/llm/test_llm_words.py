"""Words, shingles and blocks against plain regular expressions."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB9 é,ß\n日", max_size=30)), max_size=6))
def test_split_finds_the_same_words(texts):
    found = words.split(pa.array(texts, pa.string()))
    expected = [plain(t) for t in texts]
    assert found.counts.tolist() == [len(w) for w in expected]
    flat = [w for text in expected for w in text]
    by_word = dict(zip(flat, found.hashes.tolist()))
    assert [by_word[w] for w in flat] == found.hashes.tolist()
    assert len(set(by_word.values())) == len(by_word)


def test_slices_and_batches_do_not_matter():
    texts = ["one two", None, "", "three", "one"]
    whole = words.split(pa.array(texts))
    part = words.split(pa.array(["x y", *texts]).slice(1))
    assert whole.hashes.tolist() == part.hashes.tolist()
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    pieces = list(words.blocks(iter([batch]), "text", limit=4))
    assert sum(p.num_rows for p in pieces) == len(texts)


def test_shingles_of_short_and_long_texts():
    texts = ["a b c d e f", "a b c d e", "a b", "b a", "", None, "b c d e f"]
    values, of = words.shingles(words.split(pa.array(texts)))
    assert np.bincount(of, minlength=len(texts)).tolist() == [2, 1, 1, 1, 0, 0, 1]
    assert values[0] == values[2] and values[1] == values[5]
    assert values[3] != values[4]
