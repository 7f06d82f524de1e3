"""Fingerprints: estimates near the truth, edits and next documents."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa

from scriptorium.llm import fingerprints as P
from test_llm_words import plain


def shingle_set(text):
    words = plain(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def words(draw, n):
    return " ".join(f"w{draw.randint(0, 10**5)}é" for _ in range(n))


def test_estimates_are_unbiased_for_few_and_many_shingles():
    draw, errors = random.Random(3), []
    for n in (6, 20, 60, 300, 3000):
        for _ in range(30 if n < 1000 else 6):
            a = words(draw, n).split()
            b = a[: int(n * 0.7)] + words(draw, n - int(n * 0.7)).split()
            a, b = " ".join(a), " ".join(b)
            left, right = P.low_bits(pa.array([a])), P.low_bits(pa.array([b]))
            errors.append(P.likeness(*left, *right)[0] - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.35


def test_edits_and_next_documents(spark):
    draw = random.Random(5)
    texts = {i: words(draw, draw.randint(0, 200)) for i in range(0, 120, 2)} | {1: None, 3: "", 5: "?!", 7: "a b", 9: words(draw, 9000)}
    rows = [(i, t, "x", 1) for i, t in texts.items()]
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, run string, ahead int")
    got = {r.doc_id: r for r in P.edited_fingerprints(docs.repartition(3)).collect()}
    order = sorted(texts)
    assert sorted(got) == order
    for at, i in enumerate(order):
        own, after = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        quarter = len(own) // 4
        edited = own[: len(own) - quarter] + after[:quarter]
        row = got[i]
        assert (row.n_chars, row.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(row.near_edited - jaccard(own, edited)) < 0.2 and abs(row.near_next - jaccard(own, after)) < 0.2
        assert P.packed(*P.low_bits(pa.array([edited])))[0].as_py() == row.edited_fingerprint
        assert len(row.fingerprint) == (P.BINS if plain(own) else 0)


def test_ties_nulls_and_small_tables(spark):
    schema = "doc_id long, text string"
    assert P.edited_fingerprints(spark.createDataFrame([], schema)).collect() == []
    one = P.edited_fingerprints(spark.createDataFrame([(4, "abcdefgh")], schema)).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    rows = [(1, "bbbb"), (None, "nnnn"), (1, "aaaa"), (2, "cccc"), (1, "aaaa")]
    got = P.edited_fingerprints(spark.createDataFrame(rows, schema).repartition(4)).collect()
    ring = ["nnnn", "aaaa", "aaaa", "bbbb", "cccc"]
    want = sorted(hashlib.sha256((t[:3] + ring[(k + 1) % 5][:1]).encode()).hexdigest() for k, t in enumerate(ring))
    assert sorted(r.edited_sha256 for r in got) == want
    simple = P.fingerprints(spark.createDataFrame([(1, "a b c"), (2, "A, b c"), (3, None)], schema)).collect()
    assert simple[0].fingerprint == simple[1].fingerprint != "" and simple[2].fingerprint == ""
