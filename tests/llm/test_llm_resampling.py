"""Importance resampling and its radix sort against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from scriptorium.llm import radix, resampling
from test_llm_words import plain


def brute(rows, items, runs, buckets, percent, least, seed=2024):
    def runs_of(text):
        words = plain(text) if text else []
        return words, [" ".join(words[i : i + k]) for k in range(1, runs + 1) for i in range(len(words) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own, aimed = [0] * buckets, [0] * buckets
    for held, texts in ((own, [t for _, t in rows]), (aimed, items)):
        for t in texts:
            for f in runs_of(t)[1]:
                held[bucket(f)] += 1
    total, target = sum(own), sum(aimed)
    gain = [math.floor(1000 * math.log((t + 1) * (total + buckets) / ((s + 1) * (target + buckets)))) for s, t in zip(own, aimed)]
    out = []
    for at, (key, text) in enumerate(rows):
        words, found = runs_of(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(found), weight, score, None, len(words), at])
    order = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[6]))
    for rank, row in enumerate(order[: percent * len(order) // 100], 1):
        row[4] = rank
    return [tuple(r[:5]) for r in out]


def odd_rows():
    draw = random.Random(3)
    vocabulary = ["".join(draw.choice("abcdeß1é") for _ in range(draw.randint(1, 9))) for _ in range(150)]
    text = lambda n: draw.choice([" ", ", ", "\n"]).join(draw.choice(vocabulary) for _ in range(n))
    rows = [(i * 7919 - 4000, text(draw.randint(1, 80))) for i in range(150)]
    rows += [(None, text(30)), (None, None), (5, text(25)), (5, rows[3][1]), (5, rows[3][1]), (6, ""), (7, "... !"), (8, "Z" * 400_000 + " a"), (9, "é" * 70 + " b")]
    return rows, [text(40) for _ in range(5)] + [None, ""]


@pytest.mark.parametrize("runs", [1, 3])
def test_against_brute_force(spark, runs):
    rows, items = odd_rows()
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, weight string").coalesce(1)
    target = spark.createDataFrame([(t,) for t in items], "text string")
    got = resampling.ranked(docs, target, percent=40, runs=runs, buckets=97).orderBy("row").collect()
    want = brute(rows, items, runs, 97, 40, 20)
    assert [(r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got] == want
    assert any(w[4] for w in want)


def test_resample_keeps_clashing_columns_and_takes_empty_tables(spark):
    rows, items = odd_rows()
    docs = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "doc_id long, text string, rank int, _row string").coalesce(1)
    target = spark.createDataFrame([(t,) for t in items], "text string")
    want = {i for i, w in enumerate(brute(rows, items, 1, 10_000, 10, 20)) if w[4]}
    out = resampling.resample(docs, target)
    assert out.columns == docs.columns and {r["rank"] for r in out.collect()} == want
    assert resampling.resample(docs.limit(0), target).collect() == []
    none = resampling.ranked(docs.limit(0), target.limit(0))
    assert none.collect() == [] and "rank" in none.columns
    assert {r.weight for r in resampling.ranked(docs, target.limit(0)).collect()} != {0}


def test_places_of_ties_and_wide_keys(spark, monkeypatch):
    monkeypatch.setattr(radix, "CHUNK", 4)
    monkeypatch.setattr(radix, "PLACES", 16)
    draw = random.Random(4)
    values = [-(1 << 63), (1 << 63) - 1, 0, -1, 1 << 40]
    rows = [(i * 3, draw.randint(-2, 2), draw.choice(values), 7) for i in range(300)]
    keyed = spark.createDataFrame(rows, "row long, a long, b long, same long").repartition(5)
    got = {r.row: r.place for r in radix.places(keyed, ["a", "b", "same"]).collect()}
    assert got == {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2], r[0])))}
    assert [r.place for r in radix.places(keyed.limit(1), ["same"]).collect()] == [0]


def test_crc_of_words():
    texts = pa.array(["a bb " + "c" * 47 + " " + "d" * 48 + " " + "e" * 49 + " ü" * 3 + " " + "F" * 1000])
    (found, _), *_ = resampling.features(texts, 1, 1 << 31)
    assert found.tolist() == [zlib.crc32(w.encode()) % (1 << 31) for w in plain(texts[0].as_py())]
    assert np.array_equal(radix.destinations(np.array([3, 1, 3, 1]), np.arange(radix.RADIX) * 10), [30, 10, 31, 11])
