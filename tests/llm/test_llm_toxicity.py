"""Toxicity: proper Kneser-Ney models, separation on held-out texts, defined results."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from scriptorium.llm import toxicity
from scriptorium.llm.words import split


def spelled(texts):
    return toxicity.distinct(split(pa.array(texts)))


def test_probabilities_of_next_symbols_add_up_to_one():
    _, counts, words = spelled(["banana bandana cab", "banana"])
    keys = toxicity.grams(words, toxicity.ORDER)
    shared = {}
    weight = np.repeat(counts, np.diff(words.begins, append=len(words.symbols)))
    for k, fits in ((toxicity.SHARED, words.depth >= toxicity.SHARED), (2, words.depth == 2)):
        for key, n in zip(keys[k - 1][fits].tolist(), weight[fits].tolist()):
            shared[key] = shared.get(key, 0) + n
    base = toxicity.base_model(shared)
    np.testing.assert_allclose(base.bigram.sum(axis=1), 1, atol=1e-9)
    held = np.bincount(np.searchsorted(base.contexts, base.keys // np.uint64(toxicity.SYMBOLS + 1)), base.share)
    np.testing.assert_allclose(held + base.rest, 1, atol=1e-9)
    for k, (found, sums, context) in enumerate(toxicity.adjusted(keys, words, counts, toxicity.ORDER), 1):
        share, contexts, rest = toxicity.discounted(found, sums, context)
        if k > 1:
            held = np.bincount(np.searchsorted(contexts, context), share)
            np.testing.assert_allclose(held + rest, 1, atol=1e-9)


def test_adjusted_counts_are_left_neighbours_or_occurrences():
    _, counts, words = spelled(["xab yab ab ab"])
    keys = toxicity.grams(words, toxicity.ORDER)
    by_key = dict(zip(*toxicity.adjusted(keys, words, counts, toxicity.ORDER)[1][:2]))
    # "ab" stands after x, y and a word's start; a word starts with "a" twice.
    at_ab = next(i for i in range(len(words.symbols)) if words.depth[i] == 3 and words.symbols[i] == words.symbols[i - 1] + 1 and words.symbols[i - 2] == 0)
    assert by_key[keys[1][at_ab]] == 3
    assert by_key[keys[1][at_ab - 1]] == 2


def test_table_finds_all_and_only_its_keys():
    draw = np.random.default_rng(3)
    keys = np.unique(draw.integers(0, 2**63, 5000).astype(np.uint64))
    table = toxicity.Table(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()


def sample(toxic: bool, seed: int) -> str:
    draw = random.Random(seed * 2 + toxic)
    plain = ["river", "mountain", "garden", "window", "table", "quiet", "morning", "paper", "stone", "light"]
    words = [draw.choice(plain) + draw.choice(["", "s", "ly"]) for _ in range(draw.randint(20, 120))]
    if toxic:
        for _ in range(max(2, len(words) // 12)):
            words.insert(draw.randint(0, len(words)), draw.choice(["grumblefool", "nastywort", "vileknave"]))
    return " ".join(words)


def test_held_out_texts_and_defined_results(spark):
    train = [(i, sample(i % 4 == 0, i), int(i % 4 == 0)) for i in range(600)]
    test = [(i, sample(i % 4 == 0, i), int(i % 4 == 0)) for i in range(1000, 1100)]
    odd = [(2000, None, None), (2001, "", None), (2002, "!!", None), (1000, sample(True, 1), 1), (None, "river", 0), (2003, sample(False, 5) * 200, 0)]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in train + test + odd], "doc_id long, text string, evidence string, score double")
    labels = [(i, y) for i, _, y in train] + [(None, 1), (1000, None), (3, 1), (3, 0)]
    fitted = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.scores(docs, fitted).collect()
    assert len(got) == len(train + test + odd) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.score for r in got if r.doc_id and r.doc_id > 1000}
    right = sum((by_id[i] >= 0.5) == bool(y) for i, _, y in test if i > 1000)
    assert right >= 0.95 * len([t for t in test if t[0] > 1000])
    assert by_id[2000] == by_id[2001] == by_id[2002] == fitted.share
    kept = toxicity.without_toxic(docs, fitted)
    assert kept.columns == docs.columns and 0 < kept.count() < len(got)


def test_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.scores(docs, none).collect()] == [0.0, 0.0]
    all_ = toxicity.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.scores(docs, all_).collect()] == [1.0, 1.0]
