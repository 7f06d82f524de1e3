"""Near-duplicates: unbiased signatures, and groups as brute force finds them."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from scriptorium.llm import near_dedup
from test_llm_graph import roots_of
from test_llm_words import plain


def bag(text):
    words = plain(text)
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def similarity(a, b):
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def test_signatures_estimate_weighted_similarity():
    draw = random.Random(2)
    base = [f"w{draw.randint(0, 10**6)}" for _ in range(300)]
    texts = [" ".join(base), " ".join(base[:270] + base[:30] * 2), "v w x y z " * 40, "v w x y z " * 60 + "q", "a b", "a b", None]
    of, values, weights = near_dedup.bags(pa.array(texts))
    registers = 4096
    found = near_dedup.signatures(of, values, weights, len(texts), registers)
    for i, j in ((0, 1), (2, 3), (4, 5), (0, 2)):
        want = similarity(bag(texts[i]), bag(texts[j]))
        assert abs((found[i] == found[j]).mean() - want) < 4 * np.sqrt(0.25 / registers)
    assert np.isinf(found[6]).all()


def test_bags_are_coded_exactly():
    values = np.sort(np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64))
    assert (near_dedup.decoded(near_dedup.coded(values)) == values >> np.uint64(24)).all()


def test_groups_against_brute_force(spark):
    draw = random.Random(5)
    word = lambda: f"w{draw.randint(0, 400)}"
    texts = []
    for _ in range(12):
        base = [word() for _ in range(draw.randint(40, 160))]
        for edits in (0, 0, 1, 2, 3, 5):
            copy = list(base)
            for _ in range(edits):
                copy[draw.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    rows = [(i, t) for i, t in enumerate(texts)] + [(200, None), (201, ""), (202, "?!"), (203, ""), (204, "one two"), (205, "One, two"), (3, "alone here")]
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id long, text string, row string, keep int")
    bags = [bag(t) for _, t in rows]
    links = {(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if bags[a] and bags[b] and similarity(bags[a], bags[b]) >= 0.8}
    roots = roots_of(links, range(len(rows)))
    least = {}
    for at, root in roots.items():
        least[root] = min(least.get(root, 10**9), rows[at][0])
    want = Counter((rows[at][0], least[root]) for at, root in roots.items())
    got = near_dedup.groups(docs.repartition(3)).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == want
    assert sum(r.keep for r in got) == len(set(roots.values()))
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots.values()))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.groups(docs).collect() == []
