"""Vector codes against plain Lloyd rounds, and cover trees against all distances."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from scriptorium.llm import cover_tree, vector_codes


def clustered(draw, n, width, spread):
    centres = draw.integers(-300, 300, (6, width))
    return (centres[draw.integers(0, 6, n)] + draw.integers(-spread, spread + 1, (n, width))).astype(np.int64)


@pytest.mark.parametrize("n,width,spread", [(1, 3, 0), (300, 2, 0), (500, 1, 40), (700, 16, 3), (400, 8, 200)])
def test_trees_cover_and_assign_like_all_distances(n, width, spread):
    draw = np.random.default_rng(n)
    rows = clustered(draw, n, width, spread)
    tree = cover_tree.built(rows)
    assert np.array_equal(tree.points[tree.place], rows) and tree.weights.sum() == n
    loaded = cover_tree.CoverTree.loaded(tree.dumped())
    for node in range(len(tree.centre)):
        inside = tree.points[tree.begin[node] : tree.end[node]].astype(np.int64)
        away = ((inside - tree.points[tree.centre[node]]) ** 2).sum(axis=1)
        assert away.max() == tree.radius[node]
        children = range(tree.child[node], tree.last[node])
        if children:
            assert sum(tree.end[c] - tree.begin[c] for c in children) == len(inside)
            centres = tree.points[[tree.centre[c] for c in children]].astype(np.int64)
            apart = cover_tree.squares(centres, centres) + np.eye(len(centres)) * 1e18
            assert apart.min(initial=1e18) > tree.radius[node] / 16 and max(tree.radius[c] for c in children) <= tree.radius[node]
    for count in (1, 2, 40):
        entries = np.vstack([clustered(draw, count, width, 100), rows[:1], rows[:1]])
        far = ((rows[:, None, :] - entries[None]) ** 2).sum(axis=2)
        runs = cover_tree.assigned(loaded, entries)
        got = cover_tree.entries_of(loaded, runs)
        assert np.array_equal(got, far.argmin(axis=1))
        counts, totals = cover_tree.sums(loaded, runs, len(entries))
        assert np.array_equal(counts, np.bincount(got, minlength=len(entries)))
        want = np.zeros_like(totals)
        np.add.at(want, got, rows)
        assert np.array_equal(totals, want)


def test_whole_subtrees_go_to_one_entry():
    draw = np.random.default_rng(1)
    tree = cover_tree.built(clustered(draw, 1000, 8, 4))
    entries = np.unique(clustered(np.random.default_rng(1), 200, 8, 0), axis=0)
    assert cover_tree.assigned(tree, entries).compared < 300 < len(tree.points)


def brute(rows, entries, parts=4, rounds=4):
    """Rounds in plain integers on the kept rows (id, vector) in order of id, then vector."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = {i: [math.floor(Fraction(x) * 1024) for x in v] for i, (_, v) in enumerate(rows)}
    width = len(rows[0][1]) // parts
    first = [[math.floor(Fraction(x) * 1024) for x in v] for _, v in order[:entries]]
    books = [[v[p * width : (p + 1) * width] for v in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(book))

    def near():
        return {(i, p): nearest(v[p * width : (p + 1) * width], books[p]) for i, v in whole.items() for p in range(parts)}

    for _ in range(rounds):
        given = near()
        for p in range(parts):
            for e in range(len(books[p])):
                held = [whole[i][p * width : (p + 1) * width] for i in whole if given[i, p][1] == e]
                if held:
                    books[p][e] = [sum(c) // len(held) for c in zip(*held)]
    given = near()
    return [("".join(f"{given[i, p][1]:02x}" for p in range(parts)), sum(given[i, p][0] for p in range(parts))) for i in whole], books


def test_against_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 16)
    draw = random.Random(8)
    vector = lambda: [float(np.float32(draw.choice([draw.gauss(0, 1), 0.5, -0.25]))) for _ in range(8)]
    hot = vector()
    good = [(draw.randint(-50, 50), hot if draw.random() < 0.3 else vector()) for _ in range(150)] + [(None, vector()), (None, hot)]
    bad = [(1, None), (2, hot[:7] + [None]), (3, hot[:7] + [math.nan]), (4, [math.inf] + hot[1:]), (5, hot[:4]), (6, [])]
    rows = [(k, v, draw.choice([None, 1, 2]), "c") for k, v in good + bad]
    schema = "vec_id long, embedding array<float>, label int, code string"
    found, books = vector_codes.compress(spark.createDataFrame(rows, schema), "vec_id", "embedding", ["label"], entries=20)
    want, entries = brute(good, 20)
    some = lambda r: (r[0] is None, r[0] or 0, str(r[1:]))
    assert sorted(map(tuple, found.collect()), key=some) == sorted([(k, r[2], *w) for (k, _), r, w in zip(good, rows, want)], key=some)
    assert [b.tolist() for b in books.parts] == entries
    assert books.decoded([want[0][0]]).shape == (1, 8)


def test_few_vectors_empty_tables_and_lengths_that_do_not_fit(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    few = [(3, [0.5] * 4, None), (1, [0.25] * 4, None), (2, [0.5, 0.5, 0.5, 0.25], 1)]
    frame(few).write.parquet(f"{tmp_path}/few/embeddings.parquet")
    got = {r.vec_id: r for r in vector_codes.op11_vector_codes(spark, f"{tmp_path}/few").collect()}
    assert {k: r.code for k, r in got.items()} == {1: "00000000", 2: "01010100", 3: "01010102"}
    assert got[1].error == 0 and got[3].label_error == got[1].label_error == 0 and len(got[1].codebooks_sha256) == 64
    frame([(1, None, 1)]).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert vector_codes.op11_vector_codes(spark, f"{tmp_path}/none").collect() == []
    for wrong in ([0.5] * 5, [2000.0] * 4):
        with pytest.raises(ValueError):
            vector_codes.compress(frame([(1, wrong, 1)]), "vec_id", "embedding")
