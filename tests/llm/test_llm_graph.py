"""Connected groups and linking against union-find."""

from __future__ import annotations

import random

from scriptorium.llm import graph
from scriptorium.llm.membership import Membership


def roots_of(links, ids=()):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in set(parent) | set(ids)}


def test_components_of_chains_stars_and_loops(spark):
    draw = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (300, 301), (301, 300)]
    links += [(draw.randint(400, 480), draw.randint(400, 480)) for _ in range(60)]
    got = {r.id: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in roots_of(links).items() if k in got} and set(got) == {x for a, b in links if a != b for x in (a, b)}


def test_no_links(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def paired(rest):
    left, right = rest.toDF("bucket", "a", "root_a"), rest.toDF("bucket", "b", "root_b")
    return left.join(right, "bucket").where("a < b and root_a <> root_b").select("a", "b").distinct()


def test_linked_loses_no_link(spark):
    draw = random.Random(9)
    members = [(bucket, i) for bucket in range(6) for i in sorted(draw.sample(range(40), 12))] + [(99, 77)]
    true = {(a, b) for a in range(40) for b in range(a + 1, 40) if draw.random() < 0.08}
    truth = spark.createDataFrame(sorted(true), "a long, b long")
    meeting = {(a, b) for k in range(6) for j, a in members if j == k for i, b in members if i == k and a < b}
    got = graph.linked(spark.createDataFrame(members, "bucket long, id long"), lambda ids: graph.Comparison(lambda pairs: pairs.join(truth, ["a", "b"]), lambda rest: paired(rest).join(truth, ["a", "b"])))
    got = {r.id: r.root for r in got.collect()}
    want = {k: v for k, v in roots_of(true & meeting).items()}
    assert {k: v for k, v in got.items() if k != v} == {k: v for k, v in want.items() if k != v}


def test_membership_never_misses(spark):
    frame = spark.createDataFrame([(i, "x") for i in range(2000)], "id long, other string")
    test = Membership(spark.createDataFrame([(i,) for i in range(0, 2000, 7)], "id long"))
    present = {r.id for r in test.present(frame, "id").collect()}
    absent = {r.id for r in test.absent(frame, "id").collect()}
    assert present | absent == set(range(2000)) and not present & absent
    assert set(range(0, 2000, 7)) <= present and len(present) < 320
