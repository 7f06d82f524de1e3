"""Decontamination against brute force over words."""

from __future__ import annotations

import hashlib
import random

from scriptorium.llm import decontamination
from test_llm_words import plain


def brute(rows, items):
    out = []
    for doc_id, text in rows:
        words, hit, names = plain(text), set(), set()
        for name, item in items:
            terms = plain(item)
            size = min(13, len(terms))
            for i in range(len(terms) - size + 1 if size else 0):
                for at in range(len(words) - size + 1):
                    if words[at : at + size] == terms[i : i + size]:
                        hit |= set(range(at, at + size))
                        names.add("" if name is None else str(name))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=repr)


def fixture():
    draw = random.Random(8)
    word = lambda: draw.choice(["the", "of", "Ünd"]) if draw.random() < 0.4 else f"w{draw.randint(0, 60)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((30, 14, 13, 5, 40, 1))]
    items += [(2, " ".join(word() for _ in range(20))), (7, None), (8, "..."), (None, "zeta eta theta")]
    rows = []
    for i in range(40):
        text = [word() for _ in range(draw.randint(0, 200))]
        for _ in range(draw.randint(0, 3)):
            piece = (draw.choice(items)[1] or "").split()
            begin = draw.randint(0, max(0, len(piece) - 14))
            text[len(text) // 2 : len(text) // 2] = piece[begin : begin + draw.randint(10, 30)]
        rows.append((i, ", ".join(text)))
    rows += [(5, "zeta. ETA theta"), (None, "zeta eta theta " * 40), (90, None), (91, ""), (92, "?"), (93, items[0][1] * 300)]
    return rows, items


def test_against_brute_force(spark):
    rows, items = fixture()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, segment string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    index = decontamination.build_index(docs.repartition(3))
    found = decontamination.contamination(index, decontamination.find_items(index, bench)).collect()
    got = [
        (r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated)
        for r in found
    ]
    assert sorted(got, key=repr) == brute(rows, items)
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not r.contaminated for r in found)


def test_blocks_of_items_do_not_matter(spark, monkeypatch):
    rows, items = fixture()
    docs = spark.createDataFrame(rows[:12], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "SEGMENT_WORDS", 200)
    index = decontamination.build_index(docs)
    blocks = list(decontamination.query_blocks(bench, "item_id", "text", 40))
    assert len(blocks) > 1 and sum(len(b) for b in blocks) == len(items)
    spans = []
    for block in blocks:
        query = decontamination.windows_of(block)
        if query.windows:
            spans += decontamination.matches(index, query).collect()
    whole = decontamination.find_items(index, bench).collect()
    assert sorted(map(repr, spans)) == sorted(map(repr, whole))


def test_proximity_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta x gamma"), (2, "alpha " + "x " * 30 + "beta gamma")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "gamma alpha beta")], "item_id long, text string")
    index = decontamination.build_index(docs)
    assert decontamination.find_items(index, bench).collect() == []
    assert [r.doc_id for r in decontamination.find_items(index, bench, proximity=6).collect()] == [1]
    # The next document's words are not near: two and three lie in one segment.
    edges = spark.createDataFrame([(2, "x x gamma alpha"), (3, "beta x x"), (4, "beta gamma x alpha x")], "doc_id long, text string").coalesce(1)
    near = decontamination.find_items(decontamination.build_index(edges), bench, proximity=3).collect()
    assert [r.doc_id for r in near] == [4]
    nothing = decontamination.contamination(index, decontamination.find_items(index, bench.limit(0))).collect()
    assert sorted((r.doc_id, r.n_hit, r.contaminated) for r in nothing) == [(1, 0, False), (2, 0, False)]
    empty = decontamination.build_index(docs.limit(0))
    assert decontamination.contamination(empty, decontamination.find_items(empty, bench)).collect() == []
