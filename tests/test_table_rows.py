"""Rows of table cells, whose pieces are sorted once and gathered in batches."""

from __future__ import annotations

import random

import pytest

from scriptorium.operators import structure

SHAPE = "doc_id string, block_id int, row_id int, cell_id int, span int"
CELLS = "doc_id string, block_id int, row_id int, cell_id int, idx int, text string"


@pytest.fixture
def small_batches(spark):
    """Three pieces a batch, so that cells, rows and tables go on in the next."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    yield
    spark.conf.set(name, before)


def expected(shape, cells, gap):
    out = {}
    for *row, cell, span in shape:
        found = out.setdefault(tuple(row), {}).setdefault(cell, [[], []])
        found[0] += [span] * (span is not None)
    for *row, cell, idx, text in cells:
        if text:
            out.setdefault(tuple(row), {}).setdefault(cell, [[], []])[1].append((idx is not None, idx or 0, text))
    joined = lambda texts: gap.join(t for *_, t in sorted(texts))
    return {
        row: [(c, joined(texts), max(spans, default=None)) for c, (spans, texts) in sorted((c, v) for c, v in held.items() if c is not None)]
        for row, held in out.items()
    }


def test_rows_of_cells_over_batches(spark, small_batches):
    rng = random.Random(3)
    rows = [(doc, block, row) for doc in ("a", "b", None) for block in (0, 1) for row in (0, 4, None)]
    shape = [(*row, cell, rng.choice([1, 2, None])) for row in rows for cell in (None, 0, 1, 7) if rng.random() < 0.8]
    cells = [
        (*row, rng.choice([None, 0, 1, 2, 7]), rng.choice([None, 1, 2, 30]), rng.choice(["", None, "x", "é y", "z"]))
        for row in rows
        for _ in range(rng.choice([0, 2, 9]))
    ]
    # One cell of many paragraphs, and a row of nothing but itself.
    cells += [("long", 0, 0, 0, n, f"t{n}") for n in range(40)]
    shape += [("empty", 0, 0, None, 1)]
    found = structure.rows_of_cells(spark.createDataFrame(shape, SHAPE), spark.createDataFrame(cells, CELLS), "|").collect()
    got = {(r.doc_id, r.block_id, r.row_id): [tuple(c) for c in r.cells] for r in found}
    assert len(got) == len(found)
    assert got == expected(shape, cells, "|")


def test_rows_of_cells_without_rows(spark):
    assert structure.rows_of_cells(spark.createDataFrame([], SHAPE), spark.createDataFrame([], CELLS), " ").collect() == []


def test_rows_of_cells_are_sorted_once(spark):
    """No list of pieces is aggregated, which sorted all of them again for cells and for rows, in two steps each."""
    shape, cells = spark.createDataFrame([], SHAPE), spark.createDataFrame([], CELLS)
    plan = structure.rows_of_cells(shape, cells, " ")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    assert plan.count("Sort [") == 1 and plan.count("hashpartitioning") == 1
