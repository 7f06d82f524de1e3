"""The driver contract, and text queries against their reference SQL."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from scriptorium.plans import registry

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


def test_entry_returns_matches(spark):
    frame = entry.entry(spark)
    assert {"doc_id", "start", "end", "before", "after"} <= set(frame.columns)
    assert frame.count() > 0


def test_every_reference_query_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_against_reference_sql(spark, name):
    import compare

    columns, rows = compare.spark_rows(registry.QUERIES[name](spark, str(DATA)))
    assert rows
    if name in registry.SQL:
        want_columns, want, _ = compare.duck_rows(compare.connect(str(DATA)), registry.SQL[name])
        assert columns == want_columns and rows == want
