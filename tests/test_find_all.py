"""A registered search over package stories that keeps every match."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


def test_every_document_keeps_its_footnote_match(spark):
    found = entry.queries()["docx_find_all"](spark, str(DATA))
    each = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("story") == "footnote").alias("notes"))
    rows = each.collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert max(r.n for r in rows) > 5 and all(r.notes == 1 for r in rows)
