"""Every query on empty tables, and on rows with nulls, repeats, odd texts and columns named like their own."""

from __future__ import annotations

from collections import Counter

import pytest

from scriptorium.llm import registry

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row int, row int, score double, words string, tokens int, found int, rank int"
#: Queries with one row for every document.
EACH = ("op3", "op4", "op6", "op7", "op8", "op9", "op10", "op12", "op13")


def written(spark, folder, rows):
    line = lambda n: " ".join(f"{chr(97 + (n * 7 + k * k) % 26)}word{n * k % 89}" for k in range(30))
    own = (1, 2, 0.5, "w", 3, 4, 5)
    docs = spark.createDataFrame([(k, t, lang, "s", len(t or ""), *own) for k, t, lang in rows(line)], SCHEMA)
    docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 0, k % 2) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, line(3)), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    def rows(line):
        out = [(k, line(k) + "\n" + line(k + 50), ("en", "de")[k % 2]) for k in range(40)]
        out += [(None, None, None), (None, line(3), "en"), (5, line(9), "de"), (5, line(9), "de"), (60, "", "en"), (61, "\n \t", None)]
        return out + [(62, "é" * 100_000, "fr"), (63, "a " * 60_000, "en"), (64, "…!?", "de")]

    return written(spark, tmp_path_factory.mktemp("odd"), rows)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("empty"), lambda line: [])


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n.split("_")[0] in EACH])
def test_every_document_has_its_row(spark, odd, name):
    ids = Counter(r.doc_id for r in spark.read.parquet(f"{odd}/documents.parquet").select("doc_id").collect())
    assert Counter(r.doc_id for r in registry.QUERIES[name](spark, odd).select("doc_id").collect()) == ids


@pytest.mark.parametrize("name", ["op1_token_counts", "op2_packing", "op5_training_order", "op11_vector_codes"])
def test_other_queries_take_odd_rows(spark, odd, name):
    got = registry.QUERIES[name](spark, odd).collect()
    assert bool(got) == (name != "op11_vector_codes")


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).collect() == []
