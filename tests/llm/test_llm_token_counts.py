"""Rollups: signed changes, commits that happen once."""

from __future__ import annotations

from scriptorium.llm import token_counts
from scriptorium.llm.token_counts import DELETE, INSERT, REVISE, Rollup

CHANGES = "change_id string, action string, source string, lang string, tokenizer_version string, old_tokens long, new_tokens long, docs string"


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer_version): (r.docs, r.tokens) for r in rollup.totals().collect()}


def test_batches_add_up_and_commit_once(spark):
    rollup = Rollup(spark)
    assert totals(rollup) == {}
    first = [
        ("i1", INSERT, "s", "en", "v1", None, 10, "x"),
        ("i1", INSERT, "s", "en", "v1", None, 10, "x"),
        ("i2", INSERT, "s", "en", "v1", None, 5, "x"),
        ("i3", INSERT, None, None, "v1", None, None, "x"),
    ]
    second = [
        ("d1", DELETE, "s", "en", "v1", 10, None, "x"),
        ("r2", REVISE, "s", "en", "v1", 5, 8, "x"),
        ("i4", INSERT, "s", "en", "v2", None, 7, "x"),
    ]
    assert rollup.commit(1, spark.createDataFrame(first, CHANGES))
    assert totals(rollup) == {("s", "en", "v1"): (2, 15), (None, None, "v1"): (1, 0)}
    assert rollup.commit(2, spark.createDataFrame(second, CHANGES))
    after = {("s", "en", "v1"): (1, 8), ("s", "en", "v2"): (1, 7), (None, None, "v1"): (1, 0)}
    assert totals(rollup) == after
    assert not rollup.commit(2, spark.createDataFrame(second, CHANGES))
    assert rollup.commit(3, spark.createDataFrame([], CHANGES))
    assert totals(Rollup(spark, rollup.folder)) == after
    assert rollup.batches() == [1, 2, 3]


def test_unfinished_commit_is_not_counted_and_is_overwritten(spark):
    rollup = Rollup(spark)
    rows = spark.createDataFrame([("i", INSERT, "s", "en", "v1", None, 3, "x")], CHANGES)
    token_counts.delta(rows).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(rollup._path(1))
    assert totals(rollup) == {}
    assert rollup.commit(1, rows)
    assert totals(rollup) == {("s", "en", "v1"): (1, 3)}


def test_query_against_plain_counts(spark, tmp_path):
    from scriptorium.llm import tokens

    rows = [(1, "one two", "a", "en"), (2, "one two", "a", "en"), (3, " pad ", "b", None), (4, None, "b", "de"), (5, "", "a", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.source, r.lang): (r.docs, r.tokens) for r in token_counts.op1_token_counts(spark, str(tmp_path)).collect()}
    count = lambda t: len(tokens.encode(t))
    assert got == {("a", "en"): (2, count("one two")), ("b", None): (1, count("pad")), ("b", "de"): (1, 0)}


def test_query_counts_rows_with_null_and_repeated_ids(spark, tmp_path):
    from scriptorium.llm import tokens

    rows = [
        (None, "one", "a", "en"),
        (None, "two three", "a", "en"),
        (None, "one", "c", "en"),
        (7, "\n\tseven\u00a0\r\n", "b", "en"),
        (7, "other text ", "b", "de"),
        (7, "seven", "d", None),
        (8, "two three", "b", "en"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.source, r.lang): (r.docs, r.tokens) for r in token_counts.op1_token_counts(spark, str(tmp_path)).collect()}
    count = lambda *texts: (len(texts), sum(len(tokens.encode(t)) for t in texts))
    # Copies are equal as stored: the first "one" is that of source a, "two three" stays with id 8.
    assert got == {
        ("a", "en"): count("one"),
        ("c", "en"): (0, 0),
        ("b", "en"): count("seven", "two three"),
        ("b", "de"): count("other text"),
        ("d", None): count("seven"),
    }
