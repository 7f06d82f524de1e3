"""Spans of words, which are the matches themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import text as X


def test_pattern_spans_cut_no_match_out_again(spark):
    texts = ["", "one", " one  two", "é𝐀b c", "x " * 3000]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    spans = X.pattern_spans(F.col("t"), r"[\p{IsAlphabetic}]+")
    found = frame.select("t", spans.alias("s"))
    assert "substring" not in found._jdf.queryExecution().optimizedPlan().toString()
    for row in found.collect():
        at, want = 0, []
        for word in row.t.split():
            at = row.t.index(word, at)
            want.append((at, word))
            at += len(word)
        assert [tuple(s) for s in row.s] == want
