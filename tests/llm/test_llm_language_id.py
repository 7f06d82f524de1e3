"""Language identification: held-out accuracy and defined results."""

from __future__ import annotations

import random

from scriptorium.llm import language_id

VOCABULARY = {
    "aa": ["banana", "mandarin", "salad", "karma", "data", "mañana"],
    "bb": ["flüg", "grüsse", "trübe", "kühl", "übung", "stück"],
}


def text(lang: str, seed: int, words: int = 60) -> str:
    draw = random.Random(f"{lang}{seed}")
    return " ".join(draw.choice(VOCABULARY[lang]) + draw.choice(["", "s", "."]) for _ in range(words))


def test_held_out_texts_and_defined_results(spark):
    rows = [(i, text(lang, i), lang, "x") for lang in VOCABULARY for i in range(40)]
    rows += [(100, None, "aa", "x"), (101, "", "aa", "x"), (102, "12 34 !", "bb", "x"), (103, text("aa", 1), None, "x")]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    learnt = language_id.dictionaries(train)
    assert set(learnt) == set(VOCABULARY) and all(len(d) <= language_id.DICTIONARY_BYTES for d in learnt.values())
    tests = [(i, text(lang, 1000 + i), lang) for lang in VOCABULARY for i in range(30)]
    tests += [(200, None, "und"), (201, "", "und"), (202, "12 34", "und"), (203, text("bb", 5, 30000), "bb"), (0, "kühl stück übung flüg", "bb"), (None, text("aa", 7), "aa")]
    frame = spark.createDataFrame([(i, t, want, 0) for i, t, want in tests], "doc_id long, text string, want string, lang_pred int")
    got = language_id.predictions(frame, learnt, columns=("doc_id", "want")).collect()
    assert len(got) == len(tests)
    assert [r for r in got if r.lang_pred != r.want or not 0 <= r.score <= 1] == []
    assert all(r.rejected and r.score == 0 for r in got if r.want == "und")


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.dictionaries(empty) == {}
    rows = spark.createDataFrame([(1, "word")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in language_id.predictions(rows, {}).collect()] == [("und", 0.0)]


def test_narrow_margins_are_rejected(spark):
    learnt = {"aa": b"same words here", "bb": b"same words here"}
    row = language_id.predictions(spark.createDataFrame([(1, "same words")], "doc_id long, text string"), learnt).first()
    assert row.lang_pred == "aa" and row.rejected and row.score == 0.5
