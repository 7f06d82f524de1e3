"""Literal, case-folded, whole-word and wildcard search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.lineage import cut
from scriptorium.operators.carry import overlap_join
from scriptorium.operators.positions import positions
from scriptorium.schema import check, check_search, with_story

_FIELDS = ("part", "story", "idx", "offset", "length", "text", "before", "after", "note_id")


def find(
    paragraphs: DataFrame,
    text: str,
    match_case: bool = True,
    whole_word: bool = False,
    max_results: int | None = None,
    context_chars: int = 40,
    scope: str = "body",
) -> DataFrame:
    """All matches with character offsets and context. Narrow: nothing is shuffled.

    A ``max_results`` keeps so many per document, numbered across its stories by ``match_no``;
    ``truncated`` tells that it left matches out.
    """
    check_search(text, max_results, context_chars)
    check(scope in ("body", "all"), "scope must be body or all")
    searched = with_story(paragraphs)
    if scope == "body":
        searched = searched.where(F.col("story") == "body")
    limit = None if max_results is None else max_results + 1
    body = F.col("text")
    hay = body if match_case else X.fold(body)
    wanted = text if match_case else X.fold_literal(text)
    hits = X.literal_matches(body, text, match_case, whole_word, limit, context_chars)
    found = searched.where(hay.contains(F.lit(wanted))).select(
        "doc_id", "story_ord", "part", "story", "idx", F.explode(hits).alias("_m"), "note_id"
    )
    found = found.select(
        "doc_id",
        "story_ord",
        "part",
        "story",
        "idx",
        "_m.offset",
        F.lit(len(wanted)).alias("length"),
        "_m.text",
        "_m.before",
        "_m.after",
        "note_id",
    )
    if max_results is None:
        return found.select("doc_id", *_FIELDS)
    return cap(found, ["story_ord", "idx", "offset"], max_results).select(
        "doc_id", *_FIELDS, "match_no", "truncated"
    )


def cap(matches: DataFrame, order: list[str], max_results: int) -> DataFrame:
    """The first ``max_results`` matches of each document, and whether more exist.

    The rank filter becomes a group limit that runs before the shuffle, so a document with
    very many matches sends at most ``max_results + 1`` rows per task.
    """
    ranked = matches.withColumn(
        "match_no", F.row_number().over(W.partitionBy("doc_id").orderBy(*order))
    ).where(F.col("match_no") <= max_results + 1)
    more = F.max("match_no").over(W.partitionBy("doc_id")) > max_results
    return ranked.withColumn("truncated", more).where(F.col("match_no") <= max_results)


def match_summary(
    paragraphs: DataFrame,
    text: str,
    match_case: bool = True,
    whole_word: bool = False,
    max_results: int | None = None,
    scope: str = "body",
) -> DataFrame:
    """Per document with matches: how many there are, and whether more than ``max_results``.

    Counts matches per paragraph and adds them up, so no match row is ever built.
    """
    check_search(text, max_results, 0)
    searched = with_story(paragraphs)
    if scope == "body":
        searched = searched.where(F.col("story") == "body")
    wanted = text if match_case else X.fold_literal(text)
    hay = F.col("text") if match_case else X.fold(F.col("text"))
    pattern = X.quoted(wanted)
    pattern = X.whole_word(pattern) if whole_word else pattern
    return (
        searched.where(hay.contains(F.lit(wanted)))
        .groupBy("doc_id")
        .agg(F.sum(F.regexp_count(hay, F.lit(pattern))).alias("_all"))
        .where("_all > 0")
        .select(
            "doc_id",
            F.col("_all").alias("count"),
            (F.lit(False) if max_results is None else F.col("_all") > max_results).alias("truncated"),
        )
    )


def find_each(
    paragraphs: DataFrame, terms: DataFrame, context_chars: int = 40
) -> DataFrame:
    """Whole-word matches of many search texts in one pass.

    ``terms`` holds texts in ``term``, of one word or more, with anything between and around
    them; one without any word is an error. Paragraphs are cut into words once. Bare words are
    joined with the first words of the terms, so the cost does not grow with paragraphs times
    terms, and only then texts and contexts are looked at. Nothing is aggregated between the
    shuffles and the join, so a frequent word can be split over tasks.
    """
    word = f"(?<![{X.WORD_CLASS}])[{X.WORD_CLASS}]+(?![{X.WORD_CLASS}])"
    first = F.regexp_extract("term", word, 0)
    lead = F.length(F.split("term", word, 2)[0])
    no_word = F.raise_error(F.concat(F.lit("a search text without a word: "), "term"))
    keyed = cut(
        terms.where("term is not null").select("term").distinct().select(
            "term", F.when(first == "", no_word).otherwise(first).alias("_word"), lead.alias("_lead")
        )
    )
    spans = F.transform(X.pattern_spans(F.col("text"), word), lambda m: F.struct(m["offset"].alias("at"), m["text"].alias("word")))
    story = with_story(paragraphs).select("doc_id", "part", "story", "idx", "text")
    words = story.select("doc_id", "part", "story", "idx", F.explode(spans).alias("_w"))
    places = words.select("doc_id", "part", "story", "idx", "_w.at", F.col("_w.word").alias("_word")).join(keyed, "_word").where("at >= _lead")
    wanted = places.groupBy("doc_id", "part", "story", "idx").agg(
        F.collect_list(F.struct("term", (F.col("at") - F.col("_lead")).alias("offset"))).alias("_hits")
    )
    keys = ["doc_id", "part", "story", "idx"]
    wanted = wanted.toDF(*[f"_{k}" for k in keys], "_hits")
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_{key}"))
    joined = story.join(wanted, same).select(*keys, "text", "_hits")
    edge = f"[{X.WORD_CLASS}]"

    def looked_up(hit: Column, parts: Column) -> Column:
        length = F.length(hit["term"])
        start = F.greatest(hit["offset"] - context_chars, F.lit(0))
        return F.struct(
            hit["term"].alias("term"),
            hit["offset"].alias("offset"),
            X.between(parts, hit["offset"], length).alias("held"),
            X.between(parts, F.greatest(hit["offset"] - 1, F.lit(0)), F.least(hit["offset"], F.lit(1))).alias("left"),
            X.between(parts, hit["offset"] + length, F.lit(1)).alias("right"),
            X.between(parts, start, hit["offset"] - start).alias("before"),
            X.between(parts, hit["offset"] + length, F.lit(context_chars)).alias("after"),
        )

    cells = X.let(X.pieces(F.col("text")), lambda parts: F.transform("_hits", lambda h: looked_up(h, parts)))
    rows = joined.select(*keys, F.explode(cells).alias("_h")).select(*keys, "_h.*")
    return rows.where((F.col("held") == F.col("term")) & ~F.col("left").rlike(edge) & ~F.col("right").rlike(edge)).select(
        "doc_id", "term", "part", "story", "idx", "offset", "before", "after"
    )


# How each wildcard of the search syntax reads as a regular expression.
WILDCARDS = {"?": ".", "*": ".*?", "<": r"\b(?=\w)", ">": r"\b(?<=\w)"}


def wildcard_pattern(text: str) -> str:
    """The search syntax ``? * [a-z] {n} < >`` as a regular expression."""
    out: list[str] = []
    at = 0
    while at < len(text):
        char = text[at]
        if char == "[" and (close := text.find("]", at + 1)) > 0:
            inside = text[at + 1 : close]
            negated = inside.startswith("!")
            body = re.sub(r"([\\\[\]^&])", r"\\\1", inside.removeprefix("!"))
            out.append(f"[{'^' if negated else ''}{body}]")
            at = close
        elif char == "{" and (times := re.match(r"\{\d+(,\d*)?\}", text[at:])):
            out.append(times.group())
            at += times.end() - 1
        elif char == "\\" and at + 1 < len(text):
            at += 1
            out.append(re.escape(text[at]))
        else:
            out.append(WILDCARDS.get(char) or re.escape(char))
        at += 1
    return "(?sU)" + "".join(out)


def find_positions(
    paragraphs: DataFrame,
    text: str,
    match_case: bool = True,
    whole_word: bool = False,
    wildcards: bool = False,
    max_results: int | None = None,
    context_chars: int = 40,
) -> DataFrame:
    """Matches with UTF-16 positions in the whole story; context crosses paragraph ends.

    The context of the matches is read by an interval join on position buckets.
    """
    check_search(text, max_results, context_chars)
    check("\r" not in text, "a search text cannot hold a paragraph mark")
    limit = None if max_results is None else max_results + 1
    body = F.col("text")
    if wildcards:
        pattern = wildcard_pattern(text)
        if not match_case:
            pattern = "(?iu)" + pattern
        if whole_word:
            pattern = X.whole_word(pattern)
        spans = F.filter(X.matches(body, pattern, limit=limit, units=True), lambda m: F.length(m["text"]) > 0)
    else:
        spans = X.literal_matches(body, text, match_case, whole_word, limit, units=True)
    placed = positions(paragraphs)
    hits = placed.select("doc_id", "idx", "start", F.explode(spans).alias("_m")).select(
        "doc_id",
        F.col("idx").alias("paragraph"),
        (F.col("start") + F.col("_m.unit")).alias("start"),
        F.col("_m.text").alias("text"),
        (F.col("start") + F.col("_m.unit") + F.col("_m.unit_length")).alias("end"),
    )
    if max_results is not None:
        hits = cap(hits, ["start"], max_results)
    return hits if context_chars == 0 else with_context(hits, placed, context_chars)


def with_context(hits: DataFrame, placed: DataFrame, units: int) -> DataFrame:
    """Add ``before`` and ``after``: up to ``units`` of the story around each match."""
    ranges = hits.select(
        "doc_id",
        F.col("start").alias("at"),
        F.col("end").alias("stop"),
        F.greatest(F.col("start") - units, F.lit(0)).alias("lo"),
        (F.col("end") + units).alias("hi"),
    )
    story = F.concat("text", F.lit("\r"))
    begin = F.col("start")

    def cut(first: str, last: str) -> F.Column:
        return X.utf16_slice(
            story,
            F.greatest(F.col(first) - begin, F.lit(0)),
            F.least(F.col(last) - begin, F.col("end") - begin),
        )

    pieces = (
        overlap_join(placed, ranges, ["doc_id"])
        .select(
            "doc_id",
            "at",
            F.struct(
                begin.alias("o"), cut("lo", "at").alias("b"), cut("stop", "hi").alias("a")
            ).alias("_p"),
        )
        # Pieces of one match's surroundings, so a group is small.
        .groupBy("doc_id", "at")
        .agg(F.array_sort(F.collect_list("_p")).alias("_p"))
        .select(
            "doc_id",
            F.col("at").alias("start"),
            F.array_join("_p.b", "").alias("before"),
            F.array_join("_p.a", "").alias("after"),
        )
    )
    return hits.join(pieces, ["doc_id", "start"])
