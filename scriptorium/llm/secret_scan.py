"""Secrets in texts: fixed patterns and a sliding-window entropy, in DataFrame functions alone.

The fixed kinds are assignments to names such as ``password``, access keys and long hexadecimal
runs. Entropy adds spans of candidate strings: runs of one character class in which some window
of ``WINDOW`` characters has at least the class's entropy. The window's counts change by one
character in and one out, and so does the sum that its entropy is made of. The allow list passes over
candidates that are a word of letters or a number, and windows that overlap a placeholder, whatever
else the candidate holds; fixed kinds are never passed over.

Positions are code points from 0, ends exclusive. Running sums work in blocks, so that time is in
proportion to the number of matches.

Defined results: a null text is empty and has no spans. Rows with the same or a null id are
scanned one by one. Overlapping spans of different kinds are all kept. Other columns are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.tables import documents


def any_case(words: str) -> str:
    """A pattern's letters in either case."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


# The patterns of the fixed kinds, and the least length of a match's value.
NAMES = any_case("password|passwd|secret|token|api_?key")
ASSIGN = rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: Characters of the sliding window.
WINDOW = 20


@dataclass(frozen=True)
class CharacterClass:
    """A kind of candidate: its pattern, and the least entropy of a window in bits."""

    kind: str
    pattern: str
    bits: float


CLASSES = (
    CharacterClass("entropy_hex", rf"[0-9a-fA-F]{{{WINDOW},}}", 3.0),
    CharacterClass("entropy_base64", rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}", 3.85),
)
#: Candidates that are one of these in whole are no secrets: words and numbers.
ALLOWED = (r"^[A-Za-z_-]+$", r"^[0-9]+$")
#: Placeholders and alphabets, in either case; windows that overlap one are passed over.
PLACEHOLDERS = ("example", "0123456789", "abcdefghij")
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, *(c.kind for c in CLASSES))
BLOCK = 256
SPAN = "array<struct<start:int,order:int,end:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def sums_before(values: Column) -> Column:
    """For each of an array of integers the sum of those before it."""

    def spread(numbers: Column) -> Column:
        count = F.size(numbers)
        starts = F.when(count > 0, F.sequence(F.lit(1), count, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        totals = F.transform(starts, lambda s: F.aggregate(F.slice(numbers, s, BLOCK), F.lit(0), lambda a, x: a + x))
        return let(running(totals, F.lit(0)), lambda bases: F.flatten(
            F.transform(starts, lambda s, i: running(F.slice(numbers, s, BLOCK), F.get(bases, i)))
        ))

    return let(values, spread)


def running(numbers: Column, base: Column) -> Column:
    """``sums_before`` of a short array, from ``base`` on."""
    start = F.struct(base.cast("int").alias("total"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(
        numbers,
        start,
        lambda a, x: F.struct((a.total + x).cast("int").alias("total"), F.concat(a.out, F.array(a.total)).alias("out")),
        lambda a: a.out,
    )


def found(text: Column, pattern: str, inner: Callable[[Column, Column, Column], Column], group: int = 0) -> Column:
    """``inner(match, group, start)`` for each match of ``pattern``; an empty array without any."""
    regex = F.lit(pattern)

    def placed(matches: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        lengths = F.zip_with(
            F.transform(gaps, lambda g: F.length(g)), F.transform(matches, lambda m: F.length(m)), lambda g, m: g + F.coalesce(m, F.lit(0))
        )
        starts = F.zip_with(sums_before(lengths), gaps, lambda s, g: s + F.length(g))
        inside = F.regexp_extract_all(text, regex, F.lit(group)) if group else matches
        cells = F.arrays_zip(matches.alias("m"), inside.alias("g"), F.slice(starts, 1, F.size(matches)).alias("s"))
        return F.transform(cells, lambda c: inner(c["m"], c["g"], c["s"]))

    return F.when(F.regexp(text, regex), let(F.regexp_extract_all(text, regex, F.lit(0)), placed))


def span(kind: str, start: Column, end: Column) -> Column:
    return F.struct(
        start.cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("order"), end.cast("int").alias("end")
    )


def _weight(count: int) -> float:
    return count * math.log2(count) if count else 0.0


def dense_part(candidate: Column, least: float) -> Column:
    """``(first, last)``: from the first window of at least ``least`` bits to the last one's end.

    A window's entropy is log2(n) - sum(c * log2(c)) / n over its counts c. One more of a
    character that stands there c times adds (c + 1) log2(c + 1) - c log2(c) to that sum. Null
    if no window has so much.
    """
    gain = F.array(*[F.lit(_weight(c + 1) - _weight(c)) for c in range(WINDOW)])
    most = (math.log2(WINDOW) - least) * WINDOW + 1e-9
    none = F.lit(None).cast("int")

    def walk(chars: Column) -> Column:
        def step(state: Column, at: Column) -> Column:
            into, out = F.get(chars, at), F.get(chars, at - WINDOW)

            def left(held: Column) -> Column:
                """The counts without the character that leaves, and the sum."""
                now = F.element_at(held, out)
                less = F.transform_values(held, lambda c, n: F.when(c == out, n - 1).otherwise(n))
                return F.when(
                    at >= WINDOW, F.struct(less.alias("held"), (state.total - F.get(gain, now - 1)).alias("total"))
                ).otherwise(F.struct(held.alias("held"), state.total.alias("total")))

            def entered(rest: Column) -> Column:
                """The same with the character that comes."""
                now = F.coalesce(F.try_element_at(rest.held, into), F.lit(0))
                more = F.when(now > 0, F.transform_values(rest.held, lambda c, n: F.when(c == into, n + 1).otherwise(n))).otherwise(
                    F.map_concat(F.map_filter(rest.held, lambda c, n: (n > 0) & (c != into)), F.create_map(into, F.lit(1)))
                )
                total = rest.total + F.get(gain, now)
                dense = (at >= WINDOW - 1) & (total <= most)
                return F.struct(
                    more.alias("held"),
                    total.alias("total"),
                    F.when(dense & state.first.isNull(), at - WINDOW + 1).otherwise(state.first).alias("first"),
                    F.when(dense, at + 1).otherwise(state.last).alias("last"),
                )

            return let(left(state.held), entered)

        empty = F.create_map().cast("map<string,int>")
        start = F.struct(empty.alias("held"), F.lit(0.0).alias("total"), none.alias("first"), none.alias("last"))
        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), start, step)

    return let(F.split(candidate, ""), lambda chars: walk(F.slice(chars, 1, F.length(candidate))))


def without_placeholders(text: Column, placeholders: Sequence[str]) -> Column:
    """``text`` with blanks, which no candidate holds, in place of placeholders."""
    for word in placeholders:
        text = F.regexp_replace(text, any_case(word), " " * len(word))
    return text


def entropy_spans(text: Column, kind: CharacterClass, allowed: Sequence[str]) -> Column:
    """Spans of the candidates of a class that have a dense window and are not allowed."""

    def judged(match: Column, _: Column, start: Column) -> Column:
        passed = F.lit(False)
        for pattern in allowed:
            passed = passed | F.regexp(match, F.lit(pattern))
        return let(
            F.when(~passed, dense_part(match, kind.bits)),
            lambda part: F.when(part.first.isNotNull(), span(kind.kind, start + part.first, start + part.last)),
        )

    return F.filter(found(text, kind.pattern, judged), lambda s: s.isNotNull())


def scan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    classes: Sequence[CharacterClass] = CLASSES,
    allowed: Sequence[str] = ALLOWED,
    placeholders: Sequence[str] = PLACEHOLDERS,
) -> DataFrame:
    """``(doc_id, spans)`` with spans ``(start, order, end)`` by start, then by kind as in KINDS."""
    value = F.col("text")
    simple = lambda kind: lambda match, _, start: span(kind, start, start + F.length(match))
    assigns = F.filter(
        found(
            value,
            ASSIGN,
            lambda match, inside, start: F.when(
                F.length(inside) >= ASSIGN_LEAST, span("assign", start, start + F.length(match))
            ),
            group=2,
        ),
        lambda s: s.isNotNull(),
    )
    kinds = [assigns, found(value, ACCESS, simple("access")), found(value, HEX, simple("hex"))]
    kinds += [entropy_spans(F.col("plain"), c, allowed) for c in classes]
    every = F.concat(*[F.coalesce(k.cast(SPAN), F.array().cast(SPAN)) for k in kinds])
    read = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    read = read.withColumn("plain", without_placeholders(F.col("text"), placeholders))
    return read.select("doc_id", F.array_sort(every).alias("spans"))


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.order), s.start, s.end)), ",")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found_ = scan(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s.order < len(BASE_KINDS))
    number = lambda kind: F.size(F.filter("spans", lambda s: s.order == KINDS.index(kind))).cast("long")
    return found_.select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def _matches_sql(kind: str, pattern: str, value_group: int = 0, text: str = "t") -> str:
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""
SELECT r, '{kind}' AS kind, {KINDS.index(kind)} AS o, m[i] AS m, g[i] AS g,
       list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) AS s
FROM (SELECT r, m, g, p, unnest(range(1, len(m) + 1)) AS i
      FROM (SELECT r, regexp_extract_all({text}, {quoted}) AS m, regexp_extract_all({text}, {quoted}, {value_group}) AS g,
                   string_split_regex({text}, {quoted}) AS p
            FROM d WHERE regexp_matches({text}, {quoted})))"""


_PLAIN_SQL = "t"
for _word in PLACEHOLDERS:
    _PLAIN_SQL = f"regexp_replace({_PLAIN_SQL}, '{any_case(_word)}', '{' ' * len(_word)}', 'g')"


def _dense_sql(kind: CharacterClass) -> str:
    allowed = " AND ".join("NOT regexp_matches(m, '" + a.replace("'", "''") + "')" for a in ALLOWED)
    return f"""
SELECT r, kind, o, s + min(j) AS s, s + max(j) + {WINDOW} AS e
FROM (SELECT r, kind, o, m, s, unnest(range(0, length(m) - {WINDOW} + 1)) AS j
      FROM ({_matches_sql(kind.kind, kind.pattern, text=_PLAIN_SQL)}) WHERE {allowed})
WHERE list_aggregate(string_split(substring(m, CAST(j AS INTEGER) + 1, {WINDOW}), ''), 'entropy') + 1e-9 >= {kind.bits}
GROUP BY r, kind, o, m, s"""


OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), base AS (
  SELECT r, kind, o, s, s + length(m) AS e FROM ({_matches_sql("assign", ASSIGN, 2)}) WHERE length(g) >= {ASSIGN_LEAST}
  UNION ALL SELECT r, kind, o, s, s + length(m) AS e FROM ({_matches_sql("access", ACCESS)})
  UNION ALL SELECT r, kind, o, s, s + length(m) AS e FROM ({_matches_sql("hex", HEX)})
), every AS (
  SELECT * FROM base {" ".join("UNION ALL " + _dense_sql(c) for c in CLASSES)}
), told AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, o, e) FILTER (o < {len(BASE_KINDS)}) AS base,
         string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, o, e) AS spans
  FROM every GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (r)
"""
