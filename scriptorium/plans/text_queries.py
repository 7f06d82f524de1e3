"""Queries of the text operators over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.operators import paragraphs as P
from scriptorium.operators import positions as O
from scriptorium.operators import search as S
from scriptorium.plans.tables import lines, table, turns

# Fragments shared by the reference SQL. All of it runs over whole tables.
LINES_SQL = """lines AS (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS idx, parts[i] AS text
  FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)))"""
TURNS_SQL = """turns AS (
  SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS idx, text FROM conversations)"""


def units_sql(text: str) -> str:
    """UTF-16 units: characters beyond the first plane count twice."""
    return (
        f"(length({text}) + length(regexp_replace({text}, "
        f"'[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"
    )


def positions_sql(source: str) -> str:
    units = units_sql("text")
    return f"""placed AS (
  SELECT doc_id, idx, text,
    CAST(sum({units} + 1) OVER w - {units} - 1 AS INTEGER) AS "start",
    CAST(sum({units} + 1) OVER w AS INTEGER) AS "end",
    CAST(sum({units} + 1) OVER (PARTITION BY doc_id) AS INTEGER) AS story_end
  FROM {source}
  WINDOW w AS (PARTITION BY doc_id ORDER BY idx))"""


def _found_sql(source: str, needle: str, text: str = "text", context: int = 40) -> str:
    """All literal matches of ``needle`` in ``text``, with context."""
    n = len(needle)
    return f"""gaps AS (
  SELECT doc_id, idx, text, string_split({text}, '{needle}') AS g FROM {source}),
hits AS (
  SELECT doc_id, idx, text,
    CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + (k - 1) * {n} AS INTEGER) AS "offset"
  FROM (SELECT doc_id, idx, text, g, unnest(generate_series(1, len(g) - 1)) AS k
        FROM gaps WHERE len(g) > 1)),
found AS (
  SELECT doc_id, 'word/document.xml' AS part, 'body' AS story, idx, "offset",
    CAST({n} AS INTEGER) AS "length",
    substring(text, "offset" + 1, {n}) AS text,
    substring(text, greatest("offset" - {context}, 0) + 1, "offset" - greatest("offset" - {context}, 0)) AS "before",
    substring(text, "offset" + {n} + 1, {context}) AS "after",
    CAST(NULL AS VARCHAR) AS note_id, text AS body
  FROM hits)"""


_FOUND = 'doc_id, part, story, idx, "offset", "length", text, "before", "after", note_id'
NEEDLE = "the"


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.listed(lines(spark, sf_dir))


def paragraph_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page(lines(spark, sf_dir), start=2, limit=5)


def joined_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.joined_text(lines(spark, sf_dir), chunk=64)


def find_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.find(lines(spark, sf_dir), NEEDLE, max_results=None)


def find_casefold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.find(lines(spark, sf_dir), "The", match_case=False, max_results=None)


def find_whole_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.find(lines(spark, sf_dir), NEEDLE, whole_word=True, max_results=None)


def find_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.find(lines(spark, sf_dir), NEEDLE, max_results=10)


def find_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.find(turns(spark, sf_dir), NEEDLE, context_chars=12)


def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.match_summary(lines(spark, sf_dir), NEEDLE, max_results=50)


def find_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word and the first two words of every benchmark item."""
    heads = [F.substring_index("text", " ", n).alias("term") for n in (1, 2)]
    items = table(spark, sf_dir, "benchmark")
    terms = items.select(F.explode(F.array(*heads)).alias("term")).where(F.col("term").rlike(r"[\p{L}\p{N}_]"))
    return S.find_each(lines(spark, sf_dir), terms)


def find_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.find_positions(lines(spark, sf_dir), "with", context_chars=60)


def find_wildcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.find_positions(
        lines(spark, sf_dir), "t[hn]?o", wildcards=True, max_results=None, context_chars=0
    )


def info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.info(lines(spark, sf_dir))


def info_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.info(turns(spark, sf_dir))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.positions(lines(spark, sf_dir)).select("doc_id", "idx", "start", "end")


def positions_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.positions(turns(spark, sf_dir)).select("doc_id", "idx", "start", "end", "story_end")


def text_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.text_slice(lines(spark, sf_dir), 50, 900)


def position_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "documents").select(
        "doc_id", (F.col("n_chars") / 2).cast("int").alias("position")
    )
    return O.paragraph_at(lines(spark, sf_dir), points).select(
        "doc_id", "position", "idx", "start"
    )


def md_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.escaped_markdown(lines(spark, sf_dir), in_table=True)


def emphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = turns(spark, sf_dir)
    bold, italic = F.col("idx") % 2 == 0, F.col("idx") % 3 == 0
    return turn.select("doc_id", "idx", X.emphasize(F.col("text"), bold, italic).alias("text"))


def invalid_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines XML cannot hold; every third line gets a control character to be found."""
    marked = F.when(F.col("idx") % 3 == 1, F.concat("text", F.lit("\x02"))).otherwise(
        F.col("text")
    )
    return P.invalid_texts(lines(spark, sf_dir).withColumn("text", marked))


QUERIES = {
    "paragraphs": paragraphs,
    "paragraph_page": paragraph_page,
    "joined_text": joined_text,
    "find_literal": find_literal,
    "find_casefold": find_casefold,
    "find_whole_word": find_whole_word,
    "find_capped": find_capped,
    "find_turns": find_turns,
    "match_summary": match_summary,
    "find_each": find_each,
    "find_positions": find_positions,
    "find_wildcards": find_wildcards,
    "info": info,
    "info_turns": info_turns,
    "positions": positions,
    "positions_turns": positions_turns,
    "text_slice": text_slice,
    "position_lookup": position_lookup,
    "md_escape": md_escape,
    "emphasis": emphasis,
    "invalid_texts": invalid_texts,
}

_STORY = "SELECT doc_id, string_agg(text || chr(13), '' ORDER BY idx) AS story FROM lines GROUP BY doc_id"

SQL = {
    "paragraphs": f"""WITH {LINES_SQL}
SELECT doc_id, idx, text, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS total_paragraphs
FROM lines""",
    "paragraph_page": f"WITH {LINES_SQL} SELECT * FROM lines WHERE idx BETWEEN 2 AND 6",
    "joined_text": f"""WITH {LINES_SQL}
SELECT doc_id, CAST(idx // 64 AS INTEGER) AS piece,
  CASE WHEN idx // 64 > 0 THEN chr(10) ELSE '' END || string_agg(text, chr(10) ORDER BY idx) AS text
FROM lines GROUP BY doc_id, idx // 64""",
    "find_literal": f"WITH {LINES_SQL}, {_found_sql('lines', 'the')} SELECT {_FOUND} FROM found",
    "find_casefold": f"""WITH {LINES_SQL}, {_found_sql("lines", "the", "lower(text)")}
SELECT {_FOUND} FROM found""",
    "find_whole_word": f"""WITH {LINES_SQL}, {_found_sql("lines", "the")}
SELECT {_FOUND} FROM found
WHERE NOT regexp_matches(right("before", 1), '[\\p{{L}}\\p{{N}}_]')
  AND NOT regexp_matches(left("after", 1), '[\\p{{L}}\\p{{N}}_]')""",
    "find_capped": f"""WITH {LINES_SQL}, {_found_sql("lines", "the")},
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx, "offset") AS n,
  count(*) OVER (PARTITION BY doc_id) AS c FROM found)
SELECT {_FOUND}, CAST(n AS INTEGER) AS match_no, c > 10 AS truncated FROM ranked WHERE n <= 10""",
    "find_turns": f"""WITH {TURNS_SQL}, {_found_sql("turns", "the", context=12)}
SELECT {_FOUND} FROM found""",
    "match_summary": f"""WITH {LINES_SQL}, {_found_sql("lines", "the")}
SELECT doc_id, count(*) AS "count", count(*) > 50 AS truncated
FROM found GROUP BY doc_id""",
    "find_each": f"""WITH {LINES_SQL},
terms AS (SELECT DISTINCT unnest([string_split(text, ' ')[1], array_to_string(string_split(text, ' ')[1:2], ' ')]) AS term FROM benchmark),
places AS (SELECT doc_id, idx, text, term, unnest(generate_series(0, length(text) - length(term))) AS spot
  FROM lines JOIN terms ON contains(text, term) WHERE regexp_matches(term, '[\\p{{L}}\\p{{N}}_]')),
hits AS (SELECT doc_id, idx, text, term, CAST(spot AS INTEGER) AS "offset" FROM places
  WHERE substring(text, spot + 1, length(term)) = term
    AND NOT regexp_matches(CASE WHEN spot > 0 THEN substring(text, spot, 1) ELSE '' END, '[\\p{{L}}\\p{{N}}_]')
    AND NOT regexp_matches(substring(text, spot + length(term) + 1, 1), '[\\p{{L}}\\p{{N}}_]'))
SELECT doc_id, term, 'word/document.xml' AS part, 'body' AS story, idx, "offset",
  substring(text, greatest("offset" - 40, 0) + 1, "offset" - greatest("offset" - 40, 0)) AS "before",
  substring(text, "offset" + length(term) + 1, 40) AS "after"
FROM hits""",
    "find_positions": f"""WITH {LINES_SQL}, {_found_sql("lines", "with")}, {positions_sql("lines")},
stories AS ({_STORY}),
hits2 AS (SELECT f.doc_id, f.idx AS paragraph, f.text,
    CAST(p."start" + {units_sql("substring(f.body, 1, f.offset)")} AS INTEGER) AS "start"
  FROM found f JOIN placed p ON f.doc_id = p.doc_id AND f.idx = p.idx)
SELECT r.doc_id, paragraph, text, "start", CAST("start" + 4 AS INTEGER) AS "end",
  substring(story, greatest("start" - 60, 0) + 1, "start" - greatest("start" - 60, 0)) AS "before",
  substring(story, "start" + 5, 60) AS "after"
FROM hits2 r JOIN stories s ON r.doc_id = s.doc_id""",
    "find_wildcards": f"""WITH {LINES_SQL}, {positions_sql("lines")},
marked AS (SELECT doc_id, idx, "start" AS base,
    string_split(regexp_replace(text, '(t[hn].o)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS g
  FROM placed),
hits AS (SELECT doc_id, idx, base, g, unnest(generate_series(2, len(g), 2)) AS k FROM marked)
SELECT doc_id, idx AS paragraph, g[k] AS text,
  CAST(base + list_sum(list_transform(g[1:k - 1], lambda x: length(x))) AS INTEGER) AS "start",
  CAST(base + list_sum(list_transform(g[1:k], lambda x: length(x))) AS INTEGER) AS "end"
FROM hits""",
    "info": f"""WITH {LINES_SQL}
SELECT doc_id, count(*) AS paragraph_count, CAST(sum(length(text)) AS BIGINT) AS character_count
FROM lines GROUP BY doc_id""",
    "info_turns": f"""WITH {TURNS_SQL}
SELECT doc_id, count(*) AS paragraph_count, CAST(sum(length(text)) AS BIGINT) AS character_count
FROM turns GROUP BY doc_id""",
    "positions": f"""WITH {LINES_SQL}, {positions_sql("lines")}
SELECT doc_id, idx, "start", "end" FROM placed""",
    "positions_turns": f"""WITH {TURNS_SQL}, {positions_sql("turns")}
SELECT doc_id, idx, "start", "end", story_end FROM placed""",
    "text_slice": f"""WITH {LINES_SQL}, stories AS ({_STORY})
SELECT doc_id, CAST(0 AS INTEGER) AS piece,
  CASE WHEN length(story) >= 900 THEN substring(story, 51, 850) END AS text,
  CASE WHEN length(story) < 900 THEN 'range is outside the main story' END AS reason
FROM stories""",
    "position_lookup": f"""WITH {LINES_SQL}, {positions_sql("lines")},
points AS (SELECT doc_id, CAST(floor(n_chars / 2) AS INTEGER) AS position FROM documents)
SELECT p.doc_id, q.position, p.idx, p."start" FROM placed p JOIN points q
  ON p.doc_id = q.doc_id AND q.position >= p."start"
  AND (q.position < p."end" OR (q.position = p."end" AND p."end" = p.story_end))""",
    "md_escape": f"""WITH {LINES_SQL}
SELECT doc_id, idx, regexp_replace(text, '([\\\\*_`\\[\\]|])', '\\\\\\1', 'g') AS text FROM lines""",
    "emphasis": f"""WITH {TURNS_SQL},
cores AS (SELECT doc_id, idx, text, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS core,
  CASE WHEN idx % 6 = 0 THEN '***' WHEN idx % 2 = 0 THEN '**' WHEN idx % 3 = 0 THEN '*' ELSE '' END AS m
  FROM turns)
SELECT doc_id, idx, CASE WHEN core = '' OR m = '' THEN text
  ELSE regexp_extract(text, '^(\\s*)', 1) || m || core || m || regexp_extract(text, '(\\s*)$', 1) END AS text
FROM cores""",
    "invalid_texts": f"WITH {LINES_SQL} SELECT doc_id, idx FROM lines WHERE idx % 3 = 1",
}
