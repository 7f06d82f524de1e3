"""Queries over pages, orders and customers: structure, lists, links, runs, tables, chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import edits as E
from scriptorium.operators import formatting, inline, lists, markdown, structure, styles
from scriptorium.operators.positions import positions
from scriptorium.operators.style_chain import style_chain as chain
from scriptorium.plans.tables import pages, table
from scriptorium.plans.text_queries import units_sql
from scriptorium.sources import text as T


def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.page_paragraphs(pages(spark, sf_dir))


def page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.page_runs(pages(spark, sf_dir))


def outline_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styles.outline_by_name(T.page_paragraphs(pages(spark, sf_dir)))


def outline_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    paragraphs = T.page_paragraphs(pages(spark, sf_dir))
    return styles.outline_positions(styles.outline_by_name(paragraphs), positions(paragraphs))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = T.page_runs(pages(spark, sf_dir))
    return runs.where("link is not null").select("doc_id", "idx", "run", "text", "link")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List items of pages with made-up nesting: every fifth one is a bullet."""
    found = T.page_paragraphs(pages(spark, sf_dir)).where("tag = 'li'")
    place = F.col("idx")
    return found.select(
        "doc_id",
        "idx",
        F.lit("1").alias("num_id"),
        (place % 3).alias("level"),
        F.when(place % 5 == 4, "bullet").otherwise("decimal").alias("format"),
        (place % 3 + 1).alias("start"),
    )


def list_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = lists.list_numbers(_items(spark, sf_dir))
    return numbered.withColumn("marker", lists.list_marker())


def markdown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown: headings, bullets, bold and links."""
    runs = T.page_runs(pages(spark, sf_dir)).withColumn("raw", F.lit(False))
    texts = inline.render(runs, order="run")
    paragraphs = T.page_paragraphs(pages(spark, sf_dir)).select("doc_id", "idx", "style", "tag")
    level = styles.name_level(F.col("style"))
    marker = F.when(F.col("tag") == "li", F.lit("- "))
    body = markdown.paragraph_markdown(F.col("text"), level, marker)
    entries = (
        texts.join(paragraphs, ["doc_id", "idx"])
        .select("doc_id", F.col("idx").alias("at"), body.alias("text"), (F.col("tag") == "li").alias("is_list"))
        .where("text is not null")
    )
    return markdown.compose(entries)


def mixed_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = positions(T.page_paragraphs(pages(spark, sf_dir)))
    ranges = pages(spark, sf_dir).select(
        F.col("page_id").alias("doc_id"), F.lit(20).alias("lo"), F.lit(90).alias("hi")
    )
    runs = T.page_runs(pages(spark, sf_dir))
    return formatting.range_formatting(placed, runs, ranges, ["bold", "italic", "link"])


def _formats(source: DataFrame, place: dict) -> DataFrame:
    none = F.lit(None)
    return source.select(
        F.col("page_id").alias("doc_id"),
        *[F.lit(v).alias(k) for k, v in place.items()],
        F.lit(True).alias("bold"),
        none.cast("boolean").alias("italic"),
        F.lit(True).alias("underline"),
        F.lit(12.5).alias("size_pt"),
        none.cast("string").alias("font"),
        F.lit("center").alias("alignment"),
        F.lit("Quote").alias("style"),
    )


def _plain_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None)
    return T.page_runs(pages(spark, sf_dir)).withColumns(
        {
            "underline": none.cast("string"),
            "size_pt": none.cast("double"),
            "font": none.cast("string"),
        }
    )


def format_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = _formats(pages(spark, sf_dir), {"idx": 7})
    paragraphs = T.page_paragraphs(pages(spark, sf_dir))
    return E.format_paragraphs(paragraphs, _plain_runs(spark, sf_dir), edits)[1]


def format_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = _formats(pages(spark, sf_dir), {"start": 12, "end": 60})
    paragraphs = T.page_paragraphs(pages(spark, sf_dir))
    return E.format_range(paragraphs, _plain_runs(spark, sf_dir), edits)[1]


def restyled_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of ``format_range``: style and alignment where the range touches."""
    edits = _formats(pages(spark, sf_dir), {"start": 12, "end": 60})
    paragraphs = T.page_paragraphs(pages(spark, sf_dir))
    edited = E.format_range(paragraphs, _plain_runs(spark, sf_dir), edits)[0]
    return edited.paragraphs.select("doc_id", "idx", "style", "alignment")


def replace_in_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replaced texts, put together again per paragraph."""
    runs = E.replace_in_runs(T.page_runs(pages(spark, sf_dir)), "an", "<AN>")
    text = F.array_join(F.array_sort(F.collect_list(F.struct("run", "text")))["text"], "")
    return runs.groupBy("doc_id", "idx").agg(text.alias("text"))


def _order_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each order as a table: a header and one row per line number; the last cell spans two.

    Lines of an order that share their number are further paragraphs of the same cells.
    """
    line = table(spark, sf_dir, "lineitem")
    values = F.array(
        F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"), "l_returnflag"
    )
    heads = F.array(F.lit("line"), F.lit("quantity"), F.lit("ship|mode"))
    rows = line.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("row_id"), values.alias("v")
    )
    header = line.select(F.col("l_orderkey").alias("doc_id")).distinct().select(
        "doc_id", F.lit(0).alias("row_id"), heads.alias("v")
    )
    cells = rows.unionByName(header).select(
        "doc_id", F.lit(0).alias("block_id"), "row_id", F.posexplode("v").alias("cell_id", "text")
    )
    cells = cells.withColumns(
        {"idx": F.col("row_id") * 3 + F.col("cell_id"), "span": F.when(F.col("cell_id") == 2, 2).otherwise(1)}
    )
    shape = cells.select("doc_id", "block_id", "row_id", "cell_id", "span")
    # The rows themselves, as packages list them.
    own = shape.where("cell_id = 0").withColumns({"cell_id": F.lit(None).cast("int"), "span": F.lit(1)})
    return shape.unionByName(own), cells


def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.functions.text import md_escape

    shape, cells = _order_cells(spark, sf_dir)
    escaped = cells.withColumn("text", md_escape(F.col("text"), True))
    return markdown.table_markdown(structure.rows_of_cells(shape, escaped, "<br>")).drop("block_id")


def table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape, cells = _order_cells(spark, sf_dir)
    rows = structure.rows_of_cells(shape, cells, " ")
    return rows.select("doc_id", "row_id", F.array_join("cells.text", "\t").alias("text"))


def style_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation form chains: each is based on the one whose key is 25 less."""
    customer = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    made = customer.select(
        F.col("c_nationkey").alias("doc_id"),
        key.cast("string").alias("style_id"),
        (key - 25).cast("string").alias("based_on"),
    )
    return chain(made)


QUERIES = {
    "page_paragraphs": page_paragraphs,
    "page_runs": page_runs,
    "outline_pages": outline_pages,
    "outline_positions": outline_positions,
    "links": links,
    "list_numbers": list_numbers,
    "markdown_pages": markdown_pages,
    "mixed_formatting": mixed_formatting,
    "format_paragraphs": format_paragraphs,
    "format_range": format_range,
    "restyled_paragraphs": restyled_paragraphs,
    "replace_in_runs": replace_in_runs,
    "table_markdown": table_markdown,
    "table_text": table_text,
    "style_chain": style_chain,
}

_DECODE = "replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
BLOCKS_SQL = """blocks AS (
  SELECT doc_id, idx, regexp_extract(b, '^(h1|p|li)', 1) AS tag,
    string_split_regex(regexp_replace(b, '^[^>]*>', ''), '</(?:h1|p|li|ul|nav|article)>')[1] AS "inner"
  FROM (SELECT doc_id, CAST(i - 2 AS INTEGER) AS idx, bs[i] AS b
        FROM (SELECT doc_id, bs, unnest(generate_series(2, len(bs))) AS i
              FROM (SELECT page_id AS doc_id,
                      string_split(regexp_replace(html, '<(h1|p|li)([ >])', chr(1) || '\\1\\2', 'g'), chr(1)) AS bs
                    FROM pages))))"""
_UNTAGGED = "regexp_replace(regexp_replace({0}, '<br */?>', chr(10), 'g'), '<[^>]*>', '', 'g')"
PARAGRAPHS_SQL = f"""{BLOCKS_SQL},
paras AS (SELECT doc_id, idx, tag, {_DECODE.format(_UNTAGGED.format('"inner"'))} AS text,
  CASE tag WHEN 'h1' THEN 'Heading1' WHEN 'p' THEN 'Normal' ELSE 'ListBullet' END AS "style" FROM blocks)"""
_PIECE = "CASE WHEN i = 1 THEN ps[i] ELSE regexp_replace(ps[i], '^[^>]*>', '') END"
RUNS_SQL = f"""runs AS (
  SELECT * FROM (
    SELECT doc_id, idx, CAST(i - 1 AS INTEGER) AS run, {_DECODE.format(_UNTAGGED.format(_PIECE))} AS text,
      i > 1 AND starts_with(ps[i], 'b>') AS bold, FALSE AS italic,
      CASE WHEN i > 1 AND starts_with(ps[i], 'a ') THEN regexp_extract(ps[i], '^a href="([^"]*)"', 1) END AS link
    FROM (SELECT doc_id, idx, ps, unnest(generate_series(1, len(ps))) AS i
          FROM (SELECT doc_id, idx,
                  string_split(regexp_replace("inner", '<(/?(?:b|a)[ >])', chr(1) || '\\1', 'g'), chr(1)) AS ps
                FROM blocks))) WHERE text <> '')"""
_PLACED = f"""placed AS (
  SELECT doc_id, idx, text, "style",
    CAST(sum({units_sql("text")} + 1) OVER w - {units_sql("text")} - 1 AS INTEGER) AS "start",
    CAST(sum({units_sql("text")} + 1) OVER w AS INTEGER) AS "end",
    CAST(sum({units_sql("text")} + 1) OVER (PARTITION BY doc_id) AS INTEGER) AS story_end
  FROM paras WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
placed_runs AS (
  SELECT r.*, CAST(p."start" + off - {units_sql("r.text")} AS INTEGER) AS a, CAST(p."start" + off AS INTEGER) AS b
  FROM (SELECT *, sum({units_sql("text")}) OVER (PARTITION BY doc_id, idx ORDER BY run) AS off FROM runs) r
  JOIN placed p ON r.doc_id = p.doc_id AND r.idx = p.idx)"""
_ESCAPED = "regexp_replace({0}, '([\\\\*_`\\[\\]])', '\\\\\\1', 'g')"
_ITEMS = """items AS (SELECT doc_id, idx, '1' AS num_id, idx % 3 AS level,
  CASE WHEN idx % 5 = 4 THEN 'bullet' ELSE 'decimal' END AS format, idx % 3 + 1 AS "start"
  FROM paras WHERE tag = 'li')"""

SQL = {
    "page_paragraphs": f'WITH {PARAGRAPHS_SQL} SELECT doc_id, idx, text, "style", tag FROM paras',
    "page_runs": f"WITH {BLOCKS_SQL}, {RUNS_SQL} SELECT * FROM runs",
    "outline_pages": f"""WITH {PARAGRAPHS_SQL}
SELECT doc_id, idx, CAST(1 AS INTEGER) AS level, text, "style" FROM paras WHERE tag = 'h1'""",
    "outline_positions": f"""WITH {PARAGRAPHS_SQL}, {RUNS_SQL}, {_PLACED}
SELECT doc_id, idx, CAST(1 AS INTEGER) AS level, text, "style", "start", "end" FROM placed WHERE "style" = 'Heading1'""",
    "links": f"""WITH {BLOCKS_SQL}, {RUNS_SQL}
SELECT doc_id, idx, run, text, link FROM runs WHERE link IS NOT NULL""",
    # An item counts the items of its level since the last shallower counted item.
    "list_numbers": f"""WITH {PARAGRAPHS_SQL}, {_ITEMS},
resets AS (SELECT i.doc_id, i.idx, max(s.idx) AS r FROM items i JOIN items s
  ON s.doc_id = i.doc_id AND s.idx < i.idx AND s.level < i.level AND s.format <> 'bullet' GROUP BY i.doc_id, i.idx),
numbered AS (SELECT i.doc_id, i.idx, count(*) AS c FROM items i LEFT JOIN resets r ON r.doc_id = i.doc_id AND r.idx = i.idx
  JOIN items s ON s.doc_id = i.doc_id AND s.level = i.level AND s.format <> 'bullet'
    AND s.idx <= i.idx AND s.idx > coalesce(r.r, -1) GROUP BY i.doc_id, i.idx)
SELECT i.doc_id, i.idx, num_id, CAST(level AS INTEGER) AS level, format, CAST("start" AS INTEGER) AS "start",
  CASE WHEN format <> 'bullet' THEN CAST("start" + c - 1 AS INTEGER) END AS number,
  repeat('    ', level) || CASE WHEN format = 'bullet' THEN '- ' ELSE CAST("start" + c - 1 AS VARCHAR) || '. ' END AS marker
FROM items i LEFT JOIN numbered n ON n.doc_id = i.doc_id AND n.idx = i.idx""",
    "markdown_pages": f"""WITH {PARAGRAPHS_SQL}, {RUNS_SQL},
flagged AS (SELECT *, run = min(run) OVER (PARTITION BY doc_id, idx)
    OR link IS DISTINCT FROM lag(link) OVER w AS new_link, bold IS DISTINCT FROM lag(bold) OVER w AS new_bold
  FROM runs WINDOW w AS (PARTITION BY doc_id, idx ORDER BY run)),
grouped AS (SELECT *, sum(CAST(new_link AS INTEGER)) OVER w AS lg, sum(CAST(new_link OR new_bold AS INTEGER)) OVER w AS rg
  FROM flagged WINDOW w AS (PARTITION BY doc_id, idx ORDER BY run)),
joined AS (SELECT doc_id, idx, lg, rg, max(link) AS link, bool_or(bold) AS bold,
  {_ESCAPED.format("string_agg(text, '' ORDER BY run)")} AS text FROM grouped GROUP BY ALL),
shown AS (SELECT *, CASE WHEN NOT bold OR trim(text, ' ' || chr(10)) = '' THEN text ELSE
  regexp_extract(text, '^(\\s*)', 1) || '**' || trim(text, ' ' || chr(10)) || '**' || regexp_extract(text, '(\\s*)$', 1) END AS f FROM joined),
linked AS (SELECT doc_id, idx, lg, max(link) AS link, string_agg(f, '' ORDER BY rg) AS f FROM shown GROUP BY doc_id, idx, lg),
inlined AS (SELECT doc_id, idx, replace(string_agg(CASE WHEN link IS NULL OR trim(f, ' ' || chr(10)) = '' THEN f
  WHEN regexp_matches(link, '[ ()<>]') THEN '[' || f || '](<' || replace(replace(link, '<', '%3C'), '>', '%3E') || '>)'
  ELSE '[' || f || '](' || link || ')' END, '' ORDER BY lg), chr(10), '  ' || chr(10)) AS t FROM linked GROUP BY doc_id, idx),
entries AS (SELECT i.doc_id, i.idx, tag = 'li' AS li, CASE tag
    WHEN 'h1' THEN '# ' || replace(trim(t, ' ' || chr(10)), '  ' || chr(10), ' ')
    WHEN 'li' THEN '- ' || trim(t, ' ' || chr(10)) ELSE rtrim(t, ' ' || chr(10)) END AS text
  FROM inlined i JOIN paras p ON i.doc_id = p.doc_id AND i.idx = p.idx WHERE trim(t, ' ' || chr(10)) <> ''),
led AS (SELECT *, CASE WHEN lag(li) OVER w IS NULL THEN '' WHEN li AND lag(li) OVER w THEN chr(10)
  ELSE chr(10) || chr(10) END AS lead FROM entries WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
SELECT doc_id, string_agg(lead || text, '' ORDER BY idx) AS markdown FROM led GROUP BY doc_id""",
    "mixed_formatting": f"""WITH {PARAGRAPHS_SQL}, {RUNS_SQL}, {_PLACED}
SELECT doc_id, CAST(20 AS INTEGER) AS lo, CAST(90 AS INTEGER) AS hi,
  CASE WHEN count(DISTINCT bold) = 1 THEN bool_or(bold) END AS bold,
  CASE WHEN count(DISTINCT italic) = 1 THEN bool_or(italic) END AS italic,
  CASE WHEN count(DISTINCT link) = 1 AND count(link) = count(*) THEN max(link) END AS link
FROM placed_runs WHERE a < 90 AND b > 20 GROUP BY doc_id""",
    "format_paragraphs": f"""WITH {PARAGRAPHS_SQL}, {RUNS_SQL},
sizes AS (SELECT doc_id, max(idx) + 1 AS n FROM paras GROUP BY doc_id)
SELECT r.doc_id, idx, run, text, CASE WHEN idx = 7 THEN TRUE ELSE bold END AS bold, italic, link,
  CASE WHEN idx = 7 THEN 'single' END AS underline, CAST(CASE WHEN idx = 7 THEN 12.5 END AS DOUBLE) AS size_pt,
  CAST(NULL AS VARCHAR) AS font FROM runs r JOIN sizes USING (doc_id)""",
    "format_range": f"""WITH {PARAGRAPHS_SQL}, {RUNS_SQL}, {_PLACED},
ok AS (SELECT DISTINCT doc_id FROM placed WHERE story_end >= 60),
parts AS (
  SELECT r.*, 0 AS k, a AS x, CASE WHEN doc_id IN (SELECT doc_id FROM ok) THEN least(b, 12) ELSE b END AS y FROM placed_runs r
  UNION ALL SELECT r.*, 1, greatest(a, 12), least(b, 60) FROM placed_runs r WHERE doc_id IN (SELECT doc_id FROM ok)
  UNION ALL SELECT r.*, 2, greatest(a, 60), b FROM placed_runs r WHERE doc_id IN (SELECT doc_id FROM ok))
SELECT doc_id, idx, CAST(row_number() OVER (PARTITION BY doc_id, idx ORDER BY run, x) - 1 AS INTEGER) AS run,
  substring(text, x - a + 1, y - x) AS text, k = 1 OR bold AS bold, italic, link,
  CASE WHEN k = 1 THEN 'single' END AS underline, CAST(CASE WHEN k = 1 THEN 12.5 END AS DOUBLE) AS size_pt,
  CAST(NULL AS VARCHAR) AS font
FROM parts WHERE x < y""",
    "restyled_paragraphs": f"""WITH {PARAGRAPHS_SQL}, {RUNS_SQL}, {_PLACED}
SELECT doc_id, idx, CASE WHEN hit THEN 'Quote' ELSE "style" END AS "style", CASE WHEN hit THEN 'center' END AS alignment
FROM (SELECT *, story_end >= 60 AND "start" < 60 AND "end" > 12 AS hit FROM placed)""",
    "replace_in_runs": f"""WITH {BLOCKS_SQL}, {RUNS_SQL}
SELECT doc_id, idx, replace(string_agg(text, '' ORDER BY run), 'an', '<AN>') AS text FROM runs GROUP BY doc_id, idx""",
    "table_markdown": """SELECT doc_id, '| line | quantity | ship\\|mode |  |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) ||
  string_agg('| ' || n || ' | ' || q || ' | ' || f || ' |  |', chr(10) ORDER BY row_id) AS text
FROM (SELECT l_orderkey AS doc_id, l_linenumber AS row_id,
        string_agg(CAST(l_linenumber AS VARCHAR), '<br>') AS n,
        string_agg(CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR), '<br>' ORDER BY CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR)) AS q,
        string_agg(l_returnflag, '<br>' ORDER BY l_returnflag) AS f
      FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY doc_id""",
    "table_text": """SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INTEGER) AS row_id,
  string_agg(CAST(l_linenumber AS VARCHAR), ' ') || chr(9) ||
  string_agg(CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR), ' ' ORDER BY CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR)) || chr(9) ||
  string_agg(l_returnflag, ' ' ORDER BY l_returnflag) AS text
FROM lineitem GROUP BY l_orderkey, l_linenumber
UNION ALL SELECT DISTINCT l_orderkey, CAST(0 AS INTEGER), 'line' || chr(9) || 'quantity' || chr(9) || 'ship|mode' FROM lineitem""",
    "style_chain": """WITH RECURSIVE links AS (
  SELECT c_nationkey AS doc_id, c_custkey AS style_id, c_custkey - 25 AS based_on FROM customer),
walk AS (SELECT doc_id, style_id, style_id AS ancestor, 0 AS depth, based_on FROM links
  UNION ALL SELECT w.doc_id, w.style_id, l.style_id, w.depth + 1, l.based_on
  FROM walk w JOIN links l ON l.doc_id = w.doc_id AND l.style_id = w.based_on)
SELECT doc_id, CAST(style_id AS VARCHAR) AS style_id, CAST(ancestor AS VARCHAR) AS ancestor,
  CAST(depth AS INTEGER) AS depth FROM walk""",
}
