"""Queries of edits, versions and differences over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.lineage import removed, scope, stored, swept
from scriptorium.operators import composed as C
from scriptorium.operators import diff as D
from scriptorium.operators import edits as E
from scriptorium.operators import versions as V
from scriptorium.plans.tables import lines, table
from scriptorium.plans.text_queries import LINES_SQL


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def replace_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.replace(lines(spark, sf_dir), "the", "A & B", all=True).paragraphs


def replace_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.replace(lines(spark, sf_dir), "the", "A & B").paragraphs


def replace_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only in paragraph 2; documents without one stay as they are."""
    return E.replace(lines(spark, sf_dir), "e", "E", all=True, paragraph=2).paragraphs


def replace_paragraph_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.replace(lines(spark, sf_dir), "e", "E", all=True, paragraph=2).rejects


def _guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin with a T count as protected."""
    return (
        lines(spark, sf_dir)
        .where(F.col("text").startswith("T"))
        .select("doc_id", "idx", F.lit("protected").alias("reason"))
    )


def replace_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    guards = _guards(spark, sf_dir)
    return E.replace(lines(spark, sf_dir), "the", "A & B", all=True, guards=guards).paragraphs


def replace_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's own request: its first three letters in brackets."""
    edits = _documents(spark, sf_dir).select(
        "doc_id",
        F.substring("text", 1, 3).alias("find"),
        F.concat(F.lit("<"), F.substring("text", 1, 3), F.lit(">")).alias("replacement"),
        (F.col("doc_id") % 2 == 0).alias("all"),
        F.lit(None).cast("int").alias("paragraph"),
    )
    return E.replace_each(lines(spark, sf_dir), edits).paragraphs


def insert_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("doc_id") % 3
    edits = _documents(spark, sf_dir).select(
        "doc_id",
        F.when(third == 0, 0).when(third == 1, 4).alias("idx"),
        F.concat(F.lit("note on "), "lang").alias("text"),
        F.lit(None).cast("string").alias("style"),
    )
    return E.insert_paragraphs(lines(spark, sf_dir), edits).paragraphs


def delete_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = _documents(spark, sf_dir).select("doc_id", (F.col("doc_id") % 4).cast("int").alias("idx"))
    return E.delete_paragraphs(lines(spark, sf_dir), edits).paragraphs


def edits_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 0 and then 1 of what is left go from every document; the third edit fails where too
    few lines are left, and such a document stays as it was."""
    deletions = [{"action": F.lit("delete"), "idx": F.lit(n)} for n in range(3)]
    return C.compose(lines(spark, sf_dir), C.same_requests(_documents(spark, sf_dir), *deletions)).paragraphs


def _mixed(spark: SparkSession, sf_dir: str) -> C.Edited:
    """A title goes in, the second line goes, a word is replaced everywhere and once more in the
    first line, and the first line, the title and a note at the end get styles. Documents with one
    line have no second one, and lines that begin with a T must not be touched."""
    language = F.concat(F.lit("the title in "), "lang")
    steps = [
        {"action": F.lit("insert"), "idx": F.lit(0), "text": language, "style": F.lit("Title")},
        {"action": F.lit("delete"), "idx": F.lit(2)},
        {"action": F.lit("replace"), "find": F.lit("the"), "replacement": F.lit("A & B"), "all": F.lit(True)},
        {"action": F.lit("replace"), "idx": F.lit(1), "find": F.lit("e"), "replacement": F.lit("<e>")},
        {"action": F.lit("format"), "idx": F.lit(1), "style": F.lit("Lead")},
        {"action": F.lit("insert"), "text": F.lit("the end"), "style": F.lit("Note")},
    ]
    return C.compose(_styled_lines(spark, sf_dir), C.same_requests(_documents(spark, sf_dir), *steps), _guards(spark, sf_dir))


def _styled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).withColumn("style", F.when(F.col("idx") % 3 == 0, "Third"))


def composed_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).paragraphs


def composed_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).rejects


def deleted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = _documents(spark, sf_dir).select("doc_id", F.lit(1).alias("idx"))
    return E.delete_paragraphs(lines(spark, sf_dir), edits, _guards(spark, sf_dir)).audit


def insert_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = _documents(spark, sf_dir).select(
        "doc_id",
        F.floor(F.col("n_chars") / 3).cast("int").alias("position"),
        F.lit("one\rtwo\rthree ").alias("text"),
    )
    return E.insert_text(lines(spark, sf_dir), edits).paragraphs


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select(
        "doc_id",
        F.floor(F.col("n_chars") / 4).cast("int").alias("start"),
        (F.floor(F.col("n_chars") / 2) + 1).cast("int").alias("end"),
    )


def delete_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.delete_range(lines(spark, sf_dir), _ranges(spark, sf_dir)).paragraphs


def deleted_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.delete_range(lines(spark, sf_dir), _ranges(spark, sf_dir)).audit


def _old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a line of its own after the second one."""
    edits = _documents(spark, sf_dir).select(
        "doc_id", F.lit("~old only~").alias("text"), F.lit(None).cast("string").alias("style")
    )
    sizes = E.sizes(lines(spark, sf_dir))
    edits = edits.join(sizes, "doc_id").select(
        "doc_id", F.least(F.lit(2), "size").alias("idx"), "text", "style"
    )
    return E.insert_paragraphs(lines(spark, sf_dir), edits).paragraphs


def _new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its first line changed and two lines of its own."""
    base = lines(spark, sf_dir)
    sizes = E.sizes(base)
    marked = F.when(F.col("idx") == 0, F.concat("text", F.lit("~"))).otherwise(F.col("text"))
    text = F.lit("~new only~")
    style = F.lit(None).cast("string")
    inner = sizes.select(
        "doc_id", F.least(F.lit(5), "size").alias("idx"), text.alias("text"), style.alias("style")
    )
    tail = sizes.select(
        "doc_id", F.lit(None).cast("int").alias("idx"), F.lit("~end~").alias("text"), style.alias("style")
    )
    once = E.insert_paragraphs(base.withColumn("text", marked), inner).paragraphs
    return E.insert_paragraphs(once, tail).paragraphs


def diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Both versions are results of edits; keep them, as a version store would, until they are compared.
    with swept(spark), scope(spark) as folder:
        old, new = stored(_old(spark, sf_dir), "zstd"), stored(_new(spark, sf_dir), "zstd")
    found = D.diff(old, new)
    removed(spark, folder)
    return found


def _trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document without its fourth line."""
    edits = _documents(spark, sf_dir).where("doc_id % 3 = 0").select("doc_id", F.lit(3).alias("idx"))
    return E.delete_paragraphs(lines(spark, sf_dir), edits).paragraphs


def diff_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.diff_bounds(lines(spark, sf_dir), _trimmed(spark, sf_dir))


def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.diff_summary(lines(spark, sf_dir), _trimmed(spark, sf_dir))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 0 of all documents, and version 1 of those an edit really changed."""
    first = V.snapshot(lines(spark, sf_dir), 0)
    return first.unionByName(V.save(first, _trimmed(spark, sf_dir)))


def saved_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.latest(_history(spark, sf_dir))


def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.as_of(_history(spark, sf_dir))


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = _documents(spark, sf_dir).select("doc_id", F.lit(0).alias("base_version"))
    return V.conflicts(edits, _history(spark, sf_dir))


QUERIES = {
    "replace_all": replace_all,
    "replace_first": replace_first,
    "replace_paragraph": replace_paragraph,
    "replace_paragraph_refused": replace_paragraph_refused,
    "replace_guarded": replace_guarded,
    "replace_each": replace_each,
    "insert_paragraphs": insert_paragraphs,
    "delete_paragraphs": delete_paragraphs,
    "edits_in_order": edits_in_order,
    "composed_edits": composed_edits,
    "composed_refused": composed_refused,
    "deleted_texts": deleted_texts,
    "insert_text": insert_text,
    "delete_range": delete_range,
    "deleted_ranges": deleted_ranges,
    "diff": diff,
    "diff_bounds": diff_bounds,
    "diff_summary": diff_summary,
    "saved_versions": saved_versions,
    "as_of": as_of,
    "conflicts": conflicts,
}

_SIZES = "sizes AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n FROM lines GROUP BY doc_id)"
# A document is refused by its first request that fails: the title, put before a protected first line,
# then the deletion of the second line.
_REFUSED_MIXED = """refused AS (
  SELECT doc_id, CASE WHEN first LIKE 'T%' THEN 'protected' WHEN n < 2 THEN 'no paragraph has this index' ELSE 'protected' END AS reason
  FROM sizes JOIN (SELECT doc_id, max(CASE WHEN idx = 0 THEN text END) AS first, max(CASE WHEN idx = 1 THEN text END) AS second
    FROM lines GROUP BY doc_id) USING (doc_id)
  WHERE first LIKE 'T%' OR n < 2 OR second LIKE 'T%')"""
_STORIES = """stories AS (SELECT doc_id, string_agg(text || chr(13), '' ORDER BY idx) AS story
  FROM lines GROUP BY doc_id)"""
_RESPLIT = """SELECT doc_id, CAST(i - 1 AS INTEGER) AS idx, parts[i] AS text
FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i
      FROM (SELECT doc_id, string_split(left(story, length(story) - 1), chr(13)) AS parts FROM edited))"""
_TRIMMED = """trimmed AS (
  SELECT l.doc_id, CAST(idx - CASE WHEN l.doc_id % 3 = 0 AND n > 3 AND idx > 3 THEN 1 ELSE 0 END AS INTEGER) AS idx, text
  FROM lines l JOIN sizes s ON l.doc_id = s.doc_id
  WHERE NOT (l.doc_id % 3 = 0 AND n > 3 AND idx = 3))"""

SQL = {
    "replace_all": f"""WITH {LINES_SQL}
SELECT doc_id, idx, replace(text, 'the', 'A & B') AS text FROM lines""",
    "replace_first": f"""WITH {LINES_SQL},
firsts AS (SELECT doc_id, min(idx) AS f FROM lines WHERE contains(text, 'the') GROUP BY doc_id)
SELECT l.doc_id, idx, CASE WHEN idx = f
  THEN left(text, strpos(text, 'the') - 1) || 'A & B' || substring(text, strpos(text, 'the') + 3)
  ELSE text END AS text
FROM lines l LEFT JOIN firsts USING (doc_id)""",
    "replace_paragraph": f"""WITH {LINES_SQL}
SELECT doc_id, idx, CASE WHEN idx = 2 THEN replace(text, 'e', 'E') ELSE text END AS text FROM lines""",
    "replace_paragraph_refused": f"""WITH {LINES_SQL}, {_SIZES}
SELECT doc_id, 'no paragraph has this index' AS reason FROM sizes WHERE n <= 2""",
    "replace_guarded": f"""WITH {LINES_SQL},
bad AS (SELECT DISTINCT doc_id FROM lines WHERE text LIKE 'T%' AND contains(text, 'the'))
SELECT doc_id, idx, CASE WHEN doc_id IN (SELECT doc_id FROM bad) THEN text
  ELSE replace(text, 'the', 'A & B') END AS text FROM lines""",
    "replace_each": f"""WITH {LINES_SQL},
wanted AS (SELECT doc_id, left(text, 3) AS f, '<' || left(text, 3) || '>' AS r FROM documents),
hits AS (SELECT l.doc_id, min(idx) AS first FROM lines l JOIN wanted w USING (doc_id)
  WHERE contains(l.text, f) GROUP BY l.doc_id)
SELECT l.doc_id, idx, CASE
  WHEN l.doc_id % 2 = 0 THEN replace(text, f, r)
  WHEN idx = first THEN left(text, strpos(text, f) - 1) || r || substring(text, strpos(text, f) + length(f))
  ELSE text END AS text
FROM lines l JOIN wanted USING (doc_id) LEFT JOIN hits USING (doc_id)""",
    "insert_paragraphs": f"""WITH {LINES_SQL}, {_SIZES},
places AS (SELECT d.doc_id, n, 'note on ' || lang AS added,
    CASE d.doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 4 ELSE n END AS p
  FROM documents d JOIN sizes USING (doc_id))
SELECT l.doc_id, CAST(CASE WHEN p <= n AND idx >= p THEN idx + 1 ELSE idx END AS INTEGER) AS idx, text
FROM lines l JOIN places USING (doc_id)
UNION ALL SELECT doc_id, CAST(p AS INTEGER), added FROM places WHERE p <= n""",
    "delete_paragraphs": f"""WITH {LINES_SQL}, {_SIZES},
kept AS (SELECT l.doc_id, idx, text, n, l.doc_id % 4 AS p,
    l.doc_id % 4 < n AND n > 1 AS ok FROM lines l JOIN sizes USING (doc_id))
SELECT doc_id, CAST(CASE WHEN ok AND idx > p THEN idx - 1 ELSE idx END AS INTEGER) AS idx, text
FROM kept WHERE NOT (ok AND idx = p)""",
    # Of n lines the edits need more than 0, 1 and 2 of n, n - 1 and n - 2.
    "edits_in_order": f"""WITH {LINES_SQL}, {_SIZES}
SELECT doc_id, CAST(CASE WHEN n < 5 THEN idx WHEN idx = 1 THEN 0 WHEN idx = 3 THEN 1 ELSE idx - 3 END AS INTEGER) AS idx, text
FROM lines JOIN sizes USING (doc_id) WHERE n < 5 OR idx NOT IN (0, 2, 4)""",
    "composed_edits": f"""WITH {LINES_SQL}, {_SIZES}, {_REFUSED_MIXED},
edited AS (
  SELECT doc_id, 0 AS idx, 'A & B title in ' || lang AS text, 'Title' AS style FROM documents JOIN sizes USING (doc_id)
  UNION ALL SELECT doc_id, CASE WHEN idx = 0 THEN 1 ELSE idx END,
    CASE WHEN idx > 0 OR position('e' IN new) = 0 THEN new
      ELSE left(new, position('e' IN new) - 1) || '<e>' || substring(new, position('e' IN new) + 1) END,
    CASE WHEN idx = 0 THEN 'Lead' WHEN idx % 3 = 0 THEN 'Third' END
  FROM (SELECT doc_id, idx, replace(text, 'the', 'A & B') AS new FROM lines) WHERE idx <> 1
  UNION ALL SELECT doc_id, n, 'the end', 'Note' FROM sizes
)
SELECT doc_id, CAST(idx AS INTEGER) AS idx, text, style FROM edited WHERE doc_id NOT IN (SELECT doc_id FROM refused)
UNION ALL SELECT doc_id, idx, text, CASE WHEN idx % 3 = 0 THEN 'Third' END FROM lines WHERE doc_id IN (SELECT doc_id FROM refused)""",
    "composed_refused": f"""WITH {LINES_SQL}, {_SIZES}, {_REFUSED_MIXED} SELECT doc_id, reason FROM refused""",
    "deleted_texts": f"""WITH {LINES_SQL}
SELECT doc_id, idx, text AS deleted_text FROM lines WHERE idx = 1 AND text NOT LIKE 'T%'""",
    "insert_text": f"""WITH {LINES_SQL}, {_STORIES},
edited AS (SELECT doc_id, left(story, p) || 'one' || chr(13) || 'two' || chr(13) || 'three ' || substring(story, p + 1) AS story
  FROM (SELECT s.doc_id, story, CAST(floor(n_chars / 3) AS INTEGER) AS p FROM stories s JOIN documents d USING (doc_id)))
{_RESPLIT}""",
    "delete_range": f"""WITH {LINES_SQL}, {_STORIES},
edited AS (SELECT doc_id, left(story, a) || substring(story, least(b, length(story) - 1) + 1) AS story
  FROM (SELECT s.doc_id, story, CAST(floor(n_chars / 4) AS INTEGER) AS a, CAST(floor(n_chars / 2) + 1 AS INTEGER) AS b
        FROM stories s JOIN documents d USING (doc_id)))
{_RESPLIT}""",
    "deleted_ranges": f"""WITH {LINES_SQL}, {_STORIES}
SELECT doc_id, CAST(0 AS INTEGER) AS piece, substring(story, a + 1, b - a) AS deleted_text
FROM (SELECT s.doc_id, story, CAST(floor(n_chars / 4) AS INTEGER) AS a, CAST(floor(n_chars / 2) + 1 AS INTEGER) AS b
      FROM stories s JOIN documents d USING (doc_id))""",
    # The edits are known, and the added lines occur nowhere else, so the differences are.
    "diff": f"""WITH {LINES_SQL}, {_SIZES},
first AS (SELECT doc_id, n, text FROM lines JOIN sizes USING (doc_id) WHERE idx = 0)
SELECT doc_id, 'changed' AS "type", CAST(0 AS INTEGER) AS "index", CAST(0 AS INTEGER) AS old_index,
  text AS old_text, text || '~' AS text FROM first
UNION ALL SELECT doc_id, 'changed', n, n, '~old only~', '~new only~' FROM first WHERE n <= 2
UNION ALL SELECT doc_id, 'deleted', NULL, 2, '~old only~', NULL FROM first WHERE n > 2
UNION ALL SELECT doc_id, 'inserted', least(5, n), NULL, NULL, '~new only~' FROM first WHERE n > 2
UNION ALL SELECT doc_id, 'inserted', n + 1, NULL, NULL, '~end~' FROM first""",
    "diff_bounds": f"""WITH {LINES_SQL}, {_SIZES}, {_TRIMMED},
lists AS (SELECT o.doc_id, o.l AS a, t.l AS b FROM
  (SELECT doc_id, list(text ORDER BY idx) AS l FROM lines GROUP BY doc_id) o JOIN
  (SELECT doc_id, list(text ORDER BY idx) AS l FROM trimmed GROUP BY doc_id) t USING (doc_id)),
prefixes AS (SELECT *, coalesce(list_min(list_filter(generate_series(1, len(a)), lambda i: a[i] IS DISTINCT FROM b[i])), len(a) + 1) - 1 AS p
  FROM lists WHERE a <> b)
SELECT doc_id, CAST(len(a) AS INTEGER) AS n_old, CAST(len(b) AS INTEGER) AS n_new, CAST(p AS INTEGER) AS prefix,
  CAST(coalesce(list_min(list_filter(generate_series(1, len(b) - p), lambda i: a[len(a) + 1 - i] IS DISTINCT FROM b[len(b) + 1 - i])) - 1, len(b) - p) AS INTEGER) AS suffix
FROM prefixes""",
    "diff_summary": f"""WITH {LINES_SQL}, {_SIZES}
SELECT doc_id, NOT (doc_id % 3 = 0 AND n > 3) AS unchanged, n AS snapshot_paragraphs,
  CAST(n - CASE WHEN doc_id % 3 = 0 AND n > 3 THEN 1 ELSE 0 END AS INTEGER) AS current_paragraphs FROM sizes""",
    "saved_versions": f"""WITH {LINES_SQL}, {_SIZES}
SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 AND n > 3 THEN 1 ELSE 0 END AS INTEGER) AS "version",
  CAST(n - CASE WHEN doc_id % 3 = 0 AND n > 3 THEN 1 ELSE 0 END AS INTEGER) AS size FROM sizes""",
    "as_of": f"""WITH {LINES_SQL}, {_SIZES}, {_TRIMMED}
SELECT t.doc_id, idx, text, CAST(CASE WHEN t.doc_id % 3 = 0 AND n > 3 THEN 1 ELSE 0 END AS INTEGER) AS "version"
FROM trimmed t JOIN sizes s ON t.doc_id = s.doc_id""",
    "conflicts": f"""WITH {LINES_SQL}, {_SIZES}
SELECT doc_id, CAST(0 AS INTEGER) AS base_version, CAST(1 AS INTEGER) AS current_version,
  'another version came in between' AS reason FROM sizes WHERE doc_id % 3 = 0 AND n > 3""",
}
