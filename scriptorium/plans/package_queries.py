"""Queries over packages: documents and pages are written as packages and read back."""

from __future__ import annotations

import io
import warnings
import zipfile
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.lineage import new_folder, stored
from scriptorium.operators import formatting, inline, markdown, numbering, saving, search, structure, styles
from scriptorium.operators import paragraphs as P
from scriptorium.operators.composed import same_requests
from scriptorium.plans.page_queries import BLOCKS_SQL, RUNS_SQL
from scriptorium.plans.tables import lines, pages, table
from scriptorium.plans.text_queries import LINES_SQL
from scriptorium.schema import CONTENT_TYPE, DOCUMENT_PART, REL, WORD_NS
from scriptorium.sinks import docx, html
from scriptorium.sources import packages as S
from scriptorium.sources import relationships as R
from scriptorium.sources import xml_nodes as N
from scriptorium.sources.text import page_paragraphs, page_runs


def _part(root: str, inner: str) -> str:
    return f'<w:{root} xmlns:w="{WORD_NS}">{inner}</w:{root}>'


def _style(kind: str, style_id: str, name: str, inner: str = "", more: str = "") -> str:
    return f'<w:style w:type="{kind}" w:styleId="{style_id}"{more}><w:name w:val="{name}"/>{inner}</w:style>'


# The style sheet, list definitions and footnote every package of the queries carries: justified text
# throughout, a chain of three styles that sets, overrides and switches off, a level that only a style's id
# tells, and styles of other families.
STYLES = _part(
    "styles",
    '<w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="23"/></w:rPr></w:rPrDefault>'
    '<w:pPrDefault><w:pPr><w:jc w:val="both"/></w:pPr></w:pPrDefault></w:docDefaults>'
    + _style("character", "Loud", "Loud", '<w:rPr><w:b/><w:caps/></w:rPr>')
    + _style("paragraph", "Heading6", "Remark", '<w:basedOn w:val="Text"/><w:pPr><w:spacing w:before="60"/><w:ind w:left="360"/></w:pPr>')
    + _style("paragraph", "Entry", "Entry", '<w:basedOn w:val="Part"/><w:pPr><w:keepNext w:val="0"/><w:outlineLvl w:val="3"/></w:pPr>')
    + _style("paragraph", "Part", "Part of the report", '<w:basedOn w:val="Text"/><w:pPr><w:keepNext/><w:outlineLvl w:val="2"/></w:pPr>')
    + _style("table", "Ruled", "Ruled", '<w:tblPr><w:tblInd w:w="0" w:type="dxa"/></w:tblPr>')
    + _style("paragraph", "Text", "Text", '<w:pPr><w:spacing w:line="276" w:lineRule="auto"/></w:pPr>', ' w:default="1"'),
)
NUMBERING = _part(
    "numbering",
    '<w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl>'
    '<w:lvl w:ilvl="1"><w:start w:val="3"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%2)"/></w:lvl></w:abstractNum>'
    '<w:num w:numId="2"><w:abstractNumId w:val="0"/></w:num>',
)
FOOTNOTES = _part(
    "footnotes",
    '<w:footnote w:id="1"><w:p><w:r><w:t xml:space="preserve"> The note on the page. </w:t></w:r></w:p></w:footnote>',
)
EXTRA = (
    docx.Part("word/styles.xml", "styles", STYLES),
    docx.Part("word/numbering.xml", "numbering", NUMBERING),
    docx.Part("word/footnotes.xml", "footnotes", FOOTNOTES),
)


class Read(NamedTuple):
    parts: DataFrame
    nodes: DataFrame
    rels: DataFrame


def _styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines whose ordinal decides style, list membership and alignment."""
    eighth = F.col("idx") % 8
    none = F.lit(None)
    return lines(spark, sf_dir).withColumns(
        {
            "style": F.when(eighth == 0, "Part").when(eighth == 3, "Entry").when(eighth == 5, "Heading6"),
            "num_id": F.when(eighth.isin(1, 2), F.lit("2")).otherwise(none.cast("string")),
            "level": eighth - 1,
            "alignment": F.when(eighth == 4, "center"),
        }
    )


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docx.packages(_styled(spark, sf_dir), extra=EXTRA).packages


def _read(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> Read:
    """The packages of all documents, parsed once and kept."""
    parts = S.open_packages(_packages(spark, sf_dir)).parts
    nodes = stored(N.accepted(N.ingest_nodes(parts, names)))
    return Read(parts, nodes, R.relationships(nodes))


def _kept(read: Read) -> Read:
    """With the relationships kept too, for queries that follow them several times."""
    return read._replace(rels=stored(read.rels))


_BODY = ["word/document\\.xml"]


def docx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document as a package, open and parse it, and list its paragraphs."""
    parts = S.open_packages(_packages(spark, sf_dir)).parts
    return structure.listing(N.accepted(N.ingest_nodes(parts, _BODY)))


def docx_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each document, and its parts; the packages are written once and kept, as both read them."""
    files = stored(_packages(spark, sf_dir))
    body = S.open_packages(files, [DOCUMENT_PART]).parts
    names = S.open_packages(files, with_bytes=False).parts
    return P.info(structure.listing(N.accepted(N.ingest_nodes(body, _BODY))), names)


def docx_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _read(spark, sf_dir, ["\\[Content_Types\\]\\.xml"])
    return S.list_parts(read.parts, read.nodes).drop("size")


def docx_part_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = S.open_packages(_packages(spark, sf_dir)).parts
    return S.part_text(parts, "/word/numbering.xml")


def docx_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _read(spark, sf_dir, [".*\\.rels"])
    return read.rels.select("doc_id", "source", "rel_id", "kind", "target", "external", "target_part")


def docx_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _read(spark, sf_dir, [".*\\.rels", "word/footnotes\\.xml"])
    return structure.notes(read.nodes, read.rels, "footnote")


def _marked_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line in two runs; by first letter a line has a bookmark, a content control or a table cell around it."""
    styled = _styled(spark, sf_dir)
    half = F.floor(F.length("text") / 2).cast("int")
    halves = F.array(
        F.struct(F.lit(0).alias("run"), F.substring("text", F.lit(1), half).alias("text"), F.lit(True).alias("bold")),
        F.struct(F.lit(1).alias("run"), F.substring("text", half + 1, F.length("text")).alias("text"), F.lit(None).cast("boolean").alias("bold")),
    )
    runs = styled.select("doc_id", "idx", F.explode(halves).alias("_r")).select("doc_id", "idx", "_r.*")
    first = styled.select("doc_id", "idx", F.substring("text", 1, 1).alias("_c"))
    around = lambda before, after: F.concat(F.lit(before), "xml", F.lit(after))
    number = F.col("idx").cast("string")
    opened = F.concat(F.lit('<w:bookmarkStart w:id="'), number, F.lit('" w:name="here'), number, F.lit('"/><w:bookmarkEnd w:id="'), number, F.lit('"/></w:p>'))
    letter = F.col("_c")
    xml = (
        F.when(letter == "T", F.replace(F.col("xml"), F.lit("</w:p>"), opened))
        .when(letter == "A", around("<w:sdt><w:sdtContent>", "</w:sdtContent></w:sdt>"))
        .when(letter == "S", around("<w:tbl><w:tr><w:tc>", "</w:tc></w:tr></w:tbl>"))
        .otherwise(F.col("xml"))
    )
    blocks = docx.paragraph_xml(styled, runs).join(first, ["doc_id", "idx"]).select("doc_id", "idx", xml.alias("xml"))
    return docx.packages_of(blocks, EXTRA).packages


def _run(text: str) -> str:
    return f'<w:r><w:t xml:space="preserve">{text}</w:t></w:r>'


def _field(instruction: str, shown: str | None) -> str:
    """A field in its long form; with nothing shown it has no separator either."""
    mark = lambda kind: f'<w:r><w:fldChar w:fldCharType="{kind}"/></w:r>'
    code = f'<w:r><w:instrText xml:space="preserve">{instruction}</w:instrText></w:r>'
    return mark("begin") + code + ("" if shown is None else mark("separate") + shown) + mark("end")


def _linked(spark: SparkSession, sf_dir: str) -> Read:
    """Every line with what its ordinal adds: a link by a field, a field within such a link, a reference to the
    footnote, a field that shows nothing, an end of a field that never began; lines with an S lie in a table."""
    base = lines(spark, sf_dir)
    number, doc = F.col("idx").cast("string"), F.col("doc_id").cast("string")
    filled = lambda xml: F.replace(F.replace(F.lit(xml), F.lit("{doc}"), doc), F.lit("{idx}"), number)
    added = {
        1: _run(" ") + _field('HYPERLINK "https://x.test/{doc}?line={idx}"', _run("line {idx}")),
        2: _run(" ") + _field('HYPERLINK "https://x.test/{doc}" \\l "p{idx}"', _run("page ") + _field("PAGE", _run("{idx}2"))),
        3: '<w:r><w:footnoteReference w:id="1"/></w:r>',
        5: _field("SEQ hidden", None),
        6: '<w:r><w:fldChar w:fldCharType="end"/></w:r>',
    }
    tail = F.lit("")
    for place, xml in added.items():
        tail = F.when((F.col("idx") % 7 == place) & (F.trim("text") != ""), filled(xml)).otherwise(tail)
    blocks = docx.paragraph_xml(base).join(base, ["doc_id", "idx"])
    whole = F.concat(F.expr("left(xml, length(xml) - 6)"), tail, F.lit("</w:p>"))
    cell = F.concat(F.lit("<w:tbl><w:tr><w:tc>"), whole, F.lit("</w:tc></w:tr></w:tbl>"))
    xml = F.when(F.col("text").startswith("S"), cell).otherwise(whole)
    parts = S.open_packages(docx.packages_of(blocks.select("doc_id", "idx", xml.alias("xml")), EXTRA).packages).parts
    nodes = stored(N.accepted(N.ingest_nodes(parts)))
    return Read(parts, nodes, R.relationships(nodes))


def docx_linked_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _kept(_linked(spark, sf_dir))
    return markdown.markdown(read.nodes, read.rels).select("doc_id", "markdown")


def _saved(spark: SparkSession, sf_dir: str) -> saving.Saved:
    """Six requests for every package, each on what the one before left: a title before the first
    paragraph, the second line away, a word replaced everywhere and a letter in the first line, its
    style, and a note at the end."""
    steps = [
        {"action": F.lit("insert"), "idx": F.lit(0), "text": F.concat(F.lit("the title in "), "lang"), "style": F.lit("Part")},
        {"action": F.lit("delete"), "idx": F.lit(2)},
        {"action": F.lit("replace"), "find": F.lit("the"), "replacement": F.lit("A & B"), "all": F.lit(True)},
        {"action": F.lit("replace"), "idx": F.lit(1), "find": F.lit("e"), "replacement": F.lit("<e>")},
        {"action": F.lit("format"), "idx": F.lit(1), "style": F.lit("Heading6")},
        {"action": F.lit("insert"), "text": F.lit("the end"), "style": F.lit("Entry")},
    ]
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return saving.save(stored(_marked_packages(spark, sf_dir)), same_requests(docs, *steps))


def docx_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of saved packages, read back."""
    parts = S.open_packages(_saved(spark, sf_dir).packages).parts
    return structure.listing(N.accepted(N.ingest_nodes(parts, _BODY)))


def docx_saved_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parts of saved packages hold other bytes than before."""
    return _saved(spark, sf_dir).parts.select("doc_id", "part", (F.col("before") != F.col("after")).alias("changed"))


def docx_saved_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _saved(spark, sf_dir).rejects


def docx_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match of each document over its body and footnotes."""
    return search.find(_stories(spark, sf_dir), "the", context_chars=10, scope="all")


def _delivered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The packages of all documents as files below a folder, as a careless sender would leave them.

    Two documents share a file name, in two folders. By the number of the document the extension is in
    capitals, the file is cut short, an entry is there twice, the file is a document of another format, or
    no document at all.
    """
    kind = F.col("doc_id") % 8
    folder = F.when(F.col("doc_id") % 2 == 0, "north/").otherwise("south/old/")
    extension = F.when(kind == 2, ".DOCM").when(kind == 5, ".rtf").when(kind == 6, ".txt").otherwise(".docx")
    name = F.concat(folder, F.lit("report "), F.floor(F.col("doc_id") / 2).cast("string"), extension)
    half = F.substring("content", F.lit(1), F.floor(F.octet_length("content") / 2).cast("int"))
    files = _packages(spark, sf_dir).withColumn("content", F.when(kind == 3, half).otherwise(F.col("content")))

    def doubled(batches):
        for batch in batches:
            twice = batch["doc_id"] % 8 == 4
            batch.loc[twice, "content"] = [_twice(c) for c in batch.loc[twice, "content"]]
            yield batch

    files = files.mapInPandas(doubled, files.schema)
    directory = new_folder(spark)
    manifest = docx.write_packages(files.withColumn("name", name), directory, name="name")
    return manifest, directory


def _twice(content: bytes) -> bytes:
    """The archive with its first entry there a second time."""
    buffer = io.BytesIO(content)
    with zipfile.ZipFile(buffer, "a") as archive, warnings.catch_warnings():
        warnings.simplefilter("ignore")
        first = archive.infolist()[0]
        archive.writestr(first.filename, archive.read(first))
    return buffer.getvalue()


_FILE = r"(?:north|south/old)/[^/]*$"


def docx_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of all packages found below a folder, by their file's path below it."""
    _, directory = _delivered(spark, sf_dir)
    found = S.scan_packages(spark, directory, names=[DOCUMENT_PART])
    listed = structure.listing(N.accepted(N.ingest_nodes(found.parts, _BODY)))
    path = F.regexp_extract(F.url_decode(F.replace("doc_id", F.lit("+"), F.lit("%2B"))), _FILE, 0)
    return listed.select(path.alias("file"), "idx", "text")


def docx_scan_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, directory = _delivered(spark, sf_dir)
    found = S.scan_packages(spark, directory, names=[DOCUMENT_PART])
    path = F.regexp_extract(F.url_decode(F.replace("doc_id", F.lit("+"), F.lit("%2B"))), _FILE, 0)
    return found.rejects.select(path.alias("file"), "reason")


def _stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _read(spark, sf_dir, [".*\\.rels", "word/document\\.xml", "word/footnotes\\.xml"])
    return structure.stories(read.nodes, read.rels)


def docx_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _kept(_read(spark, sf_dir))
    body = structure.body_paragraphs(read.nodes)
    return styles.outline(styles.resolve(body, read.nodes, read.rels))


def docx_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved paragraph formatting, flattened."""
    read = _kept(_read(spark, sf_dir))
    resolved = styles.resolve(structure.body_paragraphs(read.nodes), read.nodes, read.rels)
    names = styles.styles_table(read.nodes, read.rels).select(
        "doc_id", "style_id", F.col("name").alias("style_name")
    )
    levels = numbering.num_levels(read.nodes, read.rels)
    found = formatting.paragraph_formatting(resolved, levels, structure.runs(read.nodes), names)
    return found.select(
        "doc_id",
        "idx",
        "style_id",
        "style_name",
        "alignment",
        "spacing.*",
        "indent.left_pt",
        "numbering.*",
        "keep_next",
        "outline_level",
        F.size("runs").alias("run_count"),
    )


def docx_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.plain_text(_read(spark, sf_dir, _BODY).nodes)


def docx_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _kept(_read(spark, sf_dir))
    return markdown.markdown(read.nodes, read.rels)


def docx_markdown_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _kept(_read(spark, sf_dir))
    return markdown.markdown(read.nodes, read.rels, start=2, limit=4)


def _page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as packages with formatted runs."""
    source = pages(spark, sf_dir)
    runs = page_runs(source).select("doc_id", "idx", "run", "text", "bold", "italic")
    built = docx.packages(page_paragraphs(source).drop("tag"), runs.withColumn("color", F.lit("112233")))
    return N.accepted(N.ingest_nodes(S.open_packages(built.packages).parts, _BODY))


def docx_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.runs(_page_nodes(spark, sf_dir))
    return found.select("doc_id", "idx", "run", "text", "bold", "italic", "color", "font")


def docx_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline content of the pages, merged where the format is the same."""
    nodes = stored(_page_nodes(spark, sf_dir))
    merged = inline.merged(inline.pieces(nodes, R.relationships(nodes)))
    return merged.groupBy("doc_id", "idx").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("run_group", "text")))["text"], "").alias("text"),
        F.count(F.lit(1)).alias("groups"),
    )


def html_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.html_preview(lines(spark, sf_dir))


QUERIES = {
    "docx_roundtrip": docx_roundtrip,
    "docx_info": docx_info,
    "docx_parts": docx_parts,
    "docx_part_text": docx_part_text,
    "docx_relationships": docx_relationships,
    "docx_notes": docx_notes,
    "docx_linked_markdown": docx_linked_markdown,
    "docx_scan": docx_scan,
    "docx_scan_refused": docx_scan_refused,
    "docx_saved": docx_saved,
    "docx_saved_parts": docx_saved_parts,
    "docx_saved_refused": docx_saved_refused,
    "docx_find": docx_find,
    "docx_find_all": docx_find,
    "docx_outline": docx_outline,
    "docx_formatting": docx_formatting,
    "docx_plain_text": docx_plain_text,
    "docx_markdown": docx_markdown,
    "docx_markdown_slice": docx_markdown_slice,
    "docx_runs": docx_runs,
    "docx_pieces": docx_pieces,
    "html_preview": html_preview,
}

_FILES = """files AS (SELECT doc_id, doc_id % 8 AS k,
  CASE WHEN doc_id % 2 = 0 THEN 'north/' ELSE 'south/old/' END || 'report ' || doc_id // 2 ||
  CASE doc_id % 8 WHEN 2 THEN '.DOCM' WHEN 5 THEN '.rtf' WHEN 6 THEN '.txt' ELSE '.docx' END AS file FROM documents)"""
# Requests are refused in their order; replacements, which concern all paragraphs, after the others.
_LOCKED, _ANCHORED = "inside a revision or a content control", "ranges begin or end here"
_REFUSED_SAVES = f"""firsts AS (
  SELECT doc_id, CAST(count(*) AS INTEGER) AS n, max(CASE WHEN idx = 0 THEN text END) AS first, max(CASE WHEN idx = 1 THEN text END) AS second,
    bool_or(idx <> 1 AND text LIKE 'A%' AND text LIKE '%the%') AS locked,
    bool_or(idx <> 1 AND text LIKE 'T%' AND (text LIKE '%the%' OR idx = 0 AND text LIKE '%e%')) AS anchored
  FROM lines GROUP BY doc_id),
refused AS (
  SELECT doc_id, reason FROM (SELECT doc_id, CASE WHEN first LIKE 'A%' THEN '{_LOCKED}' WHEN n < 2 THEN 'no paragraph has this index'
    WHEN second LIKE 'A%' THEN '{_LOCKED}' WHEN second LIKE 'T%' THEN '{_ANCHORED}' WHEN second LIKE 'S%' THEN 'the last paragraph of its tc'
    WHEN locked THEN '{_LOCKED}' WHEN anchored THEN '{_ANCHORED}' END AS reason FROM firsts) WHERE reason IS NOT NULL)"""
_STYLED = """styled AS (SELECT *, idx % 8 AS m,
  CASE idx % 8 WHEN 0 THEN 'Part' WHEN 3 THEN 'Entry' WHEN 5 THEN 'Heading6' END AS "style" FROM lines)"""
_LEVEL = "CAST(CASE m WHEN 0 THEN 3 WHEN 3 THEN 4 WHEN 5 THEN 6 END AS INTEGER)"
_NAMES = (
    "[Content_Types].xml", "_rels/.rels", "word/_rels/document.xml.rels", "word/styles.xml",
    "word/numbering.xml", "word/footnotes.xml", "word/document.xml",
)
_TYPES = (
    "application/xml", CONTENT_TYPE["relationships"], CONTENT_TYPE["relationships"],
    CONTENT_TYPE["styles"], CONTENT_TYPE["numbering"], CONTENT_TYPE["footnotes"], CONTENT_TYPE["document"],
)
_NAME_LIST = ", ".join(f"'{name}'" for name in _NAMES)
_BLANK = "' ' || chr(9) || chr(10) || chr(13)"
_MD = f"""entries AS (SELECT doc_id, idx, m IN (1, 2) AS li,
  CASE WHEN m IN (0, 3, 5) THEN repeat('#', {_LEVEL}) || ' ' || trim(e, {_BLANK})
    WHEN m = 1 THEN CAST(idx // 8 + 1 AS VARCHAR) || '. ' || trim(e, {_BLANK})
    WHEN m = 2 THEN '    3. ' || trim(e, {_BLANK}) ELSE rtrim(e, {_BLANK}) END AS text
  FROM (SELECT *, regexp_replace(text, '([\\\\*_`\\[\\]])', '\\\\\\1', 'g') AS e FROM styled)
  WHERE trim(text, {_BLANK}) <> '' AND {{0}}),
led AS (SELECT *, CASE WHEN lag(li) OVER w IS NULL THEN '' WHEN li AND lag(li) OVER w THEN chr(10)
  ELSE chr(10) || chr(10) END AS lead FROM entries WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
texts AS (SELECT doc_id, string_agg(lead || text, '' ORDER BY idx) AS md FROM led GROUP BY doc_id),
sizes AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n FROM lines GROUP BY doc_id)"""

SQL = {
    "docx_roundtrip": f"""WITH {LINES_SQL}, {_STYLED}
SELECT doc_id, idx, text, "style", FALSE AS in_table FROM styled""",
    "docx_linked_markdown": f"""WITH {LINES_SQL}, shown AS (
  SELECT doc_id, idx, text LIKE 'S%' AS cell, regexp_replace(text, '([\\\\*_`\\[\\]])', '\\\\\\1', 'g') ||
    CASE idx % 7 WHEN 1 THEN ' [line ' || idx || '](https://x.test/' || doc_id || '?line=' || idx || ')'
      WHEN 2 THEN ' [page ' || idx || '2](https://x.test/' || doc_id || '#p' || idx || ')' WHEN 3 THEN '[^1]' ELSE '' END AS e
  FROM lines WHERE trim(text, {_BLANK}) <> ''),
entries AS (SELECT doc_id, idx,
  CASE WHEN cell THEN '| ' || trim(replace(e, '|', '\\|'), {_BLANK}) || ' |' || chr(10) || '| --- |' ELSE rtrim(e, {_BLANK}) END AS f FROM shown),
texts AS (SELECT doc_id, string_agg(f, chr(10) || chr(10) ORDER BY idx) AS body FROM entries GROUP BY doc_id),
noted AS (SELECT DISTINCT doc_id FROM shown WHERE idx % 7 = 3)
SELECT doc_id, coalesce(body, '') || CASE WHEN n.doc_id IS NULL THEN '' ELSE chr(10) || chr(10) || '[^1]: The note on the page.' END AS markdown
FROM documents LEFT JOIN texts USING (doc_id) LEFT JOIN noted n USING (doc_id)""",
    "docx_scan": f"""WITH {LINES_SQL}, {_FILES}
SELECT file, idx, text FROM lines JOIN files USING (doc_id) WHERE k NOT IN (3, 4, 5, 6)""",
    "docx_scan_refused": f"""WITH {_FILES} SELECT file, CASE k WHEN 3 THEN 'not a readable archive'
  WHEN 4 THEN 'two entries of one name' ELSE 'a document, but not a package' END AS reason FROM files WHERE k IN (3, 4, 5)""",
    "docx_saved": f"""WITH {LINES_SQL}, {_STYLED}, {_REFUSED_SAVES},
edited AS (
  SELECT doc_id, 0 AS idx, 'A & B title in ' || lang AS text, 'Part' AS "style", first LIKE 'S%' AS in_table
  FROM documents JOIN firsts USING (doc_id)
  UNION ALL SELECT doc_id, CASE WHEN idx = 0 THEN 1 ELSE idx END,
    CASE WHEN idx > 0 OR position('e' IN new) = 0 THEN new
      ELSE left(new, position('e' IN new) - 1) || '<e>' || substring(new, position('e' IN new) + 1) END,
    CASE WHEN idx = 0 THEN 'Heading6' ELSE "style" END, text LIKE 'S%'
  FROM (SELECT *, replace(text, 'the', 'A & B') AS new FROM styled) WHERE idx <> 1
  UNION ALL SELECT doc_id, n, 'the end', 'Entry', FALSE FROM firsts
)
SELECT doc_id, CAST(idx AS INTEGER) AS idx, text, "style", in_table FROM edited WHERE doc_id NOT IN (SELECT doc_id FROM refused)
UNION ALL SELECT doc_id, idx, text, "style", text LIKE 'S%' FROM styled WHERE doc_id IN (SELECT doc_id FROM refused)""",
    "docx_saved_parts": f"""WITH {LINES_SQL}, {_REFUSED_SAVES}
SELECT doc_id, part, part = 'word/document.xml' AND doc_id NOT IN (SELECT doc_id FROM refused) AS changed
FROM (SELECT doc_id, unnest([{_NAME_LIST}]) AS part FROM documents)""",
    "docx_saved_refused": f"""WITH {LINES_SQL}, {_REFUSED_SAVES} SELECT doc_id, reason FROM refused""",
    "docx_info": f"""WITH {LINES_SQL}
SELECT doc_id, count(*) AS paragraph_count, CAST(sum(length(text)) AS BIGINT) AS character_count,
  [{_NAME_LIST}] AS parts FROM lines GROUP BY doc_id""",
    "docx_parts": f"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS ord, ([{_NAME_LIST}])[i] AS part,
  ([{", ".join(f"'{kind}'" for kind in _TYPES)}])[i] AS content_type
FROM (SELECT doc_id, unnest(generate_series(1, 7)) AS i FROM documents)""",
    "docx_part_text": f"""SELECT doc_id, CAST({len(NUMBERING.encode())} AS INTEGER) AS size, '{NUMBERING}' AS text,
  CAST(NULL AS VARCHAR) AS reason FROM documents""",
    "docx_relationships": f"""SELECT doc_id, '' AS source, 'rId1' AS rel_id, '{REL["officeDocument"]}' AS kind,
  'word/document.xml' AS target, FALSE AS "external", 'word/document.xml' AS target_part FROM documents
UNION ALL SELECT doc_id, 'word/document.xml', 'rId' || i, '{REL["styles"].rsplit("/", 1)[0]}/' || k[i], k[i] || '.xml', FALSE,
  'word/' || k[i] || '.xml'
FROM (SELECT doc_id, ['styles', 'numbering', 'footnotes'] AS k, unnest(generate_series(1, 3)) AS i FROM documents)""",
    "docx_notes": "SELECT doc_id, '1' AS note_id, 'The note on the page.' AS text FROM documents",
    "docx_find": f"""WITH {LINES_SQL},
gaps AS (SELECT doc_id, idx, text, string_split(text, 'the') AS g FROM lines),
hits AS (SELECT doc_id, 'word/document.xml' AS part, 'body' AS story, idx, text, CAST(NULL AS VARCHAR) AS note_id,
    CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + (k - 1) * 3 AS INTEGER) AS "offset"
  FROM (SELECT *, unnest(generate_series(1, len(g) - 1)) AS k FROM gaps WHERE len(g) > 1)
  UNION ALL SELECT doc_id, 'word/footnotes.xml', 'footnote', CAST(0 AS INTEGER), ' The note on the page. ', '1', 13 FROM documents)
SELECT doc_id, part, story, idx, "offset", CAST(3 AS INTEGER) AS "length", 'the' AS text,
  substring(text, greatest("offset" - 10, 0) + 1, "offset" - greatest("offset" - 10, 0)) AS "before",
  substring(text, "offset" + 4, 10) AS "after", note_id FROM hits""",
    "docx_outline": f"""WITH {LINES_SQL}, {_STYLED}
SELECT doc_id, idx, {_LEVEL} AS level, text, "style" FROM styled WHERE m IN (0, 3, 5)""",
    "docx_formatting": f"""WITH {LINES_SQL}, {_STYLED}
SELECT doc_id, idx, coalesce("style", 'Text') AS style_id,
  CASE m WHEN 0 THEN 'Part of the report' WHEN 3 THEN 'Entry' WHEN 5 THEN 'Remark' ELSE 'Text' END AS style_name,
  CASE WHEN m = 4 THEN 'center' ELSE 'both' END AS alignment,
  CAST(CASE WHEN m = 5 THEN 3 END AS DOUBLE) AS before_pt, CAST(NULL AS DOUBLE) AS after_pt,
  CAST(1.15 AS DOUBLE) AS line, 'multiple' AS line_rule, CAST(CASE WHEN m = 5 THEN 18 END AS DOUBLE) AS left_pt,
  CASE WHEN m IN (1, 2) THEN '2' END AS num_id, CAST(CASE WHEN m IN (1, 2) THEN m - 1 END AS INTEGER) AS ilvl,
  CASE WHEN m IN (1, 2) THEN 'decimal' END AS format, CASE m WHEN 1 THEN '%1.' WHEN 2 THEN '%2)' END AS level_text,
  m = 0 AS keep_next, {_LEVEL} AS outline_level, CAST(CASE WHEN text = '' THEN 0 ELSE 1 END AS INTEGER) AS run_count
FROM styled""",
    "docx_plain_text": f"""WITH {LINES_SQL}
SELECT doc_id, string_agg(text, chr(10) ORDER BY idx) AS text,
  CAST(length(string_agg(text, chr(10) ORDER BY idx)) AS INTEGER) AS characters, count(*) AS total_paragraphs
FROM lines GROUP BY doc_id""",
    "docx_markdown": f"""WITH {LINES_SQL}, {_STYLED}, {_MD.format("TRUE")}
SELECT s.doc_id, coalesce(md, '') AS markdown, CAST(0 AS INTEGER) AS "start", n AS "end",
  CAST(NULL AS INTEGER) AS next_start, n AS total_paragraphs
FROM sizes s LEFT JOIN texts t ON t.doc_id = s.doc_id""",
    "docx_markdown_slice": f"""WITH {LINES_SQL}, {_STYLED}, {_MD.format("idx BETWEEN 2 AND 5")}
SELECT s.doc_id, coalesce(md, '') AS markdown, CAST(2 AS INTEGER) AS "start",
  CAST(greatest(2, least(6, n)) AS INTEGER) AS "end", CAST(CASE WHEN n > 6 THEN 6 END AS INTEGER) AS next_start,
  n AS total_paragraphs FROM sizes s LEFT JOIN texts t ON t.doc_id = s.doc_id""",
    "docx_runs": f"""WITH {BLOCKS_SQL}, {RUNS_SQL}
SELECT doc_id, idx, CAST(row_number() OVER (PARTITION BY doc_id, idx ORDER BY run) - 1 AS INTEGER) AS run,
  text, bold, italic, '112233' AS color, CAST(NULL AS VARCHAR) AS font FROM runs""",
    "docx_pieces": f"""WITH {BLOCKS_SQL}, {RUNS_SQL},
flagged AS (SELECT *, run = min(run) OVER (PARTITION BY doc_id, idx) OR bold IS DISTINCT FROM lag(bold) OVER w AS fresh
  FROM runs WINDOW w AS (PARTITION BY doc_id, idx ORDER BY run))
SELECT doc_id, idx, string_agg(text, '' ORDER BY run) AS text, CAST(sum(CAST(fresh AS INTEGER)) AS BIGINT) AS "groups"
FROM flagged GROUP BY doc_id, idx""",
    "html_preview": f"""WITH {LINES_SQL}
SELECT doc_id, CAST(0 AS INTEGER) AS piece, '{html.HEAD}' || string_agg('<p>' ||
  replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&apos;'), '"', '&quot;')
  || '</p>', chr(10) ORDER BY idx) || '{html.TAIL}' AS html FROM lines GROUP BY doc_id""",
}
# The name the search had while docx_find was cut.
SQL["docx_find_all"] = SQL["docx_find"]
