"""Paragraph tables as packages."""

from __future__ import annotations

import hashlib
import io
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scriptorium.functions import text as X
from scriptorium.schema import (
    CONTENT_TYPE,
    CONTENT_TYPES_NS,
    CONTENT_TYPES_PART,
    DOCUMENT_PART,
    OFFICE_REL_NS,
    PACKAGE_REL_NS,
    REL,
    WORD_NS,
)

# The order the file format wants properties in.
PARAGRAPH_ORDER = (
    "pStyle", "keepNext", "keepLines", "pageBreakBefore", "framePr", "widowControl", "numPr",
    "suppressLineNumbers", "pBdr", "shd", "tabs", "suppressAutoHyphens", "kinsoku", "wordWrap",
    "overflowPunct", "topLinePunct", "autoSpaceDE", "autoSpaceDN", "bidi", "adjustRightInd",
    "snapToGrid", "spacing", "ind", "contextualSpacing", "mirrorIndents", "suppressOverlap", "jc",
    "textDirection", "textAlignment", "textboxTightWrap", "outlineLvl", "divId", "cnfStyle", "rPr",
    "sectPr", "pPrChange",
)
RUN_ORDER = (
    "rStyle", "rFonts", "b", "bCs", "i", "iCs", "caps", "smallCaps", "strike", "dstrike", "outline",
    "shadow", "emboss", "imprint", "noProof", "snapToGrid", "vanish", "webHidden", "color", "spacing",
    "w", "kern", "position", "sz", "szCs", "highlight", "u", "effect", "bdr", "shd", "fitText",
    "vertAlign", "rtl", "cs", "em", "lang", "eastAsianLayout", "specVanish", "oMath", "rPrChange",
)
# The page setup of new documents, in twentieths of a point.
PAGE_SETUP = (
    '<w:sectPr><w:pgSz w:w="12240" w:h="15840"/><w:pgMar w:top="1440" w:right="1440" '
    'w:bottom="1440" w:left="1440" w:header="720" w:footer="720" w:gutter="0"/></w:sectPr>'
)
#: Characters of a file name before its extension, at most.
LONGEST_NAME = 180
_DECLARATION = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_HEAD = f'{_DECLARATION}<w:document xmlns:w="{WORD_NS}" xmlns:r="{OFFICE_REL_NS}"><w:body>'
_TAIL = f"{PAGE_SETUP}</w:body></w:document>"


class Part(NamedTuple):
    """A part added to every package, related from the main document."""

    name: str
    kind: str
    xml: str


class Written(NamedTuple):
    packages: DataFrame
    rejects: DataFrame


def text_xml(text: Column) -> Column:
    """Run content: line ends become breaks, tabs become tab elements."""
    opened, closed = '<w:t xml:space="preserve">', "</w:t>"
    plain = X.markup_escape(F.regexp_replace(text, "\r\n?", "\n"))
    for char, name in (("\n", "br"), ("\t", "tab")):
        plain = F.replace(plain, F.lit(char), F.lit(f"{closed}<w:{name}/>{opened}"))
    return F.concat(F.lit(opened), plain, F.lit(closed))


def valued(name: str, value: Column) -> Column:
    """``<w:name w:val="value"/>``, null when there is no value."""
    return F.concat(F.lit(f'<w:{name} w:val="'), X.markup_escape(value), F.lit('"/>'))


def switched(name: str, value: Column) -> Column:
    return valued(name, F.when(value, "1").when(~value, "0"))


def ordered(properties: dict[str, Column], order: Sequence[str], container: str) -> Column:
    """The given properties in file format order inside their container; "" when none."""
    names = sorted(properties, key=order.index)
    inner = F.concat(*[F.coalesce(properties[name], F.lit("")) for name in names])
    return F.when(inner == "", "").otherwise(
        F.concat(F.lit(f"<w:{container}>"), inner, F.lit(f"</w:{container}>"))
    )


def _paragraph_properties(columns: Sequence[str]) -> Column:
    known: dict[str, Column] = {}
    if "style" in columns:
        known["pStyle"] = valued("pStyle", F.col("style"))
    if "alignment" in columns:
        known["jc"] = valued("jc", F.col("alignment"))
    if "num_id" in columns:
        known["numPr"] = F.concat(
            F.lit("<w:numPr>"),
            valued("ilvl", F.coalesce(F.col("level"), F.lit(0)).cast("string")),
            valued("numId", F.col("num_id").cast("string")),
            F.lit("</w:numPr>"),
        )
    if "outline_level" in columns:
        known["outlineLvl"] = valued("outlineLvl", (F.col("outline_level") - 1).cast("string"))
    return ordered(known, PARAGRAPH_ORDER, "pPr") if known else F.lit("")


def _run_properties(columns: Sequence[str]) -> Column:
    font = X.markup_escape(F.col("font")) if "font" in columns else None
    makers = {
        "style": ("rStyle", lambda c: valued("rStyle", c)),
        "bold": ("b", lambda c: switched("b", c)),
        "italic": ("i", lambda c: switched("i", c)),
        "strike": ("strike", lambda c: switched("strike", c)),
        "color": ("color", lambda c: valued("color", c)),
        "size_pt": ("sz", lambda c: valued("sz", (c * 2).cast("int").cast("string"))),
        "highlight": ("highlight", lambda c: valued("highlight", c)),
        "underline": ("u", lambda c: valued("u", c)),
        "vertical_align": ("vertAlign", lambda c: valued("vertAlign", c)),
    }
    known = {name: make(F.col(c)) for c, (name, make) in makers.items() if c in columns}
    if font is not None:
        scripts = [F.concat(F.lit(f' w:{s}="'), font, F.lit('"')) for s in ("ascii", "hAnsi", "eastAsia", "cs")]
        known["rFonts"] = F.concat(F.lit("<w:rFonts"), *scripts, F.lit("/>"))
    return ordered(known, RUN_ORDER, "rPr") if known else F.lit("")


def paragraph_xml(paragraphs: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Each paragraph as XML: ``(doc_id, idx, xml)``.

    Optional paragraph columns: style, alignment, num_id with level, outline_level. With
    ``runs`` the content of a paragraph is its runs, else its text in one run.
    """
    properties = _paragraph_properties(paragraphs.columns)
    if runs is None:
        content = F.concat(F.lit("<w:r>"), text_xml(F.coalesce("text", F.lit(""))), F.lit("</w:r>"))
        source = paragraphs
    else:
        xml = F.concat(
            F.lit("<w:r>"), _run_properties(runs.columns), text_xml(F.coalesce("text", F.lit(""))), F.lit("</w:r>")
        )
        joined = runs.groupBy("doc_id", "idx").agg(
            X.concat_items(F.array_sort(F.collect_list(F.struct("run", xml.alias("f")))), "f").alias("_runs")
        )
        source = paragraphs.join(joined, ["doc_id", "idx"], "left")
        content = F.coalesce("_runs", F.lit(""))
    body = F.concat(F.lit("<w:p>"), properties, content, F.lit("</w:p>"))
    # A null text is an empty paragraph: dropping it would move all later ordinals.
    return source.select("doc_id", "idx", body.alias("xml"))


def _fixed_parts(extra: Sequence[Part]) -> list[tuple[str, bytes]]:
    overrides = [(DOCUMENT_PART, CONTENT_TYPE["document"])]
    overrides += [(part.name, CONTENT_TYPE[part.kind]) for part in extra]
    types = "".join(
        f'<Override PartName="/{name}" ContentType="{kind}"/>' for name, kind in overrides
    )
    related = "".join(
        f'<Relationship Id="rId{n}" Type="{REL[part.kind]}" Target="{part.name.removeprefix("word/")}"/>'
        for n, part in enumerate(extra, start=1)
    )
    entries = [
        (
            CONTENT_TYPES_PART,
            f'{_DECLARATION}<Types xmlns="{CONTENT_TYPES_NS}"><Default Extension="rels" '
            f'ContentType="{CONTENT_TYPE["relationships"]}"/><Default Extension="xml" '
            f'ContentType="application/xml"/>{types}</Types>',
        ),
        (
            "_rels/.rels",
            f'{_DECLARATION}<Relationships xmlns="{PACKAGE_REL_NS}"><Relationship Id="rId1" '
            f'Type="{REL["officeDocument"]}" Target="{DOCUMENT_PART}"/></Relationships>',
        ),
    ]
    if extra:
        entries.append(
            (
                "word/_rels/document.xml.rels",
                f'{_DECLARATION}<Relationships xmlns="{PACKAGE_REL_NS}">{related}</Relationships>',
            )
        )
    entries += [(part.name, part.xml) for part in extra]
    return [(name, xml.encode()) for name, xml in entries]


class _Archive:
    """Archives that begin with the same entries, which are compressed once.

    The bytes of an archive depend on its entries alone, so that a retry writes the same.
    """

    def __init__(self, entries: Sequence[tuple[str, bytes]]) -> None:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as archive:
            for name, data in entries:
                archive.writestr(_entry(name), data)
        self.begun = buffer.getvalue()

    def with_part(self, name: str, data: bytes) -> bytes:
        buffer = io.BytesIO(self.begun)
        with zipfile.ZipFile(buffer, "a") as archive:
            archive.writestr(_entry(name), data)
        return buffer.getvalue()


def _entry(name: str) -> zipfile.ZipInfo:
    entry = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
    entry.compress_type = zipfile.ZIP_DEFLATED
    return entry


def packages(
    paragraphs: DataFrame, runs: DataFrame | None = None, extra: Sequence[Part] = ()
) -> Written:
    """One package per document: ``(doc_id, content)``."""
    return packages_of(paragraph_xml(paragraphs, runs), extra)


def packages_of(xml: DataFrame, extra: Sequence[Part] = ()) -> Written:
    """Packages of blocks ``(doc_id, idx, xml)``, in order, in the ``w`` prefix.

    Documents with text that XML cannot hold are rejected before any document is put together.
    A package is one file, so the paragraphs of a document meet in one row.
    """
    invalid = ~X.valid_xml_text(F.col("xml"))
    item = F.struct("idx", F.col("xml").alias("f"))
    # One shuffle: the verdict is an aggregate beside the list, and whoever reads it alone makes no list.
    grouped = xml.groupBy("doc_id").agg(
        F.coalesce(F.bool_or(invalid), F.lit(False)).alias("_invalid"), F.collect_list(item).alias("_items")
    )
    rejects = grouped.where("_invalid").select("doc_id", F.lit("a character that XML cannot hold").alias("reason"))
    bodies = grouped.where("NOT _invalid OR doc_id IS NULL").select(
        "doc_id",
        F.concat(F.lit(_HEAD), X.concat_items(F.array_sort("_items"), "f"), F.lit(_TAIL)).alias("xml"),
    )
    fixed = _fixed_parts(extra)
    spark_schema = T.StructType(
        [T.StructField("doc_id", xml.schema["doc_id"].dataType), T.StructField("content", T.BinaryType())]
    )
    schema = to_arrow_schema(spark_schema)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _compressed(batches, fixed, schema)

    return Written(bodies.mapInArrow(compress, spark_schema), rejects)


#: Bytes of archives sent to the JVM together; one may exceed it.
_BATCH = 2 * 1024 * 1024


def _compressed(
    batches: Iterator[pa.RecordBatch], fixed: Sequence[tuple[str, bytes]], schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    """Archives of ``(doc_id, xml)``. Of the rows that come together only a few are held as archives."""
    archive = _Archive(fixed)

    def sent(ids: pa.Array, contents: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array(contents, schema.field(1).type)], schema=schema)

    for batch in batches:
        ids, begin, held, contents = batch.column(0), 0, 0, []
        for body in batch.column(1):
            contents.append(archive.with_part(DOCUMENT_PART, body.as_py().encode()))
            held += len(contents[-1])
            if held >= _BATCH:
                yield sent(ids.slice(begin, len(contents)), contents)
                begin, held, contents = begin + len(contents), 0, []
        if contents:
            yield sent(ids.slice(begin), contents)


#: Why all but one of files for one place are refused: by their id, or by the name given.
_TAKEN = ("another document has this id", "another document has this name")


def file_name(doc_id: object) -> str:
    """A file name for a document id: its whole text, escaped, so that no two ids share one.

    Letters, digits, ``_``, ``.``, ``-`` and ``~`` stand for themselves and other bytes for ``=``
    and two digits. A longer name is cut and ends in a hash of the id.
    """
    name = quote(str(doc_id), safe="").replace("%", "=")
    if len(name) > LONGEST_NAME:
        name = f"{name[: LONGEST_NAME - 33]}-{hashlib.md5(str(doc_id).encode()).hexdigest()}"
    return f"{name}.docx"


def write_packages(files: DataFrame, directory: str, overwrite: bool = False, name: str | None = None) -> DataFrame:
    """Write ``files(doc_id, content)`` below ``directory``; returns the manifest.

    A file is named after its ``doc_id``, or by the column ``name``: a path below ``directory``, which is
    then what no two files may share. ``directory`` is any URI Arrow can open. A file is written under a temporary name and
    moved into place; archives are deterministic, so a retried or duplicated task leaves
    the same file. Without ``overwrite`` a different file in the way is kept and reported.
    Documents with the same id are refused, all but one, rather than written over each other.
    The manifest ``(doc_id, path, written, reason)`` of each call is stored in a folder of its own
    below ``_manifest``; earlier ones stay.
    """
    doc_type = files.schema["doc_id"].dataType

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(directory)
        for batch in batches:
            rows = []
            for doc_id, content, below, number in zip(*(batch.column(i) for i in range(4))):
                below = below.as_py()
                path = f"{root}/{file_name(doc_id.as_py()) if below is None else below}"
                taken = number.as_py() > 1
                reason = _TAKEN[below is not None] if taken else _place(system, path, content.as_py(), overwrite)
                rows.append((path, reason is None, reason))
            if rows:
                columns = [pa.array(column, field.type) for column, field in zip(zip(*rows), list(arrow)[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=arrow)

    schema = T.StructType(
        [
            T.StructField("doc_id", doc_type),
            T.StructField("path", T.StringType()),
            T.StructField("written", T.BooleanType()),
            T.StructField("reason", T.StringType()),
        ]
    )
    arrow = to_arrow_schema(schema)
    system, root = pafs.FileSystem.from_uri(directory)
    system.create_dir(root, recursive=True)
    manifest = f"{directory}/_manifest/{uuid.uuid4().hex}"
    named = files.select("doc_id", "content", (F.lit(None).cast("string") if name is None else F.col(name)).alias("_name"))
    same = W.partitionBy("doc_id" if name is None else "_name").orderBy(F.xxhash64("content"))
    numbered = named.select("*", F.row_number().over(same).alias("_number"))
    numbered.mapInArrow(write, schema).write.parquet(manifest)
    return files.sparkSession.read.schema(schema).parquet(manifest)


def _place(system: pafs.FileSystem, path: str, content: bytes, overwrite: bool) -> str | None:
    """Put one file in place; tells why it was not."""
    there = system.get_file_info(path).type == pafs.FileType.File
    if there:
        with system.open_input_stream(path) as stream:
            same = stream.read() == content
        if same or not overwrite:
            return None if same else "a different file is there"
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(temporary) as stream:
        stream.write(content)
    if there:  # not every file system moves a file over another
        system.delete_file(path)
    system.move(temporary, path)
    return None


def write_docx(
    paragraphs: DataFrame, directory: str, overwrite: bool = False, runs: DataFrame | None = None
) -> DataFrame:
    """Write one package per document; rejected documents appear in the manifest too."""
    built = packages(paragraphs, runs)
    manifest = write_packages(built.packages, directory, overwrite)
    refused = built.rejects.select(
        "doc_id", F.lit(None).cast("string").alias("path"), F.lit(False).alias("written"), "reason"
    )
    return manifest.unionByName(refused)
