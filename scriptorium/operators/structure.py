"""Paragraphs, stories, runs, notes, blocks and edit guards of parsed packages.

All groups are keyed by (document, part, ...). A part has no limit here, but one task has parsed it
whole, so a group or window over one part is no larger than what a task has held before.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scriptorium.functions import nodes as N
from scriptorium.functions import text as X
from scriptorium.lineage import unsent
from scriptorium.schema import DOCUMENT_PART, STORY_KINDS
from scriptorium.sources.relationships import related_part

# Elements a plain-text edit could corrupt, and wrappers it must not enter.
UNEDITABLE = (
    "fldChar", "fldSimple", "instrText", "del", "ins", "sdt", "drawing", "object", "p",
    "tab", "br", "cr", "sym", "altChunk",
)
LOCKED_IN = ("sdt", "ins", "del")
ANCHOR = "bookmark|comment|^moveFrom|^moveTo"
NOTE_ELEMENTS = ("footnote", "endnote", "comment")


def part_paragraphs(nodes: DataFrame) -> DataFrame:
    """Every paragraph of every part: texts, direct style, table membership, block place.

    One shuffle: paragraph elements and everything that adds text or the style meet in one
    aggregate per paragraph. ``text`` counts run-level tabs only, ``all_tabs`` every tab.
    """
    shown = nodes.where(
        F.col("para").isNotNull() & N.is_word("p", "t", "tab", "br", "cr", "pStyle")
    )
    strict, loose = N.run_text(), N.run_text(all_tabs=True)
    styled = N.is_word("pStyle") & F.col("first") & N.under_first("p", "pPr")
    cells = shown.select(
        "doc_id",
        "part",
        F.col("para").alias("idx"),
        F.when(
            loose.isNotNull(),
            F.struct("node_id", strict.alias("strict"), loose.alias("loose")),
        ).alias("_piece"),
        F.when(styled, F.struct("val")).alias("_style"),
        F.when(
            N.is_word("p"),
            F.struct(
                "node_id",
                N.inside("tc").alias("in_table"),
                N.nearest(*NOTE_ELEMENTS)["id"].alias("note_node"),
                N.block_place().alias("place"),
            ),
        ).alias("_p"),
    )
    return (
        cells.groupBy("doc_id", "part", "idx")
        .agg(
            F.array_sort(F.collect_list("_piece")).alias("_pieces"),
            F.max("_style").alias("_style"),
            F.max("_p").alias("_p"),
        )
        .select(
            "doc_id",
            "part",
            "idx",
            F.array_join("_pieces.strict", "").alias("text"),
            F.array_join("_pieces.loose", "").alias("all_tabs"),
            F.col("_style.val").alias("style"),
            "_p.in_table",
            "_p.node_id",
            "_p.note_node",
            F.col("_p.place.kind").alias("block_kind"),
            F.col("_p.place.block_id").alias("block_id"),
            F.col("_p.place.row_id").alias("row_id"),
            F.col("_p.place.cell_id").alias("cell_id"),
        )
    )


def body_paragraphs(nodes: DataFrame) -> DataFrame:
    """The main document's paragraphs."""
    return part_paragraphs(nodes.where(F.col("part") == DOCUMENT_PART))


def listing(nodes: DataFrame) -> DataFrame:
    """Paragraph listing as edits and previews see it: text with every tab."""
    return body_paragraphs(nodes).select(
        "doc_id", "idx", F.col("all_tabs").alias("text"), "style", "in_table"
    )


def stories(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """Searchable paragraphs of the body, headers, footers, notes and comments.

    ``story_ord`` orders the body first, then the parts as they are related.
    """
    kinds = F.create_map(*[F.lit(v) for pair in STORY_KINDS.items() for v in pair])
    parts = rels.where(
        (F.col("source") == DOCUMENT_PART) & ~F.col("external") & F.col("kind").isin(*STORY_KINDS)
    ).select(
        "doc_id",
        F.col("target_part").alias("part"),
        kinds[F.col("kind")].alias("story"),
        (F.col("ord") + 1).alias("story_ord"),
    )
    body = nodes.where((F.col("part") == DOCUMENT_PART) & (F.col("node_id") == 0)).select(
        "doc_id", "part", F.lit("body").alias("story"), F.lit(0).alias("story_ord")
    )
    found = part_paragraphs(nodes).join(body.unionByName(parts), ["doc_id", "part"])
    ids = nodes.where(N.is_word(*NOTE_ELEMENTS)).select(
        "doc_id",
        "part",
        F.col("node_id").alias("note_node"),
        N.word_attr("id").alias("_id"),
        F.col("name").alias("_note"),
    )
    return found.join(ids, ["doc_id", "part", "note_node"], "left").select(
        "doc_id",
        "story_ord",
        "story",
        "part",
        "idx",
        "text",
        "style",
        "in_table",
        F.when(F.col("_note") == F.col("story"), F.col("_id")).alias("note_id"),
    )


def runs(nodes: DataFrame, part: str | None = DOCUMENT_PART) -> DataFrame:
    """Runs with text and their direct character formatting."""
    source = nodes if part is None else nodes.where(F.col("part") == part)
    prop = N.under_first("r", "rPr") & F.col("first")
    content = N.under("r") & N.is_word("t", "tab", "br", "cr")
    mine = source.where(F.col("para").isNotNull() & (content | (prop & F.col("is_word"))))
    run_id = F.when(N.under("r"), N.ancestor(1)["id"]).otherwise(N.ancestor(2)["id"])

    def given(name: str) -> F.Column:
        return prop & N.is_word(name)

    def value(name: str) -> F.Column:
        return F.max(F.when(given(name), F.col("val")))

    def toggle(name: str) -> F.Column:
        return F.max(F.when(given(name), N.is_on(F.col("val"))))

    font = F.coalesce(*[N.word_attr(a) for a in ("ascii", "hAnsi", "eastAsia", "cs")])
    strike, double = toggle("strike"), toggle("dstrike")
    grouped = (
        mine.withColumn("_run", run_id)
        .groupBy("doc_id", "part", F.col("para").alias("idx"), "_run")
        .agg(
            F.array_sort(
                F.collect_list(F.when(content, F.struct("node_id", N.run_text().alias("f"))))
            ).alias("_pieces"),
            value("rStyle").alias("style"),
            toggle("b").alias("bold"),
            toggle("i").alias("italic"),
            value("u").alias("underline"),
            F.coalesce(strike | double, F.when(strike.isNotNull() | double.isNotNull(), F.coalesce(strike, double))).alias("strike"),
            F.max(F.when(given("rFonts"), font)).alias("font"),
            (N.number(value("sz")) / 2).alias("size_pt"),
            value("color").alias("color"),
            value("highlight").alias("highlight"),
            value("vertAlign").alias("vertical_align"),
        )
        .withColumn("text", F.array_join("_pieces.f", ""))
        .where("text != ''")
    )
    nth = F.row_number().over(W.partitionBy("doc_id", "part", "idx").orderBy("_run"))
    return grouped.select(
        "doc_id", "part", "idx", (nth - 1).alias("run"), "text", "style", "bold", "italic",
        "underline", "strike", "font", "size_pt", "color", "highlight", "vertical_align",
    )


def notes(nodes: DataFrame, rels: DataFrame, kind: str) -> DataFrame:
    """Footnotes or endnotes: ``(doc_id, note_id, text)``; blank paragraphs left out."""
    part = related_part(rels, f"{kind}s")
    mine = nodes.join(part, ["doc_id", "part"], "left_semi")
    texts = (
        part_paragraphs(mine)
        .where(F.col("note_node").isNotNull() & ~X.is_blank(F.col("text")))
        .groupBy("doc_id", "note_node")
        .agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("_t"))
    )
    heads = mine.where(N.is_word(kind) & N.word_attr("id").isNotNull()).select(
        "doc_id", F.col("node_id").alias("note_node"), N.word_attr("id").alias("note_id")
    )
    joined = heads.join(texts, ["doc_id", "note_node"], "left")
    text = F.coalesce(X.trim_space(F.array_join("_t.text", " ")), F.lit(""))
    # Of notes with the same id the last one counts.
    return joined.groupBy("doc_id", "note_id").agg(F.max_by(text, "note_node").alias("text"))


def table_shape(nodes: DataFrame) -> DataFrame:
    """Rows and cells of top-level tables, with or without paragraphs in them.

    ``cell_id`` is null for the row itself; ``span`` is the number of columns of a cell.
    """
    mine = nodes.where((F.col("part") == DOCUMENT_PART) & N.is_word("tr", "tc"))
    path = N.block_path()
    through = r"^((?:customXml/|sdt/sdtContent/)*)tbl/"
    lead = F.regexp_extract(path, through, 1)
    steps = F.length(lead) - F.length(F.replace(lead, F.lit("/"), F.lit("")))
    rest = F.regexp_replace(path, through, "")
    is_row = N.is_word("tr") & (rest == "")
    is_cell = N.is_word("tc") & (rest == "tr/")
    shape = mine.where(path.rlike(through) & (is_row | is_cell)).select(
        "doc_id",
        F.try_element_at(F.col("ancestors"), steps + 3)["id"].alias("block_id"),
        F.when(is_row, F.col("node_id")).otherwise(F.col("parent_id")).alias("row_id"),
        F.when(is_cell, F.col("node_id")).alias("cell_id"),
    )
    spans = nodes.where(
        (F.col("part") == DOCUMENT_PART)
        & N.is_word("gridSpan")
        & F.col("first")
        & N.under_first("tc", "tcPr")
    ).select(
        "doc_id",
        N.ancestor(2)["id"].alias("cell_id"),
        N.small_int(F.col("val"), 2**31 - 1).alias("span"),
    )
    return shape.join(spans, ["doc_id", "cell_id"], "left").withColumn(
        "span", F.coalesce("span", F.lit(1))
    )


def blocks(paragraphs: DataFrame) -> DataFrame:
    """Top-level blocks with the paragraph ordinals ``first .. last`` (exclusive) they cover."""
    return (
        paragraphs.where(F.col("block_id").isNotNull())
        .groupBy("doc_id", "block_id")
        .agg(
            F.max("block_kind").alias("kind"),
            F.min("idx").alias("first"),
            (F.max("idx") + 1).alias("last"),
        )
    )


def rows_of_cells(shape: DataFrame, cells: DataFrame, gap: str) -> DataFrame:
    """One row of cell texts per table row.

    ``cells(doc_id, block_id, row_id, cell_id, idx, text)``; the non-empty paragraph texts
    of a cell are joined by ``gap``. The result's ``cells`` array holds structs of the cell's
    text and span.
    """
    own = shape.select("doc_id", "block_id", "row_id", "cell_id", "span").withColumns(
        {"idx": F.lit(None).cast("int"), "text": F.lit(None).cast("string")}
    )
    texts = cells.where("text != ''").select(
        "doc_id", "block_id", "row_id", "cell_id", F.lit(None).cast("int").alias("span"), "idx", "text"
    )
    keys = ["doc_id", "block_id", "row_id"]
    # Cells, rows and tables are grouped on longer and longer keys: one shuffle and one sort serve all.
    pieces = own.unionByName(texts).repartition("doc_id", "block_id").sortWithinPartitions(*keys, "cell_id", "idx", "text")
    types = {field.name: field.dataType for field in pieces.schema}
    cell = T.StructType([T.StructField(n, types[n]) for n in ("cell_id", "text", "span")])
    schema = T.StructType([*[T.StructField(k, types[k]) for k in keys], T.StructField("cells", T.ArrayType(cell))])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _gathered_rows(batches, keys, gap, to_arrow_schema(schema))

    return pieces.select(*keys, "cell_id", "span", "text").mapInArrow(gather, schema)


def _changes(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Which rows differ from the one before in a column of ``names``. The first does."""
    out = np.zeros(len(table), bool)
    out[:1] = True
    for name in names:
        codes = table.column(name).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        out[1:] |= codes[1:] != codes[:-1]
    return out


def _gathered_rows(
    batches: Iterator[pa.RecordBatch], keys: Sequence[str], gap: str, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    """Sorted pieces of cells as one row per table row. Only a row that the next batch may go on with is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        ends = pa.Table.from_batches([held[0].slice(0, 1), batch.slice(batch.num_rows - 1)]).select(keys)
        if _changes(ends, keys)[1]:
            table = pa.Table.from_batches(held)
            last = int(np.flatnonzero(_changes(table, keys))[-1])
            yield _table_rows(table.slice(0, last), keys, gap, schema)
            held = table.slice(last).combine_chunks().to_batches()
    if held:
        yield _table_rows(pa.Table.from_batches(held), keys, gap, schema)


def _table_rows(pieces: pa.Table, keys: Sequence[str], gap: str, schema: pa.Schema) -> pa.RecordBatch:
    """One row of cells for each run of equal keys."""
    new_row = _changes(pieces, keys)
    rows = np.flatnonzero(new_row)
    new_cell = new_row | _changes(pieces, ["cell_id"])
    ids, texts, spans = (pieces.column(n).combine_chunks() for n in ("cell_id", "text", "span"))
    # Pieces without a cell are rows themselves.
    in_cell = ids.is_valid().to_numpy(zero_copy_only=False)
    cells = np.flatnonzero(new_cell & in_cell)
    place = pa.array(cells)

    def bounds(counted: np.ndarray, starts: np.ndarray) -> pa.Array:
        """Of the ``counted`` pieces, how many lie before each start, and in all."""
        before = np.concatenate(([0], np.cumsum(counted)))
        return pa.array(before[np.append(starts, len(counted))], pa.int32())

    shown = texts.is_valid().to_numpy(zero_copy_only=False) & in_cell
    lists = pa.ListArray.from_arrays(bounds(shown, cells), texts.filter(pa.array(shown)))
    of_cell = pa.array(np.cumsum(new_cell & in_cell)[in_cell] - 1)
    widest = pa.table({"cell": of_cell, "span": spans.filter(pa.array(in_cell))}).group_by("cell", use_threads=False).aggregate([("span", "max")])
    kind = schema.field("cells").type
    columns = [ids.take(place), pc.binary_join(lists, gap), widest.column("span_max").combine_chunks()]
    structs = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, kind.value_type)], fields=list(kind.value_type))
    listed = pa.ListArray.from_arrays(bounds(new_cell & in_cell, rows), structs, type=kind)
    at = pa.array(rows)
    return pa.RecordBatch.from_arrays([*[pieces.column(k).combine_chunks().take(at) for k in keys], listed], schema=schema)


def plain_text(nodes: DataFrame, shape: DataFrame | None = None) -> DataFrame:
    """One line per block paragraph and per table row, cells separated by tabs."""
    paragraphs = body_paragraphs(nodes)
    lines = paragraphs.where("block_kind = 'paragraph'").select(
        "doc_id", F.col("block_id").alias("at"), "text"
    )
    cells = paragraphs.where(F.col("cell_id").isNotNull())
    rows = rows_of_cells(table_shape(nodes) if shape is None else shape, cells, " ").select(
        "doc_id", F.col("row_id").alias("at"), F.array_join("cells.text", "\t").alias("text")
    )
    joined = (
        lines.unionByName(rows)
        .groupBy("doc_id")
        .agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "text")))["text"], "\n").alias("text"))
    )
    totals = paragraphs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_paragraphs"))
    return totals.join(joined, "doc_id", "left").select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.length(F.coalesce("text", F.lit(""))).alias("characters"),
        "total_paragraphs",
    )


def guards(nodes: DataFrame, anchors: bool = True) -> DataFrame:
    """Paragraphs plain-text edits must not touch: ``(doc_id, idx, reason)``.

    ``anchors`` also protects bookmark, comment and move ranges, which replacing and
    deleting must, and inserting and formatting need not.
    """
    body = nodes.where(F.col("part") == DOCUMENT_PART)
    outside = body.where(N.is_word("p") & N.inside(*LOCKED_IN)).select(
        "doc_id",
        F.col("para").alias("idx"),
        F.lit(0).alias("_rank"),
        F.lit("inside a revision or a content control").alias("reason"),
    )
    contained = F.concat(F.lit("holds something an edit would break: "), "name")
    within = body.where(
        F.col("para").isNotNull() & N.is_word(*[n for n in UNEDITABLE if n != "p"])
    ).select("doc_id", F.col("para").alias("idx"), (F.col("node_id") + 1).alias("_rank"), contained.alias("reason"))
    # A paragraph inside a paragraph locks the outer one.
    outer = N.nearest("p")["id"]
    nested = body.where(N.is_word("p") & outer.isNotNull()).select(
        "doc_id", outer.alias("_outer"), (F.col("node_id") + 1).alias("_rank"), contained.alias("reason")
    )
    owners = body.where(N.is_word("p")).select(
        "doc_id", F.col("node_id").alias("_outer"), F.col("para").alias("idx")
    )
    found = outside.unionByName(within).unionByName(
        nested.join(unsent(owners), ["doc_id", "_outer"]).select("doc_id", "idx", "_rank", "reason")
    )
    if anchors:
        anchored = body.where(
            F.col("para").isNotNull() & F.col("is_word") & F.col("name").rlike(ANCHOR)
        ).select(
            "doc_id",
            F.col("para").alias("idx"),
            F.lit(2**31 - 1).alias("_rank"),
            F.lit("ranges begin or end here").alias("reason"),
        )
        found = found.unionByName(anchored)
    return found.groupBy("doc_id", "idx").agg(F.min_by("reason", "_rank").alias("reason"))


def deletion_guards(nodes: DataFrame) -> DataFrame:
    """``guards`` plus paragraphs whose removal would break their container."""
    body = nodes.where(F.col("part") == DOCUMENT_PART)
    sections = body.where(
        N.is_word("sectPr") & F.col("para").isNotNull() & N.under_first("p", "pPr")
    ).select("doc_id", F.col("para").alias("idx"), F.lit("a section ends here").alias("reason"))
    # Per container: its paragraphs, and the last two children that are not properties.
    child = F.struct("node_id", N.is_word("p").alias("is_p"))
    containers = (
        body.where(F.col("parent_id").isNotNull())
        .groupBy("doc_id", "parent_id")
        .agg(
            F.count(F.when(N.is_word("p"), 1)).alias("_paragraphs"),
            F.slice(
                F.reverse(
                    F.array_sort(F.collect_list(F.when(~N.is_word("tcPr"), child)))
                ),
                1,
                2,
            ).alias("_last"),
        )
        .where("_paragraphs > 0")
    )
    places = body.where(N.is_word("p")).select(
        "doc_id",
        "parent_id",
        "node_id",
        F.col("para").alias("idx"),
        N.ancestor(1)["name"].alias("_in"),
        N.under("tc").alias("_cell"),
    )
    last = F.col("_last")[0]
    following = F.when(
        last["node_id"] == F.col("node_id"), F.try_element_at("_last", F.lit(2))["is_p"]
    ).otherwise(last["is_p"])
    reason = F.when(
        F.col("_paragraphs") == 1,
        F.concat(F.lit("the last paragraph of its "), "_in"),
    ).when(
        F.col("_cell") & ~F.coalesce(following, F.lit(False)),
        F.lit("a table cell must end with a paragraph"),
    )
    broken = (
        places.join(unsent(containers), ["doc_id", "parent_id"])
        .select("doc_id", "idx", reason.alias("reason"))
        .where("reason is not null")
    )
    ranked = (
        guards(nodes).withColumn("_rank", F.lit(0))
        .unionByName(sections.withColumn("_rank", F.lit(1)))
        .unionByName(broken.withColumn("_rank", F.lit(2)))
    )
    return ranked.groupBy("doc_id", "idx").agg(F.min_by("reason", "_rank").alias("reason"))
