"""Reading parsed packages: a guide to marsh birds, with values worked out by hand."""

from __future__ import annotations

import pytest
from documents import field, guide, p, package, parsed, r, style, table
from pyspark.sql import functions as F

from scriptorium.functions.fields import field_target
from scriptorium.operators import formatting, inline, markdown, numbering, search, structure, styles

BLOCKS = [
    "# Birds of the marsh",
    "# Herons",
    "They wade **slowly**, mostly *alone\\_2*[^en4]!",
    "## Bitterns",
    # A bullet; level 1 of its list starts at 4; the other list is overridden to start at 6.
    "- reed\n    4. old reed\n6. Look\n7. Listen",
    "| Bird | Count | Pool |\n| --- | --- | --- |\n| teal\\|duck | 4<br>5 | north<br>inner |",
    "On the [map](https://marsh.test/map?reed=1&pool=7);  \nby boat",
    "#### Nests",
    "after [rings 12](https://rings.test/#old)",
    "[^en4]: Counted at dawn, by boat.",
]
PARAGRAPHS = 19


@pytest.fixture(scope="module")
def doc(spark):
    return parsed(spark, guide())


@pytest.fixture(scope="module")
def formatted(doc):
    nodes, rels = doc
    resolved = styles.resolve(structure.body_paragraphs(nodes), nodes, rels)
    names = styles.styles_table(nodes, rels).select("doc_id", "style_id", F.col("name").alias("style_name"))
    levels = numbering.num_levels(nodes, rels)
    rows = formatting.paragraph_formatting(resolved, levels, structure.runs(nodes), names).collect()
    return {row.idx: row.asDict(recursive=True) for row in rows}


def test_whole_markdown(doc):
    whole = markdown.markdown(*doc).first()
    assert whole.markdown == "\n\n".join(BLOCKS)
    assert (whole.start, whole.end, whole.next_start, whole.total_paragraphs) == (0, PARAGRAPHS, None, PARAGRAPHS)


def test_a_slice_keeps_numbers_and_takes_whole_tables(doc):
    lists = markdown.markdown(*doc, start=5, limit=2).first()
    assert lists.markdown == "    4. old reed\n6. Look" and lists.next_start == 7
    tables = markdown.markdown(*doc, start=7, limit=2).first()
    assert tables.markdown == "7. Listen\n\n" + BLOCKS[5] and tables.next_start == 16
    with pytest.raises(ValueError):
        markdown.markdown(*doc, start=-1)


def test_outline_follows_inherited_levels(doc):
    nodes, rels = doc
    found = styles.outline(styles.resolve(structure.body_paragraphs(nodes), nodes, rels)).orderBy("idx")
    assert [(h.idx, h.level, h.style) for h in found.collect()] == [
        (0, 0, "Title"), (1, 1, "Species"), (3, 2, "Habit"), (17, 4, "Prose"),
    ]


def test_search_goes_through_stories(doc):
    stories = structure.stories(*doc)
    place = lambda m: (m.story, m.idx, m.offset, m.before[-4:], m.after[:4], m.note_id)
    boats = search.find(stories, "BOAT", match_case=False, scope="all").orderBy("part").collect()
    assert [place(m) for m in boats] == [
        ("body", 16, 15, "\nby ", "", None),
        ("endnote", 1, 21, " by ", ".", "4"),
        ("footer", 0, 14, "ey, ", " two", None),
    ]
    assert [m.idx for m in search.find(stories, "reed", whole_word=True).orderBy("idx").collect()] == [4, 5]
    first = search.find(stories, "i", max_results=3).collect()
    assert len(first) == 3 and all(m.truncated for m in first)
    assert search.find(stories, "boat", context_chars=5000).first().before == "On the map;\nby "
    for refused in ({"text": ""}, {"text": "x", "max_results": 0}, {"text": "x", "context_chars": -1}):
        with pytest.raises(ValueError):
            search.find(stories, **refused)


def test_properties_come_from_defaults_styles_and_paragraphs(formatted):
    assert len(formatted) == PARAGRAPHS
    species, habit, nests = formatted[1], formatted[3], formatted[17]
    assert species["spacing"] == habit["spacing"] == {"before_pt": 15.0, "after_pt": 5.0, "line": 1.25, "line_rule": "multiple"}
    assert (species["style_name"], species["keep_lines"], habit["keep_lines"], habit["outline_level"]) == ("heading 1", True, True, 2)
    assert (nests["alignment"], nests["outline_level"], nests["style_id"]) == ("right", 4, "Prose")
    assert nests["indent"] == {"left_pt": None, "right_pt": 12.0, "first_line_pt": 24.0, "hanging_pt": None}


def test_lists_come_from_styles_and_overrides(formatted):
    assert formatted[4]["numbering"] == {"num_id": "7", "ilvl": 0, "format": "bullet", "level_text": "*"}
    assert formatted[4]["keep_next"] and not formatted[5]["keep_next"]
    assert formatted[5]["numbering"] == {"num_id": "7", "ilvl": 1, "format": "decimal", "level_text": "%2)"}
    assert formatted[6]["numbering"] == formatted[7]["numbering"]
    assert sorted(i for i, row in formatted.items() if row["in_table"]) == list(range(8, 16))


def test_run_formatting(formatted):
    runs = formatted[2]["runs"]
    assert [x["text"] for x in runs] == ["They wade ", "slowly", ", mostly ", "alone_", "2", "!"]
    assert [(x["bold"], x["italic"]) for x in runs[:4]] == [(None, None), (True, None), (None, None), (None, True)]
    ringed = {k: v for k, v in runs[4].items() if v is not None}
    assert ringed == {
        "run": 4, "text": "2", "italic": True, "font": "Georgia", "size_pt": 9.5, "color": "1F6F3A",
        "highlight": "cyan", "vertical_align": "subscript",
    }


def test_plain_text_and_notes(doc):
    nodes, rels = doc
    lines = ["Birds of the marsh", "Herons", "They wade slowly, mostly alone_2!", "Bitterns", "reed", "old reed", "Look", "Listen"]
    lines += ["Bird\tCount\tPool", "teal|duck\t4 5\tnorth inner", "On the map;", "by boat", "Nests", "after rings 12"]
    got = structure.plain_text(nodes).first()
    assert (got.text, got.characters, got.total_paragraphs) == ("\n".join(lines), len("\n".join(lines)), PARAGRAPHS)
    notes = {n.note_id: n.text for n in structure.notes(nodes, rels, "endnote").collect()}
    assert notes == {"0": "", "4": "Counted at dawn, by boat."}


def test_hyperlinks(doc):
    found = inline.hyperlinks(*doc).collect()
    assert [x for row in found for x in row if x == "https://marsh.test/map?reed=1&pool=7"]


def test_listing_counts_tabs_and_shows_tables(spark):
    tabbed = '<dx:tabs><dx:tab dx:val="right" dx:pos="900"/></dx:tabs>'
    body = p(r("pool"), props=tabbed) + table([p(r("duck"), props=style("Cell"))]) + "<dx:p/>"
    nodes, _ = parsed(spark, package(body))
    got = [tuple(row)[1:] for row in structure.listing(nodes).orderBy("idx").collect()]
    assert got == [(0, "\tpool", None, False), (1, "duck", "Cell", True), (2, "", None, False)]


def test_wrapped_and_boxed_paragraphs(spark):
    control = f"<dx:sdt><dx:sdtContent>{p(r('chosen'))}</dx:sdtContent></dx:sdt>"
    tagged = f"<dx:customXml>{table([p(r('egg')), p(r('chick'))])}</dx:customXml>"
    caption = p(r("pond"), f"<dx:r><dx:pict><dx:txbx>{p(r('caption'))}</dx:txbx></dx:pict></dx:r>")
    nodes, rels = parsed(spark, package(control + tagged + caption + f"<dx:ins>{p(r('added'))}</dx:ins>"))
    assert structure.plain_text(nodes).first().text == "chosen\negg\tchick\npond"
    spans = structure.blocks(structure.body_paragraphs(nodes)).orderBy("first").collect()
    assert [(b.kind, b.first, b.last) for b in spans] == [("paragraph", 0, 1), ("table", 1, 3), ("paragraph", 3, 4)]
    assert markdown.markdown(nodes, rels).first().markdown == "chosen\n\n| egg | chick |\n| --- | --- |\n\npond"


def test_spanned_cells_page_breaks_and_fields(spark):
    wide = table([p(r("n")), '<dx:tcPr><dx:gridSpan dx:val="3"/></dx:tcPr>' + p(r("span"))], [p(r("z"))])
    short = p('<dx:fldSimple dx:instr="HYPERLINK \\l &quot;mud flat&quot;">' + r("mud") + "</dx:fldSimple>")
    pages = p('<dx:r><dx:t>sun</dx:t><dx:br dx:type="page"/><dx:br/><dx:t>moon</dx:t></dx:r>')
    stray = p('<dx:r><dx:fldChar dx:fldCharType="end"/></dx:r>', field("DATE", r("today")))
    nodes, rels = parsed(spark, package(wide + short + pages + stray))
    assert markdown.markdown(nodes, rels).first().markdown == (
        "| n | span |  |  |\n| --- | --- | --- | --- |\n| z |  |  |  |\n\n[mud](<#mud flat>)\n\nsun  \nmoon\n\ntoday"
    )


def test_field_targets(spark):
    cases = [
        ('HYPERLINK "https://rings.test/x y" \\t "_blank"', "https://rings.test/x y"),
        (' hyperlink \\l "pool7" ', "#pool7"),
        ("HyperLink bare \\h", "bare"),
        ("SEQ pools", None),
        (" HYPERLINK ", None),
    ]
    frame = spark.createDataFrame(cases, "i string, want string")
    got = frame.select("want", field_target("i").alias("got")).collect()
    assert [row for row in got if row.want != row.got] == []


def test_heading_names(spark):
    cases = [("heading 7", 7), ("Heading2", 2), ("title", 0), ("heading 12", None), ("Prose", None), ("Heading0", None)]
    frame = spark.createDataFrame(cases, "n string, want int")
    got = frame.select("n", "want", styles.name_level(F.col("n")).alias("got")).collect()
    assert [row for row in got if row.want != row.got] == []
