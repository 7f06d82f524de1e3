"""Packages in: refusals, parts, content types, relationships, elements."""

from __future__ import annotations

import pytest
from documents import NUMBERING, PRESERVED, archive, files, guide, p, package, parsed, r, word_part
from pyspark.sql import functions as F

from scriptorium.schema import CONTENT_TYPE, WORD_NS
from scriptorium.sources import packages as S
from scriptorium.sources import relationships as R
from scriptorium.sources import xml_nodes as N


def test_unreadable_packages_are_refused_and_others_kept(spark):
    broken = bytearray(package(p(r("broken")) * 400))
    broken[60:90] = bytes(30)
    opened = S.open_packages(
        files(spark, package(p(r("duck"))), b"PK but no archive", archive([("word/footer1.xml", "<a/>")]), bytes(broken))
    )
    assert {row.doc_id for row in opened.parts.select("doc_id").distinct().collect()} == {"0"}
    reasons = {row.doc_id: row.reason for row in opened.rejects.collect()}
    assert set(reasons) == {"1", "2", "3"} and "word/document.xml" in reasons["2"]
    assert bytes(opened.parts.where("part = 'extras/ledger.dat'").first().bytes) == PRESERVED


def test_size_does_not_matter(spark):
    many = archive([("word/document.xml", f'<w:document xmlns:w="{WORD_NS}"><w:body/></w:document>')] + [(f"item{n}", "") for n in range(5000)])
    nodes, _ = parsed(spark, package("<dx:p/>" * 260_000))
    assert S.open_packages(files(spark, many)).parts.count() == 5001
    assert nodes.where("name = 'p'").count() == 260_000


@pytest.mark.filterwarnings("ignore:Duplicate name")
def test_two_entries_of_one_name_are_refused(spark):
    twice = archive([("word/document.xml", "<a/>"), ("word/styles.xml", "<a/>"), ("word/styles.xml", "<b/>")])
    opened = S.open_packages(files(spark, twice))
    assert opened.parts.count() == 0 and opened.rejects.count() == 1


def test_scan_lists_before_it_reads(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "one.dotx").write_bytes(package(p(r("a"))))
    (tmp_path / "deep" / "er" / "TWO.Docx").write_bytes(package(p(r("b"))))
    (tmp_path / "old.DOC").write_bytes(b"binary")
    (tmp_path / "picture.png").write_bytes(b"no document")
    found = S.scan_packages(spark, str(tmp_path))
    names = {row.doc_id.rsplit("/", 1)[-1] for row in found.parts.select("doc_id").distinct().collect()}
    assert names == {"one.dotx", "TWO.Docx"}
    assert [row.doc_id.rsplit("/", 1)[-1] for row in found.rejects.collect()] == ["old.DOC"]


def test_only_what_is_asked_for_is_unzipped(spark):
    frame = files(spark, guide(), b"none")
    listed = S.opened(frame, with_bytes=False).where("reason is null")
    assert listed.where("bytes is not null").count() == 0
    sizes = {row.part: row.size for row in listed.collect()}
    whole = {row.part: len(row.bytes) for row in S.open_packages(frame).parts.collect()}
    assert sizes == whole
    some = S.open_packages(frame, names=["word/numbering.xml"]).parts.collect()
    assert [row.part for row in some] == ["word/numbering.xml"]


def test_content_types(spark):
    opened = S.open_packages(files(spark, guide()))
    nodes, _ = parsed(spark, guide())
    listed = {row.part: row.content_type for row in S.list_parts(opened.parts, nodes).collect()}
    assert listed["word/endnotes.xml"] == CONTENT_TYPE["endnotes"] and listed["word/_rels/document.xml.rels"] == CONTENT_TYPE["relationships"]
    assert listed["extras/ledger.dat"] is None


def test_part_text_is_whole(spark):
    opened = S.open_packages(files(spark, guide()))
    text = S.part_text(opened.parts, "word/numbering.xml").first()
    assert (text.text, text.size, text.reason) == (NUMBERING, len(NUMBERING.encode()), None)
    for name in ("/extras/ledger.dat", "word/comments.xml"):
        row = S.part_text(opened.parts, name).first()
        assert row.text is None and row.reason
    with pytest.raises(ValueError):
        S.part_text(opened.parts, "")
    long = word_part("ftr", f"<w:p><w:r><w:t>{'ß' * 800_000}</w:t></w:r></w:p>")
    big = S.open_packages(files(spark, package("<dx:p/>", {"word/footer1.xml": ("footer", long)})))
    plan = S.part_text(big.parts, "word/footer1.xml")
    assert plan.first().text == long
    assert plan._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1


def test_targets_resolve_against_their_source(spark):
    cases = [
        ("word/document.xml", "footer2.xml", "word/footer2.xml"),
        ("word/glossary/document.xml", "../../docProps/app.xml", "docProps/app.xml"),
        ("word/footnotes.xml", "/customXml/item4.xml", "customXml/item4.xml"),
        ("", "docProps/./core.xml", "docProps/core.xml"),
    ]
    frame = spark.createDataFrame(cases, "s string, t string, want string")
    got = frame.select("want", R.resolve_target(F.col("s"), F.col("t")).alias("got")).collect()
    assert [row for row in got if row.want != row.got] == []
    sources = spark.createDataFrame(
        [("word/glossary/_rels/document.xml.rels", "word/glossary/document.xml"), ("_rels/.rels", "")], "p string, want string"
    )
    got = sources.select("want", R.relationship_source(F.col("p")).alias("got")).collect()
    assert [row for row in got if row.want != row.got] == []


def test_documents_are_refused_with_a_reason(spark):
    word = f'xmlns:w="{WORD_NS}"'
    bad = [
        f'<!DOCTYPE w:document><w:document {word}><w:body/></w:document>',
        f"<w:styles {word}/>",
        f"<w:document {word}><w:background/></w:document>",
        f"<w:document {word}><w:body/><w:p/><w:body/></w:document>",
        f"<w:document {word}><w:sdt><w:body/></w:sdt></w:document>",
        f"<w:document {word}><w:body></w:document>",
    ]
    good = "<w:sdt>" * 300 + "<w:p/>" + "</w:sdt>" * 300
    bad_files = files(spark, *[archive([("word/document.xml", x)]) for x in [*bad, f"<w:document {word}><w:body>{good}</w:body></w:document>"]])
    nodes = N.ingest_nodes(S.open_packages(bad_files).parts)
    refused = {row.doc_id: row.reason for row in N.refused(nodes).collect()}
    assert set(refused) == {str(n) for n in range(len(bad))} and len(set(refused.values())) == len(bad)
    assert {row.doc_id for row in N.accepted(nodes).select("doc_id").distinct().collect()} == {str(len(bad))}


def test_only_values_of_the_format_count(spark):
    from scriptorium.operators.structure import body_paragraphs

    body = (
        '<dx:p><dx:pPr><dx:pStyle dx:val="A&lt;B"/></dx:pPr></dx:p>'
        '<dx:p><dx:pPr><dx:pStyle val="plain"/></dx:pPr></dx:p>'
        '<dx:p xmlns:z="urn:birds"><dx:pPr><dx:pStyle z:val="other"/></dx:pPr></dx:p>'
    )
    nodes, _ = parsed(spark, package(body))
    assert [row.style for row in body_paragraphs(nodes).orderBy("idx").collect()] == ["A<B", None, None]
