"""Writing packages and previews, and the change feed."""

from __future__ import annotations

from documents import parsed

from scriptorium.operators import structure
from scriptorium.operators.paragraphs import info
from scriptorium.sinks import docx, html
from scriptorium.sources import packages as S
from scriptorium.sources import xml_nodes as N
from scriptorium.streaming.changes import read_changes, stream_changes

ROUGH = "é 🍎 <script>& \"quotes\"\nline\ttab"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, idx int, text string")


def test_write_and_read_back(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    made = frame(spark, [("x", 0, ROUGH), ("x", 1, "b\r\nc"), ("y/z.docx", 0, "a")])
    assert {r.doc_id: r.written for r in docx.write_docx(made, folder).collect()} == {"x": True, "y/z.docx": True}
    found = S.scan_packages(spark, f"{tmp_path}/out")
    nodes = N.accepted(N.ingest_nodes(found.parts, ["word/document\\.xml"]))
    listing = structure.listing(nodes)
    got = {(r.doc_id.rsplit("/", 1)[-1], r.idx): r.text for r in listing.collect()}
    second = "y=2Fz.docx.docx"
    assert got == {("x.docx", 0): ROUGH, ("x.docx", 1): "b\nc", (second, 0): "a"}
    about = {r.doc_id.rsplit("/", 1)[-1]: r for r in info(listing, found.parts).collect()}
    assert about[second].paragraph_count == 1 and about[second].character_count == 1
    assert about[second].parts == ["[Content_Types].xml", "_rels/.rels", "word/document.xml"]
    # The same content again is fine (a retry); other content is refused unless overwritten.
    again = docx.write_docx(made, folder).collect()
    assert all(r.written for r in again)
    other = frame(spark, [("x", 0, "new")])
    assert docx.write_docx(other, folder).first().reason == "a different file is there"
    assert docx.write_docx(other, folder, overwrite=True).first().written
    assert not list((tmp_path / "out").glob("*.part"))


def test_names_never_collide_and_nothing_is_lost(spark, tmp_path):
    ids = ["/a/x.docx", "/b/x.docx", "v1.2", "v1.3", "a/b", "a=2Fb", "n" * 400 + "1", "n" * 400 + "2"]
    made = frame(spark, [(i, n, t) for i in ids for n, t in enumerate([f"first of {i}", None, f"last of {i}"])])
    written = docx.write_docx(made, f"file://{tmp_path}/out").collect()
    assert {r.doc_id for r in written if r.written} == set(ids) and len({r.path for r in written}) == len(ids)
    nodes = N.accepted(N.ingest_nodes(S.scan_packages(spark, f"{tmp_path}/out").parts, ["word/document\\.xml"]))
    texts = sorted((r.idx, r.text) for r in structure.listing(nodes).collect())
    assert texts == sorted((n, t) for i in ids for n, t in enumerate([f"first of {i}", "", f"last of {i}"]))
    # A second call keeps the first one's manifest.
    docx.write_docx(frame(spark, [("other", 0, "x")]), f"file://{tmp_path}/out").collect()
    assert len(list((tmp_path / "out" / "_manifest").iterdir())) == 2


def test_two_documents_of_one_id_are_not_written_over_each_other(spark, tmp_path):
    built = docx.packages(frame(spark, [("x", 0, "a"), ("y", 0, "b")])).packages.selectExpr("'same' doc_id", "content")
    rows = docx.write_packages(built, f"file://{tmp_path}/out", overwrite=True).collect()
    assert sorted(r.written for r in rows) == [False, True]


def test_large_documents_are_written_and_invalid_ones_refused(spark):
    rows = [("bad", 0, "a\x01"), ("ok", 0, "fine")]
    big = frame(spark, [("big", 0, "x" * 1_000_000)]).selectExpr("doc_id", "explode(sequence(0, 17)) idx", "text")
    many = spark.range(70_000).selectExpr("'many' doc_id", "cast(id as int) idx", "'a\nb' text")
    built = docx.packages(frame(spark, rows).unionByName(big).unionByName(many))
    assert {r.doc_id for r in built.packages.select("doc_id").collect()} == {"ok", "big", "many"}
    assert [r.doc_id for r in built.rejects.collect()] == ["bad"]


def test_properties_are_written_in_order(spark):
    paragraphs = spark.createDataFrame(
        [("d", 0, "ab", "Quote", "both", "2", 1)],
        "doc_id string, idx int, text string, style string, alignment string, num_id string, level int",
    )
    runs = spark.createDataFrame(
        [("d", 0, 0, "a", True, None, "single", 12.5, "A & B"), ("d", 0, 1, "b", None, False, None, None, None)],
        "doc_id string, idx int, run int, text string, bold boolean, italic boolean, underline string, size_pt double, font string",
    )
    xml = docx.paragraph_xml(paragraphs, runs).first().xml
    order = ["<w:pStyle", "<w:numPr>", "<w:jc", "<w:rFonts", "<w:b ", "<w:sz", "<w:u ", "<w:i "]
    assert [xml.index(tag) for tag in order] == sorted(xml.index(tag) for tag in order)
    package = docx.packages(paragraphs, runs).packages.first()
    nodes, _ = parsed(spark, bytes(package.content))
    got = [(r.text, r.bold, r.italic, r.underline, r.size_pt, r.font) for r in structure.runs(nodes).orderBy("run").collect()]
    assert got == [("a", True, None, "single", 12.5, "A & B"), ("b", None, False, None, None, None)]


def test_previews(spark, tmp_path):
    made = frame(spark, [("d", 0, ROUGH), ("d", 1, "b"), ("d", 2, "c")])
    whole = html.html_preview(made).first().html
    assert whole.startswith("<!doctype html>") and whole.endswith("</p></body></html>")
    assert "<p>é 🍎 &lt;script&gt;&amp; &quot;quotes&quot;<br>line\ttab</p>\n<p>b</p>" in whole
    pieces = html.html_preview(made, chunk=2).orderBy("piece").collect()
    assert len(pieces) == 2 and "".join(r.html for r in pieces) == whole
    html.write_previews(made, f"{tmp_path}/previews")
    assert list(tmp_path.glob("previews/doc_id=d/piece=0/*.txt"))


def test_change_feed(spark, tmp_path):
    schema = "doc_id string, text string, version int"
    source, store = f"{tmp_path}/in", f"{tmp_path}/store"

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = stream_changes(spark.readStream.schema(schema).parquet(source), store, f"{tmp_path}/progress")
        stream.awaitTermination()

    def seen():
        found = read_changes(spark, store, "string").collect()
        return sorted((r.batch, r.doc_id, r.version, r.type, r.text) for r in found)

    arrive(("a", "1\n2", 0), ("b", "x", 0))
    assert seen() == []
    arrive(("a", "1\n2!", 1), ("a", "0\n1\n2!", 2), ("c", "new", 0))
    second = [(1, "a", 1, "changed", "2!"), (1, "a", 2, "inserted", "0")]
    assert seen() == second
    arrive(("a", "0", 3), ("b", "x", 1))
    third = [(2, "a", 3, "deleted", None), (2, "a", 3, "deleted", None)]
    assert seen() == second + third


def test_change_feed_leaves_no_working_tables(spark, tmp_path):
    from pathlib import Path
    from urllib.parse import urlparse

    from scriptorium.lineage import shared_folder

    folder = Path(urlparse(shared_folder(spark)).path)
    held = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    schema = "doc_id string, text string, version int"
    whole = "\n".join(f"{i} " + f"line {i} " * 300 for i in range(200))
    spark.createDataFrame([("a", whole, 0), ("a", whole + "!", 1), (None, "x", 0)], schema).write.parquet(f"{tmp_path}/in")
    before = held()
    stream_changes(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/store", f"{tmp_path}/progress").awaitTermination()
    assert held() - before < 50_000
    found = read_changes(spark, f"{tmp_path}/store", "string").collect()
    assert [(r.doc_id, r.version, r.type, r["index"]) for r in found] == [("a", 1, "changed", 199)]
    kept = spark.read.parquet(f"{tmp_path}/store/snapshots").where("doc_id = 'a'").orderBy("idx").collect()
    assert "\n".join(r.text for r in kept) == whole + "!"


def test_shipped_package_is_whole(spark):
    import zipfile

    from scriptorium.session import ship

    before = set(spark.sparkContext._python_includes)
    ship(spark)
    added = set(spark.sparkContext._python_includes) - before
    assert added == {"scriptorium.zip"}
    from pyspark import SparkFiles

    names = zipfile.ZipFile(SparkFiles.get("scriptorium.zip")).namelist()
    assert "scriptorium/sources/xml_nodes.py" in names
