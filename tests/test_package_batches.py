"""What the tasks that write and parse packages hold at a time, and how often they deal rows out."""

import io
import random
import zipfile

import pyarrow as pa
from documents import NUMBERING, guide, parsed

from scriptorium.lineage import stored
from scriptorium.operators import numbering, structure, styles
from scriptorium.plans import package_queries
from scriptorium.schema import DOCUMENT_PART
from scriptorium.sinks import docx
from scriptorium.sources import packages as S

_FIXED = docx._fixed_parts([docx.Part("word/numbering.xml", "numbering", NUMBERING)])


def _rows(texts):
    return pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "xml": pa.array(texts, pa.string())})


def test_archives_leave_in_small_batches():
    noise = random.Random(5)
    texts = [noise.randbytes(150_000).hex() for _ in range(60)]
    schema = pa.schema([("doc_id", pa.int64()), ("content", pa.binary())])
    sent = list(docx._compressed(iter([_rows(texts), _rows(texts[:1])]), _FIXED, schema))
    assert len(sent) > 3
    assert all(batch.nbytes < 2 * docx._BATCH for batch in sent)
    ids = [i for batch in sent for i in batch.column(0).to_pylist()]
    assert ids == [*range(60), 0]
    for i, content in zip(ids, (c for batch in sent for c in batch.column(1).to_pylist())):
        assert zipfile.ZipFile(io.BytesIO(content)).read(DOCUMENT_PART).decode() == texts[i]


def test_an_archive_begun_once_equals_one_written_at_once():
    archive, buffer = docx._Archive(_FIXED), io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as whole:
        for name, data in [*_FIXED, (DOCUMENT_PART, b"<a/>")]:
            whole.writestr(docx._entry(name), data)
    assert archive.with_part(DOCUMENT_PART, b"<a/>") == buffer.getvalue()
    assert archive.with_part(DOCUMENT_PART, b"<b/>") != buffer.getvalue()
    assert archive.with_part(DOCUMENT_PART, b"<a/>") == buffer.getvalue()


def test_packages_take_one_shuffle(spark):
    blocks = spark.createDataFrame(
        [(1, 1, "<w:p>b</w:p>"), (1, 0, "<w:p>a</w:p>"), (2, 0, "<w:p>\x01</w:p>"), (2, 1, "<w:p/>")], "doc_id long, idx int, xml string"
    )
    written = docx.packages_of(blocks)
    plan = written.packages._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert [tuple(row) for row in written.rejects.collect()] == [(2, "a character that XML cannot hold")]
    parts = S.open_packages(written.packages).parts.where(f"part = '{DOCUMENT_PART}'").collect()
    assert [row.doc_id for row in parts] == [1]
    assert b"<w:p>a</w:p><w:p>b</w:p>" in bytes(parts[0].bytes)


def test_styles_and_levels_read_the_elements_once(spark):
    nodes, rels = parsed(spark, guide())
    nodes, rels = stored(nodes), stored(rels)

    def scans(frame):
        plan = frame._jdf.queryExecution().executedPlan().toString().splitlines()
        return sum("FileScan" in line and "is_word#" in line and "part#" in line for line in plan)

    assert scans(styles.resolve(structure.body_paragraphs(nodes), nodes, rels)) == 1
    assert scans(numbering.num_levels(nodes, rels)) == 0


def test_many_small_files_share_tasks(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    for i in range(40 * 8 * cores):
        (tmp_path / f"{i}.docx").write_bytes(b"none")
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    found = S.scan_packages(spark, str(tmp_path))
    assert found.parts.rdd.getNumPartitions() <= 8 * cores < files.rdd.getNumPartitions()
    assert found.rejects.count() == files.count()


def test_info_writes_the_packages_once(spark, tmp_path):
    rows = [(1, "one line\nand another"), (2, ""), (3, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    info = package_queries.docx_info(spark, str(tmp_path))
    counted = {row.doc_id: (row.paragraph_count, row.character_count, len(row.parts)) for row in info.collect()}
    assert counted == {1: (2, 19, 7), 2: (1, 0, 7), 3: (1, 1, 7)}
    plan = info._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    # What is left to do is opening the stored packages twice and parsing the bodies.
    assert plan.count("MapInPandas") == 2 and plan.count("MapInArrow") == 1
    assert "documents.parquet" not in plan


def test_scan_is_listed_by_tasks_as_spark_would(spark, tmp_path):
    root = tmp_path / "in box"
    names = [
        "a b+c%20#1.docx", "é 🍎 ü?.DOCM", "q'\"<>[x]{y}|^`~;,=&@!$().docx", "_hid.docx", ".hid.docx", "_a=b.docx", "x.docx._COPYING_",
        "deep/_no/x.docx", "deep/.no/x.docx", "deep/er/y\\z.dotx", "deep/er/old.RTF", "no.txt", "docx", ".docx", "folder.docx/in.docx",
    ]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(name.encode())
    (root / "empty").mkdir()

    def by_spark(extensions):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        return {r.path for r in reader.option("pathGlobFilter", S.package_glob(extensions)).load(str(root)).collect()}

    found = S.scan_packages(spark, f"file://{tmp_path}/in box")
    refused = {r.doc_id: r.reason for r in found.rejects.collect()}
    assert {d for d, r in refused.items() if r == "not a readable archive"} == by_spark(S.PACKAGE_EXTENSIONS)
    assert {d for d, r in refused.items() if r == "a document, but not a package"} == by_spark(["doc", "rtf"])
    assert {r.doc_id for r in S.scan_packages(spark, str(root)).rejects.collect()} == set(refused)
    assert "binaryFile" not in found.rejects._jdf.queryExecution().executedPlan().toString()
    # One file alone and a pattern are Spark's to find.
    one = S.scan_packages(spark, f"{tmp_path}/in*/_a=b.docx").rejects.collect()
    assert len(one) == 1
