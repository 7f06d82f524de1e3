"""Packages (zip archives of XML parts) as tables of parts."""

from __future__ import annotations

import functools
import io
import os
import re
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scriptorium.lineage import stored
from scriptorium.schema import (
    CONTENT_TYPES_NS,
    CONTENT_TYPES_PART,
    DOCUMENT_PART,
    parts_schema,
)

# File extensions of documents, and those of them that are packages.
DOCUMENT_EXTENSIONS = ("docx", "docm", "doc", "dotx", "dotm", "rtf")
PACKAGE_EXTENSIONS = ("docx", "docm", "dotx", "dotm")


class Packages(NamedTuple):
    parts: DataFrame
    rejects: DataFrame


def _unzip(content: bytes, names: frozenset[str] | None, with_bytes: bool) -> Iterator[tuple[int, str, int, bytes | None]]:
    """Place, name, size and bytes of the files of one archive; a ValueError tells why it is refused.

    Only the files in ``names``, if given, are unzipped, and none without ``with_bytes``.
    """
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        entries = [entry for entry in archive.infolist() if not entry.is_dir()]
        listed = {entry.filename for entry in archive.infolist()}
        if len(listed) < len(archive.infolist()):
            raise ValueError("two entries of one name")
        if DOCUMENT_PART not in listed:
            raise ValueError(f"no {DOCUMENT_PART} in the package")
        for place, entry in enumerate(entries):
            if names is None or entry.filename in names:
                yield place, entry.filename, entry.file_size, archive.read(entry) if with_bytes else None
    except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError, OSError) as error:
        raise ValueError("not a readable archive") from error


#: Unzipped bytes and parts sent to the JVM together; one package may exceed them.
_BATCH = 2 * 1024 * 1024
_PARTS = 4096


def opened(files: DataFrame, names: Sequence[str] | None = None, with_bytes: bool = True) -> DataFrame:
    """``files(doc_id, content)`` as parts and, with a ``reason``, refused packages, in one table.

    Narrow: each package is unzipped where it was read, and only the parts in ``names`` if given.
    Without ``with_bytes`` names and declared sizes are listed and nothing is unzipped. Packages
    of any size are read.
    """
    chosen = None if names is None else frozenset(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows: list[tuple]) -> pd.DataFrame:
            columns = ["doc_id", "ord", "part", "size", "bytes", "reason"]
            return pd.DataFrame(rows, columns=columns).astype({"ord": "Int32", "size": "Int32"})

        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for doc_id, content in zip(batch["doc_id"], batch["content"]):
                try:
                    found = [(doc_id, *entry, None) for entry in _unzip(content, chosen, with_bytes)]
                except ValueError as error:
                    found = [(doc_id, None, None, None, None, str(error))]
                rows += found
                held += sum(len(row[4] or b"") for row in found)
                if held >= _BATCH or len(rows) >= _PARTS:
                    yield frame(rows)
                    rows, held = [], 0
        if rows:
            yield frame(rows)

    return files.select("doc_id", "content").mapInPandas(run, parts_schema(files.schema["doc_id"].dataType))


def open_packages(files: DataFrame, names: Sequence[str] | None = None, with_bytes: bool = True) -> Packages:
    """``opened``, parts and refused packages apart.

    Whoever needs both should store what ``opened`` gives once.
    """
    both = opened(files, names, with_bytes)
    return Packages(
        both.where("reason is null").drop("reason"),
        both.where("reason is not null").select("doc_id", "reason"),
    )


def package_glob(extensions: Sequence[str] = PACKAGE_EXTENSIONS) -> str:
    """A file name pattern for extensions in any case."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in extensions) + "}"


#: Splits of a scan of files read by one task where there are many. Spark counts the opening of a file as 4 MB, so a
#: split of small ones holds 32, which take less time than starting a task.
_SPLITS = 32


def gathered(files: DataFrame) -> DataFrame:
    """The same rows in fewer tasks where a scan has far more splits than cores. Narrow: no shuffle."""
    splits = files.rdd.getNumPartitions()
    fewest = 8 * files.sparkSession.sparkContext.defaultParallelism
    return files.coalesce(max(splits // _SPLITS, fewest)) if splits > fewest else files


def scan_packages(spark: SparkSession, path: str, names: Sequence[str] | None = None, with_bytes: bool = True) -> Packages:
    """All packages below ``path``; ``doc_id`` is the file's path.

    The listing passes over files with other names, so they are never read. Other document
    formats (``doc``, ``rtf``) are refused by their name. Folders of local or Hadoop files are listed by
    tasks, so that the driver holds no list of files; patterns and other stores are listed by Spark.
    """
    listed = _listed(spark, path)
    if listed is None:

        def listing(extensions: Sequence[str]) -> DataFrame:
            reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            return reader.option("pathGlobFilter", package_glob(extensions)).load(path).withColumnRenamed("path", "doc_id")

        files = gathered(listing(PACKAGE_EXTENSIONS).select("doc_id", "content"))
        others = listing([e for e in DOCUMENT_EXTENSIONS if e not in PACKAGE_EXTENSIONS])
    else:
        files, others = _contents(listed.files.where("package"), listed.store), listed.files.where("NOT package")
    found = open_packages(files, names, with_bytes)
    other = others.select("doc_id", F.lit("a document, but not a package").alias("reason"))
    return Packages(found.parts, found.rejects.unionByName(other))


#: Characters that make a path a pattern.
_PATTERN = re.compile(r"[\[\]{}*?\\]")
#: Names told in one batch, and files that one task reads, about.
_NAMES, _FILES = 8192, 1024


def _system(store: str) -> pafs.FileSystem:
    """The file system of a store, in which paths are those of its URIs: local files, or ``hdfs://server``."""
    return pafs.LocalFileSystem() if store == "file:" else pafs.FileSystem.from_uri(f"{store}/")[0]


def _entries(system: pafs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """What lies in a folder, and whether it is a folder. A local one is not held as a list."""
    if isinstance(system, pafs.LocalFileSystem):
        with os.scandir(folder) as found:
            yield from ((f"{folder}/{entry.name}", entry.is_dir()) for entry in found)
    else:
        for info in system.get_file_info(pafs.FileSelector(folder)):
            yield info.path, info.type == pafs.FileType.Directory


def _hidden(name: str) -> bool:
    """Names that Spark passes over too."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


class _Listed(NamedTuple):
    """``files(doc_id, file, package)`` and the store they are in."""

    files: DataFrame
    store: str


def _listed(spark: SparkSession, path: str) -> _Listed | None:
    """All documents below a folder, stored; None if Spark has to list it.

    Level by level: each round's folders are listed by tasks, a folder by one.
    """
    if _PATTERN.search(path):
        return None
    qualified = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = qualified.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(qualified).toUri()
    if uri.getScheme() not in ("file", "hdfs"):
        return None
    store, root = f"{uri.getScheme()}://{uri.getAuthority()}" if uri.getAuthority() else f"{uri.getScheme()}:", uri.getPath()
    try:
        if _system(store).get_file_info(root).type != pafs.FileType.Directory:
            return None
    except (pa.ArrowException, OSError):
        return None
    kinds = {"." + e: e in PACKAGE_EXTENSIONS for e in DOCUMENT_EXTENSIONS}
    schema = to_arrow_schema(T._parse_datatype_string("doc_id string, file string, package boolean"))

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = _system(store)
        for folder in (f for batch in batches for f in batch.column(0).to_pylist()):
            rows = []
            for entry, is_folder in _entries(system, folder):
                name = entry.rsplit("/", 1)[-1]
                kind = None if is_folder else kinds.get(os.path.splitext("x" + name)[1].lower())
                if not _hidden(name) and (is_folder or kind is not None):
                    rows.append((None if is_folder else store + entry, entry, kind))
                if len(rows) == _NAMES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    folders, levels = spark.createDataFrame([(root,)], "file string"), []
    while not folders.isEmpty():
        cores = spark.sparkContext.defaultParallelism
        levels.append(stored(folders.select("file").repartition(cores).mapInArrow(below, "doc_id string, file string, package boolean")))
        folders = levels[-1].where("package IS NULL")
    return _Listed(functools.reduce(DataFrame.unionByName, levels).where("package IS NOT NULL"), store)


def _contents(listed: DataFrame, store: str) -> DataFrame:
    """``(doc_id, content)`` of listed files, read by tasks of about so many files each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = _system(store)
        for batch in batches:
            held, size, begin = [], 0, 0
            for number, file in enumerate(batch.column(1).to_pylist(), 1):
                with system.open_input_stream(file) as stream:
                    held.append(stream.read())
                size += len(held[-1])
                if size >= _BATCH or number == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(held)), pa.array(held, pa.binary())], names=["doc_id", "content"])
                    held, size, begin = [], 0, number

    cores = listed.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, listed.count() // _FILES)
    return listed.select("doc_id", "file").repartition(tasks).mapInArrow(read, "doc_id string, content binary")


def content_types(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The content type of every part: its override, else the default of its extension.

    ``nodes`` must include the content-types part. Names compare without letter case.
    """
    typed = nodes.where(
        (F.col("part") == CONTENT_TYPES_PART) & (F.col("ns") == CONTENT_TYPES_NS)
    )

    def lookup(element: str, attribute: str, key: str, value: str) -> DataFrame:
        named = typed.where((F.col("name") == element) & F.col("attrs")[attribute].isNotNull())
        return named.groupBy("doc_id", F.lower(F.col("attrs")[attribute]).alias(key)).agg(
            F.min_by(F.col("attrs")["ContentType"], "node_id").alias(value)
        )

    overrides = lookup("Override", "PartName", "_name", "_override")
    defaults = lookup("Default", "Extension", "_extension", "_default")
    named = parts.select("doc_id", "ord", "part", "size").withColumns(
        {
            "_name": F.lower(F.concat(F.lit("/"), "part")),
            "_extension": F.lower(F.regexp_extract("part", r"(?s)\.([^.]*)\z", 1)),
        }
    )
    return (
        named.join(overrides, ["doc_id", "_name"], "left")
        .join(defaults, ["doc_id", "_extension"], "left")
        .select(
            "doc_id", "ord", "part", "size", F.coalesce("_override", "_default").alias("content_type")
        )
    )


def list_parts(parts: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Part names and sizes, with content types when parsed parts are given."""
    if nodes is not None:
        return content_types(parts, nodes)
    return parts.select("doc_id", "ord", "part", "size")


def part_text(parts: DataFrame, name: str) -> DataFrame:
    """The whole text of one part of every package.

    A missing or binary part has a ``reason`` instead of a text. One pass over the parts, added
    up by document: names alone decide which documents lack it.
    """
    wanted = name.lstrip("/")
    if not wanted:
        raise ValueError("a part name is needed")
    here = F.col("part") == wanted
    raw = F.when(here, F.col("bytes"))
    body = F.when(F.hex(F.substring(raw, 1, 3)) == "EFBBBF", F.substring(raw, F.lit(4), F.octet_length(raw))).otherwise(raw)
    is_text = F.is_valid_utf8(body.cast("string")) & ~body.cast("string").contains("\0")
    return (
        parts.select(
            "doc_id",
            F.when(here, F.col("size")).alias("size"),
            F.when(is_text, body.cast("string")).alias("text"),
            F.when(here & ~is_text, "not text").when(here, "").alias("reason"),
        )
        .groupBy("doc_id")
        .agg(F.max("size").alias("size"), F.max("text").alias("text"), F.max("reason").alias("reason"))
        .select(
            "doc_id",
            "size",
            "text",
            F.when(F.col("reason") != "", F.col("reason")).when(F.col("reason").isNull(), "no such part").alias("reason"),
        )
    )
