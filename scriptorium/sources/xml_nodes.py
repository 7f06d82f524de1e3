"""XML parts as rows: one element per row, in document order."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from scriptorium.schema import (
    DOCUMENT_PART,
    PLACES,
    WORD_NS,
    nodes_schema,
)

_SEPARATOR = "\n"


@lru_cache(maxsize=4096)
def _tag(tag: str) -> tuple[str | None, str, bool, tuple[bool, str]]:
    """Namespace and name of a tag, whether it is Word's, and what counts as its kind among its siblings."""
    ns, _, name = tag.rpartition(_SEPARATOR)
    word = ns == WORD_NS
    return ns or None, name, word, (word, name)


@lru_cache(maxsize=4096)
def _attribute(key: str) -> tuple[str, bool]:
    """The label of an attribute and whether it is Word's ``val``."""
    space, _, local = key.rpartition(_SEPARATOR)
    return f"{{{space}}}{local}" if space else local, space == WORD_NS and local == "val"


class _Open:
    """An element that is open, and what its children share once there is one."""

    __slots__ = ("entry", "above", "labels", "owner", "seen", "ancestors", "within")

    def __init__(self, entry: tuple | None, above: tuple, labels: tuple[str, ...], owner: int | None) -> None:
        self.entry, self.above, self.labels, self.owner = entry, above, labels, owner
        #: Kinds of children so far; None before the first child.
        self.seen: set | None = None


class _Reader:
    """Collects the elements of one part as columns."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        #: The pieces of each element's own text; the empty tuple where there is none.
        self.texts: list[Sequence[str]] = []
        top = _Open(None, (), (), None)
        top.seen, top.ancestors, top.within = set(), (), ""
        self.open: list[_Open] = [top]
        self.paragraphs = 0

    def start(self, tag: str, pairs: list[str]) -> None:
        ns, name, word, kind = _tag(tag)
        attrs, value = [], None
        for key, content in zip(pairs[::2], pairs[1::2]):
            label, is_value = _attribute(key)
            attrs.append((label, content))
            if word and is_value:
                value = content
        number = len(self.rows)
        parent = self.open[-1]
        seen = parent.seen
        if seen is None:
            seen = parent.seen = set()
            parent.ancestors = (*parent.above, parent.entry)
            parent.within = "/".join(parent.labels)
        first = kind not in seen
        if first:
            seen.add(kind)
        owner = parent.owner
        if word and name == "p":
            owner = self.paragraphs
            self.paragraphs += 1
        ancestors = parent.ancestors
        self.rows.append(
            (
                number, ancestors[-1][0] if ancestors else None, len(ancestors), ns, name, word, first, owner, value,
                attrs, ancestors, parent.within,
            )
        )
        label = (name if word else "?") + ("*" if first else "")
        self.texts.append(())
        self.open.append(_Open((number, name, word, first), ancestors, (*parent.labels[-2:], label), owner))

    def end(self, _tag: str) -> None:
        self.open.pop()

    def data(self, content: str) -> None:
        entry = self.open[-1].entry
        if entry is not None:
            pieces = self.texts[entry[0]]
            if pieces:
                pieces.append(content)
            else:
                self.texts[entry[0]] = [content]

    def doctype(self, *_: object) -> None:
        raise ValueError("a DOCTYPE is refused")


#: A start tag and its prefix; a bound of an attribute's value may be in it, and ``>`` in the value.
_TAG = re.compile(rb"""<(?:([^\s:/>]++):)?+(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>""")


class _PlacedReader(_Reader):
    """Also notes where elements lie in the part's bytes."""

    def __init__(self, data: bytes, parser: expat.XMLParserType, skipped: int) -> None:
        super().__init__()
        self.bytes, self.parser, self.skipped = data, parser, skipped
        #: Of each element: first byte, first after the start tag, first of the end tag, first after all; prefix.
        self.places: list[list] = []

    def start(self, tag: str, pairs: list[str]) -> None:
        super().start(tag, pairs)
        begin = self.parser.CurrentByteIndex
        opening = _TAG.match(self.bytes, begin)
        inner = opening.end()
        prefix = (opening[1] or b"").decode()
        self.places.append([begin + self.skipped, inner + self.skipped, None, inner + self.skipped, prefix])

    def end(self, tag: str) -> None:
        place = self.places[self.open[-1].entry[0]]
        super().end(tag)
        if self.bytes[place[1] - self.skipped - 2] != ord("/"):
            close = self.parser.CurrentByteIndex
            place[2], place[3] = close + self.skipped, self.bytes.index(b">", close) + 1 + self.skipped


def parse_part(part: str, data: bytes, placed: bool = False) -> _Reader:
    """Read one part; a ValueError tells why it is refused."""
    try:
        text = data.decode("utf-8").removeprefix("\ufeff")
    except UnicodeDecodeError as error:
        raise ValueError("not UTF-8") from error
    parser = expat.ParserCreate("utf-8", _SEPARATOR)
    plain = text.encode("utf-8")
    reader = _PlacedReader(plain, parser, len(data) - len(plain)) if placed else _Reader()
    parser.ordered_attributes = True
    parser.buffer_text = True
    parser.StartElementHandler = reader.start
    parser.EndElementHandler = reader.end
    parser.CharacterDataHandler = reader.data
    parser.StartDoctypeDeclHandler = reader.doctype
    try:
        parser.Parse(plain, True)
    except expat.ExpatError as error:
        raise ValueError(f"not well-formed: {error}") from error
    if part == DOCUMENT_PART:
        if (reader.rows[0][4], reader.rows[0][5]) != ("document", True):
            raise ValueError("the root is no document")
        bodies = [row for row in reader.rows if row[4] == "body" and row[5]]
        if len(bodies) != 1:
            raise ValueError("more than one body" if bodies else "no body")
        if bodies[0][1] != 0:
            raise ValueError("invalid document structure")
    return reader


class _Refused:
    """A part that is not read, as one row with a reason."""

    texts: tuple = ([],)
    places: tuple = ((None,) * 5,)

    def __init__(self, reason: str) -> None:
        self.reason = reason
        self.rows = [(None,) * 9 + ((), (), None)]


def _batch(items: list[tuple[object, str, _Reader | _Refused]], schema: pa.Schema) -> pa.RecordBatch:
    """The elements of some parts in Arrow form; nested columns are built from flat ones."""
    flat = list(zip(*(row for _, _, reader in items for row in reader.rows)))

    def repeated(values: list) -> list:
        return [v for v, item in zip(values, items) for _ in item[2].rows]

    def offsets(lists: tuple) -> pa.Array:
        ends = [0]
        for entries in lists:
            ends.append(ends[-1] + len(entries))
        return pa.array(ends, pa.int32())

    attributes = [pair for row in flat[9] for pair in row]
    ancestors = list(zip(*(entry for row in flat[10] for entry in row))) or [()] * 4
    struct = schema.field("ancestors").type.value_type
    nested = pa.StructArray.from_arrays(
        [pa.array(column, field.type) for column, field in zip(ancestors, struct)], fields=list(struct)
    )
    columns = {
        "doc_id": repeated([item[0] for item in items]),
        "part": repeated([item[1] for item in items]),
        "node_id": flat[0],
        "parent_id": flat[1],
        "depth": flat[2],
        "ns": flat[3],
        "name": flat[4],
        "is_word": flat[5],
        "first": flat[6],
        "para": flat[7],
        "text": ["".join(pieces) for _, _, reader in items for pieces in reader.texts],
        "val": flat[8],
        "within": flat[11],
        "reason": repeated([getattr(item[2], "reason", None) for item in items]),
    }
    if "start" in schema.names:
        columns |= dict(zip(PLACES, zip(*(place for _, _, reader in items for place in reader.places))))
    arrays = []
    for field in schema:
        if field.name == "attrs":
            keys = pa.array([k for k, _ in attributes], pa.string())
            values = pa.array([v for _, v in attributes], pa.string())
            arrays.append(pa.MapArray.from_arrays(offsets(flat[9]), keys, values).cast(field.type))
        elif field.name == "ancestors":
            arrays.append(pa.ListArray.from_arrays(offsets(flat[10]), nested, type=field.type))
        else:
            arrays.append(pa.array(columns[field.name], field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


#: Elements sent to the JVM together. Small parts share a batch, a large one fills its own.
_BATCH = 8_000


def parse_parts(parts: DataFrame, places: bool = False) -> DataFrame:
    """Element rows of every given part, or one row with a ``reason`` per refused part.

    With ``places`` the rows tell where elements lie in their part's bytes.
    """
    doc_type = parts.schema["doc_id"].dataType
    spark_schema = nodes_schema(doc_type, places)
    schema = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[object, str, _Reader | _Refused]] = []
        size = 0
        for batch in batches:
            # Cell by cell: the bytes of one part are copied at a time, not those of all rows sent together.
            for doc_id, part, data in zip(*(batch.column(i) for i in range(3))):
                doc_id, part = doc_id.as_py(), part.as_py()
                try:
                    reader: _Reader | _Refused = parse_part(part, data.as_py(), places)
                except ValueError as error:
                    reader = _Refused(str(error))
                held.append((doc_id, part, reader))
                size += len(reader.rows)
                if size >= _BATCH:
                    yield _batch(held, schema)
                    held, size = [], 0
        if held:
            yield _batch(held, schema)

    return parts.select("doc_id", "part", "bytes").mapInArrow(run, spark_schema)


def ingest_nodes(parts: DataFrame, names: list[str] | None = None, places: bool = False) -> DataFrame:
    """The XML parts of packages as element rows.

    Binary parts are never parsed. ``names`` narrows the parts (regular expressions), so a
    job that needs only the body does not parse the rest.
    """
    xml = F.col("part").rlike(r"(?i)\.(xml|rels)$")
    if names is not None:
        xml = xml & F.col("part").rlike("^(" + "|".join(names) + ")$")
    return parse_parts(parts.where(xml), places)


def accepted(nodes: DataFrame) -> DataFrame:
    return nodes.where("reason is null").drop("reason")


def refused(nodes: DataFrame) -> DataFrame:
    return nodes.where("reason is not null").select("doc_id", "part", "reason")
