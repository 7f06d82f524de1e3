"""The document tables and argument checks.

Every table is keyed by ``doc_id``. Operators read only the columns they need, so any
table with those columns will do; ``doc_id`` may have any atomic type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT_PART = "word/document.xml"
CONTENT_TYPES_PART = "[Content_Types].xml"

# Namespaces.
WORD_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
OFFICE_REL_NS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE_REL_NS = "http://schemas.openxmlformats.org/package/2006/relationships"
CONTENT_TYPES_NS = "http://schemas.openxmlformats.org/package/2006/content-types"

# Relationship types and content types.
REL = {
    kind: f"{OFFICE_REL_NS}/{kind}"
    for kind in (
        "officeDocument",
        "styles",
        "numbering",
        "comments",
        "footnotes",
        "endnotes",
        "header",
        "footer",
        "hyperlink",
    )
}
_WORD_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml"
CONTENT_TYPE = {
    "document": f"{_WORD_TYPE}.document.main+xml",
    "styles": f"{_WORD_TYPE}.styles+xml",
    "numbering": f"{_WORD_TYPE}.numbering+xml",
    "comments": f"{_WORD_TYPE}.comments+xml",
    "footnotes": f"{_WORD_TYPE}.footnotes+xml",
    "endnotes": f"{_WORD_TYPE}.endnotes+xml",
    "header": f"{_WORD_TYPE}.header+xml",
    "footer": f"{_WORD_TYPE}.footer+xml",
    "relationships": "application/vnd.openxmlformats-package.relationships+xml",
}
#: Relationship type to story name, for every story besides the body.
STORY_KINDS = {
    REL["header"]: "header",
    REL["footer"]: "footer",
    REL["footnotes"]: "footnote",
    REL["endnotes"]: "endnote",
    REL["comments"]: "comment",
}

ANCESTOR = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("word", T.BooleanType()),
        T.StructField("first", T.BooleanType()),
    ]
)


def parts_schema(doc_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("doc_id", doc_type),
            T.StructField("ord", T.IntegerType()),
            T.StructField("part", T.StringType()),
            T.StructField("size", T.IntegerType()),
            T.StructField("bytes", T.BinaryType()),
            T.StructField("reason", T.StringType()),
        ]
    )


#: Where an element lies in its part's bytes: its first byte, the first after its start tag, the first of its
#: end tag (null for an empty element of one tag) and the first after it; and its prefix.
PLACES = ("start", "inner", "close", "end", "prefix")


def nodes_schema(doc_type: T.DataType, places: bool = False) -> T.StructType:
    """One XML element per row, in document order within (doc_id, part).

    ``first``: first among the equally named children of its parent. ``para``: ordinal of
    the nearest Word paragraph that contains or is the element. ``ancestors``: root first.
    ``within``: the last three ancestors' names joined by slashes, with a star after those
    that are first of their kind and a question mark for other vocabularies. ``PLACES`` are there if
    ``places`` is set.
    """
    placed = [T.StructField(n, T.StringType() if n == "prefix" else T.IntegerType()) for n in PLACES]
    return T.StructType(
        [
            T.StructField("doc_id", doc_type),
            T.StructField("part", T.StringType()),
            T.StructField("node_id", T.IntegerType()),
            T.StructField("parent_id", T.IntegerType()),
            T.StructField("depth", T.IntegerType()),
            T.StructField("ns", T.StringType()),
            T.StructField("name", T.StringType()),
            T.StructField("is_word", T.BooleanType()),
            T.StructField("first", T.BooleanType()),
            T.StructField("para", T.IntegerType()),
            T.StructField("text", T.StringType()),
            T.StructField("val", T.StringType()),
            T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
            T.StructField("ancestors", T.ArrayType(ANCESTOR)),
            T.StructField("within", T.StringType()),
            T.StructField("reason", T.StringType()),
        ]
        + (placed if places else [])
    )


def check(condition: bool, message: str) -> None:
    """Refuse a request before any job runs."""
    if not condition:
        raise ValueError(message)


def check_search(text: str, max_results: int | None, context_chars: int) -> None:
    check(text != "", "there is nothing to search for")
    check(max_results is None or max_results >= 1, "max_results, if given, starts at 1")
    check(context_chars >= 0, "context_chars starts at 0")


def check_page(start: int, limit: int | None, largest: int | None = None) -> None:
    check(start >= 0, "the start is 0 or later")
    check(limit is None or limit >= 1, "a limit, if given, starts at 1")
    if largest is not None:
        check(limit is not None and limit <= largest, f"the limit goes from 1 to {largest}")


def check_positions(start: int, end: int, allow_empty: bool) -> None:
    sign = "<=" if allow_empty else "<"
    check(
        0 <= start and (start < end or (allow_empty and start == end)),
        f"a range needs 0 <= start {sign} end",
    )


def check_size(points: float | None) -> None:
    check(
        points is None or (1 <= points <= 1638 and (points * 2) == int(points * 2)),
        "a font size is 1 to 1638 points in steps of a half",
    )


def with_story(paragraphs: DataFrame) -> DataFrame:
    """Fill in the story columns of a plain text table: everything is body text."""
    columns = set(paragraphs.columns)
    added = {}
    if "story" not in columns:
        added["story"] = F.lit("body")
    if "part" not in columns:
        added["part"] = F.lit(DOCUMENT_PART)
    if "story_ord" not in columns:
        added["story_ord"] = F.lit(0)
    if "note_id" not in columns:
        added["note_id"] = F.lit(None).cast("string")
    return paragraphs.withColumns(added) if added else paragraphs
