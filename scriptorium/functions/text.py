"""Text functions as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as part of a word, as a regex class body.
WORD_CLASS = r"\p{IsAlphabetic}\p{N}_"
# The characters Markdown escapes, and those XML and HTML escape.
MARKDOWN_SPECIALS = "\\*_`[]"
MARKUP_ENTITIES = (
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ("'", "&apos;"),
    ('"', "&quot;"),
)
# A Unicode noncharacter: stands in for one letter while the text is lower-cased.
_STAND_IN = "\ufdd0"


def fold(text: Column) -> Column:
    """Lower-case character by character, so offsets stay those of the original.

    A character whose lower form is longer (dotted capital I) is kept, and capital sigma
    does not depend on its position.
    """
    lowered = F.lower(F.translate(text, "İΣ", _STAND_IN + "σ"))
    return F.translate(lowered, _STAND_IN, "İ")


def fold_literal(text: str) -> str:
    """The same folding for a search text known when the plan is built."""
    return "".join(low if len(low := c.lower()) == 1 else c for c in text)


def quoted(literal: str) -> str:
    """A regular expression matching ``literal``."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def whole_word(pattern: str) -> str:
    """``pattern`` with no word character right before or after."""
    return f"(?<![{WORD_CLASS}])(?:{pattern})(?![{WORD_CLASS}])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, inside a higher-order function."""
    return F.transform(F.array(value), body)[0]


#: Values summed one by one, and characters of a piece that a text is cut into for slices.
BLOCK, PIECE = 256, 1024


def _running(numbers: Column, base: Column) -> Column:
    start = F.struct(base.cast("int").alias("total"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(
        numbers,
        start,
        lambda a, x: F.struct((a.total + x).cast("int").alias("total"), F.concat(a.out, F.array(a.total)).alias("out")),
        lambda a: a.out,
    )


def sums_before(values: Column) -> Column:
    """For each of an array of integers the sum of those before it.

    An array that grows is copied at every step, so the sums run over blocks of bounded size.
    """

    def spread(numbers: Column) -> Column:
        count = F.size(numbers)
        starts = F.when(count > 0, F.sequence(F.lit(1), count, F.lit(BLOCK))).otherwise(
            F.array().cast("array<int>")
        )
        totals = F.transform(
            starts, lambda s: F.aggregate(F.slice(numbers, s, BLOCK), F.lit(0), lambda a, x: a + x)
        )
        return let(
            _running(totals, F.lit(0)),
            lambda bases: F.flatten(
                F.transform(starts, lambda s, i: _running(F.slice(numbers, s, BLOCK), F.get(bases, i)))
            ),
        )

    return let(values, spread)


def pieces(text: Column) -> Column:
    """A text cut into pieces of ``PIECE`` characters, for ``between``."""
    return F.transform(
        F.sequence(F.lit(0), F.length(text), F.lit(PIECE)), lambda at: F.substring(text, at + 1, F.lit(PIECE))
    )


def between(cut: Column, start: Column, length: Column) -> Column:
    """``length`` characters from ``start`` on of a text cut into ``pieces``.

    Characters are counted from the start of a piece, not of the text.
    """
    first = F.floor(start / PIECE).cast("int")
    count = (F.floor(length / PIECE) + 2).cast("int")
    held = F.array_join(F.slice(cut, first + 1, count), "")
    return F.substring(held, start - first * PIECE + 1, length)


def matches(
    text: Column,
    pattern: str,
    hay: Column | None = None,
    limit: int | None = None,
    context: int = 0,
    units: bool = False,
) -> Column:
    """The non-overlapping matches of a regular expression, left to right.

    An array of ``(offset, text, before, after)``, and with ``units`` of ``unit`` and
    ``unit_length`` in UTF-16. The pattern is matched in ``hay``, a text with the characters of
    ``text`` one by one in another form. Time is in proportion to the text and its matches.
    """
    hay = text if hay is None else hay

    def found(cut: Column) -> Column:
        hits = cut["hits"] if limit is None else F.slice(cut["hits"], 1, limit)
        gaps = F.slice(cut["gaps"], F.lit(1), F.size(hits))

        def starts(measure: Callable[[Column], Column]) -> Column:
            before_ = sums_before(F.zip_with(gaps, hits, lambda g, h: measure(g) + measure(h)))
            return F.zip_with(before_, gaps, lambda s, g: s + measure(g))

        columns = [hits.alias("h"), starts(F.length).alias("o")]
        columns += [starts(utf16_length).alias("u")] if units else []

        def row(cell: Column, parts: Column) -> Column:
            offset, length = cell["o"], F.length(cell["h"])
            first = F.greatest(offset - context, F.lit(0))
            fields = [offset.alias("offset"), between(parts, offset, length).alias("text")]
            if units:
                fields += [cell["u"].alias("unit"), utf16_length(cell["h"]).alias("unit_length")]
            if context:
                fields += [
                    between(parts, first, offset - first).alias("before"),
                    between(parts, offset + length, F.lit(context)).alias("after"),
                ]
            else:
                fields += [F.lit("").alias("before"), F.lit("").alias("after")]
            return F.struct(*fields)

        cells = F.arrays_zip(*columns)
        return let(pieces(text), lambda parts: let(cells, lambda c: F.transform(c, lambda cell: row(cell, parts))))

    cut = F.struct(
        F.split(hay, pattern, -1).alias("gaps"),
        F.regexp_extract_all(hay, F.lit(pattern), F.lit(0)).alias("hits"),
    )
    return let(cut, found)


def literal_pattern(needle: str, match_case: bool = True, whole: bool = False) -> str:
    wanted = needle if match_case else fold_literal(needle)
    return whole_word(quoted(wanted)) if whole else quoted(wanted)


def literal_matches(
    text: Column, needle: str, match_case: bool = True, whole: bool = False, limit: int | None = None,
    context: int = 0, units: bool = False,
) -> Column:
    """``matches`` of a literal."""
    hay = text if match_case else fold(text)
    return matches(text, literal_pattern(needle, match_case, whole), hay, limit, context, units)


def literal_offsets(
    text: Column,
    needle: str,
    match_case: bool = True,
    whole: bool = False,
    limit: int | None = None,
) -> Column:
    """Character offsets of the non-overlapping matches of ``needle``, left to right."""
    return F.transform(literal_matches(text, needle, match_case, whole, limit), lambda m: m["offset"])


def pattern_spans(text: Column, pattern: str) -> Column:
    """Offset and text of each non-overlapping match of a regular expression that never matches nothing.

    The matches are the texts themselves, so none is cut from ``text`` again.
    """

    def found(cut: Column) -> Column:
        hits, gaps = cut["hits"], F.slice(cut["gaps"], F.lit(1), F.size(cut["hits"]))
        before_ = sums_before(F.zip_with(gaps, hits, lambda g, h: F.length(g) + F.length(h)))
        offsets = F.zip_with(before_, gaps, lambda s, g: s + F.length(g))
        return F.zip_with(offsets, hits, lambda o, h: F.struct(o.alias("offset"), h.alias("text")))

    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(F.struct(gaps.alias("gaps"), hits.alias("hits")), found)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units; plain ASCII skips the transcoding."""
    chars = F.length(text)
    return F.when(F.octet_length(text) == chars, chars).otherwise(
        (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")
    )


def utf16_slice(text: Column, start: Column, end: Column) -> Column:
    """Units ``[start, end)`` of ``text``; a cut inside a surrogate pair keeps the pair."""
    start = F.greatest(start, F.lit(0))
    units = F.encode(text, "UTF-16BE")

    def inside_pair(unit: Column) -> Column:
        return F.hex(F.substring(units, unit * 2 + 1, F.lit(1))).between("DC", "DF")

    first = F.when(inside_pair(start), start - 1).otherwise(start)
    stop = F.when(inside_pair(end), end + 1).otherwise(end)
    wide = F.decode(F.substring(units, first * 2 + 1, (stop - first) * 2), "UTF-16BE")
    plain = F.substring(text, start + 1, end - start)
    return (
        F.when(end <= start, F.lit(""))
        .when(F.octet_length(text) == F.length(text), plain)
        .otherwise(wide)
    )


def before(text: Column, offset: Column, count: int) -> Column:
    """Up to ``count`` characters right before ``offset``."""
    first = F.greatest(offset - count, F.lit(0))
    return F.substring(text, first + 1, offset - first)


def after(text: Column, end: Column, count: int) -> Column:
    """Up to ``count`` characters from ``end`` on."""
    return F.substring(text, end + 1, F.lit(count))


def trim_space(text: Column) -> Column:
    """Remove Unicode white space from both ends."""
    return trim_end(trim_start(text))


def trim_start(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+", "")


def trim_end(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+\z", "")


def is_blank(text: Column) -> Column:
    """Empty or only white space."""
    return ~text.rlike(r"(?U)\S")


def md_escape(text: Column, in_table: bool = False) -> Column:
    """A backslash before every character Markdown would interpret."""
    specials = MARKDOWN_SPECIALS + ("|" if in_table else "")
    body = "".join("\\" + c for c in specials)
    return F.regexp_replace(text, f"([{body}])", r"\\$1")


def emphasize(text: Column, bold: Column, italic: Column) -> Column:
    """Emphasis markers around the non-blank core; white space stays outside."""
    marker = (
        F.when(bold & italic, F.lit("***"))
        .when(bold, F.lit("**"))
        .when(italic, F.lit("*"))
        .otherwise(F.lit(""))
    )
    core = trim_space(text)
    lead = F.regexp_extract(text, r"(?U)\A(\s*)", 1)
    tail = F.regexp_extract(text, r"(?U)(\s*)\z", 1)
    return F.when((marker == "") | (core == ""), text).otherwise(
        F.concat(lead, marker, core, marker, tail)
    )


def markup_escape(text: Column) -> Column:
    """Escape text for XML or HTML content and attribute values."""
    for char, entity in MARKUP_ENTITIES:
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def valid_xml_text(text: Column) -> Column:
    """Whether XML 1.0 can represent the text."""
    return ~text.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{FFFE}\\x{FFFF}]")


def concat_items(items: Column, field: str) -> Column:
    """The concatenation of one string field of an ordered array of structs."""
    return F.array_join(items[field], "")
