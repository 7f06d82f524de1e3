"""Tables of texts, web pages and conversations as paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entities the page reader decodes; the ampersand comes last.
PAGE_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))
# The page elements read as paragraphs, and the style each one gets.
PAGE_STYLES = {"h1": "Heading1", "p": "Normal", "li": "ListBullet"}
_MARK = "\x01"


def text_paragraphs(table: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One paragraph per line of each text; a null text is one empty line. Narrow: no shuffle."""
    return table.select(
        F.col(doc_id).alias("doc_id"),
        F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("idx", "text"),
    )


def turn_paragraphs(
    table: DataFrame, doc_id: str = "conv_id", order: str = "turn", text: str = "text"
) -> DataFrame:
    """One paragraph per turn; line ends inside a turn are manual line breaks."""
    return table.select(
        F.col(doc_id).alias("doc_id"), F.col(order).cast("int").alias("idx"), F.col(text)
    )


def _decode(text: Column) -> Column:
    for entity, char in PAGE_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def page_blocks(table: DataFrame, doc_id: str = "page_id", html: str = "html") -> DataFrame:
    """The headings, paragraphs and list items of each page, with their inner markup.

    A block ends at its closing tag or where the next block begins, because pages leave
    tags open. Narrow: one page is one row.
    """
    tags = "|".join(PAGE_STYLES)
    marked = F.regexp_replace(F.col(html), f"<({tags})([ >])", f"{_MARK}$1$2")
    blocks = F.slice(F.split(marked, _MARK, -1), F.lit(2), F.lit(2**31 - 1))
    block = F.col("_block")
    return table.select(
        F.col(doc_id).alias("doc_id"), F.posexplode(blocks).alias("idx", "_block")
    ).select(
        "doc_id",
        "idx",
        F.regexp_extract(block, f"^({tags})", 1).alias("tag"),
        F.split(F.regexp_replace(block, "^[^>]*>", ""), f"</(?:{tags}|ul|nav|article)>", 2)[
            0
        ].alias("inner"),
    )


def page_paragraphs(table: DataFrame, doc_id: str = "page_id", html: str = "html") -> DataFrame:
    """Page blocks as styled paragraphs: tags dropped, breaks kept, entities decoded."""
    broken = F.regexp_replace("inner", "<br */?>", "\n")
    plain = _decode(F.regexp_replace(broken, "<[^>]*>", ""))
    styles = F.create_map(*[F.lit(v) for pair in PAGE_STYLES.items() for v in pair])
    return page_blocks(table, doc_id, html).select(
        "doc_id", "idx", plain.alias("text"), styles[F.col("tag")].alias("style"), "tag"
    )


def page_runs(table: DataFrame, doc_id: str = "page_id", html: str = "html") -> DataFrame:
    """Runs of each page block: bold spans and links split the text."""
    pieces = F.split(F.regexp_replace("inner", "<(/?(?:b|a)[ >])", f"{_MARK}$1"), _MARK, -1)
    piece = F.col("_piece")
    # The tag that opens the piece decides bold and link; pages never nest the two.
    text = F.when(F.col("run") == 0, piece).otherwise(F.regexp_replace(piece, "^[^>]*>", ""))
    plain = _decode(F.regexp_replace(F.regexp_replace(text, "<br */?>", "\n"), "<[^>]*>", ""))
    opened = F.col("run") > 0
    return (
        page_blocks(table, doc_id, html)
        .select("doc_id", "idx", F.posexplode(pieces).alias("run", "_piece"))
        .select(
            "doc_id",
            "idx",
            "run",
            plain.alias("text"),
            (opened & piece.startswith("b>")).alias("bold"),
            F.lit(False).alias("italic"),
            F.when(
                opened & piece.startswith("a "), F.regexp_extract(piece, '^a href="([^"]*)"', 1)
            ).alias("link"),
        )
        .where("text != ''")
    )
