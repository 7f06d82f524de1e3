"""Logical HTML previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.operators.carry import CHUNK, assemble
from scriptorium.schema import check

# What surrounds the paragraphs of a preview.
HEAD = (
    '<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Document preview</title>'
    "<style>body{max-width:52rem;margin:2rem auto;font-family:system-ui}p{white-space:pre-wrap}"
    "</style></head><body>"
)
TAIL = "</body></html>"


def html_preview(paragraphs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Escaped HTML, one ``<p>`` per paragraph, in ordered pieces.

    The head opens piece 0 and the tail closes the last piece; a document of up to
    ``chunk`` paragraphs is one piece.
    """
    lines = F.replace(X.markup_escape(F.col("text")), F.lit("\n"), F.lit("<br>"))
    shown = F.concat(F.lit("<p>"), lines, F.lit("</p>"))
    pieces = assemble(paragraphs, ["doc_id"], "idx", shown, "\n", "html", chunk)
    last = pieces.groupBy("doc_id").agg(F.max("piece").alias("_last"))
    head = F.when(F.col("piece") == 0, F.lit(HEAD)).otherwise("")
    tail = F.when(F.col("piece") == F.col("_last"), F.lit(TAIL)).otherwise("")
    return pieces.join(last, "doc_id").select(
        "doc_id", "piece", F.concat(head, "html", tail).alias("html")
    )


def write_previews(paragraphs: DataFrame, directory: str, overwrite: bool = False) -> None:
    """Write previews as text, one folder per document and piece."""
    check(not directory.lower().endswith((".docx", ".docm")), "a preview needs a folder, not a package")
    mode = "overwrite" if overwrite else "errorifexists"
    previews = html_preview(paragraphs).select(F.col("html").alias("value"), "doc_id", "piece")
    previews.write.mode(mode).partitionBy("doc_id", "piece").text(directory)
