"""Bulk edits as table transforms.

Every function takes paragraphs (and runs) and returns an ``Edited``: the new paragraphs,
what was refused, and what was done. A document with a refused edit keeps its old content.
A call carries at most one edit per document, and further ones are refused; ``in_order``
applies any number one after the other. ``guards(doc_id, idx, reason)`` lists paragraphs that must not
be edited.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.lineage import cut
from scriptorium.operators.carry import attach
from scriptorium.operators.positions import positions, ranges_text
from scriptorium.schema import check, check_positions, check_size

# The alignments a request may name.
ALIGNMENTS = ("left", "center", "right", "both")
_OUT_OF_BOUNDS = "no paragraph has this index"
_INVALID = "a character that XML cannot hold"
_TWICE = "one edit per document and batch"


class Edited(NamedTuple):
    paragraphs: DataFrame
    rejects: DataFrame
    audit: DataFrame


def sizes(paragraphs: DataFrame) -> DataFrame:
    """The number of paragraphs of each document."""
    return paragraphs.groupBy("doc_id").agg((F.max("idx") + 1).alias("size"))


def _single(edits: DataFrame, sized: DataFrame) -> DataFrame:
    """One row per edited document, with its size; ``_twice`` marks documents with more edits.

    Such documents are refused whole, so one of their edits stands for all. A partial
    aggregate, so many edits of one document do not meet in one task.
    """
    values = [c for c in edits.columns if c != "doc_id"]
    return (
        edits.groupBy("doc_id")
        .agg(F.min(F.struct(*values)).alias("_edit"), (F.count(F.lit(1)) > 1).alias("_twice"))
        .select("doc_id", "_edit.*", "_twice")
        .join(sized, "doc_id", "left")
        .withColumn("size", F.coalesce("size", F.lit(0)))
    )


def _guarded(edits: DataFrame, guards: DataFrame | None, index: str) -> DataFrame:
    """Add ``_guard``: why the paragraph an edit targets must not be touched."""
    if guards is None:
        return edits.withColumn("_guard", F.lit(None).cast("string"))
    reasons = guards.groupBy("doc_id", F.col("idx").alias(index)).agg(
        F.min("reason").alias("_guard")
    )
    return edits.join(reasons, ["doc_id", index], "left")


def _rejects(decided: DataFrame) -> DataFrame:
    """What was refused; ``_single`` left one row per document."""
    return decided.where("reason is not null").select("doc_id", "reason")


def _accepted(decided: DataFrame) -> DataFrame:
    return decided.where("reason is null")


def in_order(
    paragraphs: DataFrame,
    edits: DataFrame,
    step: Callable[[DataFrame, DataFrame], Edited],
    order: str = "seq",
) -> Edited:
    """Any number of edits per document, each on what the one before left.

    ``edits`` has ``order`` besides the columns of ``step``, a function of this module that takes
    paragraphs and edits. The first edits of all documents are one round, then the second ones,
    and so on; a round touches all documents at once and is stored. A document of which an edit
    is refused keeps its old content. Of edits with the same ``order`` one is refused for all.
    """
    turn = F.row_number().over(W.partitionBy("doc_id").orderBy(order))
    again = F.count(F.lit(1)).over(W.partitionBy("doc_id", order)) > 1
    ranked = cut(edits.withColumn("_turn", turn).withColumn("_same", again))
    same = ranked.where("_same").select("doc_id").distinct()
    rejects = same.select("doc_id", F.lit("two edits with one place in the order").alias("reason"))
    ranked = ranked.join(same, "doc_id", "left_anti")
    turns = ranked.agg(F.max("_turn")).first()[0] or 0
    current, audits = paragraphs, []
    for number in range(1, turns + 1):
        now = ranked.where(F.col("_turn") == number).drop("_turn", "_same", order)
        done = step(current, now)
        rejects = rejects.unionByName(done.rejects)
        audits.append(done.audit.withColumn(order, F.lit(number)))
        current = cut(done.paragraphs)
    rejects = cut(rejects.dropDuplicates(["doc_id"]))
    kept = current.join(rejects, "doc_id", "left_anti")
    restored = paragraphs.join(rejects.select("doc_id"), "doc_id", "left_semi")
    audit = None
    for part in audits:
        audit = part if audit is None else audit.unionByName(part)
    audit = rejects.limit(0) if audit is None else audit.join(rejects, "doc_id", "left_anti")
    return Edited(kept.unionByName(restored, allowMissingColumns=True), rejects, audit)


def replace(
    paragraphs: DataFrame,
    find: str,
    replacement: str,
    all: bool = False,  # noqa: A002 - the request's own name
    paragraph: int | None = None,
    guards: DataFrame | None = None,
) -> Edited:
    """The same literal replacement in every document: all matches, or only the first."""
    check(find != "", "find must not be empty")
    check(paragraph is None or paragraph >= 0, "paragraph must not be negative")
    check(not any(c < " " and c not in "\t\n\r" or c in "\ufffe\uffff" for c in replacement), _INVALID)
    named = paragraphs.withColumns(
        {"_find": F.lit(find), "_with": F.lit(replacement), "_all": F.lit(all)}
    )
    hit = F.col("text").contains(F.lit(find))
    if paragraph is not None:
        hit = hit & (F.col("idx") == paragraph)
    if all and guards is None and paragraph is None:
        # No decision depends on other rows: one narrow projection.
        changed = _replaced(named.withColumn("_hit", hit))
        audit = changed.groupBy("doc_id").agg(F.sum("_n").cast("int").alias("replacements"))
        empty = audit.select("doc_id", F.lit("").alias("reason")).where(F.lit(False))
        return Edited(changed.drop("_n"), empty, audit)
    sized = sizes(paragraphs)
    reason = F.lit(None).cast("string")
    if paragraph is not None:
        reason = F.when(F.col("size") <= paragraph, _OUT_OF_BOUNDS)
    return _replace(named, hit, sized.withColumn("_refused", reason), guards)


def replace_each(
    paragraphs: DataFrame, edits: DataFrame, guards: DataFrame | None = None
) -> Edited:
    """``edits(doc_id, find, replacement, all, paragraph)``: one replacement per document."""
    single = _single(edits, sizes(paragraphs))
    refused = (
        F.when(F.col("_twice"), _TWICE)
        .when(F.col("find") == "", "find must not be empty")
        .when(~X.valid_xml_text(F.col("replacement")), _INVALID)
        .when(F.col("paragraph") >= F.col("size"), _OUT_OF_BOUNDS)
    )
    decided = single.withColumn("_refused", refused)
    usable = decided.where("not _twice").select(
        "doc_id",
        F.col("find").alias("_find"),
        F.col("replacement").alias("_with"),
        F.col("all").alias("_all"),
        F.col("paragraph").alias("_only"),
        "size",
    )
    named = attach(paragraphs, usable, ["doc_id"], "idx", "size", "left").drop("size")
    hit = (
        F.col("text").contains(F.col("_find"))
        & (F.col("_find") != "")
        & (F.col("_only").isNull() | (F.col("_only") == F.col("idx")))
    )
    documents = decided.groupBy("doc_id").agg(
        F.max("size").alias("size"), F.min("_refused").alias("_refused")
    )
    return _replace(named, hit, documents, guards, drop="_only")


def _replace(
    named: DataFrame, hit: Column, documents: DataFrame, guards: DataFrame | None, drop: str = "_x"
) -> Edited:
    named = named.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    hits = named.where("_hit").select("doc_id", "idx", "_all")
    firsts = hits.groupBy("doc_id").agg(F.min("idx").alias("_first"))
    if guards is None:
        blocked = hits.select("doc_id", F.lit("").alias("_blocked")).where(F.lit(False))
    else:
        # Only paragraphs that would change are guarded: all hits, or the first one.
        blocked = (
            guards.join(hits, ["doc_id", "idx"])
            .join(firsts, "doc_id")
            .where(F.col("_all") | (F.col("idx") == F.col("_first")))
            .groupBy("doc_id")
            .agg(F.min("reason").alias("_blocked"))
        )
    decided = (
        documents.join(firsts, "doc_id", "left")
        .join(blocked, "doc_id", "left")
        .withColumn("reason", F.coalesce("_refused", "_blocked"))
        .select("doc_id", "size", "_first", "reason")
    )
    placed = attach(named, decided, ["doc_id"], "idx", "size", "left").drop("size")
    allowed = F.col("reason").isNull() & (F.col("_all") | (F.col("idx") == F.col("_first")))
    changed = _replaced(
        placed.withColumn("_hit", F.col("_hit") & F.coalesce(allowed, F.lit(False)))
    ).drop("_first", "reason", drop)
    audit = changed.groupBy("doc_id").agg(F.sum("_n").cast("int").alias("replacements"))
    return Edited(changed.drop("_n"), _rejects(decided), audit)


def _replaced(marked: DataFrame) -> DataFrame:
    """Rewrite the texts of paragraphs marked ``_hit``; ``_n`` counts replacements."""
    text, find, new = F.col("text"), F.col("_find"), F.col("_with")
    everything = F.replace(text, find, new)
    at = F.position(find, text)
    one = F.concat(
        F.substring(text, F.lit(1), at - 1),
        new,
        F.substring(text, at + F.length(find), F.length(text)),
    )
    removed = F.length(text) - F.length(F.replace(text, find, F.lit("")))
    times = F.when(F.col("_all"), (removed / F.length(find)).cast("int")).otherwise(1)
    return marked.withColumns(
        {
            "text": F.when(~F.col("_hit"), text).when(F.col("_all"), everything).otherwise(one),
            "_n": F.when(F.col("_hit"), times).otherwise(0),
        }
    ).drop("_hit", "_find", "_with", "_all")


def replace_in_runs(
    runs: DataFrame, find: str, replacement: str, all: bool = True  # noqa: A002
) -> DataFrame:
    """Replace literal text across the runs of each paragraph.

    ``runs(doc_id, idx, run, text, ...)``. The replacement takes the format of the run
    where the match starts; other runs lose the matched part. The paragraph is cut at run
    starts, match starts and match ends, and the pieces outside matches are put together
    again per run, so neither long paragraphs nor many matches multiply.
    """
    check(find != "", "find must not be empty")
    # Runs of one paragraph meet in a group; one task has parsed the part that holds it.
    keys = ["doc_id", "idx"]
    ordered = W.partitionBy(*keys).orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    placed = runs.withColumn(
        "_low", F.coalesce(F.sum(F.length("text")).over(ordered), F.lit(0)).cast("int")
    )
    whole = placed.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("run", "text")))["text"], "").alias("_t")
    )
    limit = None if all else 1
    matches = whole.where(F.col("_t").contains(find)).select(
        *keys, F.explode(X.literal_offsets(F.col("_t"), find, limit=limit)).alias("_at")
    )
    if not all:
        first = matches.groupBy("doc_id").agg(F.min(F.struct("idx", "_at")).alias("_m"))
        matches = first.select("doc_id", "_m.idx", "_m._at")
    # At one place a match end comes first, then a run start, then a match start.
    nothing = {"run": F.lit(None).cast("int"), "text": F.lit(None).cast("string"), "_low": F.lit(None).cast("int")}
    starts = placed.select(*keys, "run", "text", "_low", F.col("_low").alias("_pos"), F.lit(1).alias("_kind"))
    opens = matches.select(*keys, F.col("_at").alias("_pos"), F.lit(2).alias("_kind")).withColumns(nothing)
    closes = matches.select(
        *keys, (F.col("_at") + len(find)).alias("_pos"), F.lit(0).alias("_kind")
    ).withColumns(nothing)
    events = starts.unionByName(opens).unionByName(closes)
    sweep = W.partitionBy(*keys).orderBy("_pos", "_kind", "run")
    so_far = sweep.rowsBetween(W.unboundedPreceding, W.currentRow)
    kind = F.col("_kind")
    swept = events.select(
        *keys,
        "_pos",
        "_kind",
        F.last("run", ignorenulls=True).over(so_far).alias("run"),
        F.last("text", ignorenulls=True).over(so_far).alias("_source"),
        F.last("_low", ignorenulls=True).over(so_far).alias("_from"),
        F.lead("_pos").over(sweep).alias("_next"),
        F.sum(F.when(kind == 2, 1).when(kind == 0, -1).otherwise(0)).over(so_far).alias("_inside"),
    )
    begin = F.col("_pos") - F.col("_from")
    stop = F.coalesce(F.col("_next") - F.col("_from"), F.length("_source"))
    kept = F.when(F.col("_inside") > 0, "").otherwise(
        F.substring(F.col("_source"), begin + 1, F.greatest(stop - begin, F.lit(0)))
    )
    fragment = F.concat(F.when(kind == 2, F.lit(replacement)).otherwise(""), kept)
    rebuilt = (
        swept.groupBy(*keys, "run")
        .agg(F.array_sort(F.collect_list(F.struct("_pos", "_kind", fragment.alias("f")))).alias("_f"))
        .select(*keys, "run", F.array_join("_f.f", "").alias("text"))
    )
    return runs.drop("text").join(rebuilt, [*keys, "run"])


def insert_paragraphs(
    paragraphs: DataFrame, edits: DataFrame, guards: DataFrame | None = None
) -> Edited:
    """``edits(doc_id, idx, text, style)``: insert before ``idx``, or append when null.

    Later paragraphs move by one, so no renumbering window is needed. Before a table
    paragraph the new one belongs to the same cell.
    """
    single = _single(edits, sizes(paragraphs)).withColumn(
        "_at", F.coalesce("idx", "size")
    )
    decided = _guarded(single, guards, "_at").withColumn(
        "reason",
        F.when(F.col("_twice"), _TWICE)
        .when((F.col("_at") > F.col("size")) | (F.col("_at") < 0), _OUT_OF_BOUNDS)
        .when(~X.valid_xml_text(F.col("text")), _INVALID)
        .otherwise(F.col("_guard")),
    )
    accepted = _accepted(decided)
    moves = accepted.select("doc_id", "_at", "size")
    moved = attach(paragraphs, moves, ["doc_id"], "idx", "size", "left").drop("size")
    shift = F.when(F.col("idx") >= F.col("_at"), 1).otherwise(0)
    columns = paragraphs.columns
    moved = moved.withColumn("idx", F.col("idx") + shift).select(*columns)
    line = F.regexp_replace("text", "\r\n?", "\n")
    added = accepted.select(
        "doc_id", F.col("_at").alias("idx"), line.alias("text"), F.col("style").alias("style")
    )
    if "in_table" in columns:
        cells = paragraphs.select("doc_id", "idx", "in_table")
        added = added.join(cells, ["doc_id", "idx"], "left").withColumn(
            "in_table", F.coalesce("in_table", F.lit(False))
        )
    kept = [c for c in added.columns if c in columns]
    result = moved.unionByName(added.select(*kept), allowMissingColumns=True)
    audit = accepted.select("doc_id", F.col("_at").cast("int").alias("idx"))
    return Edited(result, _rejects(decided), audit)


def delete_paragraphs(
    paragraphs: DataFrame, edits: DataFrame, guards: DataFrame | None = None
) -> Edited:
    """``edits(doc_id, idx)``: delete one paragraph; the audit holds its text.

    Without ``guards`` the document is one container, whose only paragraph must stay; for
    packages pass ``deletion_guards``.
    """
    single = _single(edits, sizes(paragraphs))
    outside = (F.col("idx") >= F.col("size")) | (F.col("idx") < 0)
    reason = F.when(F.col("_twice"), _TWICE).when(outside, _OUT_OF_BOUNDS)
    if guards is None:
        reason = reason.when(F.col("size") == 1, "a document keeps at least one paragraph")
    decided = _guarded(single, guards, "idx").withColumn(
        "reason", reason.otherwise(F.col("_guard"))
    )
    accepted = _accepted(decided)
    moves = accepted.select("doc_id", F.col("idx").alias("_at"), "size")
    joined = attach(paragraphs, moves, ["doc_id"], "idx", "size", "left").drop("size")
    kept = joined.where(F.col("_at").isNull() | (F.col("idx") != F.col("_at")))
    shift = F.when(F.col("idx") > F.col("_at"), 1).otherwise(0)
    result = kept.withColumn("idx", F.col("idx") - shift).select(*paragraphs.columns)
    audit = accepted.select("doc_id", "idx").join(
        paragraphs.select("doc_id", "idx", F.col("text").alias("deleted_text")), ["doc_id", "idx"]
    )
    return Edited(result, _rejects(decided), audit)


def check_format(
    bold: bool | None = None,
    italic: bool | None = None,
    underline: bool | None = None,
    size_pt: float | None = None,
    font: str | None = None,
    alignment: str | None = None,
    style: str | None = None,
) -> None:
    """Refuse an empty or impossible formatting request."""
    given = (bold, italic, underline, size_pt, font, alignment, style)
    check(any(v is not None for v in given), "provide at least one formatting property")
    check_size(size_pt)
    check(font is None or font.strip() != "", "font must not be blank")
    check(alignment is None or alignment in ALIGNMENTS, "alignment must be left, center, right or both")


def _bad_format() -> Column:
    """Why a row of formatting edits is refused."""
    size = F.col("size_pt")
    nothing = F.coalesce(
        *[
            F.col(c).cast("string")
            for c in ("bold", "italic", "underline", "size_pt", "font", "alignment", "style")
        ]
    ).isNull()
    return (
        F.when(nothing, "provide at least one formatting property")
        .when(
            ~(size.between(1, 1638) & (size * 2 == F.floor(size * 2))),
            "font size must be 1-1638 points in half-point increments",
        )
        .when(F.trim("font") == "", "font must not be blank")
        .when(~F.col("alignment").isin(*ALIGNMENTS), "unknown alignment")
    )


def _formatted(runs: DataFrame) -> DataFrame:
    """Lay requested values (``_new_*``) over the values runs have."""
    line = F.when(F.col("_new_underline"), "single").when(~F.col("_new_underline"), "none")
    values = {
        "bold": F.coalesce("_new_bold", "bold"),
        "italic": F.coalesce("_new_italic", "italic"),
        "underline": F.coalesce(line, F.col("underline")),
        "size_pt": F.coalesce("_new_size_pt", "size_pt"),
        "font": F.coalesce("_new_font", "font"),
    }
    return runs.withColumns(values)


_RUN_FORMATS = ("bold", "italic", "underline", "size_pt", "font")


def format_paragraphs(
    paragraphs: DataFrame, runs: DataFrame, edits: DataFrame, guards: DataFrame | None = None
) -> tuple[Edited, DataFrame]:
    """``edits(doc_id, idx, bold, italic, underline, size_pt, font, alignment, style)``.

    Sets paragraph properties and the format of every run of the paragraph; what is null
    stays as it was. Returns the edited paragraphs and the edited runs.
    """
    single = _single(edits, sizes(paragraphs))
    outside = (F.col("idx") >= F.col("size")) | (F.col("idx") < 0)
    decided = _guarded(single, guards, "idx").withColumn(
        "reason",
        F.when(F.col("_twice"), _TWICE)
        .when(outside, _OUT_OF_BOUNDS)
        .otherwise(F.coalesce(F.col("_guard"), _bad_format())),
    )
    accepted = _accepted(decided)
    looks = accepted.select(
        "doc_id", "idx", F.col("alignment").alias("_new_al"), F.col("style").alias("_new_style")
    )
    styled = paragraphs.join(looks, ["doc_id", "idx"], "left")
    if "alignment" not in paragraphs.columns:
        styled = styled.withColumn("alignment", F.lit(None).cast("string"))
    if "style" not in paragraphs.columns:
        styled = styled.withColumn("style", F.lit(None).cast("string"))
    styled = styled.withColumns(
        {
            "alignment": F.coalesce("_new_al", "alignment"),
            "style": F.coalesce("_new_style", "style"),
        }
    ).drop("_new_al", "_new_style")
    faces = accepted.select("doc_id", "idx", *[F.col(c).alias(f"_new_{c}") for c in _RUN_FORMATS])
    faced = _formatted(runs.join(faces, ["doc_id", "idx"], "left")).select(*runs.columns)
    return Edited(styled, _rejects(decided), accepted.select("doc_id", "idx")), faced


def insert_text(paragraphs: DataFrame, edits: DataFrame) -> Edited:
    """``edits(doc_id, position, text)``: insert at a UTF-16 position of the story.

    A carriage return in the text starts a new paragraph, which takes the look of the one
    it was inserted in.
    """
    placed = positions(paragraphs)
    stories = placed.groupBy("doc_id").agg(
        F.max("story_end").alias("_story"), (F.max("idx") + 1).alias("size")
    )
    decided = (
        _single(edits, stories.select("doc_id", "size"))
        .join(stories.select("doc_id", "_story"), "doc_id", "left")
        .withColumn(
            "reason",
            F.when(F.col("_twice"), _TWICE)
            .when(
                (F.col("position") < 0) | (F.col("position") > F.coalesce("_story", F.lit(-1))),
                "position is outside the main story",
            )
            .when(~X.valid_xml_text(F.col("text")), _INVALID),
        )
    )
    accepted = _accepted(decided).select(
        "doc_id", "position", F.col("text").alias("_added"), "size", "_story"
    )
    # The position after the last mark belongs to the last paragraph, before its mark.
    at = F.least(F.col("position"), F.col("_story") - 1)
    joined = attach(placed, accepted.withColumn("position", at), ["doc_id"], "idx", "size", "left")
    here = F.coalesce(
        (F.col("position") >= F.col("start")) & (F.col("position") < F.col("end")), F.lit(False)
    )
    marks = F.length("_added") - F.length(F.replace(F.col("_added"), F.lit("\r"), F.lit("")))
    shift = F.when(F.col("start") > F.col("position"), marks).otherwise(0)
    cut = F.col("position") - F.col("start")
    spliced = F.concat(
        X.utf16_slice(F.col("text"), F.lit(0), cut),
        F.col("_added"),
        X.utf16_slice(F.col("text"), cut, F.col("end") - F.col("start") - 1),
    )
    lines = F.when(here, F.split(spliced, "\r", -1)).otherwise(F.array("text"))
    others = [c for c in paragraphs.columns if c not in ("doc_id", "idx", "text")]
    result = joined.select(
        "doc_id", (F.col("idx") + shift).alias("_idx"), *others, F.posexplode(lines).alias("_k", "text")
    ).withColumn("idx", (F.col("_idx") + F.col("_k")).cast("int"))
    audit = accepted.select("doc_id", X.utf16_length(F.col("_added")).alias("inserted_utf16"))
    return Edited(result.select(*paragraphs.columns), _rejects(decided), audit)


def delete_range(paragraphs: DataFrame, edits: DataFrame) -> Edited:
    """``edits(doc_id, start, end)``: delete a range of the story; the audit holds its text.

    A range over paragraph marks joins the first and last paragraph, which keeps the look
    of the last one, as its mark survives. The story's final mark always stays.
    """
    placed = positions(paragraphs)
    stories = placed.groupBy("doc_id").agg(
        F.max("story_end").alias("_story"), (F.max("idx") + 1).alias("size")
    )
    decided = (
        _single(
            edits.select("doc_id", F.col("start").alias("lo"), F.col("end").alias("hi")),
            stories.select("doc_id", "size"),
        )
        .join(stories.select("doc_id", "_story"), "doc_id", "left")
        .withColumn(
            "reason",
            F.when(F.col("_twice"), _TWICE)
            .when((F.col("lo") < 0) | (F.col("lo") >= F.col("hi")), "range must satisfy 0 <= start < end")
            .when(F.col("hi") > F.coalesce("_story", F.lit(-1)), "range is outside the main story"),
        )
    )
    accepted = _accepted(decided).select("doc_id", "lo", "hi", "size", "_story")
    cuts = accepted.withColumn("hi", F.least(F.col("hi"), F.col("_story") - 1))
    joined = attach(placed, cuts, ["doc_id"], "idx", "size", "left")
    start, end, lo, hi = (F.col(c) for c in ("start", "end", "lo", "hi"))
    opens = (start <= lo) & (lo < end)
    closes = (start <= hi) & (hi < end)
    touched = F.coalesce(opens | closes, F.lit(False))
    edges = joined.where(touched)
    merged = edges.groupBy("doc_id").agg(
        F.min("idx").alias("_top"),
        F.max("idx").alias("_bottom"),
        F.max(F.when(opens, X.utf16_slice(F.col("text"), F.lit(0), lo - start))).alias("_head"),
        F.max(F.when(closes, X.utf16_slice(F.col("text"), hi - start, end - start - 1))).alias("_tail"),
        F.max("size").alias("size"),
    )
    spread = attach(paragraphs, merged, ["doc_id"], "idx", "size", "left")
    top, bottom, idx = F.col("_top"), F.col("_bottom"), F.col("idx")
    kept = spread.where(top.isNull() | (idx < top) | (idx >= bottom))
    result = kept.withColumns(
        {
            "text": F.when(idx == bottom, F.concat("_head", "_tail")).otherwise(F.col("text")),
            "idx": F.when(idx >= bottom, idx - (bottom - top)).otherwise(idx).cast("int"),
        }
    )
    removed = ranges_text(placed, accepted.select("doc_id", "lo", "hi"), ["doc_id"])
    audit = removed.select("doc_id", "piece", F.col("text").alias("deleted_text"))
    return Edited(result.select(*paragraphs.columns), _rejects(decided), audit)


def format_range(
    paragraphs: DataFrame, runs: DataFrame, edits: DataFrame
) -> tuple[Edited, DataFrame]:
    """``edits(doc_id, start, end, bold, italic, underline, size_pt, font, alignment, style)``.

    Runs are split where the range begins and ends. The style and the alignment go to
    every paragraph the range touches, explicit run formatting comes on top.
    """
    from scriptorium.operators.formatting import placed_runs

    placed = positions(paragraphs)
    stories = placed.groupBy("doc_id").agg(
        F.max("story_end").alias("_story"), (F.max("idx") + 1).alias("size")
    )
    wanted = edits.withColumnRenamed("start", "lo").withColumnRenamed("end", "hi")
    decided = (
        _single(wanted, stories.select("doc_id", "size"))
        .join(stories.select("doc_id", "_story"), "doc_id", "left")
        .withColumn(
            "reason",
            F.when(F.col("_twice"), _TWICE)
            .when((F.col("lo") < 0) | (F.col("lo") >= F.col("hi")), "range must satisfy 0 <= start < end")
            .when(F.col("hi") > F.coalesce("_story", F.lit(-1)), "range is outside the main story")
            .otherwise(_bad_format()),
        )
    )
    accepted = _accepted(decided)
    looks = accepted.select(
        "doc_id", "lo", "hi", "size",
        F.col("alignment").alias("_new_al"), F.col("style").alias("_new_style"),
    )
    touched = F.coalesce(
        (F.col("start") < F.col("hi")) & (F.col("end") > F.col("lo")), F.lit(False)
    )
    styled = attach(placed, looks, ["doc_id"], "idx", "size", "left")
    for name in ("alignment", "style"):
        if name not in paragraphs.columns:
            styled = styled.withColumn(name, F.lit(None).cast("string"))
    styled = styled.withColumns(
        {
            "alignment": F.when(touched, F.coalesce("_new_al", "alignment")).otherwise(F.col("alignment")),
            "style": F.when(touched, F.coalesce("_new_style", "style")).otherwise(F.col("style")),
        }
    ).drop("lo", "hi", "size", "_new_al", "_new_style", "start", "end", "story_end")
    faces = accepted.select(
        "doc_id", "lo", "hi", "size", *[F.col(c).alias(f"_new_{c}") for c in _RUN_FORMATS]
    )
    joined = attach(placed_runs(runs, placed), faces, ["doc_id"], "idx", "size", "left")
    begin, stop = F.col("run_start"), F.col("run_end")
    lo, hi = F.coalesce("lo", F.lit(-1)), F.coalesce("hi", F.lit(-1))
    # Up to three parts: before, inside and after the range.
    edges = F.array(
        F.struct(begin.alias("a"), F.least(stop, lo).alias("b"), F.lit(False).alias("inside")),
        F.struct(F.greatest(begin, lo).alias("a"), F.least(stop, hi).alias("b"), F.lit(True).alias("inside")),
        F.struct(F.greatest(begin, hi).alias("a"), stop.alias("b"), F.lit(False).alias("inside")),
    )
    untouched = F.array(F.struct(begin.alias("a"), stop.alias("b"), F.lit(False).alias("inside")))
    split = F.when(F.col("lo").isNull(), untouched).otherwise(
        F.filter(edges, lambda e: e["a"] < e["b"])
    )
    parts = joined.withColumn("_e", F.explode(split)).withColumn(
        "text", X.utf16_slice(F.col("text"), F.col("_e.a") - begin, F.col("_e.b") - begin)
    )
    inside = F.col("_e.inside")
    parts = parts.withColumns(
        {f"_new_{c}": F.when(inside, F.col(f"_new_{c}")) for c in _RUN_FORMATS}
    )
    order = W.partitionBy("doc_id", "idx").orderBy("run", F.col("_e.a"))
    faced = _formatted(parts).withColumn("run", (F.row_number().over(order) - 1).cast("int"))
    audit = accepted.select("doc_id", F.col("lo").alias("start"), F.col("hi").alias("end"))
    return Edited(styled, _rejects(decided), audit), faced.select(*runs.columns)


def check_range(start: int, end: int) -> None:
    check_positions(start, end, allow_empty=False)
