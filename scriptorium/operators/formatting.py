"""Formatting of ranges and of single paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import nodes as N
from scriptorium.functions import text as X
from scriptorium.operators import styles
from scriptorium.operators.carry import overlap_join


def placed_runs(runs: DataFrame, placed: DataFrame) -> DataFrame:
    """Runs with their story positions ``run_start`` and ``run_end``."""
    before = W.partitionBy("doc_id", "idx").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    width = X.utf16_length(F.col("text"))
    inner = runs.withColumn("_off", F.coalesce(F.sum(width).over(before), F.lit(0)))
    joined = inner.join(placed.select("doc_id", "idx", "start"), ["doc_id", "idx"])
    return joined.withColumns(
        {
            "run_start": (F.col("start") + F.col("_off")).cast("int"),
            "run_end": (F.col("start") + F.col("_off") + width).cast("int"),
        }
    ).drop("_off", "start")


def uniform(value: Column) -> Column:
    """The value all rows share, null when they differ (or all lack it)."""
    same = F.min(value).eqNullSafe(F.max(value)) & (F.count(value) == F.count(F.lit(1)))
    return F.when(same, F.min(value))


def range_formatting(
    placed: DataFrame, runs: DataFrame, ranges: DataFrame, properties: list[str]
) -> DataFrame:
    """Formatting over ``ranges(doc_id, lo, hi)``: a property whose values differ is null.

    An interval join on position buckets, then one partial aggregate per property.
    ``vertical_align`` combines to superscript or subscript only when all agree; runs
    without one are on the baseline.
    """
    spans = placed_runs(runs, placed)
    pairs = overlap_join(spans, ranges, ["doc_id"], span=("run_start", "run_end"))
    values = {
        name: F.coalesce(name, F.lit("baseline")) if name == "vertical_align" else F.col(name)
        for name in properties
    }
    return pairs.groupBy("doc_id", "lo", "hi").agg(
        *[uniform(value).alias(name) for name, value in values.items()]
    )


def paragraph_formatting(resolved: DataFrame, levels: DataFrame, runs: DataFrame, names: DataFrame) -> DataFrame:
    """Resolved formatting of each paragraph and the direct formatting of its runs.

    ``resolved`` comes from ``styles.resolve``, ``levels`` from ``num_levels`` and ``names``
    holds ``(doc_id, style_id, style_name)``. A paragraph's runs come from one part, so the
    list is bounded.
    """
    number, level = styles.numbering_reference()
    flat = resolved.withColumns({"num_id": number, "ilvl": level})
    defined = levels.select(
        "doc_id", "num_id", F.col("level").alias("ilvl"), "format", "level_text"
    )
    run_fields = [c for c in runs.columns if c not in ("doc_id", "part", "idx")]
    listed = (
        runs.groupBy("doc_id", "idx")
        .agg(F.array_sort(F.collect_list(F.struct(*run_fields))).alias("runs"))
    )
    joined = (
        flat.join(defined, ["doc_id", "num_id", "ilvl"], "left")
        .join(names, ["doc_id", "style_id"], "left")
        .join(listed, ["doc_id", "idx"], "left")
    )

    def points(*names: str) -> Column:
        return N.number(F.coalesce(*[styles.attribute(n) for n in names])) / 20

    line = N.number(styles.attribute("spacing_line"))
    rule = styles.attribute("spacing_lineRule")
    fixed = F.coalesce(rule.isin("exact", "atLeast"), F.lit(False))
    rule_name = (
        F.when(line.isNull(), F.lit(None).cast("string"))
        .when(rule == "exact", "exact")
        .when(rule == "atLeast", "at_least")
        .otherwise("multiple")
    )
    return joined.select(
        "doc_id",
        "idx",
        "text",
        "in_table",
        "style_id",
        "style_name",
        styles.element("jc").alias("alignment"),
        F.struct(
            points("spacing_before").alias("before_pt"),
            points("spacing_after").alias("after_pt"),
            F.when(fixed, line / 20).otherwise(line / 240).alias("line"),
            rule_name.alias("line_rule"),
        ).alias("spacing"),
        F.struct(
            points("ind_left", "ind_start").alias("left_pt"),
            points("ind_right", "ind_end").alias("right_pt"),
            points("ind_firstLine").alias("first_line_pt"),
            points("ind_hanging").alias("hanging_pt"),
        ).alias("indent"),
        F.when(
            F.col("num_id").isNotNull(), F.struct("num_id", "ilvl", "format", "level_text")
        ).alias("numbering"),
        styles.is_set("keepNext").alias("keep_next"),
        styles.is_set("keepLines").alias("keep_lines"),
        styles.is_set("pageBreakBefore").alias("page_break_before"),
        styles.is_set("widowControl").alias("widow_control"),
        styles.heading_level().alias("outline_level"),
        F.coalesce("runs", F.array().cast(listed.schema["runs"].dataType)).alias("runs"),
    )
