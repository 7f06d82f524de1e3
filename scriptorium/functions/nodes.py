"""Predicates on element rows: everything is answered from the row's own ancestors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.schema import WORD_NS

# What switches a toggle property off.
OFF = ("0", "false", "off")


def _quoted(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{name}'" for name in names)


def ancestor(up: int) -> Column:
    """The ancestor ``up`` levels above, null beyond the root."""
    return F.expr(f"try_element_at(ancestors, -{up})")


def is_word(*names: str) -> Column:
    """Whether the element is one of the named Word elements."""
    return F.expr(f"is_word AND name IN ({_quoted(names)})")


def _under_sql(names: tuple[str, ...], first: bool) -> str:
    """One match on the names of the nearest ancestors; at most three of them."""
    star = r"\*" if first else r"\*?"
    steps = [names[0] + r"\*?", *[name + star for name in names[1:]]]
    return f"coalesce(within RLIKE r'(^|/){'/'.join(steps)}$', false)"


def under(*names: str) -> Column:
    """Whether the nearest ancestors are these Word elements, outermost first."""
    return F.expr(_under_sql(names, first=False))


def under_first(*names: str) -> Column:
    """Like ``under``; each but the outermost is also the first of its kind there."""
    return F.expr(_under_sql(names, first=True))


def nearest(*names: str) -> Column:
    """The nearest ancestor that is one of the named Word elements."""
    hits = f"filter(ancestors, a -> a.word AND a.name IN ({_quoted(names)}))"
    return F.expr(f"try_element_at({hits}, -1)")


def inside(*names: str) -> Column:
    return F.expr(f"exists(ancestors, a -> a.word AND a.name IN ({_quoted(names)}))")


def word_attr(name: str) -> Column:
    """An attribute in the Word namespace."""
    return F.expr(f"attrs['{{{WORD_NS}}}{name}']")


def is_on(value: Column) -> Column:
    """An on/off value; a missing one means on."""
    return value.isNull() | ~value.isin(*OFF)


def run_text(all_tabs: bool = False) -> Column:
    """The text an element adds to its paragraph, null when it adds none.

    Tabs and breaks count inside a run; with ``all_tabs`` wherever they are, which takes
    in the tab stops of the paragraph's properties.
    """
    placed = "true" if all_tabs else _under_sql(("r",), first=False)
    return F.expr(
        f"""CASE WHEN NOT is_word THEN NULL WHEN name = 't' THEN text
        WHEN name = 'tab' AND {placed} THEN '\t'
        WHEN name IN ('br', 'cr') AND {placed} THEN '\n' END"""
    )


def small_int(value: Column, largest: int = 255) -> Column:
    """A non-negative integer no larger than ``largest``, else null."""
    number = F.when(value.rlike(r"\A\+?[0-9]+\z"), value.try_cast("bigint"))
    return F.when(number <= largest, number.cast("int"))


def number(value: Column) -> Column:
    return value.try_cast("double")


# Where a paragraph sits among the body's blocks. The path lists the ancestors after the
# body; content controls and custom markup are looked through.
_THROUGH = "(?:customXml/|sdt/sdtContent/)*"


def block_path() -> Column:
    """Names of the ancestors below the body, each followed by a slash; null elsewhere."""

    body = "try_element_at(ancestors, 2)"
    label = """a -> concat(
        CASE WHEN NOT a.word OR (a.name = 'sdtContent' AND NOT a.first) THEN '?' ELSE a.name END, '/')"""
    below = "slice(ancestors, 3, greatest(size(ancestors) - 2, 0))"
    return F.expr(
        f"CASE WHEN {body}.word AND {body}.name = 'body' "
        f"THEN array_join(transform({below}, {label}), '') END"
    )


def block_place() -> Column:
    """Struct of ``kind`` (paragraph, table) and ids of table, row and cell; null outside.

    For a paragraph the ids of the row and cell are those of the outermost table.
    """
    path = block_path()
    through = F.regexp_extract(path, f"^({_THROUGH})tbl/", 1)
    steps = F.length(through) - F.length(F.replace(through, F.lit("/"), F.lit("")))
    rest = F.regexp_replace(path, f"^{_THROUGH}tbl/", "")

    def at(offset: int) -> Column:
        return F.try_element_at(F.col("ancestors"), steps + offset)["id"]

    none = F.lit(None).cast("int")
    in_table = path.rlike(f"^{_THROUGH}tbl/")
    in_cell = rest.startswith("tr/tc/")
    return F.when(
        in_table,
        F.struct(
            F.lit("table").alias("kind"),
            at(3).alias("block_id"),
            F.when(in_cell, at(4)).alias("row_id"),
            F.when(in_cell, at(5)).alias("cell_id"),
        ),
    ).when(
        path.rlike(f"^{_THROUGH}$"),
        F.struct(
            F.lit("paragraph").alias("kind"),
            F.col("node_id").alias("block_id"),
            none.alias("row_id"),
            none.alias("cell_id"),
        ),
    )
