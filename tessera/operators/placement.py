"""Where template regions go: sheets, anchors, margins, parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as g

SNAP = 45.0
# What a scope is called.
SCOPE_LABELS = {"all": "All pages", "odd": "Odd pages", "even": "Even pages", "first": "First page", "last": "Last page", "single": "Single page"}
LEGACY = ("range", "pages", "single")


def sheet_key(sheet: Column, orientation: Column, width: Column, height: Column) -> Column:
    """A sheet's first word, with -landscape where it lies; without a sheet the rounded sides."""
    short = F.substring_index(F.trim(sheet), " ", 1)
    own = F.when(orientation == "portrait", short).otherwise(F.concat(short, F.lit("-landscape")))
    return F.when(F.coalesce(sheet, F.lit("-")).isin("", "-"), F.format_string("%.0fx%.0f", F.bround(width, 0), F.bround(height, 0))).otherwise(own)


def placed(stored: tuple, by_sheet: Column, sheet: Column, anchor: Column, from_width: Column, from_height: Column, width: Column, height: Column) -> Column:
    """A region's box on a page: the one set for its sheet, else its anchor's where the page differs by a
    point or more from the anchor's, else the stored one. by_sheet maps sheets to boxes."""
    box = lambda b: F.struct(*[c.cast("double").alias(n) for c, n in zip(b, g.BOX)])
    own = F.try_element_at(by_sheet, sheet)
    same = (F.abs(from_width - width) < 1.0) & (F.abs(from_height - height) < 1.0)
    moved = g.from_anchor(anchor, width, height)
    return F.when(own.isNotNull(), box([own[n] for n in g.BOX])).when(anchor.isNotNull() & ~F.coalesce(same, F.lit(False)), box(moved)).otherwise(box(stored))


def recorded(by_sheet: Column, sheet: Column, box: Column) -> Column:
    """The map of boxes with this sheet's replaced."""
    return F.map_concat(F.map_filter(by_sheet, lambda k, _: k != sheet), F.map_from_arrays(F.array(sheet), F.array(box)))


def snapped(b: tuple, parent: tuple, m: dict[str, Column], width: Column, height: Column) -> tuple:
    """A region's sides set to its parent's, or without one to the margins, where they are at most 45 pt
    off; a side that is farther off goes to the page's edge (left, right, bottom) or stays (top)."""
    left, top = F.coalesce(parent[0], m["left"]), F.coalesce(parent[1], m["header"])
    right, bottom = F.coalesce(parent[2], width - m["right"]), F.coalesce(parent[3], height - m["footer"])
    to = lambda v, goal, other: F.when(F.abs(v - goal) <= SNAP, goal).otherwise(other)
    return (to(b[0], left, F.lit(0.0)), to(b[1], top, b[1]), to(b[2], right, width), to(b[3], bottom, height))


def default_scope(page: Column, is_last: Column) -> Column:
    return F.when(is_last, "last").when(page == 1, "first").otherwise("all")


def described_scope(kind: Column, first: Column, last: Column, pages: Column, page: Column) -> Column:
    """A scope in words; those bound to page numbers are marked as retired."""
    shown = F.array_join(F.slice(F.transform(pages, lambda p: p.cast("string")), 1, 6), ", ")
    body = F.when(F.coalesce(F.size(pages), F.lit(0)) <= 0, "Pages (none)").otherwise(F.concat(F.lit("Pages "), shown, F.when(F.size(pages) > 6, "...").otherwise("")))
    names = F.create_map(*[F.lit(x) for kv in SCOPE_LABELS.items() for x in kv])
    return (
        F.when(kind.isNull(), SCOPE_LABELS["single"])
        .when(kind == "range", F.format_string("Pages %d-%d  (retired)", F.coalesce(first, F.lit(1)), F.coalesce(last, F.lit(1))))
        .when(kind == "pages", F.concat(body, F.lit("  (retired)")))
        .when((kind == "single") & page.isNotNull(), F.format_string("Page %d  (retired)", page))
        .otherwise(F.coalesce(F.try_element_at(names, kind), kind))
    )


def is_legacy_scope(kind: Column) -> Column:
    return F.coalesce(kind.isin(*LEGACY), F.lit(False))


def described_margins(m: dict[str, Column], defaults: dict[str, float]) -> tuple[Column, Column]:
    """The margins in words, and whether they are the defaults (to a tenth of a point)."""
    text = F.concat_ws(", ", *[F.concat(F.lit(f"{side} "), g.describe_points(c)) for side, c in m.items()])
    same = [F.abs(m[side] - v) < 0.1 for side, v in defaults.items()]
    out = same[0]
    for s in same[1:]:
        out = out & s
    return text, out


def reparented(regions: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """Regions whose parent by place is no longer the stored one: orphaned, adopted or moved.

    regions(by, id, parent_id), found(by, id, parent_no): the innermost region around each.
    """
    met = regions.join(found, [*by, "id"], "left").where(~F.col("parent_id").eqNullSafe(F.col("parent_no")))
    why = F.when(F.col("parent_no").isNull(), "orphaned").when(F.col("parent_id").isNull(), "adopted").otherwise("moved")
    return met.select(*by, "id", F.col("parent_id").alias("old_parent"), F.col("parent_no").alias("new_parent"), why.alias("change"))


def template_names(regions: DataFrame) -> DataFrame:
    """Names of templates with their number of regions, in the order of a list that ignores case."""
    return regions.groupBy("name").agg(F.count("*").alias("regions")).withColumn("place", F.row_number().over(Window.orderBy(F.lower("name"), "name")))  # one row a template
