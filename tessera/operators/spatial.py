"""Interval joins of boxes within a page.

Boxes are dealt into horizontal bins of BIN points and joined on (page, bin), so a crowded page is
spread and no page is compared all against all; a pair counts in the first bin that both reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import BOX, area, box, contains, intersection, intersects

BIN = 32.0
LEADING = 0.55
PAGE = ["doc_id", "page_no"]


def binned(df: DataFrame, bin_size: float = BIN, pad: float = 0.0) -> DataFrame:
    lo, hi = F.floor((F.col("y0") - pad) / bin_size), F.floor((F.col("y1") + pad) / bin_size)
    return df.withColumn("__first", lo).withColumn("__bin", F.explode(F.sequence(lo, F.greatest(lo, hi))))


def renamed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keep])


def pairs(a: DataFrame, b: DataFrame, condition: Column, how: str = "inner", pad: float = 0.0) -> DataFrame:
    """Rows of a and b (columns prefixed a_ and b_) on one page whose y ranges meet and that satisfy condition."""
    keys = [*PAGE, "__bin"]
    x, y = renamed(binned(a, pad=pad), "a_", keys), renamed(binned(b, pad=pad), "b_", keys)
    met = x.join(y, keys).where((F.col("__bin") == F.greatest("a___first", "b___first")) & condition)
    return met.drop("__bin", "a___first", "b___first")


def exists_pairs(a: DataFrame, b: DataFrame, condition: Column, pad: float, key: str) -> DataFrame:
    """Distinct (doc_id, page_no, key) of a for which some row of b satisfies condition."""
    return pairs(a, b, condition, pad=pad).select(*PAGE, F.col(f"a_{key}").alias(key)).distinct()


def collisions(spans: DataFrame, min_overlap: float = 1.0, min_share: float = 0.20, min_side: float = 6.0, min_area: float = 25.0) -> DataFrame:
    """Pairs of text spans of one page that collide: their overlap is at least min_overlap, and it is a
    fair share of the smaller box, or at least min_side both ways, or at least min_area. Spans of one
    line never do (kerning), nor do lines of one block that stand over half a line apart (leading).

    spans(doc_id, page_no, box_no, block_no, line_no, box); without block_no and line_no each is its own.
    """
    a, b = box("a_"), box("b_")
    typeset = F.lit(False)
    if {"block_no", "line_no"} <= set(spans.columns):
        least_h = F.least(F.col("a_y1") - F.col("a_y0"), F.col("b_y1") - F.col("b_y0"))
        apart = F.abs(F.col("b_y0") - F.col("a_y0")) >= LEADING * least_h
        typeset = (F.col("a_block_no") == F.col("b_block_no")) & ((F.col("a_line_no") == F.col("b_line_no")) | apart)
    over = intersection(a, b)
    shared = area(over)
    small = F.least(area(a), area(b))
    rule = (shared >= min_overlap) & ((shared >= min_share * small) | ((over[2] - over[0] >= min_side) & (over[3] - over[1] >= min_side)) | (shared >= min_area))
    met = pairs(spans, spans, (F.col("a_box_no") < F.col("b_box_no")) & intersects(a, b) & rule & ~F.coalesce(typeset, F.lit(False)))
    return met.withColumn("overlap", F.round(shared, 3))


def within_same(pairs_df: DataFrame, artwork: DataFrame, slack: float = 14.0) -> DataFrame:
    """The pairs whose two boxes do not both lie (within slack) in one artwork box of their page."""
    art = binned(artwork.select(*PAGE, *BOX), pad=slack).select(*PAGE, "__bin", *[F.col(c).alias(f"g_{c}") for c in BOX])
    inside = contains(box("g_"), box("a_"), slack) & contains(box("g_"), box("b_"), slack)
    # artwork that holds box a reaches the bin of a's top
    keyed = pairs_df.withColumn("__bin", F.floor(F.col("a_y0") / BIN))
    held = keyed.join(art, [*PAGE, "__bin"]).where(inside).select(*PAGE, "a_box_no", "b_box_no").distinct()
    return pairs_df.join(held, [*PAGE, "a_box_no", "b_box_no"], "left_anti")


def outside(boxes: DataFrame, others: DataFrame, pad: float, key: str = "box_no") -> DataFrame:
    """Boxes that meet none of others, grown by pad."""
    met = exists_pairs(boxes, others, intersects(box("a_"), box("b_"), pad), pad, key)
    return boxes.join(met, [*PAGE, key], "left_anti")


def meeting(boxes: DataFrame, others: DataFrame, pad: float, key: str = "box_no") -> DataFrame:
    """Boxes that meet at least one of others, grown by pad."""
    met = exists_pairs(boxes, others, intersects(box("a_"), box("b_"), pad), pad, key)
    return boxes.join(met, [*PAGE, key], "left_semi")


def without_nested(boxes: DataFrame, factor: float = 1.15, slack: float = 0.0) -> DataFrame:
    """Boxes that lie in no other box of the page over `factor` times as large."""
    inside = (F.col("a_box_no") != F.col("b_box_no")) & contains(box("b_"), box("a_"), slack) & (area(box("b_")) > factor * area(box("a_")))
    return boxes.join(exists_pairs(boxes, boxes, inside, slack, "box_no"), [*PAGE, "box_no"], "left_anti")


def innermost_parent(boxes: DataFrame, slack: float = 8.0, share: float = 0.96) -> DataFrame:
    """(doc_id, page_no, box_no, parent_no): the smallest box that holds this one within slack and
    of which it is less than `share`; equal sizes go to the smaller number; none: no row."""
    inside = (F.col("a_box_no") != F.col("b_box_no")) & contains(box("b_"), box("a_"), slack) & (area(box("a_")) < share * area(box("b_")))
    met = pairs(boxes, boxes, inside, pad=slack)
    best = F.min_by("b_box_no", F.struct(F.round(area(box("b_")), 6).alias("a"), F.col("b_box_no").alias("b")))
    return met.groupBy(*PAGE, F.col("a_box_no").alias("box_no")).agg(best.alias("parent_no"))
