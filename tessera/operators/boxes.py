"""Boxes sifted and merged: plausibility, duplicates, figures put together from their parts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators.components import by_groups, page_components, written
from tessera.operators.spatial import PAGE, pairs

Near = Callable[[tuple, tuple], Column]
Drop = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _sides(b: tuple) -> tuple[Column, Column]:
    return b[2] - b[0], b[3] - b[1]


def plausible_table(b: tuple, width: Column, height: Column, slack: float = 2.0, least: float = 20.0, most: float = 0.60) -> Column:
    """Whether a box can be a table: sides of 20 pt, on the page but for 2 pt, at most 60 % of it."""
    w, h = _sides(b)
    inside = (b[0] >= -slack) & (b[1] >= -slack) & (b[2] <= width + slack) & (b[3] <= height + slack)
    return (w >= least) & (h >= least) & inside & (w * h / F.greatest(F.lit(1.0), width * height) <= most)


def in_header_or_footer(b: tuple, height: Column, header: float = 45.0, footer: float = 50.0, slack: float = 20.0) -> Column:
    """Whether a box starts in the header or ends in the footer and reaches at most 20 pt out of it."""
    return ((b[1] < header) & (b[3] <= header + slack)) | ((b[3] > height - footer) & (b[1] >= height - footer - slack))


def drawable(b: tuple, width: Column, height: Column) -> Column:
    """Whether an element counts: no hairline (2.5 by over 20), at most 40 % of the page, over 1 pt both ways."""
    w, h = _sides(b)
    hairline = ((w <= 2.5) & (h > 20)) | ((h <= 2.5) & (w > 20))
    return ~hairline & (w * h <= 0.40 * width * height) & (w > 1) & (h > 1)


def close_parts(a: tuple, b: tuple, gap: float = 2.0, above: float = 10.0) -> Column:
    """Boxes that meet within a gap, or share over half of the narrower one's width at most 10 pt apart."""
    across = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    narrow = F.least(a[2] - a[0], b[2] - b[0])
    apart = F.greatest(F.lit(0.0), F.greatest(a[1], b[1]) - F.least(a[3], b[3]))
    return g.intersects(a, b, gap) | ((narrow > 0) & (across > 0.5 * narrow) & (apart <= above))


def figure_parts(a: tuple, b: tuple, gap: float = 12.0) -> Column:
    """Boxes that meet, or overlap along one axis and are at most 12 pt apart along the other."""
    h, v = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return g.intersects(a, b) | ((h > 0) & (v >= -gap)) | ((v > 0) & (h >= -gap))


def touching(gap: float) -> Near:
    return lambda a, b: g.intersects(a, b, gap)


def merged(boxes: DataFrame, near: Near, pad: float, extra: list[str] | None = None, max_rounds: int = 30) -> DataFrame:
    """Union boxes of boxes that are near each other, until no two of a page are: (page, extra, box_no, box, parts).

    Boxes of different values of extra never merge. In a round all near pairs of a page merge at once,
    so chains go together in one; near must hold for boxes at most pad apart vertically. box_no is the
    least of the parts'.
    """
    extra = extra or []
    key = [*PAGE, *extra]
    now = written(boxes.select(*key, "box_no", *[F.col(c).cast("double").alias(c) for c in g.BOX], F.lit(1).cast("long").alias("parts")), "boxes")
    for _ in range(max_rounds):
        met = pairs(now, now, (F.col("a_box_no") < F.col("b_box_no")) & near(g.box("a_"), g.box("b_")), pad=pad)
        for c in extra:
            met = met.where(F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")))
        edges = met.select(*PAGE, F.col("a_box_no").alias("a"), F.col("b_box_no").alias("b"))
        label = written(page_components(edges, PAGE), "labels")
        if not label.limit(1).count():
            return now
        joined = now.join(label.withColumnRenamed("n", "box_no"), [*PAGE, "box_no"], "left")
        part = F.coalesce("label", "box_no")
        now = written(joined.groupBy(*key, part.alias("box_no")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("parts").alias("parts")), "boxes")
    raise RuntimeError(f"boxes still merged after {max_rounds} rounds")


def tidied_ignored(boxes: DataFrame, gap: float = 3.0, least: float = 6.0) -> DataFrame:
    """Ignored elements as clusters of each reason, those of 6 by 6 pt and more. boxes(page, box_no, box, reason)."""
    return merged(boxes, touching(gap), gap, ["reason"]).where((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least))


def code_proposals(boxes: DataFrame, gap: float = 2.0, least: float = 10.0) -> DataFrame:
    """Boxes where codes may stand: overlapping ones merged (2 pt), those of 10 by 10 and more."""
    return merged(boxes, touching(gap), gap).where((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least))


_WIDE = 512  # boxes of a page that are compared with each other at once


def _kept(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, drop: Drop) -> np.ndarray:
    """Whether each of a page's boxes, from large to small, stays: no kept one before it drops it."""
    b = np.stack([x0, y0, x1, y1])
    kept = np.ones(len(x0), bool)
    for at in range(0, len(x0), _WIDE):
        block = b[:, at : at + _WIDE]
        for low in range(0, at, _WIDE):
            larger = b[:, low : low + _WIDE][:, kept[low : low + _WIDE]]
            kept[at : at + _WIDE] &= ~drop(larger[:, :, None], block[:, None, :]).any(0)
        drops = drop(block[:, :, None], block[:, None, :])
        # only boxes that drop a later one have to be looked at in order
        for i in np.flatnonzero(np.triu(drops, 1).any(1)):
            if kept[at + i]:
                kept[at + i + 1 : at + _WIDE] &= ~drops[i, i + 1 :]
    return kept


def _largest_first(boxes: DataFrame, drop: Drop) -> DataFrame:
    """Boxes of each page from large to small (then by number) without those that `drop` finds covered
    by a kept one. Some pages at a time are looked through."""

    def run(rows: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        b = [rows[c].to_numpy() for c in g.BOX]
        stays = [_kept(*(c[i:j] for c in b), drop) for i, j in zip(first, np.append(first[1:], len(rows)))]
        return rows.loc[np.concatenate(stays), [*PAGE, "box_no", *g.BOX]]

    kinds = ", ".join(f"{c} {t}" for c, t in boxes.select(*PAGE).dtypes)
    shaped = boxes.select(*PAGE, F.col("box_no").cast("int").alias("box_no"), *[F.col(c).cast("double").alias(c) for c in g.BOX], (-g.area(g.box())).cast("double").alias("k"))
    return by_groups(shaped, PAGE, ["k", "box_no"], run, f"{kinds}, box_no int, x0 double, y0 double, x1 double, y1 double")


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, np.minimum(a[2], b[2]) - np.maximum(a[0], b[0])) * np.maximum(0.0, np.minimum(a[3], b[3]) - np.maximum(a[1], b[1]))


def without_duplicates(boxes: DataFrame, most: float = 0.80) -> DataFrame:
    """Boxes without those whose overlap with a larger kept one is over 0.80 of both together."""
    size = lambda x: (x[2] - x[0]) * (x[3] - x[1])

    def drop(k: np.ndarray, b: np.ndarray) -> np.ndarray:
        shared = _shared(k, b)
        return shared > most * (size(k) + size(b) - shared)

    return _largest_first(boxes, drop)


def without_covered(boxes: DataFrame, share: float = 0.85) -> DataFrame:
    """Boxes without those of which 0.85 or more lies in a larger kept one."""
    return _largest_first(boxes, lambda k, b: _shared(k, b) >= share * ((b[2] - b[0]) * (b[3] - b[1])))


def clean_boundaries(rows: DataFrame, by: list[str], value: str, gap: float = 10.0) -> DataFrame:
    """Each group's positions in order, thinned so that neighbours are at least gap apart; of at most
    two positions all stay. rows(by, value) to (by, positions)."""
    ordered = F.array_sort(F.collect_list(F.col(value).cast("double")))
    step = lambda done, v: F.when(F.size(done) == 0, F.array(v)).when(v - F.element_at(done, -1) >= gap, F.concat(done, F.array(v))).otherwise(done)
    g_ = rows.groupBy(*by).agg(ordered.alias("p"))
    return g_.select(*by, F.when(F.size("p") <= 2, F.col("p")).otherwise(F.aggregate("p", F.expr("CAST(array() AS array<double>)"), step)).alias("positions"))
