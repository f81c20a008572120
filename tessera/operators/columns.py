"""How many text columns a page runs, and why each gap between lines is a gutter or is none.

Gaps come from a sweep over the ends of a page's lines. A line knows between which gaps it begins and
ends, so it is counted at the few gaps that it lies beside or crosses, and no gap meets all lines. Both are
sums over arrays of some pages at a time; a line is shuffled and sorted once.
Pages without lines have no rows; lines with a null end are no lines.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import by_groups

# fixed values, in points and shares
BIN, GUTTER, SPAN, NOISE = 1.0, 9.0, 60.0, 0.02
MIN_LINES, MIN_SIDE, MIN_SHARE, MIN_WIDTH, MAX_CROSSING = 12, 4, 0.12, 0.15, 0.18
SHOWN = 3


def _gaps(group: np.ndarray, x0: np.ndarray, x1: np.ndarray, n: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The gaps (page, a, b), left to right, of the pages that can be judged: runs of bins of BIN pt, GUTTER wide at least and inside
    the page's text, that NOISE of the lines touch at most. group is the page of each line; n, first, last are the pages'."""
    bins = np.floor((last - first) / BIN).astype(np.int64) + 1
    met = ((n >= MIN_LINES) & (last - first >= SPAN))[group]
    group, x0, x1 = group[met], x0[met], x1[met]
    at = lambda x: np.floor((x - first[group]) / BIN).astype(np.int64)
    where = np.append(np.maximum(0, at(x0)), np.maximum(0, np.minimum(bins[group] - 1, at(x1)) + 1))
    page, step = np.append(group, group), np.repeat([1, -1], len(group))
    order = np.lexsort((where, page))
    page, where, cover = page[order], where[order], step[order].cumsum()  # a page's steps add up to nothing
    here = np.flatnonzero(np.append((np.diff(page) != 0) | (np.diff(where) != 0), True)) if len(page) else np.zeros(0, np.int64)
    page, where, cover = page[here], where[here], cover[here]
    on = np.append(page[1:] == page[:-1], False) & (cover <= np.floor(n * NOISE)[page])
    starts, ends = on & ~np.append(False, on[:-1]), on & ~np.append(on[1:], False)
    page, i, j = page[starts], where[starts], where[np.flatnonzero(ends) + 1]
    wide = (i > 0) & (j < bins[page]) & ((j - i) * BIN >= GUTTER)
    page, i, j = page[wide], i[wide], j[wide]
    return page, first[page] + i * BIN, first[page] + j * BIN


def _sides(group: np.ndarray, x0: np.ndarray, x1: np.ndarray, page: np.ndarray, number: np.ndarray, mid: np.ndarray, pages: int) -> list[np.ndarray]:
    """The lines on the left and right of each gap (up to the next gaps, a point over), and those that cross it."""
    many = np.bincount(page, minlength=pages)
    start = many.cumsum() - many
    met = many[group] > 0
    group, x0, x1 = group[met], x0[met], x1[met]
    begin, begin_near, end, end_near = (np.zeros(len(group), np.int64) for _ in range(4))
    for k in range(int(many.max(initial=0))):
        m = np.full(pages, np.inf)
        m[page[number == k]] = mid[number == k]
        m = m[group]
        begin, begin_near, end, end_near = begin + (m <= x0), begin_near + (m - 1 <= x0), end + (m < x1), end_near + (m + 1 < x1)
    counts = []
    for low, high in ((end, np.minimum(begin_near, many[group] - 1)), (np.maximum(0, end_near - 1), begin - 1), (begin, end - 1)):
        some = low <= high
        change = np.zeros(len(page) + 1, np.int64)
        np.add.at(change, (start[group] + low)[some], 1)
        np.add.at(change, (start[group] + high)[some] + 1, -1)
        counts.append(change.cumsum()[:-1])
    return counts


def _judged(lines: DataFrame, key: list[str]) -> DataFrame:
    """(key, n, first, last, k, a, b, left, right, crossing, why): the gaps of each page from k = 0; a page without gaps has one row
    whose k is null. A page's lines are brought together once, for some pages at a time."""
    lines = lines.where("x0 IS NOT NULL AND x1 IS NOT NULL").select(*key, F.col("x0").cast("double").alias("x0"), F.col("x1").cast("double").alias("x1"))
    kinds = ", ".join(f"{c} {t}" for c, t in lines.select(*key).dtypes)

    def run(rows: pd.DataFrame, begin: np.ndarray) -> pd.DataFrame:
        n = np.diff(np.append(begin, len(rows)))
        group, x0, x1 = np.repeat(np.arange(len(n)), n), rows["x0"].to_numpy(), rows["x1"].to_numpy()
        first, last = np.minimum.reduceat(x0, begin), np.maximum.reduceat(x1, begin)
        page, a, b = _gaps(group, x0, x1, n, first, last)
        number = np.arange(len(page)) - np.searchsorted(page, page)
        left, right, crossing = _sides(group, x0, x1, page, number, (a + b) / 2, len(n))
        none = np.setdiff1d(np.arange(len(n)), page)
        found = pd.DataFrame({"k": number, "a": a, "b": b, "left": left, "right": right, "crossing": crossing}).astype({c: "Int64" for c in ("k", "left", "right", "crossing")})
        found = found.reindex(range(len(page) + len(none)))
        page = np.append(page, none).astype(np.int64)
        return pd.concat([rows[key].iloc[begin[page]].reset_index(drop=True).assign(n=n[page], first=first[page], last=last[page]), found], axis=1)

    met = by_groups(lines, key, ["x0"], run, f"{kinds}, n long, first double, last double, k int, a double, b double, left long, right long, crossing long")
    mid, row = (F.col("a") + F.col("b")) / 2, Window.partitionBy(*key).orderBy("k")
    least = F.least("left", "right")
    low, high = mid - F.coalesce(F.lag(mid).over(row), "first"), F.coalesce(F.lead(mid).over(row), "last") - mid
    why = (
        F.when(least < MIN_SIDE, F.format_string("only %d line(s) on one side", least))
        .when(least / F.col("n") < MIN_SHARE, "one side holds too little of the text")
        .when(F.least(low, high) / (F.col("last") - F.col("first")) < MIN_WIDTH, "one side is too narrow to be a column")
        .when(F.col("crossing") / F.col("n") > MAX_CROSSING, F.format_string("%d line(s) cross it", F.col("crossing")))
    )
    return met.withColumn("why", F.when(F.col("k").isNotNull(), why))


def judged_gaps(lines: DataFrame, key: list[str]) -> DataFrame:
    """Each gap with the lines on its left and right (up to the next gaps, a point over), those that cross it, and why it is no
    gutter (null: it is one)."""
    return _judged(lines, key).where("k IS NOT NULL").select(*key, "k", "a", "b", "left", "right", "crossing", "why")


def detected_columns(lines: DataFrame, key: list[str], tables: DataFrame | None = None) -> DataFrame:
    """(key, columns, note) of each page with lines. tables: (key, tables), how many tables' lines were left out."""
    whole = lambda c: F.bround(c, 0).cast("long").cast("string")
    span = F.concat_ws("-", whole(F.col("a")), whole(F.col("b")))
    one = F.struct("k", F.concat(span, F.lit("pt")).alias("span"), "why")
    listed = F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), one)))
    met = _judged(lines, key).groupBy(*key).agg(*(F.first(c).alias(c) for c in ("n", "first", "last")), listed.alias("all"))
    met = met.withColumn("all", F.when(F.size("all") > 0, F.col("all")))
    met = met.withColumn("tables", F.lit(0)) if tables is None else met.join(tables, key, "left").na.fill(0, ["tables"])
    kept, other = F.filter("all", lambda g: g["why"].isNull()), F.filter("all", lambda g: g["why"].isNotNull())
    shown = lambda gs, f: F.array_join(F.transform(gs, f), "; " if f is _with_reason else ", ")
    note = F.concat(
        F.format_string("%d body lines", "n"),
        F.when(F.col("tables") > 0, F.format_string(", %d table(s) excluded", "tables")).otherwise(""),
        F.when(F.size(kept) > 0, F.concat(F.lit(", gutters at "), shown(kept, lambda g: g["span"]))).otherwise(""),
        F.when(F.size(other) > 0, F.concat(F.lit("; ignored "), shown(F.slice(other, 1, SHOWN), _with_reason))).otherwise(""),
    )
    said = (
        F.when(F.col("n") < MIN_LINES, F.format_string("%d body line(s) - too few to judge", "n"))
        .when(F.col("last") - F.col("first") < SPAN, "text spans too little of the page to judge")
        .when(F.col("all").isNull(), F.format_string(f"%d body lines, no gutter over {GUTTER:.0f}pt", "n"))
        .otherwise(note)
    )
    return met.select(*key, (F.coalesce(F.size(kept), F.lit(0)) + 1).cast("int").alias("columns"), said.alias("note"))


def _with_reason(g: Column) -> Column:
    return F.concat(g["span"], F.lit(" ("), g["why"], F.lit(")"))
