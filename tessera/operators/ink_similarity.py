"""How alike two binary rasters are, from the intersections of their runs, at every place of the smaller in the larger.

The pixels that a run of the one shares with a run of the other are a trapezoid over the shift along the row: its second
differences are four events. Events of all pairs of runs are summed by shift, and two running sums give the shared
ink at every shift; the same sums with a full rectangle give the ink under it. Correlation follows from these counts,
so no raster is built. Rasters are trimmed to their ink first. One that does not fit into the other is compared at
one place, the other scaled to its size by the nearest pixel.

The runs of both sides are brought together by key once; events and shifts exist only within a task, for some keys
at a time, so that what is shuffled is the ink alone.

Ink: (key..., y, xs, xe) of each side, disjoint runs, xe exclusive. Two blank sides have nothing to compare: null. One
blank side, or a raster without white, correlates with nothing: 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import by_groups

EVENTS = 1_000_000  # pairs of runs that are summed together


def _counted(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts of each item: the item of each count, and its number within the item from 0."""
    item = np.repeat(np.arange(len(counts)), counts)
    return item, np.arange(len(item)) - np.repeat(counts.cumsum() - counts, counts)


def _scaled_end(a: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The first new pixel whose centre lies at or beyond the old pixel a: ceil(a * new / old - 1/2)."""
    return (2 * a * new + old - 1) // (2 * old)


def _summed(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Running sums of each row of the events; rows: their widths."""
    total = at.cumsum()
    ends = rows.cumsum()
    return total - np.repeat(np.append(0, total[ends[:-1] - 1]), rows)


class _Shifts:
    """A cell for each shift (dy, dx) of each pair of rasters, and for those along the row before shift 0."""

    def __init__(self, w: np.ndarray, h: np.ndarray, wide: np.ndarray, high: np.ndarray):
        self.w, self.most_dx, self.wide, self.high = w, wide - w, wide + 1, high - h + 1
        cells = self.wide * self.high
        self.first, self.cells = cells.cumsum() - cells, int(cells.sum())
        self.rows = np.repeat(self.wide, self.high)

    def events(self, at: np.ndarray, pair: np.ndarray, dy: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> None:
        """Adds the second differences, by shift, of the pixels that [a, b) moved by the shift shares with [c, d)."""
        row, most = self.first[pair] + dy * self.wide[pair] + self.w[pair], self.most_dx[pair]
        for dx, n in ((c - b, 1), (c - a, -1), (d - b, -1), (d - a, 1)):
            seen = dx <= most
            np.add.at(at, (row + dx)[seen], n)

    def pixels(self, at: np.ndarray) -> np.ndarray:
        slope = _summed(at, self.rows)
        return _summed(slope, self.rows) - slope


def _correlations(group: np.ndarray, side: np.ndarray, y: np.ndarray, xs: np.ndarray, xe: np.ndarray, groups: int) -> np.ndarray:
    """The highest correlation of each group's runs of side 0 in those of side 1; 0 where a side is blank. Runs are in order of group, side and y."""
    part = 2 * group + side
    begin = np.flatnonzero(np.append(True, np.diff(part) != 0))
    box = {}
    for name, values in (("left", np.minimum.reduceat(xs, begin)), ("top", y[begin]), ("right", np.maximum.reduceat(xe, begin)), ("bottom", y[np.append(begin[1:], len(y)) - 1] + 1), ("ink", np.add.reduceat(xe - xs, begin)), ("runs", np.diff(np.append(begin, len(y))))):
        box[name] = np.zeros(2 * groups, np.int64)
        box[name][part[begin]] = values
    y, xs, xe = y - box["top"][part], xs - box["left"][part], xe - box["left"][part]
    w, h = ((box[b] - box[a]).reshape(-1, 2) for a, b in (("left", "right"), ("top", "bottom")))
    both = (box["runs"].reshape(-1, 2) > 0).all(1)
    m, t = (both[group] & (side == s) for s in (0, 1))
    fits = (w[:, 0] <= w[:, 1]) & (h[:, 0] <= h[:, 1])
    # rasters too small for the other are stretched to its size
    g, ya, yb, ts, te = group[t], y[t], y[t] + 1, xs[t], xe[t]
    old_w, old_h, new_w, new_h = (np.where(fits[g], whole[g, 1], size[g, k]) for whole, size, k in ((w, w, 1), (h, h, 1), (w, w, 0), (h, h, 0)))
    ya, yb, ts, te = _scaled_end(ya, old_h, new_h), _scaled_end(yb, old_h, new_h), _scaled_end(ts, old_w, new_w), _scaled_end(te, old_w, new_w)
    run, more = _counted(np.where(ts < te, yb - ya, 0))
    tg, ty, ts, te = g[run], ya[run] + more, ts[run], te[run]
    order = np.lexsort((ty, tg))
    tg, ty, ts, te = tg[order], ty[order], ts[order], te[order]

    pairs = np.flatnonzero(both)
    number = np.full(groups, -1)
    number[pairs] = np.arange(len(pairs))
    wide, high = np.where(fits, w[:, 1], w[:, 0])[pairs], np.where(fits, h[:, 1], h[:, 0])[pairs]
    w, h = w[pairs, 0], h[pairs, 0]
    found = np.zeros(groups)
    if not len(pairs):
        return found
    s = _Shifts(w, h, wide, high)
    shared, window = np.zeros(s.cells, np.int64), np.zeros(s.cells, np.int64)

    # runs of the target that a run of the master meets at some shift: those of the rows from its own on
    mg, my, ms, me, tg = number[group[m]], y[m], xs[m], xe[m], number[tg]
    deep = int(high.max()) + 2
    low = np.searchsorted(tg * deep + ty, mg * deep + my, "left")
    count = np.searchsorted(tg * deep + ty, mg * deep + my + (high - h)[mg], "right") - low
    for k in np.split(np.arange(len(mg)), np.flatnonzero(np.diff(count.cumsum() // EVENTS)) + 1):
        i, n = _counted(count[k])
        i = k[i]
        j = low[i] + n
        s.events(shared, mg[i], ty[j] - my[i], ms[i], me[i], ts[j], te[j])
    upper = np.maximum(0, ty - h[tg] + 1)
    count = np.maximum(0, np.minimum(ty, (high - h)[tg]) - upper + 1)
    for k in np.split(np.arange(len(tg)), np.flatnonzero(np.diff(count.cumsum() // EVENTS)) + 1):
        i, n = _counted(count[k])
        i = k[i]
        s.events(window, tg[i], upper[i] + n, np.zeros(len(i), np.int64), w[tg[i]], ts[i], te[i])

    cells = s.wide * s.high
    repeat = lambda v: np.repeat(v, cells)
    a, n = repeat(box["ink"].reshape(-1, 2)[pairs, 0]), repeat(w * h)
    shared, b = s.pixels(shared), s.pixels(window)
    b = np.where(np.arange(s.cells) - np.repeat(s.rows.cumsum() - s.rows, s.rows) < repeat(w), 0, b)  # shifts before 0
    spread = (a * (n - a)).astype(float) * (b * (n - b))
    r = np.divide(n * shared - a * b, np.sqrt(spread), out=np.zeros(s.cells), where=spread > 0)
    found[pairs] = np.maximum.reduceat(r, s.first)
    return found


def visual_similarity(regions: DataFrame, master: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """regions (key) with visual: the highest correlation of the master's ink in the target's, in percent, or null."""
    runs = lambda ink, side: ink.where("xs < xe").select(*key, F.lit(side).alias("side"), *(F.col(c).cast("long").alias(c) for c in ("y", "xs", "xe")))
    kinds = ", ".join(f"{c} {t}" for c, t in master.select(*key).dtypes)

    def run(rows: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))
        side, y, xs, xe = (rows[c].to_numpy(np.int64) for c in ("side", "y", "xs", "xe"))
        return rows[key].iloc[first].reset_index(drop=True).assign(r=_correlations(group, side, y, xs, xe, len(first)))

    best = by_groups(runs(master, 0).union(runs(target, 1)), key, ["side", "y", "xs"], run, f"{kinds}, r double")
    said = F.when(F.col("r").isNotNull(), F.round(100 * F.greatest(F.lit(0.0), F.col("r")), 1))
    return regions.select(*key).join(best, key, "left").select(*key, said.alias("visual"))
