"""Figures, rules and grids from a page's ink, as algebra of run-length rows.

Ink: (key..., y, xs, xe), xe exclusive, runs of a row; key names the page. Runs may have a column ye, the exclusive
end of their rows, and are boxes then, but for union, sweep, dilated and labelled, which take single rows. Union,
intersection and difference are one sweep along each row; a dilation repeats widened runs in the rows it reaches and
merges them. Strokes, rules, grids, dividers and figures see whole pages, as bits: some pages at a time, one below the
other with blank rows between them, so that a page goes through one shuffle. A page is bounded by its size.

Pages without ink have no rows anywhere. Runs that are null, empty or reversed are no ink. Runs that
overlap or repeat count once. Long strokes are runs of the given length within the page; nothing is taken
to lie beyond its edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import bitmaps as bits
from tessera.operators.components import least_labels

# fixed values: shares and sizes of the rules below
THICK_SHARE, MIN_SPAN, MIN_JUNCTIONS = 0.18, 0.25, 4
RULE_PT, GAP_PT, EDGE_PT, EDGE_SHARE = 26.0, 10.0, 10.0, 0.12
DIVIDER_SPAN, DIVIDER_FULL, DIVIDER_LEAST, DIVIDER_ASPECT = 0.70, 0.95, 0.40, 20.0
CROSSING_INK, CROSSING_SHARE = 20, 0.03
RULE_ONLY, SMALL_RULE_ONLY, SMALL_PT2, NESTED = 0.92, 0.60, 1000.0, 0.85
PIXELS = 4_000_000  # of the pages that are looked through together


def sweep(key: list[str], keep: Column, **layers: DataFrame) -> DataFrame:
    """Maximal runs where `keep` holds, a condition over the names of the layers (true where a layer has ink)."""
    events = None
    for name, runs in layers.items():
        ends = F.explode(F.array(F.struct(F.col("xs").alias("x"), F.lit(1).alias("n")), F.struct(F.col("xe").alias("x"), F.lit(-1).alias("n"))))
        one = runs.where("xs < xe").select(*key, "y", ends.alias("e")).select(*key, "y", "e.x", *(F.col("e.n").alias(n) if n == name else F.lit(0).alias(n) for n in layers))
        events = one if events is None else events.union(one)
    if len(layers) > 1:
        events = events.repartition(*key)  # rows of a page stay together in what follows
    row = Window.partitionBy(*key, "y").orderBy("x")
    pieces = events.select(*key, "y", "x", F.lead("x").over(row).alias("to"), *((F.sum(n).over(row) > 0).alias(n) for n in layers))
    pieces = pieces.where(keep & (F.col("to") > F.col("x")))
    new = F.when(F.lag("to").over(row) == F.col("x"), 0).otherwise(1)
    runs = pieces.select(*key, "y", "x", "to", F.sum(new).over(row).alias("run"))
    return runs.groupBy(*key, "y", "run").agg(F.min("x").alias("xs"), F.max("to").alias("xe")).select(*key, "y", "xs", "xe")


def union(key: list[str], **layers: DataFrame) -> DataFrame:
    """Maximal runs of all layers; runs that overlap or touch are one."""
    rows = None
    for runs in layers.values():
        one = runs.where("xs < xe").select(*key, "y", "xs", "xe")
        rows = one if rows is None else rows.union(one)
    if len(layers) > 1:
        rows = rows.repartition(*key)
    row = Window.partitionBy(*key, "y").orderBy("xs").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = F.when(F.col("xs") <= F.max("xe").over(row.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    runs = rows.withColumn("new", new).select(*key, "y", "xs", "xe", F.sum("new").over(row).alias("run"))
    return runs.groupBy(*key, "y", "run").agg(F.min("xs").alias("xs"), F.max("xe").alias("xe")).select(*key, "y", "xs", "xe")


def minus(key: list[str], ink: DataFrame, taken: DataFrame) -> DataFrame:
    return sweep(key, F.col("ink") & ~F.col("taken"), ink=ink, taken=taken)


def common(key: list[str], a: DataFrame, b: DataFrame) -> DataFrame:
    return sweep(key, F.col("a") & F.col("b"), a=a, b=b)


def _spread(key: list[str], ink: DataFrame, reach: list[tuple[int, int]]) -> DataFrame:
    """Runs repeated dy rows off and widened by dx both ways, for each (dy, dx)."""
    at = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in reach)))
    return ink.where("xs < xe").select(*key, "y", "xs", "xe", at.alias("r")).select(*key, (F.col("y") + F.col("r.dy")).alias("y"), (F.col("xs") - F.col("r.dx")).alias("xs"), (F.col("xe") + F.col("r.dx")).alias("xe"))


def dilated(key: list[str], ink: DataFrame, dx: int, dy: int) -> DataFrame:
    """Ink grown by a rectangle of 2 dx + 1 by 2 dy + 1."""
    return union(key, ink=_spread(key, ink, [(d, dx) for d in range(-dy, dy + 1)]))


def disc(size: int) -> list[tuple[int, int]]:
    """Rows and half widths of a filled ellipse in a square of odd size."""
    r = size // 2
    return [(dy, round(r * sqrt((r * r - dy * dy) / (r * r)))) for dy in range(-r, r + 1)] if r else [(0, 0)]


def _labels(y: np.ndarray, xs: np.ndarray, xe: np.ndarray) -> np.ndarray:
    """The least number of a run that each run (in order of y, xs) is connected with, by eight neighbours."""
    n, wide = len(y), int(xe.max(initial=0)) + 2
    y = y - y.min(initial=0)
    first = np.searchsorted((y * wide + xe), (y + 1) * wide + xs, "left")
    last = np.searchsorted((y * wide + xs), (y + 1) * wide + xe, "right")
    count = np.maximum(0, last - first)
    a = np.repeat(np.arange(n), count)
    b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    return least_labels(n, a, b)


def _by_pages(key: list[str], ink: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """run on the ink of some whole pages at a time, in order of y and xs, with n, the run's number in its page, from 1."""

    def in_order(runs: pd.DataFrame) -> pd.DataFrame:
        n = runs["n"].to_numpy()
        order = np.lexsort((runs["xs"].to_numpy(), runs["y"].to_numpy(), (n == 1).cumsum()))
        return runs.iloc[order].reset_index(drop=True).assign(n=n)

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for frame in frames:
            first = np.flatnonzero(frame["n"].to_numpy() == 1)
            if len(first):
                done = pd.concat([*held, frame.iloc[: first[-1]]], ignore_index=True)
                held = []
                if len(done):
                    yield run(in_order(done))
                frame = frame.iloc[first[-1] :]
            held.append(frame)
        if held and len(rest := pd.concat(held, ignore_index=True)):
            yield run(in_order(rest))

    number = F.row_number().over(Window.partitionBy(*key).orderBy(*key))  # brings pages together, in any order
    return ink.where("xs < xe").select(*key, "y", "xs", "xe", number.alias("n")).mapInPandas(whole, schema)


class _Stack:
    """Pages one below the other, with a blank row after each."""

    def __init__(self, runs: pd.DataFrame):
        one = runs["n"].to_numpy() == 1
        self.first, self.page = np.flatnonzero(one), one.cumsum() - 1
        self.y, self.xs, self.xe = (runs[c].to_numpy(np.int64) for c in ("y", "xs", "xe"))
        top = self.y[self.first]
        height = self.y[np.append(self.first[1:], len(runs)) - 1] - top + 2
        self.left = int(self.xs.min())
        self.row = self.y + (height.cumsum() - height - top)[self.page]


def _boxed(y: np.ndarray, xs: np.ndarray, xe: np.ndarray, part: np.ndarray) -> dict[str, np.ndarray]:
    """The box of each run's part."""
    found = {}
    for name, values, f in (("x0", xs, np.minimum), ("y0", y, np.minimum), ("x1", xe, np.maximum), ("y1", y + 1, np.maximum)):
        best = values.copy()
        f.at(best, part, values)
        found[name] = best[part]
    return found


def labelled(key: list[str], ink: DataFrame) -> DataFrame:
    """Runs with part, equal for runs of a page (group of key) that are connected, diagonals included, and the part's box."""

    def run(runs: pd.DataFrame) -> pd.DataFrame:
        s = _Stack(runs)
        part = _labels(s.row, s.xs - s.left, s.xe - s.left)
        return runs.assign(**_boxed(s.y, s.xs, s.xe, part), part=part - s.first[s.page])[[*key, "y", "xs", "xe", "part", "x0", "y0", "x1", "y1"]]

    kinds = ", ".join(f"{c} {t}" for c, t in ink.select(*key, "y", "xs", "xe").dtypes)
    return _by_pages(key, ink, run, f"{kinds}, part long, x0 int, y0 int, x1 int, y1 int")


def extents(key: list[str], parts: DataFrame) -> DataFrame:
    """The parts and their boxes, one row each."""
    return parts.select(*key, "part", "x0", "y0", "x1", "y1").distinct()


@dataclass
class _Pages:
    """Ink of some pages as bits, their sizes (nan where unknown), and regions: page, box in pixels and row of the table."""

    s: bits.Sheets
    m: np.ndarray
    width: np.ndarray
    height: np.ndarray
    regions: dict[str, np.ndarray]


_KINDS = {"tinyint": np.int8, "smallint": np.int16, "int": np.int32, "bigint": np.int64}
_SHAPE = ["kind", "a", "b", "c", "d"]


def _as_bits(key: list[str], ink: DataFrame, run: Callable[[_Pages], tuple], columns: str, edge: int, pages: DataFrame | None = None, regions: DataFrame | None = None) -> DataFrame:
    """run on some whole pages at a time: the page of each row found and its columns, after the key.

    Where there are regions the first of the columns is `region`, for which run gives places among the regions.
    pages: (key, width, height); regions: (key, region, x0, y0, x1, y1).
    """

    def rows(df: DataFrame, kind: int, *shape: Column) -> DataFrame:
        named = [F.lit(kind).cast("tinyint").alias("kind"), *(c.cast("int").alias(n) for c, n in zip(shape, "abcd"))]
        region = [] if regions is None else [F.col("region") if kind == 2 else F.lit(None).cast(regions.schema["region"].dataType).alias("region")]
        return df.select(*key, *named, *region)

    ye = F.col("ye") if "ye" in ink.columns else F.col("y") + 1
    given = rows(ink.where("xs < xe").where(F.col("y") < ye), 0, F.col("y"), ye, F.col("xs"), F.col("xe"))
    if pages is not None:
        given = given.unionByName(rows(pages, 1, F.coalesce("width", F.lit(-1)), F.coalesce("height", F.lit(-1)), F.lit(0), F.lit(0)))
    if regions is not None:
        given = given.unionByName(rows(regions.where("x0 < x1 AND y0 < y1"), 2, *(F.col(c) for c in ("y0", "y1", "x0", "x1"))))
    kinds, within = [k.strip().rsplit(" ", 1) for k in columns.split(",")], regions is not None

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        n, kind, a, b, c, d = (table.column(x).to_numpy() for x in ("n", *_SHAPE))
        a, b, c, d = (v.astype(np.int64) for v in (a, b, c, d))
        at = np.flatnonzero(n == 1)
        page, inked = (n == 1).cumsum() - 1, kind == 0
        has = np.flatnonzero(np.bincount(page[inked], minlength=len(at)))  # pages without ink have no rows
        if not len(has):
            return
        place = np.full(len(at), -1)
        place[has] = np.arange(len(has))
        at, page = at[has], place[page]
        todo = [(0, len(at))]
        while todo:
            lo, hi = todo.pop()
            some = (page >= lo) & (page < hi)
            i = np.flatnonzero(some & inked)
            s = bits.Sheets(page[i] - lo, a[i], b[i], c[i], d[i], edge)
            if hi - lo > 1 and s.shape[0] * s.shape[1] * 64 > PIXELS:
                todo += [((lo + hi) // 2, hi), (lo, (lo + hi) // 2)]
                continue
            size = np.full((2, hi - lo), np.nan)
            k = np.flatnonzero(some & (kind == 1))
            size[:, page[k] - lo] = np.where((sides := np.array([a[k], b[k]])) < 0, np.nan, sides)
            k = np.flatnonzero(some & (kind == 2))
            met = dict(zip(("page", "y0", "y1", "x0", "x1", "row"), (page[k] - lo, a[k], b[k], c[k], d[k], k)))
            rows = run(_Pages(s, s.drawn(page[i] - lo, a[i], b[i], c[i], d[i]), *size, met))
            if not len(rows[0]):
                continue
            out = [table.column(x).take(pa.array(at[lo + rows[0]])) for x in key]
            for (name, kind_of), v in zip(kinds, rows[1:]):
                out.append(table.column("region").take(pa.array(met["row"][v])) if within and name == "region" else pa.array(v if kind_of == "boolean" else v.astype(_KINDS[kind_of])))
            yield from pa.table(out, names=[*key, *(k for k, _ in kinds)]).to_batches()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            first = np.flatnonzero(batch.column("n").to_numpy() == 1)
            if len(first):
                done = [*held, batch.slice(0, first[-1])]
                if sum(x.num_rows for x in done):
                    yield from found(pa.Table.from_batches(done))
                held, batch = [], batch.slice(first[-1])
            held.append(batch)
        if sum(x.num_rows for x in held):
            yield from found(pa.Table.from_batches(held))

    number = F.row_number().over(Window.partitionBy(*key).orderBy(*key)).alias("n")  # brings pages together, in any order
    schema = ", ".join([*(f"{c} {dict(ink.dtypes)[c]}" for c in key), columns])
    # shapes are small for the work they make, so they go to as many tasks as a shuffle has, not to fewer by their size
    given = given.repartition(int(ink.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    return given.select("*", number).mapInArrow(whole, schema)


def _runs_of(ink: DataFrame) -> str:
    kinds = dict(ink.dtypes)
    return ", ".join(f"{c} {kinds[c]}" for c in ("y", "xs", "xe"))


def _span(lo: np.ndarray, hi: np.ndarray, part: np.ndarray) -> np.ndarray:
    """How far each one's part reaches."""
    low, high = lo.copy(), hi.copy()
    np.minimum.at(low, part, lo)
    np.maximum.at(high, part, hi)
    return (high - low)[part]


def _placed(s: bits.Sheets, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Page, y, xs and xe of runs."""
    page = s.page(row)
    return page, row - s.shift[page], start + s.left, end + s.left


def _strokes(m: np.ndarray, length: int, thick: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the strokes along rows, and of those along columns; with thick, only of those whose connected ones of their
    direction are at most as thick."""
    if thick is None:
        return bits.across(m, length), bits.upright(m, length)
    row, start, end = bits.runs(m)
    long = end - start >= length
    row, start, end = row[long], start[long], end[long]
    thin = _span(row, row + 1, _labels(row, start, end)) <= thick
    level = bits.drawn(m.shape, row[thin], row[thin] + 1, start[thin], end[thin])
    column, top, bottom = bits.column_runs(bits.upright(m, length))
    thin = _span(column, column + 1, _labels(column, top, bottom)) <= thick
    return level, bits.drawn(m.shape, top[thin], bottom[thin], column[thin], column[thin] + 1)


def strokes(key: list[str], ink: DataFrame, length: int, thick: int | None = None) -> DataFrame:
    """Ink in straight runs of at least length pixels, as runs of rows: (key, down, y, xs, xe), down: along columns.

    With thick, strokes stay that are connected, among those of one direction, to nothing that is thicker across.
    """

    def run(p: _Pages) -> tuple:
        sides = [_placed(p.s, *bits.runs(m)) for m in _strokes(p.m, length, thick)]
        page, *rows = (np.concatenate(v) for v in zip(*sides))
        return page, np.repeat([False, True], [len(v[0]) for v in sides]), *rows

    return _as_bits(key, ink, run, f"down boolean, {_runs_of(ink)}", 0)


def thin_rules(key: list[str], ink: DataFrame, length: int, thick: int | None = None) -> DataFrame:
    """Strokes that are long and thin: connected ones of one direction, at most thick across (3, or 0.18 of the length).

    A filled disc has long runs through its middle as well, but they are connected to something thick.
    """
    thick = _thick(length) if thick is None else thick

    def run(p: _Pages) -> tuple:
        level, upright = _strokes(p.m, length, thick)
        return _placed(p.s, *bits.runs(level | upright))

    return _as_bits(key, ink, run, _runs_of(ink), 0)


def _thick(length: int) -> int:
    return max(3, round(length * THICK_SHARE))


def _without_isolated(p: _Pages, m: np.ndarray, rules: np.ndarray) -> np.ndarray:
    other = m & ~bits.grown(rules, 2, 2)
    marked = p.s.marked(other)
    row, start, end = bits.runs(rules)
    part, page = _labels(row, start, end), p.s.page(row)
    attached = np.zeros(len(row), bool)
    wide = m.shape[1] * 64
    hit = bits.runs(rules & bits.grown(other, 2, 2))
    attached[part[np.searchsorted(row * wide + start, hit[0] * wide + hit[1], "right") - 1]] = True
    far = np.maximum(_span(start, end, part), _span(row, row + 1, part)) >= MIN_SPAN * np.fmax(p.width, p.height)[page]
    alone, bare = ~attached[part] & far & marked[page], ~marked[page]
    gone = bits.grown(bits.drawn(m.shape, row[alone], row[alone] + 1, start[alone], end[alone]), 1, 1)
    return m & ~gone & ~bits.drawn(m.shape, row[bare], row[bare] + 1, start[bare], end[bare])


def without_isolated_rules(key: list[str], ink: DataFrame, pages: DataFrame, length: int) -> DataFrame:
    """Ink without the rules that touch nothing else and span a quarter of the page.

    What lies within two pixels of a rule is its own fringe; a rule is attached if other ink comes within two
    pixels of it. Where a page holds rules only, all of them go. pages: (key, width, height) in pixels.
    """

    def run(p: _Pages) -> tuple:
        level, upright = _strokes(p.m, length, _thick(length))
        return _placed(p.s, *bits.runs(_without_isolated(p, p.m, level | upright)))

    return _as_bits(key, ink, run, _runs_of(ink), 2, pages)


def _grids(s: bits.Sheets, m: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Page, part, box (rows and columns of the bits) and junctions of the ruled grids."""
    level, upright = _strokes(m, length)
    lines = bits.grown(level | upright, 1, 1)
    row, start, end = bits.runs(lines)
    part, page = _labels(row, start, end), s.page(row)
    places = bits.runs(bits.grown(level, 2, 2) & bits.grown(upright, 2, 2) & lines)
    one = np.flatnonzero(_labels(*places) == np.arange(len(places[0])))  # a run of each place
    wide = m.shape[1] * 64
    junctions = np.bincount(part[np.searchsorted(row * wide + start, places[0][one] * wide + places[1][one], "right") - 1], minlength=len(row))
    box = _boxed(row, start, end, part)
    side = length * 1.5
    good = (part == np.arange(len(row))) & (junctions >= MIN_JUNCTIONS) & (box["x1"] - box["x0"] >= side) & (box["y1"] - box["y0"] >= side)
    first = np.searchsorted(page, page)  # of the page's runs
    return {"page": page[good], "part": (part - first)[good], **{c: v[good] for c, v in box.items()}, "junctions": junctions[good]}


def grid_regions(key: list[str], ink: DataFrame, length: int) -> DataFrame:
    """Boxes of ruled grids: (key, part, x0, y0, x1, y1, junctions).

    A grid is one connected lattice of long strokes, 1.5 lengths each way at least, in which strokes along
    rows meet strokes along columns at MIN_JUNCTIONS places or more. Places are counted within each lattice,
    as connected crossings; a stroke may stop two pixels short of a crossing.
    """

    def run(p: _Pages) -> tuple:
        g = _grids(p.s, p.m, length)
        shift = p.s.shift[g["page"]]
        return g["page"], g["part"], g["x0"] + p.s.left, g["y0"] - shift, g["x1"] + p.s.left, g["y1"] - shift, g["junctions"]

    return _as_bits(key, ink, run, "part bigint, x0 int, y0 int, x1 int, y1 int, junctions bigint", 2)


def row_dividers(key: list[str], ink: DataFrame, regions: DataFrame, length: int) -> DataFrame:
    """Runs (key, region, y, xs, xe) of the strokes that divide the rows of a grid.

    A divider spans 0.7 of its region and is thin, or 0.95 and is half a length thick at most, or 0.4 and is
    twenty times as long as thick. Where other ink crosses the dividers (over 20 pixels and 3 % of it) the
    region is a drawing, and has none. regions: (key, region, x0, y0, x1, y1).
    """

    def run(p: _Pages) -> tuple:
        g, shift = p.regions, p.s.shift[p.regions["page"]]
        low, high = np.append(0, p.s.end)[g["page"]], p.s.end[g["page"]]  # what lies beyond the page's ink holds none
        y0, y1 = np.clip(g["y0"] + shift, low, high), np.clip(g["y1"] + shift, low, high)
        x0, x1 = (np.clip(g[c] - p.s.left, 0, p.m.shape[1] * 64) for c in ("x0", "x1"))
        n, row, start, end = _dividers(p.m, y0, y1, x0, x1, g["x1"] - g["x0"], length)
        page, *rows = _placed(p.s, row, start, end)
        return page, n, *rows

    kind = dict(regions.dtypes)["region"]
    return _as_bits(key, ink, run, f"region {kind}, {_runs_of(ink)}", 1, regions=regions)


def grid_dividers(key: list[str], ink: DataFrame, length: int) -> DataFrame:
    """row_dividers in the page's own grids; region: their part among grid_regions."""

    def run(p: _Pages) -> tuple:
        g = _grids(p.s, p.m, length)
        n, row, start, end = _dividers(p.m, g["y0"], g["y1"], g["x0"], g["x1"], g["x1"] - g["x0"], length)
        page, *rows = _placed(p.s, row, start, end)
        return page, g["part"][n], *rows

    return _as_bits(key, ink, run, f"region bigint, {_runs_of(ink)}", 2)


def _dividers(m: np.ndarray, r0: np.ndarray, r1: np.ndarray, c0: np.ndarray, c1: np.ndarray, full: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Region, row, start and end of the runs that divide the rows of each region (rows and columns of the bits)."""
    high = r1 - r0
    last = (high + 3).cumsum()  # regions go one below the other
    begin = last - high - 3
    region = np.repeat(np.arange(len(high)), high)
    i = np.arange(int(high.sum())) - np.repeat(high.cumsum() - high, high)
    word = 64 * np.arange(m.shape[1])
    lo, hi = np.clip(c0[:, None] - word, 0, 64), np.clip(c1[:, None] - word, 0, 64)
    mask = np.where(lo < hi, (bits.ALL << np.minimum(lo, 63).astype(bits.U64)) & (bits.ALL >> np.minimum(64 - hi, 63).astype(bits.U64)), bits.U64(0))
    inner = np.zeros((int(last[-1]) if len(last) else 0, m.shape[1]), bits.U64)
    inner[begin[region] + i] = m[r0[region] + i] & mask[region]
    row, start, end = bits.runs(inner)
    long = end - start >= length
    row, start, end = row[long], start[long], end[long]
    part, at = _labels(row, start, end), np.searchsorted(last, row, "right")
    w, h, full, thick = _span(start, end, part), _span(row, row + 1, part), full[at], _thick(length)
    good = (w >= DIVIDER_LEAST * full) & (((w >= DIVIDER_SPAN * full) & (h <= thick)) | ((w >= DIVIDER_FULL * full) & (h <= max(thick, round(length * 0.5)))) | (w >= DIVIDER_ASPECT * h))
    rest = inner & ~bits.across(inner, length) & ~bits.upright(inner, length)
    near = bits.grown(bits.drawn(inner.shape, row[good], row[good] + 1, start[good], end[good]), 1, 1)
    total = lambda x: np.add.reduceat(np.bitwise_count(x).sum(1, dtype=np.int64), begin) if len(begin) else np.zeros(0, np.int64)
    crossed, drawing = total(near & rest), total(rest)
    good &= ~((crossed > CROSSING_INK) & (crossed > CROSSING_SHARE * drawing))[at]
    at, row = at[good], row[good]
    return at, row - begin[at] + r0[at], start[good], end[good]


def _without_edges(p: _Pages, m: np.ndarray, scale: float) -> np.ndarray:
    """Ink without connected parts at the left or right edge that are at most 0.12 of the page wide, and without pages of unknown size."""
    row, start, end = bits.runs(m)
    part, width = _labels(row, start, end), p.width[p.s.page(row)]
    box, edge = _boxed(row, start, end, part), round(EDGE_PT * scale)
    gone = (box["x1"] - box["x0"] <= np.rint(width * EDGE_SHARE)) & ((box["x0"] + p.s.left <= edge) | (box["x1"] + p.s.left >= width - edge)) | np.isnan(width)
    return m & ~bits.drawn(m.shape, row[gone], row[gone] + 1, start[gone], end[gone])


def ink_clusters(key: list[str], ink: DataFrame, pages: DataFrame, scale: float) -> DataFrame:
    """Whole figures of each page: (key, part, x0, y0, x1, y1) in pixels, one per group of ink with gaps under GAP_PT.

    Edge furniture goes first, then rules that stand alone; grids' row dividers keep their rows apart; what is only
    ruling is no figure. scale: pixels a point.
    Figures of which over NESTED lies in a larger kept one go with boxes.without_covered.
    """
    length, size = max(3, round(RULE_PT * scale)), max(3, round(GAP_PT * scale) | 1)
    pad = size // 2

    def run(p: _Pages) -> tuple:
        s, m = p.s, _without_edges(p, p.m, scale)
        g = _grids(s, m, length)
        level, upright = _strokes(m, length, _thick(length))
        rules = level | upright
        left, grown = _without_isolated(p, m, rules), np.zeros_like(m)
        wide = [left]
        for _ in range(pad):
            wide.append(bits.grown(wide[-1], 1, 0))
        for dy, dx in disc(size):
            grown |= bits.down(wide[dx], dy)
        _, row, start, end = _dividers(m, g["y0"], g["y1"], g["x0"], g["x1"], g["x1"] - g["x0"], length)
        grown &= ~bits.grown(bits.drawn(m.shape, row, row + 1, start, end), 0, 1)
        row, start, end = bits.runs(grown)
        part, page = _labels(row, start, end), s.page(row)
        one = np.flatnonzero(part == np.arange(len(row)))
        box, first = {c: v[one] for c, v in _boxed(row, start, end, part).items()}, np.searchsorted(page, page)[one]
        part, page = part[one] - first, page[one]
        # the page ends where it ends, so its growth does
        x0, y0 = np.maximum(0, box["x0"] + s.left) + pad, np.maximum(0, box["y0"] - s.shift[page]) + pad
        x1 = np.fmin(p.width[page], box["x1"] + s.left).astype(np.int64) - pad
        y1 = np.fmin(p.height[page], box["y1"] - s.shift[page]).astype(np.int64) - pad
        low, high = np.append(0, s.end)[page], s.end[page]
        r0, r1 = np.clip(y0 + s.shift[page], low, high), np.clip(np.fmin(p.height[page], y1 + 1).astype(np.int64) + s.shift[page], low, high)
        c0, c1 = np.clip(x0 - s.left, 0, m.shape[1] * 64), np.clip(np.fmin(p.width[page], x1 + 1).astype(np.int64) - s.left, 0, m.shape[1] * 64)
        some, inked, ruled = (r0 < r1) & (c0 < c1), np.zeros(len(one)), np.zeros(len(one))
        inked[some], ruled[some] = bits.counts([m, rules], r0[some], r1[some], c0[some], c1[some])
        share = np.where(inked == 0, 1.0, ruled / np.maximum(inked, 1))
        good = (share < RULE_ONLY) & (((x1 - x0) * (y1 - y0) >= SMALL_PT2 * scale * scale) | (share < SMALL_RULE_ONLY))
        return tuple(v[good] for v in (page, part, x0, y0, x1, y1))

    return _as_bits(key, ink, run, "part bigint, x0 int, y0 int, x1 int, y1 int", max(2, pad), pages)
