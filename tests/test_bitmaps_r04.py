"""Pages as bits against boolean arrays, and ink of several rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import bitmaps as bits
from tessera.operators import figures
from tessera.plans import page_figures
from tessera.sources import bindings

RNG = np.random.default_rng(8)
H, W = 70, 200  # four words a row


def packed(a):
    wide = np.zeros((len(a), 256), np.uint8)
    wide[:, : a.shape[1]] = a
    return np.packbits(wide, axis=1, bitorder="little").view(bits.U64)


def unpacked(m):
    return np.unpackbits(m.view(np.uint8), axis=1, bitorder="little")[:, :W].astype(bool)


def runs_of(a):
    for y, line in enumerate(a):
        edge = np.flatnonzero(np.diff(np.r_[0, line.astype(int), 0]))
        yield from ((y, int(p), int(q)) for p, q in zip(edge[::2], edge[1::2]))


def opened(a, n):
    out = np.zeros_like(a)
    for y, p, q in runs_of(a):
        out[y, p:q] = q - p >= n
    return out


@pytest.mark.parametrize("share", [0.02, 0.5, 0.97])
def test_bits_equal_arrays(share):
    a = RNG.random((H, W)) < share
    a[:6] = a[-6:] = False
    a[:, :6] = a[:, -6:] = False
    m = packed(a)
    for n in (1, 2, 5, 26, 70, 130):
        np.testing.assert_array_equal(unpacked(bits.across(m, n)), opened(a, n))
        np.testing.assert_array_equal(unpacked(bits.upright(m, n)), opened(a.T, n).T)
    for dx, dy in ((0, 0), (1, 1), (2, 2), (5, 3), (0, 1)):
        want = np.zeros_like(a)
        for y in range(-dy, dy + 1):
            for x in range(-dx, dx + 1):
                want |= np.roll(a, (y, x), (0, 1))
        np.testing.assert_array_equal(unpacked(bits.grown(m, dx, dy)), want)
    for k in (3, 64, 70):
        np.testing.assert_array_equal(unpacked(bits.right(m, k))[:, k:], a[:, : W - k])
        np.testing.assert_array_equal(unpacked(bits.left(m, k))[:, : W - k], a[:, k:])
    assert list(zip(*(v.tolist() for v in bits.runs(m)))) == list(runs_of(a))
    assert list(zip(*(v.tolist() for v in bits.column_runs(m)))) == list(runs_of(a.T))
    y0, x0 = RNG.integers(0, H - 9, 40), RNG.integers(0, W - 90, 40)
    y1, x1 = y0 + RNG.integers(1, 9, 40), x0 + RNG.integers(1, 90, 40)
    want = np.zeros_like(a)
    for box in zip(y0, y1, x0, x1):
        want[box[0] : box[1], box[2] : box[3]] = True
    np.testing.assert_array_equal(unpacked(bits.drawn(m.shape, y0, y1, x0, x1)), want)
    assert bits.counts([m], y0, y1, x0, x1)[0].tolist() == [int(a[p:q, r:s].sum()) for p, q, r, s in zip(y0, y1, x0, x1)]


@pytest.fixture(scope="module")
def shapes(spark):
    rng = np.random.default_rng(4)
    rows = []
    for p in range(12):
        x, y = int(rng.integers(-40, 40)), int(rng.integers(-40, 40))  # pages lie anywhere
        rows += [(p, y + 15 * k, y + 15 * k + 2, x + 5, x + 66) for k in range(4)] + [(p, y, y + 50, x + 5 + 20 * k, x + 6 + 20 * k) for k in range(4)]
        rows += [(p, int(a), int(a + h), int(b), int(b + w)) for a, b, h, w in zip(rng.integers(-40, 90, 9), rng.integers(-40, 150, 9), rng.integers(1, 9, 9), rng.integers(1, 40, 9))]
    df = spark.createDataFrame(rows, "p int, y int, ye int, xs int, xe int")
    return df, spark.createDataFrame([(p, 190, 110) for p in range(11)], "p int, width int, height int")


def test_boxes_are_the_rows_they_hold(spark, shapes, monkeypatch):
    boxed, pages = shapes
    single = boxed.select("p", F.explode(F.sequence("y", F.col("ye") - 1)).alias("y"), "xs", "xe")
    grids = figures.grid_regions(["p"], single, 12).withColumnRenamed("part", "region").cache()
    steps = [
        lambda ink: figures.strokes(["p"], ink, 12),
        lambda ink: figures.thin_rules(["p"], ink, 12),
        lambda ink: figures.without_isolated_rules(["p"], ink, pages, 12),
        lambda ink: figures.grid_regions(["p"], ink, 12),
        lambda ink: figures.row_dividers(["p"], ink, grids, 12),
        lambda ink: figures.grid_dividers(["p"], ink, 12),
        lambda ink: figures.ink_clusters(["p"], ink, pages, 0.5),
    ]
    found = [sorted(map(tuple, s(single).collect())) for s in steps]
    assert all(found) and found[4] == found[5]  # a page's own grids, by both ways
    assert found == [sorted(map(tuple, s(boxed).collect())) for s in steps]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # batches cut pages
    try:
        assert found == [sorted(map(tuple, s(boxed).collect())) for s in steps]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("query", ["r4_without_rules", "r6_row_dividers", "r6b_ink_figures", "r6_grid_regions"])
def test_pages_go_through_one_shuffle(spark, query):
    plan = getattr(page_figures, query)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    ink = plan[plan.index("MapInArrow") :]
    pages = query in ("r4_without_rules", "r6b_ink_figures")  # their sizes are distinct rows
    assert ink.count("Exchange") == 1 + pages and "sequence(" not in ink


def test_a_shape_is_worked_out_once(spark):
    shapes, _ = bindings.page_shapes(spark, "/root/testdata/sf0.001")
    plan = shapes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") == 1
