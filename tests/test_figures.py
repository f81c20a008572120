"""Ink as runs against pixels: morphology by shifted arrays and parts by flood fill, on random pages."""

import numpy as np
import pytest

from tessera.operators import figures
from tessera.operators.components import written

KEY, H, W, LENGTH, SCALE = ["page_id"], 90, 110, 14, 0.5


def drawn(rng):
    m = np.zeros((H, W), bool)
    for _ in range(rng.integers(0, 7)):
        y, x = rng.integers(0, H), rng.integers(0, W)
        m[y : y + rng.integers(1, 14), x : x + rng.integers(1, 18)] = True
    for _ in range(rng.integers(0, 6)):
        y, x, thick = rng.integers(0, 8) * 12, rng.integers(0, 40), rng.integers(1, 5)
        m[y : y + thick, x : x + rng.integers(10, 80)] = True
    for _ in range(rng.integers(0, 6)):
        y, x, thick = rng.integers(0, 30), rng.integers(0, 9) * 12, rng.integers(1, 5)
        m[y : y + rng.integers(10, 70), x : x + thick] = True
    m |= rng.random((H, W)) < 0.004
    return m


@pytest.fixture(scope="module")
def pages():
    rng = np.random.default_rng(5)
    blank = np.zeros((H, W), bool)
    rules = blank.copy()
    rules[20:22, 5:100] = rules[50:51, 5:40] = True
    grid = blank.copy()
    grid[10:71:20, 10:91] = grid[10:71, 10:91:20] = True
    return [blank, rules, grid, *(drawn(rng) for _ in range(40))]


def runs_of(m):
    for y in range(len(m)):
        edge = np.flatnonzero(np.diff(np.r_[0, m[y].astype(int), 0]))
        yield from ((y, int(a), int(b)) for a, b in zip(edge[::2], edge[1::2]))


@pytest.fixture(scope="module")
def ink(spark, pages):
    rows = [(i, *r) for i, m in enumerate(pages) for r in runs_of(m)]
    rows += [(0, 3, None, 5), (0, 3, 5, 5), (0, 4, 9, 2)] + [r for r in rows if r[0] == 5]  # no ink, and repeated runs
    return written(spark.createDataFrame(rows, "page_id int, y int, xs int, xe int"), "test-ink")


@pytest.fixture(scope="module")
def sizes(spark, pages):
    return spark.createDataFrame([(i, W, H) for i in range(len(pages))], "page_id int, width int, height int")


def shifted(m, dy, dx):
    out = np.zeros_like(m)
    h, w = m.shape
    out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = m[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    return out


def grown(m, offsets):
    out = np.zeros_like(m)
    for dy, dx in offsets:
        out |= shifted(m, dy, dx)
    return out


def square(dx, dy):
    return [(a, b) for a in range(-dy, dy + 1) for b in range(-dx, dx + 1)]


def opened(m, length):
    """Strokes along rows, along columns."""
    out = []
    for a in (m, m.T):
        keep = np.zeros_like(a)
        for y, s, e in runs_of(a):
            if e - s >= length:
                keep[y, s:e] = True
        out.append(keep)
    return out[0], out[1].T


def parts(m):
    """Masks of the connected parts, by flood fill over eight neighbours."""
    left, found = m.copy(), []
    while left.any():
        todo = [tuple(np.argwhere(left)[0])]
        one = np.zeros_like(m)
        left[todo[0]] = False
        while todo:
            y, x = todo.pop()
            one[y, x] = True
            for b in range(max(0, y - 1), min(m.shape[0], y + 2)):
                for a in range(max(0, x - 1), min(m.shape[1], x + 2)):
                    if left[b, a]:
                        left[b, a] = False
                        todo.append((b, a))
        found.append(one)
    return found


def extent(m):
    y, x = np.flatnonzero(m.any(1)), np.flatnonzero(m.any(0))
    return int(x[0]), int(y[0]), int(x[-1]) + 1, int(y[-1]) + 1


def thin(m, length):
    most, out = max(3, round(length * 0.18)), np.zeros_like(m)
    for stroke, side in zip(opened(m, length), (1, 0)):
        for p in parts(stroke):
            b = extent(p)
            if b[2 + side] - b[side] <= most:
                out |= p
    return out


def stripped(m, length):
    rules = thin(m, length)
    other = m & ~grown(rules, square(2, 2))
    if not other.any():
        return m & ~rules
    near, gone = grown(other, square(2, 2)), np.zeros_like(m)
    for p in parts(rules):
        b = extent(p)
        if not (p & near).any() and max(b[2] - b[0], b[3] - b[1]) >= 0.25 * max(m.shape):
            gone |= p
    return m & ~grown(gone, square(1, 1))


def grids(m, length):
    a, d = opened(m, length)
    cross = grown(a, square(2, 2)) & grown(d, square(2, 2))
    found = []
    for p in parts(grown(a | d, square(1, 1))):
        b, n = extent(p), len(parts(cross & p))
        if n >= 4 and min(b[2] - b[0], b[3] - b[1]) >= 1.5 * length:
            found.append((*b, n))
    return sorted(found)


def dividers(m, box, length):
    sub = m[box[1] : box[3], box[0] : box[2]]
    a, d = opened(sub, length)
    most, full, out = max(3, round(length * 0.18)), sub.shape[1], np.zeros_like(sub)
    for p in parts(a):
        b = extent(p)
        w, h = b[2] - b[0], b[3] - b[1]
        if w >= 0.4 * full and ((w >= 0.7 * full and h <= most) or (w >= 0.95 * full and h <= max(most, round(length / 2))) or w / h >= 20):
            out |= p
    rest = sub & ~(a | d)
    crossed = (grown(out, square(1, 1)) & rest).sum()
    return np.zeros_like(sub) if crossed > 20 and crossed > 0.03 * rest.sum() else out


def clusters(m):
    length, size = max(3, round(26 * SCALE)), max(3, round(10 * SCALE) | 1)
    pad, m = size // 2, m.copy()
    for p in parts(m):
        b = extent(p)
        if b[2] - b[0] <= round(0.12 * W) and (b[0] <= 5 or b[2] >= W - 5):
            m &= ~p
    wide = lambda a: np.pad(a, 20)
    barrier = np.zeros_like(m)
    for g in grids(wide(m), length):
        g = [g[0] - 20, g[1] - 20, g[2] - 20, g[3] - 20]
        inner = np.zeros((g[3] - g[1], g[2] - g[0]), bool)
        big = wide(m)[g[1] + 20 : g[3] + 20, g[0] + 20 : g[2] + 20]
        inner = dividers(big, (0, 0, big.shape[1], big.shape[0]), length)
        page = np.zeros((H + 40, W + 40), bool)
        page[g[1] + 20 : g[3] + 20, g[0] + 20 : g[2] + 20] = inner
        barrier |= page[20:-20, 20:-20]
    barrier = grown(barrier, square(0, 1))
    reach = [(dy, dx) for dy, w in figures.disc(size) for dx in range(-w, w + 1)]
    spread = grown(wide(stripped(m, length)), reach) & ~wide(barrier)
    rules, found = thin(m, length), []
    for p in parts(spread):
        b = extent(p)
        x0, y0, x1, y1 = max(0, b[0] - 20) + pad, max(0, b[1] - 20) + pad, min(W, b[2] - 20) - pad, min(H, b[3] - 20) - pad
        at = np.s_[y0 : min(H, y1 + 1), x0 : min(W, x1 + 1)]
        total = m[at].sum()
        share = rules[at].sum() / total if total else 1
        if not (share >= 0.92 or ((x1 - x0) * (y1 - y0) < 1000 * SCALE**2 and share >= 0.6)):
            found.append((x0, y0, x1, y1))
    return sorted(found)


def masks(df, pages):
    out = [np.zeros((H + 40, W + 40), bool) for _ in pages]
    for r in df.collect():
        assert not out[r.page_id][r.y + 20, r.xs + 20 : r.xe + 20].any()
        out[r.page_id][r.y + 20, r.xs + 20 : r.xe + 20] = True
    return out


def equal(df, pages, want):
    for i, (got, m) in enumerate(zip(masks(df, pages), pages)):
        np.testing.assert_array_equal(got, want(np.pad(m, 20)), str(i))


def test_dilation_and_disc(ink, pages):
    equal(figures.dilated(KEY, ink, 3, 2), pages, lambda m: grown(m, square(3, 2)))
    assert figures.disc(1) == [(0, 0)] and figures.disc(5) == [(-2, 0), (-1, 2), (0, 2), (1, 2), (2, 0)]


def test_thin_rules(ink, pages):
    equal(figures.thin_rules(KEY, ink, LENGTH), pages, lambda m: thin(m, LENGTH))


def test_isolated_rules(ink, sizes, pages):
    got = masks(figures.without_isolated_rules(KEY, ink, sizes, LENGTH), pages)
    for i, m in enumerate(pages):
        np.testing.assert_array_equal(got[i][20:-20, 20:-20], stripped(m, LENGTH), str(i))
    assert not got[1].any() and sum(p.any() and (stripped(p, LENGTH) != p).any() for p in pages) > 10


def test_grids_and_dividers(ink, pages):
    found = figures.grid_regions(KEY, ink, LENGTH).withColumnRenamed("part", "region")
    regions = written(found, "test-grids")
    got = sorted((r.page_id, r.x0, r.y0, r.x1, r.y1, r.junctions) for r in regions.collect())
    want = [(i, *(v - 20 for v in g[:4]), g[4]) for i, m in enumerate(pages) for g in grids(np.pad(m, 20), LENGTH)]
    assert got == sorted(want) and len(got) > 5 and (2, 9, 9, 92, 72, 20) in got
    runs = figures.row_dividers(KEY, ink, regions, LENGTH)
    got = sorted((r.page_id, r.x0, r.y0, r.y + 20, r.xs + 20, r.xe + 20) for r in runs.join(regions, ["page_id", "region"]).collect())
    want = []
    for i, m in enumerate(pages):
        for g in grids(np.pad(m, 20), LENGTH):
            want += [(i, g[0] - 20, g[1] - 20, y + g[1], s + g[0], e + g[0]) for y, s, e in runs_of(dividers(np.pad(m, 20), g, LENGTH))]
    assert got == sorted(want) and got


def test_clusters(ink, sizes, pages):
    found = figures.ink_clusters(KEY, ink, sizes, SCALE)
    got = sorted((r.page_id, r.x0, r.y0, r.x1, r.y1) for r in found.collect())
    assert got == sorted((i, *c) for i, m in enumerate(pages) for c in clusters(m)) and len(got) > 40


def test_no_ink(spark, sizes):
    none = spark.createDataFrame([], "page_id int, y int, xs int, xe int")
    assert figures.ink_clusters(KEY, none, sizes, SCALE).count() == 0
    assert figures.without_isolated_rules(KEY, none, sizes, LENGTH).count() == 0
