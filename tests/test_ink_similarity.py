"""Correlation from runs against NumPy, on random rasters; columns, tables and overlaps on literal rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import columns, ink_collisions, ink_similarity, table_alignment


def runs_of(m):
    for y in range(len(m)):
        edge = np.flatnonzero(np.diff(np.r_[0, m[y].astype(int), 0]))
        yield from ((y, int(a), int(b)) for a, b in zip(edge[::2], edge[1::2]))


def cut(m):
    y, x = np.flatnonzero(m.any(1)), np.flatnonzero(m.any(0))
    return m[y[0] : y[-1] + 1, x[0] : x[-1] + 1].astype(float)


def likeness(m, t):
    if not m.any() and not t.any():
        return None
    if not m.any() or not t.any():
        return 0.0
    m, t = cut(m), cut(t)
    (h, w), best = m.shape, 0.0
    if h > t.shape[0] or w > t.shape[1]:
        t = t[((np.arange(h) + 0.5) * t.shape[0] / h).astype(int)][:, ((np.arange(w) + 0.5) * t.shape[1] / w).astype(int)]
    for y in range(t.shape[0] - h + 1):
        for x in range(t.shape[1] - w + 1):
            p = t[y : y + h, x : x + w]
            a, b = m - m.mean(), p - p.mean()
            n = (a**2).sum() * (b**2).sum()
            if n > 1e-9:
                best = max(best, (a * b).sum() / n**0.5)
    return round(100 * best, 1)


def test_correlation_of_runs(spark):
    rng, pairs = np.random.default_rng(7), []
    for i in range(60):
        t = rng.random((rng.integers(3, 14), rng.integers(3, 16))) < rng.choice([0.2, 0.5, 0.8])
        m = t[1 : 1 + rng.integers(1, 9), 1 : 1 + rng.integers(1, 9)].copy() if i % 2 else rng.random((rng.integers(1, 16), rng.integers(1, 16))) < 0.5
        pairs.append((m ^ (rng.random(m.shape) < 0.1), t))
    blank, solid = np.zeros((4, 4), bool), np.ones((3, 5), bool)
    pairs += [(blank, blank), (blank, solid), (solid, blank), (solid, solid), (pairs[0][1], pairs[0][1])]
    side = lambda k: spark.createDataFrame([(i, *r) for i, p in enumerate(pairs) for r in runs_of(p[k])], "id int, y int, xs int, xe int")
    found = ink_similarity.visual_similarity(spark.range(len(pairs)).selectExpr("CAST(id AS INT) AS id"), side(0), side(1), ["id"])
    got = {r.id: r.visual for r in found.collect()}
    want = {i: likeness(*p) for i, p in enumerate(pairs)}
    assert got.keys() == want.keys() and got[len(pairs) - 1] == 100.0 and got[60] is None
    for i, v in want.items():
        assert got[i] == v if v is None else got[i] == pytest.approx(v, abs=0.11), i


def test_columns_of_literal_pages(spark):
    two = [(2, 50.0, 280.0)] * 8 + [(2, 310.0, 540.0)] * 7
    lines = [(1, 10.0, 100.0)] * 11 + two + [(3, 50.0, 90.0)] * 12 + [(4, 50.0, 500.0)] * 12 + [(5, None, 4.0)] + [(6, 50.0, 280.0)] * 12 + [(6, 300.0, 540.0)] * 3
    got = {r.page: (r["columns"], r.note) for r in columns.detected_columns(spark.createDataFrame(lines, "page int, x0 double, x1 double"), ["page"], spark.createDataFrame([(2, 3)], "page int, tables int")).collect()}
    assert got == {
        1: (1, "11 body line(s) - too few to judge"),
        2: (2, "15 body lines, 3 table(s) excluded, gutters at 281-310pt"),
        3: (1, "text spans too little of the page to judge"),
        4: (1, "12 body lines, no gutter over 9pt"),
        6: (1, "15 body lines; ignored 281-300pt (only 3 line(s) on one side)"),
    }


TABLE = "doc int, table_idx long, page_index int, y double, h double, page_height double, columns int, rows_per_column array<int>, overflow_reasons array<string>"


def test_tables_of_literal_documents(spark):
    low, high, mid = (700.0, 130.0), (40.0, 200.0), (300.0, 100.0)

    def side(rows):
        return spark.createDataFrame([(1, i, p, *at, 842.0, len(r or []), r, o) for i, (p, at, r, o) in enumerate(rows)], TABLE)

    m = side([(0, low, [5, 5], None), (1, high, [4, 4], ["cut"]), (2, mid, [3, 3, 3], []), (3, mid, [9, 9], None), (4, mid, [6], None), (5, mid, None, None)])
    t = side([(0, mid, [8, 8], None), (2, mid, [3, 4, 3], ["out", "cut"]), (3, mid, [1, 1, 1, 1], None), (4, mid, [9, 9], None), (5, mid, [2, 2], None)])
    steps = table_alignment.aligned(m, t, ["doc"])
    labels = spark.createDataFrame([(1, 0, "i"), (1, 1, "ii")], "doc int, page_index int, label string")
    got = table_alignment.report(steps, m, t, ["doc"], labels).orderBy("step").collect()
    assert [(r.table_number, r.status, r.reason, r.master_from, r.target_from, r.merged, r.repeated_header) for r in got] == [
        (1, "PASS", "Cross-page table split match (English 2 page(s), Translated 1 page(s))", 0, 0, [8, 8], True),
        (3, "PASS", "Structure match within tolerance", 2, 1, None, False),
        (3, "EXTRA", "Extra translated table (re-sync)", None, 2, None, False),
        (4, "PASS", "Exact structure match", 3, 3, None, False),
        (5, "DIFFERENT", "Column/row structure does not match", 4, 4, None, False),
        (6, "MISSING", "", 5, None, None, False),
    ]
    assert [(r.sequence_page_number, r.labeled_page_number, r.display_status, r.overflow_reasons, r.colour) for r in got[:3]] == [
        ("Eng P1-P2 | Trans P1", "Eng i-ii | Trans 1", "PASS (Review Overflow)", "cut", "amber"),
        ("Eng P3 | Trans P3", "Eng 3 | Trans 3", "PASS (Review Overflow)", "cut; out", "amber"),
        ("Trans P4", "Trans 4", "EXTRA (Review Structure)", "", "red"),
    ]
    alone = table_alignment.aligned(m, t.limit(0), ["doc"]).collect()
    assert [r.status for r in alone] == ["MISSING"] * 6 and table_alignment.aligned(m.limit(0), t.limit(0), ["doc"]).count() == 0


def test_ink_of_literal_overlaps(spark):
    rows = [
        (1, (0, 0, 60, 10), (5, 2, 60, 12), [(y, 12, 60) for y in range(4, 20)]),  # one line, printed
        (2, (0, 0, 60, 10), (5, 2, 60, 12), []),  # one line, nothing there
        (3, (0, 0, 60, 10), (0, 8, 60, 18), [(12, 0, 90), (13, 0, 90), (16, 0, 90), (17, 0, 90)]),  # white between
        (4, (0, 0, 60, 10), (0, 8, 60, 18), [(y, 0, 90) for y in range(10, 27)]),  # through each other
        (5, (0, 0, 60, 10), (0, 8, 60, 18), [(15, 0, 90)]),  # a single row
        (6, (0, 0, 60, 10), (0, 8, 60, 18), [(y, 0, 2 if y in (16, 17, 18) else 90) for y in range(11, 25)]),  # fringe
        (7, (0, 0, 60, 10), (20, 2, 27, 40), [(10, 45, 50)]),  # crossing
        (8, (0, 0, 60, 10), (59.8, 2, 80, 40), [(10, 45, 50)]),  # hardly a column
    ]
    box = lambda b, p: [float(v) for v in b]
    pairs = spark.createDataFrame([(1, n, 1, 2, *box(a, "a"), *box(b, "b"), 9.0) for n, a, b, _ in rows], "doc_id int, page_no int, a_box_no int, b_box_no int, a_x0 double, a_y0 double, a_x1 double, a_y1 double, b_x0 double, b_y0 double, b_x1 double, b_y1 double, overlap double")
    ink = spark.createDataFrame([(1, n, *r) for n, _, _, runs in rows for r in runs], "doc_id int, page_no int, y int, xs int, xe int")
    got = {r.page_no: (r.collides, r.why) for r in ink_collisions.tested(pairs, ink, 2.0).withColumn("why", F.col("why")).collect()}
    assert got == {
        1: (True, "direct superimposition (8.0 pt vertical overlap on same line)"),
        2: (False, "no ink in the overlap band"),
        3: (False, "1.00 pt of white separates the two lines - the boxes overlap, the letters do not"),
        4: (True, "no white between them (largest gap 0.00 pt) - the ink is printed through itself"),
        5: (False, "negligible ink in overlap band"),
        6: (False, "1.50 pt of daylight separates the lines - only antialiasing fringe in between"),
        7: (True, "cross collision (7.0x8.0 pt intersection with rotated/vertical text)"),
        8: (False, "the boxes share no column of the page"),
    }
