"""Cases of the review's third round, each one wrong before its change."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import boxes, columns, components, figures, ink_collisions, ink_similarity, layout, link_alignment, links, raster, regions, spatial, table_alignment, tables
from tessera.plans import overlaps, registry


@pytest.fixture()
def orders(spark, tmp_path):
    """A folder whose orders are the given (o_orderkey, o_custkey)."""

    def write(rows):
        spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
        return str(tmp_path)

    return write


def test_a_side_alone_is_no_check_of_section_numbers(spark, orders):
    # customers 2 and 3 are a batch with both sides, customer 4 is a master alone
    sf = orders([(0, 2), (0 + 20, 3), (1, 4), (2, 4)])
    found = registry.queries()["u5_findings"](spark, sf).where("source = 'toc'").collect()
    assert [(r.doc_id, r.passed) for r in found] == [(1, True)]
    checks = {r.doc_id: r.checks for r in registry.queries()["a17_verdicts"](spark, sf).collect()}
    assert checks == {1: 2, 2: 2}
    totals = {r.doc_id: (r.passed, r.total) for r in registry.queries()["a15_file_summaries"](spark, sf).collect()}
    assert totals == {1: (2, 2), 2: (0, 2)}


def test_headings_of_large_documents_stay_headings(spark, orders):
    # 15,000 headings of nine characters in one document
    sf = orders([(i, 100 * i) for i in range(15_000)])
    assert registry.queries()["w6_ascending_headings"](spark, sf).count() > 0


@pytest.mark.parametrize(("box", "cut", "covered"), [((1826.0, 12.59, 1854.0, 24.59), 22.79, True), ((3267.0, 8.94, 3315.0, 17.94), 16.59, False)])
def test_shares_of_areas_are_rounded_as_in_sql(spark, box, cut, covered):
    x0, y0, x1, y1 = box
    larger = (x0 - 500, y0 - 500.0, x1 + 500, cut)
    df = spark.createDataFrame([(1, 1, 1, *larger), (1, 1, 2, *box)], "doc_id int, page_no int, box_no int, x0 double, y0 double, x1 double, y1 double")
    assert [r.box_no for r in boxes.without_covered(df).collect()] == ([1] if covered else [1, 2])
    assert df.where("box_no = 2").select(F.expr(f"(x1 - x0) * ({cut} - y0) >= 0.85D * ((x1 - x0) * (y1 - y0))")).first()[0] == covered


def test_pages_are_looked_through_some_at_a_time(spark):
    rng = np.random.default_rng(3)
    rows = [(int(p), int(y), int(x), int(x + w)) for p, y, x, w in zip(rng.integers(0, 9, 400), rng.integers(0, 20, 400), rng.integers(0, 30, 400), rng.integers(1, 12, 400))]
    ink = figures.union(["p"], ink=spark.createDataFrame(rows, "p int, y int, xs int, xe int"))
    found = {}
    for size in ("10000", "7"):  # batches of 7 rows cut pages
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            steps = [figures.labelled(["p"], ink), figures.strokes(["p"], ink, 5), figures.strokes(["p"], ink, 5, 2), figures.thin_rules(["p"], ink, 5)]
            found[size] = [sorted(map(tuple, s.collect())) for s in steps]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found["7"] == found["10000"] and all(found["7"])
    for s in steps:
        assert "FlatMapGroupsInPandas" not in s._jdf.queryExecution().toString()  # one call a page


def test_a_round_of_merging_is_two_tables(spark):
    # a chain of 64 boxes on one page and two that stand alone: one round merges, one finds nothing
    chain = [(1, 1, i, 10.0 * i, 0.0, 10.0 * i + 10, 10.0) for i in range(64)]
    df = spark.createDataFrame([*chain, (1, 1, 99, 0.0, 500.0, 5.0, 505.0), (2, 1, 1, 0.0, 0.0, 5.0, 5.0)], "doc_id int, page_no int, box_no int, x0 double, y0 double, x1 double, y1 double")
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "tessera"
    before = len(list(folder.glob("*")))
    got = sorted((r.doc_id, r.box_no, r.x0, r.x1, r.parts) for r in boxes.merged(df, boxes.touching(2.0), 2.0).collect())
    assert got == [(1, 0, 0.0, 640.0, 64), (1, 99, 0.0, 5.0, 1), (2, 1, 0.0, 5.0, 1)]
    assert len(list(folder.glob("*"))) - before == 4


def test_components_of_pages_equal_those_by_rounds(spark):
    rng = np.random.default_rng(5)
    edges = spark.createDataFrame([(int(k), int(a), int(b)) for k, a, b in zip(rng.integers(0, 7, 120), rng.integers(0, 40, 120), rng.integers(0, 40, 120))], "k int, a long, b long")
    nodes = edges.select("k", F.col("a").alias("n")).union(edges.select("k", "b")).distinct()
    want = sorted(map(tuple, components.connected_components(nodes, edges, ["k"], "n").select("k", "n", "component").collect()))
    for size in ("10000", "5"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert sorted(map(tuple, components.page_components(edges, ["k"]).collect())) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ink_components_take_no_rounds(spark):
    # a diagonal chain of 40 runs and a run that stands alone
    rows = [(1, y, y, y + 1) for y in range(40)] + [(1, 3, 20, 22), (2, 0, 0, 4)]
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "tessera"
    before = len(list(folder.glob("*")))
    got = raster.ink_components(spark.createDataFrame(rows, "doc_id int, y int, xs int, xe int")).collect()
    assert sorted((r.doc_id, r.x0, r.y0, r.x1, r.y1, r.ink) for r in got) == [(1, 0, 0, 40, 40, 40), (1, 20, 3, 22, 4, 2), (2, 0, 0, 4, 1, 4)]
    assert len(list(folder.glob("*"))) == before


def test_region_similarity_makes_no_rows_of_shifts(spark):
    # an L in a page of three runs; events and shifts of pairs of runs are no rows, so nothing is exploded or shuffled but ink
    m = spark.createDataFrame([(1, 5, 0, 1), (1, 6, 0, 3), (2, 0, 0, 2)], "id int, y int, xs int, xe int")
    t = spark.createDataFrame([(1, 0, 7, 9), (1, 1, 4, 5), (1, 2, 4, 7), (3, 0, 0, 2)], "id int, y int, xs int, xe int")
    found = ink_similarity.visual_similarity(spark.range(1, 5).selectExpr("CAST(id AS INT) AS id"), m, t, ["id"])
    assert {r.id: r.visual for r in found.collect()} == {1: 100.0, 2: 0.0, 3: 0.0, 4: None}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" not in plan and plan.count("Window") == 1


@pytest.mark.parametrize("module", [table_alignment.aligned, tables.compared])
def test_document_pairs_are_aligned_some_at_a_time(spark, module):
    # pairs of 1 to 9 tables, pair 3 without a master, pair 4 without a translation; batches of 4 rows cut pairs
    rng = np.random.default_rng(11)
    row = lambda d, i: (d, i, i // 2, 300.0, 100.0, 842.0, 2, [int(v) for v in rng.integers(1, 4, 2)])
    side = lambda alone: spark.createDataFrame([row(d, i) for d in range(12) if d != alone for i in range(1 + d % 9)], "doc int, table_idx long, page_index int, y double, h double, page_height double, columns int, rows_per_column array<int>")
    m, t = side(3), side(4)
    found = {}
    for size in ("10000", "4"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            steps = module(m, t, ["doc"])
            found[size] = sorted(map(str, steps.collect()))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found["4"] == found["10000"]
    assert {r.doc: r.n for r in steps.where("status = 'EXTRA'").groupBy("doc").agg(F.count("*").alias("n")).collect()}[3] == 4
    assert {r.doc: r.n for r in steps.where("status = 'MISSING'").groupBy("doc").agg(F.count("*").alias("n")).collect()}[4] == 5
    plan = steps._jdf.queryExecution().toString()
    assert "InPandas" in plan and "GroupsInPandas" not in plan  # one call a pair


BOXES = "doc_id int, page_no int, box_no int, x0 double, y0 double, x1 double, y1 double"


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_duplicates_of_crowded_pages(spark):
    # 700 boxes on a page, more than are compared at once, and pages of a few
    rng = np.random.default_rng(2)
    page = lambda d, n: [(d, 1, i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(zip(rng.integers(0, 40, n), rng.integers(0, 40, n), rng.integers(8, 14, n), rng.integers(8, 14, n)))]
    rows = [*page(1, 700), *page(2, 3), *page(3, 30)]
    kept = {}
    for r in sorted(rows, key=lambda r: (r[0], -(r[5] - r[3]) * (r[6] - r[4]), r[2])):
        def same(k):
            shared = max(0.0, min(k[5], r[5]) - max(k[3], r[3])) * max(0.0, min(k[6], r[6]) - max(k[4], r[4]))
            return shared > 0.80 * ((k[5] - k[3]) * (k[6] - k[4]) + (r[5] - r[3]) * (r[6] - r[4]) - shared)

        if not any(same(k) for k in kept.setdefault(r[0], [])):
            kept[r[0]].append(r)
    got = boxes.without_duplicates(spark.createDataFrame(rows, BOXES))
    assert sorted(map(tuple, got.collect())) == sorted(r for k in kept.values() for r in k)
    assert sum(map(len, kept.values())) < len(rows) and "aggregate(" not in plan_of(got)  # no fold a page


def test_wrapped_links_of_random_pages(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(d), i, float(x), float(y), float(x + 20), float(y + h), str(i)) for i, (d, x, y, h) in enumerate(zip(rng.integers(0, 5, 120), rng.integers(0, 9, 120) * 30, rng.integers(0, 150, 120), rng.integers(4, 14, 120)))]
    want = {}
    for d, i, x0, y0, x1, y1, text in sorted(rows, key=lambda r: (r[0], r[3], r[2], r[1])):
        found = want.setdefault(d, [])
        on = lambda q: -2 <= y0 - q[5] <= 6 and y0 >= q[3] + (q[5] - q[3]) * 0.5  # noqa: B023, E731
        line = lambda q: min(q[5], y1) - max(q[3], y0) >= 0.5 * min(q[5] - q[3], y1 - y0)  # noqa: B023, E731
        link = next((k for k in found if on(k[-1]) or any(line(q) for q in k)), None)
        if link is None:
            found.append(link := [])
        link.append((d, i, x0, y0, x1, y1, text))
    df = spark.createDataFrame(rows, "d int, seq long, x0 double, y0 double, x1 double, y1 double, text string")
    got = links.merged_links(df, ["d"], [])
    assert sorted((r.d, r.seq, r.text, r.pieces) for r in got.collect()) == sorted((d, k[0][1], " ".join(q[6] for q in k), len(k)) for d, found in want.items() for k in found)
    assert "aggregate(" not in plan_of(got)  # no fold a page
    # the same with few pairs at a time
    y = np.array([[r[3], r[5]] for r in sorted(rows, key=lambda r: (r[0], r[3], r[2], r[1]))])
    first = np.flatnonzero(np.diff(np.sort([r[0] for r in rows]), prepend=-1))
    whole = links._links(first, y[:, 0], y[:, 1])
    monkeypatch.setattr(links, "PAIRS", 7)
    assert (links._links(first, y[:, 0], y[:, 1]) == whole).all()


def test_gutters_make_no_rows_of_bins(spark):
    rows = [(1, 1, 1, 0.0, 0.0, 50.0, 9.0), (1, 1, 2, 10.0, 0.0, 20.0, 9.0), (1, 1, 3, 63.0, 0.0, 70.0, 9.0), (1, 1, 4, 79.0, 0.0, 90.0, 9.0), (1, 1, 5, None, 0.0, 200.0, 9.0)]
    got = layout.gutters(spark.createDataFrame(rows, BOXES))
    assert [(r.x0, r.x1) for r in got.collect()] == [(51.0, 63.0)]
    assert "Generate" not in plan_of(got)


def test_link_tokens_are_matched_some_pairs_at_a_time(spark):
    rows = [(p, s, i, t) for p, (a, b) in enumerate([("abcd", "xbcd"), ("aa", ""), ("", "b"), ("abab", "baba")]) for s, side in enumerate((a, b)) for i, t in enumerate(side)]
    got = link_alignment.matching_blocks(spark.createDataFrame(rows, "p int, side int, place int, token string"), ["p"])
    assert sorted((r.p, r["__a"], r["__b"], r["__size"]) for r in got.collect()) == [(0, 1, 1, 3), (3, 0, 1, 3)]
    assert "InPandas" in plan_of(got) and "GroupsInPandas" not in plan_of(got)


def test_only_letters_that_a_pair_looks_at_become_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(1, 1 + i % 3, i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(zip(rng.integers(0, 300, 90) / 2, rng.integers(0, 300, 90) / 2, rng.integers(20, 60, 90), rng.integers(6, 16, 90)))]
    b = spark.createDataFrame([*rows, (2, 1, 7, 0.0, 0.0, 40.0, 12.0)], BOXES)
    pairs = spatial.collisions(b)
    page = b.selectExpr("doc_id", "page_no", "0 AS a_box_no", "0 AS b_box_no", *[f"{v}D AS {s}_{c}" for s, at in (("a", (-9, -9, 999, 0)), ("b", (-9, 0, 999, 999))) for c, v in zip(("x0", "y0", "x1", "y1"), at)]).distinct()
    some, every = overlaps._letter_rows(b, pairs), overlaps._letter_rows(b, page.withColumn("b_y0", F.lit(-9.0)).withColumn("a_y1", F.lit(999.0)))
    assert 0 < some.count() < every.count() and some.where("doc_id = 2").count() == 0 < every.where("doc_id = 2").count()
    got, want = (sorted(map(str, ink_collisions.tested(pairs, figures.union(spatial.PAGE, ink=ink), 2.0).collect())) for ink in (some, every))
    assert got == want and len(got) > 20


def test_gaps_of_random_pages_take_no_join(spark):
    rng = np.random.default_rng(6)
    rows = [(int(p), float(x), float(x + w)) for p, x, w in zip(rng.integers(0, 6, 240), rng.choice([0, 3, 90, 95, 200, 204], 240), rng.integers(1, 90, 240))] + [(9, 1.0, 2.0)]
    want = {}
    for p in range(6):
        lines = [(a, b) for q, a, b in rows if q == p]
        first, last = min(a for a, _ in lines), max(b for _, b in lines)
        bins = int(last - first) + 1
        free = [sum(int(a - first) <= i <= min(bins - 1, int(b - first)) for a, b in lines) <= int(len(lines) * 0.02) for i in range(bins)]
        edges = np.flatnonzero(np.diff([False, *free, False]))
        gaps = [(first + i, first + j) for i, j in zip(edges[::2], edges[1::2]) if i > 0 and j < bins and j - i >= 9]
        mids = [(a + b) / 2 for a, b in gaps]
        for k, m in enumerate(mids):
            low, high = mids[k - 1] if k else first, mids[k + 1] if k + 1 < len(mids) else last
            want[p, k] = (*gaps[k], sum(a >= low - 1 and b <= m for a, b in lines), sum(a >= m and b <= high + 1 for a, b in lines), sum(a < m < b for a, b in lines))
    df = spark.createDataFrame(rows, "p int, x0 double, x1 double")
    for size in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = {(r.p, r.k): (r.a, r.b, r.left, r.right, r.crossing) for r in columns.judged_gaps(df, ["p"]).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == want and len(want) > 3
    plan = columns.detected_columns(df, ["p"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan  # one of lines, one of gaps


def test_texts_are_measured_on_all_cores(spark):
    rows = spark.createDataFrame([(i, f"turn the key {i}", f"turn a key {i} now") for i in range(64)] + [(64, "a", "A "), (65, "", "x")], "id int, a string, b string").coalesce(1)
    found = regions.similarity(rows, "a", "b")
    assert found.count() == 66 and found.where("match_desc = 'Token Match'").select(F.spark_partition_id().alias("p")).distinct().count() == 4
