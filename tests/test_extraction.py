"""Links, outlines, merged boxes, page differences and region modes against loops and literal rows."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import boxes as bx
from tessera.operators import links as lk
from tessera.operators import inspection, page_diff, placement, summaries
from tessera.operators import region_checks as rc
from tessera.operators import outline as ol

BOXES = "doc_id int, page_no int, box_no int, x0 double, y0 double, x1 double, y1 double"


def test_wrapped_links_against_a_loop(spark):
    rng = np.random.RandomState(3)
    rows = [(1, 1, i, f"t{rng.randint(3)}", f"w{i}", *(x := np.round(rng.rand(2) * [80, 60], 1).tolist()), x[0] + 20.0, x[1] + 8.0) for i in range(60)]
    got = lk.merged_links(spark.createDataFrame(rows, "doc_id int, page_no int, seq long, target string, text string, x0 double, y0 double, x1 double, y1 double"), ["doc_id", "page_no"], ["target"]).collect()
    want = []
    for r in sorted(rows, key=lambda r: (round(r[6], 1), r[5], r[2])):
        for q in want:
            last = q[-1]
            near = -2 <= r[6] - last[8] <= 6 and r[6] >= last[6] + (last[8] - last[6]) * 0.5
            level = any(min(p[8], r[8]) - max(p[6], r[6]) >= 0.5 * min(p[8] - p[6], r[8] - r[6]) for p in q)
            if q[0][3] == r[3] and (near or level):
                q.append(r)
                break
        else:
            want.append([r])
    assert sorted((r.target, r.seq, r.text, r.pieces) for r in got) == sorted((q[0][3], q[0][2], " ".join(p[4] for p in q), len(q)) for q in want)


def test_link_targets(spark):
    rows = [("uri", "https://a", -1, None), ("goto", None, 4, None), ("goto", None, 4, "fig"), ("named", None, -1, "fig"), ("launch", "a.zip", -1, None), ("other", None, 0, None)]
    got = [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, u string, p int, n string").orderBy("i").select(*lk.target_type(F.col("k"), F.col("u"), F.col("p"), F.col("n"))).collect()]
    assert got == [("external", "https://a"), ("internal", "page 5"), ("internal", "page 5 (fig)"), ("internal", "fig"), ("file", "a.zip"), (None, None)]


def test_outline_places(spark):
    rows = [(1, 1, 2, 700.0, 842.0, "1", "a"), (1, 2, 2, 400.0, 842.0, "2", "b"), (1, 3, 1, 300.0, 842.0, "3", "c"), (1, 4, 2, 800.0, 842.0, "4", "d")] + [(2, i, i, 36.0, 842.0, str(i), "t") for i in range(1, 5)]
    o = spark.createDataFrame(rows, "d int, seq int, page_no int, raw_y double, page_height double, code string, title string")
    printed = spark.createDataFrame([(1, 2, 410.0, "2", "b"), (3, 7, 5.0, "9", "z")], "d int, page_no int, y double, code string, title string")
    assert {(r.d, r.generic) for r in ol.generic_destinations(o, ["d"]).collect()} == {(1, False), (2, True)}
    got = sorted((r.d, r.code, r.page_no, round(r.y, 3)) for r in ol.topics_with_positions(o, printed, ["d"]).collect())
    assert got == [(1, "1", 2, 142.0), (1, "2", 2, 410.0), (1, "3", 2, 410.1), (1, "4", 2, 410.2), (2, "1", 1, 0.0), (2, "2", 2, 0.0), (2, "3", 3, 0.0), (2, "4", 4, 0.0), (3, "9", 7, 5.0)]
    spans = spark.createDataFrame([(1, 1, 9.0, "ab"), (1, 2, 12.0, "cd"), (2, 1, 8.0, "x")], "line int, span_no int, size double, text string")
    assert {(r.line, r.size) for r in ol.line_sizes(spans, ["line"]).collect()} == {(1, 9.0), (2, 8.0)}


def merged_by_loop(rects, near):
    while True:
        for i, a in enumerate(rects):
            j = next((j for j in range(i + 1, len(rects)) if near(a, rects[j])), None)
            if j is not None:
                b = rects.pop(j)
                rects[i] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
                break
        else:
            return rects


def test_figures_merge_to_the_fixpoint(spark):
    rng = np.random.RandomState(7)
    rows = [(1, p, i, *(x := np.round(rng.rand(2) * 700, 1).tolist()), x[0] + 20.0, x[1] + 15.0) for p in (1, 2) for i in range(1, 45)]
    df = spark.createDataFrame(rows, BOXES)

    def near(a, b):
        h, v = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        return (h > 0 and v > 0) or (h > 0 and v >= -12) or (v > 0 and h >= -12)

    got = bx.merged(df, bx.figure_parts, 12.0).collect()
    for p in (1, 2):
        assert sorted((r.x0, r.y0, r.x1, r.y1) for r in got if r.page_no == p) == sorted(merged_by_loop([r[3:] for r in rows if r[1] == p], near))
    assert sum(r.parts for r in got) == len(rows)
    ignored = bx.tidied_ignored(df.withColumn("reason", F.when(F.col("box_no") % 2 == 0, "left").otherwise("right")))
    assert {r.reason for r in ignored.collect()} == {"left", "right"}
    alone = bx.merged(df, bx.touching(2.0), 2.0).collect()
    touch = lambda a, b: a[0] < b[2] + 2 and b[0] - 2 < a[2] and a[1] < b[3] + 2 and b[1] - 2 < a[3]
    assert sorted((r.x0, r.y0, r.x1, r.y1) for r in alone if r.page_no == 1) == sorted(merged_by_loop([r[3:] for r in rows if r[1] == 1], touch))


def test_page_differences(spark):
    a, b, c, d, e = ([float((i * k) % 17) for i in range(16)] for k in (1, 3, 5, 7, 11))
    cols = "doc int, page_no int, no long, x0 double, y0 double, x1 double, y1 double, pixels array<double>"
    box = lambda x, y, s=50.0: (x, y, x + s, y + s)
    m = spark.createDataFrame([(1, 2, 1, *box(0.0, 0.0), a), (1, 2, 2, *box(100.0, 0.0), b), (1, 2, 3, *box(200.0, 0.0), c), (1, 2, 4, *box(300.0, 0.0), d), (1, 3, 5, *box(0.0, 0.0), e)], cols)
    t = spark.createDataFrame([(1, 2, 11, *box(0.0, 90.0), a), (1, 2, 12, *box(120.0, 0.0), b), (1, 3, 13, *box(0.0, 0.0), c), (1, 2, 15, *box(400.0, 400.0), e)], cols)
    mapped = spark.createDataFrame([(1, 2, 2)], "doc int, page_no int, target_page int")
    diffs = page_diff.page_differences(m, t, mapped, ["doc"])
    assert sorted((r.kind, r.m or 0, r.t or 0, r.near_page or 0) for r in diffs.collect()) == [("missing", 4, 0, 0), ("moved", 2, 12, 0), ("reflowed", 0, 15, 3), ("reflowed", 3, 0, 3)]
    pages = spark.createDataFrame([(1, 2, 4), (1, 9, 2)], "doc int, page_no int, graphics int")
    got = {r.page_no: r.summary for r in page_diff.difference_counts(diffs, ["doc", "page_no"], pages).collect()}
    assert got == {2: "4 differences — 1 missing from the translation, 1 moved, 2 moved to an adjacent page", 9: "No differences - all 2 graphic(s) matched"}


def test_claims_largest_first(spark):
    scores = spark.createDataFrame([(1, 1, 7, 0.95), (1, 2, 7, 0.99), (1, 2, 8, 0.85), (1, 3, 8, 0.5)], "p int, m long, t long, score double")
    sizes = spark.createDataFrame([(1, 1, 900.0), (1, 2, 100.0), (1, 3, 5000.0)], "p int, m long, area double")
    assert {(r.m, r.t) for r in page_diff.claims(scores, sizes, ["p"]).collect()} == {(1, 7), (2, 8)}


def test_presence_and_patterns(spark):
    q = ["QRCODE"]
    rows = [(q, q, "", False, "", False), (q, [], "x", True, "", False), (q, ["BARCODE"], "", False, "", False), ([], [], "x", False, "", False), ([], [], " ", True, "", False), ([], [], "", False, "", False), ([], [], "", False, "e", False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a array<string>, b array<string>, t string, k boolean, e string, f boolean").orderBy("i")
    got = [r[0] for r in df.select(rc.presence_status(F.col("a"), F.col("b"), F.col("t"), F.col("k"), F.col("e"), F.col("f"))).collect()]
    assert got == ["PASS (Present)", "FAIL (Code Missing)", "FAIL (Wrong Code Type)", "PASS (Present)", "PASS (Present)", "PASS (Present)", "FAIL (Missing)"]
    rows = [("[0-9]{3}", "a 123", None), ("[0-9]{3}", "a", "b 999"), ("[0-9]{3}", "a", None), ("([0-9]", "123", None), ("[0-9", "123", None), ("*a", "a", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, t string, s string").orderBy("i")
    got = [r[0] for r in df.select(rc.own_pattern_status(F.col("p"), F.col("t"), F.col("s"))).collect()]
    assert got == ["PASS (Pattern)", "PASS (Pattern)", "FAIL (Pattern)"] + ["CHECK (Bad Pattern)"] * 3


def test_region_batch(spark):
    regions = spark.createDataFrame(
        [(1, 1, "A", "all", None, None, False, True, None, 1), (1, 2, "B", "first", 9, None, False, False, "v", 2), (1, 3, "C", "first", None, None, False, False, "v", 3), (1, 9, "P", "first", None, None, True, False, None, 4)],
        "b int, id int, label string, scope string, parent_id int, expected_text string, scope_only boolean, exact_match boolean, variant_group string, seq int",
    )
    blank = {"from": "int", "to": "int", "page_num": "int", "pattern": "string", "eng_types": "array<string>", "tr_types": "array<string>", "visual": "double", "threshold": "double"}
    regions = regions.withColumns({**{c: F.lit(None).cast(t) for c, t in blank.items()}, "pages": F.lit(None).cast("array<int>"), **{c: F.lit(False) for c in ("pattern_match", "presence_only", "dont_compare_text", "eng_ink", "tr_ink")}}).drop("pages")
    docs = spark.createDataFrame([(1, 100, "master", 2), (1, 200, "translation", 3)], "b int, doc_id int, role string, total int")
    mapped = spark.createDataFrame([(1, 200, 1, 1), (1, 200, 2, 3)], "b int, tr_doc_id int, page_no int, mapped_page int")
    texts = spark.createDataFrame([(100, 1, 1, "Seal 4"), (100, 2, 1, "Seal 5"), (200, 1, 1, "Seal 4"), (200, 3, 1, "Dichtung"), (100, 1, 2, "x"), (200, 1, 2, ""), (100, 1, 3, "pump"), (200, 1, 3, "pump")], "doc_id int, page_no int, id int, text string")
    got = sorted((r.region_label, r.eng_page, r.status) for r in rc.region_batch(regions.withColumn("pages", F.lit(None).cast("array<int>")), docs, mapped, texts, ["b"]).collect())
    assert got == [("A", 1, "PASS (Exact Match)"), ("A", 2, "FAIL (Exact Required)"), ("v", 1, "PASS (variant: C)")]


def test_scopes_and_placement(spark):
    rows = [("range", 2, 5, None, None), ("pages", None, None, list(range(1, 9)), None), ("pages", None, None, [], None), ("single", None, None, None, 4), ("single", None, None, None, None), ("odd", None, None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, a int, b int, p array<int>, n int").orderBy("i")
    got = [r[0] for r in df.select(placement.described_scope(F.col("k"), F.col("a"), F.col("b"), F.col("p"), F.col("n"))).collect()]
    assert got == ["Pages 2-5  (retired)", "Pages 1, 2, 3, 4, 5, 6...  (retired)", "Pages (none)  (retired)", "Page 4  (retired)", "Single page", "Odd pages", "Single page"]
    m = {k: F.lit(v) for k, v in {"header": 50.0, "footer": 40.0, "left": 35.0, "right": 35.0}.items()}
    none = tuple(F.lit(None).cast("double") for _ in range(4))
    b = placement.snapped((F.lit(40.0), F.lit(300.0), F.lit(400.0), F.lit(790.0)), none, m, F.lit(595.0), F.lit(842.0))
    assert tuple(spark.range(1).select(*b).first()) == (35.0, 300.0, 595.0, 802.0)
    key = placement.sheet_key
    assert tuple(spark.range(1).select(key(F.lit("A4"), F.lit("portrait"), F.lit(595.0), F.lit(842.0)), key(F.lit("A3 sheet"), F.lit("landscape"), F.lit(1.0), F.lit(1.0)), key(F.lit("-"), F.lit("portrait"), F.lit(600.4), F.lit(300.0))).first()) == ("A4", "A3-landscape", "600x300")


def test_report_helpers(spark):
    one = spark.range(1)
    assert tuple(one.select(summaries.page_range(F.lit(3), F.lit(5), "Eng"), summaries.page_range(F.lit(3), F.lit(3), "Eng"), summaries.page_range(F.lit(None).cast("int"), F.lit(3), "Tr")).first()) == ("Eng P3-P5", "Eng P3", "-")
    long = one.select(summaries.crop_path(F.lit("out"), F.lit("x" * 300), F.lit(3), F.lit(1), F.lit("image"))).first()[0]
    assert len(long) <= 240 and long.startswith("out/xxx") and long.endswith("/p003_crop_01_image.png")
    assert one.select(summaries.crop_path(F.lit("f" * 235), F.lit("Topic"), F.lit(3), F.lit(1), F.lit("image"))).first()[0].endswith("/page_003/p003_crop_01_image.png")
    crops = spark.createDataFrame([(1, 1, 2, 2, [1.0, 2.0]), (1, 2, 2, 2, [1.0, 2.0]), (1, 3, 2, 2, [1.0, 3.0])], "d int, crop_no int, width int, height int, pixels array<double>")
    assert [r.searched_as for r in summaries.signatures(crops, ["d"]).orderBy("crop_no").collect()] == [1, 1, 3]


def test_table_regions_and_images(spark):
    boxes = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 200.0, 100.0), (1, 1, 2, 1.0, 1.0, 199.0, 99.0), (1, 1, 3, 10.0, 10.0, 60.0, 40.0), (1, 1, 4, 0.0, 300.0, 50.0, 350.0), (1, 1, 5, 0.0, 200.0, 50.0, 250.0)], BOXES)
    lines = spark.createDataFrame([(1, 1, 1, 12.0, 12.0, 50.0, 20.0, "ten letters"), (1, 1, 2, 5.0, 210.0, 40.0, 220.0, "ten letters"), (1, 1, 3, 5.0, 310.0, 40.0, 320.0, "few")], BOXES + ", text string")
    assert [(r.box_no, r.place) for r in inspection.table_regions(boxes, lines).orderBy("place").collect()] == [(1, 1), (5, 2)]
    a, b, c = [1.0, 2.0, 3.0, 9.0], [4.0, 1.0, 0.0, 2.0], [9.0, 1.0, 9.0, 1.0]
    cols = "d int, topic string, page_no int, no long, x0 double, y0 double, pixels array<double>"
    m = spark.createDataFrame([(1, "1", 1, 1, 0.0, 0.0, a), (1, "1", 1, 2, 0.0, 50.0, b), (1, "2", 2, 3, 0.0, 0.0, c)], cols)
    t = spark.createDataFrame([(1, "1", 1, 11, 0.0, 0.0, a), (1, "1", 1, 12, 0.0, 50.0, c), (1, "2", 2, 13, 0.0, 0.0, c), (1, "2", 2, 14, 0.0, 9.0, c)], cols)
    got = {(r.m, r.t, r.status) for r in inspection.images_in_order(m, t, ["d"], ["topic"]).collect()}
    assert got == {(1, 11, "MATCH"), (2, 12, "DIFFERENT")}
    pairs = {(r.m, r.t) for r in inspection.images_by_content(m, t, ["d"], "topic").collect()}
    assert {(1, 11), (3, 13)} <= pairs
    everything = inspection.images_by_content(m, t.withColumn("topic", F.lit(None).cast("string")), ["d"], "topic").collect()
    assert {r.bucket for r in everything} == {"*"} and len(everything) == 3


def test_inspection_gate(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    toc = spark.createDataFrame([(1, True), (2, False)], "doc_id int, ok boolean")
    other = spark.createDataFrame([(1, False), (2, True)], "doc_id int, ok boolean")
    card = lambda name, df: inspection.cards(name, df, F.lit("t"), F.lit("d"), F.col("ok"))
    done = inspection.inspected(docs, {"toc": card("toc", toc), "links": card("links", other)})
    assert sorted((r.doc_id, r.passed, r.total, r.verdict) for r in done["summary"].collect()) == [(1, 1, 2, "FAIL"), (2, 0, 1, "FAIL")]
    assert [r.doc_id for r in done["links"].collect()] == [1]
    order = []
    inspection.staged(done, lambda: order.append("master"), lambda name, _: order.append(name), ["toc"])
    assert order[:2] == ["toc", "master"] and set(order[2:]) == {"links", "summary", "verdicts", "findings"}
