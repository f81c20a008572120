"""Operators on literal rows, with results derived by hand."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions import text as tx
from tessera.operators import crops, findings, raster, regions, spatial, tables, topics, untranslated
from tessera.operators.asof import asof_last
from tessera.operators.components import connected_components
from tessera.sources import documents
from tessera.streaming import incremental


def test_untranslated_plants_one_finding(spark):
    rows = [("m", 2, "Press the green button before the pump starts"), ("t", 2, "Pulse el botón verde antes de arrancar"), ("t", 2, "Press the green button, before the PUMP starts."), ("t", 2, "300 x 90 x 87 mm (11,8 x 3,5 in)")]
    lines = spark.createDataFrame(rows, "doc_id string, page_no int, text string")
    found = untranslated.untranslated(lines, F.col("doc_id") == "m", skip_first_last=False).collect()
    assert [(r.doc_id, r.reason) for r in found] == [("t", "verbatim")]
    assert untranslated.untranslated(lines.where("doc_id = 'm'"), F.col("doc_id") == "m", False).count() == 0


def test_text_functions(spark):
    df = spark.range(1).select(
        tx.topic_code(F.lit("4.7.3 Prepare")).alias("a"), tx.topic_code(F.lit("Prepare")).alias("b"), tx.section_prefix(F.lit("1.2.10")).alias("c"), tx.destination(F.lit("page 4 (nameddest=x)")).alias("d"),
        tx.destination(F.lit("https://x.y")).alias("e"), tx.brief(F.lit("Safety ........ 12")).alias("f"), tx.duration(F.lit(147.4)).alias("g"), tx.human_size(F.lit(1536)).alias("h"), tx.topic_slug(F.lit("1.2: A/B  c.")).alias("i"),
        tx.topic_slug(F.lit(None).cast("string")).alias("j"), tx.columns_label(F.lit(7)).alias("k"), tx.folded(tx.nfkc(F.lit("ﬁne  Day!"))).alias("l"), tx.topic_slug(F.lit("CON")).alias("m"),
    )
    assert tuple(df.first()) == ("4.7.3", None, "1.2", "nameddest=x", "", "Safety", "2m 27s", "1.5 KB", "1.2_ A_B c", "_Front matter", "4+ column", "fine day", "_CON")


def test_margins(spark):
    m = g.normal_margins({"left": F.lit(35.0), "right": F.lit("junk"), "header": F.lit(-3.0)}, F.lit(595.0), F.lit(842.0))
    r = spark.range(1).select(*[c.alias(k) for k, c in m.items()]).first()
    assert (r.header, r.footer, r.left, r.right) == (0.0, 40.0, 35.0, 0.0)
    side = lambda *b: g.which_margin(tuple(F.lit(float(x)) for x in b), F.lit(595.0), F.lit(842.0), {k: F.lit(v) for k, v in (("header", 50.0), ("footer", 40.0), ("left", 35.0), ("right", 35.0))})
    got = spark.range(1).select(side(100, 20, 200, 70).alias("a"), side(100, 54.6, 120, 70).alias("b"), side(5, 300, 52, 315).alias("c"), side(5, 300, 100, 315).alias("d")).first()
    assert tuple(got) == ("header", None, "left", None)


def test_spans_drift_and_matching(spark):
    m = spark.createDataFrame([(1, "1", 1), (1, "1.1", 3), (1, "2", 3), (1, "2.1", 8)], "b int, code string, page_no int")
    t = spark.createDataFrame([(1, "1", 1), (1, "2", 5), (1, "2.1", 11)], "b int, code string, page_no int")
    total = lambda n: spark.createDataFrame([(1, n)], "b int, total int")
    ms, ts = topics.page_spans(m, total(10), ["b"]), topics.page_spans(t, total(12), ["b"])
    assert {(r.code, r.lo, r.hi) for r in ms.collect()} == {("1", 1, 2), ("1.1", 3, 7), ("2", 3, 7), ("2.1", 8, 10)}
    pages = spark.createDataFrame([(1, p) for p in (1, 2, 4, 9)], "b int, page_no int")
    got = {r.page_no: (r.code, r.target_page, r.why) for r in topics.matching_pages(pages, ms, ts, total(12), ["b"]).collect()}
    assert got == {1: ("1", 1, "topic"), 2: ("1", 2, "topic"), 4: ("2", 6, "topic"), 9: ("2.1", 12, "topic")}


def test_headings_skip_lists_and_contents(spark):
    body = [("d", 2, float(y), 10.0, "body text of the page that is long enough") for y in range(100, 160, 10)]
    heads = [("d", 2, 20.0, 12.0, "1 Safety"), ("d", 2, 60.0, 10.0, "3 items"), ("d", 2, 70.0, 12.0, "3. Check the function"), ("d", 3, 20.0, 12.0, "1.2 Use"), ("d", 3, 90.0, 12.0, "1.1 Late")]
    contents = [("d", 1, float(i), 12.0, f"{i} Entry") for i in range(1, 8)]
    lines = spark.createDataFrame(body + heads + contents, "d string, page_no int, y double, size double, text string")
    assert [(r.code, r.level) for r in topics.printed_headings(lines, ["d"]).orderBy("page_no", "y").collect()] == [("1", 1), ("1.2", 2)]


def test_codes_order_mismatch(spark):
    rows = [(1, "master", i, c) for i, c in enumerate(["1", "1.1", "2"])] + [(1, "translation", i, c) for i, c in enumerate(["1.1", "1", "2"])] + [(2, "master", 0, "1"), (2, "translation", 0, "1"), (2, "translation", 1, "3")]
    got = {r.b: (r.status, r.diff_msg) for r in topics.compare_codes(spark.createDataFrame(rows, "b int, role string, seq int, code string"), ["b"]).collect()}
    assert got == {1: ("FAIL", "Order Mismatch"), 2: ("FAIL", "Extra: 3")}


def test_asof_ties_and_misses(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5)], "k string, at int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("b", 9, "z")], "k string, t int, v string")
    assert {(r.k, r["at"], r.v) for r in asof_last(left, right, ["k"], F.col("at"), F.col("t"), ["v"]).collect()} == {("a", 1, None), ("a", 5, "y"), ("b", 5, None)}


def test_components_chain(spark):
    nodes = spark.createDataFrame([("p", i) for i in range(12)], "k string, n int")
    edges = spark.createDataFrame([("p", i, i + 1) for i in range(9)] + [("p", 11, 10)], "k string, a int, b int")
    got = {r.n: r.component for r in connected_components(nodes, edges, ["k"], "n").collect()}
    assert got == {i: (0 if i < 10 else 10) for i in range(12)}


def test_collisions_across_bins_once(spark):
    b = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 50.0, 200.0), (1, 1, 2, 10.0, 10.0, 60.0, 190.0), (1, 2, 3, 0.0, 0.0, 9.0, 9.0)], "doc_id int, page_no int, box_no int, x0 double, y0 double, x1 double, y1 double")
    assert [(r.a_box_no, r.b_box_no, r.overlap) for r in spatial.collisions(b).collect()] == [(1, 2, 7200.0)]


def test_ink(spark):
    grid = np.zeros((12, 12), int)
    grid[2, 1:9] = grid[5, 1:9] = 1
    grid[2:6, 1] = grid[2:6, 8] = 1
    grid[10, 10] = grid[9, 11] = 1
    cells = spark.createDataFrame([(0, int(y), int(x)) for y, x in zip(*np.nonzero(grid))], "doc_id int, y int, x int")
    h, v = raster.runs(cells), raster.runs(cells, "y", "x")
    assert {(r.x0, r.y0, r.x1, r.y1, r.ink) for r in raster.ink_components(h).collect()} == {(1, 2, 9, 6, 20), (10, 9, 12, 11, 2)}
    assert raster.crossings(h, v, 4).first().junctions == 4
    assert raster.rule_share(cells, 4).first().rule_ink == 20


def test_pairing_against_permutations():
    rng = np.random.RandomState(1)
    for n, m in ((1, 1), (2, 4), (4, 3), (5, 5)):
        s = rng.rand(n, m)
        got = sum(s[i, j] for i, j in crops.best_pairing(s))
        small = s if n <= m else s.T
        assert abs(got - max(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))) < 1e-9


def test_table_alignment():
    same = [(3, 3), (4, 4), (9, 2)]
    assert [s for *_, s in tables.align(same, same)] == ["PASS"] * 3
    assert tables.align([(3, 3), (9, 9)], [(7, 1), (3, 3), (9, 9)]) == [(None, 0, "EXTRA"), (0, 1, "PASS"), (1, 2, "PASS")]
    assert tables.align([(3, 3), (9, 9)], [(9, 9)]) == [(0, None, "MISSING"), (1, 0, "PASS")]
    assert tables.align([(3, 3)], [(8, 8), (2, 1)]) == [(0, 0, "DIFFERENT"), (None, 1, "EXTRA")]


def test_region_text(spark):
    rows = [(1, "", ""), (2, "a", ""), (3, "Pump  One", "pump one"), (4, "Arvola Road 12, 55100", "Arvola Road 12, 55100 Kallio OY extra words here"), (5, "open the valve", "öffnen Sie das Ventil")]
    got = {r.i: r.match_desc for r in regions.similarity(spark.createDataFrame(rows, "i int, m string, t string"), "m", "t").collect()}
    assert got == {1: "Exact Match (Both Empty)", 2: "Empty / No Content", 3: "Exact Match", 4: "Token Match", 5: "Translated / Content Present"}
    p = spark.createDataFrame([("894387_5.0", "x 123456_7.1", ""), ("EN", "none1", "og EN"), ("894387", "1234567", "z"), ("", "a", "b")], "m string, h string, s string")
    status = [r[0] for r in p.select(regions.pattern_status(F.col("m"), F.col("h"), F.col("s"))).collect()]
    assert status == ["PASS (Pattern)", "CHECK (Pattern Moved)", "FAIL (Pattern)", "CHECK (No Pattern)"]
    assert p.select(regions.pattern_description(F.col("m"))).first()[0] == "6 digits + '_' + 1 digit + '.' + 1 digit"


def test_gate_and_verdicts(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    gate = spark.createDataFrame([("a", True), ("b", False)], "doc_id string, passed boolean")
    results = spark.createDataFrame([("a", "PASS"), ("b", "FAIL")], "doc_id string, status string")
    assert {(r.doc_id, r.status) for r in findings.gated(docs, gate, results).collect()} == {("a", "PASS"), ("b", "SKIPPED")}
    checks = spark.createDataFrame([("a", "toc", True, False), ("a", "regions", False, False), ("b", "links", False, True)], "doc_id string, check string, passed boolean, skipped boolean")
    verdict = lambda mode: {r.doc_id: r.passed for r in findings.verdicts(checks, ["doc_id"], mode).collect()}
    assert verdict("strict") == {"a": False, "b": False} and verdict("report") == {"a": True, "b": True}


def test_sources(spark, tmp_path):
    for name in ("a.pdf", "B.PDF", "c.txt"):
        (tmp_path / name).write_text("x")
    assert documents.discovered(spark, str(tmp_path)).count() == 2
    docs = spark.createDataFrame([(1, "m", "master", "/x/M.pdf"), (1, "t", "translation", "/x/t_sv-SE.pdf"), (2, "u", "translation", "/y/u.pdf")], "batch_id int, doc_id string, role string, path string")
    assert {(r.batch_id, r.status) for r in documents.masters(docs).collect()} == {(1, "OK"), (2, "NO MASTER")}
    assert [r.doc_id for r in documents.translations(docs).collect()] == ["t"]
    assert docs.select(documents.language_tag(F.element_at(F.split("path", "/"), -1))).collect()[1][0] == "sv-SE"
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.json").write_text('{"name": "n", "regions": [{"id": "x", "roi_rect": [1, 2, 3, 4], "expected_text": ""}, {"label": "L", "page_scope": {"type": "odd"}}]}')
    (tmp_path / "t" / "b.json").write_text("{broken")
    r = documents.template_regions(documents.templates(spark, str(tmp_path / "t"))).orderBy("seq").collect()
    assert [(x.id, x.label, x.scope, x.expected_text) for x in r] == [("x", "Region 1", "single", ""), ("r1", "L", "odd", None)]


def test_stream_twice_is_the_same(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Press the green button"), (2, "Ok")], "doc_id int, text string")
    docs.write.parquet(str(tmp_path / "in"))
    check = lambda d: d.where(F.length("text") > 5).select("doc_id", F.lit("long").alias("reason"))
    for run in ("c1", "c2"):
        q = incremental.checked_stream(spark, str(tmp_path / "in"), "doc_id int, text string", check, str(tmp_path / "out"), ["doc_id"], str(tmp_path / run)).start()
        q.awaitTermination(60)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("doc_id", "reason").collect()] == [(1, "long")]


def test_region_status(spark):
    rows = [(99.0, True, False), (99.0, True, True), (90.0, True, True), (90.0, True, False), (50.0, True, False), (10.0, True, False), (0.0, False, False)]
    df = spark.createDataFrame(rows, "s double, t boolean, e boolean")
    got = [r[0] for r in df.select(regions.text_status(F.col("s"), F.col("t"), F.col("e"), F.lit(30.0))).collect()]
    assert got == ["PASS (Exact)", "PASS (Exact Match)", "FAIL (Exact Required)", "PASS (Near)", "PASS (Present)", "CHECK (Translated)", "FAIL (Empty Region)"]


def test_internal_links(spark):
    from tessera.operators.link_alignment import internal_differences

    en = [("1 Safety", "page 2 (a)", "1.1"), ("2 Use", "page 3 (b)", "1.1"), ("3 Care", "page 4 (c)", "1.1"), ("4 Data", "page 5 (d)", "1.1")]
    same = [(1, 0, i, *x) for i, x in enumerate(en)] + [(1, 1, i, *x) for i, x in enumerate(en)]
    gone = [(2, 0, i, *x) for i, x in enumerate(en)] + [(2, 1, i, *x) for i, x in enumerate(en[:1] + en[2:])]
    swap = [(3, 0, i, *x) for i, x in enumerate(en)] + [(3, 1, i, *x) for i, x in enumerate([en[1], en[0], *en[2:]])]
    links = spark.createDataFrame(same + gone + swap, "b int, side int, seq long, text string, url string, topic string")
    assert [(r.b, r.side, r.seq, r.kind, r.uncertain) for r in internal_differences(links, ["b"]).collect()] == [(2, 0, 1, "missing", False)]
