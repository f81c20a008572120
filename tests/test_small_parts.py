"""Readers, writers and small operators on literal rows."""

import json
import math

from pyspark.sql import functions as F

from tessera.functions import geometry, text
from tessera.operators import asof, boxes, findings, inspection, inventories, placement, raster, regions, summaries, tables
from tessera.sources import documents


def test_labels_and_crop_paths(spark):
    pages = spark.createDataFrame([(1, None), (2, " "), (3, "iv")], "page_no int, label string")
    assert [r.label for r in documents.page_labels(pages).orderBy("page_no").collect()] == ["1", "2", "iv"]
    paths = ["/a/4.1 Pump/p012_1.png", "/a/page_007/x.png", "/a/4.1 Pump/p001_qr.png", "/a/other/x.png", "/a/page_003/p009_2.png"]
    got = documents.crop_paths(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert sorted(map(tuple, got)) == [("/a/4.1 Pump/p012_1.png", 12, "4.1 Pump"), ("/a/page_003/p009_2.png", 9, None), ("/a/page_007/x.png", 7, None)]


def test_templates_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    region = {"id": "r1", "label": "Title", "page_num": 2, "roi_rect": [1.0, 2.0, 3.0, 4.0], "page_scope": {"type": "all"}, "exact_match": True, "expected_text": "", "unknown": 5}
    (tmp_path / "in" / "a.json").write_text(json.dumps({"name": "A", "regions": [region, {"id": "r2", "roi_rect": [0.0, 0.0, 9.0, 9.0]}]}))
    (tmp_path / "in" / "bad.json").write_text("{no json")
    read = documents.template_regions(documents.templates(spark, str(tmp_path / "in")))
    rows = read.orderBy("seq").collect()
    assert [(r.template, r.id, r.label, r.page_num, r.scope, r.exact_match, r.expected_text) for r in rows] == [("A", "r1", "Title", 2, "all", True, ""), ("A", "r2", "Region 2", 1, "single", False, None)]
    documents.write_templates(read, str(tmp_path / "out"))
    (written,) = [json.loads(x) for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()]
    assert written["name"] == "A" and [r["id"] for r in written["regions"]] == ["r1", "r2"] and written["regions"][0]["roi_rect"] == [1.0, 2.0, 3.0, 4.0] and len(written["saved_at"]) == 19
    names = spark.createDataFrame([("b",), ("A",), ("A",), ("c",)], "name string")
    assert [tuple(r) for r in placement.template_names(names).orderBy("place").collect()] == [("A", 2, 1), ("b", 1, 2), ("c", 1, 3)]


def test_json_report_and_manifest(spark, tmp_path):
    rows = spark.createDataFrame([("d", 2, "PASS"), ("d", 1, "MISSING"), ("e", 1, "PASS")], "doc string, step int, status string")
    inspection.write_json_report(rows, str(tmp_path / "report"), ["doc"])
    got = {r.doc: [(t.step, t.status) for t in r.tables] for r in spark.read.json(str(tmp_path / "report")).collect()}
    assert got == {"d": [(1, "MISSING"), (2, "PASS")], "e": [(1, "PASS")]}
    crops = spark.createDataFrame([("4_1_pump", 3, 1, "Figure", "x.png"), ("front", 1, 1, "Cover", "y.png")], "topic_slug string, page_no int, crop_no int, label string, path string")
    inspection.write_manifest(crops, str(tmp_path / "manifest"))
    assert sorted((r.topic_slug, r.path) for r in spark.read.json(str(tmp_path / "manifest")).collect()) == [("4_1_pump", "x.png"), ("front", "y.png")]


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_scopes_windows_and_positions(spark):
    lit = F.lit
    assert one(spark, *(placement.default_scope(lit(p), lit(last)) for p, last in ((1, False), (3, False), (1, True), (9, True)))) == ("first", "all", "last", "last")
    assert one(spark, placement.is_legacy_scope(lit("range")), placement.is_legacy_scope(lit("all")), placement.is_legacy_scope(lit(None).cast("string"))) == (True, False, False)
    rect = tuple(lit(float(v)) for v in (50, 60, 90, 80))
    assert one(spark, *regions.search_window(rect, lit(None).cast("double"), lit(None).cast("double"), lit(500.0), lit(100.0))) == (50.0, 0.0, 90.0, 100.0)
    assert one(spark, *regions.search_window(rect, lit(70.0), lit(5.0), lit(120.0), lit(800.0))) == (0.0, 55.0, 120.0, 85.0)
    at = lambda y, h: tables.page_position(lit(float(y)), lit(float(h)), lit(100.0))
    assert one(spark, at(10, 20), at(40, 20), at(40, 30), at(31, 38)) == ("top", "middle", "bottom", "middle")
    assert one(spark, *geometry.inflated(rect, 2.0)) == (48.0, 58.0, 92.0, 82.0)
    assert math.isclose(one(spark, geometry.to_pt(lit(25.4)))[0], 72.0)
    assert one(spark, *(text.columns_label(lit(n).cast("int")) for n in (None, 1, 4, 5))) == ("-", "1 column", "4 column", "4+ column")
    by_sheet = F.create_map(lit("A4"), lit(1), lit("A5"), lit(2))
    assert one(spark, placement.recorded(by_sheet, lit("A4"), lit(7)), placement.recorded(by_sheet, lit("A3"), lit(3))) == ({"A4": 7, "A5": 2}, {"A4": 1, "A5": 2, "A3": 3})
    said, same = placement.described_margins({"left": lit(36.0), "header": lit(72.0)}, {"left": 36.0, "header": 72.05})
    assert one(spark, said, same) == ("left 36 pt (12.7 mm), header 72 pt (25.4 mm)", True)


def test_findings_scores_and_quotas(spark):
    old = spark.createDataFrame([("toc", 1), ("links", 2), (None, 3)], "source string, n int")
    new = spark.createDataFrame([("toc", 9, "x")], "source string, n int, note string")
    assert sorted(map(tuple, findings.replaced(old, "toc", new).collect()), key=str) == sorted([("links", 2, None), (None, 3, None), ("toc", 9, "x")], key=str)
    found = spark.createDataFrame([("a", True)] * 4 + [("a", False)] + [("b", True), ("b", False)], "doc string, found boolean")
    assert sorted(map(tuple, summaries.search_score(found, ["doc"]).collect())) == [("a", 4, 5, 80.0, "PASS"), ("b", 1, 2, 50.0, "CHECK")]
    rows = spark.createDataFrame([("k", i, 2) for i in (3, 1, 2)] + [("l", 5, 0)], "key string, at int, most int")
    assert sorted(r["at"] for r in inventories.quota(rows, ["key"], ["at"], "most").collect()) == [1, 2]
    left, spans = spark.createDataFrame([(1, 7), (2, 50)], "id int, p int").withColumn("doc", F.lit(1)), spark.createDataFrame([(1, 5, 9, "wide"), (1, 6, 8, "narrow")], "doc int, lo int, hi int, name string")
    assert sorted((r.id, r.name) for r in asof.range_top(left, spans, ["doc"], "p", "lo", "hi", [F.col("hi") - F.col("lo")], ["id"]).collect()) == [(1, "narrow"), (2, None)]


def test_pixels_proposals_and_parents(spark):
    crops = spark.createDataFrame([(1, [10.0, 200.0, 99.9, 100.0, 0.0, 255.0])], "doc_id int, pixels array<double>")
    assert sorted((r.y, r.x) for r in raster.binarised(crops, 3, 100.0).collect()) == [(0, 0), (0, 2), (1, 1)]
    assert sorted((r.y, r.x) for r in raster.binarised(crops, 3, 100.0, below=False).collect()) == [(0, 1), (1, 2)]
    parts = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 9.0, 9.0), (1, 1, 2, 10.5, 0.0, 20.0, 9.0), (1, 1, 3, 11.0, 9.0, 20.0, 30.0), (1, 1, 4, 50.0, 50.0, 55.0, 55.0)], "doc_id int, page_no int, box_no int, x0 double, y0 double, x1 double, y1 double")
    assert [(r.x0, r.y0, r.x1, r.y1) for r in boxes.code_proposals(parts).collect()] == [(0.0, 0.0, 20.0, 30.0)]
    held = spark.createDataFrame([(1, "a", None, 0.0, 0.0, 9.0, 9.0), (1, "b", "a", 1.0, 1.0, 2.0, 2.0)], "doc int, id string, parent_id string, x0 double, y0 double, x1 double, y1 double")
    assert {r.id: r.scope_x1 for r in inspection.parent_scopes(held, ["doc"]).collect()} == {"a": None, "b": 9.0}
    docs = spark.createDataFrame([("d", 3)], "doc string, pages int")
    assert inspection.with_columns_of(docs, {"twice": ("Twice the pages", F.col("pages") * 2)}).first()["Twice the pages"] == 6
