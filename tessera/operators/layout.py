"""Operators on boxes and pages: margins, candidates, sheets, columns, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators.spatial import PAGE, pairs

# Sheet names with their sides in millimetres.
SHEETS_MM = [
    ("A0", 841, 1189),
    ("A1", 594, 841),
    ("A2", 420, 594),
    ("A3", 297, 420),
    ("A4", 210, 297),
    ("A5", 148, 210),
    ("A6", 105, 148),
    ("A7", 74, 105),
    ("A8", 52, 74),
    ("Letter", 216, 279),
    ("Legal", 216, 356),
    ("Tabloid", 279, 432),
]
MIN_OVERFLOW = 2.0


def margin_overflows(boxes: DataFrame, width: Column, height: Column, m: dict[str, Column]) -> DataFrame:
    """Boxes that no margin owns and that run over a side band by more than 2 pt: the worse side
    (right on a tie). A page without side bands has none."""
    own = g.which_margin(g.box(), width, height, m)
    left = F.when(m["left"] > 0, m["left"] - F.col("x0")).otherwise(0.0)
    right = F.when(m["right"] > 0, F.col("x1") - (width - m["right"])).otherwise(0.0)
    side = F.when(right >= left, "right").otherwise("left")
    over = boxes.where(own.isNull()).withColumn("side", side).withColumn("over", F.greatest(left, right)).where(F.col("over") > MIN_OVERFLOW)
    edge = F.when(F.col("side") == "right", width - m["right"]).otherwise(m["left"])
    return over.withColumn("over_pt", F.bround("over", 1)).withColumn("boundary_x", F.bround(edge, 1)).drop("over")


def judged_candidates(boxes: DataFrame, width: Column, height: Column, m: dict[str, Column]) -> DataFrame:
    """boxes with ignored_by: `too small` as found or once cut to the live area, then for the cut box the
    margin that owns it or `edge artifact`, or null if it stays."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    cut = g.intersection(g.box(), g.content_box(width, height, m))
    edge = (cut[2] - cut[0] <= 0.12 * width) & ((cut[0] <= g.EDGE_TOUCH) | (cut[2] >= width - g.EDGE_TOUCH))
    owner = g.which_margin(cut, width, height, m)
    small = ~(((w >= 12) & (h >= 12)) | (w * h >= 140)) | (cut[2] - cut[0] <= 5) | (cut[3] - cut[1] <= 5)
    return boxes.withColumn("ignored_by", F.when(small, "too small").when(owner.isNotNull(), owner).when(edge, "edge artifact"))


def merged_collisions(pairs: DataFrame) -> DataFrame:
    """Pairs as findings: a pair joins the first finding of its page whose box its own union box overlaps.

    Pairs come in order of their boxes' tops (a_y0, a_box_no, b_y0, b_box_no), and a finding's box
    grows with each pair, so this is one fold over a page's pairs. Rows: group (from 1), the union
    box, pairs, summed overlap, and the box numbers in order of appearance. A page's pairs are one
    array; pages are spread.
    """
    page = ["doc_id", "page_no"]
    u = g.union_box(g.box("a_"), g.box("b_"))
    one = F.struct(F.col("a_y0").alias("k1"), F.col("a_box_no").alias("k2"), F.col("b_y0").alias("k3"), F.col("b_box_no").alias("k4"), *[c.cast("double").alias(n) for c, n in zip(u, g.BOX)], F.col("overlap").cast("double").alias("overlap"))
    empty = F.expr("CAST(array() AS array<struct<x0:double,y0:double,x1:double,y1:double,pairs:bigint,overlap:double,boxes:array<int>>>)")

    def made(x0: Column, y0: Column, x1: Column, y1: Column, n: Column, over: Column, boxes: Column) -> Column:
        return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), n.cast("bigint").alias("pairs"), over.alias("overlap"), boxes.cast("array<int>").alias("boxes"))

    def step(groups: Column, p: Column) -> Column:
        meets = lambda q: (q["x0"] < p["x1"]) & (p["x0"] < q["x1"]) & (q["y0"] < p["y1"]) & (p["y0"] < q["y1"])
        own = F.array(p["k2"], p["k4"])
        # exists() before the position: the first group that the pair overlaps
        first = F.array_position(F.transform(groups, meets), True)
        grown = lambda q: made(F.least(q["x0"], p["x0"]), F.least(q["y0"], p["y0"]), F.greatest(q["x1"], p["x1"]), F.greatest(q["y1"], p["y1"]), q["pairs"] + 1, q["overlap"] + p["overlap"], F.array_union(q["boxes"], own))
        new = F.array(made(p["x0"], p["y0"], p["x1"], p["y1"], F.lit(1), p["overlap"], own))
        return F.when(first == 0, F.concat(groups, new)).otherwise(F.transform(groups, lambda q, i: F.when(i + 1 == first, grown(q)).otherwise(q)))

    folded = pairs.groupBy(*page).agg(F.array_sort(F.collect_list(one)).alias("p")).select(*page, F.posexplode(F.aggregate("p", empty, step)).alias("i", "q"))
    return folded.select(*page, (F.col("i") + 1).alias("group_no"), "q.x0", "q.y0", "q.x1", "q.y1", "q.pairs", F.round("q.overlap", 2).alias("overlap_pt2"), F.array_join("q.boxes", ",").alias("boxes"))


def reading_order(boxes: DataFrame) -> DataFrame:
    """Slot numbers top to bottom, left to right (to a tenth), and the first and last box of a page."""
    page = Window.partitionBy("doc_id", "page_no")
    order = page.orderBy(F.bround("y0", 1), F.bround("x0", 1), "box_no")
    return boxes.select("doc_id", "page_no", "box_no", F.row_number().over(order).alias("slot"), (F.min("box_no").over(page) == F.col("box_no")).alias("is_first"), (F.max("box_no").over(page) == F.col("box_no")).alias("is_last"))


def classified_sheets(pages: DataFrame, tolerance: float = 2.5) -> DataFrame:
    """pages with the nearest sheet (`Custom w×h mm` beyond the tolerance), whether it is exact, and orientation."""
    short, long = F.least("width_pt", "height_pt") * 25.4 / 72, F.greatest("width_pt", "height_pt") * 25.4 / 72
    errors = F.array(*[F.struct(F.round(F.greatest(F.abs(short - min(w, h)), F.abs(long - max(w, h))), 6).alias("err"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, w, h) in enumerate(SHEETS_MM)])
    best = pages.withColumn("best", F.array_min(errors))
    side = F.when(F.col("width_pt") > F.col("height_pt"), "landscape").otherwise("portrait")
    custom = F.format_string("Custom %.0f×%.0f mm", F.bround(short, 0), F.bround(long, 0))
    return best.withColumn("sheet", F.when(F.col("best.err") <= tolerance, F.col("best.name")).otherwise(custom)).withColumn("exact", F.col("best.err") < 0.5).withColumn("orientation", side).drop("best")


def dominant(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group the commonest value (the larger on a tie), its count, unanimity and a note."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    d = counts.groupBy(*by).agg(F.sum("n").alias("pages"), F.max_by(value, F.struct("n", value)).alias("value"), F.max("n").alias("dominant"), (F.count("*") == 1).alias("unanimous"))
    return d.withColumn("note", F.when(F.col("unanimous"), "").otherwise(F.format_string("(%d of %d pages differ)", F.col("pages") - F.col("dominant"), F.col("pages"))))


def sampled_pages(totals: DataFrame, want: int) -> DataFrame:
    """About `want` pages of each document at even steps (half-even rounding), the first and the
    last always in; short documents whole. totals(doc_id, total)."""
    step = F.transform(F.sequence(F.lit(0), F.lit(want - 1)), lambda i: F.least(F.col("total"), 1 + F.bround(i * F.col("total") / want, 0).cast("int")))
    chosen = F.when(F.col("total") <= want, F.sequence(F.lit(1), F.col("total"))).otherwise(F.array_distinct(F.concat(F.array(F.lit(1), F.col("total")), step)))
    return totals.select("doc_id", F.explode(chosen).alias("page_no"))


def gutters(boxes: DataFrame, bin_pt: float = 3.0, min_pt: float = 9.0) -> DataFrame:
    """Vertical strips of a page between its first and last box that no box touches."""
    # a strip begins where every box so far has ended
    ends = [F.floor(F.col(c) / bin_pt) for c in ("x0", "x1")]
    spans = boxes.where("x0 IS NOT NULL AND x1 IS NOT NULL").select("doc_id", "page_no", F.least(*ends).alias("lo"), F.greatest(*ends).alias("hi"))
    w = Window.partitionBy("doc_id", "page_no").orderBy("lo")
    gap = spans.select("doc_id", "page_no", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("b"), F.col("lo").alias("next")).where((F.col("next") - F.col("b") - 1) * bin_pt >= min_pt)
    return gap.select("doc_id", "page_no", ((F.col("b") + 1) * bin_pt).alias("x0"), (F.col("next") * bin_pt).alias("x1"))


def clustered(rows: DataFrame, by: list[str], value: str, gap: float) -> DataFrame:
    """Clusters of positions whose neighbours are at most gap apart: number, count, rounded mean."""
    w = Window.partitionBy(*by).orderBy(value)
    new = F.when(F.col(value) - F.lag(value).over(w) <= gap, 0).otherwise(1)
    run = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__new", new).withColumn("cluster", run).groupBy(*by, "cluster").agg(F.count("*").alias("n"), F.bround(F.avg(value), 0).alias("position"))


def skipped_margins(pages: DataFrame, skips: DataFrame, doc: list[str]) -> DataFrame:
    """pages(doc, page_no, total) with the sides switched off there. skips(page_at, side): a page
    number, `first` or `last`, which are resolved per document."""
    names = F.array_compact(F.array(F.col("page_no").cast("string"), F.when(F.col("page_no") == 1, "first"), F.when(F.col("page_no") == F.col("total"), "last")))
    off = pages.select(*doc, "page_no", F.explode(names).alias("page_at")).join(skips, "page_at").groupBy(*doc, "page_no").agg(F.array_join(F.array_sort(F.collect_set("side")), ",").alias("off"))
    return pages.join(off, [*doc, "page_no"], "left").withColumn("off", F.coalesce("off", F.lit("")))


def uncovered(boxes: DataFrame, claims: DataFrame, share: float = 0.5) -> DataFrame:
    """Boxes of which less than `share` is covered by the (disjoint) claimed boxes of their page."""
    over = g.area(g.intersection(g.box("a_"), g.box("b_")))
    met = pairs(boxes, claims, g.intersects(g.box("a_"), g.box("b_"))).groupBy(*PAGE, F.col("a_box_no").alias("box_no")).agg(F.sum(over).alias("covered"))
    left = boxes.join(met, [*PAGE, "box_no"], "left")
    return left.where(F.coalesce(F.round("covered", 3), F.lit(0.0)) < F.round(share * g.area(g.box()), 3)).drop("covered")


def metadata_notes(docs: DataFrame, by: list[str]) -> DataFrame:
    """Translations' notes on what differs from their master: pages, then sheet size.

    docs(by, doc_id, role, pages, sheet).
    """
    m = docs.where("role = 'master'").select(*by, F.col("pages").alias("m_pages"), F.col("sheet").alias("m_sheet"))
    t = docs.where("role <> 'master'").join(m, by, "left")
    note = F.concat_ws("; ", F.when(~F.col("pages").eqNullSafe(F.col("m_pages")), F.concat(F.lit("page count differs (master "), F.coalesce(F.col("m_pages").cast("string"), F.lit("-")), F.lit(")"))), F.when(~F.col("sheet").eqNullSafe(F.col("m_sheet")), F.lit("sheet size differs")))
    return t.select(*by, "doc_id", note.alias("note"))


def resolved_paths(results: DataFrame, paths: DataFrame) -> DataFrame:
    """results(name) with the path of the file of that name, else of the only file that starts with it
    once its extension is cut. paths(path, filename).

    Every prefix of a file name is a key of the join, so names that share a beginning meet only the
    files that begin with the whole of it.
    """
    exact = results.join(paths.groupBy(F.col("filename").alias("name")).agg(F.min("path").alias("path")), "name", "left")
    # the extension: a last dot that does not stand among leading dots alone
    stem = F.when(F.col("name").rlike(r"[^.].*\.[^.]*$"), F.regexp_replace("name", r"\.[^.]*$", "")).otherwise(F.col("name"))
    open_rows = exact.where("path IS NULL AND name <> ''").select("name", stem.alias("stem")).distinct()
    begun = paths.where("filename <> ''").select("path", F.explode(F.transform(F.sequence(F.lit(1), F.length("filename")), lambda n: F.left(F.col("filename"), n))).alias("stem"))
    unique = open_rows.join(begun, "stem").groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("found")).where("n = 1").select("name", "found")
    return exact.join(unique, "name", "left").select("name", F.coalesce("path", "found").alias("path"))
