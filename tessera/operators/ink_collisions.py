"""Whether the letters of two colliding text boxes collide, told from the ink between them.

Pairs of boxes come from spatial.collisions, in points; ink is (doc_id, page_no, y, xs, xe), disjoint runs of
rows at `scale` pixels a point, xe exclusive. A pair looks at one or two windows; windows and runs meet in bands of
rows, and only rows with ink are counted, so a window without ink costs nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators.spatial import PAGE

# fixed values, in points and shares
SAME_LINE, LEAST_SPAN, LEAST_CROSS, LONG, TALL, COLUMN = 0.50, 8.0, 6.0, 2.0, 1.5, 0.5
CLEAR_GAP, FRINGE_GAP, FRINGE_ROWS, FRINGE_SHARE, FRINGE_INK, TRIM = 0.5, 1.0, 6, 0.03, 2, 2
BAND = 32


def _rows_with_ink(windows: DataFrame, ink: DataFrame) -> DataFrame:
    """Rows of each window (pair, window, px0, py0, px1, py1) that hold ink: (pair, window, y, n)."""
    band = lambda a: F.floor(F.col(a) / BAND).cast("int")
    reach = windows.where("py1 > py0 AND px1 > px0").withColumn("band", F.explode(F.sequence(band("py0"), F.floor((F.col("py1") - 1) / BAND).cast("int"))))
    met = ink.withColumn("band", band("y")).join(reach, [*PAGE, "band"]).where("y >= py0 AND y < py1 AND xs < px1 AND px0 < xe")
    return met.groupBy(*PAGE, "a_box_no", "b_box_no", "window", "y").agg(F.sum(F.least("xe", "px1") - F.greatest("xs", "px0")).alias("n"))


def _widest_gap(ys: Column) -> Column:
    """The longest series of rows between two neighbours of ascending rows."""
    return F.coalesce(F.array_max(F.transform(ys, lambda y, i: F.when(i > 0, y - F.get(ys, i - 1) - 1))), F.lit(0))


def looked_at(pairs: DataFrame) -> DataFrame:
    """(page, box): the part of the page, in points, whose ink decides about each pair."""
    a, b = g.box("a_"), g.box("b_")
    middle = [(c[1] + c[3]) / 2 for c in (a, b)]
    ends = F.greatest(a[0], b[0]), F.least(F.greatest(a[1], b[1]), *middle), F.least(a[2], b[2]), F.greatest(F.least(a[3], b[3]), *middle)
    return pairs.select(*PAGE, *[c.alias(n) for c, n in zip(ends, g.BOX)])


def tested(pairs: DataFrame, ink: DataFrame, scale: float) -> DataFrame:
    """pairs with collides and why.

    Boxes that share half of the lower one's height and 8 pt of width are printed on one line, boxes of which one is
    long and one tall cross: any ink in their overlap is a collision. Else the rows between the two middles decide:
    half a point of white, or a point of fringe, keeps the lines apart.
    """
    a, b = g.box("a_"), g.box("b_")
    x0, x1 = F.greatest(a[0], b[0]), F.least(a[2], b[2])
    top, bottom = F.greatest(a[1], b[1]), F.least(a[3], b[3])
    ha, hb, wa, wb = a[3] - a[1], b[3] - b[1], a[2] - a[0], b[2] - b[0]
    across, down = x1 - x0, bottom - top
    line = (down >= SAME_LINE * F.least(ha, hb)) & (across >= LEAST_SPAN)
    cross = (((wa > LONG * ha) & (hb > TALL * wb)) | ((wb > LONG * hb) & (ha > TALL * wa))) & (across >= LEAST_CROSS) & (down >= LEAST_CROSS)
    middle = [(c[1] + c[3]) / 2 for c in (a, b)]
    apart = F.when(across <= COLUMN, "the boxes share no column of the page").when(down <= 0, "the boxes do not overlap vertically")
    p = pairs.withColumns({"apart": apart, "line": line, "cross": cross, "across": across, "down": down})
    low = lambda c: F.floor(c * scale).cast("int")
    high = lambda c: F.ceil(c * scale).cast("int")
    one = lambda name, y0, y1: F.struct(F.lit(name).alias("window"), low(x0).alias("px0"), low(y0).alias("py0"), high(x1).alias("px1"), high(y1).alias("py1"))
    windows = F.array_compact(F.array(F.when(line | cross, one("overlap", top, bottom)), one("between", F.least(*middle), F.greatest(*middle))))
    number = [*PAGE, "a_box_no", "b_box_no"]
    placed = p.where(F.col("apart").isNull()).select(*number, F.explode(windows).alias("w")).select(*number, "w.*")
    rows = _rows_with_ink(placed, ink)
    seen = rows.where("window = 'overlap'").select(*number).distinct().withColumn("printed", F.lit(True))
    listed = rows.where("window = 'between'").groupBy(*number).agg(F.array_sort(F.collect_list(F.struct("y", "n"))).alias("rows"))
    wide = placed.where("window = 'between'").select(*number, (F.col("px1") - F.col("px0")).alias("pixels"))
    m = p.join(seen, number, "left").join(listed, number, "left").join(wide, number, "left")
    first, last = F.element_at("rows", 1)["y"], F.element_at("rows", -1)["y"]
    inked = F.transform("rows", lambda r: r["y"])
    least = F.greatest(F.lit(FRINGE_INK), F.floor(F.col("pixels") * FRINGE_SHARE))
    full = F.transform(F.filter("rows", lambda r: (r["n"] > least) & (r["y"] >= first + TRIM) & (r["y"] <= last - TRIM)), lambda r: r["y"])
    fringe = F.when(last - first + 1 >= FRINGE_ROWS, _widest_gap(F.concat(F.array(first + TRIM - 1), full, F.array(last - TRIM + 1))) / scale).otherwise(0.0)
    m = m.withColumns({"gap": _widest_gap(inked) / scale, "fringe": fringe})
    printed = F.coalesce("printed", F.lit(False))
    why = (
        F.when(F.col("apart").isNotNull(), F.col("apart"))
        .when(F.col("line") & printed, F.format_string("direct superimposition (%.1f pt vertical overlap on same line)", "down"))
        .when(F.col("cross") & printed, F.format_string("cross collision (%.1fx%.1f pt intersection with rotated/vertical text)", "across", "down"))
        .when(F.col("rows").isNull(), "no ink in the overlap band")
        .when(F.size("rows") < 2, "negligible ink in overlap band")
        .when(F.col("gap") >= CLEAR_GAP, F.format_string("%.2f pt of white separates the two lines - the boxes overlap, the letters do not", "gap"))
        .when(F.col("fringe") >= FRINGE_GAP, F.format_string("%.2f pt of daylight separates the lines - only antialiasing fringe in between", "fringe"))
        .otherwise(F.format_string("no white between them (largest gap %.2f pt) - the ink is printed through itself", "gap"))
    )
    hit = F.col("apart").isNull() & (((F.col("line") | F.col("cross")) & printed) | ((F.coalesce(F.size("rows"), F.lit(0)) >= 2) & (F.col("gap") < CLEAR_GAP) & (F.col("fringe") < FRINGE_GAP)))
    return m.select(*pairs.columns, hit.alias("collides"), why.alias("why"))
