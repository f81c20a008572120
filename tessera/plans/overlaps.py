"""Text that is printed over text, from boxes that overlap to findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import figures, ink_collisions, layout, spatial
from tessera.operators.components import written
from tessera.plans.layout import _PAIRS, _spans
from tessera.plans.registry import register
from tessera.sources.bindings import sql

SCALE = 2.0

_INK = """, ink AS (
  SELECT doc_id, page_no, y, CAST(floor(x0 * 2) AS BIGINT) AS xs, CAST(floor(x0 * 2) AS BIGINT) + 1 + (CAST(floor((x1 - x0) * 2) AS BIGINT) * (2 + (y + box_no) % 3)) // 4 AS xe FROM (
    SELECT *, unnest(range(CAST(floor(y0 * 2) AS BIGINT) + 2, CAST(floor(y1 * 2) AS BIGINT) - 1)) AS y FROM b_boxes WHERE kind <> 'R') WHERE (y + box_no) % 5 < 4 AND (box_no % 6 > 0 OR (y - CAST(floor(y0 * 2) AS BIGINT)) % 9 < 5)),
k AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM b_boxes g WHERE g.kind = 'R' AND g.doc_id = p.doc_id AND g.page_no = p.page_no
   AND ax0 >= g.x0 - 14 AND ay0 >= g.y0 - 14 AND ax1 <= g.x1 + 14 AND ay1 <= g.y1 + 14 AND bx0 >= g.x0 - 14 AND by0 >= g.y0 - 14 AND bx1 <= g.x1 + 14 AND by1 <= g.y1 + 14)),
w AS (SELECT *, greatest(ax0, bx0) AS x0, least(ax1, bx1) AS x1, greatest(ay0, by0) AS t, least(ay1, by1) AS b, least((ay0 + ay1) / 2, (by0 + by1) / 2) AS lo, greatest((ay0 + ay1) / 2, (by0 + by1) / 2) AS hi FROM k),
q AS (SELECT *, b - t >= 0.5 * least(ay1 - ay0, by1 - by0) AND x1 - x0 >= 8 AS line,
    ((ax1 - ax0 > 2 * (ay1 - ay0) AND by1 - by0 > 1.5 * (bx1 - bx0)) OR (bx1 - bx0 > 2 * (by1 - by0) AND ay1 - ay0 > 1.5 * (ax1 - ax0))) AND x1 - x0 >= 6 AND b - t >= 6 AS crossed,
    CAST(floor(x0 * 2) AS BIGINT) AS px0, CAST(ceil(x1 * 2) AS BIGINT) AS px1, CAST(floor(lo * 2) AS BIGINT) AS py0, CAST(ceil(hi * 2) AS BIGINT) AS py1, CAST(floor(t * 2) AS BIGINT) AS oy0, CAST(ceil(b * 2) AS BIGINT) AS oy1 FROM w),
cells AS (SELECT DISTINCT q.doc_id, q.page_no, a_box_no, b_box_no, i.y, unnest(range(greatest(px0, xs), least(px1, xe))) AS x FROM q JOIN ink i ON i.doc_id = q.doc_id AND i.page_no = q.page_no AND i.y >= least(py0, oy0) AND i.y < greatest(py1, oy1) AND xs < px1 AND px0 < xe),
n AS (SELECT doc_id, page_no, a_box_no, b_box_no, y, count(*) AS n FROM cells GROUP BY ALL),
o AS (SELECT q.doc_id, q.page_no, q.a_box_no, q.b_box_no, any_value(px1 - px0) AS pixels, count(*) FILTER (y >= oy0 AND y < oy1) AS printed, list(struct_pack(y := y, n := n) ORDER BY y) FILTER (y >= py0 AND y < py1) AS rows FROM q JOIN n USING (doc_id, page_no, a_box_no, b_box_no) GROUP BY ALL),
f AS (SELECT *, list_transform(rows, lambda r: r.y) AS ys, list_transform(list_filter(rows, lambda r: r.n > greatest(2, floor(pixels * 0.03)) AND r.y >= rows[1].y + 2 AND r.y <= rows[-1].y - 2), lambda r: r.y) AS full_ys FROM o),
h AS (SELECT *, coalesce(list_max(list_transform(range(2, len(ys) + 1), lambda i: ys[i] - ys[i - 1] - 1)), 0) / 2 AS gap, [ys[1] + 1] || full_ys || [ys[-1] - 1] AS z FROM f),
v AS (SELECT *, CASE WHEN ys[-1] - ys[1] + 1 >= 6 THEN list_max(list_transform(range(2, len(z) + 1), lambda i: z[i] - z[i - 1] - 1)) / 2 ELSE 0 END AS fringe FROM h),
r AS (SELECT q.*, coalesce(printed, 0) > 0 AS printed, coalesce(len(rows), 0) AS inked, gap, fringe FROM q LEFT JOIN v USING (doc_id, page_no, a_box_no, b_box_no)),
tested AS (SELECT *, x1 - x0 > 0.5 AND b > t AND (((line OR crossed) AND printed) OR (inked >= 2 AND gap < 0.5 AND fringe < 1.0)) AS collides,
  CASE WHEN x1 - x0 <= 0.5 THEN 'the boxes share no column of the page' WHEN b <= t THEN 'the boxes do not overlap vertically' WHEN line AND printed THEN 'direct superimposition' WHEN crossed AND printed THEN 'cross collision'
    WHEN inked = 0 THEN 'no ink in the overlap band' WHEN inked < 2 THEN 'negligible ink in overlap band' WHEN gap >= 0.5 THEN printf('%.2f pt of white separates the two lines', gap) WHEN fringe >= 1.0 THEN printf('%.2f pt of daylight separates the lines', fringe)
    ELSE 'no white between them' END AS why FROM r)"""


def _tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = written(_spans(spark, sf_dir), "spans")
    pairs = written(spatial.within_same(spatial.collisions(spans.drop("kind")), spans.where("kind = 'R'")), "colliding")
    return ink_collisions.tested(pairs, figures.union(spatial.PAGE, ink=_letter_rows(spans.where("kind <> 'R'"), pairs)), SCALE)


def _letter_rows(boxes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of letters of the boxes that some pair looks at; only these are cut into rows, page by page."""
    row = lambda c: F.floor(F.col(c) * SCALE)
    kept = ["doc_id", "page_no", "box_no", "x0", "y0", "x1", "y1"]
    # letters begin up to a pixel before their box and end up to a pixel behind it
    met = spatial.pairs(boxes.select(*kept), ink_collisions.looked_at(pairs), g.intersects(g.box("a_"), g.box("b_"), 2 / SCALE), pad=2 / SCALE)
    near = met.select("doc_id", "page_no", *[F.col(f"a_{c}").alias(c) for c in kept[2:]]).distinct().repartition("doc_id", "page_no")
    letters = near.where(row("y1") - row("y0") > 3).select("*", F.explode(F.sequence(row("y0") + 2, row("y1") - 2)).alias("y"))
    letters = letters.where(((F.col("y") + F.col("box_no")) % 5 < 4) & ((F.col("box_no") % 6 > 0) | ((F.col("y") - row("y0")) % 9 < 5)))
    wide = F.floor((F.col("x1") - F.col("x0")) * SCALE) * (2 + (F.col("y") + F.col("box_no")) % 3)
    return letters.select("doc_id", "page_no", "y", row("x0").alias("xs"), (row("x0") + 1 + F.floor(wide / 4)).alias("xe"))


@register("k15_ink_tests", sql("b_boxes") + _PAIRS.replace("\nn AS", "\nnn AS").replace("FROM n a JOIN n b", "FROM nn a JOIN nn b") + _INK + " SELECT doc_id, page_no, a_box_no, b_box_no, collides, why FROM tested")
def k15_ink_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlap outside artwork with what its ink says; the reason without its figures of length."""
    t = _tested(spark, sf_dir)
    return t.select("doc_id", "page_no", "a_box_no", "b_box_no", "collides", F.regexp_replace("why", r" \(.*| - .*", "").alias("why"))


@register("k15_overlaps")
def k15_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings: boxes that overlap, outside artwork, printed through each other, touching ones as one."""
    return layout.merged_collisions(_tested(spark, sf_dir).where("collides"))
