"""Queries on boxes, pages and margins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import layout, spatial
from tessera.plans.registry import register
from tessera.sources import bindings
from tessera.sources.bindings import sql

MARGINS = {"header": 50.4, "footer": 41.3, "left": 35.0, "right": 35.0}
WIDTH, HEIGHT = 595.0, 842.0


def _margins() -> dict:
    return g.normal_margins({k: F.lit(v) for k, v in MARGINS.items()}, F.lit(WIDTH), F.lit(HEIGHT))


_SIDE = """CASE WHEN greatest(0.0, least(y1, 50.4) - y0) / greatest(y1 - y0, 1e-6) >= 0.5 THEN 'header'
  WHEN greatest(0.0, y1 - (842.0 - 41.3)) / greatest(y1 - y0, 1e-6) >= 0.5 THEN 'footer'
  WHEN greatest(0.0, least(x1, 35.0) - x0) / greatest(x1 - x0, 1e-6) >= 0.5 OR (x0 <= 10 AND greatest(0.0, least(x1, 35.0) - x0) > 0 AND x1 <= 59) THEN 'left'
  WHEN greatest(0.0, x1 - 560.0) / greatest(x1 - x0, 1e-6) >= 0.5 OR (x1 >= 585 AND greatest(0.0, x1 - 560.0) > 0 AND x0 >= 536) THEN 'right' END"""


@register("p6_which_margin", sql("b_boxes") + f" SELECT doc_id, page_no, box_no, {_SIDE} AS side FROM b_boxes")
def p6_which_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The margin that owns each box."""
    return bindings.boxes(spark, sf_dir).select("doc_id", "page_no", "box_no", g.which_margin(g.box(), F.lit(WIDTH), F.lit(HEIGHT), _margins()).alias("side"))


@register(
    "k16_margin_overflow",
    sql("b_boxes")
    + f""", k AS (SELECT *, {_SIDE} AS own, 35.0 - x0 AS l, x1 - 560.0 AS r FROM b_boxes),
o AS (SELECT *, CASE WHEN r >= l THEN 'right' ELSE 'left' END AS side, greatest(l, r) AS over FROM k WHERE own IS NULL)
SELECT doc_id, page_no, box_no, side, round_even(over, 1) AS over_pt, CASE WHEN side = 'right' THEN 560.0::DOUBLE ELSE 35.0::DOUBLE END AS boundary_x FROM o WHERE over > 2.0""",
)
def k16_margin_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that run over a side margin."""
    return layout.margin_overflows(bindings.boxes(spark, sf_dir), F.lit(WIDTH), F.lit(HEIGHT), _margins()).select("doc_id", "page_no", "box_no", "side", "over_pt", "boundary_x")


_CUT_SIDE = _SIDE.replace("x0", "cx0").replace("x1", "cx1").replace("y0", "cy0").replace("y1", "cy1")


@register(
    "p20_judged_candidates",
    sql("b_boxes")
    + f""", c AS (SELECT *, greatest(x0, 35.0) AS cx0, greatest(y0, 50.4) AS cy0, least(x1, 560.0) AS cx1, least(y1, 842.0 - 41.3) AS cy1 FROM b_boxes),
k AS (SELECT *, {_CUT_SIDE} AS side FROM c)
SELECT doc_id, page_no, box_no, CASE
  WHEN NOT ((x1 - x0 >= 12 AND y1 - y0 >= 12) OR (x1 - x0) * (y1 - y0) >= 140) OR cx1 - cx0 <= 5 OR cy1 - cy0 <= 5 THEN 'too small'
  WHEN side IS NOT NULL THEN side
  WHEN cx1 - cx0 <= 0.12 * 595 AND (cx0 <= 10 OR cx1 >= 585) THEN 'edge artifact' END AS ignored_by FROM k""",
)
def p20_judged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a graphic candidate is ignored, or null if it stays."""
    return layout.judged_candidates(bindings.boxes(spark, sf_dir), F.lit(WIDTH), F.lit(HEIGHT), _margins()).select("doc_id", "page_no", "box_no", "ignored_by")


@register(
    "p4_content_boxes",
    sql("b_pages")
    + """, m AS (SELECT *, least(50.4, 0.45 * height_pt) AS t, least(41.3, 0.45 * height_pt) AS b, least(35.0, 0.45 * width_pt) AS s FROM b_pages)
SELECT page_id, round(s, 3) AS x0, round(t, 3) AS y0, round(greatest(s, width_pt - s), 3) AS x1, round(greatest(t, height_pt - b), 3) AS y1, CAST(4 AS INTEGER) AS bands, round(width_pt * t, 2) AS header_area FROM m""",
)
def p4_content_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live area and the bands of each page."""
    p = bindings.pages(spark, sf_dir)
    m = g.normal_margins({k: F.lit(v) for k, v in MARGINS.items()}, F.col("width_pt"), F.col("height_pt"))
    b, bands = g.content_box(F.col("width_pt"), F.col("height_pt"), m), g.band_boxes(F.col("width_pt"), F.col("height_pt"), m)
    return p.select("page_id", *[F.round(c, 3).alias(n) for c, n in zip(b, g.BOX)], F.size(bands).alias("bands"), F.round(g.area((bands[0]["x0"], bands[0]["y0"], bands[0]["x1"], bands[0]["y1"])), 2).alias("header_area"))


_OVER = "(least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_PAIRS = f""", t AS MATERIALIZED (SELECT *, (box_no - 1) // 8 AS block_no, (box_no - 1) // 2 AS line_no FROM b_boxes),
n AS MATERIALIZED (SELECT *, CAST(floor(y0 / 32) AS INTEGER) AS first_bin, unnest(range(CAST(floor(y0 / 32) AS INTEGER), CAST(floor(y1 / 32) AS INTEGER) + 1)) AS bin FROM t),
p AS (SELECT a.doc_id, a.page_no, a.box_no AS a_box_no, b.box_no AS b_box_no, round({_OVER}, 3) AS overlap,
    a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1
  FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.bin = b.bin
  WHERE a.box_no < b.box_no AND a.bin = greatest(a.first_bin, b.first_bin)
    AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1
    AND NOT (a.block_no = b.block_no AND a.line_no = b.line_no)
    AND NOT (a.block_no = b.block_no AND abs(b.y0 - a.y0) >= 0.55 * least(a.y1 - a.y0, b.y1 - b.y0))
    AND {_OVER} >= 1.0 AND ({_OVER} >= 0.20 * least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0))
    OR (least(a.x1, b.x1) - greatest(a.x0, b.x0) >= 6 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) >= 6) OR {_OVER} >= 25))"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as text spans: two on a line, four lines in a block."""
    return bindings.boxes(spark, sf_dir).withColumns({"block_no": F.expr("(box_no - 1) div 8"), "line_no": F.expr("(box_no - 1) div 2")})


@register("j10_text_collisions", sql("b_boxes") + _PAIRS + " SELECT doc_id, page_no, a_box_no, b_box_no, overlap FROM p")
def j10_text_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colliding box pairs of each page."""
    return spatial.collisions(_spans(spark, sf_dir)).select("doc_id", "page_no", "a_box_no", "b_box_no", "overlap")


@register(
    "j11_not_inside_artwork",
    sql("b_boxes")
    + _PAIRS
    + """ SELECT doc_id, page_no, a_box_no, b_box_no, overlap FROM p WHERE NOT EXISTS (SELECT 1 FROM b_boxes g WHERE g.kind = 'R' AND g.doc_id = p.doc_id AND g.page_no = p.page_no
   AND ax0 >= g.x0 - 14 AND ay0 >= g.y0 - 14 AND ax1 <= g.x1 + 14 AND ay1 <= g.y1 + 14 AND bx0 >= g.x0 - 14 AND by0 >= g.y0 - 14 AND bx1 <= g.x1 + 14 AND by1 <= g.y1 + 14)""",
)
def j11_not_inside_artwork(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collisions that do not lie within one graphic."""
    b = bindings.boxes(spark, sf_dir)
    return spatial.within_same(spatial.collisions(_spans(spark, sf_dir)), b.where("kind = 'R'")).select("doc_id", "page_no", "a_box_no", "b_box_no", "overlap")


@register("a19_merged_collisions")
def a19_merged_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touching collisions as one finding each; tested against a loop, as each row depends on those before it."""
    return layout.merged_collisions(spatial.collisions(_spans(spark, sf_dir)))


@register(
    "j12_boxes_off_codes",
    sql("b_boxes", "b_codes")
    + """, c AS (SELECT DISTINCT doc_id, page_no, type FROM b_codes WHERE decoded), k AS (SELECT doc_id, page_no, CASE WHEN type = 'QRCODE' THEN 100.0 ELSE 300.0 END AS x0, 200.0 AS y0, CASE WHEN type = 'QRCODE' THEN 160.0 ELSE 420.0 END AS x1, 260.0 AS y1 FROM c)
SELECT doc_id, page_no, box_no FROM b_boxes b WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = b.doc_id AND k.page_no = b.page_no AND b.x0 < k.x1 + 5 AND k.x0 - 5 < b.x1 AND b.y0 < k.y1 + 5 AND k.y0 - 5 < b.y1)""",
)
def j12_boxes_off_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphics that touch no code grown by 5 pt."""
    c = bindings.codes(spark, sf_dir).where("decoded").select("doc_id", "page_no", "type").distinct()
    qr = F.col("type") == "QRCODE"
    k = c.select("doc_id", "page_no", F.when(qr, 100.0).otherwise(300.0).alias("x0"), F.lit(200.0).alias("y0"), F.when(qr, 160.0).otherwise(420.0).alias("x1"), F.lit(260.0).alias("y1"))
    return spatial.outside(bindings.boxes(spark, sf_dir), k, 5.0).select("doc_id", "page_no", "box_no")


@register(
    "j14_table_images",
    sql("b_boxes")
    + """ SELECT doc_id, page_no, box_no, CASE WHEN EXISTS (SELECT 1 FROM b_boxes t WHERE t.kind = 'A' AND t.doc_id = b.doc_id AND t.page_no = b.page_no AND b.x0 < t.x1 + 2 AND t.x0 - 2 < b.x1 AND b.y0 < t.y1 + 2 AND t.y0 - 2 < b.y1) THEN 'table_image' ELSE 'image' END AS label FROM b_boxes b WHERE kind = 'N'""",
)
def j14_table_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops labelled by whether they meet a ruled region grown by 2 pt."""
    b = bindings.boxes(spark, sf_dir)
    crops = b.where("kind = 'N'")
    met = spatial.meeting(crops, b.where("kind = 'A'"), 2.0).select("doc_id", "page_no", "box_no", F.lit("table_image").alias("label"))
    return crops.join(met, ["doc_id", "page_no", "box_no"], "left").select("doc_id", "page_no", "box_no", F.coalesce("label", F.lit("image")).alias("label"))


@register(
    "m5_without_nested",
    sql("b_boxes")
    + """ SELECT doc_id, page_no, box_no FROM b_boxes a WHERE NOT EXISTS (SELECT 1 FROM b_boxes b WHERE a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.box_no <> b.box_no
   AND a.x0 >= b.x0 AND a.y0 >= b.y0 AND a.x1 <= b.x1 AND a.y1 <= b.y1 AND (b.x1 - b.x0) * (b.y1 - b.y0) > 1.15 * (a.x1 - a.x0) * (a.y1 - a.y0))""",
)
def m5_without_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that lie in no box over 1.15 times as large."""
    return spatial.without_nested(bindings.boxes(spark, sf_dir)).select("doc_id", "page_no", "box_no")


@register(
    "j18_innermost_parents",
    sql("b_boxes")
    + """ SELECT a.doc_id, a.page_no, a.box_no, arg_min(b.box_no, struct_pack(a := round((b.x1 - b.x0) * (b.y1 - b.y0), 6), b := b.box_no)) AS parent_no FROM b_boxes a JOIN b_boxes b
  ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.box_no <> b.box_no AND a.x0 >= b.x0 - 8 AND a.y0 >= b.y0 - 8 AND a.x1 <= b.x1 + 8 AND a.y1 <= b.y1 + 8
  AND (a.x1 - a.x0) * (a.y1 - a.y0) < 0.96 * ((b.x1 - b.x0) * (b.y1 - b.y0)) GROUP BY ALL""",
)
def j18_innermost_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost enclosing box of each box."""
    return spatial.innermost_parent(bindings.boxes(spark, sf_dir))


@register(
    "w2_reading_order",
    sql("b_boxes")
    + """ SELECT doc_id, page_no, box_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY round_even(y0, 1), round_even(x0, 1), box_no) AS INTEGER) AS slot,
  min(box_no) OVER (PARTITION BY doc_id, page_no) = box_no AS is_first, max(box_no) OVER (PARTITION BY doc_id, page_no) = box_no AS is_last FROM b_boxes""",
)
def w2_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading order and first / last box of each page."""
    return layout.reading_order(bindings.boxes(spark, sf_dir))


@register(
    "k18_sheets",
    sql("b_pages")
    + """, s(i, name, w, h) AS (VALUES """
    + ", ".join(f"({i}, '{n}', {w}::DOUBLE, {h}::DOUBLE)" for i, (n, w, h) in enumerate(layout.SHEETS_MM))
    + """), e AS (SELECT page_id, width_pt, height_pt, i, name, greatest(abs(least(width_pt, height_pt) * 25.4 / 72 - least(w, h)), abs(greatest(width_pt, height_pt) * 25.4 / 72 - greatest(w, h))) AS err FROM b_pages, s),
k AS (SELECT page_id, arg_min(name, struct_pack(a := round(err, 6), b := i)) AS name, min(round(err, 6)) AS err, any_value(width_pt) AS w, any_value(height_pt) AS h FROM e GROUP BY page_id)
SELECT page_id, CASE WHEN err <= 2.5 THEN name ELSE printf('Custom %.0f×%.0f mm', round_even(least(w, h) * 25.4 / 72, 0), round_even(greatest(w, h) * 25.4 / 72, 0)) END AS sheet,
  err < 0.5 AS exact, CASE WHEN w > h THEN 'landscape' ELSE 'portrait' END AS orientation FROM k""",
)
def k18_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheet name and orientation of each page."""
    return layout.classified_sheets(bindings.pages(spark, sf_dir)).select("page_id", "sheet", "exact", "orientation")


@register(
    "k19_document_sizes",
    sql("b_pages")
    + """, r AS (SELECT doc_id, round_even(width_pt * 25.4 / 72, 0) AS w, count(*) AS n FROM b_pages GROUP BY 1, 2)
SELECT doc_id, sum(n)::BIGINT AS pages, arg_max(w, struct_pack(a := n, b := w)) AS width_mm, max(n) AS dominant, count(*) = 1 AS unanimous,
  CASE WHEN count(*) = 1 THEN '' ELSE format('({:d} of {:d} pages differ)', (sum(n) - max(n))::BIGINT, sum(n)::BIGINT) END AS note FROM r GROUP BY doc_id""",
)
def k19_document_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's dominant page width and whether its pages agree."""
    p = bindings.pages(spark, sf_dir).withColumn("w", F.bround(F.col("width_pt") * 25.4 / 72, 0))
    return layout.dominant(p, ["doc_id"], "w").withColumnRenamed("value", "width_mm")


@register(
    "o4_sampled_pages",
    sql("b_pages")
    + """, t AS (SELECT doc_id, max(page_no) AS n FROM b_pages GROUP BY doc_id), i AS (SELECT doc_id, n, unnest(generate_series(0, 7)) AS i FROM t)
SELECT DISTINCT doc_id, CAST(p AS INTEGER) AS page_no FROM (
  SELECT doc_id, least(n, 1 + round_even(i * n / 8, 0)) AS p FROM i WHERE n > 8 UNION ALL SELECT doc_id, n FROM t UNION ALL SELECT doc_id, 1 FROM t UNION ALL SELECT doc_id, page_no FROM b_pages JOIN t USING (doc_id) WHERE n <= 8)""",
)
def o4_sampled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An even sample of each document's pages, the first and last always in."""
    return layout.sampled_pages(bindings.pages(spark, sf_dir).groupBy("doc_id").agg(F.max("page_no").alias("total")), want=8)


@register(
    "w9_column_gutters",
    sql("b_boxes")
    + """, s AS (SELECT doc_id, page_no, CAST(floor(min(x0) / 3) AS BIGINT) AS lo, CAST(floor(max(x1) / 3) AS BIGINT) AS hi FROM b_boxes GROUP BY 1, 2),
f AS (SELECT DISTINCT doc_id, page_no, unnest(generate_series(CAST(floor(x0 / 3) AS BIGINT), CAST(floor(x1 / 3) AS BIGINT))) AS b FROM b_boxes),
g AS (SELECT doc_id, page_no, b, lead(b) OVER (PARTITION BY doc_id, page_no ORDER BY b) AS nxt FROM f)
SELECT doc_id, page_no, (b + 1) * 3.0::DOUBLE AS x0, nxt * 3.0::DOUBLE AS x1 FROM g WHERE nxt - b - 1 >= 3""",
)
def w9_column_gutters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty vertical strips of at least 9 pt between boxes."""
    return layout.gutters(bindings.boxes(spark, sf_dir))


@register(
    "w10_clustered_positions",
    sql("b_boxes")
    + """, g AS (SELECT doc_id, page_no, y0, CASE WHEN y0 - lag(y0) OVER (PARTITION BY doc_id, page_no ORDER BY y0) <= 5 THEN 0 ELSE 1 END AS new FROM b_boxes),
k AS (SELECT doc_id, page_no, y0, sum(new) OVER (PARTITION BY doc_id, page_no ORDER BY y0 ROWS UNBOUNDED PRECEDING) AS cluster FROM g)
SELECT doc_id, page_no, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, round_even(avg(y0), 0) AS position FROM k GROUP BY 1, 2, 3""",
)
def w10_clustered_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes' tops clustered where neighbours are at most 5 pt apart."""
    return layout.clustered(bindings.boxes(spark, sf_dir), ["doc_id", "page_no"], "y0", 5.0)
