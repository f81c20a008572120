"""Queries on links, outlines, boxes sifted and merged, codes and crops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import boxes as bx
from tessera.operators import links as lk
from tessera.operators import outline as ol
from tessera.operators import placement, spatial, summaries
from tessera.plans.layout import HEIGHT, WIDTH
from tessera.plans.registry import register
from tessera.sources import bindings
from tessera.sources.bindings import sql

PAIR, DOC = ["batch_id"], ["batch_id", "role"]


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as link rectangles: the kind is the target, the box number the text."""
    return bindings.boxes(spark, sf_dir).withColumns({"seq": F.col("box_no"), "text": F.col("box_no").cast("string"), "target": F.col("kind")})


@register("w15_merged_links")
def w15_merged_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrapped links as one; tested against a loop, as each piece depends on those before it."""
    return lk.merged_links(_pieces(spark, sf_dir), ["doc_id", "page_no"], ["target"])


_K4 = """, h AS (SELECT doc_id, page_no, y0 AS y, concat(1 + box_no % 9, '.', 1 + box_no % 4, '.', 1 + doc_id % 3) AS code FROM b_boxes WHERE kind = 'R' AND box_no % 5 = 0)"""


@register(
    "k4_links_with_topics",
    sql("b_boxes")
    + _K4
    + """, k AS (SELECT b.*, (SELECT arg_max(code, struct_pack(p := h.page_no, y := h.y, c := h.code)) FROM h WHERE h.doc_id = b.doc_id AND (h.page_no < b.page_no OR (h.page_no = b.page_no AND h.y <= b.y0 + 5))) AS code FROM b_boxes b WHERE kind = 'A')
SELECT doc_id, page_no, box_no, coalesce(code, '') AS topic, coalesce(array_to_string(string_split(code, '.')[1:2], '.'), '') AS section FROM k""",
)
def k4_links_with_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with the topic they stand in and its section."""
    b = bindings.boxes(spark, sf_dir)
    h = b.where("kind = 'R' AND box_no % 5 = 0").select("doc_id", "page_no", F.col("y0").alias("y"), F.expr("concat(1 + box_no % 9, '.', 1 + box_no % 4, '.', 1 + doc_id % 3)").alias("code"))
    return lk.with_topic(b.where("kind = 'A'"), h, ["doc_id"]).select("doc_id", "page_no", "box_no", "topic", "section")


@register(
    "w1_link_neighbours",
    sql("b_boxes") + " SELECT doc_id, page_no, box_no, lag(CAST(box_no AS VARCHAR)) OVER w AS before, lead(CAST(box_no AS VARCHAR)) OVER w AS after FROM b_boxes WINDOW w AS (PARTITION BY doc_id ORDER BY page_no, y0, x0, box_no)",
)
def w1_link_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each link with the texts of the one before and after it."""
    return lk.neighbours(_pieces(spark, sf_dir), ["doc_id"]).select("doc_id", "page_no", "box_no", "before", "after")


def _outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    generic = F.expr("(o_custkey div 2) % 3 = 0")
    return o.select(F.expr("o_custkey div 2").alias("batch_id"), F.when(F.col("o_custkey") % 2 == 0, "master").otherwise("translation").alias("role"), F.col("o_orderkey").alias("seq"), (1 + F.expr("o_orderkey div 40 % 20")).cast("int").alias("page_no"),
                    F.when(generic, 36.0).otherwise(F.expr("CAST(o_orderkey * 37 % 800 AS DOUBLE)")).alias("raw_y"), F.lit(842.0).alias("page_height"), F.expr("concat(1 + o_orderkey % 5, '.', 1 + (o_orderkey div 5) % 4)").alias("code"), F.col("o_orderpriority").alias("title"))


_OUTLINE = """WITH o AS (SELECT o_custkey // 2 AS batch_id, CASE WHEN o_custkey % 2 = 0 THEN 'master' ELSE 'translation' END AS role, o_orderkey AS seq, CAST(1 + o_orderkey // 40 % 20 AS INTEGER) AS page_no,
  CASE WHEN (o_custkey // 2) % 3 = 0 THEN 36.0::DOUBLE ELSE CAST(o_orderkey * 37 % 800 AS DOUBLE) END AS raw_y, concat(1 + o_orderkey % 5, '.', 1 + (o_orderkey // 5) % 4) AS code, o_orderpriority AS title FROM orders),
gn AS (SELECT batch_id, role, raw_y AS v, count(*) AS n, min(seq) AS first FROM o GROUP BY 1, 2, 3),
ge AS (SELECT batch_id, role, sum(n) >= 2 AND max(n) / sum(n) >= 0.8 AND (842.0 - arg_min(v, struct_pack(a := -n, b := first))) / 842.0 > 0.5 AS generic FROM gn GROUP BY 1, 2)"""


@register("a11_generic_destinations", _OUTLINE + " SELECT batch_id, role, generic FROM ge")
def a11_generic_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines that point everything at one low spot."""
    return ol.generic_destinations(_outline(spark, sf_dir), DOC)


_PRINTED = """, pr AS (SELECT batch_id, role, page_no, code, max(CAST(seq % 700 AS DOUBLE)) AS y FROM o WHERE seq % 3 = 0 GROUP BY 1, 2, 3, 4),
pl AS (SELECT o.batch_id, o.role, o.seq, o.page_no, coalesce(pr.y, CASE WHEN ge.generic THEN 0 ELSE 842.0 - raw_y END) AS y, o.code, o.title FROM o LEFT JOIN ge USING (batch_id, role) LEFT JOIN pr USING (batch_id, role, page_no, code))"""


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outline(spark, sf_dir).where("seq % 3 = 0").select(*DOC, "page_no", F.expr("CAST(seq % 700 AS DOUBLE)").alias("y"), "code", "title")


@register("j27_printed_places", _OUTLINE + _PRINTED + " SELECT batch_id, role, seq, page_no, round(y, 3) AS y, code FROM pl")
def j27_printed_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline entries at the places where their headings are printed."""
    o = _outline(spark, sf_dir).join(ol.generic_destinations(_outline(spark, sf_dir), DOC), DOC, "left").withColumn("y", F.when(F.col("generic"), 0.0).otherwise(F.col("page_height") - F.col("raw_y")))
    return ol.corrected(o, _printed(spark, sf_dir), DOC).select(*DOC, "seq", "page_no", F.round("y", 3).alias("y"), "code")


@register(
    "k3_topics_with_positions",
    _OUTLINE.replace("WITH o AS", "WITH RECURSIVE o AS")
    + _PRINTED
    + """, nu AS (SELECT *, row_number() OVER (PARTITION BY batch_id, role ORDER BY seq) AS n FROM pl),
r AS (SELECT batch_id, role, n, page_no AS p, y, code, title FROM nu WHERE n = 1
  UNION ALL SELECT nu.batch_id, nu.role, nu.n, CASE WHEN nu.page_no < r.p THEN r.p ELSE nu.page_no END, CASE WHEN nu.page_no < r.p OR (nu.page_no = r.p AND nu.y < r.y) THEN r.y + 0.1 ELSE nu.y END, nu.code, nu.title
  FROM r JOIN nu ON nu.batch_id = r.batch_id AND nu.role = r.role AND nu.n = r.n + 1)
SELECT batch_id, role, p AS page_no, round(y, 3) AS y, code, title FROM r""",
)
def k3_topics_with_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics with positions: boilerplate cleared, printed places taken, the outline's order kept."""
    return ol.topics_with_positions(_outline(spark, sf_dir), _printed(spark, sf_dir), DOC).withColumn("y", F.round("y", 3))


_RANKED = """, rk AS (SELECT *, (x1 - x0) * (y1 - y0) AS area, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY -greatest(x1 - x0, 0) * greatest(y1 - y0, 0), box_no) AS n FROM b_boxes),
kept AS (SELECT doc_id, page_no, n, [struct_pack(b := box_no, x0 := x0, y0 := y0, x1 := x1, y1 := y1)] AS l FROM rk WHERE n = 1
  UNION ALL SELECT rk.doc_id, rk.page_no, rk.n, CASE WHEN len(list_filter(l, lambda k: %s)) > 0 THEN l ELSE list_append(l, struct_pack(b := box_no, x0 := rk.x0, y0 := rk.y0, x1 := rk.x1, y1 := rk.y1)) END
  FROM kept JOIN rk ON rk.doc_id = kept.doc_id AND rk.page_no = kept.page_no AND rk.n = kept.n + 1),
last AS (SELECT doc_id, page_no, unnest(arg_max(l, n)) AS k FROM kept GROUP BY 1, 2)
SELECT doc_id, page_no, k.b AS box_no FROM last"""
_SHARED = "(greatest(0, least(k.x1, rk.x1) - greatest(k.x0, rk.x0)) * greatest(0, least(k.y1, rk.y1) - greatest(k.y0, rk.y0)))"


def _recursive(name: str) -> str:
    return sql(name).replace("WITH ", "WITH RECURSIVE ", 1)


@register("m4_without_duplicates", _recursive("b_boxes") + _RANKED % f"{_SHARED} > 0.80 * ((k.x1 - k.x0) * (k.y1 - k.y0) + area - {_SHARED})")
def m4_without_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that repeat no larger one."""
    return bx.without_duplicates(bindings.boxes(spark, sf_dir)).select("doc_id", "page_no", "box_no")


@register("m6_without_covered", _recursive("b_boxes") + _RANKED % f"{_SHARED} >= 0.85 * area")
def m6_without_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that lie in no larger kept one."""
    return bx.without_covered(bindings.boxes(spark, sf_dir)).select("doc_id", "page_no", "box_no")


@register("m3_figure_components")
def m3_figure_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures put together from their parts, to the fixpoint; tested against a loop."""
    return bx.merged(bindings.boxes(spark, sf_dir).where("kind = 'R'"), bx.figure_parts, 12.0)


@register("m2_tight_merges")
def m2_tight_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of one icon merged, to the fixpoint."""
    return bx.merged(bindings.boxes(spark, sf_dir).where("kind = 'A'"), bx.close_parts, 10.0)


@register(
    "p10_plausible_tables",
    sql("b_boxes") + """ SELECT doc_id, page_no, box_no, x1 - x0 >= 20 AND y1 - y0 >= 20 AND x0 >= -2 AND y0 >= -2 AND x1 <= 597 AND y1 <= 844 AND (x1 - x0) * (y1 - y0) / (595.0 * 842.0) <= 0.6 AS table_like,
  (y0 < 45 AND y1 <= 65) OR (y1 > 792 AND y0 >= 772) AS furniture, NOT (((x1 - x0 <= 2.5 AND y1 - y0 > 20) OR (y1 - y0 <= 2.5 AND x1 - x0 > 20))) AND (x1 - x0) * (y1 - y0) <= 0.4 * 595.0 * 842.0 AND x1 - x0 > 1 AND y1 - y0 > 1 AS drawable FROM b_boxes""",
)
def p10_plausible_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which boxes can be tables, are furniture of the page, or count as drawings."""
    w, h = F.lit(WIDTH), F.lit(HEIGHT)
    return bindings.boxes(spark, sf_dir).select("doc_id", "page_no", "box_no", bx.plausible_table(g.box(), w, h).alias("table_like"), bx.in_header_or_footer(g.box(), h).alias("furniture"), bx.drawable(g.box(), w, h).alias("drawable"))


@register(
    "w11_clean_boundaries",
    _recursive("b_boxes")
    + """, v AS (SELECT doc_id, page_no, CAST(y0 AS DOUBLE) AS y, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y0) AS n, count(*) OVER (PARTITION BY doc_id, page_no) AS total FROM b_boxes),
r AS (SELECT doc_id, page_no, n, total, [y] AS p FROM v WHERE n = 1
  UNION ALL SELECT v.doc_id, v.page_no, v.n, v.total, CASE WHEN v.total <= 2 OR v.y - r.p[len(r.p)] >= 10 THEN list_append(r.p, v.y) ELSE r.p END FROM r JOIN v ON v.doc_id = r.doc_id AND v.page_no = r.page_no AND v.n = r.n + 1)
SELECT doc_id, page_no, array_to_string(list_transform(p, lambda x: CAST(CAST(round(x * 1000) AS BIGINT) AS VARCHAR)), ',') AS positions FROM r WHERE n = total""",
)
def w11_clean_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of a page thinned to gaps of ten points."""
    return bx.clean_boundaries(bindings.boxes(spark, sf_dir), ["doc_id", "page_no"], "y0").select("doc_id", "page_no", F.array_join(F.transform("positions", lambda x: F.round(x * 1000).cast("long").cast("string")), ",").alias("positions"))


@register(
    "w4_table_numbers",
    sql("b_boxes") + """, t AS (SELECT doc_id, page_no, box_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, y0, x0, box_no) AS table_no FROM b_boxes WHERE kind = 'A')
SELECT doc_id, page_no, box_no, CAST(table_no AS INTEGER) AS table_no, table_no = min(table_no) OVER p AS is_first, table_no = max(table_no) OVER p AS is_last FROM t WINDOW p AS (PARTITION BY doc_id, page_no)""",
)
def w4_table_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table numbers through each document."""
    return summaries.table_numbers(bindings.boxes(spark, sf_dir).where("kind = 'A'"), ["doc_id"]).select("doc_id", "page_no", "box_no", "table_no", "is_first", "is_last")


@register(
    "w3_crop_numbers",
    sql("b_boxes") + """, c AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y0, x0, box_no) AS INTEGER) AS crop_no FROM b_boxes)
SELECT doc_id, page_no, box_no, crop_no, concat('out/', concat('Topic ', doc_id), '/', format('p{:03d}_crop_{:02d}_', page_no, crop_no), kind, '.png') AS path FROM c WHERE kind <> 'N'""",
)
def w3_crop_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops numbered on their pages, with their paths."""
    c = summaries.crop_numbers(bindings.boxes(spark, sf_dir), ["doc_id"], F.col("kind") != "N")
    return c.select("doc_id", "page_no", "box_no", "crop_no", summaries.crop_path(F.lit("out"), F.concat(F.lit("Topic "), "doc_id"), F.col("page_no"), F.col("crop_no"), F.col("kind")).alias("path"))


@register(
    "k7b_codes_on_pages",
    sql("b_boxes") + """, d AS (SELECT * FROM b_boxes WHERE kind = 'A'), s AS (SELECT * FROM b_boxes WHERE kind = 'R' AND x1 - x0 >= 5 AND y1 - y0 >= 5)
SELECT doc_id, page_no, box_no, true AS decoded FROM d UNION ALL SELECT doc_id, page_no, box_no, false FROM s WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = s.doc_id AND d.page_no = s.page_no AND s.x0 < d.x1 + 4 AND d.x0 - 4 < s.x1 AND s.y0 < d.y1 + 4 AND d.y0 - 4 < s.y1)""",
)
def k7b_codes_on_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded codes, and shapes of codes that none of them explains."""
    b = bindings.boxes(spark, sf_dir)
    return summaries.all_codes(b.where("kind = 'A'"), b.where("kind = 'R'")).select("doc_id", "page_no", "box_no", "decoded")


@register(
    "p26_placed_regions",
    sql("b_pages") + """, r AS (SELECT *, greatest(0, least(width_pt - 120.0, width_pt - 60.0 - 120.0)) AS ax FROM b_pages)
SELECT page_id, CASE WHEN abs(width_pt - 595) < 1 AND abs(height_pt - 842) < 1 THEN 415.0 ELSE round(ax, 3) END AS x0, CASE WHEN abs(width_pt - 595) < 1 AND abs(height_pt - 842) < 1 THEN 30.0 ELSE round(greatest(0, least(30.0, height_pt - 40)), 3) END AS y0 FROM r""",
)
def p26_placed_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region near the right edge of an A4 page on pages of other sizes."""
    p = bindings.pages(spark, sf_dir)
    stored = tuple(F.lit(v) for v in (415.0, 30.0, 535.0, 70.0))
    anchor = g.anchored(stored, F.lit(WIDTH), F.lit(HEIGHT))
    none = F.expr("CAST(map() AS map<string, struct<x0:double,y0:double,x1:double,y1:double>>)")
    at = placement.placed(stored, none, F.lit("A4"), anchor, F.lit(WIDTH), F.lit(HEIGHT), F.col("width_pt"), F.col("height_pt"))
    return p.select("page_id", at.alias("b")).select("page_id", F.round("b.x0", 3).alias("x0"), F.round("b.y0", 3).alias("y0"))


@register(
    "j19_reparented_regions",
    sql("b_boxes")
    + """, pr AS (SELECT a.doc_id, a.page_no, a.box_no, arg_min(b.box_no, struct_pack(a := round((b.x1 - b.x0) * (b.y1 - b.y0), 6), b := b.box_no)) AS parent_no FROM b_boxes a JOIN b_boxes b
  ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.box_no <> b.box_no AND a.x0 >= b.x0 - 8 AND a.y0 >= b.y0 - 8 AND a.x1 <= b.x1 + 8 AND a.y1 <= b.y1 + 8
  AND (a.x1 - a.x0) * (a.y1 - a.y0) < 0.96 * ((b.x1 - b.x0) * (b.y1 - b.y0)) GROUP BY ALL),
r AS (SELECT b.doc_id, b.page_no, b.box_no AS id, CASE WHEN b.box_no % 7 = 0 THEN b.box_no - 1 END AS old_parent, pr.parent_no AS new_parent FROM b_boxes b LEFT JOIN pr USING (doc_id, page_no, box_no))
SELECT *, CASE WHEN new_parent IS NULL THEN 'orphaned' WHEN old_parent IS NULL THEN 'adopted' ELSE 'moved' END AS change FROM r WHERE old_parent IS DISTINCT FROM new_parent""",
)
def j19_reparented_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions whose parent by place is no longer the stored one."""
    b = bindings.boxes(spark, sf_dir)
    found = spatial.innermost_parent(b).withColumnRenamed("box_no", "id")
    r = b.select("doc_id", "page_no", F.col("box_no").alias("id"), F.when(F.col("box_no") % 7 == 0, F.col("box_no") - 1).alias("parent_id"))
    return placement.reparented(r, found, ["doc_id", "page_no"])


@register(
    "a8_column_tallies",
    sql("b_boxes") + """, t AS (SELECT doc_id, kind, count(*) AS n FROM b_boxes GROUP BY 1, 2) SELECT doc_id, string_agg(concat(kind, '=', n), ',' ORDER BY kind) AS tally FROM t GROUP BY 1""",
)
def a8_column_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each kind occurs in a document."""
    t = summaries.tally(bindings.boxes(spark, sf_dir), ["doc_id"], "kind")
    return t.select("doc_id", F.array_join(F.transform(F.map_entries("tally"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("tally"))


@register(
    "j28_anchored_counts",
    sql("b_boxes") + """, c AS (SELECT doc_id, kind, 1 AS page_no FROM b_boxes GROUP BY ALL), f AS (SELECT doc_id, kind, min(struct_pack(p := page_no, y := y0, x := x0)) AS f FROM b_boxes WHERE box_no % 3 = 0 GROUP BY ALL)
SELECT c.doc_id, c.kind, coalesce(f.p, c.page_no) AS page_no, f.y AS y0 FROM c LEFT JOIN f USING (doc_id, kind)""",
)
def j28_anchored_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count rows at the first image of their topic."""
    b = bindings.boxes(spark, sf_dir)
    c = b.select("doc_id", "kind").distinct().withColumn("page_no", F.lit(1))
    return summaries.anchored_counts(c, b.where("box_no % 3 = 0"), ["doc_id"], "kind")
