"""Queries on places: padding, sliding, anchors, page expressions, skips, coverage, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import findings as fd
from tessera.operators import layout
from tessera.plans.registry import register
from tessera.sources import bindings
from tessera.sources.bindings import sql
from tessera.sources.documents import in_scope

W, H = 595.0, 842.0


@register(
    "p16_padded_boxes",
    sql("b_boxes")
    + """ SELECT doc_id, page_no, box_no, round(greatest(0, x0 - 2), 3) AS x0, round(greatest(0, y0 - 2), 3) AS y0, round(least(595.0, x1 + 2), 3) AS x1, round(least(842.0, y1 + 2), 3) AS y1,
  round(greatest(0.0, least(x0, 400.0 - (x1 - x0))), 3) AS slid_x0, round(greatest(0.0, least(y0, 600.0 - (y1 - y0))), 3) AS slid_y0 FROM b_boxes""",
)
def p16_padded_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes grown by 2 pt and kept on the page, and slid onto a smaller page."""
    p, s = g.padded(g.box(), 2.0, F.lit(W), F.lit(H)), g.slid_inside(g.box(), F.lit(400.0), F.lit(600.0))
    return bindings.boxes(spark, sf_dir).select("doc_id", "page_no", "box_no", *[F.round(c, 3).alias(n) for c, n in zip(p, g.BOX)], F.round(s[0], 3).alias("slid_x0"), F.round(s[1], 3).alias("slid_y0"))


@register(
    "p25_anchored_regions",
    sql("b_boxes")
    + """, a AS (SELECT *, 595.0 - x1 < x0 AS r, 842.0 - y1 < y0 AS b FROM b_boxes WHERE x1 <= 595 AND y1 <= 842)
SELECT doc_id, page_no, box_no, CASE WHEN r THEN 'right' ELSE 'left' END AS x_edge, CASE WHEN b THEN 'bottom' ELSE 'top' END AS y_edge,
  round(greatest(0.0, least(CASE WHEN r THEN 420.0 - (595.0 - x1) - (x1 - x0) ELSE x0 END, 420.0 - (x1 - x0))), 2) AS x0, round(greatest(0.0, least(CASE WHEN b THEN 595.0 - (842.0 - y1) - (y1 - y0) ELSE y0 END, 595.0 - (y1 - y0))), 2) AS y0 FROM a""",
)
def p25_anchored_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions anchored on A4 and placed on A5."""
    b = bindings.boxes(spark, sf_dir).where(f"x1 <= {W} AND y1 <= {H}").withColumn("a", g.anchored(g.box(), F.lit(W), F.lit(H)))
    placed = g.from_anchor(F.col("a"), F.lit(420.0), F.lit(595.0))
    return b.select("doc_id", "page_no", "box_no", "a.x_edge", "a.y_edge", F.round(placed[0], 2).alias("x0"), F.round(placed[1], 2).alias("y0"))


@register(
    "t12_page_expressions",
    """WITH e AS (SELECT o_orderkey, 1 + o_orderkey % 9 AS a, 3 + o_orderkey % 5 AS b, 2 + o_orderkey % 11 AS c FROM orders)
SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter(list_concat([a], generate_series(least(b, c), greatest(b, c))), lambda p: p >= 1 AND p <= 10))), ',') AS pages FROM e""",
)
def t12_page_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page lists of expressions with single pages and (reversed) ranges."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.expr("concat(1 + o_orderkey % 9, '; ', 3 + o_orderkey % 5, ' - ', 2 + o_orderkey % 11, ', x')").alias("t"))
    return o.select("o_orderkey", F.array_join(g.page_numbers(F.col("t"), F.lit(10)), ",").alias("pages"))


@register(
    "p3_skipped_margins",
    sql("b_pages")
    + """, t AS (SELECT doc_id, page_no, max(page_no) OVER (PARTITION BY doc_id) AS total FROM b_pages)
SELECT doc_id, page_no, CASE WHEN page_no = 1 THEN 'footer,header' WHEN page_no = total THEN 'header' WHEN page_no = 3 THEN 'left' ELSE '' END AS off FROM t""",
)
def p3_skipped_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The margins that are switched off on each page."""
    p = bindings.pages(spark, sf_dir)
    totals = p.groupBy("doc_id").agg(F.max("page_no").alias("total"))
    skips = spark.createDataFrame([("first", "header"), ("first", "footer"), ("last", "header"), ("3", "left")], "page_at string, side string")
    return layout.skipped_margins(p.select("doc_id", "page_no").join(totals, "doc_id"), skips, ["doc_id"]).select("doc_id", "page_no", "off")


@register(
    "j26_extra_boxes",
    sql("b_boxes")
    + """, c AS (SELECT a.doc_id, a.page_no, a.box_no, sum((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))) AS covered FROM b_boxes a JOIN b_boxes b
  ON a.kind = 'N' AND b.kind = 'A' AND a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 GROUP BY 1, 2, 3)
SELECT a.doc_id, a.page_no, a.box_no FROM b_boxes a LEFT JOIN c USING (doc_id, page_no, box_no) WHERE a.kind = 'N' AND coalesce(round(covered, 3), 0) < round(0.5 * (a.x1 - a.x0) * (a.y1 - a.y0), 3)""",
)
def j26_extra_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of which less than half is claimed."""
    b = bindings.boxes(spark, sf_dir)
    return layout.uncovered(b.where("kind = 'N'"), b.where("kind = 'A'")).select("doc_id", "page_no", "box_no")


@register(
    "j29_metadata_notes",
    sql("b_pages")
    + """, d AS (SELECT doc_id, doc_id // 5 AS batch_id, count(*) FILTER (page_no % 7 <> doc_id % 3) AS pages, CASE WHEN doc_id % 4 = 3 THEN 'A5' ELSE 'A4' END AS sheet FROM b_pages GROUP BY doc_id), m AS (SELECT * FROM d WHERE doc_id % 5 = 0)
SELECT d.batch_id, d.doc_id, concat_ws('; ', CASE WHEN d.pages IS DISTINCT FROM m.pages THEN concat('page count differs (master ', coalesce(CAST(m.pages AS VARCHAR), '-'), ')') END, CASE WHEN d.sheet IS DISTINCT FROM m.sheet THEN 'sheet size differs' END) AS note
FROM d LEFT JOIN m ON d.batch_id = m.batch_id WHERE d.doc_id % 5 <> 0""",
)
def j29_metadata_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs from the master in pages and sheet size."""
    d = bindings.pages(spark, sf_dir).groupBy("doc_id").agg(F.count_if(F.col("page_no") % 7 != F.col("doc_id") % 3).alias("pages"))
    d = d.select("doc_id", F.expr("doc_id div 5").alias("batch_id"), "pages", F.when(F.col("doc_id") % 4 == 3, "A5").otherwise("A4").alias("sheet"), F.when(F.col("doc_id") % 5 == 0, "master").otherwise("translation").alias("role"))
    return layout.metadata_notes(d, ["batch_id"])


@register(
    "j30_resolved_names",
    """WITH p AS (SELECT url AS path, concat('page_', page_id, '_', substr(url, 1, 12)) AS filename FROM pages), r AS (SELECT DISTINCT CASE WHEN page_id % 3 = 0 THEN concat('page_', page_id, '_', substr(url, 1, 12)) WHEN page_id % 3 = 1 THEN concat('page_', page_id, '_ht') ELSE concat('page_', page_id // 10) END AS name FROM pages)
SELECT r.name, coalesce((SELECT min(path) FROM p WHERE p.filename = r.name), (SELECT CASE WHEN count(*) = 1 THEN min(path) END FROM p WHERE starts_with(p.filename, regexp_replace(r.name, '([^.].*)[.][^.]*$', '\\1')))) AS path FROM r""",
)
def j30_resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result names resolved to files, exactly or by a unique prefix."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    full = F.expr("concat('page_', page_id, '_', substr(url, 1, 12))")
    names = p.select(F.when(F.col("page_id") % 3 == 0, full).when(F.col("page_id") % 3 == 1, F.expr("concat('page_', page_id, '_ht')")).otherwise(F.expr("concat('page_', page_id div 10)")).alias("name")).distinct()
    return layout.resolved_paths(names, p.select(F.col("url").alias("path"), full.alias("filename")))


@register(
    "a23_run_times",
    """WITH l AS (SELECT o_custkey // 20 AS batch_id, CASE WHEN o_orderkey % 9 = 0 THEN 'master' ELSE 'translation' END AS role, CAST(o_orderkey % 100 AS DOUBLE) / 4 AS seconds FROM orders)
SELECT batch_id, coalesce(sum(seconds) FILTER (role = 'master'), 0) AS master_s, coalesce(sum(seconds) FILTER (role <> 'master'), 0) AS translations_s, count(*) FILTER (role <> 'master') AS translations,
  CASE WHEN count(*) FILTER (role <> 'master') > 0 THEN round_even(sum(seconds) FILTER (role <> 'master') / count(*) FILTER (role <> 'master'), 3) END AS average_s, sum(seconds) AS total_s FROM l GROUP BY 1""",
)
def a23_run_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of the master and the translations of each batch."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return fd.run_times(o.select(F.expr("o_custkey div 20").alias("batch_id"), F.when(F.col("o_orderkey") % 9 == 0, "master").otherwise("translation").alias("role"), ((F.col("o_orderkey") % 100).cast("double") / 4).alias("seconds")))


@register(
    "s4_documents_in_scope",
    """WITH d AS (SELECT page_id // 20 AS batch_id, CASE WHEN page_id % 20 = 7 THEN 'master' ELSE 'translation' END AS role, CASE WHEN page_id % 2 = 0 THEN upper(url) ELSE url END AS path FROM pages),
k AS (SELECT *, row_number() OVER (PARTITION BY batch_id, lower(path) ORDER BY role = 'master' DESC, path) AS n FROM d)
SELECT batch_id, role, path, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY role = 'master' DESC, lower(path)) AS INTEGER) AS place FROM k WHERE n = 1""",
)
def s4_documents_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch's files once, the master first."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    d = p.select(F.expr("page_id div 20").alias("batch_id"), F.when(F.col("page_id") % 20 == 7, "master").otherwise("translation").alias("role"), F.when(F.col("page_id") % 2 == 0, F.upper("url")).otherwise(F.col("url")).alias("path"))
    return in_scope(d)
