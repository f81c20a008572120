"""Queries on ink and crops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import crops as cr
from tessera.operators import crop_search, raster, sized_crops
from tessera.plans.registry import register
from tessera.sources import bindings
from tessera.sources.bindings import sql

_RUNS = ", r AS (SELECT doc_id, y, CAST(min(x) AS INTEGER) AS xs, CAST(max(x) + 1 AS INTEGER) AS xe FROM (SELECT *, x - row_number() OVER (PARTITION BY doc_id, y ORDER BY x) AS i FROM b_ink) GROUP BY doc_id, y, i)"


@register("r12_ink_runs", sql("b_ink") + _RUNS + " SELECT * FROM r")
def r12_ink_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink cells as runs."""
    return raster.runs(bindings.ink(spark, sf_dir))


_ROWS = _RUNS + """, q AS (SELECT DISTINCT doc_id, unnest(generate_series(1, 6)) AS y FROM b_ink),
k AS (SELECT q.doc_id, CAST(q.y AS INTEGER) AS y, coalesce(sum(greatest(0, least(xe, 4) - greatest(xs, 1))), 0)::BIGINT AS ink FROM q LEFT JOIN r ON q.doc_id = r.doc_id AND q.y = r.y GROUP BY 1, 2)"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ink = bindings.ink(spark, sf_dir)
    rects = ink.select("doc_id").distinct().select("doc_id", F.lit(0).alias("rect_id"), *[F.lit(v).alias(n) for n, v in (("x0", 1), ("y0", 1), ("x1", 4), ("y1", 7))])
    return raster.ink_rows(raster.runs(ink), rects)


@register("r1_ink_rows", sql("b_ink") + _ROWS + " SELECT doc_id, y, ink FROM k")
def r1_ink_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink per scan line of a rectangle."""
    return _rows(spark, sf_dir).drop("rect_id")


@register(
    "w8_longest_runs",
    sql("b_ink")
    + _ROWS
    + """, i AS (SELECT doc_id, ink = 0 AS blank, row_number() OVER (PARTITION BY doc_id ORDER BY y) - row_number() OVER (PARTITION BY doc_id, ink = 0 ORDER BY y) AS i FROM k), n AS (SELECT doc_id, blank, i, count(*) AS n FROM i GROUP BY 1, 2, 3)
SELECT doc_id, coalesce(max(n) FILTER (blank), 0) AS longest_blank, coalesce(max(n) FILTER (NOT blank), 0) AS longest_ink FROM n GROUP BY 1""",
)
def w8_longest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest series of blank and of inked scan lines."""
    return raster.longest_runs(_rows(spark, sf_dir)).drop("rect_id")


@register(
    "r5_rule_share",
    sql("b_ink")
    + _RUNS
    + """, v AS (SELECT doc_id, x, min(y) AS ys, max(y) + 1 AS ye FROM (SELECT *, y - row_number() OVER (PARTITION BY doc_id, x ORDER BY y) AS i FROM b_ink) GROUP BY doc_id, x, i),
c AS (SELECT doc_id, count(*) AS ink, count(*) FILTER (EXISTS (SELECT 1 FROM r WHERE r.doc_id = b.doc_id AND r.y = b.y AND b.x >= xs AND b.x < xe AND xe - xs >= 4) OR EXISTS (SELECT 1 FROM v WHERE v.doc_id = b.doc_id AND v.x = b.x AND b.y >= ys AND b.y < ye AND ye - ys >= 4)) AS rule_ink FROM b_ink b GROUP BY 1)
SELECT doc_id, ink, rule_ink, round_even(rule_ink / ink, 6) AS share FROM c""",
)
def r5_rule_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of ink in long horizontal or vertical runs."""
    return raster.rule_share(bindings.ink(spark, sf_dir), 4)


@register(
    "m9_ink_components",
    "WITH RECURSIVE "
    + bindings.SQL["b_ink"]
    + """, c(doc_id, x, y, k) AS (SELECT doc_id, x, y, y * 1000000 + x FROM b_ink UNION SELECT b.doc_id, b.x, b.y, c.k FROM c JOIN b_ink b ON b.doc_id = c.doc_id AND abs(b.x - c.x) <= 1 AND abs(b.y - c.y) <= 1),
m AS (SELECT doc_id, x, y, min(k) AS k FROM c GROUP BY 1, 2, 3)
SELECT doc_id, CAST(min(x) AS INTEGER) AS x0, CAST(min(y) AS INTEGER) AS y0, CAST(max(x) + 1 AS INTEGER) AS x1, CAST(max(y) + 1 AS INTEGER) AS y1, count(*) AS ink, CAST(k // 1000000 AS INTEGER) AS first_y, CAST(k % 1000000 AS INTEGER) AS first_x FROM m GROUP BY doc_id, k""",
)
def m9_ink_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected ink with box and size."""
    return raster.ink_components(raster.runs(bindings.ink(spark, sf_dir)))


@register(
    "r6_junctions",
    sql("b_ink")
    + _RUNS
    + """, v AS (SELECT doc_id, x, min(y) AS ys, max(y) + 1 AS ye FROM (SELECT *, y - row_number() OVER (PARTITION BY doc_id, x ORDER BY y) AS i FROM b_ink) GROUP BY doc_id, x, i)
SELECT r.doc_id, count(*) AS junctions FROM r JOIN v ON r.doc_id = v.doc_id AND v.x >= r.xs AND v.x < r.xe AND r.y >= v.ys AND r.y < v.ye AND r.xe - r.xs >= 3 AND v.ye - v.ys >= 3 GROUP BY 1""",
)
def r6_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings of horizontal and vertical rules."""
    ink = bindings.ink(spark, sf_dir)
    return raster.crossings(raster.runs(ink), raster.runs(ink, "y", "x"), 3)


@register(
    "r2_text_masked_ink",
    sql("b_ink")
    + """, k AS (SELECT doc_id, y, x FROM b_ink WHERE NOT (y >= 2 AND y < 5 AND ((x >= 2 AND x < 4) OR (x >= 3 AND x < 6))))
SELECT doc_id, y, CAST(min(x) AS INTEGER) AS xs, CAST(max(x) + 1 AS INTEGER) AS xe FROM (SELECT *, x - row_number() OVER (PARTITION BY doc_id, y ORDER BY x) AS i FROM k) GROUP BY doc_id, y, i""",
)
def r2_text_masked_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink with what lies under two text boxes of each page removed."""
    ink = bindings.ink(spark, sf_dir)
    text = F.array(*[F.struct(F.lit(a).alias("x0"), F.lit(2).alias("y0"), F.lit(b).alias("x1"), F.lit(5).alias("y1")) for a, b in ((2, 4), (3, 6))])
    boxes = ink.select("doc_id").distinct().select("doc_id", F.explode(text).alias("t")).select("doc_id", "t.*")
    return raster.subtracted(raster.runs(ink), boxes)


_SCORES = """, u AS (SELECT m.batch_id, m.topic_code, m.vec_id AS m, t.vec_id AS t, unnest(m.pixels) AS p, unnest(t.pixels) AS q FROM b_crops m JOIN b_crops t ON m.batch_id = t.batch_id AND m.topic_code = t.topic_code AND m.role = 'master' AND t.role = 'translation'),
s AS (SELECT batch_id, topic_code, m, t, round_even(corr(p, q), 6) AS score FROM u GROUP BY 1, 2, 3, 4)"""

GROUP = ["batch_id", "topic_code"]


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = bindings.crops(spark, sf_dir)
    return c.where("role = 'master'"), c.where("role = 'translation'")


@register("r7_crop_similarity", sql("b_crops") + _SCORES + " SELECT batch_id, topic_code, m, t, CAST(round_even(score * 100, 0) AS INTEGER) AS pct FROM s")
def r7_crop_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of the crops of each topic."""
    s = cr.scored_pairs(*_sides(spark, sf_dir), GROUP, "vec_id")
    return s.select(*GROUP, "m", "t", F.bround(F.col("score") * 100, 0).cast("int").alias("pct"))


@register(
    "o3_shortlist",
    sql("b_crops")
    + _SCORES
    + """, w AS (SELECT *, row_number() OVER (PARTITION BY batch_id, topic_code, m ORDER BY score DESC, t) AS place, max(score) OVER (PARTITION BY batch_id, topic_code, m) AS top FROM s)
SELECT batch_id, topic_code, m, t, CAST(place AS INTEGER) AS place FROM w WHERE place <= 3 OR score >= round_even(top - 0.12, 6)""",
)
def o3_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates worth a closer look for each master crop."""
    s = cr.scored_pairs(*_sides(spark, sf_dir), GROUP, "vec_id")
    return cr.shortlisted(s, [*GROUP, "m"]).drop("score")


@register("m1_crop_pairing")
def m1_crop_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one pairing of the crops of each topic."""
    return cr.paired(cr.scored_pairs(*_sides(spark, sf_dir), GROUP, "vec_id"), GROUP)


@register("k8_crop_sets")
def k8_crop_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each crop's result within its topic."""
    m, t = _sides(spark, sf_dir)
    return cr.crop_status(m, t, cr.paired(cr.scored_pairs(m, t, GROUP, "vec_id"), GROUP), GROUP, "vec_id")


@register("a20_crop_set_scores")
def a20_crop_set_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score and verdict of each batch's crops."""
    return cr.set_score(k8_crop_sets(spark, sf_dir), ["batch_id"])


def _sized(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Crops of the vectors' values as greys, six to eight rows of eight pixels or the same turned."""
    rows, turned = F.expr("CAST(6 + vec_id % 3 AS INT)"), F.expr("vec_id % 7 = 0")
    c = bindings.crops(spark, sf_dir).withColumns({"width": F.when(turned, rows).otherwise(8), "height": F.when(turned, 8).otherwise(rows)})
    c = c.withColumn("pixels", F.transform(F.slice("pixels", 1, F.col("width") * F.col("height")), lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round(128 + 64 * x, 3)))))
    return c.where("role = 'master'"), c.where("role <> 'master'")


@register("r7_sized_similarity")
def r7_sized_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops of unequal size within a topic, those of like aspect."""
    return sized_crops.sized_pairs(*_sized(spark, sf_dir), GROUP, "vec_id")


@register("k8_sized_sets")
def k8_sized_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each crop's result where crops of a topic have unequal sizes."""
    m, t = _sized(spark, sf_dir)
    return cr.crop_status(m, t, cr.paired(sized_crops.sized_pairs(m, t, GROUP, "vec_id"), GROUP), GROUP, "vec_id")


@register("k9_crop_search")
def k9_crop_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each crop of the masters sought in its topic's pages of the translation, then in the others."""
    c = bindings.crops(spark, sf_dir).withColumns({"width": F.lit(8), "height": F.lit(8), "pixels": F.transform("pixels", lambda x: F.round(128 + 64 * x, 3)), "topic": F.col("topic_code").cast("string")})
    m = c.where("role = 'master'").select("batch_id", F.col("vec_id").alias("no"), F.expr("CAST(1 + vec_id % 20 AS INT)").alias("page_no"), "topic", "width", "height", "pixels")
    t = c.where("role <> 'master'").select("batch_id", F.col("vec_id").alias("id"), F.expr("CAST(1 + (vec_id * 7) % 20 AS INT)").alias("page"), "topic_code", "topic", "width", "height", "pixels")
    spans = t.where("topic_code % 3 > 0").groupBy("batch_id", "topic").agg(F.min("page").alias("lo"), F.max("page").alias("hi"))
    totals = m.select("batch_id").distinct().withColumn("total", F.lit(20))
    return crop_search.searched(m, t.drop("topic", "topic_code"), spans, totals, ["batch_id"])
