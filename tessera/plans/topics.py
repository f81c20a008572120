"""Queries on topics, links, codes and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import code_key
from tessera.operators import inventories as inv
from tessera.operators import topics
from tessera.operators.asof import asof_last
from tessera.operators.link_alignment import internal_differences
from tessera.plans.registry import register
from tessera.sources import bindings
from tessera.sources.bindings import sql

DOC = ["batch_id", "role"]
PAIR = ["batch_id"]

_SPANS = """, tot AS (SELECT batch_id, role, max(page_no) AS total FROM b_outline GROUP BY 1, 2),
st AS (SELECT DISTINCT batch_id, role, code, page_no FROM b_outline),
nx AS (SELECT st.*, total, min(page_no) OVER (PARTITION BY batch_id, role ORDER BY page_no RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - 1 AS e FROM st JOIN tot USING (batch_id, role)),
sp AS (SELECT batch_id, role, code, greatest(1, min(least(page_no, coalesce(e, total)))) AS lo, least(max(total), max(greatest(page_no, coalesce(e, total)))) AS hi FROM nx GROUP BY 1, 2, 3)"""


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = bindings.outline(spark, sf_dir)
    totals = o.groupBy(*DOC).agg(F.max("page_no").alias("total"))
    return o, totals, topics.page_spans(o, totals, DOC)


@register("a12_topic_spans", sql("b_outline") + _SPANS + " SELECT batch_id, role, code, CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi FROM sp")
def a12_topic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages each topic of each document occupies."""
    return _spans(spark, sf_dir)[2]


@register(
    "j4_topic_at_page",
    sql("b_outline")
    + _SPANS
    + """, pg AS (SELECT DISTINCT batch_id, role, page_no FROM b_outline),
b AS (SELECT pg.batch_id, pg.role, pg.page_no, arg_max(code, struct_pack(a := lo, b := CAST(string_split(code, '.')[1] AS INTEGER), c := CAST(string_split(code, '.')[2] AS INTEGER))) AS code FROM pg JOIN sp ON pg.batch_id = sp.batch_id AND pg.role = sp.role AND page_no BETWEEN lo AND hi GROUP BY ALL)
SELECT pg.*, b.code FROM pg LEFT JOIN b USING (batch_id, role, page_no)""",
)
def j4_topic_at_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic that owns each page."""
    o, _, spans = _spans(spark, sf_dir)
    return topics.topic_at(o.select(*DOC, "page_no").distinct(), spans, DOC)


def _pair(spark: SparkSession, sf_dir: str):
    o, totals, spans = _spans(spark, sf_dir)
    side = lambda df, role: df.where(F.col("role") == role).drop("role")
    pages = side(o, "master").select(*PAIR, "page_no").distinct().join(side(totals, "translation").select(*PAIR), PAIR)
    return pages, side(spans, "master"), side(spans, "translation"), side(totals, "translation")


_PAGES = """, ms AS (SELECT * FROM sp WHERE role = 'master'), ts AS (SELECT * FROM sp WHERE role = 'translation'), tt AS (SELECT batch_id, total FROM tot WHERE role = 'translation'),
pg AS (SELECT DISTINCT batch_id, page_no, total FROM b_outline JOIN tt USING (batch_id) WHERE role = 'master'),
sh AS (SELECT ms.batch_id, ms.lo AS start, ts.lo - ms.lo AS delta FROM ms JOIN ts ON ms.batch_id = ts.batch_id AND ms.code = ts.code),
mp AS (SELECT pg.batch_id, pg.page_no, greatest(1, least(total, pg.page_no + coalesce((SELECT arg_max(delta, struct_pack(a := start, b := delta)) FROM sh WHERE sh.batch_id = pg.batch_id AND start <= pg.page_no), 0))) AS mapped FROM pg)"""


@register("j6_mapped_pages", sql("b_outline") + _SPANS + _PAGES + " SELECT batch_id, page_no, CAST(mapped AS INTEGER) AS mapped_page FROM mp")
def j6_mapped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of the translation that each master page became, by drift."""
    pages, master, target, totals = _pair(spark, sf_dir)
    return topics.mapped_pages(pages, topics.drift(master, target, PAIR), totals, PAIR)


@register(
    "j7_matching_pages",
    sql("b_outline")
    + _SPANS
    + _PAGES
    + """, ow AS (SELECT pg.batch_id, pg.page_no, arg_max(code, struct_pack(a := lo, b := CAST(string_split(code, '.')[1] AS INTEGER), c := CAST(string_split(code, '.')[2] AS INTEGER))) AS code FROM pg JOIN ms ON pg.batch_id = ms.batch_id AND page_no BETWEEN lo AND hi GROUP BY ALL),
us AS (SELECT DISTINCT batch_id FROM sh)
SELECT mp.batch_id, mp.page_no, ow.code, CAST(CASE WHEN ts.lo IS NOT NULL THEN greatest(ts.lo, least(ts.hi, ts.lo + mp.page_no - ms.lo)) WHEN us.batch_id IS NOT NULL THEN mapped ELSE mp.page_no END AS INTEGER) AS target_page,
  CASE WHEN ts.lo IS NOT NULL THEN 'topic' WHEN us.batch_id IS NOT NULL THEN 'drift' ELSE 'same page' END AS why
FROM mp LEFT JOIN ow ON mp.batch_id = ow.batch_id AND mp.page_no = ow.page_no LEFT JOIN ms ON ms.batch_id = mp.batch_id AND ms.code = ow.code
  LEFT JOIN ts ON ts.batch_id = mp.batch_id AND ts.code = ow.code LEFT JOIN us ON us.batch_id = mp.batch_id""",
)
def j7_matching_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of the translation that holds the same topic, with the reason."""
    pages, master, target, totals = _pair(spark, sf_dir)
    return topics.matching_pages(pages, master, target, totals, PAIR)


@register(
    "k1_toc_numerics",
    sql("b_outline")
    + """, p AS (SELECT batch_id, list(code ORDER BY seq, code) FILTER (role = 'master') AS m, list(code ORDER BY seq, code) FILTER (role = 'translation') AS t FROM b_outline GROUP BY batch_id),
d AS (SELECT *, list_filter(m, lambda c: NOT list_contains(t, c)) AS mi, list_filter(t, lambda c: NOT list_contains(m, c)) AS ex FROM (SELECT batch_id, coalesce(m, []) AS m, coalesce(t, []) AS t FROM p))
SELECT batch_id, CASE WHEN m = t THEN 'PASS' ELSE 'FAIL' END AS status, CAST(len(m) AS INTEGER) AS english_topic_count, CAST(len(t) AS INTEGER) AS translated_topic_count,
  CASE WHEN m = t THEN 'PASS' WHEN len(mi) + len(ex) = 0 THEN 'Order Mismatch' ELSE concat_ws(' | ', CASE WHEN len(mi) > 0 THEN concat('Missing: ', array_to_string(mi, ', ')) END, CASE WHEN len(ex) > 0 THEN concat('Extra: ', array_to_string(ex, ', ')) END) END AS diff_msg,
  array_to_string(mi, ', ') AS missing_topics, array_to_string(ex, ', ') AS extra_topics, array_to_string(m, ', ') AS source_numerics_str, array_to_string(t, ', ') AS target_numerics_str FROM d""",
)
def k1_toc_numerics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section-number sequences of master and translation."""
    return topics.compare_codes(bindings.outline(spark, sf_dir), PAIR)


@register(
    "j5_shared_topics",
    sql("b_outline") + """ SELECT batch_id, code, min(page_no) FILTER (role = 'master') AS master_page, min(page_no) FILTER (role = 'translation') AS target_page FROM b_outline GROUP BY 1, 2 HAVING count(DISTINCT role) = 2""",
)
def j5_shared_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics that both documents have, with their first pages."""
    o = bindings.outline(spark, sf_dir)
    first = lambda role, name: o.where(F.col("role") == role).groupBy(*PAIR, "code").agg(F.min("page_no").alias(name))
    return first("master", "master_page").join(first("translation", "target_page"), [*PAIR, "code"])


@register(
    "j9_missing_topics",
    sql("b_outline") + """ SELECT batch_id, role, seq, code FROM b_outline o WHERE NOT EXISTS (SELECT 1 FROM b_outline x WHERE x.batch_id = o.batch_id AND x.role <> o.role AND x.code = o.code)""",
)
def j9_missing_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of one document that the other lacks, duplicates kept."""
    o = bindings.outline(spark, sf_dir).select(*DOC, "seq", "code")
    other = o.select("batch_id", F.when(F.col("role") == "master", "translation").otherwise("master").alias("role"), "code").distinct()
    return o.join(other, ["batch_id", "role", "code"], "left_anti").select("batch_id", "role", "seq", "code")


_HEADINGS = """, h AS (SELECT o_custkey % 100 AS doc_id, CAST(1 + o_orderkey % 7 AS INTEGER) AS page_no, (o_orderkey * 37 % 780)::DOUBLE AS y, concat(1 + o_orderkey % 5, '.', 1 + (o_orderkey // 5) % 4) AS code FROM orders)"""


def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select((F.col("o_custkey") % 100).alias("doc_id"), (1 + F.col("o_orderkey") % 7).cast("int").alias("page_no"), (F.col("o_orderkey") * 37 % 780).cast("double").alias("y"), F.expr("concat(1 + o_orderkey % 5, '.', 1 + (o_orderkey div 5) % 4)").alias("code"))


def _asof_sql(key: str) -> str:
    return f""", k AS (SELECT doc_id, page_no, y, max(code) AS code FROM h GROUP BY 1, 2, 3), b AS (SELECT *, page_no * 100000.0 + {key} AS at FROM b_boxes), t AS (SELECT doc_id, code, page_no * 100000.0 + y AS at FROM k)
SELECT b.doc_id, b.page_no, b.box_no, t.code AS topic FROM b ASOF LEFT JOIN t ON b.doc_id = t.doc_id AND b.at >= t.at"""


@register("j2_heading_of_box", sql("b_boxes") + _HEADINGS + _asof_sql("round(y0 + 0.3 * (y1 - y0), 4)"))
def j2_heading_of_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last heading at or above a point 30 % down each box; none: front matter (null)."""
    key = F.struct("page_no", F.round(F.col("y0") + 0.3 * (F.col("y1") - F.col("y0")), 4).alias("y"))
    found = asof_last(bindings.boxes(spark, sf_dir), _headings(spark, sf_dir).withColumnRenamed("code", "topic"), ["doc_id"], key, F.struct("page_no", "y"), ["topic"])
    return found.select("doc_id", "page_no", "box_no", "topic")


@register("j3_heading_of_link", sql("b_boxes") + _HEADINGS + _asof_sql("round(y0 + 5, 4)"))
def j3_heading_of_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As j2, for links: their top with 5 pt of tolerance."""
    key = F.struct("page_no", F.round(F.col("y0") + 5, 4).alias("y"))
    found = asof_last(bindings.boxes(spark, sf_dir), _headings(spark, sf_dir).withColumnRenamed("code", "topic"), ["doc_id"], key, F.struct("page_no", "y"), ["topic"])
    return found.select("doc_id", "page_no", "box_no", "topic")


_COUNTS = """, c AS (SELECT batch_id, code, count(*) FILTER (role = 'master') AS master_count, count(*) FILTER (role = 'translation') AS target_count FROM b_outline GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN master_count = target_count THEN 'PASS' ELSE format('FAIL (E({:d}) vs T({:d}))', master_count, target_count) END AS status FROM c)"""


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = bindings.outline(spark, sf_dir)
    return inv.image_counts(o.where("role = 'master'"), o.where("role = 'translation'"), PAIR, "code")


@register("j1_image_counts", sql("b_outline") + _COUNTS + " SELECT * FROM s")
def j1_image_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per topic over the union of topics."""
    return _counts(spark, sf_dir)


@register(
    "k10_image_summary",
    sql("b_outline")
    + _COUNTS
    + """, o AS (SELECT *, CASE WHEN len(list_filter(string_split(CAST(code AS VARCHAR), '.'), lambda p: TRY_CAST(p AS INTEGER) IS NULL)) > 0 THEN [-1] ELSE list_transform(string_split(CAST(code AS VARCHAR), '.'), lambda p: CAST(p AS INTEGER)) END AS place FROM s),
g AS (SELECT batch_id, sum(master_count)::BIGINT AS e, sum(target_count)::BIGINT AS t, max(master_count) > 0 AND max(target_count) > 0 AS topics, coalesce(list(code ORDER BY place, code) FILTER (status <> 'PASS'), []) AS all_bad FROM o GROUP BY 1),
h AS (SELECT *, CASE WHEN NOT topics THEN [] WHEN len(all_bad) = 0 AND e <> t THEN ['total'] ELSE all_bad END AS bad, CASE WHEN topics THEN 'per topic' ELSE 'document total' END AS granularity FROM g)
SELECT batch_id, e AS master_total, t AS target_total, granularity, CAST(len(bad) AS INTEGER) AS mismatched,
  CASE WHEN e = t AND len(bad) = 0 THEN format('PASS (E({:d}) vs T({:d}), {})', e, t, granularity)
  ELSE format('FAIL (E({:d}) vs T({:d}), {}; differs at {})', e, t, granularity, CASE WHEN len(bad) = 0 THEN 'total' ELSE concat(array_to_string(bad[1:6], ', '), CASE WHEN len(bad) > 6 THEN format(', +{:d} more', len(bad) - 6) ELSE '' END) END) END AS status FROM h""",
)
def k10_image_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and the topics that differ, per pair of documents."""
    return inv.image_summary(_counts(spark, sf_dir), PAIR, "code")


@register(
    "a2_topic_keys",
    sql("b_outline")
    + """, o AS (SELECT batch_id, role, seq, CASE WHEN seq % 4 = 0 THEN NULL ELSE code END AS code FROM b_outline)
SELECT batch_id, role, seq, code, coalesce(code, concat('#', CAST(sum(CASE WHEN code IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY batch_id, role ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT))) AS topic_key FROM o""",
)
def a2_topic_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic keys, with numbers for entries without a code."""
    o = bindings.outline(spark, sf_dir).select(*DOC, "seq", F.when(F.col("seq") % 4 != 0, F.col("code")).alias("code"))
    return topics.topic_keys(o, DOC, "seq")


@register(
    "w6_ascending_headings",
    _HEADINGS.replace(", h AS", "WITH h AS")
    + """, k AS (SELECT *, [CAST(string_split(code, '.')[1] AS INTEGER), CAST(string_split(code, '.')[2] AS INTEGER)] AS key FROM h),
b AS (SELECT *, max(key) OVER (PARTITION BY doc_id ORDER BY page_no, y, code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k)
SELECT doc_id, page_no, y, code FROM b WHERE before IS NULL OR key > before""",
)
def w6_ascending_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings whose numbers advance."""
    h = _headings(spark, sf_dir).withColumn("size", F.lit(12.0)).withColumn("text", F.concat("code", F.lit(" Title")))
    body = h.select("doc_id", "page_no", "y", F.lit("").alias("code"), F.lit(10.0).alias("size"), F.expr("repeat('body ', 5)").alias("text"))  # below each heading, longer than it
    return topics.ascending(topics.heading_candidates(h.unionByName(body), ["doc_id"]), ["doc_id"]).select("doc_id", "page_no", "y", "code")


_LINKS = """, l AS (SELECT page_id // 20 AS batch_id, page_id, CASE WHEN regexp_matches(url, '^(#|/)') THEN 'internal' WHEN regexp_matches(url, '^(?i)file:') THEN 'file' ELSE 'external' END AS type,
  CASE WHEN regexp_matches(url, '(?i)^https?://(www\\.)?qr\\.example\\.com(/|$)') THEN '<qr>' ELSE trim(url) END AS target FROM b_links)"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return bindings.links(spark, sf_dir).select(F.expr("page_id div 20").alias("batch_id"), "page_id", inv.link_type(url).alias("type"), inv.link_key(url, r"qr\.example\.com").alias("target"))


@register("a4_link_groups", sql("b_links") + _LINKS + " SELECT batch_id, type, target, count(*) AS n, array_to_string(list_sort(list_distinct(list(page_id))), ',') AS pages FROM l GROUP BY 1, 2, 3")
def a4_link_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a batch by target, with counts and pages."""
    return inv.link_groups(_links(spark, sf_dir), PAIR, "page_id").withColumn("pages", F.array_join("pages", ","))


_LINK_COUNTS = ", c AS (SELECT batch_id, type, target, count(*) FILTER (page_id % 2 = 0) AS m, count(*) FILTER (page_id % 2 = 1) AS t FROM l GROUP BY 1, 2, 3)"


@register("u4_link_differences", sql("b_links") + _LINKS + _LINK_COUNTS + " SELECT batch_id, type, target, greatest(m - t, 0) AS missing, greatest(t - m, 0) AS extra FROM c WHERE m <> t")
def u4_link_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links missing from and extra in the translation, with counts."""
    li = _links(spark, sf_dir)
    return inv.links_compared(li.where("page_id % 2 = 0"), li.where("page_id % 2 = 1"), PAIR)


@register(
    "k5_links",
    sql("b_links")
    + _LINKS
    + _LINK_COUNTS
    + """ SELECT batch_id, sum(m)::BIGINT AS english_total, sum(t)::BIGINT AS translated_total, coalesce(sum(m) FILTER (type = 'internal'), 0)::BIGINT AS english_internal, coalesce(sum(t) FILTER (type = 'internal'), 0)::BIGINT AS translated_internal,
  count(*) FILTER (m > t) AS missing, count(*) FILTER (t > m) AS extra, CASE WHEN count(*) FILTER (m <> t) = 0 AND sum(m) = sum(t) THEN 'PASS' ELSE 'FAIL' END AS status FROM c GROUP BY 1""",
)
def k5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links verdict of each batch."""
    li = _links(spark, sf_dir)
    return inv.links_verdict(li.where("page_id % 2 = 0"), li.where("page_id % 2 = 1"), PAIR)


@register(
    "a5_codes_by_type",
    sql("b_codes")
    + """ SELECT doc_id, count(*) FILTER (type = 'BARCODE') AS barcodes, count(*) FILTER (type = 'QRCODE') AS qr_codes, count(*) FILTER (decoded) AS decoded,
  coalesce(array_to_string(list_sort(list_distinct(list(page_no) FILTER (type = 'BARCODE'))), ', '), '') AS barcode_pages, coalesce(array_to_string(list_sort(list_distinct(list(page_no) FILTER (type = 'QRCODE'))), ', '), '') AS qr_pages FROM b_codes GROUP BY 1""",
)
def a5_codes_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of each document by type."""
    return inv.codes_by_type(bindings.codes(spark, sf_dir), ["doc_id"])


@register(
    "k7_codes",
    sql("b_codes")
    + """, c AS (SELECT doc_id // 2 AS batch_id, count(*) FILTER (type = 'BARCODE' AND doc_id % 2 = 0) AS mb, count(*) FILTER (type = 'BARCODE' AND doc_id % 2 = 1) AS tb, count(*) FILTER (type = 'QRCODE' AND doc_id % 2 = 0) AS mq, count(*) FILTER (type = 'QRCODE' AND doc_id % 2 = 1) AS tq FROM b_codes GROUP BY 1)
SELECT batch_id, format('{} (Count {:d}/{:d})', CASE WHEN mb = tb THEN 'PASS' ELSE 'FAIL' END, tb, mb) AS barcode_status, format('{} (Count {:d}/{:d})', CASE WHEN mq = tq THEN 'PASS' ELSE 'FAIL' END, tq, mq) AS qr_status,
  CASE WHEN mb = tb AND mq = tq THEN 'PASS' ELSE 'FAIL' END AS overall_verdict FROM c""",
)
def k7_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code counts of master against translation."""
    c = inv.codes_by_type(bindings.codes(spark, sf_dir).withColumn("batch_id", F.expr("doc_id div 2")).withColumn("master", F.col("doc_id") % 2 == 0), ["batch_id", "master"])
    side = lambda m: c.where(F.col("master") == m).select("batch_id", "barcodes", "qr_codes")
    return inv.codes_status(side(True), side(False), PAIR)


@register(
    "o1_topic_order",
    sql("b_outline") + """ SELECT batch_id, role, seq, CAST(row_number() OVER (PARTITION BY batch_id, role ORDER BY CAST(string_split(code, '.')[1] AS INTEGER), CAST(string_split(code, '.')[2] AS INTEGER), seq) AS INTEGER) AS place FROM b_outline""",
)
def o1_topic_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of topics in their natural order."""
    w = Window.partitionBy(*DOC).orderBy(code_key(F.col("code")), "seq")
    return bindings.outline(spark, sf_dir).select(*DOC, "seq", F.row_number().over(w).alias("place"))


@register("k6_internal_links")
def k6_internal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal links of page pairs aligned in order."""
    li = bindings.links(spark, sf_dir).where("url LIKE '/%'")
    rows = li.select(F.expr("page_id div 2").alias("batch_id"), (F.col("page_id") % 2).cast("int").alias("side"), F.col("seq").cast("long").alias("seq"), F.concat(F.expr("length(url) % 5"), F.lit(" "), F.col("url")).alias("text"), F.regexp_replace("url", "^/", "").alias("url"), F.lit("1.1").alias("topic"))
    return internal_differences(rows, PAIR)
