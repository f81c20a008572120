"""Queries on page differences, regions in their modes, and report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import page_diff as pd_
from tessera.operators import region_checks as rc
from tessera.operators import inspection, summaries, tables
from tessera.operators.components import written
from tessera.plans.layout import HEIGHT, WIDTH, _margins
from tessera.plans.registry import register
from tessera.sources import bindings
from tessera.sources.bindings import sql

DOC = ["batch_id"]


def _graphics(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors as graphics: a batch's even ones are the master's, five to a page; every third vector of
    the translation carries the pixels of the one before it, so that matches exist."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("pixels"))
    twin = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("pixels").alias("twin"))
    e = e.join(twin, "vec_id", "left").withColumn("pixels", F.when(F.expr("vec_id % 2 = 1 AND vec_id % 3 <> 0"), F.coalesce("twin", "pixels")).otherwise(F.col("pixels")))
    place = F.expr("(vec_id % 100) div 2")
    x, y = (place % 5 * 100 + F.when(F.col("vec_id") % 4 == 1, 10).otherwise(0)).cast("double"), (place % 5 * 150 + F.col("vec_id") % 2 * 7).cast("double")
    shaped = e.select(F.expr("vec_id div 100").alias("batch_id"), (1 + F.expr("(vec_id % 100) div 10") + F.when(F.col("vec_id") % 26 == 1, 1).otherwise(0)).cast("int").alias("page_no"), F.col("vec_id").alias("no"), x.alias("x0"), y.alias("y0"), (x + 60 + F.col("vec_id") % 7).alias("x1"), (y + 50).alias("y1"), "pixels")
    shaped = written(shaped, "graphics")
    m, t = shaped.where("no % 2 = 0"), shaped.where("no % 2 = 1")
    mapped = m.select("batch_id", "page_no").distinct().withColumn("target_page", F.col("page_no"))
    return m, t, mapped


@register("k13_page_differences")
def k13_page_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphics that are missing, extra, moved or on another page; tested on literal rows."""
    return pd_.page_differences(*_graphics(spark, sf_dir), DOC)


@register("a26_difference_counts")
def a26_difference_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of each kind, and a line of text for each page."""
    m, t, mapped = _graphics(spark, sf_dir)
    pages = m.groupBy("batch_id", "page_no").agg(F.count("*").alias("graphics"))
    return pd_.difference_counts(pd_.page_differences(m, t, mapped, DOC), ["batch_id", "page_no"], pages)


@register(
    "a25_reflow_notes",
    sql("b_boxes") + """, d AS (SELECT doc_id, page_no, max(y0 % 40) AS d FROM b_boxes GROUP BY 1, 2)
SELECT doc_id, page_no, format('artwork on the translated page sits up to {:d} pt lower than on the master - normal reflow, not reported per graphic', CAST(round_even(d, 0) AS BIGINT)) AS note FROM d WHERE d > 3""",
)
def a25_reflow_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far artwork slid down a page at most."""
    return pd_.reflow_notes(bindings.boxes(spark, sf_dir).withColumn("dy", F.col("y0") % 40), ["doc_id", "page_no"])


def _verifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as region checks: the turn number chooses the mode."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    r = c.withColumn("tr_text", F.when(F.col("turn") % 4 == 3, F.col("text")).otherwise(after)).withColumn("k", F.expr("(conv_id + turn) % 6"))
    code = lambda on, *kinds: F.when(on, F.array(*[F.lit(k) for k in kinds]).cast("array<string>")).otherwise(F.array().cast("array<string>"))
    return r.select("conv_id", "turn", "k", (F.col("k") == 0).alias("pattern_match"), (F.col("k") <= 1).alias("presence_only"), F.expr("k in (1, 2)").alias("dont_compare_text"), F.expr("k in (3, 4)").alias("exact_match"),
                    F.when(F.col("turn") % 2 == 1, F.lit("[a-z]+ing")).alias("pattern"), F.col("text").alias("eng_text"), "tr_text", F.lit(None).cast("string").alias("scope_text"),
                    code(F.expr("conv_id % 3 = 0"), "QRCODE").alias("eng_types"), code(F.expr("conv_id % 3 = 0 AND turn % 3 > 0"), "QRCODE").alias("tr_types"), F.lit(False).alias("eng_ink"), F.expr("turn % 2 = 0").alias("tr_ink"),
                    F.when(F.col("conv_id") % 5 > 0, F.expr("CAST((conv_id * 7 + turn * 13) % 101 AS DOUBLE)")).alias("visual"),
                    F.when(F.col("k") == 3, F.slice(F.split("text", " "), 1, 2)).alias("needle"), F.when(F.col("k") == 3, F.split(F.coalesce("tr_text", F.lit("")), " ")).alias("scope_tokens"),
                    F.lit(30.0).alias("threshold"), F.expr("conv_id % 11 > 0").alias("file_found"), F.expr("CASE WHEN conv_id % 13 = 0 THEN 0 ELSE 5 END").alias("pages"))


@register("k20_verified_regions")
def k20_verified_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions in all modes, each giving way to the next; the modes apart from text similarity are in k20_modes."""
    return rc.verified(_verifications(spark, sf_dir)).select("conv_id", "turn", "mode", "status", "similarity", "is_match")


@register(
    "k20_modes",
    r"""WITH c AS (SELECT *, (conv_id + turn) % 6 AS k, CASE WHEN turn % 4 = 3 THEN text ELSE lead(text) OVER (PARTITION BY conv_id ORDER BY turn) END AS tr_text FROM conversations),
r AS (SELECT *, conv_id % 3 = 0 AS want, conv_id % 3 = 0 AND turn % 3 > 0 AS have, CASE WHEN conv_id % 5 > 0 THEN (conv_id * 7 + turn * 13) % 101 END AS visual, string_split(text, ' ')[1:2] AS needle, string_split(coalesce(tr_text, ''), ' ') AS words FROM c),
m AS (SELECT *, CASE WHEN conv_id % 11 = 0 THEN 'no file' WHEN conv_id % 13 = 0 THEN 'empty' WHEN k = 0 THEN 'pattern' WHEN k = 1 THEN 'presence' WHEN k = 2 THEN 'visual' WHEN k = 3 THEN 'scoped' END AS mode,
  len(list_filter(range(1, len(words) - len(needle) + 2), lambda i: words[i:i + len(needle) - 1] = needle)) AS hits FROM r)
SELECT conv_id, turn, mode, CASE mode WHEN 'no file' THEN 'FAIL (File Not Found)' WHEN 'empty' THEN 'FAIL (Empty PDF)'
  WHEN 'pattern' THEN CASE WHEN regexp_matches(coalesce(tr_text, ''), '[a-z]+ing') THEN 'PASS (Pattern)' ELSE 'FAIL (Pattern)' END
  WHEN 'presence' THEN CASE WHEN want THEN CASE WHEN have THEN 'PASS (Present)' ELSE 'FAIL (Code Missing)' END WHEN trim(coalesce(tr_text, '')) <> '' OR turn % 2 = 0 THEN 'PASS (Present)' WHEN trim(coalesce(text, '')) = '' THEN 'PASS (Present)' ELSE 'FAIL (Missing)' END
  WHEN 'visual' THEN CASE WHEN visual IS NULL THEN 'CHECK (No Graphics Here)' WHEN visual >= 75 THEN 'PASS (Visual Match)' WHEN visual >= 30 THEN 'CHECK (Visual Partial)' ELSE 'FAIL (Visual Mismatch)' END
  ELSE CASE WHEN hits = 1 THEN 'PASS' WHEN hits = 0 THEN 'FAIL' ELSE 'CHECK' END END AS status
FROM m WHERE mode IS NOT NULL AND NOT (mode = 'pattern' AND turn % 2 = 0)""",
)
def k20_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modes that need no measure of text: hand-written patterns, presence, pictures, needles."""
    done = rc.verified(_verifications(spark, sf_dir))
    return done.where("mode NOT IN ('exact', 'normal') AND NOT (mode = 'pattern' AND turn % 2 = 0)").select("conv_id", "turn", "mode", "status")


@register(
    "a22_region_summaries",
    """WITH r AS (SELECT conv_id, (conv_id + turn) % 3 > 0 AS ok FROM conversations) SELECT conv_id, format('{:d}/{:d} passed', count(*) FILTER (ok), count(*)) AS summary FROM r GROUP BY 1""",
)
def a22_region_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many regions of each conversation passed."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rc.region_summary(c.select("conv_id", F.expr("(conv_id + turn) % 3 > 0").alias("is_match")), ["conv_id"])


@register(
    "j17_needles",
    sql("b_boxes")
    + """, t AS (SELECT * FROM b_boxes WHERE kind = 'N'), r AS (SELECT * FROM b_boxes WHERE kind = 'R')
SELECT r.doc_id, r.page_no, r.box_no, string_agg(CAST(t.box_no AS VARCHAR), ' ' ORDER BY t.box_no) AS needle FROM r JOIN t ON r.doc_id = t.doc_id AND r.page_no = t.page_no AND t.x0 < r.x1 AND r.x0 < t.x1 AND t.y0 < r.y1 AND r.y0 < t.y1
WHERE (least(r.x1, t.x1) - greatest(r.x0, t.x0)) * (least(r.y1, t.y1) - greatest(r.y0, t.y0)) / ((t.x1 - t.x0) * (t.y1 - t.y0)) >= 0.5 GROUP BY 1, 2, 3""",
)
def j17_needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens that a region covers by half."""
    b = bindings.boxes(spark, sf_dir)
    t = b.where("kind = 'N'").withColumn("token", F.col("box_no").cast("string")).withColumn("at", F.col("box_no")).drop("kind")
    return rc.needles(b.where("kind = 'R'").drop("kind"), t, ["box_no"], ["at"]).select("doc_id", "page_no", "box_no", F.array_join("needle", " ").alias("needle"))


@register(
    "j15_codes_in_regions",
    sql("b_boxes")
    + """, c AS (SELECT *, CASE WHEN box_no % 2 = 0 THEN 'QRCODE' ELSE 'BARCODE' END AS type FROM b_boxes WHERE kind = 'A'), r AS (SELECT * FROM b_boxes WHERE kind = 'R')
SELECT r.doc_id, r.page_no, r.box_no, string_agg(type, ',' ORDER BY type) AS types FROM r JOIN c ON r.doc_id = c.doc_id AND r.page_no = c.page_no AND c.x0 < r.x1 AND r.x0 < c.x1 AND c.y0 < r.y1 AND r.y0 < c.y1 GROUP BY 1, 2, 3""",
)
def j15_codes_in_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of the codes that meet each region."""
    b = bindings.boxes(spark, sf_dir)
    c = b.where("kind = 'A'").withColumn("type", F.when(F.col("box_no") % 2 == 0, "QRCODE").otherwise("BARCODE")).withColumn("data", F.lit(None).cast("string")).drop("kind")
    return rc.codes_in(b.where("kind = 'R'").drop("kind"), c, ["box_no"]).select("doc_id", "page_no", "box_no", F.array_join("types", ",").alias("types"))


@register(
    "t9_tokens",
    r"""WITH c AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(text, '[_ \t\n\r\x0b\x0c]'), lambda t: t <> '')) AS token, text FROM benchmark)
SELECT item_id, count(*) AS tokens, CAST(sum(length(token)) AS BIGINT) AS chars, max(length(token)) AS longest FROM c GROUP BY 1""",
)
def t9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of benchmark items from their characters."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    chars = b.select("item_id", F.posexplode(F.split("text", "")).alias("char_no", "c"))
    at = F.col("char_no").cast("double")
    t = rc.tokens_of(chars.select("item_id", "char_no", "c", at.alias("x0"), F.lit(0.0).alias("y0"), (at + 1).alias("x1"), F.lit(1.0).alias("y1")), ["item_id"])
    return t.groupBy("item_id").agg(F.count("*").alias("tokens"), F.sum(F.length("token")).alias("chars"), F.max(F.length("token")).cast("long").alias("longest"))


@register(
    "a14_batch_footers",
    """WITH d AS (SELECT o_custkey // 20 AS batch_id, 1 + o_orderkey % 90 AS pages, o_orderkey * 17 % 100000 AS bytes, CASE WHEN o_orderkey % 4 = 0 THEN 'sheet size differs' ELSE '' END AS note FROM orders)
SELECT batch_id, count(*) AS documents, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (note <> '') AS differ FROM d GROUP BY 1""",
)
def a14_batch_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, pages and bytes of each batch, and how many differ."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    d = o.select(F.expr("o_custkey div 20").alias("batch_id"), F.expr("1 + o_orderkey % 90").alias("pages"), F.expr("o_orderkey * 17 % 100000").alias("bytes"), F.when(F.col("o_orderkey") % 4 == 0, "sheet size differs").otherwise("").alias("note"))
    return summaries.batch_footer(d, DOC)


@register("k24_table_reports")
def k24_table_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned tables with page ranges, labels, reasons and classes."""
    s = bindings.signatures(spark, sf_dir)
    rows = tables.compared(s.where("role = 'master'"), s.where("role = 'translation'"), DOC)
    page = lambda i: (1 + F.floor(F.col(i) / 3)).cast("int")
    return summaries.table_report(rows.withColumns({"m_first": page("master_idx"), "m_last": (page("master_idx") + F.col("master_idx") % 2).cast("int"), "t_first": page("target_idx"), "t_last": page("target_idx")})).select("batch_id", "step", "label", "master_pages", "target_pages", "status", "reason", "verdict_class")


def _topic_images(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m, t, _ = _graphics(spark, sf_dir)
    topic = F.expr("(no % 100) div 20").cast("string").alias("topic")
    shape = lambda df: df.select("batch_id", topic, "page_no", "no", "x0", "y0", "pixels")
    return shape(m), shape(t).where("no % 37 <> 3")


@register("k11_images_in_order")
def k11_images_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of topics with equal counts, slot by slot."""
    return inspection.images_in_order(*_topic_images(spark, sf_dir), DOC, ["topic"])


@register("k12_images_by_content")
def k12_images_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of each topic paired by content."""
    return inspection.images_by_content(*_topic_images(spark, sf_dir), DOC, "topic")


@register(
    "p15_live_lines",
    sql("b_boxes") + " SELECT doc_id, page_no, box_no FROM b_boxes WHERE x0 < 560.0 AND 35.0 < x1 AND y0 < 842.0 - 41.3 AND 50.4 < y1 AND x1 - x0 >= 1",
)
def p15_live_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in the live area of their page."""
    return inspection.live_lines(bindings.boxes(spark, sf_dir), F.lit(WIDTH), F.lit(HEIGHT), _margins()).select("doc_id", "page_no", "box_no")


@register(
    "j24_candidate_pages",
    """WITH c AS (SELECT o_custkey // 2 AS batch_id, o_orderkey AS no, CAST(1 + o_orderkey % 20 AS INTEGER) AS page_no, concat(1 + o_orderkey % 5) AS topic FROM orders WHERE o_custkey % 2 = 0),
s AS (SELECT o_custkey // 2 AS batch_id, concat(1 + o_orderkey % 3) AS topic, min(1 + o_orderkey % 20) AS lo, max(1 + o_orderkey % 20) AS hi FROM orders WHERE o_custkey % 2 = 1 GROUP BY 1, 2),
p AS (SELECT c.batch_id, no, page_no, unnest(generate_series(greatest(1, coalesce(lo - 1, page_no - 3)), least(20, coalesce(hi + 1, page_no + 3)))) AS page FROM c LEFT JOIN s USING (batch_id, topic))
SELECT batch_id, no, CAST(page AS INTEGER) AS page, CAST(row_number() OVER (PARTITION BY batch_id, no ORDER BY abs(page - page_no), page) AS INTEGER) AS place FROM p""",
)
def j24_candidate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each crop is sought, nearest page first."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("batch_id", F.expr("o_custkey div 2")).withColumn("page_no", F.expr("CAST(1 + o_orderkey % 20 AS INT)"))
    c = o.where("o_custkey % 2 = 0").select("batch_id", F.col("o_orderkey").alias("no"), "page_no", F.expr("concat(1 + o_orderkey % 5)").alias("topic"))
    s = o.where("o_custkey % 2 = 1").groupBy("batch_id", F.expr("concat(1 + o_orderkey % 3)").alias("topic")).agg(F.min("page_no").alias("lo"), F.max("page_no").alias("hi"))
    return inspection.candidate_pages(c, s, c.select("batch_id").distinct().withColumn("total", F.lit(20)), DOC)


@register("k28_table_regions")
def k28_table_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table-like regions of each page; tested on literal rows."""
    b = bindings.boxes(spark, sf_dir)
    lines = b.where("kind = 'N'").withColumns({"x1": F.col("x0") + 6, "y1": F.col("y0") + 4, "text": F.lit("six letters")})
    return inspection.table_regions(b.where("kind <> 'N'").drop("kind"), lines.drop("kind"))


@register(
    "k26_inspection",
    sql("b_boxes")
    + """, c AS (SELECT doc_id, 'toc' AS source, doc_id % 4 > 0 AS passed FROM (SELECT DISTINCT doc_id FROM b_boxes) UNION ALL SELECT doc_id, 'overflow', x1 <= 560 FROM b_boxes WHERE doc_id % 4 > 0 UNION ALL SELECT doc_id, 'crops', box_no % 9 > 0 FROM b_boxes WHERE kind = 'R' AND doc_id % 4 > 0)
SELECT doc_id, count(*) FILTER (passed) AS passed, count(*) AS total, CASE WHEN bool_and(passed) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM c GROUP BY 1""",
)
def k26_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gate and two checks through the whole inspection: its summary sheet."""
    b = bindings.boxes(spark, sf_dir)
    docs = b.select("doc_id").distinct()
    title = F.lit("a finding")
    checks = {
        "toc": inspection.cards("toc", docs, title, F.lit(""), F.col("doc_id") % 4 > 0),
        "overflow": inspection.cards("overflow", b, title, F.col("kind"), F.col("x1") <= 560, F.col("page_no")),
        "crops": inspection.cards("crops", b.where("kind = 'R'"), title, F.col("kind"), F.col("box_no") % 9 > 0, F.col("page_no")),
    }
    return inspection.inspected(docs, checks)["summary"].select("doc_id", "passed", "total", "verdict")
