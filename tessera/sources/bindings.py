"""Layout tables in the shapes the operators expect, made from the benchmark tables.

They only shape rows, and every one is a projection or an explode of its table, so it grows with it.
SQL holds the same definitions for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines of documents, empty ones dropped; a page is three lines; English is the master."""
    d = _table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return d.where("text <> ''").select("doc_id", "lang", "line_no", (1 + F.expr("line_no div 3")).cast("int").alias("page_no"), "text")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on the pages of documents; box_no is unique within a page."""
    li = _table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_suppkey", "l_linenumber").orderBy(*[c for c in li.columns if c not in ("l_suppkey", "l_linenumber")])
    x0, y0 = F.round(F.col("l_quantity") * 11, 3), F.round(F.expr("l_extendedprice % 780"), 3)
    b = li.select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), F.row_number().over(w).alias("box_no"), x0.alias("x0"), y0.alias("y0"), F.round(12 + F.col("l_discount") * 400, 3).alias("w"), F.round(6 + F.col("l_tax") * 100, 3).alias("h"), F.col("l_returnflag").alias("kind"))
    return b.select("doc_id", "page_no", "box_no", "x0", "y0", F.round(F.col("x0") + F.col("w"), 3).alias("x1"), F.round(F.col("y0") + F.col("h"), 3).alias("y1"), "kind")


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    return o.select(
        F.expr("o_custkey div 2").alias("batch_id"),
        F.when(F.col("o_custkey") % 2 == 0, "master").otherwise("translation").alias("role"),
        F.col("o_orderkey").alias("seq"),
        F.expr("concat(1 + o_orderkey % 5, '.', 1 + (o_orderkey div 5) % 4)").alias("code"),
        (1 + F.col("o_orderkey") % 20).cast("int").alias("page_no"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"), F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("seq", "url"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").where("event_type IN ('signup', 'purchase')")
    return e.select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 20 + 1).cast("int").alias("page_no"), F.when(F.col("event_type") == "signup", "BARCODE").otherwise("QRCODE").alias("type"), (F.col("value") > 5).alias("decoded"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page sizes: A4, A5, A3 or a square of 250 mm, up to 2.5 mm off; a document is forty pages."""
    p = _table(spark, sf_dir, "part")
    jitter = F.round((F.expr("p_retailprice % 51") / 10 - 2.5), 3)
    mm = lambda a, b, c, d: F.expr(f"CASE p_size % 4 WHEN 0 THEN {a}D WHEN 1 THEN {b}D WHEN 2 THEN {c}D ELSE {d}D END")
    return p.select(F.col("p_partkey").alias("page_id"), F.expr("p_partkey div 40").alias("doc_id"), (F.expr("p_partkey % 40") + 1).cast("int").alias("page_no"), F.round((mm(210, 148, 297, 250) + jitter) * 72 / 25.4, 3).alias("width_pt"), F.round((mm(297, 210, 420, 250) + jitter) * 72 / 25.4, 3).alias("height_pt"))


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table of three columns per order; rows per column from its line counts."""
    li = _table(spark, sf_dir, "lineitem")
    s = li.groupBy("l_orderkey").agg(*[(F.count_if(F.col("l_returnflag") == f) + 1).cast("int").alias(r) for f, r in (("A", "r1"), ("N", "r2"), ("R", "r3"))])
    return s.select(F.expr("l_orderkey div 40").alias("batch_id"), F.when(F.col("l_orderkey") % 2 == 0, "master").otherwise("translation").alias("role"), F.expr("(l_orderkey % 40) div 2").alias("table_idx"), F.lit(3).alias("columns"), F.array("r1", "r2", "r3").alias("rows_per_column"))


def printed_tables(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    """Tables of both documents of a batch, one an order, cut at page ends at places that differ by role: the master
    after three lines, the translation after two. Some orders have no table on one side, some other rows."""
    master = role == "master"
    li = _table(spark, sf_dir, "lineitem").where("l_orderkey % 19 > 0" if master else "l_orderkey % 17 > 0")
    part = F.expr("IF(l_orderkey % 2 = 0, (l_linenumber - 1) div 3, 0)" if master else "IF(l_orderkey % 3 = 0, (l_linenumber - 1) div 2, 0)").cast("int")
    counts = [F.count_if(F.col("l_returnflag") == f).alias(f) for f in "ANR"]
    t = li.groupBy("l_orderkey", part.alias("part")).agg(*counts, F.min("l_quantity").alias("least"), F.max("l_discount").alias("most"))
    w = Window.partitionBy("batch_id").orderBy("l_orderkey", "part")
    t = t.withColumn("batch_id", F.expr("l_orderkey div 20"))
    goes_on, cut = F.coalesce(F.lag("l_orderkey").over(w) == F.col("l_orderkey"), F.lit(False)), F.coalesce(F.lead("l_orderkey").over(w) == F.col("l_orderkey"), F.lit(False))
    t = t.withColumns({"new_page": F.when(goes_on | (F.col("l_orderkey") % 4 == 0), 1).otherwise(0), "cut": cut, "table_idx": (F.row_number().over(w) - 1).cast("long"), "header": F.expr("IF(part = 0 OR l_orderkey % 5 < 3, 1, 0)"), "more": F.expr("IF(l_orderkey % 13 = 0, 3, 0)") if not master else F.lit(0)})
    rows = F.array(*((F.col(f) + F.col("header") + (F.col("more") if f == "A" else F.lit(0))).cast("int") for f in "ANR"))
    y = F.when(F.col("new_page") == 1, 50.0).otherwise(300.0)
    reasons = F.filter(F.array(F.when(F.col("least") < 3, "text is cut"), F.when(F.col("most") > 0.09, "text leaves its cell")), lambda x: x.isNotNull())
    return t.select("batch_id", "table_idx", F.sum("new_page").over(w).cast("int").alias("page_index"), y.alias("y"), F.when(F.col("cut"), 760.0 - y).otherwise(120.0).alias("h"), F.lit(842.0).alias("page_height"), F.expr("IF(l_orderkey % 11 = 0, 2, 3)").alias("columns"), F.slice(rows, 1, F.expr("IF(l_orderkey % 11 = 0, 2, 3)")).alias("rows_per_column"), reasons.alias("overflow_reasons"))


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").alias("topic_code"), F.when(F.col("vec_id") % 2 == 0, "master").otherwise("translation").alias("role"), F.expr("vec_id div 100").alias("batch_id"), F.transform("embedding", lambda x: x.cast("double")).alias("pixels"))


def ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink cells (value > 0) of the 8 x 8 grids."""
    e = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.posexplode("embedding").alias("i", "v"))
    return e.where("v > 0").select("doc_id", F.expr("i div 8").cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"))


def column_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines of pages of one to three columns, with headings that cross them, indents, short lines and notes in the margin."""
    li = _table(spark, sf_dir, "lineitem")
    page = F.expr("l_suppkey * 10 + l_linenumber")
    n = 1 + page % 3
    place, width = F.col("l_partkey") % n, F.lit(500.0) / n
    x0 = 50 + place * width + F.expr("(CAST(l_extendedprice AS BIGINT) % 5) * 3")
    x1 = 50 + (place + 1) * width - 15 - F.round(F.col("l_tax") * 200, 2) - F.when(F.col("l_linestatus") == "F", 6.0).otherwise(0.0)
    heading = (F.col("l_quantity") > 49) & (page % 4 == 0)
    note = (page % 5 == 1) & (F.col("l_partkey") % (5 + page % 40) == 0)
    return li.select(page.alias("page_id"), F.round(F.when(heading, 50.0).when(note, 15.0).otherwise(x0), 3).alias("x0"), F.round(F.when(heading, 430.0 + F.col("l_quantity")).when(note, 38.0).otherwise(x1), 3).alias("x1"))


def page_shapes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Shapes (x0, y0, x1, y1, ends exclusive) on pages of 240 x 200 pixels, and the pages: lines of four orders, drawn as
    blots, as rules on a coarse lattice and as short strokes."""
    li = _table(spark, sf_dir, "lineitem")
    kind, at = F.expr("(l_partkey + l_linenumber) % 5"), F.expr("CAST(l_extendedprice AS BIGINT)")
    x, y = F.expr("CAST(l_quantity AS INT) * 4"), (at % 190).cast("int")
    box = lambda x, y, w, h: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), w.cast("int").alias("w"), h.cast("int").alias("h"))
    blot = box(x, y, 4 + at % 15, 3 + at % 11)
    rule = box(F.lit(10) + 0 * at, (at % 7) * 25 + 5, 90 + at % 60, 1 + at % 3)
    post = box((at % 6) * 25 + 10, F.lit(5) + 0 * at, 1 + at % 2, 36 + at % 40)
    stroke = box(x, y, 30 + at % 20, 1 + at % 2)
    shape = F.when(kind < 2, blot).when(kind == 2, rule).when(kind == 3, post).otherwise(stroke)
    page = F.expr("l_orderkey div 16").alias("page_id")
    drawn = li.select(page, F.inline(F.array(shape))).where("x < 240")  # a shape is worked out once, not wherever its sides are used
    ends = F.least(F.lit(240), F.col("x") + F.col("w")).alias("x1"), F.least(F.lit(200), F.col("y") + F.col("h")).alias("y1")
    return drawn.select("page_id", F.col("x").alias("x0"), F.col("y").alias("y0"), *ends), li.select(page).distinct().withColumns({"width": F.lit(240), "height": F.lit(200)})


def shape_rows(key: list[str], shapes: DataFrame) -> DataFrame:
    """The runs of shapes; shapes are brought together by key before they are cut into rows."""
    return shapes.repartition(*key).select(*key, F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y"), F.col("x0").alias("xs"), F.col("x1").alias("xe"))


def page_ink(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ink of the pages of `page_shapes`, runs that may overlap, and the pages."""
    shapes, pages = page_shapes(spark, sf_dir)
    return shape_rows(["page_id"], shapes), pages


SQL = {
    "b_lines": """b_lines AS (
  SELECT doc_id, lang, CAST(line_no AS INTEGER) AS line_no, CAST(1 + line_no // 3 AS INTEGER) AS page_no, text FROM (
    SELECT doc_id, lang, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS text FROM documents)
  WHERE text <> '')""",
    "b_boxes": """b_boxes AS (
  SELECT doc_id, page_no, CAST(box_no AS INTEGER) AS box_no, x0, y0, round(x0 + w, 3) AS x1, round(y0 + h, 3) AS y1, kind FROM (
    SELECT l_suppkey AS doc_id, l_linenumber AS page_no,
      row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS box_no,
      round(l_quantity * 11, 3) AS x0, round(l_extendedprice % 780, 3) AS y0, round(12 + l_discount * 400, 3) AS w, round(6 + l_tax * 100, 3) AS h, l_returnflag AS kind FROM lineitem))""",
    "b_outline": """b_outline AS (
  SELECT o_custkey // 2 AS batch_id, CASE WHEN o_custkey % 2 = 0 THEN 'master' ELSE 'translation' END AS role, o_orderkey AS seq,
    concat(1 + o_orderkey % 5, '.', 1 + (o_orderkey // 5) % 4) AS code, CAST(1 + o_orderkey % 20 AS INTEGER) AS page_no FROM orders)""",
    "b_links": """b_links AS (
  SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS url FROM pages)""",
    "b_codes": """b_codes AS (
  SELECT user_id AS doc_id, CAST(event_id % 20 + 1 AS INTEGER) AS page_no, CASE WHEN event_type = 'signup' THEN 'BARCODE' ELSE 'QRCODE' END AS type, value > 5 AS decoded
  FROM events WHERE event_type IN ('signup', 'purchase'))""",
    "b_pages": """b_pages AS (
  SELECT p_partkey AS page_id, p_partkey // 40 AS doc_id, CAST(p_partkey % 40 + 1 AS INTEGER) AS page_no,
    round((CASE p_size % 4 WHEN 0 THEN 210.0::DOUBLE WHEN 1 THEN 148 WHEN 2 THEN 297 ELSE 250 END + round((p_retailprice % 51) / 10 - 2.5, 3)) * 72 / 25.4::DOUBLE, 3) AS width_pt,
    round((CASE p_size % 4 WHEN 0 THEN 297.0::DOUBLE WHEN 1 THEN 210 WHEN 2 THEN 420 ELSE 250 END + round((p_retailprice % 51) / 10 - 2.5, 3)) * 72 / 25.4::DOUBLE, 3) AS height_pt FROM part)""",
    "b_sigs": """b_sigs AS (
  SELECT l_orderkey // 40 AS batch_id, CASE WHEN l_orderkey % 2 = 0 THEN 'master' ELSE 'translation' END AS role, (l_orderkey % 40) // 2 AS table_idx,
    [CAST(count(*) FILTER (l_returnflag = 'A') + 1 AS INTEGER), CAST(count(*) FILTER (l_returnflag = 'N') + 1 AS INTEGER), CAST(count(*) FILTER (l_returnflag = 'R') + 1 AS INTEGER)] AS rows_per_column
  FROM lineitem GROUP BY l_orderkey)""",
    "b_columns": """b_columns AS (
  SELECT page_id, round(CASE WHEN heading THEN 50.0 WHEN note THEN 15.0 ELSE 50 + place * (500.0::DOUBLE / n) + (CAST(trunc(l_extendedprice) AS BIGINT) % 5) * 3 END, 3) AS x0,
    round(CASE WHEN heading THEN 430.0 + l_quantity WHEN note THEN 38.0 ELSE 50 + (place + 1) * (500.0::DOUBLE / n) - 15 - round(l_tax * 200, 2) - CASE WHEN l_linestatus = 'F' THEN 6.0 ELSE 0.0 END END, 3) AS x1
  FROM (SELECT *, l_suppkey * 10 + l_linenumber AS page_id, 1 + (l_suppkey * 10 + l_linenumber) % 3 AS n, l_partkey % (1 + (l_suppkey * 10 + l_linenumber) % 3) AS place, l_quantity > 49 AND (l_suppkey * 10 + l_linenumber) % 4 = 0 AS heading, (l_suppkey * 10 + l_linenumber) % 5 = 1 AND l_partkey % (5 + (l_suppkey * 10 + l_linenumber) % 40) = 0 AS note FROM lineitem))""",
    "b_printed": """b_cut AS (
  SELECT role, l_orderkey // 20 AS batch_id, l_orderkey, part, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r, min(l_quantity) AS least, max(l_discount) AS most FROM (
    SELECT *, 'master' AS role, CASE WHEN l_orderkey % 2 = 0 THEN (l_linenumber - 1) // 3 ELSE 0 END AS part FROM lineitem WHERE l_orderkey % 19 > 0
    UNION ALL SELECT *, 'translation', CASE WHEN l_orderkey % 3 = 0 THEN (l_linenumber - 1) // 2 ELSE 0 END FROM lineitem WHERE l_orderkey % 17 > 0) GROUP BY ALL),
b_placed AS (
  SELECT *, row_number() OVER w - 1 AS table_idx, CASE WHEN lag(l_orderkey) OVER w = l_orderkey OR l_orderkey % 4 = 0 THEN 1 ELSE 0 END AS new_page, coalesce(lead(l_orderkey) OVER w = l_orderkey, false) AS cut,
    CASE WHEN part = 0 OR l_orderkey % 5 < 3 THEN 1 ELSE 0 END AS header, CASE WHEN role = 'translation' AND l_orderkey % 13 = 0 THEN 3 ELSE 0 END AS more, CASE WHEN l_orderkey % 11 = 0 THEN 2 ELSE 3 END AS columns
  FROM b_cut WINDOW w AS (PARTITION BY role, batch_id ORDER BY l_orderkey, part)),
b_printed AS (
  SELECT role, batch_id, table_idx, sum(new_page) OVER (PARTITION BY role, batch_id ORDER BY table_idx) AS page_index, CASE WHEN new_page = 1 THEN 50.0 ELSE 300.0 END AS y, columns,
    CASE WHEN cut THEN 760.0 - CASE WHEN new_page = 1 THEN 50.0 ELSE 300.0 END ELSE 120.0 END AS h, [a + header + more, n + header, r + header][1:columns] AS rows,
    list_filter([CASE WHEN least < 3 THEN 'text is cut' END, CASE WHEN most > 0.09 THEN 'text leaves its cell' END], lambda x: x IS NOT NULL) AS overflow_reasons FROM b_placed)""",
    "b_crops": """b_crops AS (
  SELECT vec_id, label AS topic_code, CASE WHEN vec_id % 2 = 0 THEN 'master' ELSE 'translation' END AS role, vec_id // 100 AS batch_id, CAST(embedding AS DOUBLE[]) AS pixels FROM embeddings)""",
    "b_ink": """b_ink AS (
  SELECT doc_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x FROM (
    SELECT vec_id AS doc_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS v FROM embeddings) WHERE v > 0)""",
}


def sql(*names: str) -> str:
    """`WITH` and the named definitions; a query goes on with a comma or a SELECT."""
    return "WITH " + ",\n".join(SQL[n] for n in names)
