"""Binary rasters as run-length tables: ink_runs(doc_id, y, xs, xe), xe exclusive.

An opening by a length keeps the runs of at least that length, so rules are found without pixels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import page_components

BAND = 32


def runs(cells: DataFrame, along: str = "x", across: str = "y") -> DataFrame:
    """Cells (doc_id, y, x) to maximal runs by gaps and islands; along='y' gives column runs."""
    w = Window.partitionBy("doc_id", across).orderBy(along)
    island = F.col(along) - F.row_number().over(w)
    return cells.distinct().withColumn("__i", island).groupBy("doc_id", across, "__i").agg(F.min(along).alias("xs"), (F.max(along) + 1).alias("xe")).drop("__i").withColumnRenamed(across, "y")


def binarised(crops: DataFrame, width: int, threshold: float, below: bool = True) -> DataFrame:
    """Crops (doc_id, pixels) to the cells under (or over) a threshold."""
    p = crops.select("doc_id", F.posexplode("pixels").alias("i", "v"))
    hit = F.col("v") < threshold if below else F.col("v") > threshold
    return p.where(hit).select("doc_id", F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).cast("int").alias("x"))


def ink_rows(ink: DataFrame, rects: DataFrame) -> DataFrame:
    """Ink per scan line of each rectangle (doc_id, rect_id, x0, y0, x1, y1), rows without ink too."""
    rows = rects.select("*", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y"))
    met = rows.join(ink, ["doc_id", "y"], "left")
    cut = F.greatest(F.lit(0), F.least("xe", "x1") - F.greatest("xs", "x0"))
    return met.groupBy("doc_id", "rect_id", "y").agg(F.coalesce(F.sum(cut), F.lit(0)).cast("long").alias("ink"))


def longest_runs(rows: DataFrame) -> DataFrame:
    """Per rectangle the longest series of scan lines without ink and with ink. rows: ink_rows."""
    w = Window.partitionBy("doc_id", "rect_id").orderBy("y")
    s = rows.withColumn("blank", F.col("ink") == 0)
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy("doc_id", "rect_id", "blank").orderBy("y"))
    n = s.withColumn("i", island).groupBy("doc_id", "rect_id", "blank", "i").agg(F.count("*").alias("n"))
    return n.groupBy("doc_id", "rect_id").agg(F.coalesce(F.max(F.when(F.col("blank"), F.col("n"))), F.lit(0)).alias("longest_blank"), F.coalesce(F.max(F.when(~F.col("blank"), F.col("n"))), F.lit(0)).alias("longest_ink"))


def rule_share(cells: DataFrame, length: int) -> DataFrame:
    """Per document the ink, the ink in runs of at least `length` either way, and its share."""
    long = lambda along, across: runs(cells, along, across).where(F.col("xe") - F.col("xs") >= length).select("doc_id", F.col("y").alias(across), F.explode(F.sequence(F.col("xs"), F.col("xe") - 1)).alias(along)).select("doc_id", "y", "x")
    rules = long("x", "y").union(long("y", "x")).distinct().groupBy("doc_id").agg(F.count("*").alias("rule_ink"))
    total = cells.distinct().groupBy("doc_id").agg(F.count("*").alias("ink"))
    out = total.join(rules, "doc_id", "left").withColumn("rule_ink", F.coalesce("rule_ink", F.lit(0)))
    return out.withColumn("share", F.bround(F.col("rule_ink") / F.col("ink"), 6))


def ink_components(ink: DataFrame) -> DataFrame:
    """Connected ink (eight neighbours): per component its box and ink. Runs of neighbouring rows
    that overlap or touch at a corner are edges."""
    named = ink.withColumn("run", F.col("y").cast("long") * 1_000_000 + F.col("xs"))
    upper = named.select("doc_id", (F.col("y") + 1).alias("y"), F.col("xs").alias("us"), F.col("xe").alias("ue"), F.col("run").alias("a"))
    edges = upper.join(named, ["doc_id", "y"]).where("us <= xe AND xs <= ue").select("doc_id", "a", F.col("run").alias("b"))
    labels = page_components(edges, ["doc_id"]).withColumnRenamed("n", "run")
    met = named.join(labels, ["doc_id", "run"], "left").withColumn("component", F.coalesce("label", "run"))
    return met.groupBy("doc_id", "component").agg(F.min("xs").alias("x0"), F.min("y").alias("y0"), F.max("xe").alias("x1"), (F.max("y") + 1).alias("y1"), F.sum(F.col("xe") - F.col("xs")).alias("ink")).withColumn("first_y", F.floor(F.col("component") / 1_000_000).cast("int")).withColumn("first_x", (F.col("component") % 1_000_000).cast("int")).drop("component")


def crossings(ink_h: DataFrame, ink_v: DataFrame, length: int) -> DataFrame:
    """Junctions of long horizontal with long vertical runs, per document."""
    h = ink_h.where(F.col("xe") - F.col("xs") >= length)
    v = ink_v.where(F.col("xe") - F.col("xs") >= length).select("doc_id", F.col("y").alias("vx"), F.col("xs").alias("vs"), F.col("xe").alias("ve"))
    # dealt into bands of rows: a horizontal run lies in one, a vertical one in all it reaches
    h = h.withColumn("band", F.expr(f"y div {BAND}"))
    v = v.withColumn("band", F.explode(F.expr(f"sequence(vs div {BAND}, (ve - 1) div {BAND})")))
    met = h.join(v, ["doc_id", "band"]).where("vx >= xs AND vx < xe AND y >= vs AND y < ve")
    return met.groupBy("doc_id").agg(F.count("*").alias("junctions"))


def subtracted(ink: DataFrame, boxes: DataFrame) -> DataFrame:
    """Runs with the parts under boxes (doc_id, x0, y0, x1, y1) removed, as maximal runs."""
    # dealt into bands of rows: a run lies in one, a box in all it reaches
    reach = boxes.where("y1 > y0").withColumn("band", F.explode(F.expr(f"sequence(CAST(floor(y0 / {BAND}) AS INT), CAST(floor(y1 / {BAND}) AS INT))")))
    cover = ink.withColumn("band", F.expr(f"CAST(floor(y / {BAND}) AS INT)")).join(reach, ["doc_id", "band"]).where("y >= y0 AND y < y1 AND x0 < xe AND xs < x1")
    holes = cover.groupBy("doc_id", "y", "xs", "xe").agg(F.array_sort(F.collect_list(F.struct(F.col("x0").alias("a"), F.col("x1").alias("b")))).alias("holes"))
    joined = ink.join(holes, ["doc_id", "y", "xs", "xe"], "left")
    # walk the holes left to right, keeping where the next piece starts and the pieces so far
    zero = F.struct(F.col("xs").alias("at"), F.array().cast("array<struct<xs:int,xe:int>>").alias("out"))
    step = lambda s, h: F.struct(F.greatest(s["at"], h["b"]).alias("at"), F.when(h["a"] > s["at"], F.concat(s["out"], F.array(F.struct(s["at"].alias("xs"), h["a"].alias("xe"))))).otherwise(s["out"]).alias("out"))
    walked = F.aggregate(F.coalesce("holes", F.array().cast("array<struct<a:int,b:int>>")), zero, step)
    pieces = F.when(walked["at"] < F.col("xe"), F.concat(walked["out"], F.array(F.struct(walked["at"].alias("xs"), F.col("xe").alias("xe"))))).otherwise(walked["out"])
    return joined.select("doc_id", "y", F.explode(pieces).alias("p")).select("doc_id", "y", "p.xs", "p.xe")
