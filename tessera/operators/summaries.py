"""Rows that reports are made of: page ranges, reasons, batch footers, tallies, anchors of counts, file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PATH_LIMIT = 240


def page_range(first: Column, last: Column, prefix: str) -> Column:
    """`Eng P3-P5`, `Eng P3`, or `-` without a page."""
    return F.when(first.isNull(), "-").when(last.isNull() | (first == last), F.format_string(f"{prefix} P%d", first)).otherwise(F.format_string(f"{prefix} P%d-P%d", first, last))


def verdict_class(status: Column) -> Column:
    """green for passes, amber for what is to be checked, red for the rest."""
    return F.when(status.startswith("PASS"), "green").when(status.startswith("CHECK") | status.startswith("SKIPPED"), "amber").otherwise("red")


def table_report(rows: DataFrame) -> DataFrame:
    """Aligned tables as report rows: numbers from 1, page ranges of both sides, a label and a class.

    rows(pair..., step, master_idx, target_idx, status, m_first, m_last, t_first, t_last).
    """
    label = F.when(F.col("master_idx").isNull(), F.format_string("Extra table %d", F.col("target_idx") + 1)).otherwise(F.format_string("Table %d", F.col("master_idx") + 1))
    reason = F.when(F.col("status") == "PASS", "").when(F.col("status") == "MISSING", "not found in the translation").when(F.col("status") == "EXTRA", "not in the master").otherwise("rows or columns differ")
    return rows.withColumns({"label": label, "master_pages": page_range(F.col("m_first"), F.col("m_last"), "Eng"), "target_pages": page_range(F.col("t_first"), F.col("t_last"), "Tr"), "reason": reason, "verdict_class": verdict_class(F.col("status"))})


def tally(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, tally): a map from each value to how often it occurs."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(value), F.col("n"))))).alias("tally"))


def batch_footer(docs: DataFrame, by: list[str]) -> DataFrame:
    """Documents, pages, bytes and how many differ from their master. docs(by, pages, bytes, note)."""
    return docs.groupBy(*by).agg(F.count("*").alias("documents"), F.sum("pages").alias("pages"), F.sum("bytes").alias("bytes"), F.count_if(F.coalesce("note", F.lit("")) != "").alias("differ"))


def anchored_counts(counts: DataFrame, images: DataFrame, by: list[str], key: str) -> DataFrame:
    """Count rows moved to the first image of their topic: its page and place; rows of topics without
    images keep their page. counts(by, key, page_no), images(by, key, page_no, y0, x0)."""
    first = images.groupBy(*by, key).agg(F.min(F.struct("page_no", "y0", "x0")).alias("f"))
    met = counts.join(first, [*by, key], "left")
    return met.select(*[c for c in counts.columns if c != "page_no"], F.coalesce("f.page_no", "page_no").alias("page_no"), F.col("f.y0").alias("y0"))


def search_score(rows: DataFrame, by: list[str], threshold: float = 80.0) -> DataFrame:
    """Matched over checked in percent, PASS from the threshold. rows(by, found)."""
    s = rows.groupBy(*by).agg(F.count_if("found").alias("matched"), F.count("*").alias("checked"))
    pct = F.bround(100.0 * F.col("matched") / F.col("checked"), 1)
    return s.withColumn("score_pct", pct).withColumn("overall", F.when(pct >= threshold, "PASS").otherwise("CHECK"))


def table_numbers(tables: DataFrame, doc: list[str]) -> DataFrame:
    """tables with a number that runs through the document, and whether each is its page's first or last."""
    order = Window.partitionBy(*doc).orderBy("page_no", "y0", "x0", "box_no")
    page = Window.partitionBy(*doc, "page_no")
    t = tables.withColumn("table_no", F.row_number().over(order))
    return t.withColumn("is_first", F.col("table_no") == F.min("table_no").over(page)).withColumn("is_last", F.col("table_no") == F.max("table_no").over(page))


def crop_numbers(crops: DataFrame, doc: list[str], kept: Column) -> DataFrame:
    """Crops with their number on the page; those that `kept` leaves out are counted first, so gaps stay."""
    w = Window.partitionBy(*doc, "page_no").orderBy("y0", "x0", "box_no")
    return crops.withColumn("crop_no", F.row_number().over(w)).where(kept)


def crop_path(folder: Column, topic: Column, page: Column, number: Column, label: Column, limit: int = PATH_LIMIT) -> Column:
    """folder/topic/p003_crop_01_label.png within limit characters: the topic's name is shortened, and
    where that leaves under 8 of it the page's folder stands in."""
    name = F.concat(F.format_string("p%03d_crop_%02d_", page, number), label, F.lit(".png"))
    room = F.lit(limit) - F.length(folder) - F.length(name) - 2
    short = F.regexp_replace(F.left(topic, F.greatest(room, F.lit(0))), r"[. ]+$", "")
    where = F.when(F.length(topic) <= room, topic).when(room >= 8, short).otherwise(F.format_string("page_%03d", page))
    return F.concat_ws("/", folder, where, name)


def all_codes(decoded: DataFrame, structural: DataFrame, least: float = 5.0, pad: float = 4.0) -> DataFrame:
    """Codes of each page: decoded ones, and found shapes that no decoded one meets (grown by pad), of
    5 by 5 and more. Both(doc_id, page_no, box_no, type, box)."""
    from tessera.operators.spatial import outside

    big = structural.where((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least))
    alone = outside(big, decoded.select("doc_id", "page_no", "x0", "y0", "x1", "y1"), pad)
    return decoded.withColumn("decoded", F.lit(True)).unionByName(alone.withColumn("decoded", F.lit(False)))


def comparable_crop(width: Column, height: Column, pixels: Column) -> Column:
    """Whether a crop can be compared: 8 by 8 pixels and a standard deviation of one or more."""
    n = F.size(pixels)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    mean = total(pixels) / n
    return (width >= 8) & (height >= 8) & (F.sqrt(total(F.transform(pixels, lambda v: (v - mean) * (v - mean))) / n) >= 1.0)


def signatures(crops: DataFrame, key: list[str]) -> DataFrame:
    """crops with the number of the first crop of the same shape and pixels, so that repeats are searched once."""
    same = ["height", "width", F.sha2(F.to_json(F.struct("pixels")), 256)]
    first = F.min("crop_no").over(Window.partitionBy(*key, *same))
    return crops.withColumn("searched_as", first)
