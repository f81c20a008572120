"""Template regions: page scopes, shapes of text, similarity, variants."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

SPECIFIC_DIGITS = 4


def scope_pages(kind: Column, total: Column, first: Column, last: Column, pages: Column, page: Column) -> Column:
    """The pages a region is checked on, sorted, for a document of `total` pages."""
    every = F.sequence(F.lit(1), total)
    lo, hi = F.greatest(F.lit(1), F.coalesce(first, F.lit(1))), F.least(total, F.coalesce(last, total))
    none = F.array().cast("array<int>")
    one = F.coalesce(page, F.lit(1))
    found = (
        F.when(kind == "all", every)
        .when(kind == "odd", F.filter(every, lambda p: p % 2 == 1))
        .when(kind == "even", F.filter(every, lambda p: p % 2 == 0))
        .when(kind == "first", F.array(F.lit(1)))
        .when(kind == "last", F.array(total))
        .when(kind == "range", F.when(lo <= hi, F.sequence(lo, F.greatest(lo, hi))).otherwise(none))
        .when(kind == "pages", F.array_sort(F.array_distinct(F.filter(pages, lambda p: (p >= 1) & (p <= total)))))
        .otherwise(F.array(F.when(one == -1, total).otherwise(F.greatest(F.lit(1), F.least(total, one)))))
    )
    return F.when(total >= 1, found).otherwise(none)


def expanded(regions: DataFrame, docs: DataFrame, by: list[str]) -> DataFrame:
    """One row per region, document and page in scope. docs(by, doc_id, total)."""
    met = docs.join(regions, by)
    pages = scope_pages(F.col("scope"), F.col("total"), F.col("from"), F.col("to"), F.col("pages"), F.col("page_num"))
    return met.withColumn("page_no", F.explode(pages)).drop("scope", "from", "to", "pages", "page_num")


def derived_pattern(text: Column) -> Column:
    """The shape of a text as a pattern: exact runs of digits and letters, white space, literals,
    with boundaries that treat `_` as a separator; null without text."""
    flat = F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))
    pieces = F.regexp_extract_all(flat, F.lit(r"(\p{Nd}+|\p{L}+| |.)"), F.lit(1))

    def part(p: Column) -> Column:
        n = F.length(p).cast("string")
        return (
            F.when(p.rlike(r"^\p{Nd}+$"), F.concat(F.lit(r"\p{Nd}{"), n, F.lit("}")))
            .when(p.rlike(r"^\p{L}+$"), F.concat(F.lit(r"\p{L}{"), n, F.lit("}")))
            .when(p == " ", F.lit(r"\s+"))
            .otherwise(F.concat(F.lit(r"\Q"), p, F.lit(r"\E")))
        )

    return F.when(flat != "", F.concat(F.lit(r"(?<![\p{L}\p{N}])"), F.array_join(F.transform(pieces, part), ""), F.lit(r"(?![\p{L}\p{N}])")))


def pattern_description(text: Column) -> Column:
    """`6 digits + '_' + 1 digit` for 894387_5."""
    flat = F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))
    pieces = F.regexp_extract_all(flat, F.lit(r"(\p{Nd}+|\p{L}+| |.)"), F.lit(1))

    def part(p: Column) -> Column:
        n = F.length(p)
        many = F.when(n > 1, "s").otherwise("")
        return F.when(p.rlike(r"^\p{Nd}+$"), F.concat(n, F.lit(" digit"), many)).when(p.rlike(r"^\p{L}+$"), F.concat(n, F.lit(" letter"), many)).when(p == " ", F.lit("space")).otherwise(F.concat(F.lit("'"), p, F.lit("'")))

    return F.array_join(F.transform(pieces, part), " + ")


def is_specific(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{Nd}", "")) >= SPECIFIC_DIGITS


def pattern_status(master: Column, here: Column, scope: Column) -> Column:
    """PASS where the shape stands in place, or elsewhere in the scope if it is specific; a common
    shape elsewhere is only CHECK; nothing is FAIL; no master text is CHECK."""
    pattern = derived_pattern(master)
    hits = lambda t: F.regexp_extract_all(F.coalesce(t, F.lit("")), pattern, F.lit(0))
    in_place, elsewhere = F.size(hits(here)) > 0, F.size(F.array_except(hits(scope), hits(here))) > 0
    return (
        F.when(pattern.isNull(), "CHECK (No Pattern)")
        .when(in_place, "PASS (Pattern)")
        .when(elsewhere & is_specific(master), "PASS (Pattern)")
        .when(elsewhere, "CHECK (Pattern Moved)")
        .otherwise("FAIL (Pattern)")
    )


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio in percent; an edit distance is not the same measure."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() * 100 for x, y in zip(a, b)], dtype=float)


def similarity(rows: DataFrame, master: str, target: str) -> DataFrame:
    """rows with similarity (percent, one decimal) and match_desc; only pairs that are neither empty
    nor equal reach the Python measure, and those in as many tasks as a shuffle has."""
    flat = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\s\p{Z}]+", " ")))
    r = rows.withColumn("__a", flat(master)).withColumn("__b", flat(target))
    empty_a, empty_b = F.coalesce(F.col(master), F.lit("")) == "", F.coalesce(F.col(target), F.lit("")) == ""
    kind = F.when(empty_a & empty_b, "Exact Match (Both Empty)").when(empty_a | empty_b, "Empty / No Content").when(F.col("__a") == F.col("__b"), "Exact Match")
    r = r.withColumn("match_desc", kind)
    easy = r.where("match_desc IS NOT NULL").withColumn("similarity", F.when(F.col("match_desc") == "Empty / No Content", 0.0).otherwise(100.0))
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(r"([\p{L}\p{M}\p{N}_]+)"), F.lit(1)))
    # a small table takes long here: its rows are dealt out to all cores, however few files or partitions hold them
    session = rows.sparkSession
    tasks = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    hard = r.where("match_desc IS NULL").repartition(tasks).withColumn("__r", _ratio("__a", "__b"))
    overlap = F.when((F.size(tokens("__a")) > 0) & (F.size(tokens("__b")) > 0), 100.0 * F.size(F.array_intersect(tokens("__a"), tokens("__b"))) / F.size(tokens("__a")))
    hard = hard.withColumn("__o", F.coalesce(overlap, F.lit(0.0)))
    near, token = F.col("__r") >= 85, F.col("__o") >= 75
    hard = hard.withColumn("match_desc", F.when(near, "Near Match").when(token, "Token Match").otherwise("Translated / Content Present"))
    hard = hard.withColumn("similarity", F.bround(F.when(~near & token, F.greatest("__r", "__o")).otherwise(F.col("__r")), 1))
    return easy.drop("__a", "__b").unionByName(hard.drop("__a", "__b", "__r", "__o"))


def needle_count(scope: Column, needle: Column) -> Column:
    """How often the needle's tokens stand one after another in the scope's."""
    n, k = F.size(scope), F.size(needle)
    starts = F.when((k > 0) & (n >= k), F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(starts, lambda i: F.slice(scope, i, k) == needle))


def needle_status(count: Column) -> Column:
    return F.when(count == 1, "PASS").when(count == 0, "FAIL").otherwise("CHECK")


def collapsed_variants(results: DataFrame) -> DataFrame:
    """Regions of one variant group on a page of a target as one row: any match wins (the first),
    else the most similar. Rows without a group pass through.

    results(variant_group, region_label, eng_page, tr_name, seq, similarity, is_match, status).
    """
    key = ["variant_group", "eng_page", "tr_name"]
    order = [F.desc("is_match"), F.when(F.col("is_match"), F.lit(0.0)).otherwise(-F.col("similarity")), "seq"]
    w = Window.partitionBy(*key)
    grouped = results.where("variant_group IS NOT NULL").withColumn("variant_count", F.count("*").over(w)).withColumn("__n", F.row_number().over(w.orderBy(*order))).where("__n = 1").drop("__n")
    status = F.when(F.col("is_match"), F.concat(F.lit("PASS (variant: "), F.col("region_label"), F.lit(")"))).otherwise(F.format_string("FAIL (no variant matched, tried %d)", "variant_count"))
    grouped = grouped.withColumn("status", status).withColumn("variant_matched", F.when(F.col("is_match"), F.col("region_label"))).withColumn("region_label", F.col("variant_group"))
    alone = results.where("variant_group IS NULL").withColumn("variant_count", F.lit(None).cast("long")).withColumn("variant_matched", F.lit(None).cast("string"))
    return alone.unionByName(grouped)


def numbered(regions: DataFrame, by: list[str]) -> DataFrame:
    """Labels `Region 1` and `Region 1.1` in order of parents and children; labels of one's own stay.
    Regions further down, and those whose parent is not there, are not numbered: they keep what they have.

    regions(by, id, parent_id, seq, label).
    """
    parents = regions.where("parent_id IS NULL").withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("seq")))
    children = regions.where("parent_id IS NOT NULL").withColumn("k", F.row_number().over(Window.partitionBy(*by, "parent_id").orderBy("seq")))
    children = children.join(parents.select(*by, F.col("id").alias("parent_id"), "n"), [*by, "parent_id"])
    auto = F.coalesce(F.col("label").startswith("Region "), F.lit(True))
    a = parents.select(*by, "id", F.when(auto, F.concat(F.lit("Region "), "n")).otherwise(F.col("label")).alias("label"))
    b = children.select(*by, "id", F.when(auto, F.concat(F.lit("Region "), "n", F.lit("."), "k")).otherwise(F.col("label")).alias("label"))
    rest = regions.join(a.unionByName(b).select(*by, "id"), [*by, "id"], "left_anti").select(*by, "id", "label")
    return a.unionByName(b).unionByName(rest)


def text_status(similarity_pct: Column, has_text: Column, exact: Column, threshold: Column) -> Column:
    """Verdict of a region's text. Exact mode passes from 98. Otherwise 98 is exact, 85 near; other
    text passes as present from the threshold and is a translation to check below it; no text fails."""
    return (
        F.when(exact, F.when(similarity_pct >= 98, "PASS (Exact Match)").otherwise("FAIL (Exact Required)"))
        .when(~has_text, "FAIL (Empty Region)")
        .when(similarity_pct >= 98, "PASS (Exact)")
        .when(similarity_pct >= 85, "PASS (Near)")
        .when(similarity_pct >= threshold, "PASS (Present)")
        .otherwise("CHECK (Translated)")
    )


def is_match(status: Column) -> Column:
    """Passes and translations to check are matches."""
    return status.startswith("PASS") | (status == "CHECK (Translated)")


def search_window(rect: tuple, x_tolerance: Column, y_tolerance: Column, width: Column, height: Column, run_x: float = 0.0, run_y: float = 90.0) -> tuple:
    """A region's box grown by its own tolerances (else the run's) and kept on the page."""
    dx, dy = F.coalesce(x_tolerance, F.lit(run_x)), F.coalesce(y_tolerance, F.lit(run_y))
    zero = F.lit(0.0)
    return (F.greatest(zero, rect[0] - dx), F.greatest(zero, rect[1] - dy), F.least(width, rect[2] + dx), F.least(height, rect[3] + dy))


def clipped_text(spans: DataFrame, rects: DataFrame, key: list[str]) -> DataFrame:
    """The text in each rectangle, in reading order. spans(doc_id, page_no, text, x0, y0, x1, y1),
    rects(doc_id, page_no, *key, r_x0, r_y0, r_x1, r_y1); rectangles without text give ''."""
    page = ["doc_id", "page_no"]
    met = rects.join(spans, page).where("x0 < r_x1 AND r_x0 < x1 AND y0 < r_y1 AND r_y0 < y1")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.bround("y0", 0).alias("y"), "x0", "text"))), lambda s: s["text"])
    text = met.groupBy(*page, *key).agg(F.array_join(ordered, " ").alias("clip"), F.min(F.col("y0") - F.col("r_y0")).alias("shift"))
    return rects.join(text, [*page, *key], "left").withColumn("clip", F.coalesce("clip", F.lit(""))).withColumn("shift_y", F.bround(F.round("shift", 3), 1) + F.lit(0.0)).drop("shift")
