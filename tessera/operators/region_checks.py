"""Regions verified in their modes, in the order in which one mode gives way to the next."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import geometry as g
from tessera.operators import regions as rg
from tessera.operators.spatial import PAGE, pairs

VISUAL_PASS, THRESHOLD, COVERAGE = 75.0, 30.0, 0.5
SEPARATORS = "[_ \t\n\r\x0b\x0c   ]"


def codes_in(regions: DataFrame, codes: DataFrame, key: list[str]) -> DataFrame:
    """(page, key, types, values): the codes that meet each region, types as a sorted list."""
    met = pairs(regions, codes, g.intersects(g.box("a_"), g.box("b_")))
    kinds = F.array_sort(F.collect_list(F.struct(F.col("b_type").alias("type"), F.col("b_data").alias("data"))))
    return met.groupBy(*PAGE, *[F.col(f"a_{k}").alias(k) for k in key]).agg(kinds.alias("c")).select(*PAGE, *key, F.transform("c", lambda x: x["type"]).alias("types"), F.transform("c", lambda x: x["data"]).alias("values"))


def tokens_of(chars: DataFrame, line: list[str]) -> DataFrame:
    """Tokens of each line: characters between separators, with the box around them and their order.

    chars(line, char_no, c, x0, y0, x1, y1); a line's end ends a token.
    """
    w = Window.partitionBy(*line).orderBy("char_no")
    cut = F.col("c").rlike(SEPARATORS)
    numbered = chars.withColumn("cut", cut).withColumn("token_no", F.sum(F.col("cut").cast("int")).over(w)).where(~F.col("cut"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("char_no", "c"))), lambda x: x["c"]), "")
    return numbered.groupBy(*line, "token_no").agg(text.alias("token"), F.min("char_no").alias("first"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def needles(regions: DataFrame, tokens: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """(page, key, needle): the tokens of which half or more lies in each region, in reading order.

    tokens(page, order, token, box); order is that of the text, not of the places.
    """
    share = g.area(g.intersection(g.box("a_"), g.box("b_"))) / g.area(g.box("b_"))
    met = pairs(regions, tokens.where(g.area(g.box()) > 0), g.intersects(g.box("a_"), g.box("b_")) & (share >= COVERAGE))
    said = F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(f"b_{c}").alias(c) for c in order], F.col("b_token").alias("token")))), lambda x: x["token"])
    return met.groupBy(*PAGE, *[F.col(f"a_{k}").alias(k) for k in key]).agg(said.alias("needle"))


def presence_status(eng_types: Column, tr_types: Column, tr_text: Column, tr_ink: Column, eng_text: Column, eng_ink: Column) -> Column:
    """What belongs there is there: codes of the same types, else any text or ink, else nothing on both sides."""
    said = lambda t: F.trim(F.coalesce(t, F.lit(""))) != ""
    want, have = F.coalesce(eng_types, F.array().cast("array<string>")), F.coalesce(tr_types, F.array().cast("array<string>"))
    code = F.when(F.array_sort(want) == F.array_sort(have), "PASS (Present)").when(F.size(have) == 0, "FAIL (Code Missing)").otherwise("FAIL (Wrong Code Type)")
    plain = F.when(said(tr_text) | F.coalesce(tr_ink, F.lit(False)), "PASS (Present)").when(~said(eng_text) & ~F.coalesce(eng_ink, F.lit(False)), "PASS (Present)").otherwise("FAIL (Missing)")
    return F.when(F.size(want) > 0, code).otherwise(plain)


def visual_status(similarity: Column, threshold: Column) -> Column:
    """Pictures alike from 75 (or the threshold, if higher), to check from the threshold; null: nothing to compare."""
    return (
        F.when(similarity.isNull(), "CHECK (No Graphics Here)")
        .when(similarity >= F.greatest(F.lit(VISUAL_PASS), threshold), "PASS (Visual Match)")
        .when(similarity >= threshold, "CHECK (Visual Partial)")
        .otherwise("FAIL (Visual Mismatch)")
    )


@lru_cache(maxsize=1024)
def _compiled(pattern: str) -> re.Pattern | None:
    try:
        return re.compile(pattern)
    except (re.error, OverflowError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def _pattern_found(pattern: pd.Series, here: pd.Series, scope: pd.Series) -> pd.Series:
    """bad, here, scope or none for each pattern in the two texts; null without a pattern."""

    def one(p: str | None, a: str | None, b: str | None) -> str | None:
        if p is None:
            return None
        found = _compiled(p)
        if found is None:
            return "bad"
        return "here" if found.search(a or "") else "scope" if b and found.search(b) else "none"

    return pd.Series([one(*x) for x in zip(pattern, here, scope)], dtype=object)


def own_pattern_status(pattern: Column, here: Column, scope: Column) -> Column:
    """A hand-written pattern passes wherever in the scope it is found; one that is no pattern is to check.

    Patterns are Python's, whose grammar and classes differ from those of Java: each distinct one is compiled once
    in a worker, and one that can't be compiled stops nothing. Texts go to Python only where there is a pattern.
    """
    given = lambda c: F.when(pattern.isNotNull(), c)
    found = _pattern_found(pattern, given(here), given(scope))
    return F.when(found == "bad", "CHECK (Bad Pattern)").when(found.isin("here", "scope"), "PASS (Pattern)").when(found == "none", "FAIL (Pattern)")


def verified(rows: DataFrame) -> DataFrame:
    """rows with status, similarity, mode and is_match.

    rows hold one region on one page of one translation: pattern_match, presence_only,
    dont_compare_text, exact_match (boolean), pattern, eng_text, tr_text, scope_text, eng_types,
    tr_types, eng_ink, tr_ink, visual, needle and scope_tokens (arrays), threshold, file_found, pages.
    Pattern goes before presence, presence before pictures, these before a needle in a scope, that
    before exact text, and that before the check of text in general.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    threshold = F.coalesce("threshold", F.lit(THRESHOLD))
    mode = (
        F.when(~F.coalesce(F.col("file_found"), F.lit(True)), "no file").when(F.coalesce(F.col("pages"), F.lit(1)) == 0, "empty")
        .when(flag("pattern_match"), "pattern").when(flag("presence_only"), "presence").when(flag("dont_compare_text"), "visual")
        .when(flag("exact_match") & (F.coalesce(F.size("needle"), F.lit(0)) > 0) & F.col("scope_tokens").isNotNull(), "scoped").when(flag("exact_match"), "exact").otherwise("normal")
    )
    r = rg.similarity(rows.withColumn("mode", mode), "eng_text", "tr_text").withColumnRenamed("similarity", "__text")
    own = F.when((F.col("mode") == "pattern") & (F.col("pattern") != ""), F.col("pattern"))
    pattern = F.when(F.coalesce("pattern", F.lit("")) != "", own_pattern_status(own, F.col("tr_text"), F.col("scope_text"))).otherwise(rg.pattern_status(F.col("eng_text"), F.col("tr_text"), F.col("scope_text")))
    scoped = F.coalesce("scope_text", "tr_text")
    status = (
        F.when(F.col("mode") == "no file", "FAIL (File Not Found)").when(F.col("mode") == "empty", "FAIL (Empty PDF)")
        .when(F.col("mode") == "pattern", pattern)
        .when(F.col("mode") == "presence", presence_status(F.col("eng_types"), F.col("tr_types"), scoped, F.col("tr_ink"), F.col("eng_text"), F.col("eng_ink")))
        .when(F.col("mode") == "visual", visual_status(F.col("visual"), threshold))
        .when(F.col("mode") == "scoped", rg.needle_status(rg.needle_count(F.col("scope_tokens"), F.col("needle"))))
        .otherwise(rg.text_status(F.col("__text"), F.trim(F.coalesce("tr_text", F.lit(""))) != "", F.col("mode") == "exact", threshold))
    )
    r = r.withColumn("status", status)
    passed = F.col("status").startswith("PASS")
    similarity = F.when(F.col("mode") == "visual", F.coalesce("visual", F.lit(0.0))).when(F.col("mode").isin("exact", "normal"), F.col("__text")).otherwise(F.when(passed, 100.0).otherwise(0.0))
    return r.withColumn("similarity", similarity).withColumn("is_match", passed | F.col("status").isin("CHECK (Translated)", "CHECK (Visual Partial)")).drop("__text")


def region_batch(regions: DataFrame, docs: DataFrame, mapped: DataFrame, texts: DataFrame, by: list[str]) -> DataFrame:
    """All regions of each batch on all its translations, variants collapsed.

    regions as rg.expanded takes them, with seq, label, parent_id, id, variant_group, scope_only and
    the mode columns of verified(); docs(by, doc_id, role, total); mapped(by, tr_doc_id, page_no,
    mapped_page); texts(doc_id, page_no, id, text): a region's clip on each page, in the master and
    the translations. Scopes are expanded on the master; regions that only bound others are not checked.
    """
    master = docs.where("role = 'master'").select(*by, "doc_id", "total")
    pages = rg.expanded(regions, master, by).withColumnRenamed("doc_id", "eng_doc").withColumnRenamed("page_no", "eng_page")
    scope = regions.select(*by, F.col("id").alias("parent_id")).withColumn("has_parent", F.lit(True))
    checked = pages.join(scope, [*by, "parent_id"], "left").where(~F.coalesce("scope_only", F.lit(False)))
    t = docs.where("role <> 'master'").select(*by, F.col("doc_id").alias("tr_doc_id"), F.col("total").alias("pages"))
    fanned = checked.drop("total").join(t, by).join(mapped.withColumnRenamed("page_no", "eng_page"), [*by, "tr_doc_id", "eng_page"], "left")
    page = F.greatest(F.lit(1), F.least(F.col("pages"), F.coalesce("mapped_page", "eng_page")))
    clip = lambda name, doc, at, region: texts.select(F.col("doc_id").alias(doc), F.col("page_no").alias(at), F.col("id").alias(region), F.col("text").alias(name))
    full = fanned.withColumn("target_page", page).join(clip("clipped", "eng_doc", "eng_page", "id"), ["eng_doc", "eng_page", "id"], "left").join(clip("tr_text", "tr_doc_id", "target_page", "id"), ["tr_doc_id", "target_page", "id"], "left")
    full = full.join(clip("scope_text", "tr_doc_id", "target_page", "parent_id"), ["tr_doc_id", "target_page", "parent_id"], "left")
    needle = F.when(F.col("has_parent") & F.coalesce("exact_match", F.lit(False)), F.filter(F.split(F.coalesce("clipped", F.lit("")), SEPARATORS), lambda x: x != ""))
    tokens = F.when(F.col("has_parent"), F.filter(F.split(F.coalesce("scope_text", F.lit("")), SEPARATORS), lambda x: x != ""))
    ready = full.withColumn("eng_text", F.coalesce("expected_text", "clipped")).withColumn("needle", needle).withColumn("scope_tokens", tokens).withColumn("file_found", F.lit(True))
    done = verified(ready).withColumnRenamed("label", "region_label").withColumn("tr_name", F.concat_ws("/", *[F.col(c).cast("string") for c in by], F.col("tr_doc_id").cast("string")))
    return rg.collapsed_variants(done.select("variant_group", "region_label", "eng_page", "tr_name", "seq", "similarity", "is_match", "status"))


def region_summary(results: DataFrame, by: list[str]) -> DataFrame:
    """`p/n passed` for each translation."""
    return results.groupBy(*by).agg(F.format_string("%d/%d passed", F.count_if("is_match"), F.count("*")).alias("summary"))
