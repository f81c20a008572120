"""Lines of a translation that still read as the master's language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import folded, function_word_count, is_numeric_line, nfkc, words

MIN_WORDS, DENSE_MIN_WORDS, DENSE_MIN_RATIO = 4, 6, 0.40


def _normal(lines: DataFrame) -> DataFrame:
    """lines with `norm`; only rows beyond ASCII go through the Python normaliser."""
    plain, rest = lines.where(~F.col("text").rlike(r"[^\x00-\x7F]")), lines.where(F.col("text").rlike(r"[^\x00-\x7F]"))
    return plain.withColumn("norm", folded(F.col("text"))).unionByName(rest.withColumn("norm", folded(nfkc("text"))))


def inner_pages(lines: DataFrame, doc: list[str]) -> DataFrame:
    """lines without those of each document's first and last page."""
    last = lines.groupBy(*doc).agg(F.max("page_no").alias("__last"))
    return lines.join(last, doc).where("page_no > 1 AND page_no < __last").drop("__last")


def untranslated(lines: DataFrame, is_master: Column, skip_first_last: bool = True) -> DataFrame:
    """Findings over lines(doc_id, page_no, text, ...): lines that are verbatim in the master's
    inventory and hold a function word, or are dense in function words, or both.

    The inventory is a set of distinct normal lines and joins by equality. Lines of under four words
    and numeric lines never count; the master itself is not scanned.
    """
    rows = inner_pages(lines, ["doc_id"]) if skip_first_last else lines
    rows = rows.where(~is_numeric_line(F.col("text")))
    enough = F.size(F.filter(F.split("norm", " "), lambda w: w != "")) >= MIN_WORDS
    inventory = _normal(rows.where(is_master)).where(enough).select("norm").distinct().withColumn("in_master", F.lit(True))
    found = F.col("__words")
    other = rows.where(~is_master).withColumn("__words", words(F.col("text"))).withColumn("n_words", F.size(found)).withColumn("hits", function_word_count(found)).drop("__words")
    other = _normal(other.where(F.col("n_words") >= MIN_WORDS)).join(inventory, "norm", "left")
    ratio = F.col("hits") / F.col("n_words")
    verbatim = F.coalesce("in_master", F.lit(False)) & (F.col("hits") > 0)
    dense = (F.col("n_words") >= DENSE_MIN_WORDS) & (ratio >= DENSE_MIN_RATIO)
    reason = F.when(verbatim & dense, "verbatim + dense").when(verbatim, "verbatim").when(dense, "dense")
    return other.withColumn("reason", reason).where("reason IS NOT NULL").withColumn("density", F.bround(ratio, 2)).drop("norm", "in_master")
