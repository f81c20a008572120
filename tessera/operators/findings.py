"""All checks' findings in one schema, verdicts, the gate, and report sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The order in which checks are listed.
SOURCES = ("counts", "crops", "regions", "toc", "links", "barcodes", "qr_codes", "overlap", "untranslated", "overflow")


def merged(checks: list[DataFrame]) -> DataFrame:
    """Findings of several checks; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), checks)


def replaced(findings: DataFrame, source: str, rows: DataFrame) -> DataFrame:
    """findings with one source's rows replaced; rows of no source stay."""
    return findings.where(~F.col("source").eqNullSafe(source)).unionByName(rows, allowMissingColumns=True)


def ordered(findings: DataFrame) -> DataFrame:
    """Review order: page, topic, the checks' priority, title; rows without a page last."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source")), F.lit(len(SOURCES) + 1))
    return findings.withColumn("priority", rank).orderBy(F.col("page_no").asc_nulls_last(), F.col("topic").asc_nulls_last(), "priority", "title")


def file_summaries(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """Per document: passed, total, percent (one decimal) and a verdict; documents without findings
    pass. docs(doc_id)."""
    s = findings.groupBy("doc_id").agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"))
    r = docs.select("doc_id").distinct().join(s, "doc_id", "left").na.fill(0, ["passed", "total"])
    pct = F.when(F.col("total") == 0, 100.0).otherwise(F.bround(100.0 * F.col("passed") / F.col("total"), 1))
    return r.withColumn("percent", pct).withColumn("verdict", F.when(F.col("passed") == F.col("total"), "PASS").otherwise("FAIL"))


def verdicts(checks: DataFrame, by: list[str], mode: str = "strict") -> DataFrame:
    """One verdict per document over its checks (by, check, passed, skipped): every check passes.

    mode="report" leaves regions and overflow out and counts a skipped check as passed.
    """
    ok = F.col("passed")
    if mode == "report":
        ok = ok | F.col("skipped") | F.col("check").isin("regions", "overflow")
    return checks.groupBy(*by).agg(F.every(ok).alias("passed"), F.count("*").alias("checks"))


def gated(docs: DataFrame, gate: DataFrame, results: DataFrame) -> DataFrame:
    """Results of documents whose gate check passed; the others are SKIPPED. gate(doc_id, passed)."""
    open_docs = gate.where("passed").select("doc_id")
    kept = results.join(open_docs, "doc_id", "left_semi")
    return docs.select("doc_id").distinct().join(kept, "doc_id", "left").withColumn("status", F.coalesce("status", F.lit("SKIPPED")))


def write_reports(reports: dict[str, DataFrame], folder: str, fmt: str = "parquet", partition_by: str | None = None) -> None:
    """One folder per sheet under `folder`, replaced as a whole (or only the partitions written)."""
    for sheet, rows in reports.items():
        writer = rows.write.mode("overwrite").format(fmt).option("header", True)
        if partition_by:
            writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition_by)
        writer.save(f"{folder.rstrip('/')}/{sheet}")


def run_times(log: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Master time, sum, average and total of a run log (batch, role, seconds)."""
    t = log.groupBy(batch).agg(F.sum(F.when(F.col("role") == "master", F.col("seconds")).otherwise(0.0)).alias("master_s"), F.sum(F.when(F.col("role") != "master", F.col("seconds")).otherwise(0.0)).alias("translations_s"), F.count_if(F.col("role") != "master").alias("translations"))
    return t.withColumn("average_s", F.when(F.col("translations") > 0, F.bround(F.col("translations_s") / F.col("translations"), 3))).withColumn("total_s", F.col("master_s") + F.col("translations_s"))
