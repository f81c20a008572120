"""Findings kept up to date by a file stream.

New documents land as files; each micro-batch drops documents already in the ledger, where one is
given, with the same path, time and size, runs the checks on the rest, and overwrites those
documents' findings only. They enter the ledger once their findings are written, so a batch that is
run twice leaves the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tessera.operators.components import written

BUCKETS, BUCKET = 64, "__bucket"
IDENTITY = ["path", "mtime", "size"]


def unseen(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Documents whose (path, mtime, size) is not in the ledger."""
    return docs.join(ledger.select(*IDENTITY).distinct(), IDENTITY, "left_anti")


def _same(key: list[str]) -> Column:
    """Equality of old and new keys, nulls equal."""
    met = F.lit(True)
    for c in key:
        met = met & F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    return met


def upserted(findings: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """findings with the rows of every key in `new` (null ones too) replaced by the new rows."""
    left = findings.alias("old").join(new.select(*key).distinct().alias("new"), _same(key), "left_anti")
    return left.unionByName(new, allowMissingColumns=True)


def write_upsert(rows: DataFrame, docs: DataFrame, folder: str, key: str) -> None:
    """Replace the findings of docs in folder by rows; other documents' findings stay.

    Findings lie in BUCKETS partitions by a hash of the document's key, whatever characters it holds, so the folders
    are few however many documents there are. The touched partitions are merged into a table beside them first and
    overwritten when it is whole: a check that fails leaves the old rows as they were. A document without findings
    loses those it had.
    """
    spark, bucket = rows.sparkSession, F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    new = rows.withColumn(BUCKET, bucket)
    new.limit(0).write.mode("append").partitionBy(BUCKET).parquet(folder)  # so that the folder is there
    keys = docs.select(key).distinct().withColumn(BUCKET, bucket)
    touched = sorted(r[0] for r in keys.select(BUCKET).distinct().collect())  # BUCKETS at most
    if not touched:
        return
    held = spark.read.option("mergeSchema", True).schema(new.schema).parquet(folder).where(F.col(BUCKET).isin(touched))
    kept = held.alias("old").join(keys.alias("new"), _same([key]) & (F.col(f"old.{BUCKET}") == F.col(f"new.{BUCKET}")), "left_anti")
    merged = written(kept.unionByName(new), "findings")
    merged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(folder)
    # partitions that nothing is left of are not overwritten
    left = {r[0] for r in merged.select(BUCKET).distinct().collect()}
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for b in touched:
        if b not in left:
            fs.delete(path(f"{folder.rstrip('/')}/{BUCKET}={b}"), True)


def checked_stream(spark: SparkSession, landing: str, schema: str, check: Callable[[DataFrame], DataFrame], out: str, partition: list[str], checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None, ledger: str | None = None) -> DataStreamWriter:
    """A stream writer over the landing folder that runs `check` on each batch and upserts its
    findings to `out` by the first of the partition columns, the document; on_batch sees each batch's
    findings, masters are checked with the rest. ledger is a folder that lists the documents
    checked; without it all count as new. Of a document that a batch holds twice the latest counts."""

    def run(batch: DataFrame, number: int) -> None:
        key = partition[0]
        latest = batch.withColumn("__nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("mtime"), F.desc("size")))).where("__nth = 1").drop("__nth") if "mtime" in batch.columns else batch
        fresh = latest
        if ledger is not None:
            held = batch.sparkSession.createDataFrame([], batch.select(*IDENTITY).schema)
            held.write.mode("append").parquet(ledger)
            fresh = unseen(latest, batch.sparkSession.read.schema(held.schema).parquet(ledger))
        fresh = fresh.persist()
        found = check(fresh)
        write_upsert(found, fresh, out, key)
        if on_batch is not None:
            on_batch(found, number)
        if ledger is not None:
            fresh.select(*IDENTITY).distinct().write.mode("append").parquet(ledger)
        fresh.unpersist()

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(landing)
    return source.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(run)
