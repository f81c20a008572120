"""The training-data pipeline: STAGES in order, each over all that its predecessor kept.

Quality rules reject documents; line dedup drops recurring template lines, among them those with numbers in all fields
but two, and identical lines, and the documents that it leaves without a word; one document of each near-duplicate
group stays; repeated passages are cut out; what is left is packed into sequences. Each stage takes documents of any columns among
which are doc_id and text; all but the last return the same columns, n_chars counted anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh, table, written
from tessera.llm.config_packing import pack
from tessera.llm.crf_quality import keep_good
from tessera.llm.line_templates import dedup_lines
from tessera.llm.minhash_join import near_duplicates, row_id
from tessera.llm.suffix_levels import drop_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done, _, n_dropped = dedup_lines(docs, identical=True, least_const=2)
    done = done.where((F.col(n_dropped) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    *key, nth = fresh(docs.columns, "__uid", "__uid2", "__nth")
    kept = near_duplicates(docs).where("kept").select("uid", "uid2").distinct().toDF(*key)
    keyed = docs.withColumns(dict(zip(key, row_id()))).join(written(kept, "near-kept").hint("shuffle_hash"), key)
    # rows that repeat a doc_id and its text are one document
    first = keyed.withColumn(nth, F.row_number().over(Window.partitionBy(*key).orderBy("doc_id")))
    return first.where(F.col(nth) == 1).select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
