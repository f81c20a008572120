"""Cases of the review's second round, each one wrong before its change."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import region_checks
from tessera.streaming import incremental

PATTERNS = [
    ("x**", "CHECK (Bad Pattern)"),
    ("[z-a]", "CHECK (Bad Pattern)"),
    ("a{2,1}", "CHECK (Bad Pattern)"),
    ("ab)(", "CHECK (Bad Pattern)"),
    ("*a", "CHECK (Bad Pattern)"),
    ("(?P<n>ing)", "PASS (Pattern)"),
    (r"\d{4}", "PASS (Pattern)"),
    (r"^Nr\. \d+", "PASS (Pattern)"),
    ("absent", "FAIL (Pattern)"),
    (None, None),
]


def test_patterns_that_are_none_stop_nothing(spark):
    rows = [(p, "Nr. ١٢٣ reading", "the year 1984", want) for p, want in PATTERNS]
    df = spark.createDataFrame(rows, "pattern string, here string, scope string, want string")
    got = df.select("want", region_checks.own_pattern_status(*(F.col(c) for c in ("pattern", "here", "scope"))).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    none = spark.createDataFrame([("a", None, None)], "pattern string, here string, scope string")
    assert none.select(region_checks.own_pattern_status(*(F.col(c) for c in none.columns))).first()[0] == "FAIL (Pattern)"


IDS = ["a:b", "50%", "x/y", "k=v", None, "", "a b", "__HIVE_DEFAULT_PARTITION__", "plain"]


def held(spark, out):
    return sorted(((r.doc_id, r.found) for r in spark.read.parquet(out).collect()), key=str)


def test_findings_of_any_id_are_replaced(spark, tmp_path):
    out = str(tmp_path / "out")
    docs = lambda ids: spark.createDataFrame([(i,) for i in ids], "doc_id string")
    rows = lambda ids, n: spark.createDataFrame([(i, n) for i in ids], "doc_id string, found int")
    incremental.write_upsert(rows(IDS * 2, 1), docs(IDS), out, "doc_id")
    assert held(spark, out) == sorted([(i, 1) for i in IDS * 2], key=str)
    incremental.write_upsert(rows(IDS[:5], 2), docs(IDS[:5]), out, "doc_id")
    assert held(spark, out) == sorted([(i, 2) for i in IDS[:5]] + [(i, 1) for i in IDS[5:] * 2], key=str)
    # a document without findings loses those it had, and a batch that runs twice changes nothing
    for _ in range(2):
        incremental.write_upsert(rows([], 3), docs(IDS[:7]), out, "doc_id")
    assert held(spark, out) == sorted([(i, 1) for i in IDS[7:] * 2], key=str)
    assert len(list((tmp_path / "out").glob("__bucket=*"))) <= incremental.BUCKETS


def test_a_check_that_fails_leaves_the_old_rows(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([(i, 1) for i in IDS], "doc_id string, found int")
    incremental.write_upsert(rows, rows, out, "doc_id")
    bad = rows.withColumn("found", F.when(F.col("doc_id") == "plain", F.raise_error(F.lit("no"))).otherwise(F.col("found")).cast("int"))
    with pytest.raises(Exception, match="no"):
        incremental.write_upsert(bad, rows, out, "doc_id")
    assert held(spark, out) == sorted([(i, 1) for i in IDS], key=str)


def test_upserted_replaces_null_keys(spark):
    old = spark.createDataFrame([(None, 1), ("a", 1), ("b", 1)], "doc_id string, found int")
    new = spark.createDataFrame([(None, 2), ("a", 2)], "doc_id string, found int")
    assert sorted(map(tuple, incremental.upserted(old, new, ["doc_id"]).collect()), key=str) == [("a", 2), ("b", 1), (None, 2)]
