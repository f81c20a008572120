"""The shuffle files of written tables, wrong before its change."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from tessera.llm import common


def shuffle_files(spark):
    return len(list(Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data")))


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    table = common.written(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.sum("id").alias("n")), "test-sums")
    for _ in range(50):  # they go behind the query's back
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert table.count() == 700 and table.agg(F.sum("n")).first()[0] == 5000 * 4999 // 2
