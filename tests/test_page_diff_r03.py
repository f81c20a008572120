"""Page differences at size: what is worked out for each pair, and how often graphics are read."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import page_diff
from tessera.operators.crops import correlation


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_correlation_sums_once(spark):
    rng = np.random.RandomState(3)
    pairs = [(rng.rand(n), rng.rand(n)) for n in (2, 9, 64, 500)] + [(np.full(9, 0.3), rng.rand(9)), (np.full(9, 0.3), np.full(9, 0.3)), (np.full(9, 0.3), np.full(9, 0.4))]
    df = spark.createDataFrame([(i, p.tolist(), q.tolist()) for i, (p, q) in enumerate(pairs)], "i int, p array<double>, q array<double>")
    scored = df.select("i", correlation(F.col("p"), F.col("q")).alias("r"))
    want = [np.corrcoef(p, q)[0, 1] for p, q in pairs[:4]] + [0.0, 1.0, 0.0]
    assert np.allclose([r.r for r in scored.orderBy("i").collect()], want, atol=1e-12)
    # two means and three products; a mean inside another sum's function would be taken anew for each pixel
    assert plan_of(scored).count("aggregate(") == 5


def test_graphics_are_read_a_few_times(spark, tmp_path):
    cols = "doc int, page_no int, no long, x0 double, y0 double, x1 double, y1 double, pixels array<double>"
    rng = np.random.RandomState(5)
    rows = [(d, p, n, 90.0 * n, 0.0, 90.0 * n + 50, 50.0, rng.rand(16).tolist()) for d in (1, 2) for p in (1, 2, 3) for n in (1, 2, 3)]
    spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / "m"))
    m = spark.read.parquet(str(tmp_path / "m"))
    t = m.where("page_no <> 3 OR no <> 2").withColumn("page_no", F.when(F.expr("page_no = 2 AND no = 1"), 3).otherwise(F.col("page_no")))
    diffs = page_diff.page_differences(m, t, m.select("doc", "page_no").distinct().withColumn("target_page", F.col("page_no")), ["doc"])
    # the one carried to page 3 lies on the place of that page's first, so it is no addition there
    want = [(d, *row) for d in (1, 2) for row in ((2, "reflowed", 1, 0, 3), (3, "missing", 2, 0, 0))]
    assert sorted((r.doc, r.page_no, r.kind, r.m or 0, r.t or 0, r.near_page or 0) for r in diffs.collect()) == want
    assert plan_of(diffs).count("Relation [") <= 14
