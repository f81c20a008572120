"""Exact top-k inner-product search with norm buckets.

Vectors are integers here (each component floor(scale * x)), so products are exact. Candidates are
grouped by length into buckets of about equal numbers (quantiles of the squared norm) and each
bucket is cut into blocks. A query's k-th best score among the longest vectors (at most SEEDS of
them, a broadcast whose size is that constant) is a floor for its final k-th score. In a bucket of
greatest length L, a candidate must have cosine at least floor / (|q| L) with q: the local
threshold. No query of a block can be met by a bucket whose threshold is over 1, so that pair of
blocks is never made. Within a pair of blocks a query prunes by length where its threshold is low
(a candidate's own length must reach floor / |q|) and by coordinates where it is high (in the
query's FOCUS largest coordinates a candidate must lie within the arc the threshold allows). What
is left is verified by products. Vectors of each width are searched apart, with their own seeds.

Query blocks meet the blocks of a bucket by its number, not row by row. Vectors that
are null, empty, or hold null or non-finite components take no part; so do those with a null id.
Queries meet candidates of their own width only. Products are taken in doubles where all of them are
whole there, else doubles only choose what 64-bit integers then verify. Equal scores go to the smaller id; repeated ids are separate
candidates but never match their own id. Fewer candidates than k: all. Extra columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table, written

K, SCALE = 20, 64
BUCKETS, QUERY_BLOCK, CANDIDATE_BLOCK = 16, 1024, 4096
SEEDS = 4096
FOCUS, HIGH = 4, 0.75


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>, norm2 double) of the usable vectors."""
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = vectors.where(ok & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))
    return v.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def slack(q: np.ndarray, c: np.ndarray) -> float:
    """How far a product in doubles may be from the whole number it stands for; 0 if never."""
    most = float(np.abs(q.astype(float)).max(initial=0.0)) * float(np.abs(c.astype(float)).max(initial=0.0)) * q.shape[1]
    return 0.0 if most < 2.0**53 else most * q.shape[1] * 2.0**-51


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores, ties to the smaller id."""
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search_block(q_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query of a block, its up to k best candidates of the block at or over its floor; whole numbers throughout."""
    loose, q_whole = slack(q, c), q
    q, as_double = q.astype(float), c.astype(float)
    order = np.argsort(-(as_double * as_double).sum(1), kind="stable")
    c_ids, whole, c = c_ids[order], c[order], as_double[order]
    length = np.sqrt((c * c).sum(1))
    unit = c / np.maximum(length, 1e-12)[:, None]
    reach = np.sqrt((q * q).sum(1))
    long_enough = np.searchsorted(-length, -np.divide(floors, np.maximum(reach, 1e-12)) * (1 - 1e-9) + 1e-6, "right")
    long_enough = np.where(floors <= 0, len(c), np.where(reach > 0, long_enough, 0))
    threshold = np.where((floors > 0) & (reach > 0), floors / np.maximum(reach * (length[0] if len(length) else 0), 1e-12), -1.0)
    exact = lambda i, rows, s: s if not loose else (whole[rows] * q_whole[i]).sum(1)
    by_length = np.flatnonzero((threshold < HIGH) & (long_enough > 0))
    for a in range(0, len(by_length), 128):
        rows = by_length[a : a + 128]
        scores = q[rows] @ c[: int(long_enough[rows].max())].T
        for i, s in zip(rows, scores):
            keep = np.flatnonzero((s >= floors[i] - loose) & (c_ids[: len(s)] != q_ids[i]))
            if len(keep) > k:
                least = np.partition(s[keep], len(keep) - k)[len(keep) - k]
                keep = keep[s[keep] >= least - 2 * loose]
            yield (i, *best(c_ids[keep], exact(i, keep, s[keep]), k))
    for i in np.flatnonzero((threshold >= HIGH) & (threshold <= 1 + 1e-9) & (long_enough > 0)):
        n, u, t = int(long_enough[i]), q[i] / reach[i], min(1.0, float(threshold[i]))
        live = np.arange(n)
        for f in np.argsort(-np.abs(u))[:FOCUS]:
            # cos(q, c) >= t keeps coordinate f of c / |c| within this arc around the query's
            wide = np.sqrt(max(0.0, (1 - t * t) * (1 - u[f] * u[f])))
            x = unit[live, f]
            low = -1.0 if u[f] < -t else t * u[f] - wide
            high = 1.0 if u[f] > t else t * u[f] + wide
            live = live[(x >= low - 1e-9) & (x <= high + 1e-9)]
        s = c[live] @ q[i]
        keep = (s >= floors[i] - loose) & (c_ids[live] != q_ids[i])
        yield (i, *best(c_ids[live][keep], exact(i, live[keep], s[keep]), k))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k best of all other vectors of its width."""
    c = written(quantised(vectors, scale), "topk-vectors")
    q = written(quantised(queries, scale), "topk-queries")
    width = F.size("v").alias("w")
    edges = c.groupBy(width).agg(F.percentile_approx("norm2", [i / BUCKETS for i in range(1, BUCKETS)], 10000).alias("e"), F.count("*").alias("n"))
    asked = {r.w: r.n for r in q.groupBy(width).agg(F.count("*").alias("n")).collect()}  # one row a width
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for r in edges.collect():
        if r.w in asked:
            of_width = F.size("v") == r.w
            found = found.unionByName(_top_k(c.where(of_width), q.where(of_width), r, asked[r.w], k))
    return found


def _top_k(c: DataFrame, q: DataFrame, edges, n_queries: int, k: int) -> DataFrame:
    """top_k of vectors that have one width; edges holds their norm quantiles e and their number n."""
    spark = c.sparkSession
    cuts = sorted(set(edges.e))
    blocks = max(1, -(-edges.n // (CANDIDATE_BLOCK * (len(cuts) + 1))))
    bucket = F.lit(0)
    for x in cuts:
        bucket = bucket + (F.col("norm2") > x).cast("int")
    c = c.withColumn("bucket", bucket).withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int"))
    longest = c
    if edges.n > 4 * SEEDS:  # a floor from the counts, so that no task sends SEEDS vectors of its own
        longest = c.where(F.col("norm2") >= c.agg(F.percentile_approx("norm2", 1 - 2 * SEEDS / edges.n, 10000)).first()[0])
    seeds = longest.orderBy(F.desc("norm2"), "vec_id").limit(SEEDS).toArrow()
    s_ids, s = seeds.column("vec_id").to_numpy(), _matrix(seeds.column("v"))
    shared = spark.sparkContext.broadcast((s_ids, s))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m = shared.value
        for batch in batches:
            out, own = [], batch.column("vec_id").to_numpy()
            for a in range(0, len(own), 256):
                q = _matrix(batch.column("v").slice(a, 256))
                scores = q.astype(float) @ m.T.astype(float)
                scores -= slack(q, m)
                scores[own[a : a + 256, None] == ids] = -np.inf
                out.append(np.partition(scores, -k, 1)[:, -k] if scores.shape[1] >= k else np.full(len(scores), -np.inf))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else np.zeros(0))], [*batch.schema.names, "floor"])

    q_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    q = q.mapInArrow(floors, "vec_id long, v array<long>, norm2 double, floor double")
    q = q.withColumn("q_block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(q_blocks)).cast("int"))
    q = written(q, "topk-floors")
    grid = c.select("bucket", "block").distinct()
    reaches = {r.bucket: r.longest for r in c.groupBy("bucket").agg(F.max("norm2").alias("longest")).collect()}  # at most BUCKETS rows
    # of each query block the least floor / |q|: a bucket whose longest vector is shorter is not met
    asks = q.groupBy("q_block").agg(F.min(F.when(F.col("floor") <= 0, F.lit(0.0)).otherwise(F.col("floor") * (1 - 1e-9) / F.sqrt(F.greatest(F.col("norm2"), F.lit(1.0))))).alias("least"))
    buckets = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(float(n) ** 0.5).alias("reach")) for b, n in sorted(reaches.items())]) if reaches else F.expr("CAST(array() AS array<struct<bucket:int,reach:double>>)")
    near = asks.select("q_block", "least", F.explode(buckets).alias("b")).where(F.col("b.reach") * (1 + 1e-9) >= F.col("least") - 1e-6)
    # pairs of blocks, about (queries / 1024) * (vectors / 4096) of them; the rows meet by key only
    pairs = written(near.select("q_block", "b.bucket").join(grid, "bucket").select("bucket", "block", "q_block"), "topk-pairs")
    one = F.lit(None)
    left = c.join(pairs, ["bucket", "block"]).select("bucket", "block", "q_block", F.lit(0).alias("side"), "vec_id", "v", one.cast("double").alias("floor"))
    right = q.join(pairs, "q_block").select("bucket", "block", "q_block", F.lit(1).alias("side"), "vec_id", "v", "floor")

    def search(key, table):
        side = table.column("side").to_numpy()
        ids, m, floor = table.column("vec_id").to_numpy(), _matrix(table.column("v")), table.column("floor").to_numpy()
        a, b = side == 1, side == 0
        found = [(np.full(len(i), ids[a][row]), i, s) for row, i, s in search_block(ids[a], m[a], floor[a], ids[b], m[b], k)]
        columns = [np.concatenate([y.astype(np.int64) for y in x]) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(x) for x in columns], ["query_id", "vec_id", "score"])

    hits = left.unionByName(right).groupBy("bucket", "block", "q_block").applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s)
WHERE r <= 20
"""
