"""Similarity of crops that were placed at different sizes.

Crops meet by group and by a band of their aspect: bands are one tolerance wide, so crops within the tolerance lie in
the same or in neighbouring bands and no crop meets those of other shapes. The second crop of a pair is resampled by
area onto the first one's size, one matrix for its rows and one for its columns; both are blurred a little, and their
correlation is the score. Pixels are taken in Arrow batches.

Crops: (by..., key, width, height, pixels), pixels row by row, 0 black to 255 white. Crops without pixels, with null ones, with fewer
than their sizes say or with a side under LEAST score with nothing. Constant crops are alike if their greys are.
Enlarging weighs by area as well, so each new pixel lies within one or two old ones a side.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the aspects' ratio, the least side in pixels
ASPECT, LEAST = 1.35, 4


@lru_cache(maxsize=4096)
def weights(old: int, new: int) -> np.ndarray:
    """Row i: the shares of the old pixels in the new pixel i."""
    edge = np.arange(new + 1) * old / new
    at = np.arange(old)
    part = np.minimum(edge[1:, None], at + 1) - np.maximum(edge[:-1, None], at)
    return np.maximum(part, 0) * new / old


@lru_cache(maxsize=4096)
def blur(n: int) -> np.ndarray:
    """Weights 1, 2, 1 along n pixels, mirrored about the first and the last."""
    out = np.zeros((n, n))
    for d, w in ((-1, 0.25), (0, 0.5), (1, 0.25)):
        i = np.abs(np.arange(n) + d)
        np.add.at(out, (np.arange(n), np.where(i >= n, 2 * n - 2 - i, i)), w)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Correlation of two crops, the second scaled onto the first."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    (h, w), (bh, bw) = a.shape, b.shape
    b = weights(bh, h) @ b @ weights(bw, w).T
    a, b = (blur(h) @ x @ blur(w).T for x in (a, b))
    if a.std() < 1e-6 or b.std() < 1e-6:
        return 1.0 if abs(a.mean() - b.mean()) < 1.0 else 0.0
    a, b = a - a.mean(), b - b.mean()
    return float((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()))


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p, pw, ph, q, qw, qh, other columns) to the other columns with score."""
    for batch in batches:
        p, pw, ph, q, qw, qh = (batch.column(i) for i in range(6))
        size = [c.to_pylist() for c in (pw, ph, qw, qh)]
        found = [likeness(p[i].values.to_numpy(zero_copy_only=False).reshape(h, w), q[i].values.to_numpy(zero_copy_only=False).reshape(bh, bw)) for i, (w, h, bw, bh) in enumerate(zip(*size))]
        yield pa.RecordBatch.from_arrays([*batch.columns[6:], pa.array(found, pa.float64())], [*batch.schema.names[6:], "score"])


def sized_pairs(master: DataFrame, target: DataFrame, by: list[str], key: str, target_key: str | None = None) -> DataFrame:
    """(by, m, t, score) of the pairs of a group whose aspects differ by at most ASPECT."""
    aspect = F.col("width") / F.col("height")
    band = F.floor(F.log(aspect) / np.log(ASPECT)).cast("int")

    def side(df: DataFrame, key: str, name: str, pixels: str) -> DataFrame:
        fit = df.where((F.col("width") >= LEAST) & (F.col("height") >= LEAST) & (F.size("pixels") == F.col("width") * F.col("height")) & ~F.exists("pixels", F.isnull))
        return fit.select(*by, F.col(key).alias(name), F.col("pixels").cast("array<double>").alias(pixels), F.col("width").alias(f"{pixels}w"), F.col("height").alias(f"{pixels}h"), aspect.alias(f"{pixels}a"), band.alias("band"))

    m = side(master, key, "m", "p")
    t = side(target, target_key or key, "t", "q").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    met = m.join(t, [*by, "band"]).where(F.greatest("pa", "qa") / F.least("pa", "qa") <= ASPECT)
    rows = met.select("p", "pw", "ph", "q", "qw", "qh", *by, "m", "t")
    kinds = dict(rows.dtypes)
    done = rows.mapInArrow(_scores, ", ".join([*(f"{c} {kinds[c]}" for c in (*by, "m", "t")), "score double"]))
    return done.withColumn("score", F.bround("score", 6))
