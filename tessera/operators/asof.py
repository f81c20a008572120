"""As-of and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_last(left: DataFrame, right: DataFrame, by: list[str], left_key: Column, right_key: Column, values: list[str]) -> DataFrame:
    """left with, from the last right row of the same group at or before left_key, its values (else null).

    One sort by group and key instead of a pair of rows for each match; right rows come before left
    rows at equal keys, and of equal right rows the greatest values win.
    """
    own = F.struct(*[F.col(c) for c in left.columns if c not in by])
    found = F.struct(*[F.col(c) for c in values])
    lhs = left.select(*by, left_key.alias("__key"), F.lit(1).alias("__side"), own.alias("__own"), F.lit(None).cast(right.select(found.alias("x")).schema["x"].dataType).alias("__found"))
    rhs = right.select(*by, right_key.alias("__key"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(own.alias("x")).schema["x"].dataType).alias("__own"), found.alias("__found"))
    w = Window.partitionBy(*by).orderBy("__key", "__side", "__found").rowsBetween(Window.unboundedPreceding, 0)
    done = lhs.unionByName(rhs).withColumn("__last", F.last("__found", ignorenulls=True).over(w)).where("__side = 1")
    return done.select(*by, "__own.*", *[F.col(f"__last.{c}").alias(c) for c in values])


def range_top(left: DataFrame, spans: DataFrame, by: list[str], point: str, lo: str, hi: str, order: list[Column], key: list[str]) -> DataFrame:
    """left with the first (by order) span of its group that holds the point; unmatched rows keep nulls."""
    hit = left.join(spans, [*by, ], "left").where(F.col(lo).isNull() | F.col(point).between(F.col(lo), F.col(hi)))
    w = Window.partitionBy(*by, *key).orderBy(*order)
    best = hit.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    extra = [c for c in spans.columns if c not in by]
    return left.join(best.select(*by, *key, *extra), [*by, *key], "left")
