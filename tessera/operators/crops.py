"""Crops compared by content: similarity within a topic, search, one-to-one pairing, scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MATCH, FOUND = 0.80, 0.55
EXACT_SIDE = 8


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r of two equally long pixel arrays; constant arrays: 1 if both are equal, else 0."""
    n = F.size(a)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    # what a function over one value is given is worked out once, not for each pixel
    once = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)
    centred = lambda x: once(total(x) / n, lambda m: F.struct(m.alias("mean"), F.transform(x, lambda v: v - m).alias("off")))
    power = lambda x, y: total(F.zip_with(x, y, lambda v, w: v * w))

    def sums(s: Column) -> Column:
        x, y = s["x"]["off"], s["y"]["off"]
        return F.struct(power(x, y).alias("cross"), power(x, x).alias("va"), power(y, y).alias("vb"), F.abs(s["x"]["mean"] - s["y"]["mean"]).alias("apart"))

    def score(s: Column) -> Column:
        flat = (s["va"] < 1e-12) | (s["vb"] < 1e-12)
        return F.when(flat, F.when((s["va"] < 1e-12) & (s["vb"] < 1e-12) & (s["apart"] < 1e-9), 1.0).otherwise(0.0)).otherwise(s["cross"] / F.sqrt(s["va"] * s["vb"]))

    return once(once(F.struct(centred(a).alias("x"), centred(b).alias("y")), sums), score)


def scored_pairs(master: DataFrame, target: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by, m, t, score) for the crops of a group; they meet by the group's key only."""
    m = master.select(*by, F.col(key).alias("m"), F.col("pixels").alias("p"))
    t = target.select(*by, F.col(key).alias("t"), F.col("pixels").alias("q"))
    met = m.join(t, by).where(F.size("p") == F.size("q"))
    return met.select(*by, "m", "t", F.bround(correlation(F.col("p"), F.col("q")), 6).alias("score"))


def shortlisted(scores: DataFrame, key: list[str], best: int = 3, within: float = 0.12) -> DataFrame:
    """The best three candidates of each key and all within 0.12 of the best."""
    w = Window.partitionBy(*key)
    s = scores.withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "t"))).withColumn("top", F.max("score").over(w))
    return s.where((F.col("place") <= best) | (F.col("score") >= F.bround(F.col("top") - within, 6))).drop("top")


def assignment(cost: np.ndarray) -> np.ndarray:
    """The column of each row in an assignment of the least total cost (rows at most columns).

    Rows enter one by one by a shortest augmenting path under potentials that keep reduced costs
    non-negative.
    """
    n, m = cost.shape
    row_price, column_price, row_of = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        reach, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, last = row, -1
        while True:
            step = cost[at] - row_price[at] - column_price + (reach[last] if last >= 0 else 0.0)
            nearer = ~done & (step < reach)
            reach[nearer], via[nearer] = step[nearer], last
            last = int(np.where(done, np.inf, reach).argmin())
            done[last] = True
            if row_of[last] < 0:
                break
            at = row_of[last]
        end = reach[last]
        held = np.flatnonzero(done & (row_of >= 0))
        row_price[row_of[held]] += end - reach[held]
        row_price[row] += end
        column_price[done] -= end - reach[done]
        while last >= 0:
            row_of[last] = row_of[via[last]] if via[last] >= 0 else row
            last = via[last]
    out = np.full(n, -1)
    out[row_of[row_of >= 0]] = np.flatnonzero(row_of >= 0)
    return out


def best_pairing(scores: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of a score table, one to one.

    Up to EXACT_SIDE a side they have the greatest total; of several such pairings, the one that
    gives the first row of the shorter side the first possible partner, then the next row, and so on.
    Beyond that, pairs that are each other's best leave the table until it is empty.
    """
    rows, columns = scores.shape
    if not rows or not columns:
        return []
    if max(rows, columns) <= EXACT_SIDE:
        turned = rows > columns
        cost = -(scores.T if turned else scores).astype(float)
        total = lambda c: float(c[np.arange(len(c)), assignment(c)].sum()) if len(c) else 0.0
        free, found = list(range(cost.shape[1])), []
        for i in range(len(cost)):
            goal = total(cost[i:, free])
            j = next(j for j in free if cost[i, j] + total(cost[i + 1 :, [x for x in free if x != j]]) <= goal + 1e-9)
            free.remove(j)
            found.append((j, i) if turned else (i, j))
        return sorted(found)
    left, found = scores.astype(float).copy(), []
    while np.isfinite(left).any():
        of_row, of_column = left.argmax(1), left.argmax(0)
        for i in np.flatnonzero(np.isfinite(left).any(1) & (of_column[of_row] == np.arange(rows))):
            found.append((int(i), int(of_row[i])))
        for i, j in found:
            left[i, :] = left[:, j] = -np.inf
    return sorted(found)


def paired(scores: DataFrame, by: list[str]) -> DataFrame:
    """One-to-one pairing of each group's score table: (by, m, t, score), once for each pair."""
    schema = scores.select(*by, "m", "t", "score").schema

    def pair(group: pd.DataFrame) -> pd.DataFrame:
        ms, ts = sorted(group["m"].unique()), sorted(group["t"].unique())
        table = group.pivot_table(index="m", columns="t", values="score", aggfunc="max", fill_value=-1.0).loc[ms, ts].to_numpy()
        rows = [(ms[i], ts[j], float(table[i, j])) for i, j in best_pairing(table)]
        out = pd.DataFrame(rows, columns=["m", "t", "score"])
        for c in reversed(by):
            out.insert(0, c, group[c].iloc[0])
        return out

    return scores.select(*by, "m", "t", "score").groupBy(*by).applyInPandas(pair, schema)


def crop_status(master: DataFrame, target: DataFrame, pairs: DataFrame, by: list[str], key: str) -> DataFrame:
    """Each crop's result: MATCH (PASS) from 0.80, CHECK from 0.55, else and without a partner
    EXTRA IN MASTER or EXTRA IN TRANSLATION."""
    kept = pairs.where(F.col("score") >= FOUND)
    status = F.when(F.col("score") >= MATCH, "MATCH (PASS)").otherwise("CHECK")
    ms = master.select(*by, F.col(key).alias("m")).join(kept, [*by, "m"], "left").select(*by, "m", "t", "score", F.when(F.col("t").isNull(), "EXTRA IN MASTER").otherwise(status).alias("status"))
    ts = target.select(*by, F.col(key).alias("t")).join(kept.select(*by, "t"), [*by, "t"], "left_anti").select(*by, F.lit(None).cast("long").alias("m"), "t", F.lit(None).cast("double").alias("score"), F.lit("EXTRA IN TRANSLATION").alias("status"))
    return ms.unionByName(ts)


def set_score(rows: DataFrame, by: list[str]) -> DataFrame:
    """Matched over checked plus extras in percent; PASS from 80 without extras, else CHECK."""
    extra = F.col("status").startswith("EXTRA")
    s = rows.groupBy(*by).agg(F.count_if(F.col("status") == "MATCH (PASS)").alias("matched"), F.count("*").alias("checked"), F.count_if(extra).alias("extras"))
    pct = F.bround(100.0 * F.col("matched") / F.col("checked"), 1)
    return s.withColumn("score_pct", pct).withColumn("overall", F.when((pct >= 80) & (F.col("extras") == 0), "PASS").otherwise("CHECK"))
