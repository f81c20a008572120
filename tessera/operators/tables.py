"""Table shapes compared: predicates in SQL, order-dependent alignment of some document pairs at a time in pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import by_groups

BOTTOM, TOP, AHEAD, TOLERANCE = 0.70, 0.30, 3, 1


def same_shape(a: Column, b: Column) -> Column:
    """Equal rows per column (and so equal column counts)."""
    return a == b


def similar_shape(a: Column, b: Column, tolerance: int = TOLERANCE) -> Column:
    """Equal column counts, each column's rows at most `tolerance` apart."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance), lambda ok: F.coalesce(ok, F.lit(False)))


def merged_shape(a: Column, b: Column, repeated_header: bool) -> Column:
    """Rows of a table that b continues; a repeated header row counts once."""
    return F.zip_with(a, b, lambda x, y: x + y - (1 if repeated_header else 0))


def page_position(y: Column, h: Column, page_height: Column) -> Column:
    """bottom if the table ends at or below 70 % of its page, top if it starts at or above 30 %."""
    return F.when((y + h) / page_height >= BOTTOM, "bottom").when(y / page_height <= TOP, "top").otherwise("middle")


def chains(tables: DataFrame, doc: list[str]) -> DataFrame:
    """tables with `chain`: consecutive tables of equal width of which one ends at the bottom of its
    page and the next one starts at the top of the next page.

    tables(doc, page_index, table_idx, y, h, page_height, columns).
    """
    w = Window.partitionBy(*doc).orderBy("page_index", "table_idx")
    before = lambda c: F.lag(c).over(w)
    ends = (F.col("y") + F.col("h")) / F.col("page_height") >= BOTTOM
    t = tables.withColumn("__ends", ends)
    goes_on = (before("page_index") == F.col("page_index") - 1) & before("__ends") & (F.col("y") / F.col("page_height") <= TOP) & (before("columns") == F.col("columns"))
    new = F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)
    return t.withColumn("chain", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__ends")


def align(master: list[tuple[int, ...]], target: list[tuple[int, ...]]) -> list[tuple[int | None, int | None, str]]:
    """Walks two table lists in order: (master index, target index, status).

    Equal or tolerably equal shapes pass. Else, if within three tables ahead the target has the
    master's shape, the target tables up to it are EXTRA; if the master has the target's, those are
    MISSING; else the two are DIFFERENT. What is left over is MISSING or EXTRA.
    """
    fits = lambda a, b: len(a) == len(b) and all(abs(x - y) <= TOLERANCE for x, y in zip(a, b))
    out: list[tuple[int | None, int | None, str]] = []
    i = j = 0
    while i < len(master):
        if j >= len(target):
            out.append((i, None, "MISSING"))
            i += 1
            continue
        if fits(master[i], target[j]):
            out.append((i, j, "PASS"))
            i, j = i + 1, j + 1
            continue
        skip = next((n for n in range(1, AHEAD + 1) if j + n < len(target) and fits(master[i], target[j + n])), 0)
        if skip:
            out += [(None, j + n, "EXTRA") for n in range(skip)]
            j += skip
            continue
        skip = next((n for n in range(1, AHEAD + 1) if i + n < len(master) and fits(master[i + n], target[j])), 0)
        if skip:
            out += [(i + n, None, "MISSING") for n in range(skip)]
            i += skip
            continue
        out.append((i, j, "DIFFERENT"))
        i, j = i + 1, j + 1
    return out + [(None, n, "EXTRA") for n in range(j, len(target))]


def compared(master: DataFrame, target: DataFrame, pair: list[str]) -> DataFrame:
    """Aligned tables of each document pair: (pair, step, master_idx, target_idx, status)."""
    schema = ", ".join([f"{c} {master.schema[c].dataType.simpleString()}" for c in pair] + ["step int", "master_idx long", "target_idx long", "status string"])

    def run(rows: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        ends = np.append(first[1:], len(rows))
        cuts = first + np.add.reduceat(rows["side"].to_numpy() == 0, first)
        idx, shapes = rows["table_idx"].tolist(), [tuple(r.tolist()) for r in rows["rows_per_column"]]
        out, group = [], []
        for n, (a, c, b) in enumerate(zip(first.tolist(), cuts.tolist(), ends.tolist())):
            steps = align(shapes[a:c], shapes[c:b])
            out += [(k, None if i is None else idx[a + i], None if j is None else idx[c + j], status) for k, (i, j, status) in enumerate(steps)]
            group += [first[n]] * len(steps)
        found = pd.DataFrame(out, columns=["step", "master_idx", "target_idx", "status"]).astype({"master_idx": "Int64", "target_idx": "Int64"})
        return pd.concat([rows[pair].iloc[group].reset_index(drop=True), found], axis=1)

    side = lambda df, n: df.select(*pair, F.lit(n).alias("side"), "table_idx", "rows_per_column")
    return by_groups(side(master, 0).unionByName(side(target, 1)), pair, ["side", "table_idx"], run, schema)


def totals(rows: DataFrame, pair: list[str]) -> DataFrame:
    """PASS, DIFFERENT, MISSING and EXTRA counts of each pair."""
    return rows.groupBy(*pair).agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PASS", "DIFFERENT", "MISSING", "EXTRA")])
