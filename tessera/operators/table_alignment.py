"""Two sequences of tables aligned where tables run over pages, and the report of it.

A table that is cut at a page's end stands as several fragments, and the two documents are cut at
different places, so m tables of one may stand for n of the other. Continuations and runs come from windows.
The walk through a pair of documents is ordered and takes their shapes alone; pages, labels and
overflows are joined to its steps afterwards. A task walks through some document pairs at a time.

Tables: (pair..., table_idx, page_index from 0, y, h, page_height, columns, rows_per_column), table_idx
ascending through the document. Without rows (null or empty) a table continues nothing and fits only
another one without. Documents without tables on one side have all tables of the other MISSING or EXTRA.
"""

from __future__ import annotations

from itertools import accumulate
from math import inf

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import by_groups

# fixed values: shares of the page height, rows of a fragment at least, rows apart, tables looked ahead
BOTTOM, TOP, MIN_ROWS, TOLERANCE, AHEAD = 0.70, 0.30, 2, 1, 3
# fixed texts of the report
SPLIT = "Cross-page table split match (English {} page(s), Translated {} page(s))"
EXACT, NEAR, OTHER = "Exact structure match", "Structure match within tolerance", "Column/row structure does not match"
RESYNC_EXTRA, RESYNC_MISSING, REST_EXTRA = "Extra translated table (re-sync)", "No matching translated table (re-sync)", "Extra translated table"

STEPS = "step int, table_number int, status string, reason string, master_from long, master_n int, target_from long, target_n int, merged array<long>, repeated_header boolean"


def in_runs(tables: DataFrame, doc: list[str]) -> DataFrame:
    """tables with run (its number in the document) and place in the run from 0.

    A table continues the one before it if that is its page's last and ends at or below BOTTOM of it, this one is
    the first of the next page and begins at or above TOP, both are equally wide and have a column of MIN_ROWS rows.
    """
    order, page = Window.partitionBy(*doc).orderBy("table_idx"), Window.partitionBy(*doc, "page_index")
    before = lambda c: F.lag(c).over(order)
    t = tables.withColumns(
        {
            "__last": F.col("table_idx") == F.max("table_idx").over(page),
            "__first": F.col("table_idx") == F.min("table_idx").over(page),
            "__long": F.coalesce(F.array_max("rows_per_column") >= MIN_ROWS, F.lit(False)),
            "__low": (F.col("y") + F.col("h")) / F.col("page_height") >= BOTTOM,
            "__high": F.col("y") / F.col("page_height") <= TOP,
        }
    )
    on = (before("page_index") == F.col("page_index") - 1) & (before("columns") == F.col("columns")) & before("__low") & F.col("__high") & before("__last") & F.col("__first") & before("__long") & F.col("__long")
    t = t.withColumn("run", F.sum(F.when(F.coalesce(on, F.lit(False)), 0).otherwise(1)).over(order))
    t = t.withColumn("place", (F.row_number().over(Window.partitionBy(*doc, "run").orderBy("table_idx")) - 1).cast("int"))
    return t.drop("__last", "__first", "__long", "__low", "__high")


def continued(tables: DataFrame, doc: list[str]) -> DataFrame:
    """tables as from `in_runs`, with upto, the sums of rows per column along the run."""
    t = in_runs(tables, doc)
    cells = t.select(*doc, "run", "table_idx", F.posexplode("rows_per_column").alias("c", "n"))
    sums = cells.withColumn("n", F.sum(F.col("n").cast("long")).over(Window.partitionBy(*doc, "run", "c").orderBy("table_idx")))
    upto = sums.groupBy(*doc, "table_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "n"))), lambda x: x["n"]).alias("upto"))
    return t.join(upto, [*doc, "table_idx"], "left")


def merged_runs(runs: DataFrame, doc: list[str]) -> DataFrame:
    """Runs of two fragments or more as whole tables: fragments, first_page, last_page, columns, rows_plain and, where
    every fragment repeats the header, rows_header. runs: as from `continued`."""
    last = F.max(F.struct("place", "upto", "page_index", "columns"))
    whole = runs.groupBy(*doc, "run").agg(F.count("*").alias("fragments"), F.min("page_index").alias("first_page"), last.alias("last")).where("fragments > 1")
    return whole.select(*doc, "run", "fragments", "first_page", F.col("last.page_index").alias("last_page"), F.col("last.columns").alias("columns"), F.col("last.upto").alias("rows_plain"), F.transform("last.upto", lambda x: x - F.col("fragments") + 1).alias("rows_header"))


class _Side:
    """One document's tables as lists."""

    def __init__(self, columns: list, place: list[int], rows: list[list[int]]):
        self.columns, self.rows = columns, rows
        # fragments of the run that are left from each table on
        self.left = [1] * len(rows)
        for i in range(len(rows) - 2, -1, -1):
            if place[i + 1]:
                self.left[i] = self.left[i + 1] + 1

    def __len__(self) -> int:
        return len(self.rows)

    def sums(self, i: int) -> list[list[int]]:
        """Rows of 1, 2, ... fragments from table i on."""
        return list(accumulate(self.rows[i : i + self.left[i]], lambda a, b: [x + y for x, y in zip(a, b)]))


def _far(a: list[int], b: list[int]) -> int:
    return max((abs(x - y) for x, y in zip(a, b)), default=0)


def _apart(m: _Side, i: int, t: _Side, j: int) -> float:
    """How many rows a column differs by at most; infinite where the widths differ."""
    a, b = m.rows[i], t.rows[j]
    if m.columns[i] != t.columns[j] or len(a) != len(b):
        return inf
    return _far(a, b)


def _split(m: _Side, i: int, t: _Side, j: int) -> tuple[int, int, list[int], bool] | None:
    """Most fragments of the master, then of the target, whose rows agree; with headers that repeat before those that don't."""
    if m.left[i] == t.left[j] == 1 or m.columns[i] != t.columns[j] or len(m.rows[i]) != len(t.rows[j]):
        return None
    forms = lambda sums: [([x - k for x in r], r) for k, r in enumerate(sums)]
    a, b = forms(m.sums(i)), forms(t.sums(j))
    for x in range(len(a), 0, -1):
        for y in range(len(b), 1 if x == 1 else 0, -1):
            for h, one in enumerate(a[x - 1]):
                for g, other in enumerate(b[y - 1]):
                    if _far(one, other) <= TOLERANCE:
                        return x, y, one, (h if x > 1 else g) == 0
    return None


def _walk(m: _Side, t: _Side) -> list[tuple]:
    """Steps (table_number, status, reason, master, m, target, n, merged, repeated_header), places within the sequences."""
    out: list[tuple] = []
    i = j = 0
    near = lambda a, b: a < len(m) and b < len(t) and _apart(m, a, t, b) <= TOLERANCE

    def extra(reason: str) -> None:
        nonlocal j
        out.append((len(out) + 1, "EXTRA", reason, None, 0, j, 1, None, False))
        j += 1

    def step(status: str, reason: str, k: int = 1, n: int = 1, merged: list[int] | None = None, header: bool = False) -> None:
        nonlocal i, j
        out.append((i + 1, status, reason, i, k, j if n else None, n, merged, header))
        i, j = i + k, j + n

    while i < len(m):
        if j >= len(t):
            step("MISSING", "", n=0)
        elif found := _split(m, i, t, j):
            k, n, merged, header = found
            step("PASS", SPLIT.format(k, n), k, n, merged, header)
        elif near(i, j):
            step("PASS", NEAR if _apart(m, i, t, j) else EXACT)
        elif skip := next((n for n in range(1, AHEAD + 1) if near(i, j + n)), 0):
            for _ in range(skip):
                extra(RESYNC_EXTRA)
        elif skip := next((n for n in range(1, AHEAD + 1) if near(i + n, j)), 0):
            for _ in range(skip):
                step("MISSING", RESYNC_MISSING, n=0)
        else:
            step("DIFFERENT", OTHER)
    while j < len(t):
        extra(REST_EXTRA)
    return out


def aligned(master: DataFrame, target: DataFrame, pair: list[str]) -> DataFrame:
    """The steps of each document pair: (pair, STEPS); from and n name the tables of a step by table_idx and count."""
    names = [s.split()[0] for s in STEPS.split(", ")]

    def run(rows: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        ends = np.append(first[1:], len(rows))
        cuts = first + np.add.reduceat(rows["side"].to_numpy() == 0, first)
        idx, columns, place = rows["table_idx"].tolist(), rows["columns"].tolist(), rows["place"].tolist()
        cells = [[] if r is None else r.tolist() for r in rows["rows_per_column"]]
        part = lambda a, b: _Side(columns[a:b], place[a:b], cells[a:b])
        out, group = [], []
        for n, (a, c, b) in enumerate(zip(first.tolist(), cuts.tolist(), ends.tolist())):
            steps = _walk(part(a, c), part(c, b))
            out += [(s, no, status, reason, None if i is None else idx[a + i], k, None if j is None else idx[c + j], m, merged, header) for s, (no, status, reason, i, k, j, m, merged, header) in enumerate(steps)]
            group += [first[n]] * len(steps)
        found = pd.DataFrame(out, columns=names).astype({"master_from": "Int64", "target_from": "Int64"})
        return pd.concat([rows[pair].iloc[group].reset_index(drop=True), found], axis=1)

    shape = lambda df, side: in_runs(df, pair).select(*pair, F.lit(side).alias("side"), "table_idx", "columns", "place", "rows_per_column")
    kinds = [f"{c} {master.schema[c].dataType.simpleString()}" for c in pair]
    return by_groups(shape(master, 0).union(shape(target, 1)), pair, ["side", "table_idx"], run, ", ".join([*kinds, STEPS]))


def _side_facts(steps: DataFrame, tables: DataFrame, labels: DataFrame | None, pair: list[str], side: str, name: str) -> DataFrame:
    """(pair, step) with the pages of one side's fragments as they are numbered and printed, and their overflow reasons."""
    order = Window.partitionBy(*pair).orderBy("table_idx")
    placed = tables.withColumn("place", F.row_number().over(order))
    parts = steps.where(F.col(f"{side}_from").isNotNull()).select(*pair, "step", F.col(f"{side}_from").alias("table_idx"), F.col(f"{side}_n").alias("n"))
    first = parts.join(placed.select(*pair, "table_idx", "place"), [*pair, "table_idx"]).select(*pair, "step", F.explode(F.expr("sequence(place, place + n - 1)")).alias("place"))
    facts = first.join(placed.select(*pair, "place", "page_index", "overflow_reasons"), [*pair, "place"])
    if labels is None:
        facts = facts.withColumn("label", F.lit(None).cast("string"))
    else:
        facts = facts.join(labels.select(*pair, "page_index", "label"), [*pair, "page_index"], "left")
    facts = facts.withColumn("label", F.coalesce("label", (F.col("page_index") + 1).cast("string")))
    span = facts.groupBy(*pair, "step").agg(F.min(F.struct("place", "page_index", "label")).alias("a"), F.max(F.struct("place", "page_index", "label")).alias("b"), F.flatten(F.collect_list("overflow_reasons")).alias("reasons"))
    page = lambda c: F.concat(F.lit("P"), (F.col(c) + 1).cast("string"))
    both = lambda a, b: F.concat(F.lit(f"{name} "), F.when(a == b, a).otherwise(F.concat_ws("-", a, b)))
    return span.select(*pair, "step", both(page("a.page_index"), page("b.page_index")).alias(f"{side}_pages"), both(F.col("a.label"), F.col("b.label")).alias(f"{side}_labels"), F.col("reasons").alias(f"{side}_reasons"))


def display_status(status: Column, overflow: Column) -> Column:
    return F.when(overflow, F.concat(status, F.lit(" (Review Overflow)"))).when(status == "PASS", "PASS (OK)").otherwise(F.concat(status, F.lit(" (Review Structure)")))


def row_colour(status: Column, overflow: Column) -> Column:
    return F.when(overflow, "amber").when(status == "PASS", "green").otherwise("red")


def report(steps: DataFrame, master: DataFrame, target: DataFrame, pair: list[str], master_labels: DataFrame | None = None, target_labels: DataFrame | None = None) -> DataFrame:
    """The steps as report rows: page ranges by sequence and by printed label of both sides, and overflow reasons.

    master, target: tables that also have overflow_reasons (array of strings, null or empty where the text fits);
    labels: (pair, page_index, label) of pages whose printed label is known.
    """
    found = steps
    for side, tables, labels, name in (("master", master, master_labels, "Eng"), ("target", target, target_labels, "Trans")):
        found = found.join(_side_facts(steps, tables, labels, pair, side, name), [*pair, "step"], "left")
    reasons = F.array_sort(F.array_distinct(F.concat(*(F.coalesce(f"{s}_reasons", F.array().cast("array<string>")) for s in ("master", "target")))))
    found = found.withColumn("overflow_reasons", reasons)
    overflow = F.size("overflow_reasons") > 0
    return found.select(
        *steps.columns,
        F.concat_ws(" | ", "master_pages", "target_pages").alias("sequence_page_number"),
        F.concat_ws(" | ", "master_labels", "target_labels").alias("labeled_page_number"),
        overflow.alias("has_text_overflow"),
        F.concat_ws("; ", "overflow_reasons").alias("overflow_reasons"),
        display_status(F.col("status"), overflow).alias("display_status"),
        row_colour(F.col("status"), overflow).alias("colour"),
    )
