"""Filter interaction audit: what each filter removes in every order in which the filters can be applied.

Every filter has a table of the ids that fail it. A prefix of an order is the set of the filters
before: its survivors are the ids left by left-anti joins with those tables, and what the next
filter removes is a left-semi join of the survivors with its own table. The joins run over ids
alone, and only over ids that fail something; counts are combined before they are shuffled.

The five filters of `failing_tables`: A under 200 words, B under half of the words distinct, C over
2 % capitals, D a sign among #$%&*|, E a text that a smaller doc_id has as well, table-wide. Words
are runs without ASCII white space, in their case.

Null texts count as empty, a null source is the part ''. A null doc_id is smaller than none: such a
row fails E never and makes no other fail it, and it has no labels. Repeated rows count one by one;
they don't fail E by each other, as neither id is the smaller. A document with several label rows is
good (toxic) if any of them says so; null labels say nothing. Texts are read whole whatever their
length. An empty table has no parts and gives no rows. Extra columns are passed by.
"""

from __future__ import annotations

import uuid
from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shared_dir, table, written

MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2
BLANKS, SIGNS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
MAX_FILTERS = 6


def failing_tables(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Ids (uid, part, good, toxic) of all rows of docs, and for each of the filters A to E its failing ids (uid).

    uid numbers the rows; it is fixed once the ids are written. Texts are read once and never shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), F.array_remove(F.split(text, BLANKS), "").alias("words"))
    n, chars = F.size("words"), F.length("text")
    fails = {
        "A": n < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct("words")) < MIN_DISTINCT * n,
        "C": 100 * (chars - F.length(F.regexp_replace("text", "[A-Z]", ""))) > MAX_CAPITALS * chars,
        "D": F.col("text").rlike(SIGNS),
    }
    # 128 bits of the text stand for it
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "part", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), *(c.alias(f) for f, c in fails.items()))
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    ids = written(rows.join(said.hint("shuffle_hash"), "doc_id", "left").select(*rows.columns, *flags), "audit-ids")
    least = ids.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    # from a table, so that a text of very many rows is split between tasks
    least = written(least.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "least"), "audit-copies")
    copies = ids.join(least.hint("shuffle_hash"), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("doc_id") > F.col("least")), "left_semi")
    own = ids.select("uid", F.explode(F.filter(F.array(*(F.when(F.col(f), f) for f in fails)), lambda x: x.isNotNull())).alias("filter"))
    folder = f"{shared_dir(docs.sparkSession)}/tessera/audit-fails-{uuid.uuid4().hex}"
    own.union(copies.select("uid", F.lit("E"))).write.partitionBy("filter").parquet(folder)
    # one folder a filter; a filter that nothing fails has none
    stored = docs.sparkSession.read.schema("uid long, filter string").parquet(folder)
    return ids.select("uid", "part", "good", "toxic"), {f: stored.where(F.col("filter") == f).select("uid") for f in "ABCDE"}


def removals(ids: DataFrame, fails: dict[str, DataFrame]) -> DataFrame:
    """Per part, prefix and filter with a removal: part, cell, removed, good_lost, toxic_lost.

    A prefix is a set of filters, as bits in the order of their names; cell is prefix * n + the filter's place.
    All tables are dealt by uid once; each id is then taken for every prefix, within its task.
    """
    names, found = sorted(fails), None
    for f in names:
        found = fails[f] if found is None else found.union(fails[f])
    failing = written(ids.join(found.hint("shuffle_hash"), "uid", "left_semi"), "audit-failing")
    left = failing.repartition("uid").withColumn("prefix", F.explode(F.sequence(F.lit(0), F.lit(2 ** len(names) - 1))))
    for i, f in enumerate(names):
        own = fails[f].withColumnRenamed("uid", "failed").hint("shuffle_hash")
        left = left.join(own, (F.col("uid") == F.col("failed")) & (F.col("prefix").bitwiseAND(1 << i) > 0), "left_anti")
    gone = None
    for i, f in enumerate(names):
        rows = left.where(F.col("prefix").bitwiseAND(1 << i) == 0).join(fails[f].hint("shuffle_hash"), "uid", "left_semi")
        rows = rows.select("part", (F.col("prefix") * len(names) + i).alias("cell"), "good", "toxic")
        gone = rows if gone is None else gone.union(rows)
    return gone.groupBy("part", "cell").agg(F.count("*").alias("removed"), F.count_if("good").alias("good_lost"), F.count_if("toxic").alias("toxic_lost"))


def audit(ids: DataFrame, fails: dict[str, DataFrame]) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ids: (uid, part, good, toxic) with distinct uids; fails: the failing uids of each filter, of one-letter
    names, 2 to MAX_FILTERS of them. Rows grow with the parts only: n! * n for each.
    """
    names = sorted(fails)
    if not 2 <= len(names) <= MAX_FILTERS or any(len(f) != 1 for f in names):
        raise ValueError(f"filters: 2 to {MAX_FILTERS} names of one letter")
    counts = removals(ids, fails)
    n = len(names)
    at = lambda before, i: sum(1 << j for j in before) * n + i
    # what the steps look up, and how many orders put just these filters before one: fixed tables of n! * n and 2^n entries
    steps = []
    for order in permutations(range(n)):
        path = [at(order[:k], i) for k, i in enumerate(order)]
        steps += [(len(steps) + k, "".join(names[j] for j in order), k + 1, names[i], path[: k + 1]) for k, i in enumerate(order)]
    weights = {i: {at(b, i): factorial(k) * factorial(n - 1 - k) for k in range(n) for b in combinations(sorted({*range(n)} - {i}), k)} for i in range(n)}
    spark = ids.sparkSession
    steps_of = spark.createDataFrame(steps, "no int, filter_order string, step int, filter string, path array<int>")
    cell = lambda k, field: F.coalesce(F.col("cells")[k][field], F.lit(0))
    total = lambda ks, value: F.aggregate(ks, F.lit(0).cast("long"), lambda x, k: x + value(k))

    def by_filter(value) -> Column:
        return F.create_map(*(x for i, f in enumerate(names) for x in (F.lit(f), value(i))))

    shapley = by_filter(lambda i: sum((cell(F.lit(c), "removed") * w for c, w in weights[i].items()), F.lit(0).cast("long")))
    alone = by_filter(lambda i: cell(F.lit(at({*range(n)} - {i}, i)), "removed"))
    failed = by_filter(lambda i: cell(F.lit(at((), i)), "removed"))
    wide = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("cell", F.struct("removed", "good_lost", "toxic_lost")))).alias("cells"))
    parts = ids.groupBy("part").agg(F.count("*").alias("rows")).join(wide, "part", "left")
    parts = parts.select("part", "rows", "cells", shapley.alias("shapley"), alone.alias("alone"), failed.alias("failed"), F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))).alias("no"))
    here = F.element_at("path", -1)
    return parts.join(F.broadcast(steps_of), "no").select(
        "part",
        "filter_order",
        "step",
        (F.col("rows") - total("path", lambda k: cell(k, "removed"))).alias("kept"),
        cell(here, "removed").alias("removed"),
        (F.col("failed")[F.col("filter")] - cell(here, "removed")).alias("redundant"),
        F.col("alone")[F.col("filter")].alias("unique_fails"),
        cell(here, "good_lost").alias("good_lost"),
        cell(here, "toxic_lost").alias("toxic_lost"),
        F.col("shapley")[F.col("filter")].alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(*failing_tables(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP11_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS s, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
said AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
rows AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * (length(s) - length(regexp_replace(s, '[A-Z]', '', 'g'))) > 2 * length(s) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(s, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY s), false) THEN 16 ELSE 0 END) AS mask
  FROM texts LEFT JOIN said USING (doc_id)),
hist AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM rows GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)),
orders AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31),
steps AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS before FROM orders, range(1, 6) r(step)),
counted AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS toxic_lost
  FROM hist, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""
