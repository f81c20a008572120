"""Internal links of two documents aligned in order.

Tokens, shared destinations, gaps and quotas are joins and windows; only the matching blocks of one
document pair's token sequences are Python (the standard library's).
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import destination, number_prefix, section_prefix
from tessera.operators.components import by_groups


def tokens(links: DataFrame, pair: list[str]) -> DataFrame:
    """links(pair, side 0/1, seq, text, url, topic) with dest, number, is_shared and token.

    A destination that both sides have stands for the link; else its text's leading number does;
    the section (two levels of its topic) belongs to both.
    """
    t = links.withColumn("dest", destination(F.trim("url"))).withColumn("number", number_prefix(F.col("text")))
    names = t.where("dest <> ''").groupBy(*pair, "dest").agg(F.count_distinct("side").alias("sides")).where("sides = 2").select(*pair, "dest", F.lit(True).alias("is_shared"))
    t = t.join(names, [*pair, "dest"], "left").withColumn("is_shared", F.coalesce("is_shared", F.lit(False)))
    section = F.coalesce(section_prefix(F.col("topic")), F.lit(""))
    token = F.when(F.col("is_shared"), F.concat_ws("\x1f", F.lit("N"), "dest", section)).otherwise(F.concat_ws("\x1f", F.lit("T"), "number", section))
    return t.withColumn("token", token)


def matching_blocks(tokened: DataFrame, pair: list[str]) -> DataFrame:
    """(pair, __a, __b, __size): runs of equal tokens of both sides, longest first between those found; __a and
    __b are places from 0 in each side's order. A task takes the tokens of some document pairs at a time."""
    schema = ", ".join([f"{c} {tokened.schema[c].dataType.simpleString()}" for c in pair] + ["__a int", "__b int", "__size int"])

    def run(rows: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        ends = np.append(first[1:], len(rows))
        cuts = first + np.add.reduceat(rows["side"].to_numpy() == 0, first)
        tokens_, found, group = rows["token"].tolist(), [], []
        for n, (a, c, b) in enumerate(zip(first.tolist(), cuts.tolist(), ends.tolist())):
            if a < c < b:
                blocks = [x for x in SequenceMatcher(None, tokens_[a:c], tokens_[c:b], autojunk=False).get_matching_blocks() if x.size]
                found += blocks
                group += [first[n]] * len(blocks)
        blocks = pd.DataFrame(np.array(found, np.int32).reshape(-1, 3), columns=["__a", "__b", "__size"])
        return pd.concat([rows[pair].iloc[group].reset_index(drop=True), blocks], axis=1)

    return by_groups(tokened.select(*pair, "side", "place", "token"), pair, ["side", "place"], run, schema)


def aligned(tokened: DataFrame, pair: list[str]) -> DataFrame:
    """(pair, side, seq, kind, uncertain, other_seq): `changed` pairs are rows of side 0 with the
    other's seq; `missing` rows are of side 0, `extra` rows of side 1; equal links give no row.

    Links outside the matching blocks lie in gaps; a gap's number is that of the matched links before
    it, on both sides alike. The k-th links of a gap's two sides are a changed pair, what one side has
    beyond the other is missing or extra, and uncertain where the other side has links there at all.
    """
    placed = tokened.withColumn("place", (F.row_number().over(Window.partitionBy(*pair, "side").orderBy("seq")) - 1).cast("int"))
    blocks = matching_blocks(placed, pair)
    start = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("__a").alias("at")), F.struct(F.lit(1).alias("side"), F.col("__b").alias("at")))).alias("__s")
    matched = blocks.select(*pair, "__size", start).select(*pair, "__s.side", F.explode(F.sequence("__s.at", F.expr("__s.at + __size - 1"))).alias("place")).withColumn("matched", F.lit(1))
    rows = placed.select(*pair, "side", "seq", "place").join(matched, [*pair, "side", "place"], "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    before = F.sum("matched").over(Window.partitionBy(*pair, "side").orderBy("place"))
    loose = rows.withColumn("gap", before).where("matched = 0")
    loose = loose.withColumn("nth", F.row_number().over(Window.partitionBy(*pair, "side", "gap").orderBy("place")))
    m = loose.where("side = 0").select(*pair, "gap", "nth", F.col("seq").alias("m"))
    t = loose.where("side = 1").select(*pair, "gap", "nth", F.col("seq").alias("t"))
    met = m.join(t, [*pair, "gap", "nth"], "full_outer").withColumn("both", F.max(F.col("m").isNotNull() & F.col("t").isNotNull()).over(Window.partitionBy(*pair, "gap")))
    kind = F.when(F.col("t").isNull(), "missing").when(F.col("m").isNull(), "extra").otherwise("changed")
    side = F.when(F.col("m").isNull(), 1).otherwise(0)
    return met.select(*pair, side.alias("side"), F.coalesce("m", "t").cast("long").alias("seq"), kind.alias("kind"), (F.col("both") & (kind != "changed")).alias("uncertain"), F.when(kind == "changed", F.col("t")).cast("long").alias("other_seq"))


def within_quota(rows: DataFrame, tokened: DataFrame, pair: list[str]) -> DataFrame:
    """Missing and extra rows up to the surplus of their destination (if shared) or else of their
    number; rows with neither stay. So links that only changed places give no finding."""
    key = F.when(F.col("is_shared"), F.concat(F.lit("d:"), "dest")).when(F.col("number") != "", F.concat(F.lit("n:"), "number"))
    # a number counts all links that have it, whether their destination is shared or not
    names = F.array_compact(F.array(F.when(F.col("dest") != "", F.concat(F.lit("d:"), "dest")), F.when(F.col("number") != "", F.concat(F.lit("n:"), "number"))))
    counts = tokened.select(*pair, "side", F.explode(names).alias("key")).groupBy(*pair, "key").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
    r = rows.where("kind <> 'changed'").join(tokened.select(*pair, "side", "seq", key.alias("key")), [*pair, "side", "seq"]).join(counts, [*pair, "key"], "left")
    surplus = F.when(F.col("side") == 0, F.col("n0") - F.col("n1")).otherwise(F.col("n1") - F.col("n0"))
    r = r.withColumn("nth", F.row_number().over(Window.partitionBy(*pair, "side", "key").orderBy("seq")))
    kept = r.where(F.col("key").isNull() | (F.col("nth") <= surplus)).select(*rows.columns)
    return kept.unionByName(rows.where("kind = 'changed'"))


def internal_differences(links: DataFrame, pair: list[str]) -> DataFrame:
    """Missing, extra and changed internal links of each document pair."""
    t = tokens(links, pair)
    return within_quota(aligned(t, pair), t, pair)
