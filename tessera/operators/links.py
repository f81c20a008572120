"""Links of a document: pieces of wrapped links put together, typed, with their topic and neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import section_prefix
from tessera.operators.asof import asof_last
from tessera.operators.components import by_groups

LINE_GAP, TOPIC_SLACK = 6.0, 5.0
PAIRS = 1_000_000  # pairs of pieces that are compared together


def merged_links(pieces: DataFrame, page: list[str], target: list[str]) -> DataFrame:
    """Links from their rectangles: one row per link, with the first piece's rounded box, the texts of
    all pieces, and how many there are.

    pieces(page, target, seq, text, x0, y0, x1, y1). In reading order a piece joins the first link of
    its page and target whose last piece it continues (it starts up to LINE_GAP below, and at least
    half a line lower) or one of whose pieces stands on its line (half of the lower height shared).
    Some pages at a time are looked through.
    """
    key, box = [*page, *target], ["x0", "y0", "x1", "y1"]
    kinds = ", ".join(f"{c} {t}" for c, t in pieces.select(*key).dtypes)
    placed = pieces.select(*key, F.col("seq").cast("bigint").alias("seq"), *[F.col(c).cast("double").alias(c) for c in box], F.col("text").cast("string").alias("text"), F.bround("y0", 1).cast("double").alias("k1"))

    def run(rows: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        link = _links(first, rows["y0"].to_numpy(float), rows["y1"].to_numpy(float))
        heads = np.flatnonzero(link == np.arange(len(link)))
        texts: dict[int, list[str]] = {}
        for at, t in zip(link.tolist(), rows["text"].tolist()):
            if t:
                texts.setdefault(at, []).append(t)
        said = [" ".join(texts.get(h, [])).strip(" ") for h in heads.tolist()]
        return rows[[*key, "seq", *box]].iloc[heads].assign(text=said, pieces=np.bincount(link)[heads])

    found = by_groups(placed, key, ["k1", "x0", "seq", "y0", "x1", "y1", "text"], run, f"{kinds}, seq long, x0 double, y0 double, x1 double, y1 double, text string, pieces int")
    return found.select(*key, "seq", *[F.bround(c, 1).alias(c) for c in box], "text", "pieces")


def _links(first: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """The place of the first piece of the link that each piece belongs to; groups begin at the places `first`."""
    begin = np.repeat(first, np.diff(np.append(first, len(y0))))
    before = np.arange(len(y0)) - begin
    link, last = list(range(len(y0))), list(range(len(y0)))
    for some in np.split(np.arange(len(y0)), np.flatnonzero(np.diff(before.cumsum() // PAIRS)) + 1):
        p = np.repeat(some, before[some])
        q = begin[p] + np.arange(len(p)) - np.repeat(before[some].cumsum() - before[some], before[some])
        gap, high = y0[p] - y1[q], y1 - y0
        goes_on = (gap >= -2) & (gap <= LINE_GAP) & (y0[p] >= y0[q] + high[q] * 0.5)
        same = np.fmin(y1[q], y1[p]) - np.fmax(y0[q], y0[p]) >= 0.5 * np.fmin(high[q], high[p])
        hit = np.flatnonzero(goes_on | same)
        ends = np.searchsorted(p[hit], some, "right").tolist()
        q, same, n = q[hit].tolist(), same[hit].tolist(), 0
        for one, end in zip(some.tolist(), ends):
            # the first link with a piece on this line, or whose last piece goes on here
            joined = min((link[k] for k, line in zip(q[n:end], same[n:end]) if line or last[link[k]] == k), default=one)
            link[one], last[joined], n = joined, one, end
    return np.array(link)


def target_type(kind: Column, uri: Column, page: Column, name: Column) -> tuple[Column, Column]:
    """Type and target: external URIs, internal `page N (name)` or a bare name, files; null for other kinds."""
    at = F.when(page >= 0, F.concat(F.lit("page "), (page + 1).cast("string"), F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit(" ("), name, F.lit(")"))).otherwise(""))).otherwise(F.coalesce(name, F.lit("")))
    inner = kind.isin("goto", "named")
    return F.when(kind == "uri", "external").when(inner, "internal").when(kind == "launch", "file"), F.when(inner, at).when(kind.isin("uri", "launch"), F.coalesce(uri, F.lit("")))


def with_topic(links: DataFrame, headings: DataFrame, doc: list[str]) -> DataFrame:
    """links with the code of the last heading at or above them (TOPIC_SLACK points of grace on the
    same page) and the section, its first two levels. headings(doc, page_no, y, code)."""
    key = lambda page, y: F.struct(page.cast("int").alias("p"), y.cast("double").alias("y"))
    found = asof_last(links, headings.select(*doc, F.col("page_no").alias("h_page"), F.col("y").alias("h_y"), "code"), doc, key(F.col("page_no"), F.col("y0") + TOPIC_SLACK), key(F.col("h_page"), F.col("h_y")), ["code"])
    found = found.withColumn("topic", F.coalesce("code", F.lit(""))).drop("code")
    return found.withColumn("section", F.when(F.col("topic") == "", "").otherwise(section_prefix(F.col("topic"))))


def neighbours(links: DataFrame, doc: list[str]) -> DataFrame:
    """links with the text of the link before and after, in order of page and place."""
    w = Window.partitionBy(*doc).orderBy("page_no", "y0", "x0", "seq")
    return links.withColumn("before", F.lag("text").over(w)).withColumn("after", F.lead("text").over(w))
