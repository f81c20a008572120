"""Checks put together: images in order and by content, table-like regions, cards, the whole inspection."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import boxes as bx
from tessera.operators import findings, spatial
from tessera.operators.crops import correlation, paired

IN_ORDER = [(90.0, "MATCH"), (55.0, "CHECK")]
# The columns that all cards have.
CARD = ["doc_id", "source", "page_no", "topic", "title", "detail", "passed"]
SHEETS = ("summary", "toc", "links", "barcodes", "qr_codes", "crops", "counts", "regions", "untranslated", "overlap")


def slots(images: DataFrame, doc: list[str], topic: list[str]) -> DataFrame:
    """images with their slot in their topic, in reading order."""
    return images.withColumn("slot", F.row_number().over(Window.partitionBy(*doc, *topic).orderBy("page_no", F.bround("y0", 1), "x0", "no")))


def images_in_order(master: DataFrame, target: DataFrame, doc: list[str], topic: list[str]) -> DataFrame:
    """Slot by slot where a topic has as many images on both sides: similarity in percent and MATCH from 90,
    CHECK from 55, else DIFFERENT. Both(doc, topic, page_no, no, x0, y0, pixels)."""
    key = [*doc, *topic]
    n = lambda df, name: df.groupBy(*key).agg(F.count("*").alias(name))
    even = n(master, "m").join(n(target, "t"), key).where("m = t").select(*key)
    m = slots(master, doc, topic).select(*key, "slot", F.col("no").alias("m"), F.col("pixels").alias("p"))
    t = slots(target, doc, topic).select(*key, "slot", F.col("no").alias("t"), F.col("pixels").alias("q"))
    met = m.join(even, key).join(t, [*key, "slot"])
    alike = F.when(F.size("p") == F.size("q"), F.bround(100 * correlation(F.col("p"), F.col("q")), 1)).otherwise(0.0)
    s = met.select(*key, "slot", "m", "t", alike.alias("similarity"))
    status = reduce(lambda w, x: w.when(F.col("similarity") >= x[0], x[1]), IN_ORDER, F.when(F.lit(False), "")).otherwise("DIFFERENT")
    return s.withColumn("status", status)


def images_by_content(master: DataFrame, target: DataFrame, doc: list[str], topic: str) -> DataFrame:
    """One-to-one pairs of the most alike images of each topic; all of a document is one topic where a side
    has none. (doc, topic, m, t, score)."""
    has = lambda df, name: df.groupBy(*doc).agg(F.max(F.col(topic).isNotNull()).alias(name))
    both = has(master, "a").join(has(target, "b"), doc).select(*doc, (F.col("a") & F.col("b")).alias("split"))
    own = F.when(F.col("split"), F.coalesce(F.col(topic).cast("string"), F.lit("-"))).otherwise("*").alias("bucket")
    m = master.join(both, doc).select(*doc, own, F.col("no").alias("m"), F.col("pixels").alias("p"))
    t = target.join(both, doc).select(*doc, own, F.col("no").alias("t"), F.col("pixels").alias("q"))
    s = m.join(t, [*doc, "bucket"]).where(F.size("p") == F.size("q")).select(*doc, "bucket", "m", "t", F.bround(correlation(F.col("p"), F.col("q")), 6).alias("score"))
    return paired(s, [*doc, "bucket"])


def table_regions(boxes: DataFrame, lines: DataFrame, least_text: int = 10) -> DataFrame:
    """Table-like regions of each page in reading order: boxes with ten characters of text or more, without
    those that repeat a larger one or lie in one. boxes(page, box_no, box), lines(page, box_no, box, text)."""
    inside = spatial.pairs(boxes, lines, g.contains(g.box("a_"), g.box("b_"), 1.0))
    said = inside.groupBy(*spatial.PAGE, F.col("a_box_no").alias("box_no")).agg(F.sum(F.length("b_text")).alias("chars"))
    full = boxes.join(said.where(F.col("chars") >= least_text), [*spatial.PAGE, "box_no"], "left_semi")
    kept = spatial.without_nested(bx.without_duplicates(full.select(*spatial.PAGE, "box_no", *g.BOX)))
    order = Window.partitionBy(*spatial.PAGE).orderBy("y0", "x0", "box_no")
    return kept.withColumn("place", F.row_number().over(order))


def live_lines(lines: DataFrame, width: Column, height: Column, m: dict[str, Column]) -> DataFrame:
    """Lines that share some of the live area and are at least a point wide."""
    return lines.where(g.intersects(g.box(), g.content_box(width, height, m)) & (F.col("x1") - F.col("x0") >= 1))


def candidate_pages(crops: DataFrame, spans: DataFrame, totals: DataFrame, doc: list[str]) -> DataFrame:
    """The pages on which each crop is sought, nearest first: its topic's in the translation and one around
    them, without a shared topic its own page and three around. crops(doc, no, page_no, topic),
    spans(doc, topic, lo, hi), totals(doc, total)."""
    c = crops.join(spans, [*doc, "topic"], "left").join(totals, doc)
    lo, hi = F.coalesce(F.col("lo") - 1, F.col("page_no") - 3), F.coalesce(F.col("hi") + 1, F.col("page_no") + 3)
    lo, hi = F.greatest(F.lit(1), lo), F.least(F.col("total"), hi)
    pages = c.where(lo <= hi).withColumn("page", F.explode(F.sequence(lo, hi)))
    w = Window.partitionBy(*doc, "no").orderBy(F.abs(F.col("page") - F.col("page_no")), "page")
    return pages.select(*doc, "no", "page", F.row_number().over(w).alias("place"))


def parent_scopes(regions: DataFrame, by: list[str]) -> DataFrame:
    """regions with the box of the region they lie in, for those that are checked in a scope."""
    p = regions.select(*by, F.col("id").alias("parent_id"), *[F.col(c).alias(f"scope_{c}") for c in g.BOX])
    return regions.join(p, [*by, "parent_id"], "left")


def with_columns_of(docs: DataFrame, registry: dict[str, tuple[str, Column]]) -> DataFrame:
    """docs with the registered metadata columns: key to (heading, expression)."""
    return docs.withColumns({heading: expression for heading, expression in registry.values()})


def cards(source: str, rows: DataFrame, title: Column, detail: Column, passed: Column, page: Column | None = None, topic: Column | None = None) -> DataFrame:
    """One check's rows as cards."""
    none = F.lit(None)
    return rows.select("doc_id", F.lit(source).alias("source"), (none if page is None else page).cast("int").alias("page_no"), (none if topic is None else topic).cast("string").alias("topic"), title.alias("title"), detail.alias("detail"), passed.alias("passed"))


def inspected(docs: DataFrame, checks: dict[str, DataFrame], gate: str = "toc") -> dict[str, DataFrame]:
    """The whole inspection: sheets by name. checks are cards by source; documents whose gate failed are
    skipped by all others. Where no document passes the gate, all others are empty.

    Sheets: one of each source in SHEETS, the summary of each document, all findings in review order
    (findings), and the verdicts.
    """
    open_docs = docs.select("doc_id").join(checks[gate].groupBy("doc_id").agg(F.every("passed").alias("ok")), "doc_id", "left").where(F.coalesce("ok", F.lit(True))).select("doc_id") if gate in checks else docs.select("doc_id")
    kept = {name: rows if name == gate else rows.join(open_docs, "doc_id", "left_semi") for name, rows in checks.items()}
    every = findings.merged(list(kept.values()))
    summary = findings.file_summaries(every, docs)
    verdict = findings.verdicts(every.select("doc_id", F.col("source").alias("check"), "passed", F.lit(False).alias("skipped")), ["doc_id"])
    return {**{name: kept[name] for name in SHEETS if name in kept}, "summary": summary, "verdicts": verdict, "findings": every}


def staged(sheets: dict[str, DataFrame], master_done: Callable[[], None], write: Callable[[str, DataFrame], None], masters: list[str]) -> None:
    """Writes the sheets that the master alone needs, tells that its stage is complete, then writes the rest."""
    for name in masters:
        write(name, sheets[name])
    master_done()
    for name, rows in sheets.items():
        if name not in masters:
            write(name, rows)


def write_json_report(rows: DataFrame, folder: str, by: list[str]) -> None:
    """Table comparisons as one JSON record a document: its tables in order, as nested rows."""
    each = F.struct(*[c for c in rows.columns if c not in by])
    rows.groupBy(*by).agg(F.array_sort(F.collect_list(each)).alias("tables")).write.mode("overwrite").json(folder)


def write_manifest(crops: DataFrame, folder: str) -> None:
    """The crop manifest, a folder for each topic. crops(topic_slug, page_no, crop_no, label, path)."""
    crops.write.mode("overwrite").partitionBy("topic_slug").json(folder)
