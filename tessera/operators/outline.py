"""Topics with positions, from an outline whose destinations may be boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GENERIC_SHARE, GENERIC_DEPTH, NUDGE = 0.8, 0.5, 0.1


def line_sizes(spans: DataFrame, line: list[str]) -> DataFrame:
    """Size of each line: that of its span with the most characters, the first of equals. spans(line, span_no, size, text)."""
    return spans.groupBy(*line).agg(F.max_by("size", F.struct(F.length("text"), -F.col("span_no"))).alias("size"))


def generic_destinations(outline: DataFrame, doc: list[str]) -> DataFrame:
    """(doc, generic): whether a document's outline points at one low spot by default.

    outline(doc, seq, raw_y bottom-up, page_height). So it is where GENERIC_SHARE of at least two
    destinations are the commonest one (of equals the first) and this lies below GENERIC_DEPTH of the
    first entry's page, or no page height is known.
    """
    o = outline.where("raw_y IS NOT NULL").withColumn("v", F.bround("raw_y", 1))
    n = o.groupBy(*doc, "v").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.min_by("page_height", "seq").alias("h"))
    d = n.groupBy(*doc).agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.min_by("v", F.struct(-F.col("n"), "first")).alias("v"), F.min_by("h", "first").alias("h"))
    low = F.when(F.coalesce("h", F.lit(0.0)) == 0, F.lit(True)).otherwise((F.col("h") - F.col("v")) / F.col("h") > GENERIC_DEPTH)
    return d.select(*doc, ((F.col("total") >= 2) & (F.col("most") / F.col("total") >= GENERIC_SHARE) & low).alias("generic"))


def corrected(outline: DataFrame, printed: DataFrame, doc: list[str]) -> DataFrame:
    """outline(doc, code, page_no, y) with the printed heading's y where one of its code stands on its page."""
    p = printed.groupBy(*doc, "code", "page_no").agg(F.max("y").alias("__y"))
    return outline.join(p, [*doc, "code", "page_no"], "left").withColumn("y", F.coalesce("__y", "y")).drop("__y")


def in_outline_order(outline: DataFrame, doc: list[str]) -> DataFrame:
    """outline(doc, seq, page_no, y, code, title) with places that never go back: an entry that would
    stand before the one ahead of it moves to just after that. A document's outline is one array."""
    one = F.struct(F.col("seq").cast("bigint").alias("seq"), F.col("page_no").cast("int").alias("page_no"), F.col("y").cast("double").alias("y"), "code", "title")
    kind = outline.select(one.alias("x")).schema["x"].dataType.simpleString()

    def step(done: Column, t: Column) -> Column:
        last = F.element_at(done, -1)
        back = (F.size(done) > 0) & ((t["page_no"] < last["page_no"]) | ((t["page_no"] == last["page_no"]) & (t["y"] < last["y"])))
        moved = F.struct(t["seq"].alias("seq"), F.greatest(t["page_no"], last["page_no"]).alias("page_no"), (last["y"] + NUDGE).alias("y"), t["code"].alias("code"), t["title"].alias("title"))
        return F.concat(done, F.array(F.when(F.coalesce(back, F.lit(False)), moved).otherwise(t)))

    folded = F.aggregate(F.array_sort(F.collect_list(one)), F.expr(f"CAST(array() AS array<{kind}>)"), step)
    return outline.groupBy(*doc).agg(folded.alias("o")).select(*doc, F.inline("o"))


def topics_with_positions(outline: DataFrame, printed: DataFrame, doc: list[str]) -> DataFrame:
    """Topics by page and place: destinations turned top-down, boilerplate ones set to the top, printed
    headings' places in their stead, the outline's order kept. Documents without an outline get their
    printed headings. outline(doc, seq, page_no, raw_y, page_height, code, title), printed(doc,
    page_no, y, code, title)."""
    usable = outline.where("page_no >= 1").join(generic_destinations(outline.where("page_no >= 1"), doc), doc, "left")
    down = F.when(F.coalesce("generic", F.lit(False)) | F.col("raw_y").isNull() | F.col("page_height").isNull(), 0.0).otherwise(F.col("page_height") - F.col("raw_y"))
    placed = corrected(usable.withColumn("y", down).select(*doc, "seq", "page_no", "y", "code", "title"), printed, doc)
    own = in_outline_order(placed, doc).select(*doc, "page_no", "y", "code", "title")
    read = printed.join(own.select(*doc).distinct(), doc, "left_anti").select(*doc, "page_no", F.col("y").cast("double").alias("y"), "code", "title")
    return own.unionByName(read)
