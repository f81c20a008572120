"""Where each crop of the master stands in a translation: searched in its scope first, then in the rest.

A crop meets the graphics of the pages of its scope (its topic's there and one page around, else three pages around its
own). Only crops that have a topic there and pass nowhere in it meet the pages outside it. Of equal crops with the same
pages in the same order one is searched for all. A page's score is that of its best graphic; the nearest page that
passes is the place, else the page of the highest score, the nearer one of equals.

Crops: (doc..., no, page_no, topic, width, height, pixels), pixels 0 black to 255 white; graphics of the translation:
(doc..., page, id, width, height, pixels). Blank crops and those under 8 pixels are not searched and have no row. A
document without graphics finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import inspection, sized_crops, summaries
from tessera.operators.components import written

# fixed values, in percent
THRESHOLD, CREDIBLE = 80.0, 55.0


def scored_pages(asked: DataFrame, crops: DataFrame, graphics: DataFrame, doc: list[str]) -> DataFrame:
    """asked (doc, no, page, place) with the score of the page's best graphic, of those pages that have any of like shape."""
    pages = crops.join(asked, [*doc, "no"])
    named = pages.select(*doc, "page", "no", "width", "height", "pixels")
    best = sized_crops.sized_pairs(named, graphics, [*doc, "page"], "no", "id").groupBy(*doc, "page", F.col("m").alias("no")).agg(F.max("score").alias("score"))
    return asked.join(best, [*doc, "no", "page"])


def placed(scores: DataFrame, doc: list[str], threshold: float) -> DataFrame:
    """The place of each crop: (doc, no, page, score)."""
    passed = F.col("score") * 100 >= threshold
    order = F.struct(passed.alias("a"), F.when(passed, 0.0).otherwise(F.col("score")).alias("b"), (-F.col("place")).alias("c"))
    return scores.groupBy(*doc, "no").agg(F.max_by(F.struct("page", "score"), order).alias("best")).select(*doc, "no", "best.page", "best.score")


def status_of(score: Column, threshold: float) -> Column:
    return F.when(score * 100 >= threshold, "MATCH (PASS)").when(score * 100 >= CREDIBLE, "CHECK").otherwise("EXTRA IN MASTER")


def searched(crops: DataFrame, graphics: DataFrame, spans: DataFrame, totals: DataFrame, doc: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Each crop's result: (doc, no, page_no, page, match_pct, scope, shift, status).

    spans(doc, topic, lo, hi): the topics of the translation; totals(doc, total): its pages.
    """
    usable = crops.where(summaries.comparable_crop(F.col("width"), F.col("height"), F.col("pixels")))
    scope = inspection.candidate_pages(usable, spans, totals, doc)
    pages = scope.groupBy(*doc, "no").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "page"))), lambda x: x["page"]).alias("pages"))
    same = [*doc, "pages", "width", "height", F.sha2(F.to_json(F.struct("pixels")), 256)]
    known = usable.join(pages, [*doc, "no"]).withColumn("asked_as", F.min("no").over(Window.partitionBy(*same)))
    known = written(known.join(spans.select(*doc, "topic", "lo", "hi"), [*doc, "topic"], "left"), "crops")
    alone = known.where("no = asked_as")
    first = written(placed(scored_pages(scope.join(alone.select(*doc, "no"), [*doc, "no"], "left_semi"), alone, graphics, doc), doc, threshold), "crops-first")
    # what a topic doesn't hold may stand anywhere else
    lost = alone.where("lo IS NOT NULL").join(first.where(F.col("score") * 100 >= threshold), [*doc, "no"], "left_anti").join(totals.where("total >= 1"), doc)
    rest = lost.select(*doc, "no", F.col("pages")[0].alias("expect"), F.explode(F.array_except(F.sequence(F.lit(1), F.col("total")), "pages")).alias("page"))
    nearest = Window.partitionBy(*doc, "no").orderBy(F.abs(F.col("page") - F.col("expect")), "page")
    rest = rest.select(*doc, "no", "page", F.row_number().over(nearest).alias("place"))
    wider = placed(scored_pages(rest, lost.drop("total"), graphics, doc), doc, threshold).select(*doc, "no", F.col("page").alias("w_page"), F.col("score").alias("w_score"))
    both = alone.select(*doc, "no").join(first, [*doc, "no"], "left").join(wider, [*doc, "no"], "left")
    better = F.coalesce(F.col("w_score") > F.coalesce("score", F.lit(0.0)), F.lit(False))
    found = both.select(*doc, F.col("no").alias("asked_as"), F.when(better, F.col("w_page")).otherwise(F.col("page")).alias("page"), F.when(better, F.col("w_score")).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"), better.alias("widened"))
    r = known.join(found, [*doc, "asked_as"], "left")
    status = status_of(F.col("score"), threshold)
    lost_at = F.concat(F.lit("Extra in master (not found near page "), F.coalesce(F.col("pages")[0], F.col("page_no")).cast("string"), F.lit(")"))
    shift = F.when(status == "EXTRA IN MASTER", lost_at).when(F.col("page") == F.col("page_no"), "Same Page").otherwise(F.concat(F.lit("Moved to Page "), F.col("page").cast("string")))
    said = F.when(F.col("lo").isNull(), "page window").when(F.col("widened"), F.format_string("topic %s, then widened", "topic")).otherwise(F.format_string("topic %s (pp %d-%d)", "topic", "lo", "hi"))
    return r.select(*doc, "no", "page_no", F.when(status != "EXTRA IN MASTER", F.col("page")).alias("page"), F.bround(100 * F.col("score"), 2).alias("match_pct"), said.alias("scope"), shift.alias("shift"), status.alias("status"))
