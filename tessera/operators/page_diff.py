"""Two pages' graphics compared: missing, moved sideways, carried to a neighbour page, extra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators.components import written
from tessera.operators.crops import correlation

MATCH, SIDEWAYS, NEIGHBOURS = 0.80, 3.0, 1
# Kinds of differences in the order of the summary, with what it calls them.
KINDS = [("missing", "missing from the translation"), ("extra", "extra in the translation"), ("moved", "moved"), ("reflowed", "moved to an adjacent page")]
_CLAIM = "struct<m:bigint,t:bigint,score:double>"


def scored_graphics(master: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """(key, m, t, score) of the graphics of matched pages with equal pixel counts; both(key, no, pixels)."""
    m, t = master.select(*key, F.col("no").alias("m"), F.col("pixels").alias("p")), target.select(*key, F.col("no").alias("t"), F.col("pixels").alias("q"))
    score = F.bround(correlation(F.col("p"), F.col("q")), 6)
    # exploded, so that filters on the score don't work it out again
    return m.join(t, key).where(F.size("p") == F.size("q")).select(*key, "m", "t", F.explode(F.array(score)).alias("score"))


def claims(scores: DataFrame, sizes: DataFrame, key: list[str]) -> DataFrame:
    """(key, m, t, score): each master graphic's best target graphic that none before it took, from
    MATCH on; the largest master graphic chooses first. sizes(key, m, area). One page is one array."""
    best = F.struct((-F.col("score")).alias("k"), F.col("t").cast("bigint").alias("t"), F.col("score").cast("double").alias("score"))
    wishes = scores.where(F.col("score") >= MATCH).groupBy(*key, "m").agg(F.array_sort(F.collect_list(best)).alias("w"))
    ranked = wishes.join(sizes, [*key, "m"]).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct((-F.col("area")).alias("k"), F.col("m").cast("bigint").alias("m"), "w"))).alias("r"))

    def step(done: Column, r: Column) -> Column:
        free = F.filter(r["w"], lambda x: ~F.exists(done, lambda d: d["t"] == x["t"]))
        took = F.element_at(free, 1)
        return F.when(F.size(free) == 0, done).otherwise(F.concat(done, F.array(F.struct(r["m"].alias("m"), took["t"].alias("t"), took["score"].alias("score")))))

    return ranked.select(*key, F.inline(F.aggregate("r", F.expr(f"CAST(array() AS array<{_CLAIM}>)"), step)))


def found_nearby(lost: DataFrame, others: DataFrame, doc: list[str]) -> DataFrame:
    """(doc, page_no, no, near_page, near_score): lost graphics that a neighbour page of the other
    document carries, the nearest page first, the one before ahead of the one after.

    lost(doc, page_no, no, at_page, pixels): at_page is the page of the other document it was sought on.
    """
    steps = F.explode(F.array(*[F.lit(d) for n in range(1, NEIGHBOURS + 1) for d in (-n, n)]))
    asked = lost.withColumn("d", steps).withColumn("near_page", (F.col("at_page") + F.col("d")).cast("int"))
    met = asked.join(others.select(*doc, F.col("page_no").alias("near_page"), F.col("pixels").alias("q")), [*doc, "near_page"]).where(F.size("pixels") == F.size("q"))
    score = F.bround(correlation(F.col("pixels"), F.col("q")), 6)
    hit = met.select(*doc, "page_no", "no", "d", "near_page", F.explode(F.filter(F.array(score), lambda s: s >= MATCH)).alias("near_score"))
    w = Window.partitionBy(*doc, "page_no", "no").orderBy(F.abs("d"), "d", F.desc("near_score"))
    return hit.withColumn("n", F.row_number().over(w)).where("n = 1").select(*doc, "page_no", "no", "near_page", "near_score")


def page_differences(master: DataFrame, target: DataFrame, mapped: DataFrame, doc: list[str]) -> DataFrame:
    """Differences of each master page and its matching page: kind, both boxes, shift, score, near_page.

    master and target(doc, page_no, no, x0, y0, x1, y1, pixels), mapped(doc, page_no, target_page).
    A graphic that only slid up or down is none, however far. Graphics and claims are written once: each is read by
    several of the parts that make the result.
    """
    key = [*doc, "page_no"]
    m = written(master.join(mapped, key), "master-pages")
    t = written(target.withColumnRenamed("page_no", "target_page").join(mapped, [*doc, "target_page"]), "target-pages")
    taken = claims(scored_graphics(m, t, key), m.select(*key, F.col("no").alias("m"), g.area(g.box()).alias("area")), key)
    named = lambda df, p: df.select(*key, F.col("no").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in g.BOX])
    placed = taken.join(named(m, "m"), [*key, "m"]).join(named(t, "t"), [*key, "t"]).withColumn("dx", F.round(F.col("t_x0") - F.col("m_x0"), 3)).withColumn("dy", F.round(F.col("t_y0") - F.col("m_y0"), 3))
    placed = written(placed, "claims")
    none = lambda n, kind="double": F.lit(None).cast(kind).alias(n)
    own, other = [F.col(f"m_{c}") for c in g.BOX], [F.col(f"t_{c}") for c in g.BOX]
    moved = placed.where(F.abs("dx") > SIDEWAYS).select(*key, F.lit("moved").alias("kind"), F.col("m").cast("long").alias("m"), F.col("t").cast("long").alias("t"), *own, *other, "dx", "dy", "score", none("near_page", "int"))
    lost = m.join(placed.select(*key, F.col("m").alias("no")), [*key, "no"], "left_anti")
    near = found_nearby(lost.select(*key, "no", F.col("target_page").alias("at_page"), "pixels"), target, doc)
    gone = lost.join(near, [*key, "no"], "left")
    kind = lambda one: F.when(F.col("near_page").isNotNull(), "reflowed").otherwise(one)
    gone = gone.select(*key, kind("missing").alias("kind"), F.col("no").cast("long").alias("m"), none("t", "long"), *[F.col(c).alias(f"m_{c}") for c in g.BOX], *[none(f"t_{c}") for c in g.BOX], none("dx"), none("dy"), F.col("near_score").alias("score"), F.col("near_page").cast("int").alias("near_page"))
    # a target graphic is an addition unless half of it is covered by what was claimed
    cover = t.select(*key, "no", *g.BOX).join(placed.select(*key, *[F.col(f"t_{c}").alias(f"c_{c}") for c in g.BOX]), key).groupBy(*key, "no").agg(F.sum(g.area(g.intersection(g.box(), g.box("c_")))).alias("covered"))
    free = t.join(cover, [*key, "no"], "left").where(F.coalesce("covered", F.lit(0.0)) < 0.5 * g.area(g.box()))
    back = found_nearby(free.select(*key, "no", F.col("page_no").alias("at_page"), "pixels"), master, doc)
    new = free.join(back, [*key, "no"], "left")
    new = new.select(*key, kind("extra").alias("kind"), none("m", "long"), F.col("no").cast("long").alias("t"), *[none(f"m_{c}") for c in g.BOX], *[F.col(c).alias(f"t_{c}") for c in g.BOX], none("dx"), none("dy"), F.col("near_score").alias("score"), F.col("near_page").cast("int").alias("near_page"))
    return moved.unionByName(gone).unionByName(new)


def difference_counts(diffs: DataFrame, key: list[str], pages: DataFrame) -> DataFrame:
    """Counts of each kind and one line of text for each page. pages(key, graphics)."""
    n = diffs.groupBy(*key).agg(*[F.count_if(F.col("kind") == k).alias(k) for k, _ in KINDS])
    d = pages.join(n, key, "left").na.fill(0, [k for k, _ in KINDS])
    total = sum((F.col(k) for k, _ in KINDS), F.lit(0))
    parts = F.concat_ws(", ", *[F.when(F.col(k) > 0, F.concat(F.col(k).cast("string"), F.lit(f" {name}"))) for k, name in KINDS])
    some = F.concat(total.cast("string"), F.when(total == 1, " difference").otherwise(" differences"), F.lit(" — "), parts)
    return d.withColumn("summary", F.when(total == 0, F.format_string("No differences - all %d graphic(s) matched", F.col("graphics"))).otherwise(some))


def reflow_notes(placed: DataFrame, key: list[str], tolerance: float = SIDEWAYS) -> DataFrame:
    """(key, note): how much lower artwork sits at most, where that is over the tolerance. placed(key, dy)."""
    drop = F.max("dy")
    text = F.format_string("artwork on the translated page sits up to %.0f pt lower than on the master - normal reflow, not reported per graphic", F.bround("drop", 0))
    return placed.groupBy(*key).agg(drop.alias("drop")).where(F.col("drop") > tolerance).select(*key, text.alias("note"))
