"""Topics: outlines, page spans, drift between documents, headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import code_key
from tessera.operators.asof import asof_last

MAX_DEPTH, CONTENTS_PAGE, SIZE_RATIO = 4, 6, 1.06


def page_spans(outline: DataFrame, totals: DataFrame, doc: list[str]) -> DataFrame:
    """(doc, code, lo, hi): a topic runs to the page before the next later start, the last one to
    the end; a repeated code widens. outline(doc, code, page_no), totals(doc, total)."""
    starts = outline.where("page_no >= 1").select(*doc, "code", "page_no").distinct()
    w = Window.partitionBy(*doc).orderBy("page_no").rangeBetween(1, Window.unboundedFollowing)
    s = starts.withColumn("next", F.min("page_no").over(w)).join(totals, doc)
    end = F.coalesce(F.col("next") - 1, F.col("total"))
    lo, hi = F.least("page_no", end), F.greatest("page_no", end)
    return s.groupBy(*doc, "code").agg(F.greatest(F.lit(1), F.min(lo)).alias("lo"), F.least(F.max("total"), F.max(hi)).alias("hi"))


def topic_at(pages: DataFrame, spans: DataFrame, doc: list[str], page: str = "page_no") -> DataFrame:
    """pages with the code of the topic that holds the page; the latest start wins, then the
    greatest code in reading order."""
    # every page of every span: rows meet by document and page, not by document alone
    each = spans.where("lo <= hi").select(*doc, "code", "lo", F.explode(F.sequence("lo", "hi")).alias(page))
    best = each.groupBy(*doc, page).agg(F.max_by("code", F.struct("lo", code_key(F.col("code")))).alias("code"))
    return pages.join(best, [*doc, page], "left")


def drift(master: DataFrame, target: DataFrame, pair: list[str]) -> DataFrame:
    """(pair, start, delta) for every topic both documents have."""
    m = master.select(*pair, "code", F.col("lo").alias("start"))
    t = target.select(*pair, "code", F.col("lo").alias("t_lo"))
    return m.join(t, [*pair, "code"]).select(*pair, "start", (F.col("t_lo") - F.col("start")).alias("delta"))


def mapped_pages(pages: DataFrame, shifts: DataFrame, totals: DataFrame, pair: list[str]) -> DataFrame:
    """pages(pair, page_no) with the page each became: moved by the drift at the last shared topic
    start at or before it and kept within the target."""
    m = asof_last(pages, shifts, pair, F.col("page_no"), F.col("start"), ["start", "delta"]).join(totals, pair)
    moved = F.col("page_no") + F.coalesce("delta", F.lit(0))
    return m.select(*pair, "page_no", F.greatest(F.lit(1), F.least(F.col("total"), moved)).alias("mapped_page"))


def matching_pages(pages: DataFrame, master: DataFrame, target: DataFrame, totals: DataFrame, pair: list[str]) -> DataFrame:
    """The page of the target that holds the same topic as each master page, and why: the offset
    within a shared topic, else the drift, else the same page."""
    own = topic_at(pages, master, pair)
    m = master.select(*pair, "code", F.col("lo").alias("m_lo"))
    t = target.select(*pair, "code", F.col("lo").alias("t_lo"), F.col("hi").alias("t_hi"))
    shifts = drift(master, target, pair)
    usable = shifts.select(*pair).distinct().withColumn("usable", F.lit(True))
    by_topic = own.join(m, [*pair, "code"], "left").join(t, [*pair, "code"], "left")
    full = by_topic.join(mapped_pages(pages, shifts, totals, pair), [*pair, "page_no"]).join(usable, pair, "left")
    within = F.greatest("t_lo", F.least(F.col("t_hi"), F.col("t_lo") + F.col("page_no") - F.col("m_lo")))
    page = F.coalesce(within, F.when(F.col("usable"), F.col("mapped_page")), F.col("page_no"))
    why = F.when(within.isNotNull(), "topic").when(F.col("usable"), "drift").otherwise("same page")
    return full.select(*pair, "page_no", "code", page.alias("target_page"), why.alias("why"))


def compare_codes(outline: DataFrame, pair: list[str]) -> DataFrame:
    """Master against translation per pair: PASS if the code sequences are equal, else what is
    missing and extra, in order and with duplicates, or `Order Mismatch`. A side without codes in its
    outline must come with its printed headings (see with_printed); without any it fails against the other."""
    ordered = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("seq", "code")))), lambda s: s["code"])
    p = outline.groupBy(*pair).agg(ordered("master").alias("m"), ordered("translation").alias("t"))
    missing, extra = F.filter("m", lambda c: ~F.array_contains("t", c)), F.filter("t", lambda c: ~F.array_contains("m", c))
    p = p.withColumn("missing_topics", missing).withColumn("extra_topics", extra).withColumn("same", F.col("m") == F.col("t"))
    parts = F.concat_ws(" | ", F.when(F.size("missing_topics") > 0, F.concat(F.lit("Missing: "), F.array_join("missing_topics", ", "))), F.when(F.size("extra_topics") > 0, F.concat(F.lit("Extra: "), F.array_join("extra_topics", ", "))))
    message = F.when(F.col("same"), "PASS").when(parts == "", "Order Mismatch").otherwise(parts)
    return p.select(*pair, F.when(F.col("same"), "PASS").otherwise("FAIL").alias("status"), F.size("m").alias("english_topic_count"), F.size("t").alias("translated_topic_count"), message.alias("diff_msg"), F.array_join("missing_topics", ", ").alias("missing_topics"), F.array_join("extra_topics", ", ").alias("extra_topics"), F.array_join("m", ", ").alias("source_numerics_str"), F.array_join("t", ", ").alias("target_numerics_str"))


def heading_candidates(lines: DataFrame, doc: list[str]) -> DataFrame:
    """Lines that read as headings: a code, white space and a title, at most four levels, set larger
    than the body, whose size is the one with the most characters. lines(doc, page_no, y, size, text)."""
    weight = lines.where("size > 0").groupBy(*doc, F.bround("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("n"), F.min(F.struct("page_no", "y")).alias("first"))
    # of equal weights the size that stands first
    body = weight.groupBy(*doc).agg(F.min_by("size", F.struct(-F.col("n"), "first")).alias("body"))
    pattern = r"^(\d+(?:\.\d+)*)\s+(\S.*)$"
    found = lines.select(*doc, "page_no", "y", "size", F.regexp_extract("text", pattern, 1).alias("code"), F.regexp_extract("text", pattern, 2).alias("title")).where("code <> ''").join(body, doc, "left")
    return found.where((F.size(F.split("code", r"\.")) <= MAX_DEPTH) & (F.col("size") >= F.coalesce(F.col("body") * SIZE_RATIO, F.lit(0.0))))


def ascending(found: DataFrame, doc: list[str]) -> DataFrame:
    """Candidates whose codes advance; a dropped one is never greater than the running maximum, so
    the maximum over all rows before is the one over the kept rows."""
    w = Window.partitionBy(*doc).orderBy("page_no", "y", "code").rowsBetween(Window.unboundedPreceding, -1)
    keyed = found.withColumn("key", code_key(F.col("code")))
    return keyed.withColumn("before", F.max("key").over(w)).where(F.col("before").isNull() | (F.col("key") > F.col("before")))


def printed_headings(lines: DataFrame, doc: list[str]) -> DataFrame:
    """Headings read off the page: candidates on pages with fewer than six, in ascending order."""
    found = heading_candidates(lines, doc)
    body = found.withColumn("on_page", F.count("*").over(Window.partitionBy(*doc, "page_no"))).where(F.col("on_page") < CONTENTS_PAGE)
    return ascending(body, doc).select(*doc, "page_no", "y", "code", "title", F.size("key").alias("level"))


def topic_keys(outline: DataFrame, doc: list[str], order: str) -> DataFrame:
    """outline with topic_key: the code, or #n for the n-th entry without one."""
    n = F.sum(F.col("code").isNull().cast("int")).over(Window.partitionBy(*doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return outline.withColumn("topic_key", F.coalesce("code", F.concat(F.lit("#"), n)))
