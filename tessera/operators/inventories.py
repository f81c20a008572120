"""Inventories compared as multisets: links, codes, graphics per topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_compared(left: DataFrame, right: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """(by, key, master_count, target_count) over the union of keys; a missing side counts 0."""
    m = left.groupBy(*by, *key).agg(F.count("*").alias("master_count"))
    t = right.groupBy(*by, *key).agg(F.count("*").alias("target_count"))
    both = m.join(t, [*by, *key], "full_outer")
    return both.select(*by, *key, F.coalesce("master_count", F.lit(0)).alias("master_count"), F.coalesce("target_count", F.lit(0)).alias("target_count"))


def image_counts(left: DataFrame, right: DataFrame, by: list[str], key: str) -> DataFrame:
    """Per topic PASS or FAIL with both counts."""
    c = counts_compared(left, right, by, [key])
    same = F.col("master_count") == F.col("target_count")
    return c.withColumn("status", F.when(same, "PASS").otherwise(F.format_string("FAIL (E(%d) vs T(%d))", "master_count", "target_count")))


def image_summary(counts: DataFrame, by: list[str], key: str, named: int = 6) -> DataFrame:
    """Per document pair: totals, granularity, the topics that differ and the status text.

    Topics decide where both sides have some, the totals where one has none. Topics stand in
    reading order (1.2 before 1.10), those without a number first; the text names the first ones,
    then `, +k more`.
    """
    number = F.expr("transform(split(CAST(%s AS string), '[.]'), p -> try_cast(p AS int))" % key)
    place = F.when(F.exists(number, lambda p: p.isNull()), F.array(F.lit(-1))).otherwise(number)
    bad = F.array_sort(F.collect_list(F.when(F.col("status") != "PASS", F.struct(place.alias("a"), F.col(key).alias("b")))))
    s = counts.groupBy(*by).agg(F.sum("master_count").alias("e"), F.sum("target_count").alias("t"), F.transform(bad, lambda x: x["b"].cast("string")).alias("bad"), (F.max(F.col("master_count") > 0) & F.max(F.col("target_count") > 0)).alias("topics"))
    same = F.col("e") == F.col("t")
    bad = F.when(~F.col("topics"), F.array().cast("array<string>")).when((F.size("bad") == 0) & ~same, F.array(F.lit("total"))).otherwise(F.col("bad"))
    s = s.withColumn("bad", bad).withColumn("granularity", F.when(F.col("topics"), "per topic").otherwise("document total"))
    more = F.when(F.size("bad") > named, F.format_string(", +%d more", F.size("bad") - named)).otherwise("")
    names = F.when(F.size("bad") == 0, F.lit("total")).otherwise(F.concat(F.array_join(F.slice("bad", 1, named), ", "), more))
    ok = same & (F.size("bad") == 0)
    text = F.when(ok, F.format_string("PASS (E(%d) vs T(%d), %s)", "e", "t", "granularity")).otherwise(F.format_string("FAIL (E(%d) vs T(%d), %s; differs at %s)", F.col("e"), F.col("t"), F.col("granularity"), names))
    return s.select(*by, F.col("e").alias("master_total"), F.col("t").alias("target_total"), "granularity", F.size("bad").alias("mismatched"), text.alias("status"))


def link_type(url: Column) -> Column:
    """internal for a fragment or path, file for other schemes of files, else external."""
    return F.when(url.rlike("^(#|/)"), "internal").when(url.rlike("^(?i)file:"), "file").otherwise("external")


def link_key(url: Column, qr_host: str) -> Column:
    """The trimmed target; links to the QR host collapse to one placeholder."""
    return F.when(url.rlike(f"(?i)^https?://(www\\.)?{qr_host}(/|$)"), F.lit("<qr>")).otherwise(F.trim(url))


def link_groups(links: DataFrame, by: list[str], page: str) -> DataFrame:
    """Per (by, type, target): count and the sorted distinct pages. links(by, type, target, page)."""
    return links.groupBy(*by, "type", "target").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(page)).alias("pages"))


def links_compared(master: DataFrame, target: DataFrame, by: list[str]) -> DataFrame:
    """Multiset difference per link: missing n, extra n; equal links give no row."""
    c = counts_compared(master, target, by, ["type", "target"]).where("master_count <> target_count")
    return c.select(*by, "type", "target", F.greatest(F.col("master_count") - F.col("target_count"), F.lit(0)).alias("missing"), F.greatest(F.col("target_count") - F.col("master_count"), F.lit(0)).alias("extra"))


def links_verdict(master: DataFrame, target: DataFrame, by: list[str]) -> DataFrame:
    """PASS if both totals agree and nothing is missing or extra."""
    c = counts_compared(master, target, by, ["type", "target"])
    kind = lambda t, n: F.coalesce(F.sum(F.when(F.col("type") == t, F.col(n))), F.lit(0))
    v = c.groupBy(*by).agg(F.sum("master_count").alias("english_total"), F.sum("target_count").alias("translated_total"), kind("internal", "master_count").alias("english_internal"), kind("internal", "target_count").alias("translated_internal"), F.count_if(F.col("master_count") > F.col("target_count")).alias("missing"), F.count_if(F.col("target_count") > F.col("master_count")).alias("extra"))
    ok = (F.col("english_total") == F.col("translated_total")) & (F.col("missing") == 0) & (F.col("extra") == 0)
    return v.withColumn("status", F.when(ok, "PASS").otherwise("FAIL"))


def quota(rows: DataFrame, key: list[str], order: list[str], limit: str) -> DataFrame:
    """The first `limit` (a column) rows of each key in order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("__n") <= F.col(limit)).drop("__n")


def codes_by_type(codes: DataFrame, by: list[str]) -> DataFrame:
    """Barcode and QR counts, decoded ones, and their pages."""
    of = lambda t: F.count_if(F.col("type") == t)
    pages = lambda t: F.array_join(F.array_sort(F.collect_set(F.when(F.col("type") == t, F.col("page_no")))), ", ")
    return codes.groupBy(*by).agg(of("BARCODE").alias("barcodes"), of("QRCODE").alias("qr_codes"), F.count_if("decoded").alias("decoded"), pages("BARCODE").alias("barcode_pages"), pages("QRCODE").alias("qr_pages"))


def codes_status(master: DataFrame, target: DataFrame, by: list[str], detector: bool = True) -> DataFrame:
    """Count comparison per type: PASS (Count t/m), FAIL (Count t/m), or CHECK without a detector."""
    both = master.join(target.withColumnsRenamed({c: f"t_{c}" for c in ("barcodes", "qr_codes")}), by, "full_outer")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))

    def status(c: str) -> Column:
        if not detector:
            return F.lit("CHECK (No Detector)")
        return F.format_string("%s (Count %d/%d)", F.when(n(f"t_{c}") == n(c), "PASS").otherwise("FAIL"), n(f"t_{c}"), n(c))

    out = both.select(*by, status("barcodes").alias("barcode_status"), status("qr_codes").alias("qr_status"))
    return out.withColumn("overall_verdict", F.when(F.col("barcode_status").startswith("PASS") & F.col("qr_status").startswith("PASS"), "PASS").when(F.lit(not detector), "CHECK").otherwise("FAIL"))
