"""Queries on text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.untranslated import inner_pages, untranslated
from tessera.plans.registry import register
from tessera.sources import bindings
from tessera.sources.bindings import sql

_WORDS = "list_transform(regexp_extract_all(text, '[\\p{L}\\p{Nl}\\p{No}]+'), lambda w: lower(w))"
_IS_WORD = "[" + ", ".join(f"'{w}'" for w in tx.FUNCTION_WORDS) + "]"
_NUMERIC = "length(regexp_replace(text, '[^\\p{Nd}]', '', 'g')) / length(text) > 0.20"
_NORM = "regexp_replace(lower(trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g'))), '[^\\p{L}\\p{M}\\p{N}_ ]', '', 'g')"


@register(
    "k14_untranslated",
    sql("b_lines")
    + f""", t AS (SELECT doc_id, max(page_no) AS last FROM b_lines GROUP BY doc_id),
l AS (SELECT b.*, {_WORDS} AS ws, {_NORM} AS norm FROM b_lines b JOIN t USING (doc_id)
      WHERE NOT ({_NUMERIC})),
inv AS (SELECT DISTINCT norm FROM l WHERE lang = 'en' AND len(list_filter(string_split(norm, ' '), lambda w: w <> '')) >= 4),
f AS (SELECT l.*, len(ws) AS n_words, len(list_filter(ws, lambda w: list_contains({_IS_WORD}, w))) AS hits,
      inv.norm IS NOT NULL AS in_master FROM l LEFT JOIN inv USING (norm) WHERE lang <> 'en'),
r AS (SELECT *, in_master AND hits > 0 AS verbatim, n_words >= 6 AND hits / n_words >= 0.40 AS dense FROM f WHERE n_words >= 4)
SELECT doc_id, lang, line_no, page_no, text, CAST(n_words AS INTEGER) AS n_words, CAST(hits AS INTEGER) AS hits,
  CASE WHEN verbatim AND dense THEN 'verbatim + dense' WHEN verbatim THEN 'verbatim' ELSE 'dense' END AS reason,
  round_even(hits / n_words, 2) AS density
FROM r WHERE verbatim OR dense""",
)
def k14_untranslated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untranslated lines: every other language against the English documents."""
    return untranslated(bindings.lines(spark, sf_dir), F.col("lang") == "en", skip_first_last=False)


@register(
    "k14_inner_pages",
    sql("b_lines")
    + """, t AS (SELECT doc_id, max(page_no) AS last FROM b_lines GROUP BY doc_id)
SELECT doc_id, line_no, page_no FROM b_lines JOIN t USING (doc_id) WHERE page_no > 1 AND page_no < last""",
)
def k14_inner_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all pages but each document's first and last."""
    return inner_pages(bindings.lines(spark, sf_dir), ["doc_id"]).select("doc_id", "line_no", "page_no")


@register(
    "t3_line_words",
    sql("b_lines")
    + f""" SELECT doc_id, line_no, CAST(len({_WORDS}) AS INTEGER) AS n_words,
  CAST(len(list_filter({_WORDS}, lambda w: list_contains({_IS_WORD}, w))) AS INTEGER) AS hits,
  CAST(length(regexp_replace(text, '[^\\p{{Nd}}]', '', 'g')) AS INTEGER) AS digits, {_NUMERIC} AS is_numeric, {_NORM} AS norm FROM b_lines""",
)
def t3_line_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word, function-word and digit counts and the normal form of each line."""
    found = tx.words(F.col("text"))
    return bindings.lines(spark, sf_dir).select("doc_id", "line_no", F.size(found).alias("n_words"), tx.function_word_count(found).alias("hits"), tx.digit_count(F.col("text")).alias("digits"), tx.is_numeric_line(F.col("text")).alias("is_numeric"), tx.folded(F.col("text")).alias("norm"))


@register(
    "t1_topic_codes",
    sql("b_outline")
    + """ SELECT seq, nullif(regexp_extract(t, '^\\s*(\\d+(?:\\.\\d+)*)', 1), '') AS code, CAST(string_split(code, '.')[1] AS INTEGER) AS level1,
  CAST(string_split(code, '.')[2] AS INTEGER) AS level2, regexp_extract(t, '^\\s*(\\d+(?:\\.\\d+)*)\\b', 1) AS number,
  trim(regexp_replace(t, '\\.{3,}.*$', '')) AS brief
FROM (SELECT seq, code, concat(code, ' Topic ', seq % 7, CASE WHEN seq % 3 = 0 THEN ' ..... 12' ELSE '' END) AS t FROM b_outline)""",
)
def t1_topic_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, keys and brief titles of outline entries."""
    o = bindings.outline(spark, sf_dir).withColumn("t", F.expr("concat(code, ' Topic ', seq % 7, CASE WHEN seq % 3 = 0 THEN ' ..... 12' ELSE '' END)"))
    code = tx.topic_code(F.col("t"))
    return o.select("seq", code.alias("code"), tx.code_key(code)[0].alias("level1"), tx.code_key(code)[1].alias("level2"), tx.number_prefix(F.col("t")).alias("number"), tx.brief(F.col("t")).alias("brief"))


@register(
    "t5_sizes_and_durations",
    """SELECT page_id, CASE WHEN n < 1024 THEN format('{:d} B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) ELSE printf('%.1f MB', n / 1048576) END AS size,
  CASE WHEN s < 60 THEN printf('%.1fs', s) ELSE format('{:d}m {:d}s', CAST(round_even(s, 0) AS BIGINT) // 60, CAST(round_even(s, 0) AS BIGINT) % 60) END AS took
FROM (SELECT page_id, strlen(html) * (1 + page_id % 400) AS n, (page_id % 700) / 4.0::DOUBLE AS s FROM pages)""",
)
def t5_sizes_and_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human-readable sizes and run times."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", (F.octet_length("html") * (1 + F.col("page_id") % 400)).alias("n"), ((F.col("page_id") % 700) / 4.0).alias("s"))
    return p.select("page_id", tx.human_size(F.col("n")).alias("size"), tx.duration(F.col("s")).alias("took"))


@register(
    "t10_topic_slugs",
    """SELECT item_id, CASE WHEN b IS NULL THEN '_Front matter' WHEN b = '' THEN 'Untitled' WHEN regexp_matches(upper(b), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])([.]|$)') THEN concat('_', b) ELSE b END AS slug FROM (
  SELECT item_id, regexp_replace(CASE WHEN length(c) > 60 THEN concat(rtrim(c[:60]), '~') ELSE c END, '[. ]+$', '') AS b FROM (
    SELECT item_id, trim(regexp_replace(regexp_replace(text, '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '\\s+', ' ', 'g')) AS c FROM benchmark))""",
)
def t10_topic_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder names of titles."""
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", tx.topic_slug(F.col("text")).alias("slug"))
