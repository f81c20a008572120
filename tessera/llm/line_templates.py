"""Line dedup by a log-template tree, in DataFrame functions alone.

Lines are parsed as logs are: a token with a digit is a variable field, then the tree's fixed depth
is the number of tokens followed by the first LEAD tokens; lines on one path share a leaf. Only
leaves that occur in MIN_DOCS documents or more go on. There the other fields are generalised: at
each position of a leaf a token stays if at least MIN_DOCS of the leaf's lines have it there, else
it becomes a variable field. A line's template recurs if MIN_DOCS documents or more hold it and at
least MIN_CONST of its fields are constant; of a recurring template the first line (smallest
doc_id, then line number) stays and all others are dropped. Lines of under MIN_TOKENS tokens always
stay, and so do lines that recur within one document only.

With least_const, a template also recurs where fewer of its fields are constant, if at least
least_const are and every other field holds digits, as in `Page 3 of 10`: nothing but numbers then
differs from line to line, and prose that shares its leading tokens only is left alone.

With identical, lines that are the same byte for byte in MIN_DOCS documents or more go too, however
few tokens they have and however many of these hold digits; the first stays. Lines of under
MIN_BYTES bytes, blanks around them not counted, may be short prose and stay. The query's SQL has neither
rule, so the query goes without; the pipeline's line dedup has both.

Identical lines are counted before their tokens are looked at, small tables are written so that
joins on a very common line can be split, and documents are joined with nothing but their own list
of dropped lines.

A null text stays null and has no lines; an empty text has one line, without tokens. Rows that
repeat a doc_id and its text count as one document and are treated alike; a null doc_id sorts after
all others. An empty table gives no rows. All columns of docs stay, under any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, table, written

LEAD, MIN_DOCS, MIN_TOKENS, MIN_CONST = 3, 3, 3, 0.6
MIN_BYTES = 8
BLANK = r"[\x20\x09-\x0D]+"
# 128 bits each: a document, a leaf of the tree, a line as its tokens, a template
KEY, LEAF, FORM, TEMPLATE = ["key", "key2"], ["leaf", "leaf2"], ["form", "form2"], ["template", "template2"]


def _wide(names: list[str], *columns: str | Column) -> dict[str, Column]:
    return {names[0]: F.xxhash64(*columns), names[1]: F.xxhash64(F.lit(1), *columns)}


def _tokens(line: Column) -> Column:
    words = F.filter(F.split(line, BLANK), lambda t: t != "")
    return F.when(line.rlike("[0-9]"), F.transform(words, lambda t: F.when(t.rlike("[0-9]"), F.lit("<*>")).otherwise(t))).otherwise(words)


def _plain(text: Column) -> Column:
    """Whether all blanks of a text are single spaces within its lines: then tokens need no patterns."""
    odd = text.startswith(" ") | text.endswith(" ")
    for sign in ("  ", " \n", "\n ", "\t", "\x0b", "\x0c", "\r"):
        odd = odd | text.contains(sign)
    return ~odd


def _leaf(line: Column, plain: Column) -> tuple[Column, Column]:
    """The tree's path: the number of tokens, and the leading ones with single spaces between them."""
    spaces = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    n = F.when(plain, F.when(line == "", F.lit(0)).otherwise(spaces + 1)).otherwise(F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")))
    first = F.substring_index(line, " ", LEAD)
    bare = F.when(line.rlike(r"^[\x20\x09-\x0D]"), F.regexp_replace(line, r"^[\x20\x09-\x0D]+", "")).otherwise(line)
    lead = F.slice(F.split(bare, BLANK, LEAD + 1), 1, LEAD)
    lead = F.array_join(F.transform(lead, lambda t: F.when(t.rlike("[0-9]"), F.lit("<*>")).otherwise(t)), " ")
    return n, F.when(plain & ~first.rlike("[0-9]"), first).otherwise(lead)


def _after_first(held: DataFrame, group: list[str], min_docs: int, name: str) -> DataFrame:
    """(key, key2, line_no) of all but the first line of each group that min_docs documents or more hold."""
    place = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("line_no").alias("c"))
    recurring = written(held.groupBy(*group).agg(F.count_distinct(*KEY).alias("docs"), F.min(place).alias("first")).where(F.col("docs") >= min_docs).select(*group, "first"), name)
    return held.join(recurring, group).where(~place.eqNullSafe(F.col("first"))).select(*KEY, "line_no")


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, min_const: float = MIN_CONST, identical: bool = False, least_const: int | None = None) -> DataFrame:
    """(key, key2, line_no) of the lines to drop from docs(key, key2, doc_id, text); line_no counts from 0.

    Leaves, lines and templates are told apart by 128 bits of their text. The joins that carry text
    name their method, so that small and large inputs run alike.
    """
    # plain is found before the lines are taken apart: once a text, not once a line
    texts = docs.select(*KEY, "doc_id", "text", _plain(F.col("text")).alias("plain"))
    lines = texts.select(*KEY, "doc_id", "plain", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    n, lead = _leaf(F.col("line"), F.col("plain"))
    parsed = lines.withColumn("n_tokens", n).where(F.col("n_tokens") >= max(min_tokens, LEAD)).withColumn("lead", lead).withColumns(_wide(LEAF, "n_tokens", "lead")).drop("plain", "n_tokens", "lead")
    leaves = written(parsed.groupBy(*LEAF).agg(F.count_distinct(*KEY).alias("docs")).where(F.col("docs") >= min_docs).select(*LEAF), "leaves")
    common = parsed.join(leaves.hint("shuffle_hash"), LEAF).withColumn("tokens", F.array_join(_tokens(F.col("line")), " ")).withColumns(_wide(FORM, "tokens"))
    common = written(common.select(*KEY, "doc_id", "line_no", *LEAF, *FORM, "tokens"), "leaf-lines")
    # each distinct line once; only leaves with several distinct lines have fields to generalise
    distinct = written(common.groupBy(*LEAF, *FORM).agg(F.count("*").alias("n"), F.first("tokens").alias("tokens")), "distinct-lines")
    several = written(distinct.groupBy(*LEAF).agg(F.count("*").alias("kinds")).where("kinds > 1").select(*LEAF), "mixed-leaves")
    fields = distinct.join(several, LEAF).select(*LEAF, *FORM, "n", F.posexplode(F.split("tokens", " ")).alias("at", "token"))
    field = [*LEAF, "at", "token"]
    constant = written(fields.groupBy(*field).agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select(*field, F.lit(True).alias("constant")), "constant-fields")
    kept = fields.join(constant, field, "left").select(*LEAF, *FORM, "at", F.when(F.col("constant") & (F.col("token") != "<*>"), F.col("token")).alias("token"), (F.col("token") != "<*>").alias("word"))
    # a variable field is an empty token in a template's text
    parts = F.sort_array(F.collect_list(F.struct("at", F.coalesce("token", F.lit("")).alias("token"))))
    n_const, n_words = F.count("token"), F.count_if(F.col("token").isNull() & F.col("word"))
    mixed = kept.groupBy(*LEAF, *FORM).agg(F.array_join(F.transform(parts, lambda x: x["token"]), " ").alias("text"), (n_const / F.count("*")).alias("share"), n_const.alias("n_const"), n_words.alias("n_words"))
    own = F.split("tokens", " ")
    fixed = F.size(F.filter(own, lambda t: t != "<*>"))
    alone = distinct.join(several, LEAF, "left_anti").select(
        *LEAF, *FORM, F.array_join(F.transform(own, lambda t: F.when(t != "<*>", t).otherwise("")), " ").alias("text"), (fixed / F.size(own)).alias("share"), fixed.cast("long").alias("n_const"), F.lit(0).cast("long").alias("n_words")
    )
    recurs = F.col("share") >= min_const
    if least_const is not None:
        recurs = recurs | ((F.col("n_words") == 0) & (F.col("n_const") >= least_const))
    templates = written(mixed.unionByName(alone).where(recurs).withColumns(_wide(TEMPLATE, *LEAF, "text")).select(*FORM, *TEMPLATE), "templates")
    held = written(common.select(*KEY, "doc_id", "line_no", *FORM).join(templates, FORM).drop(*FORM), "template-lines")
    drops = _after_first(held, TEMPLATE, min_docs, "recurring")
    if not identical:
        return drops
    # templates settle the other lines: there, a line that recurs as it is has constant fields alone but for digits
    loose = lines.withColumn("n_tokens", n).where((F.col("n_tokens") > 0) & ((F.col("n_tokens") < max(min_tokens, LEAD)) | F.col("line").rlike("[0-9]")) & (F.octet_length(F.trim("line")) >= MIN_BYTES))
    loose = written(loose.select(*KEY, "doc_id", "line_no", F.xxhash64("line").alias("same"), F.xxhash64(F.lit(1), "line").alias("same2")), "loose-lines")
    return drops.union(_after_first(loose, ["same", "same2"], min_docs, "identical"))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, min_const: float = MIN_CONST, identical: bool = False, least_const: int | None = None) -> tuple[DataFrame, str, str]:
    """docs with the dropped lines taken out of text and two more columns (long), whose names are returned:
    the number of lines and of dropped ones, __n_lines and __n_dropped, with more underscores where docs has these.
    """
    n_lines, n_dropped, gone, *key = fresh(docs.columns, "__n_lines", "__n_dropped", "__gone", "__key", "__key2")
    keys = [F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), "doc_id", "text")]
    drops = dropped_lines(docs.select(*(k.alias(c) for k, c in zip(keys, KEY)), "doc_id", "text"), min_docs, min_tokens, min_const, identical, least_const)
    per_doc = written(drops.groupBy(*KEY).agg(F.collect_set("line_no").alias(gone)).withColumnsRenamed(dict(zip(KEY, key))), "line-drops")
    joined = docs.withColumns(dict(zip(key, keys))).join(per_doc.hint("shuffle_hash"), key, "left")
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.element_at(lines, i + 1)), "\n"))
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    counted = joined.withColumns({n_lines: F.coalesce(breaks + 1, F.lit(0)).cast("long"), n_dropped: F.coalesce(F.size(gone), F.lit(0)).cast("long")})
    return counted.withColumn("text", text).select(*docs.columns, n_lines, n_dropped), n_lines, n_dropped


def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, n_lines, n_dropped = dedup_lines(table(spark, sf_dir, "documents"))
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return done.select("doc_id", F.col(n_lines).alias("n_lines"), F.col(n_dropped).alias("n_dropped"), sha.alias("kept_sha256"))


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no,
         unnest(string_split(text, chr(10))) AS line
  FROM documents WHERE text IS NOT NULL
), p AS (
  SELECT doc_id, line_no, list_transform(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda t: t <> ''),
         lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens
  FROM l
), q AS (
  SELECT doc_id, line_no, tokens, len(tokens) AS n, tokens[1:3] AS lead FROM p WHERE len(tokens) >= 3
), leaves AS (
  SELECT n, lead FROM q GROUP BY n, lead HAVING count(DISTINCT doc_id) >= 3
), c AS (
  SELECT q.* FROM q JOIN leaves USING (n, lead)
), d AS (
  SELECT n, lead, tokens, count(*) AS lines FROM c GROUP BY n, lead, tokens
), f AS (
  SELECT n, lead, tokens, lines, generate_subscripts(tokens, 1) AS pos, unnest(tokens) AS token FROM d
), k AS (
  SELECT n, lead, pos, token FROM f GROUP BY n, lead, pos, token HAVING sum(lines) >= 3
), several AS (
  SELECT n, lead FROM d GROUP BY n, lead HAVING count(*) > 1
), g AS (
  SELECT f.n, f.lead, f.tokens,
         list(CASE WHEN (k.pos IS NOT NULL OR several.n IS NULL) AND f.token <> '<*>' THEN f.token END ORDER BY f.pos) AS template
  FROM f LEFT JOIN k ON f.n = k.n AND f.lead = k.lead AND f.pos = k.pos AND f.token = k.token
         LEFT JOIN several ON f.n = several.n AND f.lead = several.lead
  GROUP BY f.n, f.lead, f.tokens
), t AS (
  SELECT *, len(list_filter(template, lambda x: x IS NOT NULL)) / n AS share FROM g
), h AS (
  SELECT c.doc_id, c.line_no, t.n, t.lead, t.template FROM c JOIN t ON c.n = t.n AND c.tokens = t.tokens WHERE share >= 0.6
), r AS (
  SELECT n, lead, template, min(struct_pack(a := doc_id, b := line_no)) AS first
  FROM h GROUP BY n, lead, template HAVING count(DISTINCT doc_id) >= 3
), x AS (
  SELECT h.doc_id, h.line_no FROM h JOIN r ON h.n = r.n AND h.lead = r.lead AND h.template IS NOT DISTINCT FROM r.template
  WHERE struct_pack(a := h.doc_id, b := h.line_no) <> r.first
), m AS (
  SELECT l.doc_id, count(*) AS n_lines, count(x.doc_id) AS n_dropped,
         coalesce(string_agg(CASE WHEN x.doc_id IS NULL THEN l.line END, chr(10) ORDER BY l.line_no), '') AS kept
  FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.line_no = x.line_no GROUP BY l.doc_id
)
SELECT documents.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN m ON documents.doc_id = m.doc_id
"""
