"""Scalar text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words whose share makes a line read as English.
FUNCTION_WORDS = (
    "the and of to in is are for with on this that be not or from by as it if can must should will when before after "
    "which these those all any have has been into other than then there use used using see note only each such both "
    "while during between above below over under about"
).split()

LETTERS = r"[\p{L}\p{Nl}\p{No}]+"


def topic_code(title: Column) -> Column:
    """The dotted number a title starts with, or null."""
    code = F.regexp_extract(title, r"^\s*(\d+(?:\.\d+)*)", 1)
    return F.when(code != "", code)


def code_key(code: Column) -> Column:
    """A dotted number as integers; arrays compare in reading order."""
    return F.transform(F.split(code, r"\."), lambda p: p.cast("int"))


def section_prefix(code: Column) -> Column:
    """The first two levels of a code, or the code."""
    return F.substring_index(code, ".", 2)


def number_prefix(text: Column) -> Column:
    """The section number a link's text starts with, or ''."""
    return F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)*)\b", 1)


def destination(target: Column) -> Column:
    """`page N (dest)` gives dest; a bare string that is neither a URL nor a page gives itself; else ''."""
    t = F.regexp_replace(target, r"^\s+|\s+$", "")
    page = r"^page\s+\d+\s+\((.*)\)$"
    bare = ~t.rlike(r"^(https?://|mailto:|ftp://|file:)") & ~t.startswith("page ")
    return F.when(t.rlike(page), F.regexp_extract(t, page, 1)).when(bare, t).otherwise(F.lit(""))


def brief(text: Column, limit: int = 100) -> Column:
    """The text without dot leaders and what follows them, cut to limit characters."""
    return F.left(F.trim(F.regexp_replace(text, r"\.{3,}.*$", "")), F.lit(limit))


def words(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({LETTERS})"), F.lit(1)), lambda w: F.lower(w))


def function_word_count(found: Column) -> Column:
    return F.size(F.filter(found, lambda w: w.isin(FUNCTION_WORDS)))


def digit_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{Nd}", ""))


def is_numeric_line(text: Column, share: float = 0.20) -> Column:
    """A measurement or a code: null, empty, or more digits than this share of its characters."""
    return F.coalesce(digit_count(text) / F.greatest(F.length(text), F.lit(1)) > share, F.lit(True)) | (text == "")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility normalisation; there is no built-in."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def folded(text: Column) -> Column:
    """Words alone: lower case, single blanks, no punctuation; text is already NFKC."""
    spaced = F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))
    return F.regexp_replace(F.lower(spaced), r"[^\p{L}\p{M}\p{N}_ ]", "")


def human_size(size: Column) -> Column:
    """Bytes as B, KB, MB or GB, base 1024, one decimal from KB up."""
    n = size.cast("double")
    return (
        F.when(n < 1024, F.format_string("%d B", size.cast("long")))
        .when(n < 1024**2, F.format_string("%.1f KB", F.bround(n / 1024, 1)))
        .when(n < 1024**3, F.format_string("%.1f MB", F.bround(n / 1024**2, 1)))
        .otherwise(F.format_string("%.1f GB", F.bround(n / 1024**3, 1)))
    )


def duration(seconds: Column) -> Column:
    """`5.8s` under a minute, else whole minutes and seconds."""
    whole = F.bround(seconds).cast("long")
    return F.when(seconds < 60, F.format_string("%.1fs", F.bround(seconds.cast("double"), 1))).otherwise(F.format_string("%dm %ds", F.floor(whole / 60), whole % 60))


def columns_label(n: Column) -> Column:
    return F.when(n.isNull(), F.lit("-")).when(n > 4, F.lit("4+ column")).otherwise(F.format_string("%d column", n))


def topic_slug(title: Column, limit: int = 60) -> Column:
    """A folder name: illegal characters to _, single blanks, at most limit characters and ~, no
    trailing dots or blanks, device names (up to the first dot) prefixed; no topic (null) gives
    `_Front matter`, a topic of which nothing is left `Untitled`."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(title, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"\s+", " "))
    cut = F.when(F.length(clean) > limit, F.concat(F.rtrim(F.left(clean, F.lit(limit))), F.lit("~"))).otherwise(clean)
    bare = F.regexp_replace(cut, r"[. ]+$", "")
    reserved = F.upper(bare).rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(\.|$)")
    return F.when(title.isNull(), F.lit("_Front matter")).when(bare == "", F.lit("Untitled")).when(reserved, F.concat(F.lit("_"), bare)).otherwise(bare)
