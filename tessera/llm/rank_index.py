"""Where the k-th boundary of a text lies, by a learned index, and the fill-in-the-middle transformation on it.

Tokens are runs of ASCII white space with the word behind them; white space at a text's end is a token
of its own. The index of a chunk of texts holds the byte offsets of all token ends as straight lines:
each segment predicts the offset of a rank with an error of at most BOUND, and one signed byte a rank
holds what the prediction is off, so that a look-up is exact. A segment that misses the bound is halved
until it keeps it; two neighbouring ends always do. No segment crosses a text's border, so the index of
one text can be stored by itself (`boundary_index`) and cut again with other seeds.

Null texts count as empty; they have no tokens and are plain. A null doc_id is hashed as an empty number.
Repeated rows are cut alike. Texts are read whole whatever their length. Empty tables give no rows.
Extra columns, also of the names used here, are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import chunks, table, text_bytes, word_spans

BOUND, RUN = 127, 4096
SEED, RATE, SPM_SHARE = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass
class RankIndex:
    """Straight lines over ranks first[i] to first[i + 1] and the residual of every rank."""

    first: np.ndarray  # int64, ascending
    base: np.ndarray  # int64, the offset a line predicts at its first rank
    slope: np.ndarray  # float64
    residual: np.ndarray  # int8

    def predicted(self, ranks: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.first, ranks, "right") - 1
        return self.base[at] + np.floor(self.slope[at] * (ranks - self.first[at])).astype(np.int64)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        return self.predicted(ranks) + self.residual[ranks]


def fitted(offsets: np.ndarray, borders: np.ndarray, bound: int = BOUND) -> RankIndex:
    """The index of ascending offsets; borders: ranks at which a new text begins, the first and the end included."""
    n = len(offsets)
    residual = np.zeros(n, np.int8)
    starts = np.unique(np.concatenate([borders, np.arange(0, n, RUN)]))
    first, end = starts[:-1], starts[1:]
    kept = []
    while len(first):
        size = end - first
        slope = (offsets[end - 1] - offsets[first]) / np.maximum(1, size - 1)
        begin = np.cumsum(size) - size
        within = np.arange(int(size.sum())) - np.repeat(begin, size)
        ranks = within + np.repeat(first, size)
        off = offsets[ranks] - np.repeat(offsets[first], size) - np.floor(np.repeat(slope, size) * within).astype(np.int64)
        least, most = np.minimum.reduceat(off, begin), np.maximum.reduceat(off, begin)
        middle = (least + most) // 2
        good = np.maximum(most - middle, middle - least) <= bound
        kept.append((first[good], offsets[first[good]] + middle[good], slope[good]))
        settled = np.repeat(good, size)
        residual[ranks[settled]] = (off - np.repeat(middle, size))[settled]
        first, end = first[~good], end[~good]
        half = (first + end) // 2
        first, end = np.concatenate([first, half]), np.concatenate([half, end])
    lines = [np.concatenate(x) for x in zip(*kept)] if kept else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    order = np.argsort(lines[0], kind="stable")
    return RankIndex(lines[0][order], lines[1][order], lines[2][order], residual)


def token_ends(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the ends of all tokens, in order, and for each row the rank of its first (n + 1 numbers)."""
    _, ends = word_spans(raw, offsets)
    last = offsets[1:]
    # rows that end in white space have one more token
    words = np.searchsorted(ends, last, "right")
    tail = np.concatenate([[0], ends])[words]
    open_end = last[(last > offsets[:-1]) & (tail < last)]
    found = np.concatenate([ends, open_end])
    found.sort()
    return found, np.concatenate([[0], np.searchsorted(found, last, "right")])


def indexed(raw: np.ndarray, offsets: np.ndarray) -> tuple[RankIndex, np.ndarray]:
    """The index of a chunk and the ranks of its rows' first tokens."""
    ends, rank = token_ends(raw, offsets)
    return fitted(ends, np.unique(rank)), rank


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, other columns) to the other columns with n and the index of the text."""
    for batch in batches:
        texts = batch.column(0)
        _, offsets = text_bytes(texts)
        for a, b in chunks(offsets):
            raw, at = text_bytes(texts.slice(a, b - a))
            index, rank = indexed(raw, at)
            lines = np.searchsorted(index.first, rank)
            row = np.repeat(np.arange(b - a), np.diff(lines))
            segments = pa.StructArray.from_arrays([pa.array(index.first - rank[row]), pa.array(index.base - at[row]), pa.array(index.slope)], ["first", "base", "slope"])
            residuals = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(rank.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(index.residual))])
            rest = batch.slice(a, b - a).columns[1:]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.diff(rank)), pa.ListArray.from_arrays(pa.array(lines, pa.int32()), segments), residuals], [*batch.schema.names[1:], "n", "segments", "residuals"])


def boundary_index(docs: DataFrame) -> DataFrame:
    """doc_id with n, segments (first rank, base, slope) and residuals: the text's index, in bytes from its start."""
    text = F.coalesce("text", F.lit("")).alias("text")
    return docs.select(text, "doc_id").mapInArrow(_index_rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, segments array<struct<first: long, base: long, slope: double>>, residuals binary")


def stored_offset(rank: Column) -> Column:
    """The byte at which the token of a rank (from 0) ends, from the columns of `boundary_index`."""
    line = F.element_at(F.filter("segments", lambda x: x["first"] <= rank), -1)
    byte = F.conv(F.hex(F.substring(F.col("residuals"), (rank + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return line["base"] + F.floor(line["slope"] * (rank - line["first"])) + F.when(byte > 127, byte - 256).otherwise(byte)


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, h1, h2, other columns) to the other columns with n and the two cuts in bytes."""
    for batch in batches:
        texts = batch.column(0)
        _, offsets = text_bytes(texts)
        for a, b in chunks(offsets):
            raw, at = text_bytes(texts.slice(a, b - a))
            index, rank = indexed(raw, at)
            n = np.diff(rank)
            h = [batch.column(k).slice(a, b - a).to_numpy() % (n + 1) for k in (1, 2)]
            cuts = []
            for k in (np.minimum(*h), np.maximum(*h)):
                cut, inner = np.zeros(b - a, np.int64), k > 0
                cut[inner] = index.offsets(rank[:-1][inner] + k[inner] - 1) - at[:-1][inner]
                cuts.append(pa.array(cut))
            rest = batch.slice(a, b - a).columns[3:]
            yield pa.RecordBatch.from_arrays([*rest, texts.slice(a, b - a), pa.array(n), *cuts], [*batch.schema.names[3:], "text", "n", "cut1", "cut2"])


def group_of(sha: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits, as an unsigned number."""
    return F.conv(F.substring(sha, 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output (text) of each row of docs(doc_id, text).

    rate of 100 documents are rearranged, spm_share of 100 of these with the suffix first. marks: of prefix,
    suffix and middle; texts that hold one stay plain. They must begin with a character that they hold nowhere
    else, and differ, so that `restored` finds them.
    """
    if len({*marks}) < 3 or any(len(m) < 2 or m[0] in m[1:] or m[0] != marks[0][0] for m in marks):
        raise ValueError("three marks that differ and begin with one character that they hold nowhere else")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    kind = docs.schema["doc_id"].dataType.simpleString()
    hashed = docs.select(text.alias("text"), "doc_id", F.sha2(F.concat(F.lit(f"{seed}:"), number).cast("binary"), 256).alias("sha"))
    h1, h2, h3, h4 = (group_of(F.col("sha"), k) for k in range(1, 5))
    plain = (F.length("text") == 0) | (h3 % 100 >= rate)
    for m in marks:
        plain = plain | F.contains("text", F.lit(m))
    form = F.when(plain, "plain").when(h4 % 100 < spm_share, "spm").otherwise("psm")
    cut = hashed.select("text", h1.alias("h1"), h2.alias("h2"), "doc_id", form.alias("form")).mapInArrow(_cut_rows, f"doc_id {kind}, form string, text string, n long, cut1 long, cut2 long")
    raw, c1, c2 = F.col("text").cast("binary"), F.col("cut1").cast("int"), F.col("cut2").cast("int")
    part = lambda a, n: F.substring(raw, a, n).cast("string")
    p, m, s = part(F.lit(1), c1), part(c1 + 1, c2 - c1), part(c2 + 1, F.octet_length("text"))
    open_p, open_s, open_m = (F.lit(x) for x in marks)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", F.concat(open_s, s, open_p, p, open_m, m)).otherwise(F.concat(open_p, p, open_s, s, open_m, m))
    moved = F.col("form") != "plain"
    return cut.select("doc_id", "n", "form", F.when(moved, F.length(p)).cast("long").alias("prefix_chars"), F.when(moved, F.length(m)).cast("long").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text of an output, from it and its form alone."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        a = F.substring_index(rest := F.substring(output, F.lit(len(first) + 1), F.length(output)), second, 1)
        b = F.substring_index(rest := F.substring(rest, F.length(a) + len(second) + 1, F.length(output)), marks[2], 1)
        return a, b, F.substring(rest, F.length(b) + len(marks[2]) + 1, F.length(output))

    p, s, m = parts(marks[0], marks[1])
    s2, p2, m2 = parts(marks[1], marks[0])
    return F.when(form == "plain", output).when(form == "psm", F.concat(p, m, s)).otherwise(F.concat(p2, m2, s2))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS s, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT doc_id, s, regexp_extract_all(s, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
f AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
  CASE WHEN s = '' OR contains(s, '<P>') OR contains(s, '<S>') OR contains(s, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
c AS (SELECT doc_id, s, n, form, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS x FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN s WHEN 'spm' THEN '<S>' || x || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || x || '<M>' || m END) AS output_sha256,
  sha256(s) AS restored_sha256
FROM c
"""
