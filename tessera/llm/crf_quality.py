"""Quality rules with line labelling by a linear-chain conditional random field.

Every line with a word gets features from its characters and its place; the field has two labels,
content and boilerplate. It is fitted on the lines of at most TRAIN_DOCS labelled documents (those
of the smallest doc_id hashes; at most TRAIN_LINES lines of each), where a line carries its
document's quality label. Viterbi decoding marks the lines of every document, and the share of
content among the characters decides, after two base rules: too few words, too much repetition.

Null, empty and blank texts have no words and fail the base rules. Rows are judged one by one, so
repeated rows get equal results. Labels that are null, or of one kind only, leave the base rules
alone to decide. Very long texts are read whole. Extra columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import chunks, mix, slice_hashes, table, text_bytes, word_spans

TRAIN_DOCS, TRAIN_LINES = 2000, 200
MIN_SHARE = 0.5
MIN_WORDS, MAX_REPEAT, WINDOW = 20, 30, 8
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_STEPS = np.array([0.02, 0.05, 0.1, 0.2, 0.4, 0.7])


def _within(flag: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=total[1:])
    return total[end] - total[start]


def line_table(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Lines that hold a word: row, start, end, words and the 0/1 features, in order."""
    breaks = np.flatnonzero(raw == 10)
    start = np.concatenate([offsets[:-1], breaks + 1])
    row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    end = offsets[1:][row]
    same = np.flatnonzero(row[1:] == row[:-1])
    end[same] = start[same + 1] - 1
    first, last = word_spans(raw, offsets)
    words = np.searchsorted(first, end) - np.searchsorted(first, start)
    keep = words > 0
    start, end, row, words = start[keep], end[keep], row[keep], words[keep]
    chars = np.maximum(1, _within((raw & 0xC0) != 0x80, start, end))
    share = lambda flag: _within(flag, start, end) / chars
    lower, upper = (raw >= 97) & (raw <= 122), (raw >= 65) & (raw <= 90)
    shares = [share(_SYMBOLS[raw]), share((raw == 33) | (raw == 63)), upper_share := share(upper), share((raw >= 48) & (raw <= 57)), share((raw == 46) | (raw == 44)), share(raw >= 0xC0)]
    tail = raw[np.maximum(end - 1, 0)] if len(end) else np.zeros(0, np.uint8)
    length = _within((raw & 0xC0) != 0x80, start, end) / np.maximum(1, words)
    new = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    columns = [np.ones(len(row), bool)]
    for s in shares:
        columns += [s > x for x in _STEPS]
    columns += [words > x for x in (1, 3, 8, 20, 60)] + [length > x for x in (3, 4.5, 6, 8, 12)]
    columns += [(tail == 46) | (tail == 33) | (tail == 63), upper[start] if len(start) else new, lower[start] if len(start) else new, upper_share == 0, new]
    hashed = slice_hashes(raw, start, end)
    return {"row": row, "chars": _within((raw & 0xC0) != 0x80, start, end), "hash": hashed, "x": np.stack(columns, 1).astype(np.float32), "first": first, "last": last}


def forward_backward(score: np.ndarray, move: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log partition, label marginals and summed move marginals of padded chains (docs, steps, 2)."""
    docs, steps, _ = score.shape
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    alpha[:, 0] = score[:, 0]
    for t in range(1, steps):
        alpha[:, t] = score[:, t] + np.logaddexp(alpha[:, t - 1, :1] + move[0], alpha[:, t - 1, 1:] + move[1])
    for t in range(steps - 2, -1, -1):
        after = (score[:, t + 1] + beta[:, t + 1])[:, None, :] + move
        beta[:, t] = np.where((t + 1 < n)[:, None], np.logaddexp(after[:, :, 0], after[:, :, 1]), 0)
    end = alpha[np.arange(docs), n - 1]
    log_z = np.logaddexp(end[:, 0], end[:, 1])
    label = np.exp(alpha + beta - log_z[:, None, None]) * (np.arange(steps) < n[:, None])[:, :, None]
    moves = np.zeros((2, 2))
    for t in range(1, steps):
        on = t < n
        if on.any():
            moves += np.exp(alpha[on, t - 1, :, None] + move + (score[on, t] + beta[on, t])[:, None, :] - log_z[on, None, None]).sum(0)
    return log_z, label, moves


def fit(chains: list[tuple[np.ndarray, int]], rounds: int = 80, rate: float = 0.15, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray] | None:
    """(weights, moves) from (features of the lines, label) chains; None if only one label occurs."""
    chains = [c for c in chains if len(c[0])]
    if len({y for _, y in chains}) < 2:
        return None
    steps = max(len(x) for x, _ in chains)
    x = np.zeros((len(chains), steps, chains[0][0].shape[1]), np.float32)
    for i, (lines, _) in enumerate(chains):
        x[i, : len(lines)] = lines
    n, y = np.array([len(c[0]) for c in chains]), np.array([c[1] for c in chains])
    # each chain counts as one document and both labels weigh alike
    share = np.array([(y == k).sum() for k in (0, 1)])
    each = (len(y) / 2 / share[y]) / n
    on = np.arange(steps) < n[:, None]
    gold = np.zeros((len(chains), steps, 2))
    gold[np.arange(len(chains))[:, None], np.arange(steps), y[:, None]] = on
    gold_moves = np.zeros((2, 2))
    for k in (0, 1):
        gold_moves[k, k] = (n[y == k] - 1).sum()
    w, move = np.zeros((x.shape[2], 2)), np.zeros((2, 2))
    m1, m2 = [np.zeros_like(w), np.zeros_like(move)], [np.zeros_like(w), np.zeros_like(move)]
    for step in range(1, rounds + 1):
        _, label, moves = forward_backward(x @ w, move, n)
        grads = [np.einsum("dtf,dtk->fk", x, ((gold - label) * each[:, None, None]).astype(np.float32)) / len(chains) - decay * w, (gold_moves - moves) / n.sum() - decay * move]
        for p, g, a, b in zip((w, move), grads, m1, m2):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return w, move


def viterbi(score: np.ndarray, move: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best labels of chains that stand one after another; first holds each chain's start, then the end."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    n, at = n[order], first[:-1][order]
    label = np.zeros(len(score), np.int8)
    if not len(n) or not n[0]:
        return label
    back = np.zeros((len(score), 2), np.int8)
    best = np.zeros((len(n), 2))
    live = np.searchsorted(-n, -np.arange(1, n[0] + 1), "right")
    best[: live[0]] = score[at[: live[0]]]
    for t in range(1, n[0]):
        k = live[t]
        step = best[:k, :, None] + move
        back[at[:k] + t] = step.argmax(1)
        best[:k] = step.max(1) + score[at[:k] + t]
    some = n > 0
    at, n, now = at[some], n[some], best[some].argmax(1)
    for t in range(n[0] - 1, -1, -1):
        k = live[t]
        label[at[:k] + t] = now[:k]
        now[:k] = back[at[:k] + t, now[:k]]
    return label


def repeated_words(raw: np.ndarray, offsets: np.ndarray, first: np.ndarray, last: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Words in each row, and how many stand in a window of words that its row holds twice or more."""
    at = np.searchsorted(first, offsets)
    words, repeats = np.diff(at), np.zeros(len(offsets) - 1, np.int64)
    if len(first) >= window:
        h = slice_hashes(raw, first, last)
        n = len(h) - window + 1
        key = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(window):
                key = key * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
            row = np.searchsorted(at, np.arange(n), "right") - 1
            key = mix(key) ^ mix(row.astype(np.uint64) + np.uint64(1))
        whole = np.arange(n) + window <= at[row + 1]
        order = np.argsort(key[whole], kind="stable")
        place, key = np.flatnonzero(whole)[order], key[whole][order]
        same = key[1:] == key[:-1]
        twice = np.zeros(len(key), bool)
        twice[1:] |= same
        twice[:-1] |= same
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, place[twice], 1)
        np.add.at(edge, place[twice] + window, -1)
        total = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])
        repeats = total[at[1:]] - total[at[:-1]]
    return words, repeats


def features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of the first TRAIN_LINES lines of each training document, as bytes, with its label."""
    for batch in batches:
        raw, offsets = text_bytes(batch.column("text"))
        t = line_table(raw, offsets)
        at = np.searchsorted(t["row"], np.arange(len(offsets)))
        x = np.packbits(t["x"] > 0, axis=1)
        out = [x[a : min(b, a + TRAIN_LINES)].tobytes() for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column("quality")], ["lines", "quality"])


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """The field's weights from a bounded sample of labelled rows; None without both labels."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    # hashes below a bound that the count gives, so that no task sends TRAIN_DOCS rows of its own
    share = min(1.0, 2 * TRAIN_DOCS / max(1, known.count()))
    below = known.where(F.xxhash64("doc_id") <= int(-(1 << 63) + share * ((1 << 64) - 1))) if share < 1 else known
    sample = below.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    # of rows that repeat a doc_id the least text counts
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    got = rows.mapInArrow(features_of, "lines binary, quality int").orderBy("lines").limit(TRAIN_DOCS).collect()
    n = line_table(*text_bytes(pa.array(["a"])))["x"].shape[1]
    wide = -(-n // 8)
    unpack = lambda b: np.unpackbits(np.frombuffer(b, np.uint8).reshape(-1, wide), axis=1)[:, :n].astype(np.float32)
    return fit([(unpack(bytes(r.lines)), int(r.quality)) for r in got])


def verdicts(model: tuple[np.ndarray, np.ndarray] | None, texts: pa.Array) -> list[np.ndarray]:
    """The columns NAMES for a column of texts."""
    raw_all, offsets_all = text_bytes(texts)
    parts = []
    for a, b in chunks(offsets_all):
        offsets = offsets_all[a : b + 1] - offsets_all[a]
        raw = raw_all[offsets_all[a] : offsets_all[b]]
        t = line_table(raw, offsets)
        words, repeats = repeated_words(raw, offsets, t["first"], t["last"])
        space = np.isin(raw, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
        chars = _within(((raw & 0xC0) != 0x80) & ~space, offsets[:-1], offsets[1:])
        symbols = _within(_SYMBOLS[raw], offsets[:-1], offsets[1:])
        at = np.searchsorted(t["row"], np.arange(len(offsets)))
        distinct = np.unique(np.stack([t["row"].astype(np.uint64), t["hash"]], 1), axis=0)[:, 0] if len(t["row"]) else np.zeros(0, np.uint64)
        dup = np.diff(at) - np.bincount(distinct.astype(np.int64), minlength=b - a)
        content = np.ones(b - a)
        if model is not None and len(t["row"]):
            label = viterbi(t["x"] @ model[0].astype(np.float32), model[1], at)
            size = np.bincount(t["row"], t["chars"], b - a)
            content = np.bincount(t["row"], t["chars"] * label, b - a) / np.maximum(size, 1)
        failed = (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT * words)
        parts.append((words, chars, symbols, dup, repeats, failed, ~failed & (content >= MIN_SHARE), content))
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0)] * 8


def judged(model: tuple[np.ndarray, np.ndarray] | None):
    """A mapInArrow function from (doc_id, text, ...) to the counts and the verdict of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = verdicts(model, batch.column("text"))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds))], ["doc_id", *NAMES])

    return run


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]
OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row of counts and a verdict for each row of docs(doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(judged(train(docs, labels)), OUT)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the verdict keeps, with all their columns."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(verdicts(model, batch.column("text"))[6].astype(bool)))

    return docs.mapInArrow(run, docs.schema)


def op10_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
