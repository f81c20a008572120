"""Language identification in two steps: the family, then a duel between languages within it.

A text becomes the square roots of its hashed character n-gram counts (one to three UTF-8 bytes,
A-Z lower-cased, all else but letters a blank), scaled to length one. Families are found from the
learned languages: their mean vectors are joined by average linkage until about the square root of
their number remains. Linear support vector machines (squared hinge) tell the families apart, one
against the rest, and within the family one against one for each pair of languages; most votes win,
then the larger summed margins. Learning takes a bounded sample: the TRAIN_DOCS learnable documents
with the smallest doc_id hashes, and one document of each of PER_LANG hash cells of each language,
so that a rare language is never missed. Prediction reads whole texts and nothing but the text.

A null text or one without a letter gets `und` and score 0. Without anything to learn from, every
row gets that. Rows are predicted one by one; equal texts get equal predictions. A null lang is not
learned, a null doc_id counts as held in. Extra columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import chunks, crc_mod, lower_ascii, table, text_bytes

DIM = 2048
TRAIN_DOCS, PER_LANG, ROWS = 3000, 64, 512
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def runs(offsets: np.ndarray):
    """Runs of rows with about a megabyte of text and at most ROWS rows, so that empty texts take no memory either."""
    for a, b in chunks(offsets):
        for x in range(a, b, ROWS):
            yield x, min(b, x + ROWS)


def ngram_vectors(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unit vectors (rows, DIM) of the texts that stand one after another in raw."""
    n = len(offsets) - 1
    low = lower_ascii(raw)
    b = np.where(_LETTER[low], low, 32).astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64) * DIM, np.diff(offsets))
    total = np.zeros(n * DIM)
    key = np.zeros(len(b), np.uint32)
    for size in (1, 2, 3):
        if len(b) < size:
            break
        key = key[: len(b) - size + 1] * np.uint32(0x01000193) + b[size - 1 :] + np.uint32(size * 7919)
        spot = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - 11)
        inside = row[: len(key)] == row[size - 1 :]
        total += np.bincount((row[: len(key)] + spot)[inside], minlength=n * DIM)
    x = np.sqrt(total.reshape(n, DIM))
    return (x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, rounds: int = 120, reg: float = 1e-4) -> np.ndarray:
    """Weights and bias of a squared-hinge linear machine for y in {-1, 1}, both sides weighed alike."""
    w, v, b, vb = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 0.0, 0.0
    each = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    step = 1.0
    for k in range(rounds):
        pw, pb = w + 0.9 * v, b + 0.9 * vb
        slack = np.maximum(0, 1 - y * (x @ pw + pb)) * each * y
        v = 0.9 * v + step * (slack @ x - reg * pw)
        vb = 0.9 * vb + step * 0.2 * float(slack.sum())
        w, b = w + v, b + vb
    return np.append(w, np.float32(b))


@dataclass
class Model:
    families: list[list[str]]
    family: np.ndarray | None  # (families, DIM + 1)
    duels: dict[tuple[str, str], np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        if self.family is None:
            of, sure = np.zeros(len(x), np.int64), np.ones(len(x))
        else:
            margin = x @ self.family.T
            of = margin.argmax(1)
            p = np.exp(2 * (margin - margin.max(1, keepdims=True)))
            sure = p.max(1) / p.sum(1)
        lang, score = np.empty(len(x), object), sure.astype(float)
        for f, names in enumerate(self.families):
            rows = np.flatnonzero(of == f)
            votes, margins = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
            least = np.ones((len(rows), len(names)))
            for i, a in enumerate(names):
                for j in range(i + 1, len(names)):
                    m = x[rows] @ self.duels[a, names[j]]
                    p = 1 / (1 + np.exp(-2 * np.clip(m, -30, 30)))
                    votes[:, i] += m >= 0
                    votes[:, j] += m < 0
                    margins[:, i] += m
                    margins[:, j] -= m
                    least[:, i], least[:, j] = np.minimum(least[:, i], p), np.minimum(least[:, j], 1 - p)
            best = (votes + 1e-3 * np.tanh(margins)).argmax(1)
            lang[rows] = np.array(names, object)[best]
            score[rows] *= least[np.arange(len(rows)), best]
        return lang, np.clip(score, 0, 1)


def families(names: list[str], means: np.ndarray) -> list[list[str]]:
    """Average linkage of mean vectors until about the square root of their number remains."""
    groups = [[i] for i in range(len(names))]
    near = means @ means.T
    while len(groups) > max(1, round(len(names) ** 0.5)):
        pairs = [(near[np.ix_(a, b)].mean(), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = max(pairs)
        groups[-i] += groups.pop(-j)
    return [[names[i] for i in sorted(g)] for g in groups]


def fit(x: np.ndarray, lang: np.ndarray) -> Model | None:
    names = sorted(set(lang.tolist()))
    if not names:
        return None
    means = np.stack([x[lang == n].mean(0) for n in names])
    found = families(names, means - means.mean(0))
    of = {n: f for f, g in enumerate(found) for n in g}
    own = np.array([of[n] for n in lang])
    family = np.stack([svm(x, np.where(own == f, 1, -1).astype(np.float32)) for f in range(len(found))]) if len(found) > 1 else None
    duels = {}
    for g in found:
        for i, a in enumerate(g):
            for b in g[i + 1 :]:
                rows = (lang == a) | (lang == b)
                duels[a, b] = svm(x[rows], np.where(lang[rows] == a, 1, -1).astype(np.float32))
    return Model(found, family, duels)


def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = text_bytes(batch.column("text"))
        out: list[bytes] = []
        for a, b in runs(offsets):
            out += [v.tobytes() for v in ngram_vectors(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]).astype(np.float16)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column("lang")], ["vector", "lang"])


def train(docs: DataFrame) -> Model | None:
    """The model from a bounded sample of the documents whose crc32(doc_id) mod 4 is not 2."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(crc_mod("doc_id", 4), F.lit(0)) != 2) & F.col("doc_id").isNotNull())
    keyed = known.select("doc_id", "lang").distinct().withColumn("h", F.xxhash64("doc_id"))
    # hashes below a bound that the count gives, so that no task sends TRAIN_DOCS rows of its own
    share = min(1.0, 2 * TRAIN_DOCS / max(1, keyed.count()))
    most = keyed.where(F.col("h") <= int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else F.lit(True)).orderBy("h", "doc_id").limit(TRAIN_DOCS).select("doc_id")
    rare = keyed.groupBy("lang", F.pmod("h", F.lit(PER_LANG)).alias("cell")).agg(F.min_by("doc_id", F.struct("h", "doc_id")).alias("doc_id")).select("doc_id")
    # at most TRAIN_DOCS + PER_LANG a language ids; of rows that repeat one the least text counts
    sample = known.select("doc_id", "text", "lang").join(F.broadcast(most.union(rare).distinct()), "doc_id").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = sorted((r.lang, bytes(r.vector)) for r in sample.select("text", "lang").mapInArrow(vectors, "vector binary, lang string").collect())
    x = np.array([np.frombuffer(v, np.float16) for _, v in rows], np.float32).reshape(len(rows), DIM)
    return fit(x, np.array([n for n, _ in rows], object))


def predicted(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            texts = batch.column("text")
            ascii_letter = np.concatenate([[0], np.cumsum((lower_ascii(raw) >= 97) & (lower_ascii(raw) <= 122))])
            plain = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
            letters = np.array([bool(p) or any(c.isalpha() for c in (texts[i].as_py() or "")) for i, p in enumerate(plain)], bool)
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if model is not None:
                for a, b in runs(offsets):
                    lang[a:b], score[a:b] = model.predict(ngram_vectors(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                lang[~letters], score[~letters] = "und", 0.0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text, lang): held_out, lang_pred, score."""
    model = train(docs)
    rows = docs.select("doc_id", "text", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(predicted(model), "doc_id long, held_out boolean, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
