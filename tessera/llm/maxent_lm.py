"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

A token's chance is that of its class given the context, times that of its head within the class
given the last unit, times, for words that are no head, its add-one share among the class's rest.

Classes: words are put into ENDINGS cells by their last two bytes, and the cells into CLASSES classes
of about equal counts, so that endings with like neighbours come together (halving along the first
principal direction of the cells' follower shares, again and again; one small matrix of counts). So
unseen words have a class too. Heads are the most frequent words of a class, HEADS at most; a unit is
a class with a head or with its rest.

The class model is log-linear over features of the DISTANCE last tokens: the class at each distance
(skips), and the last token's row (its unit, or a hash of the word among ROWS rows). The head model is
log-linear over the last unit, for each class. Both start from the training tokens' own counts; the
class model then takes ROUNDS gradient steps, each over all training documents. Observed counts and a
step's expected counts are summed by Spark tasks, first in SALTS partial sums; the gradient of a weight
is scaled by its row's expected count, and features share a step among them.

Word counts come from all training tokens and grow with them. Documents are read in batches of about
BATCH_BYTES. A batch asks for each of its distinct words once, counts are summed where the askers of
a word meet (at most one row a batch), and the answers go back to the batch, which scores its
documents in sparse numpy arrays. Nothing that grows with the vocabulary is collected or broadcast.

Tokens: runs without ASCII white space, A-Z lower-cased, then one end token. Null and empty texts
have the end token alone. Rows with a null doc_id count as training rows; repeated rows are trained
on and scored as often as they occur. An empty table gives no rows. Extra columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import U64, chunks, crc_mod, lower_ascii, mix, slice_hashes, table, text_bytes, word_spans, written

ENDINGS, CLASSES, HEADS, DISTANCE, ROUNDS = 1024, 64, 15, 4, 2
UNITS = CLASSES * (HEADS + 1)
ROWS = 8192  # the first UNITS of them are units
FREQUENT = 2048
SALTS, BLOCK_CELLS = 64, 1 << 17
BATCH_BYTES, CHUNK = 12 << 20, 1 << 18
PART, SLICE, WIDE = 1 << 16, 1 << 10, 96  # tokens at a time, tokens within the cache, members of a large group
SMOOTH, STEP_SMOOTH, HEAD_SMOOTH = 20.0, 40.0, 8.0
END, START = mix(np.array([0x5EED, 0xBE61], U64))
END_CELL = 0


def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a batch number: rows of one task, up to about BATCH_BYTES of text."""
    number, held = TaskContext.get().partitionId() << 24, 0
    for batch in batches:
        _, offsets = text_bytes(batch.column("text"))
        for a, b in chunks(offsets, BATCH_BYTES // 4):
            if held > BATCH_BYTES:
                number, held = number + 1, 0
            held += int(offsets[b] - offsets[a])
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(b - a, number))], [*part.schema.names, "batch"])


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and ending cells of all rows' tokens, each row with its end token, and the n + 1 places where rows begin."""
    low = lower_ascii(raw)
    start, end = word_spans(raw, offsets)
    h, at = slice_hashes(low, start, end), np.searchsorted(start, offsets)
    last = low[end - 1].astype(U64) if len(end) else np.zeros(0, U64)
    two = last << U64(8) | np.where(end - start > 1, low[np.maximum(end - 2, 0)], 0).astype(U64) if len(end) else last
    cell = (mix(two + U64(1)) % U64(ENDINGS - 1)).astype(np.int64) + 1
    return np.insert(h, at[1:], END), np.insert(cell, at[1:], END_CELL), at + np.arange(len(at))


def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct word of a batch with its cell and its count in the batch's training rows."""
    now, parts = None, []

    def close() -> pa.RecordBatch:
        h, c, n = (np.concatenate(x) for x in zip(*parts))
        h, first, back = np.unique(h, return_index=True, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), now)), pa.array(h.view(np.int64)), pa.array(c[first].astype(np.int32)), pa.array(np.bincount(back, n, len(h)).astype(np.int64))], ["batch", "word", "cell", "n"])

    for batch in batches:
        raw, offsets = text_bytes(batch.column("text"))
        number, train = batch.column("batch").to_numpy(), ~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        for a, b in chunks(offsets):
            for x in np.split(np.arange(a, b), np.flatnonzero(np.diff(number[a:b])) + 1):
                if parts and number[x[0]] != now:
                    yield close()
                    parts = []
                now = number[x[0]]
                o = offsets[x[0] : x[-1] + 2]
                h, cell, at = tokens(raw[o[0] : o[-1]], o - o[0])
                word, first, back = np.unique(h, return_index=True, return_inverse=True)
                parts.append((word, cell[first], np.bincount(back, np.repeat(train[x], np.diff(at)), len(word))))
    if parts:
        yield close()


def _blocks(total: np.ndarray, task: int, kind: str) -> Iterator[pa.RecordBatch]:
    flat = total.ravel()
    for i in range(0, len(flat), BLOCK_CELLS):
        yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK_CELLS], pa.int32()), pa.array([task % SALTS], pa.int32()), pa.array([flat[i : i + BLOCK_CELLS].astype(kind).tobytes()], pa.binary())], ["block", "salt", "total"])


def adder(kind: str = "<f8"):
    """A mapInArrow function that sums the blocks of this kind that reach a task, one array of doubles for each number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for block, salt, total in zip(*(batch.column(c).to_pylist() for c in ("block", "salt", "total"))):
                x = np.frombuffer(total, kind).astype(float)
                sums[block, salt] = sums[block, salt] + x if (block, salt) in sums else x
        for (block, salt), x in sorted(sums.items()):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([salt], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["block", "salt", "total"])

    return run


def collected(rows: DataFrame, gather, cells: int, kind: str = "<f8", fold=lambda total: total) -> np.ndarray:
    """The sum over all tasks of what gather adds up, an array of a fixed number of cells; tasks send its fold as kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            for a, b in chunks(offsets, CHUNK):
                gather(total, *tokens(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
        yield from _blocks(fold(total), TaskContext.get().partitionId(), kind)

    schema = "block int, salt int, total binary"
    part = rows.select("text").mapInArrow(run, schema).repartition("block", "salt").mapInArrow(adder(kind), schema)
    whole = part.withColumn("salt", F.lit(0)).repartition("block").mapInArrow(adder(), schema)
    total = fold(np.zeros(cells))
    for r in whole.collect():
        x = np.frombuffer(bytes(r.total), "<f8")
        total[r.block * BLOCK_CELLS : r.block * BLOCK_CELLS + len(x)] += x
    return total


def before(x: np.ndarray, at: np.ndarray, distance: int, none: int) -> np.ndarray:
    """What stands `distance` tokens before each token of its row, none at the row's start."""
    out = np.full(len(x), none, x.dtype)
    out[distance:] = x[:-distance]
    for d in range(distance):
        first = at[:-1] + d
        out[first[first < at[1:]]] = none
    return out


def neighbours(total: np.ndarray, h: np.ndarray, cell: np.ndarray, at: np.ndarray) -> None:
    last = before(cell, at, 1, END_CELL)
    total += np.bincount(last * ENDINGS + cell, minlength=len(total))


def classes_of(pairs: np.ndarray) -> np.ndarray:
    """The class of each ending cell from counts of (last cell, cell), of about equal counts."""
    share = np.sqrt(pairs / np.maximum(pairs.sum(1, keepdims=True), 1))
    count = pairs.sum(0) + 1e-3
    groups = [np.arange(len(pairs))]
    while len(groups) < CLASSES:
        # the heaviest group that can be halved
        i = max(range(len(groups)), key=lambda i: (len(groups[i]) > 1, float(count[groups[i]].sum())))
        g = groups.pop(i)
        x = share[g] - np.average(share[g], axis=0, weights=count[g])
        way = np.linspace(-1, 1, x.shape[1])
        for _ in range(30):
            way = x.T @ ((x @ way) * count[g])
            way /= max(np.linalg.norm(way), 1e-12)
        order = g[np.lexsort((g, x @ way))]
        half = np.cumsum(count[order])
        cut = int(np.clip(np.searchsorted(half, half[-1] / 2), 1, len(order) - 1))
        groups += [order[:cut], order[cut:]]
    out = np.zeros(len(pairs), np.int64)
    for k, g in enumerate(groups):
        out[g] = k
    return out


@dataclass
class Words:
    """Which class and which head a token is."""

    of_cell: np.ndarray
    hashes: np.ndarray  # of the heads, ascending
    heads: np.ndarray  # their numbers within their classes
    slots: np.ndarray | None = None

    def units(self, h: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class, and unit (class and head, or HEADS for the rest)."""
        kind, head = self.of_cell[cell], np.full(len(h), HEADS, np.int64)
        if len(self.hashes):
            if self.slots is None:
                self.slots = np.zeros(1 << 16, bool)
                self.slots[(self.hashes >> U64(48)).astype(np.int64)] = True
            some = np.flatnonzero(self.slots[(h >> U64(48)).astype(np.int64)])
            i = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
            hit = self.hashes[i] == h[some]
            head[some[hit]] = self.heads[i[hit]]
        return kind, kind * (HEADS + 1) + head

    def features(self, h: np.ndarray, cell: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """Class, unit, last unit, classes at distances 1 to DISTANCE (CLASSES for none), the last token's row."""
        kind, unit = self.units(h, cell)
        row = np.where(unit % (HEADS + 1) < HEADS, unit, UNITS + (h % U64(ROWS - UNITS - 1)).astype(np.int64))
        skips = [before(kind, at, d, CLASSES) for d in range(1, DISTANCE + 1)]
        return kind, unit, before(unit, at, 1, UNITS), skips, before(row, at, 1, ROWS - 1)


# cells of one array: class counts at each distance, by row, then heads by last unit
_SKIP, _ROW, _HEAD = DISTANCE * (CLASSES + 1) * CLASSES, ROWS * CLASSES, (UNITS + 1) * UNITS


def observed(words):
    def gather(total: np.ndarray, h: np.ndarray, cell: np.ndarray, at: np.ndarray) -> None:
        kind, unit, last, skips, row = words.value.features(h, cell, at)
        for d, c in enumerate(skips):
            part = total[d * (CLASSES + 1) * CLASSES : (d + 1) * (CLASSES + 1) * CLASSES]
            part += np.bincount(c * CLASSES + kind, minlength=len(part))
        np.add.at(total, _SKIP + row * CLASSES + kind, 1.0)
        np.add.at(total, _SKIP + _ROW + last * UNITS + unit, 1.0)

    return gather


# cells of expected counts: class counts by pair of classes at two distances, then by row
_PAIRS = (CLASSES + 1) ** 2
_PAIR = DISTANCE // 2 * _PAIRS * CLASSES


def factors(weights: list[np.ndarray]) -> list[np.ndarray]:
    """The powers of the weights, to be multiplied: one table for each pair of classes at two distances, then the rows'."""
    both = [(a[:, None] + b[None]).reshape(-1, CLASSES) for a, b in zip(weights[:-1:2], weights[1:-1:2])]
    # a context's chances are the same whatever is taken off all classes
    return [np.exp(w - w.max(1, keepdims=True)).astype(np.float32) for w in [*both, weights[-1]]]


def contexts(skips: list[np.ndarray], row: np.ndarray) -> list[np.ndarray]:
    """Each token's place in each table of factors."""
    return [*(a * (CLASSES + 1) + b for a, b in zip(skips[::2], skips[1::2])), row]


def chances(tables: list[np.ndarray], places: list[np.ndarray]) -> np.ndarray:
    out, ones = np.empty((len(places[0]), CLASSES), np.float32), np.ones(CLASSES, np.float32)
    for a in range(0, len(out), SLICE):
        p = out[a : a + SLICE]
        tables[-1].take(places[-1][a : a + SLICE], axis=0, out=p, mode="clip")
        for table, place in zip(tables[:-1], places):
            p *= table.take(place[a : a + SLICE], axis=0)
        p /= (p @ ones)[:, None]
    return out


def class_chances(weights: list[np.ndarray], skips: list[np.ndarray], row: np.ndarray) -> np.ndarray:
    """weights: one array for each distance, then the rows' (with the bias)."""
    return chances(factors(weights), contexts(skips, row))


def summed(rows: np.ndarray, values: np.ndarray, into: np.ndarray) -> None:
    """into[r] += values where rows == r."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    sorted_rows = rows[order]
    first = np.flatnonzero(np.r_[True, sorted_rows[1:] != sorted_rows[:-1]])
    size = np.diff(np.r_[first, len(rows)])
    wide = size >= WIDE
    for a, n in zip(first[wide].tolist(), size[wide].tolist()):
        into[sorted_rows[a]] += np.ones(n, np.float32) @ values.take(order[a : a + n], axis=0)
    # the other groups, large ones first, so that those with a further member are always the first ones
    group = np.flatnonzero(~wide)
    group = group[np.argsort(-size[group], kind="stable")]
    for a in range(0, len(group), SLICE):
        at, n = first[group[a : a + SLICE]], size[group[a : a + SLICE]]
        sums = values.take(order[at], axis=0)
        for i in range(1, int(n[0])):
            more = int(np.searchsorted(-n, -i))
            sums[:more] += values.take(order[at[:more] + i], axis=0)
        into[sorted_rows[at]] += sums


def expected(words, model):
    def gather(total: np.ndarray, h: np.ndarray, cell: np.ndarray, at: np.ndarray) -> None:
        _, _, _, skips, row = words.value.features(h, cell, at)
        places = contexts(skips, row)
        into = [*total[:_PAIR].reshape(-1, _PAIRS, CLASSES), total[_PAIR:].reshape(ROWS, CLASSES)]
        for a in range(0, len(row), PART):
            part = [x[a : a + PART] for x in places]
            p = chances(model.value, part)
            for place, sums in zip(part, into):
                summed(place, p, sums)

    return gather


def by_distance(total: np.ndarray) -> np.ndarray:
    """Expected counts by pairs of classes as counts by the class at each distance."""
    pairs = total[:_PAIR].reshape(-1, CLASSES + 1, CLASSES + 1, CLASSES)
    return np.concatenate([*(x.ravel() for p in pairs for x in (p.sum(1), p.sum(0))), total[_PAIR:]])


def _tables(cells: np.ndarray) -> list[np.ndarray]:
    return [*cells[:_SKIP].reshape(DISTANCE, CLASSES + 1, CLASSES), cells[_SKIP : _SKIP + _ROW].reshape(ROWS, CLASSES)]


def train(rows: DataFrame, words, shares: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Factors of the class weights, and log10 chances of the heads given class and last unit, from the training rows."""
    spark = rows.sparkSession
    counts = collected(rows, observed(words), _SKIP + _ROW + _HEAD)
    seen, pull = _tables(counts), 1 / (DISTANCE + 1)
    prior = SMOOTH * shares
    # a feature alone would take the whole of its log ratio; together they take a part each
    weights = [pull * (np.log(n + prior) - np.log((n.sum(1, keepdims=True) + SMOOTH) * shares)) for n in seen]
    weights[-1] += np.log(shares)
    prior = STEP_SMOOTH * shares
    for _ in range(ROUNDS):
        model = spark.sparkContext.broadcast(factors(weights))
        want = _tables(collected(rows, expected(words, model), _PAIR + _ROW, "<f4", by_distance))
        weights = [w + 2 * pull * np.clip(np.log((n + prior) / (e + prior)), -2, 2) for w, n, e in zip(weights, seen, want)]
    heads = counts[_SKIP + _ROW :].reshape(UNITS + 1, CLASSES, HEADS + 1)
    overall = heads.sum(0, keepdims=True) + 1e-3
    overall /= overall.sum(2, keepdims=True)
    chance = (heads + HEAD_SMOOTH * overall) / (heads.sum(2, keepdims=True) + HEAD_SMOOTH)
    return factors(weights), np.log10(chance).reshape(UNITS + 1, UNITS).astype(np.float32)


def finder(word: np.ndarray):
    """A function from hashes to their places in word, which is ascending and holds them all."""
    shift = U64(64 - len(word).bit_length())
    begin = np.r_[0, np.cumsum(np.bincount((word >> shift).astype(np.int64), minlength=1 << len(word).bit_length()))]

    def find(h: np.ndarray) -> np.ndarray:
        i = begin[(h >> shift).astype(np.int64)]
        left = np.flatnonzero(word[i] != h)
        while len(left):
            i[left] += 1
            left = left[word[i[left]] != h[left]]
        return i

    return find


def scored(words, model, size: tuple[int, int], rest: np.ndarray):
    """A function of a batch's rows and its word counts to the rows' scores; rest holds each class's denominator."""
    n_all, v_all = size

    def run(left, right):
        raw, offsets = text_bytes(left.column("text"))
        word = right.column("word").to_numpy().view(U64)
        order = np.argsort(word)
        word, count = word[order], right.column("c").to_numpy()[order]
        find = finder(word)
        tables, heads = model.value
        out = []
        for a, b in chunks(offsets, CHUNK):
            h, cell, at = tokens(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            c = count[find(h)]
            kind, unit, last, skips, row = words.value.features(h, cell, at)
            places, p = contexts(skips, row), np.empty(len(h))
            for i in range(0, len(h), PART):
                own = kind[i : i + PART]
                p[i : i + PART] = chances(tables, [x[i : i + PART] for x in places])[np.arange(len(own)), own]
            own = np.log10(np.maximum(p, 1e-30)) + heads[last, unit]
            own += np.where(unit % (HEADS + 1) == HEADS, np.log10((c + 1) / rest[kind]), 0.0)
            base = np.log10((c + 1) / (n_all + v_all + 1))
            out.append((np.diff(at), np.add.reduceat((c > 0).astype(np.int64), at[:-1]), np.add.reduceat(base, at[:-1]), np.add.reduceat(own, at[:-1])))
        n, known, base, own = (np.concatenate(x) for x in zip(*out)) if out else [np.zeros(0)] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        values = [n.astype(np.int64), known.astype(np.int64), np.full(len(n), n_all, np.int64), base, own]
        return pa.table([left.column("doc_id"), left.column("held_out"), *(pa.array(v, k) for v, k in zip(values, kinds))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame) -> DataFrame:
    """One row of scores for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    held = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False)).alias("held_out")
    rows = written(docs.select("doc_id", "text", held).mapInArrow(batched, "doc_id long, text string, held_out boolean, batch long"), "lm-rows")
    asks = rows.mapInArrow(asked, "batch long, word long, cell int, n long").groupBy("batch", "word").agg(F.first("cell").alias("cell"), F.sum("n").alias("n"))
    by_word = Window.partitionBy("word")
    answers = asks.withColumn("c", F.sum("n").over(by_word)).withColumn("nth", F.row_number().over(by_word.orderBy("batch")))
    answers = written(answers.select("batch", "word", "cell", "c", "nth"), "lm-answers")
    each = answers.where("nth = 1 AND c > 0")
    cells = each.groupBy("cell").agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect()  # at most ENDINGS rows
    n_all, v_all = sum(r.n for r in cells), sum(r.v for r in cells)
    training = rows.where("NOT held_out")
    of_cell = classes_of(collected(training, neighbours, ENDINGS * ENDINGS).reshape(ENDINGS, ENDINGS))
    mass, rest = np.zeros(CLASSES), np.ones(CLASSES)
    for r in cells:
        mass[of_cell[r.cell]] += r.n
        rest[of_cell[r.cell]] += r.n + r.v
    taken, heads = np.zeros(CLASSES, np.int64), []
    # words that make up a ten-thousandth, so at most ten thousand rows, of which the first FREQUENT count
    often = each.where(F.col("c") * 10_000 >= n_all).select("word", "cell", "c").orderBy(F.desc("c"), "word").limit(FREQUENT).collect()
    for r in often:
        k = of_cell[r.cell]
        if taken[k] < HEADS:
            heads.append((np.int64(r.word).astype(U64), taken[k]))
            taken[k] += 1
            rest[k] -= r.c + 1
    heads.sort()
    words = spark.sparkContext.broadcast(Words(of_cell, np.array([h for h, _ in heads], U64), np.array([k for _, k in heads], np.int64)))
    model = spark.sparkContext.broadcast(train(training, words, (mass + 1) / (mass + 1).sum()))
    return rows.groupBy("batch").cogroup(answers.select("batch", "word", "c").groupBy("batch")).applyInArrow(scored(words, model, (n_all, v_all), rest), OUT)


def op9_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
