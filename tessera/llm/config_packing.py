"""Best-fit packing by a configuration linear program over the length histogram.

Only the histogram of piece lengths (at most max_tokens numbers) reaches the driver, however many
documents there are. The program asks for the least number of sequences such that chosen patterns
(multisets of length classes that fit into one sequence) cover every class's count. Multiplicative
weights solve it: a class's weight falls as it is covered, and each round a knapsack dynamic
program finds the pattern of the greatest weight; by duality it bounds the optimum from below. The
copies are rounded down, then full patterns go once more while they fit. Patterns are filled with exact
lengths, their two shortest places by best fit. Only what that leaves, whose number depends on the
number of patterns and not on that of documents, opens sequences of its own. `solve` tells the share of pieces in the program's sequences, and its covering gap.

The plan says how often each pattern is used; each piece finds its place from its length and its
number among the pieces of this length, so placing is a map. These numbers come from counts by
(length, bucket) and a row number within the bucket, so a length that many pieces share is spread.

Null texts count as empty (the end id alone); texts of more than max_tokens ids are cut, the last
piece may be shorter; rows with equal doc_ids are packed each by itself; an empty table gives no
rows; extra columns are passed by.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import chunks, table, text_bytes, written
from tessera.llm.tokens import word_ids

MAX_TOKENS = 4096
UNITS, ROUNDS, RATE, LEAST, FULL = 256, 6000, 1.0, 4, 0.98
BUCKETS = 512


@dataclass
class Program:
    """The program's solution: patterns (rows, in classes), fractional copies, and a lower bound of their sum."""

    patterns: np.ndarray
    copies: np.ndarray
    bound: float


def knapsack(weights: np.ndarray, limit: np.ndarray, room: int | None = None) -> tuple[np.ndarray, float]:
    """How often each class k (of size k, k from 1) goes into a knapsack (of len(weights), or room) for the greatest weight.

    The dynamic program runs over capacities and lets classes repeat; its value, returned too, is an
    upper bound. A class goes in at most limit[k - 1] times: where that binds, a second pass does
    without the class and the better of both cut patterns stays.
    """
    wide, room = len(weights), len(weights) if room is None else room
    left, chosen, most = np.where(limit > 0, weights, 0.0), np.zeros(wide, np.int64), 0.0
    for turn in range(2):
        best, took = np.zeros(room + 1), np.zeros(room + 1, np.int64)
        down = left[::-1].copy()  # down[wide - k] is class k
        for c in range(1, room + 1):
            value = best[:c] + down[wide - c :]  # class c - j on top of capacity j
            j = int(value.argmax())
            best[c], took[c] = (value[j], c - j) if value[j] > best[c - 1] else (best[c - 1], 0)
        if not turn:
            most = float(best[room])
        pattern, c = np.zeros(wide, np.int64), room
        while c > 0:
            if took[c]:
                pattern[took[c] - 1] += 1
            c -= int(took[c]) or 1
        over = pattern > limit
        pattern = np.minimum(pattern, limit)
        if pattern @ weights > chosen @ weights:
            chosen = pattern
        if not over.any():
            break
        left = np.where(over, 0.0, left)
    return chosen, most


def program(demand: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> Program:
    """Fewest knapsacks of len(demand) that hold demand[k - 1] pieces of each size k, as a covering program.

    Multiplicative weights: a class of size k weighs k * exp(-rate * its cover), and the knapsack
    prices the pattern of the greatest weight among the classes not covered yet. It is used for half
    of what its scarcest class still needs, for all of it once that is under 1 / LEAST of the class,
    and its classes' weights fall. So covers rise evenly and never over one; each class ends after
    about log2(LEAST) rounds of its own. Every knapsack gives a lower bound by duality.
    """
    size, d = np.arange(1, len(demand) + 1), np.maximum(demand, 1).astype(float)
    cover, bound, copies = np.where(demand > 0, 0.0, 1.0), 0.0, Counter()
    for _ in range(rounds):
        open_ = cover < 1
        if not open_.any():
            break
        weight = np.where(open_, size * np.exp(-rate * cover), 0.0)
        found, most = knapsack(weight, demand)
        bound = max(bound, float(weight @ demand) / most)
        on = found > 0
        needs = (1 - cover[on]) * d[on] / found[on]
        scarcest = int(needs.argmin())
        whole = 1 - cover[on][scarcest] <= 1 / LEAST
        copies[found.tobytes()] += float(needs[scarcest]) * (1 if whole else 0.5)
        cover[on] += found[on] * needs[scarcest] * (1 if whole else 0.5) / d[on]
        cover[cover > 1 - 1e-9] = 1
    patterns = np.array([np.frombuffer(p, np.int64) for p in copies], np.int64).reshape(-1, len(demand))
    return Program(patterns, np.array(list(copies.values()), float), bound)


def whole_copies(found: Program, demand: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(pattern, whole copies) that never ask for more of a class than there is.

    The whole parts stay; then patterns that are FULL go once more while they fit, in order of
    their fractions.
    """
    left, out = demand.astype(np.int64).copy(), []
    full = found.patterns @ np.arange(1, len(left) + 1) >= FULL * len(left)
    for part in (lambda x, i: int(x), lambda x, i: int(full[i])):
        for i in np.argsort(-(found.copies - np.floor(found.copies)), kind="stable").tolist():
            on = found.patterns[i] > 0
            n = min(part(found.copies[i], i), int((left[on] // found.patterns[i][on]).min()))
            if n:
                out.append((found.patterns[i], n))
                left -= n * found.patterns[i]
    return out


def class_of(length: np.ndarray | int, unit: int) -> np.ndarray | int:
    """Lengths as whole numbers of units, rounded to the nearest, at least one."""
    return np.maximum(1, (length + unit // 2) // unit)


@dataclass
class Packing:
    """The plan, and how it came about: pieces in sequences of the program, its fractional sequences and their bound."""

    plan: list[tuple[tuple[int, ...], int]]
    by_program: int
    fractional: float
    bound: float


def solve(histogram: dict[int, int], room: int = MAX_TOKENS) -> Packing:
    """(pattern, copies) that use each length exactly as often as the histogram says.

    Lengths from 1 to room; others are an error. The program sees lengths in units of room / UNITS,
    rounded to the nearest. Its patterns are filled with exact lengths from long to short: all places
    but a pattern's last two (no place where a unit is one token) are taken in runs of equal lengths from its classes, and what they leave
    is filled by best fit from all that remains, so that rounding costs next to nothing. A run ends with a
    pattern's copies or with a length, so the plan's size depends on room and the program alone.
    """
    if not histogram:
        return Packing([], 0, 0.0, 0.0)
    if max(histogram) > room or min(histogram) < 1:
        raise ValueError(f"lengths must lie from 1 to {room}")
    unit = max(1, room // UNITS)
    demand = np.zeros(-(-room // unit), np.int64)
    for n, c in histogram.items():
        demand[min(len(demand), int(class_of(n, unit))) - 1] += c
    found = program(demand)
    stock: dict[int, list[list[int]]] = defaultdict(list)  # of each class its lengths with counts, short to long
    for n in sorted(histogram):
        stock[min(len(demand), int(class_of(n, unit)))].append([n, histogram[n]])
    left = dict(histogram)
    begun: list[tuple[list[int], int]] = []
    for made, copies in whole_copies(found, demand):
        places = [k + 1 for k in np.flatnonzero(made)[::-1].tolist() for _ in range(int(made[k]))]
        runs = [([], copies)]
        for k in places[: max(1, len(places) - (2 if unit > 1 else 0))]:
            cut = []
            for held, n in runs:
                while n:
                    while stock[k] and not stock[k][-1][1]:
                        stock[k].pop()
                    if not stock[k]:
                        cut.append((held, n))
                        break
                    size, there = stock[k][-1]
                    m = min(n, there)
                    stock[k][-1][1] -= m
                    left[size] -= m
                    cut.append(([*held, size], m))
                    n -= m
            runs = cut
        for held, n in runs:
            while sum(held) > room:  # rounding to the nearest can overfill; the last piece goes back
                left[held[-1]] += n
                stock[min(len(demand), int(class_of(held[-1], unit)))].append([held[-1], n])
                held = held[:-1]
            begun.append((held, n))
    plan: Counter = Counter()
    left = {n: c for n, c in left.items() if c}
    by_program = 0
    for held, n in sorted(begun, key=lambda x: -sum(x[0])):
        for pattern, copies in best_fit(left, room, held, n).items():
            plan[pattern] += copies
            by_program += len(pattern) * copies
    for pattern, copies in best_fit(left, room).items():
        plan[pattern] += copies
    return Packing(sorted(plan.items()), by_program, float(found.copies.sum()), found.bound)


def best_fit(left: dict[int, int], room: int, held: list[int] | None = None, most: int | None = None) -> Counter:
    """Best-fit decreasing on a histogram, which it uses up: equal patterns are made together.

    With held, `most` sequences that begin with these lengths are filled; without, as many as it takes.
    """
    plan: Counter = Counter()
    sizes = sorted(left)
    while sizes and most is None or most:
        pattern, gap, n_left = list(held or ()), room - sum(held or ()), Counter()
        while sizes:
            at = bisect_left(sizes, gap + 1) - 1
            while at >= 0 and n_left[sizes[at]] >= left[sizes[at]]:
                at -= 1
            if at < 0:
                break
            s = sizes[at]
            n = min(gap // s, left[s] - n_left[s])
            pattern += [s] * n
            n_left[s] += n
            gap -= n * s
        copies = min([left[s] // n for s, n in n_left.items()] + ([] if most is None else [most]))
        plan[tuple(pattern)] += copies
        most = None if most is None else most - copies
        for s, n in n_left.items():
            left[s] -= n * copies
            if not left[s]:
                del left[s], sizes[bisect_left(sizes, s)]
    return plan


def places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: the first number, first sequence, offset of each of its slots.

    Piece number r of a length takes the last slot whose first number is at most r; its sequence is
    the slot's first sequence plus r minus the slot's first number.
    """
    slots, used, sequence = defaultdict(list), Counter(), 0
    for pattern, copies in plan:
        offset = 0
        for n in pattern:
            slots[n].append((used[n], sequence, offset))
            used[n] += copies
            offset += n
        sequence += copies
    return {n: tuple(np.array(x, np.int64) for x in zip(*s)) for n, s in slots.items()}


def cut(path: str, room: int):
    """A mapInArrow function: pieces (doc_id, piece, start, length, ids_crc32, bucket)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, base = word_ids(path), TaskContext.get().partitionId() * 7919
        for batch in batches:
            texts, docs = batch.column("text"), batch.column("doc_id").cast(pa.int64())
            _, offsets = text_bytes(texts)
            for a, b in chunks(offsets):
                ids, at = words.encode(texts.slice(a, b - a))
                raw, n = ids.tobytes(), np.diff(at)
                of = np.repeat(np.arange(b - a), -(-n // room))
                piece = np.arange(len(of)) - np.searchsorted(of, of)
                start = piece * room
                length = np.minimum(n[of] - start, room)
                edge = 4 * (at[of] + start)
                crc = np.array([zlib.crc32(raw[x:y]) for x, y in zip(edge.tolist(), (edge + 4 * length).tolist())], np.int64)
                # pieces of one length are spread by where they stand, whatever they hold
                bucket = (base + np.arange(len(of))) % BUCKETS
                yield pa.RecordBatch.from_arrays([docs.slice(a, b - a).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc), pa.array(bucket, pa.int32())], ["doc_id", "piece", "start", "length", "ids_crc32", "bucket"])

    return run


def pack(docs: DataFrame, path: str | None = None, room: int = MAX_TOKENS) -> DataFrame:
    """One row per piece of docs(doc_id, text) with its sequence_id and its offset there."""
    spark = docs.sparkSession
    path = path or public_tokenizers.path("word_bpe_49k.json")
    pieces = written(docs.select("doc_id", "text").mapInArrow(cut(path, room), "doc_id long, piece int, start long, length long, ids_crc32 long, bucket int"), "pieces")
    counts = written(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {int(r.length): int(r.n) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `room` rows
    slots = spark.sparkContext.broadcast(places(solve(histogram, room).plan))  # its size depends on room and ROUNDS alone
    first = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    numbered = pieces.withColumn("nth", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = numbered.join(first, ["length", "bucket"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            values, starts = np.unique(length[order], return_index=True)
            for n, rows in zip(values.tolist(), np.split(order, starts[1:])):
                begin, first_sequence, at = slots.value[n]
                i = np.searchsorted(begin, number[rows], "right") - 1
                sequence[rows] = first_sequence[i] + number[rows] - begin[i]
                offset[rows] = at[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_config_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
