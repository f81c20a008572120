"""Exact repeated-passage removal with a logarithmic family of suffix arrays.

A byte goes if it lies in a LENGTH-byte string that starts anywhere else too. Suffixes matter only
by their first LENGTH bytes (windows), and that far the suffix arrays are ordered by their bytes,
with the common prefix of each suffix and the one before it.

Most windows never need to be indexed. Each window has an anchor, its least GRAM-byte hash (the
leftmost one); equal windows have equal anchors at equal places. The consecutive windows of one
anchor are its context. Every map task is a batch: it drops repeats of whole contexts within the
batch, then the contexts meet by anchor. An anchor found once settles its windows as unique, a
context found twice (128 bits of its bytes tell) settles all its windows as repeated. What is left
are contexts whose anchor occurs in different surroundings, that is near edits and passage borders.

These contexts' bytes go into the family: they arrive in batches, each batch gets its suffix array,
which is merge-scanned against the arrays (levels) already there for matches of LENGTH bytes, and
levels of about equal size are merged, so sizes grow geometrically and a suffix is moved a
logarithmic number of times. Tasks are split by anchor. An anchor whose contexts would make its
task uneven (over half of a task's share, HOT at least and HOT_MOST at most) is split further: map
tasks first index their share, each distinct window leaves a task once, and those meet by 128 bits
of their bytes. Both ways give the same spans.

Matches never cross rows. Null and empty texts, and those under LENGTH bytes, lose nothing. Rows
that repeat a doc_id and its text are each other's repeats and get equal results. What is left of a
UTF-8 text need not be UTF-8, as spans are bytes. Extra columns are passed by, under any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import U64, chunks, fresh, mix, slice_hashes, table, text_bytes, written

LENGTH, GRAM = 200, 48
HOT, HOT_MOST = 400, 100_000
BATCH_ANCHORS, BATCH_BYTES = 2_000_000, 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, U64)
    steps[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(steps, dtype=U64)


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of gram bytes. They choose anchors only: alike hashes of other bytes cost time, no result."""
    total = np.zeros(len(raw) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[raw] * _powers(_BASE, len(raw)), dtype=U64, out=total[1:])
        n = len(raw) - gram + 1
        return mix((total[gram:] - total[:n]) * _powers(_INVERSE, n))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, from minima up to and away from block borders."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, ~U64(0), U64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def contexts(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each anchor: row, first and last window start within the row, anchor hash, and two hashes of its context."""
    n = len(raw)
    z, u = np.zeros(0, np.int64), np.zeros(0, U64)
    if n < length:
        return z, z, z, u, u, u
    at = np.arange(n - gram + 1)
    grams = gram_hashes(raw, gram)
    low = U64(int(n).bit_length())
    packed = (grams >> low << low) | at.astype(U64)
    place = (sliding_min(packed, length - gram + 1) & ((U64(1) << low) - U64(1))).astype(np.int64)
    start = np.arange(n - length + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(start)]
    inside = start + length <= offsets[row + 1]
    start, place, row = start[inside], place[inside], row[inside]
    if not len(start):
        return z, z, z, u, u, u
    new = np.r_[True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(start)] - 1
    row = row[first]
    context = [slice_hashes(raw, start[first], start[last] + length, seed) for seed in (0, 1)]
    return row, start[first] - offsets[row], start[last] - offsets[row], grams[place[first]], *context


def parted(offsets: np.ndarray, length: int, most: int):
    """(first byte, end byte, first row, end row) of runs of rows; a row of over `most` bytes comes in
    parts that overlap by length - 1 bytes, so that each window lies in one part alone."""
    for a, b in chunks(offsets, most):
        x, y = int(offsets[a]), int(offsets[b])
        if b - a > 1 or y - x <= 2 * most:
            yield x, y, a, b
            continue
        for p in range(x, y - length + 1, most):
            yield p, min(y, p + most + length - 1), a, b


KEPT, ALONE, MIXED, MARK = 0, 1, 2, 3


MET = "key long, anchor long, c1 long, c2 long, uid long, uid2 long, lo int, hi int, multi boolean, kind byte"


def scanned(length: int, gram: int):
    """A mapInArrow function from (uid, uid2, text) to anchor rows; a task's rows are one batch.

    KEPT rows repeat a context of the batch and only pass through. ALONE: the batch's one context of its anchor, keyed by
    the anchor. MIXED: one of several, keyed by the context, with a MARK row keyed by the anchor.
    """

    def batch_rows(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*parts)]
        uid, uid2, lo, hi, anchor, c1, c2 = columns
        order = np.lexsort((lo, uid2, uid, c2, c1, anchor))
        uid, uid2, lo, hi, anchor, c1, c2 = (x[order] for x in columns)
        new_anchor = np.r_[True, anchor[1:] != anchor[:-1]]
        new = new_anchor | np.r_[True, (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])]
        first = np.flatnonzero(new)
        several = np.diff(np.r_[first, len(new)]) > 1
        kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_anchor))
        mixed = np.repeat(kinds > 1, kinds)
        kind = np.full(len(new), KEPT, np.int8)
        kind[first] = np.where(mixed, MIXED, ALONE)
        multi = np.zeros(len(new), bool)
        multi[first] = several
        key = np.where(kind == MIXED, c1, anchor)
        key[kind == KEPT] = mix(uid.view(U64) + lo.astype(U64))[kind == KEPT]  # met by no other context
        marks = np.unique(anchor[first][mixed])
        k, z = len(marks), np.zeros(len(marks), np.int64)
        wide = lambda a, b: pa.array(np.concatenate([a.view(np.int64), b.view(np.int64)]))
        hidden = np.r_[np.zeros(len(new), bool), np.ones(k, bool)]
        none = lambda c: pa.array(np.concatenate([c.view(np.int64), z]), mask=hidden)
        narrow = lambda a, b, t: pa.array(np.concatenate([a, b]).astype(t))
        return pa.RecordBatch.from_arrays(
            [wide(key, marks), wide(anchor, marks), none(c1), none(c2), wide(uid, z), wide(uid2, z), narrow(lo, z, np.int32), narrow(hi, z, np.int32), narrow(multi, z > 0, bool), narrow(kind, np.full(k, MARK), np.int8)],
            ["key", "anchor", "c1", "c2", "uid", "uid2", "lo", "hi", "multi", "kind"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            uid, uid2 = batch.column("uid").to_numpy(), batch.column("uid2").to_numpy()
            for x, y, a, b in parted(offsets, length, BATCH_BYTES):
                inner = np.clip(offsets[a : b + 1], x, y) - x
                row, lo, hi, *hashes = contexts(raw[x:y], inner, length, gram)
                if len(row):
                    shift = x + inner[row] - offsets[a + row]
                    parts.append((uid[a + row], uid2[a + row], lo + shift, hi + shift, *hashes))
                    held += len(row)
            if held > BATCH_ANCHORS:
                yield batch_rows(parts)
                parts, held = [], 0
        if parts:
            yield batch_rows(parts)

    return run


def _word(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on, as numbers that stand in the order of the bytes."""
    return np.ndarray((len(text) - 7,), ">u8", text.data, strides=(1,))[at].astype(U64)


def _steps(length: int) -> list[int]:
    """Where to read eight bytes so that all of a window is seen, in order."""
    return [*range(0, length - 8, 8), length - 8]


def suffix_array(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts in the order of their first length bytes (8 at least), and how many bytes (in steps
    of eight, length if all) each shares with the one before it."""
    order, shared = np.argsort(key := _word(text, starts), kind="stable"), np.zeros(len(starts), np.int64)
    key = key[order]
    same = np.r_[False, key[1:] == key[:-1]] if len(key) else np.zeros(0, bool)
    for step in _steps(length)[1:]:
        shared[same] = step
        inside = same | np.r_[same[1:], False]
        some = np.flatnonzero(inside)
        if not len(some):
            break
        group = np.cumsum(~same[some])
        key = _word(text, starts[order[some]] + step)
        again = np.lexsort((key, group))
        order[some], key, group = order[some][again], key[again], group[again]
        same[some] = np.r_[False, (key[1:] == key[:-1]) & (group[1:] == group[:-1])]
    shared[same] = length
    return starts[order], shared


@dataclass
class Level:
    """A suffix array of distinct windows over its own text."""

    text: np.ndarray
    at: np.ndarray  # starts, in the order of their windows
    key: np.ndarray  # the first eight bytes of each
    owner: np.ndarray  # (2, n): uid and uid2
    place: np.ndarray
    done: np.ndarray  # known to repeat

    def scan(self, text: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each window text[at : at + length] how many of the level's come before it, and whether it is the next one."""
        first = _word(text, at)
        lo, hi = np.searchsorted(self.key, first, "left"), np.searchsorted(self.key, first, "right")
        for step in _steps(length)[1:]:
            live = np.flatnonzero(hi > lo)
            if not len(live):
                break
            goal, edges = _word(text, at[live] + step), []
            for upper in (False, True):
                a, b = lo[live].copy(), hi[live].copy()
                while len(open_ := np.flatnonzero(a < b)):
                    m = (a[open_] + b[open_]) >> 1
                    there = _word(self.text, self.at[m] + step)
                    ahead = there <= goal[open_] if upper else there < goal[open_]
                    a[open_[ahead]] = m[ahead] + 1
                    b[open_[~ahead]] = m[~ahead]
                edges.append(a)
            lo[live], hi[live] = edges
        return lo, hi > lo


def merged(a: Level, b: Level, length: int) -> Level:
    """Both levels as one; they have no window in common."""
    n = len(a.at) + len(b.at)
    of_a = np.zeros(n, bool)
    of_a[b.scan(a.text, a.at, length)[0] + np.arange(len(a.at))] = True

    def woven(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.empty((*x.shape[:-1], n), x.dtype)
        out[..., of_a], out[..., ~of_a] = x, y
        return out

    return Level(np.concatenate([a.text, b.text]), woven(a.at, b.at + len(a.text)), woven(a.key, b.key), woven(a.owner, b.owner), woven(a.place, b.place), woven(a.done, b.done))


class LevelFamily:
    """Suffix arrays whose sizes grow geometrically."""

    def __init__(self, length: int):
        self.length = length
        self.levels: list[Level] = []

    def insert(self, blobs: list[bytes], owner: np.ndarray, lo: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Takes a batch of contexts: their bytes, owners (2, n), places in their texts, and whether known to repeat.

        Returns the (owner, place) of the windows that turn out repeated, each once; windows of known
        contexts count as matches for others but are not returned themselves.
        """
        length, size = self.length, np.array([len(x) for x in blobs], np.int64)
        n = np.maximum(0, size - length + 1)
        text = np.frombuffer(b"".join(blobs) + b"\0" * 8, np.uint8)
        of = np.repeat(np.arange(len(blobs)), n)
        step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        starts = (np.cumsum(size) - size)[of] + step
        window = np.full(len(text), -1, np.int64)
        window[starts] = np.arange(len(starts))
        at, shared = suffix_array(text, starts, length)
        w = window[at]
        owner, place, known = owner[:, of[w]], lo[of[w]] + step[w], known[of[w]]
        new = shared < length
        first = np.flatnonzero(new)
        run = np.diff(np.r_[first, len(at)])
        twice = np.repeat(run > 1, run)
        found = [(owner[:, twice & ~known], place[twice & ~known])]
        settled = np.logical_or.reduceat(known | twice, first) if len(first) else known
        at, owner, place = at[first], owner[:, first], place[first]
        left = np.ones(len(at), bool)
        for level in self.levels:
            where, hit = level.scan(text, at, length)
            fresh_ = hit & ~settled
            found.append((owner[:, fresh_], place[fresh_]))
            old = where[hit][~level.done[where[hit]]]
            found.append((level.owner[:, old], level.place[old]))
            level.done[where[hit]] = True
            left &= ~hit
        if left.any():
            self.levels.append(Level(text, at[left], _word(text, at[left]), owner[:, left], place[left], settled[left]))
        while len(self.levels) > 1 and len(self.levels[-2].at) < 2 * len(self.levels[-1].at):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(merged(a, b, length))
        return np.concatenate([x for x, _ in found], 1), np.concatenate([x for _, x in found])


def _spans(owner: np.ndarray, place: np.ndarray, length: int) -> pa.RecordBatch:
    """Windows to the spans they cover, consecutive ones as one."""
    order = np.lexsort((place, owner[1], owner[0]))
    owner, place = owner[:, order], place[order]
    new = np.r_[True, (owner[:, 1:] != owner[:, :-1]).any(0) | (place[1:] != place[:-1] + 1)] if len(place) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(place)] - 1 if len(first) else first
    return pa.RecordBatch.from_arrays([pa.array(owner[0, first]), pa.array(owner[1, first]), pa.array(place[first].astype(np.int32)), pa.array((place[last] + length).astype(np.int32))], ["uid", "uid2", "a", "b"])


PIECES = "uid long, uid2 long, anchor long, lo int, bytes binary, known boolean, hot boolean"


def cut_out(length: int):
    """A mapInArrow function from (uid, uid2, text, asked) to one row per asked context with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.bool_())
        for batch in batches:
            out: list[tuple] = []
            for uid, uid2, text, asked in zip(*(batch.column(c).to_pylist() for c in ("uid", "uid2", "text", "asked"))):
                raw = (text or "").encode()
                out += [(uid, uid2, x["anchor"], x["lo"], raw[x["lo"] : x["hi"] + length], x["known"], x["hot"]) for x in asked]
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["uid", "uid2", "anchor", "lo", "bytes", "known", "hot"])

    return run


def _inserted(family: LevelFamily, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Puts contexts into the family about BATCH_BYTES at a time; yields the windows found to repeat."""
    for batch in batches:
        get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023,E731
        blobs, owner, lo, known = batch.column("bytes").to_pylist(), np.stack([get("uid"), get("uid2")]), get("lo").astype(np.int64), get("known").astype(bool)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in blobs])])
        for a, b in chunks(ends, BATCH_BYTES):
            found, place = family.insert(blobs[a:b], owner[:, a:b], lo[a:b], known[a:b])
            if len(place):
                yield found, place


def indexed(length: int):
    """A mapInArrow function over the contexts of whole anchors to spans of repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owner, place in _inserted(LevelFamily(length), batches):
            yield _spans(owner, place, length)

    return run


SHARES = "r1 long, r2 long, uid long, uid2 long, place int, known boolean, settled boolean"


def thinned(length: int):
    """A mapInArrow function over a share of hot contexts: each distinct window once, with 128 bits of
    its bytes; the ones that repeat within the share also with settled = true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = LevelFamily(length)

        def rows(r1: np.ndarray, r2: np.ndarray, owner: np.ndarray, place: np.ndarray, known: np.ndarray, settled: bool) -> pa.RecordBatch:
            columns = [r1.view(np.int64), r2.view(np.int64), owner[0], owner[1], place.astype(np.int32), known, np.full(len(place), settled)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["r1", "r2", "uid", "uid2", "place", "known", "settled"])

        for owner, place in _inserted(family, batches):
            none = np.zeros(len(place), U64)
            yield rows(none, none, owner, place, np.ones(len(place), bool), True)
        for x in family.levels:
            yield rows(slice_hashes(x.text, x.at, x.at + length), slice_hashes(x.text, x.at, x.at + length, 1), x.owner, x.place, x.done, False)

    return run


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(uid, uid2, a, b): byte spans of texts(uid, uid2, text) made of repeated windows; they may overlap."""
    rows = texts.mapInArrow(scanned(length, gram), MET)
    by_key, by_context = Window.partitionBy("key"), Window.partitionBy("key", "c1", "c2")
    # a key has at most one row a batch and a mark, so no key grows with a group of copies
    differ = lambda c: F.min(c).over(by_key) < F.max(c).over(by_key)
    met = rows.withColumn("mixed", (F.max((F.col("kind") >= MIXED).cast("int")).over(by_key) > 0) | differ("c1") | differ("c2") | differ("anchor"))
    met = met.withColumn("again", (F.col("kind") == KEPT) | (F.count("*").over(by_context) > 1) | F.max("multi").over(by_context))
    met = met.withColumn("nth", F.row_number().over(by_context.orderBy("uid", "uid2", "lo"))).where((F.col("kind") != MARK) & (F.col("mixed") | F.col("again")))
    met = written(met.select("anchor", "uid", "uid2", "lo", "hi", "mixed", "again", "nth"), "suffix-met")
    settled = met.where("again").select("uid", "uid2", F.col("lo").alias("a"), (F.col("hi") + length).alias("b"))
    asked = met.where("mixed AND nth = 1")
    share = asked.count() // (2 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = written(asked.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > max(HOT, min(HOT_MOST, share))).select("anchor", F.lit(True).alias("hot")), "suffix-hot")
    asked = asked.join(hot.hint("shuffle_hash"), "anchor", "left")
    asked = asked.groupBy("uid", "uid2").agg(F.collect_list(F.struct("anchor", "lo", "hi", F.col("again").alias("known"), F.coalesce("hot", F.lit(False)).alias("hot"))).alias("asked"))
    pieces = written(texts.join(asked.hint("shuffle_hash"), ["uid", "uid2"]).mapInArrow(cut_out(length), PIECES), "suffix-contexts")
    plain = pieces.where("NOT hot").repartition("anchor").mapInArrow(indexed(length), "uid long, uid2 long, a int, b int")
    shares = written(pieces.where("hot").repartition(F.xxhash64("uid", "lo")).mapInArrow(thinned(length), SHARES), "suffix-shares")
    window = lambda df: df.select("uid", "uid2", F.col("place").alias("a"), (F.col("place") + length).alias("b"))
    # a window has at most one row a share
    spread = shares.where("NOT settled").withColumn("n", F.count("*").over(Window.partitionBy("r1", "r2"))).where("n > 1 AND NOT known")
    return settled.unionByName(plain).unionByName(window(spread)).unionByName(window(shares.where("settled")))


def removed(spans_name: str):
    """A mapInArrow function from (doc_id, text, spans) to the kept bytes' digest and the maximal removed runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, runs, sha = [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(spans_name).to_pylist()):
                raw = (text or "").encode()
                cut = merge_spans(spans)
                kept, at = hashlib.sha256(), 0
                for a, b in cut:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                n.append(len(raw))
                gone.append(sum(b - a for a, b in cut))
                runs.append(len(cut))
                sha.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def merge_spans(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Overlapping and touching spans as maximal runs, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def with_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, str]:
    """docs with one more column, the repeated byte spans of each row's text (null: none), and its name:
    spans, with leading underscores where docs has that."""
    name, *own = fresh(docs.columns, "spans", "__uid", "__uid2")
    uids: list[Column] = [F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), "doc_id", "text")]
    found = written(repeated_spans(docs.select(uids[0].alias("uid"), uids[1].alias("uid2"), "text"), length, gram), "suffix-spans")
    spans = found.groupBy("uid", "uid2").agg(F.collect_set(F.struct("a", "b")).alias(name)).withColumnsRenamed({"uid": own[0], "uid2": own[1]})
    return docs.withColumns(dict(zip(own, uids))).join(spans.hint("shuffle_hash"), own, "left").select(*docs.columns, name), name


def cut_texts(schema_names: list[str], spans_name: str):
    """A mapInArrow function dropping the spans from text, whole code points only, and their column.

    A span's ragged ends stay: a code point that is covered in part is kept. n_chars, if there, is
    counted anew. Rows that lost all their words go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(spans_name).to_pylist()):
                if spans:
                    raw, at, parts = (text or "").encode(), 0, []
                    for a, b in merge_spans(spans):
                        while a < len(raw) and raw[a] & 0xC0 == 0x80:
                            a += 1
                        while b < len(raw) and b > a and raw[b] & 0xC0 == 0x80:
                            b -= 1
                        parts.append(raw[at:a])
                        at = max(a, b)
                    text = b"".join([*parts, raw[at:]]).decode()
                texts.append(text)
                keep.append(not spans or bool(text.strip(" \t\n\x0b\x0c\r")))
            columns = []
            for name in schema_names:
                column = batch.column(name)
                if name == "text":
                    column = pa.array(texts, column.type)
                elif name == "n_chars":
                    column = pa.array([None if t is None else len(t) for t in texts], column.type)
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, schema_names).filter(pa.array(keep, pa.bool_()))

    return run


def drop_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs without their repeated passages; see cut_texts for what becomes of the rows."""
    done, spans = with_spans(docs, length, gram)
    return done.mapInArrow(cut_texts(docs.columns, spans), docs.schema)


def op6_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, spans = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.mapInArrow(removed(spans), DIGESTS)
