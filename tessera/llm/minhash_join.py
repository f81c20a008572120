"""MinHash near-duplicate detection by an inverted join of signature coordinates.

Each text becomes its set of word shingles and a signature of COORDINATES minima. Texts with equal
sets form one class and only one of each class goes on. Two sets at the similarity threshold agree
in at least `least` coordinates but for about one chance in a million, so they share one of the
COORDINATES - least + 1 (coordinate, value) pairs that each posts. Rare pairs are posted first: all
texts order their pairs by the same counts, a sketch of SKETCH numbers whatever the corpus holds.

Posting lists are merged in two rounds. Lists hold marks, two bits of each coordinate: pairs whose
sizes allow a link and whose marks agree in `least` coordinates or more are looked at, all others
cannot be links but for the chance above. First every member of a list meets the list's smallest
member only, and such pairs are confirmed on full sets. Members that this joined to one component
need not meet again: lists that lie within one component are skipped, and in the others only members
of different components meet. In lists of at most SHORT members such pairs are confirmed. Longer
lists are looked through by blocks of about LIST members, and what a block's marks connect goes on as
links of a family, never as pairs. Each family is cut into blocks of at most BLOCK texts, and each
pair of blocks counts the shingles its texts share by matrix products and returns links that join
what it joins. No pair is capped or sampled away.

Texts are read anew from the documents wherever they are needed, those of pairs and families only: a
sketch of 2**18 words of 64 bits, whatever the corpus holds, keeps most others out of the shuffle.

Null, empty and blank texts have no shingles, are linked with nothing and are kept. A text of fewer
words than a shingle is one shingle by itself. Rows with a null doc_id get a null component and are
kept; rows that repeat a doc_id are judged each by its text. Extra columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import U64, chunks, components, mix, table, text_bytes, word_hashes, written
from tessera.operators.components import least_labels

COORDINATES, SKETCH, SHORT, LIST, BLOCK, FANOUT, MISS = 64, 1 << 16, 32, 4096, 512, 256, 1e-6
PAIRS, WANTED = 400_000, 1 << 18  # pairs that are looked at together, words of the sketch of wanted texts
_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=U64))
_A, _B = _SEEDS[:COORDINATES] | U64(1), _SEEDS[COORDINATES:]


def least_matches(percent: int, n: int = COORDINATES, miss: float = MISS) -> int:
    """The greatest t such that a pair at the threshold agrees in fewer than t of n coordinates with chance `miss` at most."""
    p, tail = percent / 100, 0.0
    for t in range(n + 1):
        tail += comb(n, t) * p**t * (1 - p) ** (n - t)
        if tail > miss:
            return max(1, t)
    return n


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text."""
    h, at = word_hashes(raw, offsets)
    n = np.diff(at)
    out = []
    key = np.zeros(max(0, len(h) - words + 1), U64)
    with np.errstate(over="ignore"):
        for i in range(words):
            key = key * U64(0x9E3779B97F4A7C15) + h[i : i + len(key)]
        key = mix(key)
        for i, k in enumerate(n.tolist()):
            if k >= words:
                out.append(np.unique(key[at[i] : at[i + 1] - words + 1]))
            elif k:
                one = U64(k)
                for x in h[at[i] : at[i + 1]]:
                    one = one * U64(0x9E3779B97F4A7C15) + x
                out.append(mix(np.array([one ^ U64(0x5851F42D4C957F2D)], U64)))
            else:
                out.append(np.zeros(0, U64))
    return out


def signatures(words: int):
    """A mapInArrow function from (uid, uid2, doc_id, text) to set sizes, set digests and signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            size, digest, signature = [], [], []
            for a, b in chunks(offsets):
                for s in shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words):
                    size.append(len(s))
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    least = np.full(COORDINATES, ~U64(0), U64)
                    with np.errstate(over="ignore"):
                        for x in range(0, len(s), 2048):
                            np.minimum(least, (s[x : x + 2048, None] * _A + _B).min(0), out=least)
                    signature.append((least >> U64(32)).astype("<u4").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("uid2"), batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(signature, pa.binary())], ["uid", "uid2", "doc_id", "n", "digest", "signature"])

    return run


def _coordinates(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, COORDINATES)


def _tokens(signature: np.ndarray) -> np.ndarray:
    """One 64-bit name for each (coordinate, value) pair."""
    return mix((signature.astype(U64) << U64(8)) | np.arange(COORDINATES, dtype=U64))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SKETCH, np.int64)
    for batch in batches:
        total += np.bincount((_tokens(_coordinates(batch.column("signature"))) >> U64(48)).astype(np.int64).ravel(), minlength=SKETCH)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])


def posted(prefix: int, counts):
    """A mapInArrow function from (uid, signature) to its `prefix` rarest pairs, (token, uid)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token = _tokens(_coordinates(batch.column("signature")))
            order = np.lexsort((token, counts.value[(token >> U64(48)).astype(np.int64)]), axis=1)[:, :prefix]
            token = np.take_along_axis(token, order, 1)
            yield pa.RecordBatch.from_arrays([pa.array(token.ravel().view(np.int64)), pa.array(np.repeat(batch.column("uid").to_numpy(), prefix))], ["token", "uid"])

    return run


def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, n, lo, hi): the two lowest bits of each coordinate."""
    for batch in batches:
        least = _coordinates(batch.column("signature"))
        lo, hi = (np.packbits((least >> np.uint32(k)) & np.uint32(1), axis=1).view(np.int64)[:, 0] for k in (0, 1))
        yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("n"), pa.array(lo), pa.array(hi)], ["uid", "n", "lo", "hi"])


def alike(lo: np.ndarray, hi: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The number of coordinates in which the marks of x and y agree, no less than their signatures do."""
    return COORDINATES - np.bitwise_count(((lo[x] ^ lo[y]) | (hi[x] ^ hi[y])).view(U64)).astype(np.int64)


def spokes(percent: int, least: int):
    """A mapInArrow function over (token, chunk, spoke, uid, n, lo, hi), sorted so that each (token, chunk) starts with the
    list's smallest member (spoke false): pairs (a, b) of that member and another that may be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None
        for batch in batches:
            if not batch.num_rows:
                continue
            uid, n, lo, hi = (np.r_[hub[i] if hub else np.zeros(0, np.int64), batch.column(c).to_numpy()] for i, c in enumerate(("uid", "n", "lo", "hi")))
            spoke = np.r_[np.zeros(1 if hub else 0, bool), batch.column("spoke").to_numpy(zero_copy_only=False)]
            at = np.maximum.accumulate(np.where(spoke, 0, np.arange(len(spoke))))
            y = np.flatnonzero(spoke)
            x = at[y]
            ok = (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (alike(lo, hi, x, y) >= least)
            yield pa.RecordBatch.from_arrays([pa.array(uid[x[ok]]), pa.array(uid[y[ok]])], ["a", "b"])
            hub = tuple(c[at[-1:]] for c in (uid, n, lo, hi))

    return run


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that end where a key ends, from rows that come sorted by the keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = np.ones(batch.num_rows, bool)
        for k in keys:
            column = batch.column(k).to_numpy()
            last &= column == column[-1]
        cut = 0 if last.all() else int(np.flatnonzero(~last)[-1]) + 1
        if held and (cut or any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys)):
            head = batch.slice(0, cut)
            if any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
                yield pa.Table.from_batches(held)
                if cut:
                    yield pa.Table.from_batches([head])
            else:
                yield pa.Table.from_batches([*held, head])
            held = [batch.slice(cut)]
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _meetings(group: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray, percent: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (x, y) of rows of a group (0, 1, ...) that may be linked, some at a time; rows come by group, then by n."""
    wide = int(n.max(initial=0)) + 1
    last = np.searchsorted(group * wide + n, group * wide + np.minimum(100 * n // percent, wide - 1), "right")
    later = np.maximum(0, last - np.arange(len(n)) - 1)  # partners after each row
    step = np.cumsum(later)
    a0 = 0
    while a0 < len(n):
        a1 = max(a0 + 1, int(np.searchsorted(step, (step[a0 - 1] if a0 else 0) + PAIRS, "right")))
        k = later[a0:a1]
        x = np.repeat(np.arange(a0, a1), k)
        y = np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k) + x + 1
        ok = alike(lo, hi, x, y) >= least
        yield x[ok], y[ok]
        a0 = a1


def crossing(percent: int, least: int):
    """A mapInArrow function over lists (token, uid, part, family, n, lo, hi), sorted by token and n:
    pairs of different parts and families that may be linked, (a, b) with a < b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, ["token"]):
            token, uid, part, family, n, lo, hi = (rows.column(c).to_numpy() for c in ("token", "uid", "part", "family", "n", "lo", "hi"))
            group = np.cumsum(np.r_[False, token[1:] != token[:-1]])
            for x, y in _meetings(group, n, lo, hi, percent, least):
                ok = (part[x] != part[y]) & (family[x] != family[y])
                p, q = uid[x[ok]], uid[y[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["a", "b"])

    return run


def connecting(percent: int, least: int):
    """A mapInArrow function over blocks of lists (token, i, j, uid, part, n, lo, hi), sorted by the first three and n:
    links (a, b) that connect what pairs of different parts that may be linked connect, fewer than a block has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, ["token", "i", "j"]):
            token, i, j, uid, part, n, lo, hi = (rows.column(c).to_numpy() for c in ("token", "i", "j", "uid", "part", "n", "lo", "hi"))
            group = np.cumsum(np.r_[False, (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            label = np.arange(len(n))
            for x, y in _meetings(group, n, lo, hi, percent, least):
                ok = part[x] != part[y]
                if ok.any():
                    known = np.flatnonzero(label != np.arange(len(n)))
                    label = least_labels(len(n), np.r_[known, x[ok]], np.r_[label[known], y[ok]])
            known = np.flatnonzero(label != np.arange(len(n)))
            yield pa.RecordBatch.from_arrays([pa.array(uid[label[known]]), pa.array(uid[known])], ["a", "b"])

    return run


def joined_labels(linked: np.ndarray) -> np.ndarray:
    """Component labels (smallest index) of a symmetric link matrix."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(label)).min(1, initial=len(label))
        new = np.minimum(label, near)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def shared_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """The numbers of shingles that each two sets share."""
    size = np.array([len(s) for s in sets])
    value, column, count = np.unique(np.concatenate(sets) if sets else np.zeros(0, U64), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    common = count > 1
    place = np.cumsum(common) - 1
    keep = common[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    step = 4096
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + step + 1, step))
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        m = np.zeros((len(sets), step), np.float32)
        m[row[a:b], column[a:b] - i * step] = 1
        out += m @ m.T
    return out


def family_links(words: int, percent: int):
    """A mapInArrow function over blocks (family, i, j, uid, part, text), sorted by the first three:
    links (a, b) that join all that the block's links join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, ["family", "i", "j"]):
            rows = rows.combine_chunks()
            family, i, j, uid, part = (rows.column(c).to_numpy() for c in ("family", "i", "j", "uid", "part"))
            starts = np.flatnonzero(np.r_[True, (family[1:] != family[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            for a, b in zip(starts, np.r_[starts[1:], len(family)]):
                if len(np.unique(part[a:b])) < 2:
                    continue
                raw, offsets = text_bytes(rows.column("text").slice(a, b - a))
                sets = shingle_sets(raw, offsets, words)
                n = np.array([len(s) for s in sets], np.float64)
                both = shared_shingles(sets).astype(np.float64)
                linked = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (both > 0)
                linked |= part[a:b][:, None] == part[a:b][None, :]  # these are joined already
                label = joined_labels(linked)
                lone = np.flatnonzero(label != np.arange(b - a))
                yield pa.RecordBatch.from_arrays([pa.array(uid[a:b][label[lone]]), pa.array(uid[a:b][lone])], ["a", "b"])

    return run


def confirmed(words: int, percent: int):
    """A mapInArrow function over (a, chunk, b, text), sorted so that each (a, chunk) starts with
    a's own text (b null): the pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, U64)
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            a, b, links = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            for x, y in chunks(offsets):
                sets = shingle_sets(raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], words)
                for k, s in zip(range(x, y), sets):
                    if b[k] is None:
                        hub = s
                        continue
                    small, large = (s, hub) if len(s) <= len(hub) else (hub, s)
                    at = np.searchsorted(large, small)
                    both = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
                    if both and 100 * both >= percent * (len(s) + len(hub) - both):
                        links.append((a[k], b[k]))
            p, q = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(q, pa.int64())], ["a", "b"])

    return run


def with_texts(keyed: DataFrame, ids: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(uid, ...) with the text of each uid; keyed(row, row2, text), ids(uid, row, row2), each row once."""
    named = written(asked.join(ids, "uid"), "near-asked")
    cell, bit = F.pmod("row", F.lit(WANTED)).alias("cell"), F.pmod(F.expr("row div %d" % WANTED), F.lit(64)).cast("int")
    sketch = named.select("row", cell).groupBy("cell").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    near = keyed.join(F.broadcast(sketch), F.pmod("row", F.lit(WANTED)) == F.col("cell")).where(F.call_function("shiftrightunsigned", "bits", bit).bitwiseAND(F.lit(1)) == 1)
    texts = near.groupBy("row", "row2").agg(F.first("text").alias("text"))
    return texts.join(named.hint("shuffle_hash"), ["row", "row2"]).drop("row", "row2")


def confirm(pairs: DataFrame, keyed: DataFrame, ids: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of uids that are links."""
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / FANOUT).cast("int").alias("chunks"))
    dealt = written(pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk")), "near-dealt")
    hubs = dealt.select("a", "chunk").distinct().select(F.col("a").alias("uid"), "a", "chunk", F.lit(None).cast("long").alias("b"))
    asked = dealt.select(F.col("b").alias("uid"), "a", "chunk", "b").unionByName(hubs)
    rows = with_texts(keyed, ids, asked).select("a", "chunk", "b", "text").repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    return written(rows.mapInArrow(confirmed(words, percent), "a long, b long"), "near-links")


def row_id() -> list[Column]:
    """128 bits of doc_id and text as two longs: rows are one document where both are equal."""
    return [F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), "doc_id", "text")]


def _blocks(rows: DataFrame) -> DataFrame:
    """rows(uid, blocks, ...) dealt into blocks, once for each pair of blocks i <= j that theirs is one of."""
    block = F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")
    cut = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cut.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("block", "other", "blocks")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(uid, uid2, doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text).

    uid and uid2 are the 128 bits of row_id; kept is true for one doc_id of each component, the smallest.
    """
    spark = docs.sparkSession
    least = least_matches(percent)
    uid, uid2 = row_id()
    keyed = docs.select(uid.alias("uid"), uid2.alias("uid2"), "doc_id", "text")
    rows = written(keyed.mapInArrow(signatures(words), "uid long, uid2 long, doc_id long, n long, digest binary, signature binary"), "near-signatures")
    # a class goes by a number of its own (uid), and by the row (row, row2) whose text stands for it
    row = F.min(F.struct(F.col("uid").alias("row"), F.col("uid2").alias("row2"))).alias("at")
    sets = rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), row, F.first("n").alias("n"), F.first("signature").alias("signature"))
    classes = written(sets.select("digest", "doc_id", F.monotonically_increasing_id().alias("uid"), "at.row", "at.row2", "n", "signature"), "near-classes")
    cells = classes.select("signature").mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most SKETCH rows
    counts = np.zeros(SKETCH, np.int64)
    counts[[r.cell for r in cells]] = [r.n for r in cells]
    shared = spark.sparkContext.broadcast(counts)
    posts = written(classes.select("uid", "signature").mapInArrow(posted(COORDINATES - least + 1, shared), "token long, uid long"), "near-posts")
    lists = written(posts.groupBy("token").agg(F.count("*").alias("m"), F.min("uid").alias("hub")).where("m > 1"), "near-lists")
    listed = written(posts.join(lists, "token").select("token", "m", "hub", "uid"), "near-listed")
    marks = written(classes.select("uid", "n", "signature").mapInArrow(marked, "uid long, n long, lo long, hi long"), "near-marks")
    chunks = F.ceil(F.col("m") / LIST).cast("int")
    hubs = lists.select("token", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.lit(False).alias("spoke"), F.col("hub").alias("uid"))
    star = hubs.unionByName(listed.where("uid <> hub").select("token", F.pmod(F.xxhash64("uid"), chunks).cast("int").alias("chunk"), F.lit(True).alias("spoke"), "uid")).join(marks, "uid")
    pairs = written(star.repartition("token", "chunk").sortWithinPartitions("token", "chunk", "spoke").mapInArrow(spokes(percent, least), "a long, b long").distinct(), "near-pairs")
    source = docs.select(uid.alias("row"), uid2.alias("row2"), "text")
    ids = classes.select("uid", "row", "row2")
    links = confirm(pairs, source, ids, words, percent)
    parts = written(components(links), "near-parts")
    # lists that reach over several components: only members of different ones meet
    part = F.coalesce("component", "uid")
    labelled = written(listed.join(parts.withColumnRenamed("id", "uid"), "uid", "left").select("token", "m", "uid", part.alias("part")), "near-labelled")
    open_lists = labelled.groupBy("token").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("token")
    members = written(labelled.join(open_lists, "token").select("token", "m", "uid", "part"), "near-open")
    long, both = _blocks(members.where(F.col("m") > SHORT).withColumn("blocks", F.ceil(F.col("m") / LIST).cast("int"))), ["token", "i", "j"]
    linked = long.join(marks, "uid").repartition(*both).sortWithinPartitions(*both, "n").mapInArrow(connecting(percent, least), "a long, b long")
    families = written(components(linked).toDF("uid", "family"), "near-families")
    short = members.where(F.col("m") <= SHORT).join(families, "uid", "left").withColumn("family", F.coalesce("family", "uid")).join(marks, "uid")
    met = short.select("token", "uid", "part", "family", "n", "lo", "hi").repartition("token").sortWithinPartitions("token", "n")
    cross = written(met.mapInArrow(crossing(percent, least), "a long, b long").distinct(), "near-cross")
    more = confirm(cross, source, ids, words, percent)
    sizes = families.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    cut = _blocks(families.join(sizes, "family").join(parts.withColumnRenamed("id", "uid"), "uid", "left").withColumn("part", part))
    blocks = with_texts(source, ids, cut.select("uid", "part", "family", "i", "j")).repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    inner = written(blocks.mapInArrow(family_links(words, percent), "a long, b long"), "near-family-links")
    more = more.unionByName(inner)
    roots = written(components(links.union(more)).withColumnRenamed("id", "uid"), "near-roots")
    owned = classes.join(roots, "uid", "left").select("digest", "doc_id", F.coalesce("component", "uid").alias("root"))
    owned = written(owned, "near-owned")
    named = owned.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    known = written(owned.join(named, "root").select("digest", "component_id"), "near-components")
    done = rows.join(known, "digest", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return done.select("uid", "uid2", "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op3_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85).drop("uid", "uid2")
