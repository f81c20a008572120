"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
CHUNK_BYTES = 1 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, from spark.checkpoint.dir; where that is unset a new one in local mode
    (one machine, as in tests), and an error on a cluster, where no folder of the driver's is safe."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files that this took are dropped at once, not when the driver happens to collect its garbage.
    """
    path, conf = f"{shared_dir(df.sparkSession)}/tessera/{name}-{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, with more leading underscores where a column of any case has one already."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def crc_mod(doc_id: str | F.Column, n: int) -> F.Column:
    """crc32 of doc_id written as text, modulo n."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % n


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, nulls as empty, and the n + 1 offsets into them."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """(first row, end row) of runs of rows with about limit bytes; a longer row is a run of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_LONG = 512
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def slice_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of raw[start:end]; equal bytes hash alike wherever they stand. Two seeds make 128 bits.

    Eight bytes at a time are mixed in, for all slices at once; slices of over _LONG bytes go through
    xxh3 one by one.
    """
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded.data, strides=(1,))
    size = end - start
    with np.errstate(over="ignore"):
        h = mix(size.astype(U64) * U64(0xA24BAED4963EE407) + U64((0x9E3779B97F4A7C15 * (seed + 1)) % (1 << 64)))
        live, at, left = np.arange(len(size)), start, size
        short = size <= _LONG
        if not short.all():
            live, at, left = live[short], start[short], size[short]
            data = raw.data
            wide = np.flatnonzero(~short)
            h[wide] = np.array([xxhash.xxh3_64_intdigest(data[a:b], seed) for a, b in zip(start[wide].tolist(), end[wide].tolist())], U64)
        while True:
            on = left > 0
            if not on.all():
                live, at, left = live[on], at[on], left[on]
            if not len(live):
                return h
            h[live] = mix(h[live] ^ ((eight[at] & _MASK[np.minimum(left, 8)]) * U64(0xD1342543DE82EF95)))
            at, left = at + 8, left - 8


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space; no run crosses a row's border."""
    word = ~_SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and for each row the place of its first word (n + 1 numbers)."""
    start, end = word_spans(raw, offsets)
    return slice_hashes(lower_ascii(raw) if lower else raw, start, end), np.searchsorted(start, offsets)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for every id in edges(a, b): component is the smallest id reachable.

    Alternating large-star and small-star rounds on a written edge table, until it stays as it is.
    A hub's edges are spread by the join, never gathered in a list.
    """
    both = lambda e: e.union(e.select("b", "a"))
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    before = None
    while True:
        n = both(e)
        least = n.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = n.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        e = written(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    root = e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    return root.union(e.select("b", "b").distinct().join(root, F.col("b") == F.col("id"), "left_anti").toDF("id", "component"))
