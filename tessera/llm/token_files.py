"""Token-id files: documents in ascending doc_id order, coded by token_coder.

A file set is a folder of Parquet files whose rows are segments: file_no (order of the files),
segment_no, doc_ids and lengths of the documents wholly in it, and blocks, the coded ids (see
token_coder for the bytes). Spark's range partitioning deals the documents out by doc_id and each
task writes its own segments, so nothing is gathered anywhere. Reading needs one segment at a time.

Null texts count as empty: they hold the end id alone. Equal doc_ids stand in order of a hash of their texts,
a null doc_id comes first. An empty table gives a file set without rows. Extra columns are passed by.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import chunks, shared_dir, table, text_bytes, written
from tessera.llm.token_coder import BLOCK, LANES, decode_blocks, encode_segments
from tessera.llm.tokens import word_ids

SEGMENT = 1 << 19
FILES = "file_no int, segment_no int, doc_ids array<long>, lengths array<long>, blocks binary"
SCHEMA = pa.schema([("file_no", pa.int32()), ("segment_no", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("blocks", pa.binary())])


def coded(path: str):
    """A mapInArrow function from (doc_id, text) in order to segments of about SEGMENT ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, file_no, segment = word_ids(path), TaskContext.get().partitionId(), 0
        docs: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def close() -> None:
            if docs:
                held.append((pa.concat_arrays(docs), np.concatenate(sizes), np.concatenate(ids)))
                for x in (docs, sizes, ids):
                    x.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal segment
            # blocks of all held segments run side by side; none reaches into the next segment
            for (d, n, _), blocks in zip(held, encode_segments([x for _, _, x in held])):
                one = pa.array([0, len(d)], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([file_no], pa.int32()), pa.array([segment], pa.int32()), pa.ListArray.from_arrays(one, d), pa.ListArray.from_arrays(one, pa.array(n)), pa.array([blocks], pa.binary())], schema=SCHEMA)
                segment += 1
            held.clear()

        size = 0
        for batch in batches:
            texts, doc_ids = batch.column("text"), batch.column("doc_id").cast(pa.int64())
            _, offsets = text_bytes(texts)
            for a, b in chunks(offsets):
                found, at = words.encode(texts.slice(a, b - a))
                docs.append(doc_ids.slice(a, b - a))
                sizes.append(np.diff(at))
                ids.append(found)
                size += len(found)
                if size >= SEGMENT:
                    close()
                    size = 0
                    if sum(len(x) for _, _, x in held) >= BLOCK * LANES:
                        yield from flush()
        close()
        yield from flush()

    return run


def write_token_files(docs: DataFrame, out: str, path: str | None = None) -> None:
    """Tokenise docs(doc_id, text) and write a file set to the folder out.

    The ranges are cut by (doc_id, hash of the text), so that a doc_id of very many rows takes many
    files; equal doc_ids stand in order of that hash, then of their texts.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    order = ["doc_id", F.xxhash64("text"), "text"]
    docs.select("doc_id", "text").repartitionByRange(*order[:2]).sortWithinPartitions(*order).mapInArrow(coded(path), FILES).write.option("compression", "none").parquet(out)


def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments to (file_no, segment_no, place, doc_id, before, n_tokens, ids_crc32), before within the segment."""
    names = ["file_no", "segment_no", "place", "doc_id", "before", "n_tokens", "ids_crc32"]
    held, size = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal size
        ids = decode_blocks(b"".join(r[4] for r in held)).astype("<u4").tobytes()
        at = 0
        for file_no, segment, docs, n, _ in held:
            ends = np.cumsum(n)
            edges = (at + 4 * np.concatenate([[0], ends])).tolist()
            crc = [zlib.crc32(ids[x:y]) for x, y in zip(edges, edges[1:])]
            at, k = edges[-1], len(docs)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, file_no), pa.int32()), pa.array(np.full(k, segment), pa.int32()), pa.array(np.arange(k), pa.int32()), docs, pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())], names)
        held.clear()
        size = 0

    for batch in batches:
        for i in range(batch.num_rows):
            held.append((batch.column("file_no")[i].as_py(), batch.column("segment_no")[i].as_py(), batch.column("doc_ids")[i].values, batch.column("lengths")[i].values.to_numpy(), batch.column("blocks")[i].as_py()))
            size += int(held[-1][3].sum())
            if size >= BLOCK * LANES:
                yield from flush()
    if held:
        yield from flush()


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of a file set: doc_id, start, n_tokens, ids_crc32, decoded and checked."""
    files = spark.read.parquet(folder)
    # one row a segment, of SEGMENT ids: the sums run over files first, then within a file
    sizes = files.select("file_no", "segment_no", F.aggregate("lengths", F.lit(0).cast("long"), lambda x, y: x + y).alias("n"))
    of_file = sizes.groupBy("file_no").agg(F.sum("n").alias("n"))
    before_file = of_file.select("file_no", (F.sum("n").over(Window.orderBy("file_no")) - F.col("n")).alias("f0"))
    base = sizes.join(before_file, "file_no").select("file_no", "segment_no", (F.col("f0") + F.sum("n").over(Window.partitionBy("file_no").orderBy("segment_no")) - F.col("n")).alias("base"))
    # decoded once; the join reads the rows from there
    rows = written(files.mapInArrow(decoded, "file_no int, segment_no int, place int, doc_id long, before long, n_tokens long, ids_crc32 long"), "token-rows")
    return rows.join(base, ["file_no", "segment_no"]).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tessera/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder)
