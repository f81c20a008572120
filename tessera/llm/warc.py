"""WARC archives under Zstandard: one record to a frame, a dictionary in the leading skippable frame.

An archive begins with a skippable frame (magic number 0x184D2A5D) that holds the dictionary, itself
compressed or as it is; then every record is a frame of its own that is decoded with that dictionary.
The reader finds a frame's end from its block headers, so it needs one record in memory at a time and
starts nowhere anew; it reads archives of any length in windows.

`write_archives` deals pages out to archives: of records with equal payloads of at least min_revisit
bytes the one with the smallest page_id is a response, the others revisit it and carry the HTTP head
alone. Every task writes its own archives, named by its attempt, and returns their names; only archives
that are named in the written list are read, so a task that ran twice adds nothing.

A null html counts as an empty payload. A null page_id is larger than any other and has no number in
its record's id. Rows that repeat both page_id and payload of a response are responses too, so no record
revisits one of its own number. A null url gives the record's id as the target; characters below the
exclamation mark and DEL are percent-encoded in it. Payloads are written whole whatever their length. An empty table
gives no archives. Extra columns are passed by.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shared_dir, table, written

# fixed values of the formats
DICTIONARY_FRAME, SKIPPABLE, SKIPPABLE_MASK = 0x184D2A5D, 0x184D2A50, 0xFFFFFFF0
FRAME, DICTIONARY = 0xFD2FB528, 0xEC30A437
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")

#: Pages a dictionary is trained on at most, and bytes of each; the dictionary has no part in the records' content.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 512, 16_384, 65_536
ARCHIVE_BYTES, WINDOW = 256 << 20, 4 << 20
DATE = "1970-01-01T00:00:00Z"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORDS = "file string, place long, type string, record_id string, target string, date string, payload_digest string, payload_bytes long, refers_to string, payload binary, error string"


def trained(pages: DataFrame) -> bytes:
    """A dictionary from at most SAMPLE_PAGES pages, those of the smallest hashes; empty where they are too few."""
    hashed = pages.where("html is not null").select(F.xxhash64("page_id", "html").alias("at"), F.substring(F.col("html").cast("binary"), 1, SAMPLE_BYTES).alias("head"))
    # the hashes alone are sorted; tasks send the heads of no other rows
    last = hashed.select("at").orderBy("at").limit(SAMPLE_PAGES).agg(F.max("at")).first()[0]
    rows = hashed.where(F.col("at") <= last).limit(SAMPLE_PAGES).collect() if last is not None else []
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(r["head"]) for r in rows], level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def page_of(name: str | Column) -> Column:
    """The page number in a record's id; null where it has none."""
    found = F.regexp_extract(name, "^<urn:page:(-?[0-9]+):", 1)
    return F.when(found != "", found.cast("long"))


class Archive:
    """Writes one archive after another into a folder of any file system that Arrow knows."""

    def __init__(self, folder: str, dictionary: bytes, attempt: str):
        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.uri, self.attempt, self.dictionary = folder, attempt, dictionary
        self.coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        self.n, self.out = 0, None

    def add(self, data: bytes) -> Iterator[tuple[str, int, int]]:
        if self.out is None:
            self.name = f"{self.attempt}-{self.n:05d}.warc.zst"
            self.fs.create_dir(self.folder, recursive=True)
            self.out, self.n, self.records = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None), self.n + 1, 0
            if self.dictionary:
                held = zstandard.ZstdCompressor(level=9).compress(self.dictionary)
                self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(held)) + held)
            self._put(record("warcinfo", [("WARC-Record-ID", f"<urn:archive:{self.name}>"), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._put(data)
        if self.out.tell() >= ARCHIVE_BYTES:
            yield self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(self.coder.compress(data))
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        size = self.out.tell()
        self.out.close()
        self.out = None
        return f"{self.uri}/{self.name}", self.records, size


_PLAIN = {i: f"%{i:02X}" for i in [*range(33), 127]}


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """The record of a page: a response with its payload, or a revisit of the record refers_to."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = record_id(page_id, digest)
    fields = [("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", url.translate(_PLAIN) if url else name[1:-1]), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        return record("response", fields, head + payload)
    return record("revisit", [*fields, ("WARC-Refers-To", refers_to), ("WARC-Profile", PROFILE)], head)


def writer(folder: str, dictionary: bytes):
    """A mapInArrow function from (page_id, url, payload, digest, first, is_response) to (file, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        archive = Archive(folder, dictionary, f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}")
        done = []
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "first", "is_response")]
            for i in range(batch.num_rows):
                page_id, url, payload, digest, first, response = (c[i].as_py() for c in columns)
                done += archive.add(page_record(page_id, url, payload, digest, None if response else record_id(first, digest)))
        if archive.out:
            done.append(archive.close())
        names, records, sizes = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], ["file", "records", "bytes"])

    return run


def base32(digest: Column) -> Column:
    """Base32 of a hexadecimal SHA-1: twenty bits, four letters, at a time."""
    letters = []
    for k in range(8):
        bits = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(ALPHABET), (F.shiftright(bits, s).bitwiseAND(31) + 1), F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def write_archives(pages: DataFrame, folder: str, min_revisit: int = 0) -> DataFrame:
    """Write pages(page_id, url, html) into archives in the folder; returns (file, records, bytes) of those that count."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    # payloads that more than one row has; the payloads themselves are not shuffled for this
    again = rows.where(F.octet_length("payload") >= min_revisit).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first", F.lit(True).alias("repeated"))
    again = written(again, "warc-repeated")
    joined = rows.join(again.hint("shuffle_hash"), "sha", "left")
    response = F.col("repeated").isNull() | F.col("page_id").eqNullSafe(F.col("first"))
    named = joined.select("page_id", "url", "payload", base32(F.col("sha")).alias("digest"), "first", response.alias("is_response"))
    return written(named.mapInArrow(writer(folder, trained(pages)), "file string, records long, bytes long"), "warc-files")


class Damaged(ValueError):
    """An archive, frame or record that breaks the format."""


class Window:
    """Bytes of a file by place, read in windows: at most one window and what a request needs are held."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.data = file, size, 0, b""

    def get(self, at: int, n: int) -> memoryview:
        if at + n > self.size:
            raise Damaged(f"the archive ends at {self.size}, {at + n} bytes are needed")
        if at < self.start or at + n > self.start + len(self.data):
            self.file.seek(at)
            self.start, self.data = at, self.file.read(min(max(n, WINDOW), self.size - at))
            if len(self.data) < n:
                raise Damaged(f"only {len(self.data)} bytes could be read at {at}")
        return memoryview(self.data)[at - self.start : at - self.start + n]


def frame_end(w: Window, at: int) -> int:
    """Where the Zstandard frame at this place ends, by its block headers."""
    head = bytes(w.get(at, min(18, w.size - at)))
    try:
        size, known = zstandard.frame_header_size(head), zstandard.get_frame_parameters(head)
    except zstandard.ZstdError as e:
        raise Damaged(f"no frame header at {at}: {e}") from None
    at += size
    while True:
        word = int.from_bytes(w.get(at, 3), "little")
        last, kind, length = word & 1, word >> 1 & 3, word >> 3
        if kind == 3:
            raise Damaged(f"a reserved block at {at}")
        at += 3 + (1 if kind == 1 else length)
        if last:
            return at + 4 * known.has_checksum


def frames(w: Window) -> Iterator[tuple[int, bytes]]:
    """Place and decoded bytes of every frame but the skippable ones; the leading one gives the dictionary."""
    at, decoder = 0, zstandard.ZstdDecompressor()
    while at < w.size:
        magic = int.from_bytes(w.get(at, 4), "little")
        if magic & SKIPPABLE_MASK == SKIPPABLE:
            n = int.from_bytes(w.get(at + 4, 4), "little")
            if at == 0 and magic == DICTIONARY_FRAME:
                held = bytes(w.get(8, n))
                try:
                    if held[:4] == FRAME.to_bytes(4, "little"):
                        held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
                    if held[:4] != DICTIONARY.to_bytes(4, "little"):
                        raise Damaged("the leading frame holds no dictionary")
                    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
                except zstandard.ZstdError as e:
                    raise Damaged(f"the dictionary can't be read: {e}") from None
            at += 8 + n
            if at > w.size:
                raise Damaged("a skippable frame reaches beyond the end")
            continue
        end = frame_end(w, at)
        try:
            yield at, decoder.decompressobj().decompress(bytes(w.get(at, end - at)))
        except zstandard.ZstdError as e:
            raise Damaged(f"the frame at {at} can't be decoded: {e}") from None
        at = end


def head_fields(data: bytes, what: str) -> tuple[bytes, dict[str, str], int]:
    """First line, fields by lower-case name and length of a head that ends in an empty line."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise Damaged(f"{what}: its head does not end")
    first, *lines = data[:end].split(b"\r\n")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip() or name != name.strip():
            raise Damaged(f"{what}: a line that is no field")
        key = name.decode("utf-8", "replace").lower()
        if key in fields:
            raise Damaged(f"{what}: {key} stands twice")
        fields[key] = value.strip().decode("utf-8", "replace")
    return first, fields, end + 4


def length_of(fields: dict[str, str], what: str) -> int:
    n = fields.get("content-length", "")
    if not (n.isascii() and n.isdigit()):
        raise Damaged(f"{what}: its length {n!r} is no number")
    return int(n)


def parsed(data: bytes) -> dict:
    """The record in a frame: exactly one, with its fields, its length and, for a response, its digest validated."""
    first, fields, at = head_fields(data, "record")
    if first not in VERSIONS:
        raise Damaged(f"record: it begins with {first[:20]!r}")
    for name in NEEDED:
        if not fields.get(name):
            raise Damaged(f"record: {name} is missing")
    n = length_of(fields, "record")
    if len(data) != at + n + 4 or data[-4:] != b"\r\n\r\n":
        raise Damaged(f"record: {n} bytes are stated, {len(data) - at - 4} are there")
    kind, found = fields["warc-type"].lower(), {"digest": None, "bytes": None, "payload": None}
    if kind in ("response", "revisit") and fields.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        status, http, body = head_fields(data[at : at + n], "HTTP head")
        if not status.startswith(b"HTTP/"):
            raise Damaged("HTTP head: no status line")
        payload = data[at + body : at + n]
        stated = fields.get("warc-payload-digest", "")
        found = {"digest": stated.partition(":")[2] or None, "bytes": length_of(http, "HTTP head") if "content-length" in http else len(payload), "payload": payload}
        if kind == "response":
            if found["bytes"] != len(payload):
                raise Damaged(f"payload: {found['bytes']} bytes are stated, {len(payload)} are there")
            if stated.startswith("sha1:") and base64.b32encode(hashlib.sha1(payload).digest()).decode() != stated[5:]:
                raise Damaged("payload: its digest differs")
        elif payload:
            raise Damaged("revisit: it holds a payload")
    if kind == "revisit" and not fields.get("warc-profile"):
        raise Damaged("revisit: its profile is missing")
    return found | {"type": kind, "id": fields["warc-record-id"], "target": fields.get("warc-target-uri"), "date": fields["warc-date"], "refers": fields.get("warc-refers-to")}


def records_of(file, size: int, name: str, payloads: bool) -> Iterator[tuple]:
    """Rows of RECORDS; what breaks the format ends as a row with an error: a record's the next goes on after, a frame's is the last."""
    try:
        for at, data in frames(Window(file, size)):
            try:
                r = parsed(data)
                yield name, at, r["type"], r["id"], r["target"], r["date"], r["digest"], r["bytes"], r["refers"], r["payload"] if payloads and r["type"] == "response" else None, None
            except Damaged as e:
                yield name, at, *[None] * 8, str(e)
    except Damaged as e:
        yield name, None, *[None] * 8, str(e)


def reader(payloads: bool, rows: int = 1024, held: int = 16 << 20):
    """A mapInArrow function from (file) to RECORDS."""
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary(), pa.string()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for name in files.column("file").to_pylist():
                store, path = fs.FileSystem.from_uri(name)
                found, size = [], 0
                with store.open_input_file(path) as file:
                    for row in records_of(file, file.size(), name, payloads):
                        found.append(row)
                        size += len(row[9] or b"")
                        if len(found) >= rows or size >= held:
                            yield batch(found)
                            found, size = [], 0
                if found:
                    yield batch(found)

    return run


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives named in files(file), one row each (RECORDS), whose error is null where they are right.

    payloads: hold the responses' payloads. An archive is one task's work; each is dealt out alone.
    """
    n = max(1, files.count())
    return files.select("file").repartition(n, "file").mapInArrow(reader(payloads), RECORDS)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tessera/warc-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = f"file://{os.path.abspath(folder.removeprefix('file:'))}"
    found = read_archives(write_archives(table(spark, sf_dir, "pages"), folder), payloads=False)
    sound = found.withColumn("type", F.when(F.col("error").isNull(), F.col("type")).otherwise(F.raise_error(F.concat_ws(": ", "file", "error"))))
    return sound.where(F.col("type").isin("response", "revisit")).select(
        page_of("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        page_of("refers_to").alias("refers_to"),
    )


OP12_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
d AS (SELECT page_id, payload_bytes, sha, list_aggregate(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || sha[5 * (i // 4) + 1:5 * (i // 4) + 5])::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1]), 'string_agg', '') AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first, count(*) OVER (PARTITION BY sha) AS n FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN n = 1 OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n > 1 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM m
"""
