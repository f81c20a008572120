"""Byte-level BPE by a lazily determinised transducer, and its streaming decoder.

The merges are compiled into a machine over bytes. A state stands for the chain of tokens that
end at the last bytes read, as far back as the longest token reaches; two prefixes that agree
there continue alike, so they share a state, and states and arcs are made the first time a text
needs them. An arc emits the tokens that have left this window: no later byte can change them.
The chain is found by pairs: a token may follow another if BPE on the two strings together keeps
both, and at each byte exactly one token that ends there can follow the chain before it.

Null texts count as empty (no ids); very long words need no more than the window; equal rows give
equal rows; extra columns are passed by.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table

MAX_STATES = 600_000
MAX_WORDS = 600_000


class Transducer:
    """Encoder for one merge table; ranks maps a token's bytes to its id, which is its merge rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.prefixes = {b[:i] for b in ranks for i in range(1, len(b))}
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._split: dict[int, tuple[int, int] | None] = {}
        self.words: dict[str, bytes] = {}
        self.forget()

    def forget(self) -> None:
        """Drop all states; they are made again on demand."""
        self.arcs: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.live: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self._state(((b"", -1, ()),))

    def _state(self, live: tuple) -> int:
        """The number of a state: for each place where a later token may start, the bytes read
        since, the last token before it and the tokens not yet emitted before it."""
        known = self.number.get(live)
        if known is None:
            known = self.number[live] = len(self.arcs)
            self.arcs.append({})
            self.live.append(live)
        return known

    def _arc(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        after, new = [], None
        for seen, last, pending in self.live[state]:
            grown = seen + bytes((byte,))
            token = self.ranks.get(grown)
            if token is not None and self.whole(token) and (last < 0 or self.follows(last, token)):
                new = (b"", token, (*pending, token))
            if grown in self.prefixes:
                after.append((grown, last, pending))
        if new is None:
            raise ValueError("the merge table lacks a single-byte token")
        after.append(new)
        sure = 0
        while all(len(x[2]) > sure and x[2][sure] == new[2][sure] for x in after):
            sure += 1
        arc = (self._state(tuple((s, t, p[sure:]) for s, t, p in after)), new[2][:sure])
        self.arcs[state][byte] = arc
        return arc

    def word(self, piece: bytes) -> bytes:
        """Ids of one pre-token, as little-endian uint32."""
        state, out, arcs = 0, [], self.arcs
        for byte in piece:
            state, sure = arcs[state].get(byte) or self._arc(state, byte)
            if sure:
                out += sure
        out += self.live[state][-1][2]
        return np.array(out, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian uint32, each match of the pattern by itself."""
        if len(self.arcs) > MAX_STATES:
            self.forget()
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        words, pieces = self.words, self.pattern.findall(text)
        for w in set(pieces).difference(words):
            words[w] = self.word(w.encode())
        return b"".join(map(words.__getitem__, pieces))

    def merged(self, piece: bytes) -> list[int]:
        """Plain BPE on a short piece: the lowest-ranked adjacent pair first, leftmost on ties."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def follows(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens as they are when their strings stand together."""
        key = (left, right)
        known = self._pairs.get(key)
        if known is None:
            known = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            self._pairs[key] = known
        return known

    def whole(self, token: int) -> bool:
        """Whether BPE on the token's own bytes gives that token alone."""
        known = self._split.get(token)
        if known is None:
            known = self._split[token] = self.merged(self.bytes_of[token]) == [token]
        return known


class Utf8Decoder:
    """Turns a stream of id blocks into text; a code point that a block cuts waits for the next."""

    def __init__(self, bytes_of: list[bytes]):
        self.bytes_of, self.held = bytes_of, b""

    def feed(self, ids: list[int], last: bool = False) -> str:
        raw = self.held + b"".join(map(self.bytes_of.__getitem__, ids))
        cut = len(raw)
        if not last:  # step back over at most three continuation bytes to an unfinished lead byte
            for back in range(1, min(4, len(raw)) + 1):
                byte = raw[-back]
                if byte >= 0xC0:
                    need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                    cut -= back if back < need else 0
                    break
                if byte < 0x80:
                    break
        self.held = raw[cut:]
        return raw[:cut].decode("utf-8", "replace")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def transducer(path: str, pattern: str) -> Transducer:
    """One machine for each Python worker; its states serve all later tasks."""
    return Transducer(read_ranks(path), pattern)


BLOCK = 1 << 16
OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(path: str, pattern: str):
    """A mapInArrow function: encodes each text, then decodes its ids block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path, pattern)
        bytes_of = [machine.bytes_of.get(i, b"") for i in range(max(machine.bytes_of) + 1)]
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column("text"):
                ids = machine.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                numbers, decoder, sha = np.frombuffer(ids, "<u4").tolist(), Utf8Decoder(bytes_of), hashlib.sha256()
                for a in range(0, len(numbers), BLOCK):
                    sha.update(decoder.feed(numbers[a : a + BLOCK], a + BLOCK >= len(numbers)).encode())
                text_sha.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def bpe_round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row for each row of docs(doc_id, text): token count and digests of ids and decoded bytes."""
    run = round_trip(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
    return docs.select("doc_id", "text").mapInArrow(run, OUT)


def op8_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"))
