"""Token ids by the tokenizers library, kept per white-space-separated word.

The tokenizer drops white space, lower-cases, and none of its pieces or normalisations reaches
across a blank or a line end, so a text's ids are its words' ids one after another. A letter and an
ASCII mark after it are two pieces as well, so they are kept apart. Each distinct word is encoded by
the library once for each Python worker; in a text its words are found by numpy in an open table
that is keyed by the words' own bytes (up to KEY_BYTES of them; longer words go by a dict), so no
two words can be mixed up. A worker keeps MAX_WORDS words; when there are more it starts anew.

The tokenizer file's added tokens are one id each wherever they stand in a text, as by the library's
defaults: a text is cut at them, in their exact case, before its words are lower-cased. A word that
looks like one only after lower-casing is cut between its last letter and the mark after it, so the
library never takes it for one.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tessera.llm.common import U64, chunks, mix, text_bytes

MAX_WORDS, SLOT_BITS, KEY_BYTES, PIECE = 1 << 20, 21, 16, 1 << 20
END = 1
_SPACE, _LETTER, _MARK, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[list(b" \t\n\r")] = _SPACE
_KIND[97:123] = _LETTER
_KIND[list(rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~""")] = _MARK
_TAIL = np.zeros(256, bool)  # second bytes of the letters à-ö and ø-ÿ, whose first byte is 0xC3
_TAIL[0xA0:0xB7] = _TAIL[0xB8:0xC0] = True
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+")
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def _spans(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased bytes; rows begin at offsets."""
    kind = _KIND[low]
    word = kind != _SPACE
    letter = kind == _LETTER
    letter[1:] |= _TAIL[low[1:]] & (low[:-1] == 0xC3)
    start = word.copy()
    start[1:] &= ~word[:-1] | ((kind[1:] == _MARK) & letter[:-1])
    inner = offsets[1:-1]
    inner = inner[inner < len(low)]
    start[inner] = word[inner]
    end = np.ones(len(low) + 1, bool)
    end[0] = False
    end[1:-1] = word[:-1] & (~word[1:] | start[1:])
    end[-1] = bool(len(low)) and word[-1]
    return np.flatnonzero(start), np.flatnonzero(end)


class WordIds:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("an added token that is not matched as it stands")
        self.added = {t.content: i for i, t in added.items()}
        self.border = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.signs = [t.encode() for t in self.added]
        # words of plain letters need no normalisation and are one piece: the model takes their bytes' stand-ins
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # all their bytes but these two stand for themselves
        self.stand_in = [("\xa0", level.pre_tokenize_str("à")[0][0][1]), ("\xad", level.pre_tokenize_str("í")[0][0][1])]
        self.start_anew()

    def start_anew(self) -> None:
        self.low, self.high = np.zeros(1 << SLOT_BITS, U64), np.zeros(1 << SLOT_BITS, U64)
        self.of = np.full(1 << SLOT_BITS, -1, np.int32)
        self.size = np.zeros(1 << SLOT_BITS, np.uint8)
        self.long: dict[bytes, int] = {}
        self.n_words = self.n_ids = 0
        self.first, self.count = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, "<u4")

    def learn(self, words: list[bytes]) -> int:
        """Encodes the words and returns the number of the first of them."""
        found: list[list[int]] = [[]] * len(words)
        rest = []
        for k, w in enumerate(words):
            if w.isalpha():
                found[k] = [t.id for t in self.model.tokenize(w.decode())]
            elif _LETTERS.fullmatch(w):
                name = w.decode("latin-1")
                for c, other in self.stand_in:
                    name = name.replace(c, other)
                found[k] = [t.id for t in self.model.tokenize(name)]
            else:
                rest.append(k)
        for a in range(0, len(rest), 4096):
            part = rest[a : a + 4096]
            for k, e in zip(part, self.tokenizer.encode_batch_fast([words[k].decode() for k in part], add_special_tokens=False)):
                found[k] = e.ids
        count = np.array([len(f) for f in found], np.int64)
        new = np.array([i for f in found for i in f], "<u4")
        begin, a, b = self.n_words, self.n_ids, self.n_ids + len(new)
        while len(self.first) < begin + len(words):
            self.first, self.count = (np.pad(x, (0, len(x))) for x in (self.first, self.count))
        while len(self.ids) < b:
            self.ids = np.pad(self.ids, (0, len(self.ids)))
        self.ids[a:b] = new
        self.first[begin : begin + len(words)] = a + np.cumsum(count) - count
        self.count[begin : begin + len(words)] = count
        self.n_words, self.n_ids = begin + len(words), b
        return begin

    def _slots(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (mix(low ^ (high * U64(0x9E3779B97F4A7C15)) ^ size.astype(U64)) >> U64(64 - SLOT_BITS)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Numbers of known words, -1 for others."""
        out = self.of[slot]
        open_ = np.flatnonzero((out >= 0) & ((self.low[slot] != low) | (self.high[slot] != high) | (self.size[slot] != size)))
        at = slot[open_]
        while len(open_):
            at = (at + 1) & ((1 << SLOT_BITS) - 1)
            out[open_] = self.of[at]
            other = (out[open_] >= 0) & ((self.low[at] != low[open_]) | (self.high[at] != high[open_]) | (self.size[at] != size[open_]))
            open_, at = open_[other], at[other]
        return out

    def _keep(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, slot: np.ndarray, number: np.ndarray) -> None:
        """Enters distinct new words into the open table."""
        while len(slot):
            free = np.flatnonzero(self.of[slot] < 0)
            place, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.low[place], self.high[place], self.size[place], self.of[place] = low[won], high[won], size[won], number[won]
            left = np.ones(len(slot), bool)
            left[won] = False
            low, high, size, slot, number = (x[left] for x in (low, high, size, slot, number))
            slot = (slot + 1) & ((1 << SLOT_BITS) - 1)

    def numbers(self, low: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word low[start:end]; new words are learnt."""
        padded = low + b"\0" * KEY_BYTES
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        size = end - start
        k1, k2 = eight[start] & _MASK[np.minimum(size, 8)], eight[start + 8 if len(start) else start] & _MASK[np.clip(size - 8, 0, 8)]
        slot = self._slots(k1, k2, size)
        out = self._find(k1, k2, size, slot).astype(np.int64)
        wide = np.flatnonzero(size > KEY_BYTES)
        out[wide] = [self.long.get(low[a:b], -1) for a, b in zip(start[wide].tolist(), end[wide].tolist())]
        new = np.flatnonzero(out < 0)
        if len(new):
            if self.n_words + len(new) > MAX_WORDS and self.n_words:
                self.start_anew()
                return self.numbers(low, start, end)
            seen: dict[bytes, int] = {}
            which = [seen.setdefault(low[a:b], len(seen)) for a, b in zip(start[new].tolist(), end[new].tolist())]
            out[new] = self.learn(list(seen)) + np.array(which)
            _, first = np.unique(out[new], return_index=True)
            once = new[first]
            narrow = once[size[once] <= KEY_BYTES]
            self._keep(k1[narrow], k2[narrow], size[narrow], slot[narrow], out[narrow])
            for i in once[size[once] > KEY_BYTES].tolist():
                self.long[low[start[i] : end[i]]] = int(out[i])
        return out

    def plain(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in raw, which hold no added token, each with the end id, and their places."""
        low = raw.lower()
        start, end = _spans(np.frombuffer(low, np.uint8), offsets)
        word = self.numbers(low, start, end)
        count = self.count[word].astype(np.int64)
        at = np.searchsorted(start, offsets)  # the first word of each row
        before = np.concatenate([[0], np.cumsum(count)])
        ends = before[at] + np.arange(len(at))  # where each row's ids begin
        out = np.full(int(ends[-1]), END, "<u4")
        place = before[:-1] + np.repeat(np.arange(len(at) - 1), np.diff(at))
        first = self.first[word].astype(np.int64)
        k = 0
        while len(place):
            some = count > k
            place, first, count = place[some], first[some], count[some]
            out[place + k] = self.ids[first + k]
            k += 1
        return out, ends

    def encode(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of each text and the end id, one text after another; null counts as empty."""
        raw, offsets = text_bytes(column)
        ids, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for a, b in chunks(offsets):
            if b - a == 1 and offsets[b] - offsets[a] > 2 * PIECE:
                ids.append(self._long_text(raw[offsets[a] : offsets[b]].tobytes()))
                sizes.append(np.array([len(ids[-1])]))
                continue
            part, o = raw[offsets[a] : offsets[b]].tobytes(), offsets[a : b + 1] - offsets[a]
            if any(s in part for s in self.signs):
                for x, y in zip(o[:-1].tolist(), o[1:].tolist()):
                    ids.append(self._cut_at_added(part[x:y]))
                    sizes.append(np.array([len(ids[-1])]))
            else:
                found, at = self.plain(part, o)
                ids.append(found)
                sizes.append(np.diff(at))
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def _long_text(self, raw: bytes) -> np.ndarray:
        """A long text in pieces that end at a blank or line end, where there is one."""
        out, a = [], 0
        while a < len(raw):
            b = min(len(raw), a + PIECE)
            if b < len(raw):
                at = max(raw.rfind(b" ", a, b), raw.rfind(b"\n", a, b))
                b = at + 1 if at >= a else next((x + 1 for x in (raw.find(b" ", b), raw.find(b"\n", b)) if x >= 0), len(raw))
            out.append(self._cut_at_added(raw[a:b])[:-1])
            a = b
        return np.concatenate([*out, np.array([END], "<u4")])

    def _cut_at_added(self, raw: bytes) -> np.ndarray:
        parts = self.border.split(raw.decode())
        out = [np.array([self.added[p]], "<u4") if p in self.added else self.plain(p.encode(), np.array([0, len(p.encode())]))[0][:-1] for p in parts]
        return np.concatenate([*out, np.array([END], "<u4")])


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
