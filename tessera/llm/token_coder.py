"""Adaptive context-mixing range coder for token ids, many blocks side by side.

A coded segment is a dictionary, then its blocks. The dictionary lists the segment's distinct ids
from frequent to rare, with rounded logarithms of their counts; inside blocks an id is its rank
there. Every block starts its models anew from the dictionary, with its own header and checksum, so
it can be decoded with nothing but the dictionary.

For each id, order 2 guesses the id that last followed the last two, and order 1 has two recent
followers of the last id with their counts. Their chances are mixed into one event (order 2's
guess, one of order 1's followers, or neither): an adaptive estimate for how sure order 2 is, given
what order 1 knows of the same id, then one for how often order 1 holds, shared by its counts. An id
that neither guesses is coded by order 0: counts of all ids of the dictionary, which start from its
figures and grow as ids occur, taken into its sums from time to time. Numpy runs the same step of all
blocks at once (a block is a lane); lanes of different segments can be put together in any way.

Dictionary: "TSRD", number of ids, CRC-32 and size of the payload (little-endian uint32), then zlib
of the ids by rank (little-endian uint16) and their counts' logarithms (bytes). Block: "TSRC",
number of ids, CRC-32 of the ids as little-endian uint32, size of the payload, then the payload
(16-bit big-endian words).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

DICTIONARY, MARK = b"TSRD", b"TSRC"
HEADER = struct.Struct("<4sIII")
BLOCK, LANES, CELLS = 2048, 4096, 1 << 24
MAX_ID = 1 << 16
_SLOTS2, _SLOTS1 = 9, 9  # bits
_ID = np.int32((1 << 17) - 1)
_STEP, _SURE = np.int32(1 << 17), np.int32(63000)
_MIX1, _MIX2 = np.uint32(0x85EBCA6B), np.uint32(0x9E3779B1)
_ROWS, _STRETCH = 24, 16
_BIT, _UPTO = 2.0 ** np.arange(32), (2 << np.arange(32)) - 1
_TOTAL, _ONE = 14, 16
_RENEWALS = {48, 128, 320, 704, 1280}
_WORD, _FULL, _LEAST = (1 << 16) - 1, 1 << 48, 1 << 32
# chances in 1024 of order 1's later follower, and of either, by their counts (0 to 15 each)
_BOTH = np.array([1024 * (a + b) // (a + b + 20) for a in range(16) for b in range(16)], np.int32)
_LATER = np.array([1024 * a // (a + b + 20) for a in range(16) for b in range(16)], np.int32)
_WEIGHT = np.array([round(256 * 2 ** (q / 8)) for q in range(256)], np.int64)


def _prior(logs: np.ndarray) -> tuple[np.ndarray, int]:
    """Starting counts of order 0 and how much an occurrence adds."""
    weight = _WEIGHT[logs]
    size = max(8192, 4 * len(logs))
    return 1 + weight * size // int(weight.sum()), size // 400


class _Models:
    """Models of all lanes; the encoder and the decoder make the same calls in the same order.

    Ids are ranks + 1 here, 0 is none. Lane i starts from tables[whose[i]].
    """

    def __init__(self, tables: list[tuple[np.ndarray, int]], whose: np.ndarray, jumps: bool = False):
        lanes = len(whose)
        self.lane = np.arange(lanes, dtype=np.int64)
        self.guess = np.zeros(lanes << _SLOTS2, np.int32)  # an id, and confidence above it
        self.follow = np.zeros(lanes << _SLOTS1, np.int64)  # two ids with counts, the later one in the low half
        self.base2, self.base1 = self.lane << _SLOTS2, self.lane << _SLOTS1
        self.sure = np.tile(np.repeat(np.array([0, 12000, 12000, 12000], np.int32), 4), lanes)
        self.base4 = self.lane << 4
        self.wide = max(len(start) for start, _ in tables)
        self.starts = np.zeros((len(tables), self.wide), np.int32)
        for row, (start, _) in zip(self.starts, tables):
            row[: len(start)] = start
        self.whose, self.add = whose, np.array([add for _, add in tables], np.int32)
        self.counts = np.zeros((lanes, self.wide), np.uint16)
        self.row = self.wide + 33 | 1  # no power of two: lanes' same places share no cache set
        self.sums = np.zeros((lanes, self.row), np.int32)
        # for every 32 of the order-0 counts: how many upper edges lie before them, then a bit for each in them
        self.cells = (int((self.starts.sum(axis=1) + self.add * max(_RENEWALS)).max()) >> 5) + 1
        self.jump = np.zeros((lanes, self.cells), np.int64) if jumps else None
        self.renew(lanes)

    def renew(self, k: int) -> None:
        """Order 0 takes in what the first k lanes have counted so far."""
        for i in range(0, k, _ROWS):
            j = min(k, i + _ROWS)
            now = self.counts[i:j] * self.add[self.whose[i:j], None]
            now += self.starts[self.whose[i:j]]
            sums = self.sums[i:j, 1 : self.wide + 1]
            np.cumsum(now, axis=1, out=sums)
            if self.jump is not None:
                # the last rank's upper edge, and those after it, are no target's
                bits = _BIT.take(sums & 31)
                bits *= sums < sums[:, -1:]
                cell = sums >> 5
                cell += np.arange(0, (j - i) * self.cells, self.cells, dtype=np.int32)[:, None]
                bits = np.bincount(cell.ravel(), bits.ravel(), (j - i) * self.cells).reshape(j - i, -1).astype(np.int64)
                edges = np.bitwise_count(bits)
                jump = np.cumsum(edges, axis=1, dtype=np.int64)
                jump -= edges
                jump <<= 32
                jump |= bits
                self.jump[i:j] = jump
        # a little under one by the total, so that no product goes beyond the span
        total = self.sums[:, self.wide]
        self.last, self.each = total - 1, (1 - 2.0**-50) / total

    def look(self, at2: np.ndarray, at1: np.ndarray, base4: np.ndarray) -> tuple[np.ndarray, ...]:
        """What the models hold at these places: order 2's slot, order 1's later and earlier follower
        with counts, and how sure order 2 is."""
        self.at2, self.at1 = at2, at1
        slot, pair = self.guess.take(at2), self.follow.take(at1).view(np.int32)
        later, earlier = pair[::2], pair[1::2]
        self.slot, self.later, self.earlier = slot, later, earlier
        self.two, self.one, self.old = slot & _ID, later & _ID, earlier & _ID
        new = (self.one != self.two).view(np.int8) + (self.old != self.two).view(np.int8)
        self.i = slot >> 15
        self.i &= -4
        self.i += new
        self.i = self.i + base4
        self.p = self.sure.take(self.i)
        return slot, later, earlier, self.p

    def learn(self, x: np.ndarray) -> None:
        hit2, hit1, hit0 = _mask(x == self.two), _mask(x == self.one), _mask(x == self.old)
        goal = hit2 & _SURE
        goal -= self.p
        goal >>= 4
        goal += self.p
        self.sure[self.i] = goal
        plain = x + _STEP
        more = self.slot - self.two
        np.minimum(more, 2 * _STEP, out=more)
        more &= hit2
        more += plain
        self.guess[self.at2] = more
        # the id comes first among the followers of the last one; counts end at 15
        more = self.later - self.one
        more &= hit1
        hit0 &= self.earlier - self.old
        more |= hit0
        np.minimum(more, 14 * _STEP, out=more)
        pair = np.empty((len(x), 2), np.int32)
        np.add(more, plain, out=pair[:, 0])
        hit1 &= self.later ^ self.earlier
        np.bitwise_xor(self.later, hit1, out=pair[:, 1])
        self.follow[self.at1] = pair.view(np.int64)[:, 0]

    def find(self, lanes: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rank at each target of the order-0 counts, with counts before it and its own; it is counted."""
        goal = np.minimum(target, self.last.take(lanes))
        cell = goal >> 5
        cell += lanes * self.cells
        cell = self.jump.take(cell)
        # edges up to the target: those before its cell and those in it
        goal &= 31
        upto = _UPTO.take(goal)
        upto &= cell
        ranks = cell >> 32
        ranks += np.bitwise_count(upto)
        at = lanes * self.row
        at += ranks
        before = self.sums.take(at)
        counted = lanes * self.wide
        counted += ranks
        self.counts.ravel()[counted] += np.uint16(1)
        return ranks, before, self.sums.take(at + 1) - before


def _mask(held: np.ndarray) -> np.ndarray:
    """All bits where held."""
    mask = held.astype(np.int32)
    return np.negative(mask, out=mask)


def _choice(e2: np.ndarray, e1: np.ndarray, e0: np.ndarray, past2: np.ndarray, past1: np.ndarray, past0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower edge and size of the choice that lies past these upper edges; the edges ascend."""
    below = e2 & past2
    np.maximum(below, e1 & past1, out=below)
    np.maximum(below, e0 & past0, out=below)
    # passed edges are the largest unsigned numbers
    size = (e2 | past2).view(np.uint32)
    np.minimum(size, (e1 | past1).view(np.uint32), out=size)
    np.minimum(size, (e0 | past0).view(np.uint32), out=size)
    np.minimum(size, np.uint32(1 << _TOTAL), out=size)
    size = size.view(np.int32)
    size -= below
    return below, size


def _edges(slot: np.ndarray, later: np.ndarray, earlier: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Upper edges in 1 << _TOTAL of the choices order 2, later and earlier follower in order 1."""
    two = slot & _ID
    first = p >> _ONE - _TOTAL
    first += slot > _ID  # nothing where order 2 has no guess, which is never sure
    later = (later >> 17) * ((later & _ID) != two)
    later <<= 4
    later += (earlier >> 17) * ((earlier & _ID) != two)
    rest = (1 << _TOTAL) - first
    both = _BOTH.take(later)
    both *= rest
    both >>= 10
    both += first
    rest *= _LATER.take(later)
    rest >>= 10
    rest += first
    return first, rest, both


def _lanes(counts: np.ndarray) -> np.ndarray:
    """Number of lanes (longest first) that are still running at each step."""
    steps = int(counts[0]) if len(counts) else 0
    return np.searchsorted(-counts, -np.arange(1, steps + 1), "right")


def _runs(sizes: list[int]) -> list[tuple[int, int]]:
    """Lanes in runs of about equal numbers, LANES at most side by side, fewer where long dictionaries
    would take too much memory; sizes are those of the lanes' dictionaries."""
    most, n = max(1, min(LANES, CELLS // max([1, *sizes]))), len(sizes)
    runs = -(-n // most)
    return [(n * i // runs, n * (i + 1) // runs) for i in range(runs)]


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The dictionary and the blocks of one segment of ids under 65,536; nothing for no ids."""
    found = encode_segments([ids])[0]
    return [found] if found else []


def encode_segments(segments: list[np.ndarray]) -> list[bytes]:
    """Each segment's dictionary and blocks; the blocks of all segments share the coder's lanes."""
    heads, parts, priors, whose = [], [], {}, []
    for number, ids in enumerate(segments):
        ids = np.asarray(ids)
        if not len(ids):
            heads.append(b"")
            continue
        if ids.max() >= MAX_ID or ids.min() < 0:
            raise ValueError(f"ids must lie from 0 to {MAX_ID - 1}")
        value, count = np.unique(ids, return_counts=True)
        order = np.argsort(-count, kind="stable")
        value, logs = value[order], np.minimum(255, np.rint(8 * np.log2(count[order]))).astype(np.uint8)
        body = zlib.compress(value.astype("<u2").tobytes() + logs.tobytes())
        heads.append(HEADER.pack(DICTIONARY, len(value), zlib.crc32(body), len(body)) + body)
        rank = np.zeros(MAX_ID, np.int32)
        rank[value] = np.arange(len(value))
        prior = _prior(logs)
        for a in range(0, len(ids), BLOCK):
            parts.append((rank[ids[a : a + BLOCK]], zlib.crc32(ids[a : a + BLOCK].astype("<u4").tobytes())))
            whose.append(number)
        priors[number] = prior
    order = sorted(range(len(parts)), key=lambda i: -len(parts[i][0]))
    blocks: list[bytes] = [b""] * len(parts)
    for a, b in _runs([len(priors[whose[i]][0]) for i in order]):
        rows = order[a:b]
        for i, block in zip(rows, _encode([parts[i] for i in rows], [priors[whose[i]] for i in rows])):
            blocks[i] = block
    out = [[h] for h in heads]
    for number, block in zip(whose, blocks):
        out[number].append(block)
    return [b"".join(x) for x in out]


def _tables(priors: list[tuple[np.ndarray, int]]) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
    """The distinct starting figures, and which of them each lane has."""
    found: dict[int, int] = {}
    whose = [found.setdefault(id(p), len(found)) for p in priors]
    return [priors[whose.index(i)] for i in range(len(found))], np.array(whose)


def _stretches(running: np.ndarray) -> list[tuple[int, int]]:
    """Steps in stretches of _STRETCH at most, with as many lanes throughout and no renewal inside."""
    cuts = {0, len(running), *range(0, len(running), _STRETCH), *(r for r in _RENEWALS if r < len(running)), *(np.flatnonzero(np.diff(running)) + 1).tolist()}
    at = sorted(cuts)
    return list(zip(at, at[1:]))


def _encode(parts: list[tuple[np.ndarray, int]], priors: list[tuple[np.ndarray, int]]) -> list[bytes]:
    lanes, counts = len(parts), np.array([len(p) for p, _ in parts], np.int64)
    columns = np.zeros((int(counts[0]) + 2, lanes), np.int32)  # two steps of none come first
    for lane, (part, _) in enumerate(parts):
        columns[2 : 2 + len(part), lane] = part + 1
    m, low, span = _Models(*_tables(priors)), np.zeros(lanes, np.int64), np.full(lanes, _FULL - 1, np.int64)
    words, at = np.zeros((lanes, BLOCK), np.uint32), np.zeros(lanes, np.int64)

    def renew(i: np.ndarray) -> None:
        while len(i):
            now = low[i]
            words[i, at[i]] = now >> 32
            at[i] += 1
            low[i] = (now & _LEAST - 1) << 16
            now = span[i] << 16
            span[i] = now
            i = i[now < _LEAST]

    running = _lanes(counts)
    for begin, end in _stretches(running):
        k = int(running[begin])
        if words.shape[1] < int(at.max()) + 4 * _STRETCH:
            words = np.pad(words, ((0, 0), (0, BLOCK)))
        if begin in _RENEWALS:
            m.renew(k)
        x = columns[begin + 2 : end + 2, :k]
        # all ids are known here: places, edges and order 0 are found for the whole stretch at once
        b = columns[begin + 1 : end + 1, :k].view(np.uint32) * _MIX1
        at1 = (b >> 32 - _SLOTS1) + m.base1[:k]
        at2 = ((columns[begin:end, :k].view(np.uint32) * _MIX2 ^ b) >> 32 - _SLOTS2) + m.base2[:k]
        base4, held = m.base4[:k], np.empty((4, end - begin, k), np.int32)
        for row in range(end - begin):
            held[0, row], held[1, row], held[2, row], held[3, row] = m.look(at2[row], at1[row], base4)
            m.learn(x[row])
        slot, later, earlier, p = held
        e2, e1, e0 = _edges(slot, later, earlier, p)
        past2 = x != (slot & _ID)
        past1 = past2 & ~((x == (later & _ID)) & (e1 > e2))
        past0 = past1 & ~((x == (earlier & _ID)) & (e0 > e1))
        below, size = (v.astype(np.int64) for v in _choice(e2, e1, e0, _mask(past2), _mask(past1), _mask(past0)))
        step, lane = np.nonzero(past0)
        rank = x[step, lane] - 1
        np.add.at(m.counts.ravel(), lane * m.wide + rank, np.uint16(1))
        place = lane * m.row + rank
        before, each = m.sums.take(place), m.each[lane]
        own = m.sums.take(place + 1) - before
        cut = np.searchsorted(step, np.arange(end - begin + 1)).tolist()
        for row, (i, j) in enumerate(zip(cut, cut[1:])):
            unit = span[:k] >> _TOTAL
            low[:k] += below[row] * unit
            unit *= size[row]
            rest = lane[i:j]
            part = (unit.take(rest) * each[i:j]).astype(np.int64)
            low[rest] += part * before[i:j]
            part *= own[i:j]
            unit[rest] = part
            span[:k] = unit
            renew((unit < _LEAST).nonzero()[0])
    for j in range(3):
        words[m.lane, at + j] = (low >> 32 - 16 * j) & (_WORD if j else -1)
    out = []
    for i, (part, crc) in enumerate(parts):
        w = words[i, : at[i] + 3]
        value = int.from_bytes((w & _WORD).astype(">u2").tobytes()) + (int.from_bytes((w >> 16).astype(">u2").tobytes()) << 16)
        body = value.to_bytes(2 * len(w))
        out.append(HEADER.pack(MARK, len(part), crc, len(body)) + body)
    return out


def decode_blocks(data: bytes) -> np.ndarray:
    """The ids of segments that stand one after another; a damaged one is an error."""
    heads, bodies, tables, at = [], [], [], 0
    known = None
    while at < len(data):
        if len(data) - at < HEADER.size:
            raise ValueError("a cut token segment")
        mark, n, crc, size = HEADER.unpack_from(data, at)
        at += HEADER.size
        body = data[at : at + size]
        at += size
        if mark == DICTIONARY:
            if zlib.crc32(body) != crc:
                raise ValueError("a token dictionary's checksum doesn't match")
            raw = zlib.decompress(body)
            known = np.frombuffer(raw, "<u2", n).astype(np.uint32), _prior(np.frombuffer(raw, np.uint8, n, 2 * n))
        elif mark == MARK and known is not None and len(body) == size and n <= BLOCK:
            heads.append((n, crc))
            bodies.append(body)
            tables.append(known)
        else:
            raise ValueError("not a token block")
    out = [np.zeros(0, np.uint32)]
    for a, b in _runs([len(ids) for ids, _ in tables]):
        out += _decode(heads[a:b], bodies[a:b], tables[a:b])
    return np.concatenate(out)


def _decode(heads: list[tuple[int, int]], bodies: list[bytes], tables: list[tuple[np.ndarray, tuple[np.ndarray, int]]]) -> list[np.ndarray]:
    order = sorted(range(len(heads)), key=lambda i: -heads[i][0])
    counts = np.array([heads[i][0] for i in order], np.int64)
    lanes = len(order)
    width = max(3, *(len(bodies[i]) // 2 for i in order)) + 3
    words = np.zeros((lanes, width), np.uint16)
    for row, i in enumerate(order):
        w = np.frombuffer(bodies[i], ">u2", len(bodies[i]) // 2)
        words[row, : len(w)] = w
    code = words[:, :3] @ np.array([1 << 32, 1 << 16, 1])
    words, at = words.ravel(), np.arange(lanes, dtype=np.int64) * width + 3
    m, span = _Models(*_tables([tables[i][1] for i in order]), True), np.full(lanes, _FULL - 1, np.int64)
    last_of = np.array([len(tables[i][0]) - 1 for i in order], np.int64)
    columns = np.zeros((int(counts[0]), lanes), np.int32)
    mixed, base4 = np.zeros(lanes, np.uint32), m.base4
    last = np.zeros(lanes, np.uint32)

    def renew(i: np.ndarray) -> None:
        while len(i):
            place = at[i]
            code[i] = (code[i] << 16) | words.take(place, mode="clip")
            at[i] = place + 1
            now = span[i] << 16
            span[i] = now
            i = i[now < _LEAST]

    for step, k in enumerate(_lanes(counts)):
        if step in _RENEWALS:
            m.renew(k)
        b = last[:k] * _MIX1
        e2, e1, e0 = _edges(*m.look(((mixed[:k] ^ b) >> 32 - _SLOTS2) + m.base2[:k], (b >> 32 - _SLOTS1) + m.base1[:k], base4[:k]))
        unit, c = span[:k] >> _TOTAL, code[:k]
        # exact: a quotient lies further from the next whole number than the division errs
        goal = (c / unit).astype(np.int32)
        miss = goal >= e0
        past2, past1 = _mask(goal >= e2), _mask(goal >= e1)
        below, size = _choice(e2, e1, e0, past2, past1, _mask(miss))
        past2 &= m.two ^ m.one
        past1 &= m.one ^ m.old
        x = m.two ^ past2
        x ^= past1
        c -= below * unit
        unit *= size
        rest = miss.nonzero()[0]
        part = (unit.take(rest) * m.each.take(rest)).astype(np.int64)
        held = code.take(rest)
        found, before, own = m.find(rest, (held / np.maximum(part, 1)).astype(np.int64))
        code[rest] = held - part * before
        part *= own
        unit[rest] = np.maximum(part, 1)
        x[rest] = np.minimum(found, last_of.take(rest)) + 1
        span[:k] = unit
        m.learn(x)
        renew((unit < _LEAST).nonzero()[0])
        mixed[:k] = last[:k] * _MIX2
        last[:k] = x
        columns[step, :k] = x
    out: list = [None] * lanes
    for row, i in enumerate(order):
        ids = tables[i][0][columns[: counts[row], row] - 1]
        if zlib.crc32(ids.astype("<u4").tobytes()) != heads[i][1]:
            raise ValueError("a token block's checksum doesn't match")
        out[i] = ids
    return out
