"""A range coder for token ids whose model mixes predictions of orders 0 to 2 and adapts as it goes.

A block is coded on its own, from an empty model. Its ids lie in lanes, stretches of equal length that advance side by side, so every
operation of coder and model is one over arrays. All lanes share the model:

- order 2 and order 1 remember, for the last two ids (hashed) and the last id, the id that followed and how sure that is;
- a table by (whether both agree, sureness of order 2, sureness of order 1) counts how often either was right. What it says is mixed with
  what order 2 alone, order 1 alone and the whole block say, each weighed by the evidence for it, into the shares of three cases: the id
  is order 2's, it is order 1's, it is neither;
- order 0 gives the shares of ids in the third case, with an escape for ids that the block has not shown yet.

One arithmetic step codes case and id. The model learns every few steps, first after each step, then at most every EPOCH: between,
encoder and decoder use the same tables. Shares come from integers by single divisions, so every machine computes the same ones.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids of a block, lanes of a full one, and steps between two updates of the model at most.
BLOCK, LANES, EPOCH = 1 << 20, 2048, 32
#: Shares of the three cases, and of order 0's ids, are fractions of these powers of two.
CASE_BITS, HASH_BITS = 12, 18
#: Sureness runs from 0 (nothing known) to this.
SURE = 7

HEAD = struct.Struct("<4sIIIIII")
MAGIC = b"idb1"
_WORD = np.uint64(32)
_LOW = np.uint64((1 << 32) - 1)


def _epochs(steps: int):
    """(first, last) steps between updates: 1, 1, 2, 4 ... up to EPOCH."""
    at, n = 0, 1
    while at < steps:
        yield at, min(at + n, steps)
        at += n
        n = min(EPOCH, max(1, at))


class _Model:
    """What the block has taught so far; ids are below `alphabet`, which stands for no id."""

    def __init__(self, alphabet: int):
        self.alphabet = alphabet
        self.bits = max(18, alphabet.bit_length() + 2)
        # Shares of a step fit into 32 bits, unless there are very many ids.
        self.kind = np.int32 if CASE_BITS + self.bits < 31 else np.int64
        self.raw_bits = max(1, (alphabet - 1).bit_length())
        nothing = alphabet * (SURE + 1)
        self.second = np.full(1 << HASH_BITS, nothing, np.int32)
        self.first = np.full(alphabet + 1, nothing, np.int32)
        self.cases = np.zeros((2, SURE + 1, SURE + 1, 3), np.int64)
        self.counts = np.zeros(alphabet, np.int64)
        self.refresh()

    def refresh(self) -> None:
        """The tables that coding uses until the next update."""
        total = self.cases.sum(axis=(0, 1, 2)) + np.array([1, 1, 2])
        share = total / total.sum()
        by_second, by_first = self.cases.sum(axis=2), self.cases.sum(axis=1)
        second = (by_second + 8 * share) / (by_second.sum(axis=-1, keepdims=True) + 8)
        first = (by_first + 8 * share) / (by_first.sum(axis=-1, keepdims=True) + 8)
        mixed = (self.cases + 8 * (second[:, :, None] + first[:, None])) / (self.cases.sum(axis=-1, keepdims=True) + 16)
        whole = 1 << CASE_BITS
        self.hit2 = (1 + (mixed[..., 0] * (whole - 3)).astype(self.kind)).ravel()
        self.hit1 = self.hit2 + (1 + (mixed[..., 1] * (whole - 3)).astype(self.kind)).ravel()

        self.seen = np.flatnonzero(self.counts).astype(np.int32)
        n, counts = len(self.seen), self.counts[self.seen]
        free = (1 << self.bits) - n - 1
        width = 1 + free * counts // max(1, int(counts.sum()) + n)
        self.cum = np.concatenate(([0], width.cumsum())).astype(self.kind)
        self.width = np.append(width, (1 << self.bits) - self.cum[-1]).astype(self.kind)
        self.place = np.full(self.alphabet, n, np.int32)
        self.place[self.seen] = np.arange(n)

    def slots(self) -> np.ndarray:
        """Order 0's place of each of its shares, for decoding."""
        return np.repeat(np.arange(len(self.width), dtype=np.int32), self.width)

    def look(self, before: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """Keys of order 2, what order 2 and order 1 say, and the cell of the case table."""
        key = before.view(np.uint32) * np.uint32(0x9E3779B1) + last.view(np.uint32) * np.uint32(0x85EBCA6B)
        key = ((key ^ (key >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - HASH_BITS)).astype(np.intp)
        second, first = self.second.take(key), self.first.take(last)
        same = (second >> 3) == (first >> 3)
        return key, second, first, (same.astype(np.int32) << 6) + ((second & SURE) << 3) + (first & SURE)

    @staticmethod
    def _learned(known: np.ndarray, ids: np.ndarray) -> np.ndarray:
        sure = known & SURE
        right = (known >> 3) == ids
        return np.where(right, known + (sure < SURE), np.where(sure > 1, known - (sure + 1 >> 1), (ids << 3) + 1))

    def update(self, key, last, second, first, cell, case, ids) -> None:
        """Learn from ids coded since the last update, in their order: of several in one place the last one stays."""
        self.cases += np.bincount(cell * 3 + case, minlength=self.cases.size).reshape(self.cases.shape)
        self.counts += np.bincount(ids[case == 2], minlength=self.alphabet)
        self.second[key] = self._learned(second, ids)
        self.first[last] = self._learned(first, ids)
        self.refresh()


class _Encoder:
    """The lanes' intervals; words that an interval has settled lie in a table, carries added to the word before."""

    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
        self.words, self.n = np.zeros((lanes, 2 * steps + 2), np.uint32), np.zeros(lanes, np.int64)

    def _carry(self, lanes: np.ndarray) -> None:
        """One more in the lanes' last words, and in those before as long as that makes zeros of them."""
        at = self.n[lanes] - 1
        while lanes.size:
            self.words[lanes, at] += np.uint32(1)
            over = self.words[lanes, at] == 0
            lanes, at = lanes[over], at[over] - 1

    def code(self, lanes, start: np.ndarray, width: np.ndarray, bits: int) -> None:
        """Narrow the intervals of `lanes` (a slice or places) to [start, start + width) of 2 ** bits."""
        unit = self.range[lanes] >> np.uint64(bits)
        low = self.low[lanes]
        moved = low + unit * start
        span = unit * width
        if (over := np.flatnonzero(moved < low)).size:
            self._carry(over if isinstance(lanes, slice) else lanes[over])
        self.low[lanes], self.range[lanes] = moved, span
        if (full := np.flatnonzero(span <= _LOW)).size:
            full = full if isinstance(lanes, slice) else lanes[full]
            low = self.low[full]
            self.words[full, self.n[full]] = low >> _WORD
            self.n[full] += 1
            self.low[full] = low << _WORD
            self.range[full] <<= _WORD

    def finish(self) -> bytes:
        """Numbers of words and the words, lane by lane."""
        ends = self.low + _LOW
        self._carry(np.flatnonzero(ends < self.low))
        self.words[np.arange(len(self.n)), self.n] = ends >> _WORD
        self.n += 1
        held = np.arange(int(self.n.max())) < self.n[:, None]
        return self.n.astype("<u4").tobytes() + self.words[:, : held.shape[1]][held].astype("<u4").tobytes()


class _Decoder:
    def __init__(self, lanes: int, data: bytes):
        n = np.frombuffer(data, "<u4", lanes).astype(np.int64)
        # Beyond a lane's last word it reads zeros, or its neighbour's words, below what decides.
        self.words = np.concatenate((np.frombuffer(data, "<u4", offset=4 * lanes).astype(np.uint64), np.zeros(4, np.uint64)))
        self.at, self.end = np.concatenate(([0], n.cumsum()[:-1])), n.cumsum()
        self.value = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, (1 << 64) - 1, np.uint64)
        for _ in range(2):
            self.value = (self.value << _WORD) | self._next(np.arange(lanes))

    def _next(self, lanes: np.ndarray) -> np.ndarray:
        at = self.at[lanes]
        self.at[lanes] = at + 1
        end = self.end[lanes]
        return np.where(at < end, self.words.take(np.minimum(at, end)), np.uint64(0))

    def target(self, lanes, bits: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
        unit = self.range[lanes] >> np.uint64(bits)
        return unit, np.minimum(self.value[lanes] // unit, np.uint64((1 << bits) - 1)).astype(kind)

    def take(self, lanes, unit: np.ndarray, start: np.ndarray, width: np.ndarray) -> None:
        self.value[lanes] -= unit * start.astype(np.uint64)
        span = unit * width.astype(np.uint64)
        self.range[lanes] = span
        if (low := np.flatnonzero(span <= _LOW)).size:
            low = low if isinstance(lanes, slice) else lanes[low]
            self.value[low] = (self.value[low] << _WORD) | self._next(low)
            self.range[low] <<= _WORD


def _shape(n: int) -> tuple[int, int, int]:
    """Lanes, steps, and the steps of the last lane, of n ids."""
    steps = -(-n // min(LANES, max(1, n // 64)))
    lanes = -(-n // steps)
    return lanes, steps, n - (lanes - 1) * steps


def encode(ids: np.ndarray) -> bytes:
    """One block of ids (at least one, below 2 ** 24): a head with checksums of data and ids, and the coded lanes."""
    ids = np.ascontiguousarray(ids, np.int32)
    n, alphabet = len(ids), int(ids.max()) + 1
    lanes, steps, last_steps = _shape(n)
    model, coder = _Model(alphabet), _Encoder(lanes, steps)
    table = np.zeros((lanes, steps), np.int32)
    table.ravel()[:n] = ids
    table = np.ascontiguousarray(table.T)
    history = np.concatenate((np.full((2, lanes), alphabet, np.int32), table))
    for begin, end in _epochs(steps):
        live = [lanes if t < last_steps else lanes - 1 for t in range(begin, end)]
        if live[-1] == lanes:
            own, last, before = (x[begin + d : end + d].ravel() for x, d in ((table, 0), (history, 1), (history, 0)))
        else:
            own, last, before = (np.concatenate([x[t + d, :w] for t, w in zip(range(begin, end), live, strict=True)]) for x, d in ((table, 0), (history, 1), (history, 0)))
        key, second, first, cell = model.look(before, last)
        in2, in1 = (second >> 3) == own, (first >> 3) == own
        case = np.where(in2, 0, np.where(in1, 1, 2)).astype(np.int32)
        hit2, hit1, place = model.hit2.take(cell), model.hit1.take(cell), model.place.take(own)
        rest = (1 << CASE_BITS) - hit1
        start = np.where(in2, 0, np.where(in1, hit2 << model.bits, (hit1 << model.bits) + rest * model.cum.take(place))).astype(np.uint64)
        width = np.where(in2, hit2 << model.bits, np.where(in1, hit1 - hit2 << model.bits, rest * model.width.take(place))).astype(np.uint64)
        escape = (case == 2) & (place == len(model.seen))
        at = 0
        for w in live:
            row = slice(at, at + w)
            coder.code(slice(0, w), start[row], width[row], CASE_BITS + model.bits)
            if (new := np.flatnonzero(escape[row])).size:
                coder.code(new, own[row][new].astype(np.uint64), np.uint64(1), model.raw_bits)
            at += w
        model.update(key, last, second, first, cell, case, own)
    data = coder.finish()
    ids_crc = zlib.crc32(ids.astype("<u4"))
    return HEAD.pack(MAGIC, n, alphabet, lanes, len(data), _checksum(data, n, alphabet, lanes), ids_crc) + data


def _checksum(data: bytes, *head: int) -> int:
    return zlib.crc32(data, zlib.crc32(struct.pack("<3I", *head)))


def decode(block: bytes) -> np.ndarray:
    """The ids of a block as little-endian unsigned 32-bit integers; a block that is damaged is an error."""
    magic, n, alphabet, lanes, size, data_crc, ids_crc = HEAD.unpack_from(block)
    data = bytes(block[HEAD.size : HEAD.size + size])
    if magic != MAGIC or len(data) != size or _checksum(data, n, alphabet, lanes) != data_crc:
        raise ValueError("a block of ids is damaged")
    expected_lanes, steps, last_steps = _shape(n)
    if lanes != expected_lanes:
        raise ValueError("a block of ids has another number of lanes than its ids need")
    model, coder = _Model(alphabet), _Decoder(lanes, data)
    history = np.full((steps + 2, lanes), alphabet, np.int32)
    for begin, end in _epochs(steps):
        slots, bits, told = model.slots(), model.bits, []
        for t in range(begin, end):
            w = lanes if t < last_steps else lanes - 1
            row = slice(0, w)
            last = history[t + 1, :w]
            key, second, first, cell = model.look(history[t, :w], last)
            hit2, hit1 = model.hit2.take(cell), model.hit1.take(cell)
            unit, target = coder.target(row, CASE_BITS + bits, model.kind)
            part = target >> bits
            not2, not1 = part >= hit2, part >= hit1
            case = not2.astype(np.int32) + not1
            start, width = np.where(not2, hit2, 0) << bits, np.where(not2, hit1 - hit2, hit2) << bits
            own = np.where(not2, first, second) >> 3
            other = np.flatnonzero(not1)
            base = hit1.take(other)
            rest = (1 << CASE_BITS) - base
            base <<= bits
            place = slots.take((target.take(other) - base) // rest)
            start[other], width[other] = base + rest * model.cum.take(place), rest * model.width.take(place)
            coder.take(row, unit, start, width)
            known = model.seen.take(place, mode="clip") if len(model.seen) else np.zeros(len(place), np.int32)
            own[other] = known
            if (new := other[place == len(model.seen)]).size:
                unit, raw = coder.target(new, model.raw_bits, np.int32)
                coder.take(new, unit, raw, np.ones(len(new), np.int32))
                own[new] = np.minimum(raw, alphabet - 1)
            history[t + 2, :w] = own
            told.append((key, last, second, first, cell, case, own))
        model.update(*(np.concatenate(x) for x in zip(*told, strict=True)))
    ids = np.ascontiguousarray(history[2:].T).ravel()[:n].astype("<u4")
    if zlib.crc32(ids) != ids_crc:
        raise ValueError("a block of ids does not decode to what its checksum says")
    return ids
