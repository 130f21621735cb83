"""Range coder for token ids, driven by a mixture of order-0, order-1 and order-2 predictions.

Ids are cut into blocks, each with its own model, so a block can be read without any other. A block lists its
distinct ids once; from then on an id is its number in that list. Three predictors give a distribution over
these numbers: order 0 the frequencies so far (brought up to date every REFRESH ids), order 1 the id that
followed the last one lately, order 2 the id that followed the last two. Their mixture is what the range coder
uses; the weights are learned within the block, for each pair of confidences of orders 1 and 2.

Many blocks are coded at once, one array element each, so that the work for an id is a few array operations.
All arithmetic is on integers, hence reader and writer agree on every machine.

Layout of a coded block, little-endian: three 32-bit numbers (ids, bytes of the list, bytes of the code), CRC-32
of all that follows, the list as gaps in 7-bit groups, the code as 32-bit words, CRC-32 of the ids as 32-bit numbers.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids in a block, and blocks that are coded at once.
BLOCK, LANES = 4096, 2048
#: Ids in a block at most, as sums over all blocks coded at once stay below 2^31.
MOST = 1 << 14
#: Places between two updates of order 0, once it has settled; what one occurrence adds to a count that starts with 1.
REFRESH, GAIN = 256, 24
#: Weights add up to 2^16 while learned and to 2^8 while coding; every second id moves them by 2^-RATE.
RATE = 5
#: What a right prediction adds to its weight: 62/64 of a full step, so that order 0 always keeps a share.
_STEP = (1 << 16 - RATE) * 62 // 64
_HEAD = struct.Struct("<IIII")
_SLOTS = 1 << 12
_ONE, _TWO = np.int32(2_531), np.int32(40_503)
#: Change of a slot by confidence << 1 | hit; below 3 it is filled anew.
_MOVE = np.array([0, 0, 0, 1, -1, 1, -1, 0], np.int32)
_U, _LOW32 = np.uint64, np.uint64(0xFFFFFFFF)
_32 = _U(32)


class CorruptBlock(ValueError):
    """A block whose checksum or length doesn't fit."""


class _Mixture:
    """Models of several blocks side by side; `sizes` are the lengths of their lists of ids.

    Blocks are ordered by falling number of ids, so those still running at a place are the first few. A slot of
    orders 1 and 2 holds id << 2 | confidence; with confidence 0 it is empty and its weight stays 0.
    """

    def __init__(self, sizes: np.ndarray) -> None:
        lanes = len(sizes)
        self.sizes = sizes.astype(np.int64)
        self.base = np.cumsum(self.sizes) - self.sizes
        self.top = 1 << max(int(sizes.max()) - 1, 1).bit_length() - 1  # first step of a search in a list
        self.counts = np.ones(int(sizes.sum()), np.int32)
        # beyond the last list nothing is found
        self.cum = np.full(len(self.counts) + 1 + 2 * self.top, np.iinfo(np.int32).max, np.int32)
        # slots of order 1 (one for each number) and behind them those of order 2; row 0 stands for order 1
        self.slots = np.zeros(len(self.counts) + lanes * _SLOTS, np.int32)
        w2 = np.repeat(np.array([0, 20_000, 34_000, 46_000]), 4)
        w1 = np.tile(np.array([0, 14_000, 26_000, 36_000]), 4) * (65_536 - w2) // 65_536
        self.weights = np.tile(np.array([w1, w2], np.int32), lanes)
        self.lane_two, self.lane_w = len(self.counts) + np.arange(lanes) * _SLOTS, np.arange(lanes) * 16
        self.last, self.before = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
        self.refresh()

    def refresh(self) -> None:
        n = len(self.counts)
        self.cum[0] = 0
        np.cumsum(self.counts, out=self.cum[1 : n + 1])
        self.start = self.cum[self.base]
        self.total = self.cum[self.base + self.sizes] - self.start

    def predict(self, t: int, m: int) -> None:
        """The mixture at place t for the first m blocks."""
        if t and (t % REFRESH == 0 or (t < REFRESH and t & (t - 1) == 0)):
            self.refresh()
        self.t, self.m, self.b = t, m, self.base[:m]
        last = self.last[:m]
        self.at = np.empty((2, m), np.int64)
        np.add(self.b, last, out=self.at[0])
        np.add(self.lane_two[:m], (self.before[:m] * _TWO + last * _ONE) & (_SLOTS - 1), out=self.at[1])
        self.slot = self.slots.take(self.at, mode="clip")
        self.s, self.c = self.slot >> 2, self.slot & 3
        self.at_w = self.lane_w[:m] + (self.c[1] << 2 | self.c[0])
        self.w = self.weights.take(self.at_w, axis=1, mode="clip")
        share = self.w >> 8
        self.a0 = 256 - share[0] - share[1]
        self.mass = self.total[:m] * share
        # where both orders say the same, order 1 has the mass of both
        same = self.s[0] == self.s[1]
        self.mass[0] += self.mass[1] * same
        self.mass[1] *= ~same

    def interval(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(below, width) of the numbers x, out of 256 * total."""
        self.x, self.at_x = x, self.b + x
        low = self.cum.take(self.at_x, mode="clip")
        self.hit = self.s == x
        before, own = self.mass * (self.s < x), self.mass * self.hit
        below = self.a0 * (low - self.start[: self.m]) + before[0] + before[1]
        return below, self.a0 * (self.cum.take(self.at_x + 1, mode="clip") - low) + own[0] + own[1]

    def find(self, v: np.ndarray) -> np.ndarray:
        """The numbers whose interval holds v."""
        start, s, mass = self.start[: self.m], self.s, self.mass
        # what orders 1 and 2 add lies at the start of a number's interval; without it, order 0 is left
        first = (self.cum.take(self.b + s, mode="clip") - start) * self.a0
        first += mass[::-1] * (s[::-1] < s)
        cut = np.minimum(np.maximum(v - first, 0), mass)
        u = (v - cut[0] - cut[1]) // self.a0 + start
        at, step = self.b.copy(), self.top
        while step:
            at += (self.cum.take(at + step, mode="clip") <= u) * step
            step >>= 1
        return (at - self.b).astype(np.int32)

    def learn(self) -> None:
        """Takes in the numbers last given to `interval`."""
        m, x = self.m, self.x
        self.counts[self.at_x] += GAIN
        state = self.c << 1 | self.hit
        kept = state > 2
        if self.t & 1:
            right = kept & self.hit
            right[0] &= ~right[1]
            self.weights[:, self.at_w] = self.w - (self.w >> RATE) + right * _STEP
        self.slots[self.at] = np.where(kept, self.slot + _MOVE.take(state, mode="clip"), x << 2 | 1)
        self.before[:m] = self.last[:m]
        self.last[:m] = x


def _settle(low: np.ndarray, span: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low ends and spans below 2^32, cut to the larger side of a multiple of 2^32 if they straddle one."""
    a, s = low[at], span[at]
    edge = ((a >> _32) + _U(1)) << _32
    left = edge - a  # edge may wrap to 0: then nothing lies beyond it
    over = s > left
    right = np.where(over, s - left, _U(0))
    up = over & (right > left)
    return np.where(up, edge, a), np.where(up, right, np.where(over, left, s))


def _varints(lists: list[np.ndarray]) -> list[bytes]:
    """The gaps of each rising list in groups of 7 bits, low ones first; the high bit says that more follow."""
    sizes = np.array([len(x) for x in lists])
    ids = np.concatenate(lists)
    gaps = np.diff(ids, prepend=0)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    gaps[starts] = ids[starts]
    out, keep = np.zeros((len(gaps), 5), np.uint8), np.ones((len(gaps), 5), bool)
    for k in range(5):
        if k:
            keep[:, k] = gaps > 0
        out[:, k] = gaps & 127
        gaps >>= 7
    out[:, :-1] |= keep[:, 1:].view(np.uint8) << 7
    ends = np.concatenate([[0], np.cumsum(keep.sum(1))])[np.cumsum(sizes)].tolist()
    data = out[keep].tobytes()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _from_varints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    if not len(raw):
        return raw
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127) << (7 * place), starts)


def _steps(lengths: np.ndarray) -> np.ndarray:
    """For each place, how many of the blocks (longest first) are still running."""
    return len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of ids (whole numbers from 0 to 2^32 - 1) as bytes."""
    if any(len(b) > MOST for b in blocks):
        raise ValueError(f"a block has at most {MOST} ids")
    done: list[bytes] = []
    for k in range(0, len(blocks), LANES):
        done += _encode(blocks[k : k + LANES])
    return done


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lengths = np.array([len(blocks[i]) for i in order])
    lists, grid = [], np.zeros((len(order), lengths[0]), np.int32)
    most = max((int(b.max()) for b in blocks if len(b)), default=0)
    seen, number = (np.zeros(most + 1, bool), np.zeros(most + 1, np.int32)) if most < 1 << 22 else (None, None)
    for lane, i in enumerate(order):
        ids = blocks[i]
        if seen is None:
            own, grid[lane, : len(ids)] = np.unique(ids, return_inverse=True)
        else:
            seen[ids] = True
            own = np.flatnonzero(seen)
            number[own] = np.arange(len(own))
            grid[lane, : len(ids)] = number[ids]
            seen[own] = False
        lists.append(own.astype(np.int64))
    lanes, grid = len(order), np.ascontiguousarray(grid.T)
    mixture = _Mixture(np.array([max(len(x), 1) for x in lists]))
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    out, n_out = np.zeros((lanes, int(lengths[0]) + 4), np.uint32), np.zeros(lanes, np.int64)
    for t, m in enumerate(_steps(lengths).tolist()):
        mixture.predict(t, m)
        below, width = mixture.interval(grid[t, :m])
        unit = span[:m] // (mixture.total[:m] << 8).astype(np.uint64)
        low[:m] += unit * below.astype(np.uint64)
        span[:m] = unit * width.astype(np.uint64)
        at = np.flatnonzero(span[:m] <= _LOW32)
        if at.size:
            a, s = _settle(low, span, at)
            out[at, n_out[at]] = a >> _32
            n_out[at] += 1
            low[at], span[at] = a << _32, s << _32
        mixture.learn()
    done, tables = [b""] * lanes, _varints(lists)
    for lane, i in enumerate(order):
        # one word more settles the rest: the first multiple of 2^32 in the interval, or its low end's high word
        a, s = int(low[lane]), int(span[lane])
        tail = (a + 0xFFFFFFFF) >> 32
        words = [*out[lane, : n_out[lane]].tolist(), *([tail] if tail << 32 < a + s and tail < 1 << 32 else [a >> 32, a & 0xFFFFFFFF])]
        code = np.array(words, "<u4").tobytes() if lengths[lane] else b""
        table = tables[lane]
        body = table + code + struct.pack("<I", zlib.crc32(blocks[i].astype("<u4").tobytes()))
        done[i] = _HEAD.pack(len(blocks[i]), len(table), len(code), zlib.crc32(body)) + body
    return done


def block_size(head: bytes) -> int:
    """Bytes that follow the first 16 of a coded block."""
    _, table, code, _ = _HEAD.unpack(head)
    return table + code + 4


HEAD_BYTES = _HEAD.size


def decode_blocks(coded: list[bytes]) -> list[np.ndarray]:
    """The ids of each block, as 32-bit numbers. Raises CorruptBlock where a checksum doesn't fit."""
    done: list[np.ndarray] = []
    for k in range(0, len(coded), LANES):
        done += _decode(coded[k : k + LANES])
    return done


def _decode(coded: list[bytes]) -> list[np.ndarray]:
    parts = []
    for data in coded:
        if len(data) < HEAD_BYTES:
            raise CorruptBlock("a block ends within its head")
        n, table, code, check = _HEAD.unpack_from(data)
        body = data[HEAD_BYTES:]
        if len(body) != table + code + 4 or code % 4 or zlib.crc32(body) != check:
            raise CorruptBlock("the checksum of a block doesn't fit")
        own = np.cumsum(_from_varints(body[:table]))
        parts.append((n, own, np.frombuffer(body, "<u4", code // 4, table), struct.unpack_from("<I", body, table + code)[0]))
    order = sorted(range(len(parts)), key=lambda i: -parts[i][0])
    lengths = np.array([parts[i][0] for i in order])
    lanes = len(order)
    words = np.zeros((lanes, max(len(p[2]) for p in parts) + 3), np.uint64)
    for lane, i in enumerate(order):
        words[lane, : len(parts[i][2])] = parts[i][2]
    mixture = _Mixture(np.array([max(len(parts[i][1]), 1) for i in order]))
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    code = (words[:, 0] << _32) | words[:, 1]
    taken = np.full(lanes, 2, np.int64)
    grid = np.zeros((lengths[0], lanes), np.int32)
    for t, m in enumerate(_steps(lengths).tolist()):
        mixture.predict(t, m)
        whole = mixture.total[:m] << 8
        unit = span[:m] // whole.astype(np.uint64)
        v = np.minimum(((code[:m] - low[:m]) // unit).astype(np.int64), whole - 1).astype(np.int32)
        x = mixture.find(v)
        grid[t, :m] = x
        below, width = mixture.interval(x)
        low[:m] += unit * below.astype(np.uint64)
        span[:m] = unit * width.astype(np.uint64)
        at = np.flatnonzero(span[:m] <= _LOW32)
        if at.size:
            a, s = _settle(low, span, at)
            low[at], span[at] = a << _32, s << _32
            code[at] = (code[at] << _32) | words[at, np.minimum(taken[at], words.shape[1] - 1)]
            taken[at] += 1
        mixture.learn()
    grid = np.ascontiguousarray(grid.T)
    done: list[np.ndarray] = [np.zeros(0, np.uint32)] * lanes
    for lane, i in enumerate(order):
        n, own, _, check = parts[i]
        ids = own[grid[lane, :n]].astype("<u4") if n else np.zeros(0, "<u4")
        if zlib.crc32(ids.tobytes()) != check:
            raise CorruptBlock("the ids of a block don't fit their checksum")
        done[i] = ids
    return done
