"""Adaptive context-mixing range coder for token ids, vectorised over lanes.

A block is cut into lanes of consecutive ids, and step j codes the j-th id of every lane at once.  All lanes share one
model, which is updated after each step, so decoder and encoder see the same model.  The model mixes three predictions:

- order 0: frequencies of all ids so far, refreshed at growing intervals;
- order 1 and order 2: for the last id, and for a hash of the last two, the id that followed, with a confidence 0 to 3.

The point predictions add mass to their ids on top of the order-0 frequencies.  How much is learnt: for each pair of
confidences the coder tallies how often the order-2 id, the order-1 id or neither came.  The resulting interval drives a
range coder with 64-bit state and 32-bit output words for each lane.  A lane ends with the one word that tells its last interval
apart, and lanes differ little in length, so a lane costs five bytes beside its ids.

A block is independent of all others: its header holds the number of ids, the number of lanes and the checksums of ids and
payload; the model starts anew.  Lanes have the same length whatever the size of a block, so the model learns at one pace.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

# magic, version, bytes of a lane's word count, lanes, ids, vocabulary, least word count, crc of ids, crc of payload
HEADER = struct.Struct("<4sHHIIIIII")
MAGIC, VERSION = b"TRC3", 1
LANE_IDS, HASH_BITS, GAIN, REFRESH, GUIDE_BITS = 384, 18, 24, 8, 15
_LOW = np.uint64(1 << 32)
_WORD = np.uint64(32)


# What an id's confidence becomes, by 4 * (it came) + confidence; at confidence 0 an id that did not come is replaced.
_STEP = np.array([0, -1, -1, -1, 1, 1, 1, 0], np.int32)


class _Model:
    def __init__(self, vocabulary: int) -> None:
        self.vocabulary = vocabulary
        self.weight = np.ones(vocabulary, np.int64)
        self.cumulative = np.arange(vocabulary + 1, dtype=np.int64)
        self.after1, self.after2 = np.zeros(vocabulary, np.int32), np.zeros(1 << HASH_BITS, np.int32)  # id * 4 + confidence
        self.tally = np.tile(np.array([1, 1, 4], np.int64), (32, 1))
        self.waiting: list[np.ndarray] = []
        self.steps = 0
        self.guide: np.ndarray | None = None
        self._mass()

    def _mass(self) -> None:
        """Mass of the order-1 and order-2 ids in each of the 32 contexts, given the total of order 0."""
        all0 = int(self.cumulative[-1])
        miss = np.maximum(self.tally[:, 2], self.tally.sum(axis=1) // 64 + 1)
        self.mass2 = all0 * self.tally[:, 0] // miss
        self.mass1 = all0 * self.tally[:, 1] // miss
        self.mass1[1::2] = 0  # the two ids agree
        self.totals = (all0 + self.mass1 + self.mass2).astype(np.uint64)

    def look(self, last: np.ndarray, before: np.ndarray) -> None:
        self.last = last
        mixed = last.astype(np.uint32) * np.uint32(0x9E3779B1) + before.astype(np.uint32) * np.uint32(0x85EBCA6B)
        self.slot = (mixed >> np.uint32(32 - HASH_BITS)).astype(np.int64)
        self.own1, self.own2 = self.after1.take(last), self.after2.take(self.slot)
        self.p1, self.p2 = (self.own1 >> 2).astype(np.int64), (self.own2 >> 2).astype(np.int64)
        self.q1, self.q2 = self.own1 & 3, self.own2 & 3
        self.context = ((self.q2 << 3) + (self.q1 << 1) + (self.p1 == self.p2)).astype(np.int64)
        self.m1, self.m2, self.total = self.mass1.take(self.context), self.mass2.take(self.context), self.totals.take(self.context)

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.hit1, self.hit2 = self.p1 == ids, self.p2 == ids
        start, size = self.cumulative.take(ids), self.weight.take(ids)
        start += self.m1 * (self.p1 < ids)
        start += self.m2 * (self.p2 < ids)
        size += self.m1 * self.hit1
        size += self.m2 * self.hit2
        return start.view(np.uint64), size.view(np.uint64)

    def find(self, value: np.ndarray) -> np.ndarray:
        """The id whose interval holds the value."""
        value = value.view(np.int64)
        p1, p2, m1, m2 = self.p1, self.p2, self.m1, self.m2
        begin1, begin2 = self.cumulative.take(p1), self.cumulative.take(p2)
        begin1 += m2 * (p2 < p1)
        begin2 += m1 * (p1 < p2)
        past1, past2 = value >= begin1 + self.weight.take(p1) + m1 + m2 * (p1 == p2), value >= begin2 + self.weight.take(p2) + m2
        in1, in2 = (value >= begin1) & ~past1, (value >= begin2) & ~past2
        out = np.where(in1, p1, p2)
        rest = np.flatnonzero(~(in1 | in2))
        out[rest] = self._order0((value - m1 * past1 - m2 * past2).take(rest))
        return out

    def _order0(self, value: np.ndarray) -> np.ndarray:
        """The id whose order-0 interval holds the value; a guide from the high bits of values decides most of them."""
        if self.guide is None:
            self.shift = max(0, int(self.cumulative[-1]).bit_length() - GUIDE_BITS)
            over = (1 << self.shift) - 1
            slots = (int(self.cumulative[-1]) >> self.shift) + 2
            self.guide = np.cumsum(np.bincount((self.cumulative[1:] + over) >> self.shift, minlength=slots))  # ids that end at or below a slot's begin
        slot = value >> self.shift
        out, upto = self.guide.take(slot), self.guide.take(slot + 1)
        unsure = np.flatnonzero(out != upto)
        out[unsure] = np.searchsorted(self.cumulative, value.take(unsure), "right") - 1
        return out

    def learn(self, ids: np.ndarray) -> None:
        outcome = np.where(self.hit2, 0, 2 - self.hit1.view(np.int8))
        self.tally += np.bincount(self.context * 3 + outcome, minlength=96).reshape(32, 3)
        if self.steps % 4 == 0:
            large = self.tally.sum(axis=1) > 1 << 16
            self.tally[large] = self.tally[large] // 2 + 1
        fresh = ids.astype(np.int32) << 2
        for known, at, hit, own, q in ((self.after1, self.last, self.hit1, self.own1, self.q1), (self.after2, self.slot, self.hit2, self.own2, self.q2)):
            case = (hit.view(np.int8) << 2) + q
            known[at] = np.where(case == 0, fresh, own + _STEP.take(case))
        self.waiting.append(ids)
        self.steps += 1
        if self.steps % REFRESH == 0 or self.steps in (1, 2, 4, 8):
            self.weight += GAIN * np.bincount(np.concatenate(self.waiting), minlength=self.vocabulary)
            self.waiting.clear()
            np.cumsum(self.weight, out=self.cumulative[1:])
            self.guide = None
        self._mass()


def _shape(n: int) -> tuple[int, int]:
    """Lanes and steps of a block of n ids."""
    lanes = max(1, -(-n // LANE_IDS))
    return lanes, -(-n // lanes)


def encode(ids: np.ndarray, vocabulary: int) -> bytes:
    """One block.  Ids lie in 0 to vocabulary - 1."""
    ids = np.ascontiguousarray(ids, np.int64)
    n = len(ids)
    if n and (int(ids.min()) < 0 or int(ids.max()) >= vocabulary):
        raise ValueError("an id is outside the vocabulary")
    lanes, steps = _shape(n)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    words, used = np.zeros((lanes, steps + 2), np.uint32), np.zeros(lanes, np.int64)
    last = before = np.zeros(lanes, np.int64)
    model = _Model(vocabulary)
    short = n - (lanes - 1) * steps  # ids in the last lane
    for j in range(steps):
        live = lanes if j < short else lanes - 1
        now = grid[j, :live]
        model.look(last[:live], before[:live])
        start, size = model.interval(now)
        unit = span[:live] // model.total
        moved = low[:live] + unit * start
        carry = np.flatnonzero(moved < low[:live])
        if len(carry):
            _carry(words, used, carry)
        low[:live] = moved
        span[:live] = unit * size
        out = np.flatnonzero(span[:live] < _LOW)
        words[out, used[out]] = low[out] >> _WORD
        used[out] += 1
        low[out] <<= _WORD
        span[out] <<= _WORD
        model.learn(now)
        before = last[:live]
        last = now
    final = low + (_LOW - np.uint64(1))  # the multiple of a word's range in the interval, whose lower word is 0
    _carry(words, used, np.flatnonzero(final < low))
    words[np.arange(lanes), used] = final >> _WORD
    used += 1
    least = int(used.min())
    width = 1 if int(used.max()) - least < 1 << 8 else 4
    payload = (used - least).astype(f"<u{width}").tobytes() + words[np.arange(steps + 2)[None, :] < used[:, None]].astype("<u4").tobytes()
    return HEADER.pack(MAGIC, VERSION, width, lanes, n, vocabulary, least, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(payload)) + payload


def _carry(words: np.ndarray, used: np.ndarray, lanes: np.ndarray) -> None:
    at = used[lanes] - 1
    while len(lanes):
        words[lanes, at] += np.uint32(1)
        over = words[lanes, at] == 0
        lanes, at = lanes[over], at[over] - 1


def decode(block: bytes) -> np.ndarray:
    """The ids of one block, uint32.  Raises ValueError where a checksum does not hold."""
    magic, version, width, lanes, n, vocabulary, least, crc_ids, crc_payload = HEADER.unpack_from(block)
    payload = memoryview(block)[HEADER.size :]
    if magic != MAGIC or version != VERSION or zlib.crc32(payload) != crc_payload:
        raise ValueError("damaged block")
    steps = -(-n // lanes)
    used = np.frombuffer(payload[: width * lanes], f"<u{width}").astype(np.int64) + least
    flat = np.concatenate([np.frombuffer(payload[width * lanes :], "<u4"), np.zeros(2, np.uint32)]).astype(np.uint64)
    ends = np.cumsum(used)
    at = ends - used
    code = (flat[at] << _WORD) | flat[at + 1] * (used > 1)  # behind a lane's words there are zeros
    at = at + 2
    span = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    grid = np.zeros((steps, lanes), np.int64)
    last = before = np.zeros(lanes, np.int64)
    model = _Model(vocabulary)
    short = n - (lanes - 1) * steps
    for j in range(steps):
        live = lanes if j < short else lanes - 1
        model.look(last[:live], before[:live])
        unit = span[:live] // model.total
        now = model.find(np.minimum(code[:live] // unit, model.total - np.uint64(1)))
        start, size = model.interval(now)
        code[:live] -= unit * start
        span[:live] = unit * size
        more = np.flatnonzero(span[:live] < _LOW)
        read = at[more]
        code[more] = (code[more] << _WORD) | flat[np.minimum(read, ends[more] - 1)] * (read < ends[more])
        at[more] += 1
        span[more] <<= _WORD
        grid[j, :live] = now
        model.learn(now)
        before = last[:live]
        last = now
    ids = grid.T.reshape(-1)[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc_ids:
        raise ValueError("decoded ids differ from those encoded")
    return ids
