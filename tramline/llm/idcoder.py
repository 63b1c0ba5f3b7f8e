"""Adaptive context-mixing range coder for token ids, vectorised over lanes.

A block holds up to a few million ids.  It is cut into lanes of equal length
that advance in step, one id of each lane at a time, and share one model that
starts empty in every block:

* order 2: a hashed table of the id that last followed a pair, with a confidence;
* order 1: the same for single ids;
* order 0: counts of the ids that neither predicts, refreshed at fixed steps.

The mixture weights of the three (predicted by order 2, by order 1, neither)
are learned per pair of confidences as the block goes on.  Weight times
order-0 share makes one interval of 32 bits for a 64-bit range coder per lane,
which puts out 16-bit words; carries are added to words already out and
carried on at the end.  A block decodes alone and checks a CRC-32 of its ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TLB1"
HEAD = struct.Struct("<4sIIIIII")  # magic, ids, lanes, symbols, lane table bytes, word bytes, crc32 of ids
BITS2 = 18
TOTAL0 = 1 << 20
WEIGHTS = 1 << 12
REFRESH = 64
#: Lanes from which halves take turns in teaching the model.
HALVES = 64
U = np.uint64


class CorruptBlock(ValueError):
    """A block that is cut short or whose ids fail their checksum."""


def lanes_for(n: int) -> int:
    """Wide blocks run faster, up to where the arrays of a step leave the cache; each lane costs a few bytes."""
    return max(1, min(4096, n // 256))


class _Model:
    """Tables that encoder and decoder change alike, one id of each lane at a time."""

    def __init__(self, symbols: int):
        self.symbols = symbols
        self.t1 = np.zeros(symbols, np.uint32)
        self.t2 = np.zeros(1 << BITS2, np.uint32)
        self.seen = np.full((128, 3), (2, 1, 4), np.float64)
        self.fresh_weights = np.zeros(512, np.int64)
        self.counts0 = np.zeros(symbols, np.int64)
        self.pending: list[np.ndarray] = []
        self.step = 0
        self._weights()
        self._order0()

    def _weights(self) -> None:
        self.seen += self.fresh_weights.reshape(128, 4)[:, :3]
        self.fresh_weights[:] = 0
        self.seen *= np.where(self.seen.sum(1, keepdims=True) > 50_000, 0.5, 1.0)
        f = np.floor(self.seen / self.seen.sum(1, keepdims=True) * (WEIGHTS - 3)).astype(np.int64) + 1
        f[:, 2] += WEIGHTS - f.sum(1)
        f = np.pad(f, ((0, 0), (0, 1)))  # four cells a row, the last one empty
        self.weight = f.ravel().astype(U)
        self.weight_start = (np.cumsum(f, 1) - f).ravel().astype(U)

    def _order0(self) -> None:
        if self.pending:
            self.counts0 += np.bincount(np.concatenate(self.pending), minlength=self.symbols)
            self.pending = []
        total = max(1, int(self.counts0.sum()))
        f = 1 + self.counts0 * (TOTAL0 - self.symbols) // total
        f[int(f.argmax())] += TOTAL0 - int(f.sum())
        self.freq0, self.start0 = f.astype(U), (np.cumsum(f) - f).astype(U)
        self.by_slot = None

    def slots(self) -> np.ndarray:
        """Symbol of each of the TOTAL0 slots, for decoding."""
        if self.by_slot is None:
            self.by_slot = np.repeat(np.arange(self.symbols, dtype=np.uint32), self.freq0.astype(np.int64))
        return self.by_slot

    def look(self, before1: np.ndarray, hashed: np.ndarray):
        """Predictions of order 2 and 1 and the row of the weights."""
        e2, e1 = self.t2[hashed], self.t1[before1]
        p2, p1 = e2 >> 3, e1 >> 3
        row = ((e2 & 7) << 6) | ((e1 & 7) << 3) | ((p2 == p1).view(np.uint8) << np.uint32(2))
        return e2, e1, p2, p1, row.astype(np.int64)

    def learn(self, ids, before1, hashed, e2, e1, hit2, hit1, cell, missed) -> None:
        """Tables and weights learn from one half of the lanes at a step and from the other at the next, order 1 at every other step, order 0 from all."""
        if len(ids) >= HALVES:
            half = slice(0, len(ids) // 2) if self.step & 1 else slice(len(ids) // 2, len(ids))
            ids, before1, hashed, e2, e1, hit2, hit1, cell = (v[half] for v in (ids, before1, hashed, e2, e1, hit2, hit1, cell))
        fresh = (ids << np.uint32(3)) | np.uint32(1)
        tables = [(self.t2, hashed, e2, hit2), (self.t1, before1, e1, hit1)]
        for table, at, e, hit in tables if self.step & 2 else tables[:1]:
            kept = e & np.uint32(7)
            after = np.where(kept > 1, e - (kept + np.uint32(1) >> np.uint32(1)), fresh)
            hit = np.flatnonzero(hit)
            good = e[hit]
            after[hit] = good + (good & np.uint32(7) < 7)
            table[at] = after
        self.fresh_weights += np.bincount(cell, minlength=512)
        self.pending.append(missed)
        self.step += 1
        s = self.step
        if s % 8 == 0 or s < 8:
            self._weights()
        if s % REFRESH == 0 or s < REFRESH and s & (s - 1) == 0:
            self._order0()


def _hashed(before2: np.ndarray, before1: np.ndarray) -> np.ndarray:
    h = before2 * np.uint32(0x9E3779B1) + before1 * np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0xC2B2AE3D) >> np.uint32(32 - BITS2)).astype(np.int64)


def encode_block(ids: np.ndarray) -> bytes:
    """A block of ids (unsigned, below 2**19); may be empty."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    n = len(ids)
    if not n:
        return HEAD.pack(MAGIC, 0, 0, 0, 0, 0, 0)
    lanes, symbols = lanes_for(n), int(ids.max()) + 1
    if symbols > TOTAL0 // 2:
        raise ValueError("ids must be below 2**19")
    steps = -(-n // lanes)
    grid = np.zeros((lanes, steps), np.uint32)
    grid.ravel()[:n] = ids
    grid = np.ascontiguousarray(grid.T)
    zero = np.zeros((1, lanes), np.uint32)
    b1 = np.concatenate([zero, grid[:-1]])
    b2 = np.concatenate([zero, b1[:-1]])
    low, span = np.zeros(lanes, U), np.full(lanes, ~U(0), U)
    cap = 2 * steps + 4
    words, at = np.zeros(lanes * cap, np.uint32), np.arange(lanes, dtype=np.int64) * cap
    first, model = at.copy(), _Model(symbols)
    for s in range(steps):
        x, before1 = grid[s], b1[s]
        hashed = _hashed(b2[s], before1)
        e2, e1, p2, p1, row = model.look(before1, hashed)
        hit2, hit1 = p2 == x, p1 == x
        cell = row + np.where(hit2, 0, np.where(hit1, 1, 2))
        w = model.weight[cell]
        start, size = model.weight_start[cell] << U(20), w << U(20)
        miss = np.flatnonzero(~(hit2 | hit1))
        missed = x[miss]
        start[miss] += w[miss] * model.start0[missed]
        size[miss] = w[miss] * model.freq0[missed]
        unit = span >> U(32)
        add = unit * start
        low += add
        over = np.flatnonzero(low < add)
        words[at[over] - 1] += 1
        span = unit * size
        out = np.flatnonzero(span < U(1 << 48))
        while out.size:
            v = low[out]
            words[at[out]] = v >> U(48)
            at[out] += 1
            low[out] = v << U(16)
            span[out] <<= U(16)
            out = out[span[out] < U(1 << 48)]
        model.learn(x, before1, hashed, e2, e1, hit2, hit1, cell, missed)
    end = low + U((1 << 48) - 1)
    words[at[np.flatnonzero(end < low)] - 1] += 1
    words[at] = end >> U(48)
    at += 1
    over = np.flatnonzero(words > 0xFFFF)
    while over.size:
        words[over] -= 1 << 16
        np.add.at(words, over - 1, 1)
        over = np.unique(over - 1)
        over = over[words[over] > 0xFFFF]
    lengths = at - first
    table = zlib.compress(lengths.astype("<u4").tobytes(), 1)
    keep = np.arange(cap) < lengths[:, None]
    body = words.reshape(lanes, cap)[keep].astype("<u2").tobytes()
    return HEAD.pack(MAGIC, n, lanes, symbols, len(table), len(body), zlib.crc32(ids.tobytes())) + table + body


def decode_block(data: bytes, offset: int = 0) -> tuple[np.ndarray, int]:
    """The ids of the block at offset, and where the next one begins; raises CorruptBlock."""
    if len(data) < offset + HEAD.size:
        raise CorruptBlock("cut short")
    magic, n, lanes, symbols, n_table, n_body, crc = HEAD.unpack_from(data, offset)
    offset += HEAD.size
    if magic != MAGIC or len(data) < offset + n_table + n_body:
        raise CorruptBlock("not a block, or cut short")
    if not n:
        return np.zeros(0, "<u4"), offset
    try:
        lengths = np.frombuffer(zlib.decompress(data[offset : offset + n_table]), "<u4").astype(np.int64)
    except zlib.error as e:
        raise CorruptBlock(str(e)) from e
    offset += n_table
    if len(lengths) != lanes or int(lengths.sum()) * 2 != n_body:
        raise CorruptBlock("lane table differs")
    cap = int(lengths.max()) + 8
    words = np.zeros((lanes, cap), np.uint16)
    words[np.arange(cap) < lengths[:, None]] = np.frombuffer(data, "<u2", n_body // 2, offset)
    words = words.ravel()
    steps = -(-n // lanes)
    at = np.arange(lanes, dtype=np.int64) * cap
    last = at + cap - 1
    code = np.zeros(lanes, U)
    for _ in range(4):
        code = (code << U(16)) | words[at]
        at += 1
    span, model = np.full(lanes, ~U(0), U), _Model(symbols)
    grid = np.zeros((steps, lanes), np.uint32)
    before1 = before2 = np.zeros(lanes, np.uint32)
    for s in range(steps):
        hashed = _hashed(before2, before1)
        e2, e1, p2, p1, row = model.look(before1, hashed)
        unit = span >> U(32)
        q = np.minimum(code // unit, U((1 << 32) - 1))
        t = q >> U(20)
        k = (t >= model.weight_start[row + 1]).astype(np.int64) + (t >= model.weight_start[row + 2])
        x = np.where(k == 0, p2, p1)
        cell = row + k
        w = model.weight[cell]
        start, size = model.weight_start[cell] << U(20), w << U(20)
        miss = np.flatnonzero(k == 2)
        slot = (q[miss] - start[miss]) // w[miss]
        missed = model.slots()[np.minimum(slot, U(TOTAL0 - 1)).astype(np.int64)]
        x[miss] = missed
        start[miss] += w[miss] * model.start0[missed]
        size[miss] = w[miss] * model.freq0[missed]
        code -= unit * start
        span = unit * size
        out = np.flatnonzero(span < U(1 << 48))
        while out.size:
            code[out] = (code[out] << U(16)) | words[at[out]]
            at[out] = np.minimum(at[out] + 1, last[out])
            span[out] <<= U(16)
            out = out[(span[out] < U(1 << 48)) & (span[out] > 0)]
        if x.max() >= symbols:
            raise CorruptBlock("id out of range")
        span = np.maximum(span, U(1 << 32))
        grid[s] = x
        model.learn(x, before1, hashed, e2, e1, p2 == x, p1 == x, cell, missed)
        before2, before1 = before1, grid[s]
    ids = np.ascontiguousarray(grid.T).ravel()[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise CorruptBlock("checksum differs")
    return ids, offset + n_body
