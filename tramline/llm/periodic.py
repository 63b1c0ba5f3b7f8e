"""Periodic runs of words by the runs theorem, and texts without the repeats.

Every maximal run has a root that is the longest Lyndon word at its start,
under the order of words or under the opposite one.  With the end of a
document below every word in the one order and above it in the other, the two
orders are exact opposites: one suffix array serves both, and the longest
Lyndon words are the next smaller and the next greater values of its inverse.
A root at i of length p stretches to the right over the longest common
extension of i and i + p, a range minimum over the LCP array by a sparse
table, and to the left by bisection over such extensions.

Many documents are worked on at once in numpy: suffixes are ranked by prefix
doubling over (document, word), so no suffix is compared across documents, and
each round sorts only what is not yet told apart.  Documents in which no
stretch as long as a run minus its period stands twice hold no run and go no
further.  Nothing is shuffled; what a task holds is bounded by ``SLICE_BYTES``
of text or one document, whichever is larger.

Defined cases: a null text is empty (n = 0: no run, the digests those of the
empty text); a null doc_id is carried, its text taken as it is; a repeated row
gives a row each time; an empty table gives no rows; further columns are
ignored.  Ties between runs of equal exponent go to the smaller start, then
the smaller period.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import load, text_or_empty, trimmed

#: A run has at least so many words and so many periods.
LENGTH, EXPONENT = 24, 3
#: Bytes of text worked on at a time.
SLICE_BYTES = 1 << 20
RUNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
FOUND = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def levels_of(key: np.ndarray, upto: int | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... keys until all differ or ``upto`` keys are ranked, and the suffixes not told apart.

    A rank is the number of suffixes that are smaller; equal ranks mean equal
    beginnings.  What follows the last key counts as nothing at all: keys must
    make suffixes differ before they end.
    """
    n = len(key)
    at = np.argsort(key)
    ordered = key[at]
    rank = np.zeros(n, np.int64)
    old = np.zeros(n, np.int64)
    levels, width = [], 1
    while True:
        # groups of equal beginnings among ``at``, each within a group of equal old ranks
        new = np.ones(len(at), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        first = np.flatnonzero(new)
        sizes = np.diff(first, append=len(at))
        outer = np.ones(len(at), bool)
        outer[1:] = old[1:] != old[:-1]
        outer = np.maximum.accumulate(np.where(outer, np.arange(len(at)), 0))
        rank[at] = old + np.repeat(first, sizes) - outer
        levels.append(rank.astype(np.int32))
        at = at[np.repeat(sizes > 1, sizes)]
        if not len(at) or width == upto:
            return levels, at
        old, following = rank[at], np.minimum(at + width, n - 1)
        joined = (old << 32) | rank[following]
        order = np.argsort(joined)
        at, ordered, old = at[order], joined[order], old[order]
        width *= 2


def next_past(rank: np.ndarray, smaller: bool) -> np.ndarray:
    """For each place the next one of smaller (or greater) rank, len(rank) where there is none; all places step on over what is known to lie behind them."""
    a = np.append(rank if smaller else -rank, np.iinfo(np.int64).min)
    to = np.minimum(np.arange(1, len(a) + 1), len(rank))
    at = np.arange(len(rank))
    while len(at := at[a[to[at]] > a[at]]):
        to[at] = to[to[at]]
    return to[:-1]


class Extensions:
    """Longest common extensions of pairs of places: range minima of the LCP array by a sparse table."""

    def __init__(self, levels: list[np.ndarray]):
        self.rank = levels[-1].astype(np.int64)
        suffixes = np.empty_like(self.rank)
        suffixes[self.rank] = np.arange(len(self.rank))
        a, b = suffixes[:-1].copy(), suffixes[1:].copy()
        lcp = np.zeros(len(a), np.int32)
        for j in range(len(levels) - 1, -1, -1):
            same = levels[j][a] == levels[j][b]
            step = same.astype(np.int64) << j
            lcp += step.astype(np.int32)
            a += step
            b += step
        self.table = [lcp]
        while len(self.table[-1]) > (half := 1 << (len(self.table) - 1)):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        out = np.zeros(len(a), np.int64)
        depth = np.frexp(np.maximum(b - a, 1).astype(np.float64))[1] - 1
        for k in np.unique(depth).tolist():
            own = np.flatnonzero(depth == k)
            row = self.table[k]
            out[own] = np.minimum(row[a[own]], row[b[own] - (1 << k)])
        return out


def keys_of(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, where documents begin) of documents of word numbers from 1: each followed by its end, which is below its words; one more end stands last."""
    sizes = np.fromiter(map(len, docs), np.int64, len(docs)) + 1
    begin = np.concatenate([[0], np.cumsum(sizes)])
    words = np.zeros(begin[-1] + 1, np.int64)
    for d, b in zip(docs, begin.tolist(), strict=False):
        words[b : b + len(d)] = d
    return words + np.repeat(np.arange(len(docs) + 1), np.append(sizes, 1)) * (int(words.max(initial=0)) + 1), begin


def runs_of(docs: list[np.ndarray], length: int = LENGTH, exponent: int = EXPONENT) -> list[np.ndarray]:
    """For each document of word numbers from 1 its runs: rows of start, length, period, by start and period."""
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(docs)
    if exponent < 2:
        raise ValueError("a run has at least two periods")
    needs = [(max(length, exponent * p), p) for p in range(1, length + 1)]
    # what stands twice in a document with a run, and what a leftmost root shares with the place a period on, at least
    twice, shared = min(n - p for n, p in needs), max(1, min(n - 2 * p + 1 for n, p in needs))
    left = [i for i, d in enumerate(docs) if len(d) >= length]
    if not left:
        return out
    key, begin = keys_of([docs[i] for i in left])
    _, again = levels_of(key, 1 << (twice.bit_length() - 1))
    left = [left[i] for i in np.unique(np.searchsorted(begin, again, "right") - 1).tolist()]
    if not left:
        return out
    key, begin = keys_of([docs[i] for i in left])
    levels, _ = levels_of(key)
    extension = Extensions(levels)
    same = levels[min(shared.bit_length(), len(levels)) - 1]
    places = np.arange(len(key))
    found = []
    for smaller in (True, False):
        period = next_past(levels[-1].astype(np.int64), smaller) - places
        i = np.flatnonzero(places + period < len(key))
        i = i[same[i] == same[i + period[i]]]
        p = period[i]
        right = extension(i, i + p)
        ok = right >= np.maximum(length, exponent * p) - 2 * p + 1
        i, p, right = i[ok], p[ok], right[ok]
        room = i - begin[np.searchsorted(begin, i, "right") - 1]
        before = np.flatnonzero(room >= p)
        ok = np.ones(len(i), bool)
        ok[before] = extension(i[before] - p[before], i[before]) < p[before]  # else a root stands one period before
        i, p, right, room = i[ok], p[ok], right[ok], room[ok]
        low, high = np.zeros(len(i), np.int64), np.minimum(p - 1, room)
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_] + 1) // 2
            a = i[open_] - mid
            reach = extension(a, a + p[open_]) >= mid
            low[open_] = np.where(reach, mid, low[open_])
            high[open_] = np.where(reach, high[open_], mid - 1)
        found.append(np.stack([i - low, low + p + right, p], 1))
    rows = np.concatenate(found)
    rows = np.unique(rows[rows[:, 1] >= np.maximum(length, exponent * rows[:, 2])], axis=0)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    owner = np.searchsorted(begin, rows[:, 0], "right") - 1
    for d in np.unique(owner).tolist():
        own = rows[owner == d]
        own[:, 0] -= begin[d]
        out[left[d]] = own
    return out


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(step[:n]) == 0


def strongest(runs: np.ndarray) -> tuple[int, int, int] | tuple[None, None, None]:
    """The run of greatest exponent, compared exactly; the first of equals."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best or (None, None, None)


def as_given(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    return words


def with_stretch(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One document in ten, by the checksum of its id, with a periodic stretch from some word to its end."""
    h = 1 if doc_id is None else zlib.crc32(b"%d" % doc_id)
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _scan(batches: Iterator[pa.RecordBatch], prepare: Callable, length: int, exponent: int) -> Iterator[list[tuple]]:
    """Lists of (doc_id, words, runs), some documents at a time."""

    def flush(held: list) -> list[tuple]:
        number = defaultdict(count(1).__next__)  # any order of the words will do
        docs = [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for _, words in held]
        return [(doc_id, words, runs) for (doc_id, words), runs in zip(held, runs_of(docs, length, exponent), strict=True)]

    for batch in batches:
        held, size = [], 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            raw = text.as_py().encode("utf-8", "surrogatepass")
            held.append((doc_id, prepare(doc_id, raw.split())))  # bytes are cut at space and \x09-\x0D
            size += len(raw)
            if size >= SLICE_BYTES:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def find_runs(docs: DataFrame, prepare: Callable = as_given, length: int = LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """FOUND: the runs of each document of (doc_id, text), and its text with one period of each, words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _scan(batches, prepare, length, exponent):
            rows = [
                {"doc_id": d, "runs": [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()], "collapsed": _collapsed(words, runs).decode("utf-8", "replace")}
                for d, words, runs in part
            ]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())]))

    return _source(docs).mapInArrow(trimmed(run), FOUND)


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    if len(runs):
        words = [words[i] for i in np.flatnonzero(kept(len(words), runs)).tolist()]
    return b" ".join(words)


def run_digests(docs: DataFrame, prepare: Callable = as_given, length: int = LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """RUNS: number, strongest run and digests of each document of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in RUNS.split(", ")]
        for part in _scan(batches, prepare, length, exponent):
            rows = []
            for doc_id, words, runs in part:
                start, n, period = strongest(runs)
                lines = "".join(f"{a},{b},{p}\n" for a, b, p in runs.tolist())
                rows.append((doc_id, len(runs), start, n, period, None if n is None else 1000 * n // period, sha256(lines.encode()).hexdigest(), sha256(_collapsed(words, runs)).hexdigest()))
            columns = chain(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    return _source(docs).mapInArrow(trimmed(run), RUNS)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUNS of all whole documents, one in ten with a periodic stretch put in."""
    return run_digests(load(spark, sf_dir, "documents", "doc_id", "text"), with_stretch)
