"""Packing documents into windows of at most 2048 ids by multiway differencing.

A document's ids (with the end id) are cut into full windows and a rest of
less than one window, and the rest into pieces of at most ``PIECE`` ids.
Pools of such pieces are dealt to as few windows as hold them by the
Karmarkar-Karp differencing method: partial partitions, each a tuple of
window sums, are merged two at a time, largest spread first, the largest sums
of one onto the smallest of the other.  When a window exceeds the capacity the
number of windows rises and the pool is dealt anew; where that would leave
more than ``PADDING`` empty, the largest pieces of the windows that exceed are
halved instead, as documents may be cut freely.  Pools are filled within a
task, so nothing is shuffled and one pool of pieces is held.

Defined cases: a null text is empty, its one id the end id; a null doc_id is
carried; repeated rows are packed each; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import load, text_or_empty, trimmed
from tramline.llm.tokens import public_path, tokenizer_at

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
WINDOW = 2048
PIECE = 512
POOL = 1024
#: Bytes of text encoded at a time: what a worker holds beside its tokenizer is some thirty times that.
SLICE_BYTES = 2 << 20
#: Share of the windows that may stay empty for the sake of fewer cuts.
PADDING = 0.03
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(lengths: list[int], k: int) -> list[list[int]]:
    """Deal items to k windows with nearly equal sums: the items of each window.

    A state keeps its k window sums in ascending order, and for each window
    the tree of its items.  States come from a heap, largest spread first.
    """
    trees: list = list(range(len(lengths)))  # an item, or a pair of trees
    heap = []
    for i, n in enumerate(lengths):
        sums, nodes = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[-1], nodes[-1] = n, i
        heap.append((-n, i, sums, nodes))
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, sums, nodes = heapq.heappop(heap)
        _, _, more, others = heapq.heappop(heap)
        others = others[::-1]
        joined = np.where(nodes < 0, others, nodes)
        for j in np.flatnonzero((nodes >= 0) & (others >= 0)).tolist():
            trees.append((int(nodes[j]), int(others[j])))
            joined[j] = len(trees) - 1
        sums = sums + more[::-1]
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (int(sums[0] - sums[-1]), serial, sums, joined[order]))
        serial += 1

    def items(node: int) -> list[int]:
        out, stack = [], [node] if node >= 0 else []
        while stack:
            t = trees[stack.pop()]
            if isinstance(t, tuple):
                stack += t
            else:
                out.append(t)
        return sorted(out)

    return [items(int(n)) for n in heap[0][3]] if heap else []


def pack(lengths: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Windows of at most capacity, as few as differencing finds; no item may exceed it."""
    if max(lengths, default=0) > capacity:
        raise ValueError("an item exceeds the capacity")
    k = max(1, -(-sum(lengths) // capacity))
    while True:
        found = difference(lengths, k)
        if max((sum(lengths[i] for i in w) for w in found), default=0) <= capacity:
            return [w for w in found if w]
        k += 1


def pack_cut(lengths: list[int], capacity: int = WINDOW, padding: float = PADDING) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start, length): few, or filled but for the padding; items are cut where whole ones would leave more empty."""
    pieces = [(i, 0, n) for i, n in enumerate(lengths)]
    total = sum(lengths)
    k = max(1, -(-total // capacity))
    most = max(k, int(total / ((1 - padding) * capacity)))
    while True:
        found = [[pieces[i] for i in w] for w in difference([n for _, _, n in pieces], k)]
        over = [sum(n for _, _, n in w) > capacity for w in found]
        if not any(over):
            return [w for w in found if w]
        if k < most:
            k += 1
            continue
        pieces = []
        for w, exceeds in zip(found, over, strict=True):
            largest = max(w, key=lambda x: (x[2], x), default=None)
            for i, start, n in w:
                if exceeds and (i, start, n) == largest and n > 1:
                    pieces += [(i, start, n // 2), (i, start + n // 2, n - n // 2)]
                else:
                    pieces.append((i, start, n))


def cuts(n: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: full windows, then the rest in even pieces."""
    out = [(a, capacity) for a in range(0, n - n % capacity, capacity)]
    if rest := n % capacity:
        parts = -(-rest // piece)
        ends = [n - rest + rest * j // parts for j in range(parts + 1)]
        out += [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = WINDOW, piece: int = PIECE, pool: int = POOL) -> DataFrame:
    """PACKED, a row for each piece of documents (doc_id, text)."""
    path = tokenizer or public_path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, names = tokenizer_at(path).encode, [c.split()[0] for c in PACKED.split(", ")]
        serial, rests, out = TaskContext.get().partitionId() << 32, [], []

        def deal() -> None:
            nonlocal serial, rests
            for window in pack_cut([len(raw) // 4 for _, _, _, raw in rests], capacity):
                offset = 0
                for i, a, n in window:
                    doc_id, total, start, raw = rests[i]
                    out.append((doc_id, start + a, n, zlib.crc32(raw[4 * a : 4 * (a + n)]), total, serial, offset))
                    offset += n
                serial += 1
            rests = []

        def table() -> pa.RecordBatch:
            nonlocal out
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)
            out = []
            return batch

        for batch in batches:
            doc_ids = iter(batch.column("doc_id").to_pylist())
            for ids, ends in encode(batch.column("text"), end_id, SLICE_BYTES):
                ids, begin = ids.astype("<u4", copy=False), 0
                for end in ends.tolist():
                    doc_id, n = next(doc_ids), end - begin
                    for start, length in cuts(n, capacity, piece):
                        raw = ids[begin + start : begin + start + length].tobytes()
                        if length == capacity:
                            out.append((doc_id, start, length, zlib.crc32(raw), n, serial, 0))
                            serial += 1
                        else:
                            rests.append((doc_id, n, start, raw))
                    begin = end
                    if len(rests) >= pool:
                        deal()
                if out:
                    yield table()
        if rests:
            deal()
        if out:
            yield table()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(trimmed(run), PACKED)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed: PACKED, a row for each piece."""
    return pack_documents(load(spark, sf_dir, "documents", "doc_id", "text"))
