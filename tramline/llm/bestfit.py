"""Packing whole documents into few sequences by the sum of squares.

Of the open sequences, counted by the room they have left, each document goes
where the squares of these counts then sum to the least: the counts stay even,
so there is a sequence with the right room for what comes later.  Documents of
a pool are placed longest first, and a sequence is opened only for a document
that fits no open one; then the last documents, which are short, fill the
room.  On 20,000 documents of the test tables that takes as many sequences as
their ids need at least; in the order of arrival, opening sequences freely,
0.9 % more.

Only documents longer than a sequence are cut, into full sequences and a rest.
Pools are filled within a task, so nothing is shuffled; a pool keeps numbers
and checksums, not ids, and costs less than one sequence more than it must.

Defined cases: a null text is empty, its one id the end id; a null doc_id is
carried; repeated rows are packed each; an empty table gives no rows; further
columns are ignored.  Among places of equal sums the least room is taken.
"""

from __future__ import annotations

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
END_ID = 0
CAPACITY = 2048
#: Pieces placed together.
POOL = 65536
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Sequences:
    """Open sequences by the room they have left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)  # by room; full ones are not counted
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n = 0

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset there) of a piece of that length."""
        if not 0 < length <= self.capacity:
            raise ValueError("a piece is longer than a sequence, or empty")
        before, after = self.count[length:], self.count[: self.capacity + 1 - length]
        # one sequence fewer of the room before, one more of the room after: what the sum of squares gains
        gain = 2 * (after - before) + 2
        gain[0] = 1 - 2 * before[0]
        left = int(np.where(before > 0, gain, np.iinfo(np.int64).max).argmin())
        room = left + length
        if self.count[room]:
            sequence = self.open[room].pop()
            self.count[room] -= 1
        else:
            room, left = self.capacity, self.capacity - length
            sequence = self.n
            self.n += 1
        if left:
            self.count[left] += 1
            self.open[left].append(sequence)
        return sequence, self.capacity - room


def sum_of_squares(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int]], int]:
    """((sequence, offset) of each piece, number of sequences)."""
    sequences = Sequences(capacity)
    out: list = [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        out[i] = sequences.place(lengths[i])
    return out, sequences.n


def pack_whole(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, pool: int = POOL) -> DataFrame:
    """PLACED, a row for each piece of documents (doc_id, text)."""
    path = tokenizer or public_path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer_at(path).encode
        fields = [(n, {"int": pa.int32(), "long": pa.int64()}[kind]) for n, kind in (c.split() for c in PLACED.split(", "))]
        serial, waiting, out = TaskContext.get().partitionId() << 32, [], []

        def deal() -> None:
            nonlocal serial, waiting
            placed, n = sum_of_squares([length for _, _, _, length, _ in waiting], capacity)
            out.extend((*piece, serial + sequence, offset) for piece, (sequence, offset) in zip(waiting, placed, strict=True))
            serial, waiting = serial + n, []

        def tables() -> Iterator[pa.RecordBatch]:
            nonlocal out
            for a in range(0, len(out), 1 << 14):
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*out[a : a + (1 << 14)], strict=True), fields, strict=True)], [n for n, _ in fields])
            out = []

        for batch in batches:
            doc_ids = iter(batch.column("doc_id").to_pylist())
            for ids, ends in encode(batch.column("text"), end_id):
                raw, begin = ids.astype("<u4", copy=False), 0
                for end in ends.tolist():
                    doc_id = next(doc_ids)
                    for piece, start in enumerate(range(begin, end, capacity)):
                        part = raw[start : min(end, start + capacity)]
                        row = (doc_id, piece, start - begin, len(part), zlib.crc32(part.tobytes()))
                        if len(part) == capacity:
                            out.append((*row, serial, 0))
                            serial += 1
                        else:
                            waiting.append(row)
                    begin = end
                    if len(waiting) >= pool:
                        deal()
            yield from tables()
        deal()
        yield from tables()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(trimmed(run), PLACED)


def op12_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed whole: PLACED, a row for each piece."""
    return pack_whole(load(spark, sf_dir, "documents", "doc_id", "text"))
