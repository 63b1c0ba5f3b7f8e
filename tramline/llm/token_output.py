"""Token-id files: documents encoded, written in doc_id order as range-coded blocks, and read back.

A file holds pairs of a document table (zlib) and a block of ids
(``idcoder``); a document may go on in the next block of its file.  A task
holds one block of ids and one run of texts at a time.

Defined cases: a null text is empty (its ids are the end id alone); null
doc_ids come first; rows that repeat a doc_id stand side by side, in order of
their text's hash; an empty table writes no files and gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import Workspace, filesystem, load, partitions, text_or_empty, trimmed
from tramline.llm.idcoder import HEAD, CorruptBlock, decode_block, encode_block
from tramline.llm.tokens import public_path, tokenizer_at

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
BLOCK_IDS = 2_000_000
FILE_IDS = 64_000_000
MAGIC = b"TLIDS01\n"
TABLE = struct.Struct("<4sIII")  # magic, pieces, bytes of the table, its crc32
PIECE = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("last", "u1"), ("n", "<u4")])
MANIFEST = "part int, serial int, path string, n_docs long, n_ids long, n_bytes long"
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


class FileWriter:
    """Documents' ids -> (file name, documents, ids, bytes) of each file finished."""

    def __init__(self, folder: str, block_ids: int, file_ids: int):
        self.fs, self.base = filesystem(folder)
        self.fs.create_dir(self.base, recursive=True)
        self.block_ids, self.file_ids, self.out = block_ids, file_ids, None
        self.pieces: list[tuple] = []
        self.ids: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray):
        if self.out is None:
            self.name, self.docs, self.n, self.size = f"{uuid.uuid4().hex}.ids", 0, 0, len(MAGIC)
            self.out = self.fs.open_output_stream(f"{self.base}/{self.name}")
            self.out.write(MAGIC)
        self.docs += 1
        self.n += len(ids)
        while True:
            some, ids = ids[: self.block_ids - self.held], ids[self.block_ids - self.held :]
            self.pieces.append((doc_id or 0, doc_id is not None, not len(ids), len(some)))
            self.ids.append(some)
            self.held += len(some)
            if self.held >= self.block_ids:
                self._block()
            if not len(ids):
                break
        return self.close() if self.n >= self.file_ids else None

    def _block(self) -> None:
        table = np.array(self.pieces, PIECE).tobytes()
        packed = zlib.compress(table, 6)
        data = TABLE.pack(b"TLDT", len(self.pieces), len(packed), zlib.crc32(table)) + packed + encode_block(np.concatenate(self.ids))
        self.out.write(data)
        self.size += len(data)
        self.pieces, self.ids, self.held = [], [], 0

    def close(self):
        if self.out is None:
            return None
        if self.pieces:
            self._block()
        self.out.close()
        self.out = None
        return self.name, self.docs, self.n, self.size


def read_blocks(stream) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pieces, ids) of each block of one file; raises CorruptBlock."""
    if stream.read(len(MAGIC)) != MAGIC:
        raise CorruptBlock("not a file of token ids")
    while head := stream.read(TABLE.size):
        if len(head) < TABLE.size:
            raise CorruptBlock("cut short")
        magic, n, size, crc = TABLE.unpack(head)
        try:
            table = zlib.decompress(stream.read(size)) if magic == b"TLDT" else b""
        except zlib.error as e:
            raise CorruptBlock(str(e)) from e
        if zlib.crc32(table) != crc or len(table) != n * PIECE.itemsize:
            raise CorruptBlock("document table differs")
        head = stream.read(HEAD.size)
        if len(head) < HEAD.size:
            raise CorruptBlock("cut short")
        fields = HEAD.unpack(head)
        ids, _ = decode_block(head + stream.read(fields[4] + fields[5]))
        pieces = np.frombuffer(table, PIECE)
        if int(pieces["n"].sum()) != len(ids):
            raise CorruptBlock("document table and ids differ")
        yield pieces, ids


def read_documents(stream) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids with the end id) of each document of one file, in order."""
    held: list[np.ndarray] = []
    for pieces, ids in read_blocks(stream):
        at = 0
        for doc_id, known, last, n in pieces.tolist():
            held.append(ids[at : at + n])
            at += n
            if last:
                yield (doc_id if known else None), held[0] if len(held) == 1 else np.concatenate(held)
                held = []
    if held:
        raise CorruptBlock("the file ends inside a document")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode documents (doc_id, text) and write them in ascending doc_id order; MANIFEST, one row a file.

    Files in order of (part, serial) hold the documents in order.  A task that
    runs again writes under new names, so only files that the manifest names
    count; act on the result once and store it.
    """
    spark, path = docs.sparkSession, tokenizer or public_path(TOKENIZER)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, serial = tokenizer_at(path).encode, TaskContext.get().partitionId(), 0
        writer = FileWriter(folder, block_ids, file_ids)

        def done(found) -> pa.RecordBatch:
            name, n_docs, n, size = found
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([serial], pa.int32()), *map(pa.array, ([f"{folder}/{name}"], [n_docs], [n], [size]))], [c.split()[0] for c in MANIFEST.split(", ")])

        for batch in batches:
            doc_ids = iter(batch.column("doc_id").to_pylist())
            for ids, ends in encode(batch.column("text"), end_id):
                start = 0
                for end in ends.tolist():
                    if found := writer.add(next(doc_ids), ids[start:end]):
                        yield done(found)
                        serial += 1
                    start = end
        if found := writer.close():
            yield done(found)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # by doc_id alone: the pass that samples the range then reads no text
    dealt = keyed.repartitionByRange(partitions(spark), F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    return dealt.select("doc_id", "text").mapInArrow(trimmed(write), MANIFEST)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """DIGEST of every document in the files that the manifest names; the counts by file (few) go to the driver."""
    spark = manifest.sparkSession
    rows, start = [], 0
    for r in manifest.select("part", "serial", "path", "n_ids").orderBy("part", "serial").collect():
        rows.append((r.path, start))
        start += r.n_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in DIGEST.split(", ")]
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, name = filesystem(path)
                out: list[tuple] = []
                with fs.open_input_stream(name) as stream:
                    for doc_id, ids in read_documents(stream):
                        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(out) >= 8192:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    files = spark.createDataFrame(rows, "path string, base long").repartition(max(1, min(len(rows), partitions(spark))))
    return files.mapInArrow(trimmed(read), DIGEST)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through token-id files and back: doc_id, start, n_tokens, ids_crc32."""
    work = Workspace(spark, "token-output")
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    return read_token_files(work.store(write_token_files(docs, work.path("files")), "manifest"))
