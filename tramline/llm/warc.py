"""WARC archives: one gzip member per record, written per task and read back sequentially.

``write_archives`` turns pages into response and revisit records; ``read_records``
reads one archive from the front: zlib inflates a chunk at a time, the record
header ends at its blank line, Content-Length frames the block, the member must
end with the record, and block and payload digests are verified.  One record is
held at a time.

Defined cases: a null html counts as empty; a null url leaves out the target
header; a null page_id is carried as null, never is the one that others refer
to unless all of its group are null (then all are responses); rows that repeat
the smallest page_id of their group with the same payload are responses too;
an empty table gives no records; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import Workspace, filesystem, load, partitions, trimmed

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
CHUNK = 1 << 20
FILE_BYTES = 256 << 20
MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


class WarcError(ValueError):
    """A record that is cut short, badly framed or fails its digest."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, not yet compressed; with refers_to a revisit that leaves the payload out."""
    digest = base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}:{digest}')}>"
    head = {
        "WARC-Type": "revisit" if refers_to is not None else "response",
        "WARC-Record-ID": name(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        "WARC-Page-ID": page_id,
    }
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": name(refers_to), "WARC-Refers-To-Page-ID": refers_to}
    head |= {"Content-Type": "application/http;msgtype=response", "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def read_records(stream, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of one archive, in order; raises WarcError."""
    raw, more = b"", True
    while True:
        if not raw:
            raw = stream.read(chunk)
            if not raw:
                return
        z, text, head, start = zlib.decompressobj(31), bytearray(), None, 0
        while not z.eof:
            try:
                text += z.decompress(raw)
            except zlib.error as e:
                raise WarcError(f"bad gzip member: {e}") from e
            raw = z.unused_data
            if head is None and (end := text.find(b"\r\n\r\n")) >= 0:
                first, *rest = text[:end].decode().split("\r\n")
                if not first.startswith("WARC/"):
                    raise WarcError("a record does not begin with its version")
                head = dict(x.split(": ", 1) for x in rest)
                start = end + 4
            if not z.eof:
                raw = stream.read(chunk)
                more = bool(raw)
                if not more:
                    raise WarcError("the archive ends inside a record")
        if head is None:
            raise WarcError("a record without a header")
        length = int(head["Content-Length"])
        if len(text) != start + length + 4 or text[-4:] != b"\r\n\r\n":
            raise WarcError("Content-Length does not frame the record")
        block = bytes(text[start : start + length])
        if head.get("WARC-Block-Digest", "").removeprefix("sha1:") != base32_sha1(block):
            raise WarcError("block digest differs")
        yield head, block


def page_of(head: dict[str, str], block: bytes) -> tuple:
    """RECORDS of one record; a response's payload is checked against its digest and length."""
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
    if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise WarcError("payload digest or length differs")
    number = lambda k: int(head[k]) if k in head else None
    return number("WARC-Page-ID"), head.get("WARC-Target-URI"), length, digest, kind, number("WARC-Refers-To-Page-ID")


def with_first_copies(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to: the smallest page_id of equal payloads, null where the page is it."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    firsts = own.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return own.join(firsts, "digest", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 6, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write archives under folder, which executors share; a row (MANIFEST) for each file.

    Payloads of at least min_bytes that are equal are stored once.  A task
    that runs again writes files under new names, so only those that its
    manifest row names count.  Act on the result once and store it.
    """

    def file_row(path: str, n: int, size: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "n_records": [n], "n_bytes": [size]})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        out, path, n, size = None, "", 0, 0
        for batch in batches:
            for page_id, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None:
                    path, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/{path}")
                member = gzip_member(record_bytes(page_id, url, html.encode(), refers), level)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield file_row(path, n, size)
        if out is not None:
            out.close()
            yield file_row(path, n, size)

    return with_first_copies(pages, min_bytes).mapInArrow(trimmed(write), MANIFEST)


def read_archives(manifest: DataFrame) -> DataFrame:
    """RECORDS of all archives named; one archive is one task's sequential read."""

    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, n in zip(batch.column("path").to_pylist(), batch.column("n_records").to_pylist(), strict=True):
                fs, name = filesystem(path)
                rows, seen = [], 0
                with fs.open_input_stream(name) as stream:
                    for head, block in read_records(stream):
                        rows.append(page_of(head, block))
                        seen += 1
                        if len(rows) >= 4096:
                            yield table(rows)
                            rows = []
                if seen != n:
                    raise WarcError(f"{path}: {seen} records, {n} were written")
                if rows:
                    yield table(rows)

    return manifest.mapInArrow(trimmed(read), RECORDS)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through archives and back: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    work = Workspace(spark, "warc")
    manifest = work.store(write_archives(load(spark, sf_dir, "pages", "page_id", "url", "html"), work.path("archives")), "manifest")
    return read_archives(manifest.repartition(partitions(spark))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
