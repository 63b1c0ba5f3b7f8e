"""Map extracts in the PBF format as a Spark data source, ``format("osm_pbf")``.

A file is a row of blobs, each with its length before it, most of them packed
with zlib, each a block of some thousand nodes, ways or relations of its own.
Planning reads the lengths alone; groups of blobs are the partitions, and a
task reads, unpacks and decodes only its own.  Numbers of a block are decoded
together in numpy: variable-length integers by their end bytes, differences by
running sums within each object.  Written tables are folders of such files, one
for each task, which count once the writer commits.

A row is (kind, id, tags, lon, lat, refs, members): a node has a place, a way
references, a relation members; what a kind lacks is null, tags are never null.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "kind string, id long, tags map<string,string>, lon double, lat double, refs array<long>, members array<struct<kind:string,ref:long,role:string>>"
MEMBER = pa.struct([("kind", pa.string()), ("ref", pa.int64()), ("role", pa.string())])
ARROW = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("tags", pa.map_(pa.string(), pa.string())), ("lon", pa.float64()), ("lat", pa.float64()), ("refs", pa.list_(pa.int64())), ("members", pa.list_(MEMBER))])
#: Fixed values of the format: limits of a blob, features a reader must know, kinds of members, degrees in a unit.
MAX_HEADER, MAX_BLOB = 64 << 10, 32 << 20
FEATURES = ("OsmSchema-V0.6", "DenseNodes")
KINDS = ("node", "way", "relation")
GRANULARITY, UNIT = 100, 1e-9
#: Objects in a block that is written, and bytes of packed blobs in a partition that is read.
BLOCK, PARTITION_BYTES = 8000, 16 << 20


# --- files of any file system ----------------------------------------------------


def place(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a path or URI."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files in a folder; hidden ones do not count."""
    system, inner = place(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = [i for i in system.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.File and i.base_name.endswith(".pbf") and i.base_name[0] not in "._"]
    return sorted((f"{path.rstrip('/')}/{i.base_name}", i.size) for i in found)


# --- the wire format -------------------------------------------------------------


def fields(raw: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of the fields of a message: an integer or the bytes."""
    at, end = 0, len(raw)

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        elif kind == 2:
            n = number()
            if at + n > end:
                raise ValueError("a field reaches beyond its message")
            yield tag >> 3, raw[at : at + n]
            at += n
        else:
            raise ValueError(f"wire type {kind} is not in use")


def varints(raw: bytes | memoryview) -> np.ndarray:
    """All variable-length integers of a packed field."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    last = np.flatnonzero(b < 128)
    if not len(last) or last[-1] != len(b) - 1:
        raise ValueError("a number is cut off")
    first = np.concatenate([[0], last[:-1] + 1])
    nth = np.arange(len(b)) - np.repeat(first, last - first + 1)
    return np.bitwise_or.reduceat((b & 127).astype(np.uint64) << (7 * nth).astype(np.uint64), first)


def signed(values: np.ndarray) -> np.ndarray:
    """Numbers stored with their sign in the lowest bit."""
    return (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)


def within(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places begin, begin + 1, ... of several stretches, one after the other."""
    return np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def sums_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each of several runs of values."""
    total, ends = np.concatenate([[0], np.cumsum(values)]), np.cumsum(counts)
    return total[ends] - total[ends - counts]


def many(b: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, how many of each) of several packed fields, decoded at once."""
    own = b[within(begin, sizes)]
    last = sizes > 0
    if (b[(begin + sizes)[last] - 1] >= 128).any():
        raise ValueError("a number is cut off")
    return varints(own), sums_of((own < 128).astype(np.int64), sizes)


def number_at(b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, places behind them) of the variable-length integers at several places."""
    value, n, going, shift = np.zeros(len(at), np.uint64), at.copy(), np.arange(len(at)), 0
    while len(going):
        if shift > 63 or n[going].max() >= len(b):
            raise ValueError("a number is cut off")
        byte = b[n[going]]
        value[going] |= (byte & 127).astype(np.uint64) << np.uint64(shift)
        n[going] += 1
        going, shift = going[byte >= 128], shift + 7
    return value, n


def fields_of(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(value, begin, size) by number of the fields of many messages, field after field of all at once; of a repeated field the last, zeros where it is missing."""
    found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    at, going = start.copy(), np.flatnonzero(start < end)
    while len(going):
        tag, n = number_at(b, at[going])
        number, kind = (tag >> np.uint64(3)).astype(np.int64), (tag & np.uint64(7)).astype(np.int64)
        if not np.isin(kind, (0, 1, 2, 5)).all():
            raise ValueError(f"wire type {kind[~np.isin(kind, (0, 1, 2, 5))][0]} is not in use")
        value, begin, fixed = np.zeros(len(n), np.uint64), n.copy(), (kind == 1) | (kind == 5)
        value[~fixed], begin[~fixed] = number_at(b, n[~fixed])
        if (value[kind == 2] > len(b)).any():
            raise ValueError("a field reaches beyond its message")
        size = np.where(kind == 2, value.astype(np.int64), np.where(kind == 1, 8, np.where(kind == 5, 4, 0)))
        after = begin + size
        if (after > end[going]).any():
            raise ValueError("a field reaches beyond its message")
        for k in np.unique(number[~fixed]):
            own = (number == k) & ~fixed
            for out, new in zip(found.setdefault(int(k), (np.zeros(len(start), np.uint64), np.zeros(len(start), np.int64), np.zeros(len(start), np.int64))), (value, begin, size), strict=True):
                out[going[own]] = new[own]
        at[going] = after
        going = going[after < end[going]]
    return found


def sums_within(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running sums that begin anew with each of the runs."""
    total = np.concatenate([[0], np.cumsum(values)])
    begin = np.cumsum(sizes) - sizes
    return total[1:] - np.repeat(total[begin], sizes)


def offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())


# --- reading ---------------------------------------------------------------------


def blob_header(raw: bytes) -> tuple[str, int]:
    """(type, size of the blob) of the message before a blob."""
    found = dict(fields(memoryview(raw)))
    return bytes(found[1]).decode(), int(found[3])


def unpack(raw: bytes) -> memoryview:
    """What a blob holds."""
    found = dict(fields(memoryview(raw)))
    if 1 in found:
        return found[1]
    if 3 in found:
        inflate = zlib.decompressobj()
        out = inflate.decompress(found[3], MAX_BLOB + 1)
        if len(out) > MAX_BLOB or not inflate.eof or found.get(2, len(out)) != len(out):
            raise ValueError("a blob is damaged or too large")
        return memoryview(out)
    raise ValueError("a blob is packed by a method other than zlib")


def scan(path: str, size: int) -> list[tuple[str, int, int]]:
    """(type, offset, size) of a file's blobs; their contents are skipped."""
    system, inner = place(path)
    out, at = [], 0
    with system.open_input_file(inner) as f:
        while at < size:
            f.seek(at)
            n = int.from_bytes(f.read(4), "big")
            if not 0 < n <= MAX_HEADER:
                raise ValueError(f"{path} is no PBF file at {at}")
            kind, length = blob_header(f.read(n))
            at += 4 + n
            if length > MAX_BLOB or at + length > size:
                raise ValueError(f"{path} is cut off or damaged at {at}")
            out.append((kind, at, length))
            at += length
        for kind, offset, length in out[:1]:
            if kind != "OSMHeader":
                raise ValueError(f"{path} begins without a header")
            f.seek(offset)
            needs = {bytes(v).decode() for k, v in fields(unpack(f.read(length))) if k == 4}
            if unknown := needs - set(FEATURES):
                raise ValueError(f"{path} needs {', '.join(sorted(unknown))}")
    return out


class Block:
    """Strings and scale of a block, and the tables of its groups."""

    def __init__(self, raw: memoryview):
        self.strings, self.groups = pa.array([], pa.string()), []
        self.granularity, self.lat0, self.lon0 = GRANULARITY, 0, 0
        for k, v in fields(raw):
            if k == 1:
                self.strings = pa.array([bytes(s).decode("utf-8", "replace") for n, s in fields(v) if n == 1], pa.string())
            elif k == 2:
                self.groups.append(v)
            elif k == 17:
                self.granularity = v
            elif k in (19, 20):
                v = v - (1 << 64) if v >> 63 else v
                self.lat0, self.lon0 = (v, self.lon0) if k == 19 else (self.lat0, v)

    def tables(self, kinds: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
        for group in self.groups:
            nodes, ways, relations = [], [], []
            for k, v in fields(group):
                if k == 1 and "node" in kinds:
                    nodes.append(v)
                elif k == 2 and "node" in kinds:
                    yield self.dense(v)
                elif k == 3 and "way" in kinds:
                    ways.append(v)
                elif k == 4 and "relation" in kinds:
                    relations.append(v)
            for kind, messages, made in (("node", nodes, self.nodes), ("way", ways, self.ways), ("relation", relations, self.relations)):
                if messages:
                    yield made(kind, messages)

    def degrees(self, values: np.ndarray, first: int) -> pa.Array:
        return pa.array((first + self.granularity * values) * UNIT)

    def tags(self, keys: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> pa.Array:
        take = lambda i: self.strings.take(pa.array(i.astype(np.int64)))
        return pa.MapArray.from_arrays(offsets(sizes), take(keys), take(values))

    def row(self, kind: str, ids: np.ndarray, tags: pa.Array, **more: pa.Array) -> pa.RecordBatch:
        given = {"kind": pa.array([kind] * len(ids), pa.string()), "id": pa.array(ids), "tags": tags} | more
        return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(len(ids), f.type)) for f in ARROW], schema=ARROW)

    def dense(self, raw: memoryview) -> pa.RecordBatch:
        found = {k: v for k, v in fields(raw)}
        number = lambda k: np.cumsum(signed(varints(found.get(k, b""))))
        ids, kv = number(1), varints(found.get(10, b""))
        ends = np.flatnonzero(kv == 0)  # a zero ends the tags of a node
        sizes = np.diff(ends, prepend=-1) - 1 if len(kv) else np.zeros(len(ids), np.int64)
        kv = kv[kv != 0]
        if len(sizes) != len(ids) or (sizes % 2).any():
            raise ValueError("tags of dense nodes do not add up")
        return self.row("node", ids, self.tags(kv[0::2], kv[1::2], sizes // 2), lon=self.degrees(number(9), self.lon0), lat=self.degrees(number(8), self.lat0))

    def read(self, messages: list[memoryview], numbers: list[int], packed: list[int]) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
        """Single and packed fields of many messages."""
        b = np.frombuffer(b"".join(messages), np.uint8)
        sizes = np.fromiter(map(len, messages), np.int64, len(messages))
        end = np.cumsum(sizes)
        found, none = fields_of(b, end - sizes, end), np.zeros(len(sizes), np.int64)
        get = lambda k: found.get(k, (none.astype(np.uint64), none, none))
        return [get(k)[0] for k in numbers], [many(b, *get(k)[1:]) for k in packed]

    def nodes(self, kind: str, messages: list[memoryview]) -> pa.RecordBatch:
        (ids, lat, lon), ((keys, sizes), (values, _)) = self.read(messages, [1, 8, 9], [2, 3])
        return self.row(kind, signed(ids), self.tags(keys, values, sizes), lon=self.degrees(signed(lon), self.lon0), lat=self.degrees(signed(lat), self.lat0))

    def ways(self, kind: str, messages: list[memoryview]) -> pa.RecordBatch:
        (ids,), ((keys, sizes), (values, _), (refs, lengths)) = self.read(messages, [1], [2, 3, 8])
        refs = pa.ListArray.from_arrays(offsets(lengths), pa.array(sums_within(signed(refs), lengths)))
        return self.row(kind, ids.astype(np.int64), self.tags(keys, values, sizes), refs=refs)

    def relations(self, kind: str, messages: list[memoryview]) -> pa.RecordBatch:
        (ids,), ((keys, sizes), (values, _), (roles, _), (refs, lengths), (kinds, _)) = self.read(messages, [1], [2, 3, 8, 9, 10])
        member = pa.StructArray.from_arrays([pa.array(KINDS).take(pa.array(kinds.astype(np.int64))), pa.array(sums_within(signed(refs), lengths)), self.strings.take(pa.array(roles.astype(np.int64)))], fields=list(MEMBER))
        return self.row(kind, ids.astype(np.int64), self.tags(keys, values, sizes), members=pa.ListArray.from_arrays(offsets(lengths), member))


@dataclass
class Blobs(InputPartition):
    path: str
    blobs: list[tuple[int, int]]


class PbfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.kinds = tuple(options.get("kinds", ",".join(KINDS)).split(","))
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        if unknown := set(self.kinds) - set(KINDS):
            raise ValueError(f"no objects of kind {', '.join(sorted(unknown))}")

    def partitions(self) -> list[Blobs]:
        out = []
        for path, size in files_of(self.path):
            held = self.bytes
            for kind, offset, length in scan(path, size):
                if kind != "OSMData":
                    continue
                if held >= self.bytes:
                    out.append(Blobs(path, []))
                    held = 0
                out[-1].blobs.append((offset, length))
                held += length
        return out or [Blobs("", [])]

    def read(self, partition: Blobs) -> Iterator[pa.RecordBatch]:
        if not partition.blobs:
            return
        system, inner = place(partition.path)
        with system.open_input_file(inner) as f:
            for offset, length in partition.blobs:
                f.seek(offset)
                yield from Block(unpack(f.read(length))).tables(self.kinds)


# --- writing ---------------------------------------------------------------------


Bytes = tuple[np.ndarray, np.ndarray]  # those of several pieces one after the other, and how many each has


def encoded(values: np.ndarray) -> Bytes:
    """Variable-length integers, the lowest seven bits first."""
    v = values.astype(np.uint64)
    sizes = np.ones(len(v), np.int64)
    for n in range(1, 10):
        sizes += v >= np.uint64(1 << (7 * n))
    nth = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    b = ((np.repeat(v, sizes) >> (7 * nth).astype(np.uint64)) & np.uint64(127)).astype(np.uint8)
    return b | ((nth < np.repeat(sizes, sizes) - 1).astype(np.uint8) << 7), sizes


def packed_varints(values: np.ndarray) -> bytes:
    return encoded(values)[0].tobytes()


def packed_each(values: np.ndarray, counts: np.ndarray) -> Bytes:
    """Packed fields of so many of the values each."""
    b, sizes = encoded(values)
    return b, sums_of(sizes, counts)


def joined(*parts: Bytes) -> Bytes:
    """The pieces of all parts, the first of each part, then the second, and so on."""
    total = np.sum([sizes for _, sizes in parts], axis=0)
    out, at = np.empty(int(total.sum()), np.uint8), np.cumsum(total) - total
    for b, sizes in parts:
        out[within(at, sizes)] = b
        at = at + sizes
    return out, total


def field_each(number: int, body: Bytes) -> Bytes:
    """A field of each piece; numbers below 16."""
    n = len(body[1])
    return joined((np.full(n, number << 3 | 2, np.uint8), np.ones(n, np.int64)), encoded(body[1]), body)


def number_each(number: int, values: np.ndarray) -> Bytes:
    return joined((np.full(len(values), number << 3, np.uint8), np.ones(len(values), np.int64)), encoded(values))


def zigzag(values: np.ndarray) -> np.ndarray:
    return ((values << 1) ^ (values >> 63)).astype(np.uint64)


def differences(values: np.ndarray) -> bytes:
    return packed_varints(zigzag(np.diff(values.astype(np.int64), prepend=0)))


def differences_within(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each value less the one before it; the first of each run as it is."""
    out, first = np.diff(values, prepend=0), (np.cumsum(counts) - counts)[counts > 0]
    out[first] = values[first]
    return zigzag(out)


def field(number: int, value: int | bytes) -> bytes:
    one = lambda n: packed_varints(np.array([n & (1 << 64) - 1], np.uint64))
    if isinstance(value, bytes):
        return one(number << 3 | 2) + one(len(value)) + value
    return one(number << 3) + one(value)


def blob(kind: str, content: bytes) -> bytes:
    body = field(2, len(content)) + field(3, zlib.compress(content))
    head = field(1, kind.encode()) + field(3, len(body))
    return len(head).to_bytes(4, "big") + head + body


def block(rows: pa.Table) -> bytes:
    """A block of some objects; nodes lie dense."""
    rows = rows.combine_chunks()
    own = {kind: rows.filter(pc.equal(rows["kind"], kind)).combine_chunks() for kind in KINDS}
    column = lambda kind, c: own[kind][c].combine_chunks() if own[kind].num_rows else pa.array([], rows.schema.field(c).type)
    tags = {kind: column(kind, "tags") for kind in KINDS}
    members = column("relation", "members")
    each = members.flatten()
    texts = [x for kind in KINDS for x in (tags[kind].keys, tags[kind].items)] + [each.field("role")]
    coded = pa.concat_arrays([x.cast(pa.string()).fill_null("") for x in texts]).dictionary_encode()
    at = np.split(coded.indices.to_numpy().astype(np.uint64) + np.uint64(1), np.cumsum([len(x) for x in texts])[:-1])  # zero ends a node's tags, so even the empty string has another number
    tagged = {kind: (at[2 * i], at[2 * i + 1], np.diff(tags[kind].offsets.to_numpy()).astype(np.int64)) for i, kind in enumerate(KINDS)}
    counts = lambda x: pc.list_value_length(x).fill_null(0).to_numpy().astype(np.int64)
    ids = {kind: column(kind, "id").to_numpy() for kind in KINDS}
    groups = []
    if own["node"].num_rows:
        keys, values, n = tagged["node"]
        kv = np.zeros(int((2 * n + 1).sum()), np.uint64)
        place = within(np.cumsum(2 * n + 1) - (2 * n + 1), 2 * n)
        kv[place[0::2]], kv[place[1::2]] = keys, values
        unit = lambda c: np.rint(column("node", c).to_numpy() / (UNIT * GRANULARITY)).astype(np.int64)
        groups.append(field(2, field(1, differences(ids["node"])) + field(8, differences(unit("lat"))) + field(9, differences(unit("lon"))) + field(10, packed_varints(kv))))
    if own["way"].num_rows:
        keys, values, n = tagged["way"]
        refs = column("way", "refs")
        m, ref = counts(refs), whole(refs.flatten())
        message = joined(number_each(1, ids["way"]), field_each(2, packed_each(keys, n)), field_each(3, packed_each(values, n)), field_each(8, packed_each(differences_within(ref, m), m)))
        groups.append(field_each(3, message)[0].tobytes())
    if own["relation"].num_rows:
        keys, values, n = tagged["relation"]
        m, ref, kinds = counts(members), whole(each.field("ref")), whole(pc.index_in(each.field("kind"), pa.array(KINDS)))
        message = joined(number_each(1, ids["relation"]), field_each(2, packed_each(keys, n)), field_each(3, packed_each(values, n)), field_each(8, packed_each(at[-1], m)), field_each(9, packed_each(differences_within(ref, m), m)), field_each(10, packed_each(kinds, m)))
        groups.append(field_each(4, message)[0].tobytes())
    distinct = [b"", *(x.encode() for x in coded.dictionary.to_pylist())]
    strings = field_each(1, (np.frombuffer(b"".join(distinct), np.uint8), np.fromiter(map(len, distinct), np.int64, len(distinct))))[0].tobytes()
    return field(1, strings) + b"".join(field(2, g) for g in groups)


def whole(numbers: pa.Array) -> np.ndarray:
    if numbers.null_count:
        raise ValueError("a reference needs a kind and an id")
    return numbers.to_numpy().astype(np.int64)


def checked(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch, if every object can be written."""
    is_node = pc.equal(batch["kind"], "node")
    nowhere = pc.and_(is_node, pc.or_(pc.is_null(batch["lon"]), pc.is_null(batch["lat"])))
    if pc.any(pc.or_(pc.or_(pc.invert(pc.is_in(batch["kind"], pa.array(KINDS))), pc.is_null(batch["id"])), nowhere.fill_null(True))).as_py():
        raise ValueError("an object needs a kind and an id, a node a place")
    return batch


@dataclass
class Written(WriterCommitMessage):
    name: str


class PbfWriter(DataSourceArrowWriter):
    """One file a task, under a hidden name until the whole table is there."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        if not overwrite and place(self.path)[0].get_file_info(place(self.path)[1]).type != fs.FileType.NotFound and files_of(self.path):
            raise FileExistsError(self.path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, inner = place(self.path)
        system.create_dir(inner, recursive=True)
        name = f".{uuid.uuid4().hex}.osm.pbf"
        held: list[pa.RecordBatch] = []
        with system.open_output_stream(f"{inner}/{name}") as f:
            f.write(blob("OSMHeader", b"".join(field(4, x.encode()) for x in FEATURES)))
            for batch in batches:
                checked(batch)
                while batch.num_rows:
                    room = BLOCK - sum(x.num_rows for x in held)
                    held.append(batch.slice(0, room))
                    batch = batch.slice(room)
                    if sum(x.num_rows for x in held) >= BLOCK:
                        f.write(blob("OSMData", block(pa.Table.from_batches(held))))
                        held = []
            if held:
                f.write(blob("OSMData", block(pa.Table.from_batches(held))))
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = place(self.path)
        system.create_dir(inner, recursive=True)
        old = files_of(self.path) if self.overwrite else []
        for m in messages:
            if m:
                system.move(f"{inner}/{m.name}", f"{inner}/part-{m.name[1:]}")
        for path, _ in old:
            system.delete_file(place(path)[1])

    def abort(self, messages: list[Written | None]) -> None:
        system, inner = place(self.path)
        for m in messages:
            if m:
                system.delete_file(f"{inner}/{m.name}")


class PbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PbfReader:
        return PbfReader(self.options)

    def writer(self, schema, overwrite: bool) -> PbfWriter:
        return PbfWriter(self.options, overwrite)


def read_pbf(spark: SparkSession, path: str, *kinds: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """SCHEMA: the objects of a PBF file or a folder of them; of the kinds named, else of all."""
    spark.dataSource.register(PbfSource)
    return spark.read.format("osm_pbf").option("kinds", ",".join(kinds or KINDS)).option("partitionBytes", str(partition_bytes)).load(path)


def write_pbf(objects: DataFrame, path: str, mode: str = "append") -> None:
    """Objects (SCHEMA) as a folder of PBF files."""
    objects.sparkSession.dataSource.register(PbfSource)
    names = [c.split(" ", 1)[0] for c in SCHEMA.split(", ")]
    objects.select(*names).write.format("osm_pbf").mode(mode).save(path)
