"""N-gram Jaccard join with PartEnum signatures.

A document's set holds the hashes of its distinct 5-word shingles.  Two sets
link when 100 * |intersection| >= 75 * |union|.

Signatures.  Sizes fall into bands whose bounds grow by 4/3, so linked sets
lie in one band or in neighbouring ones; instance j of the scheme serves bands
j-1 and j.  An instance divides the domain of shingles into n1 parts, and a
signature is the hash of one part's content (the enumeration with first-level
subsets of one part each).  Linked sets of sizes a and b differ in at most
k = (a + b) / 7 shingles, and a differing shingle spoils one part; a set that
occupies more than k parts hence shares a signature with every partner.  A set
that occupies fewer also emits its empty parts, which only such sets do.

Buckets.  Up to ``SMALL`` sets with one signature are all paired.  In larger
buckets each set is paired with the first.  Linked sets share as many
signatures of an instance as the set occupies parts beyond k (its spare), so a
pair is compared only if the small buckets that it shares, and as many large
ones as it can share at most, come to that.  A set with more occupied parts
outside large buckets than k shares one of those with every partner and needs
no large bucket.  The sets that remain are mostly true copies of each other:
after the pairs above are verified, sets with a common neighbour share a label,
and only links between different labels that meet in a large bucket are left.

Large buckets.  For equal-size sets of more than a few shingles no affordable
enumeration of subsets of partitions tells a similarity of 0.7 from one of
0.75, so the remaining sets are joined on rare shingles instead.  Linked sets
of sizes p >= q share at least 3 (p + q) / 7 shingles; with the shingles in
one order, rarest first, the first p - 0.75 p + 1 of the larger and the first
q - 6 q / 7 + 1 of the smaller hence have one in common.  A shingle that no
other remaining set holds takes a place there but joins nothing, so a near
copy that misses the threshold mostly emits nothing at all.  Sizes are part of
the key in steps of 1/20, which shortens the prefix of the larger set for each
step, and a set meets only those sets of a key that have other labels.
That is done twice: first with one pivot of each key, which ties most copies to
their component, then with all that is left.  No link between different
components is missed, and no bucket is cut off.

Sets with equal content are one class from the start, and classes are the
nodes of the components.  Signatures travel in packed columns (five bytes and
an eight-byte class each), by hash label; a task holds one label at a time.

Defined cases: a null or wordless text has an empty set and links with
nothing; fewer than five words make one shingle of the whole; a null doc_id
takes no part and has a null component; rows that repeat a doc_id are judged
each by its own text; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import Workspace, load, partitions, text_or_empty, trim, trimmed
from tramline.llm.components import connected_components

WORDS = 5
NUMERATOR, DENOMINATOR = 75, 100
SMALL = 8
#: Ids sent to all executors at most (8 bytes each); beyond it a shuffled join takes over.
BROADCAST_IDS = 1_000_000
FLUSH = 500_000
#: Texts or pairs that a worker takes out of an Arrow batch at a time.
SLICE = 768
U = np.uint64
#: Band i holds the sizes from BOUNDS[i] up to below BOUNDS[i + 1].
BOUNDS = [1]
while BOUNDS[-1] < 1 << 40:
    BOUNDS.append(4 * BOUNDS[-1] // 3 + 1)
BOUNDS_ARRAY = np.array(BOUNDS, np.int64)
#: Step of the sizes that are part of a key in large buckets.
SIZE_STEP = 1.05


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _apart(ends: np.ndarray) -> np.ndarray:
    """How many entries each run has, from where the runs end."""
    return np.diff(ends, prepend=0)


def shingle_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): sorted distinct hashes of each whole text's shingles, one text after the other; A-Z in lower case, words split at ASCII white space."""
    texts = pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), ""))
    cut = pc.ascii_split_whitespace(texts)
    codes = cut.flatten().dictionary_encode()
    words = codes.dictionary.cast(pa.binary()).to_pylist()
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))
    code = codes.indices.to_numpy()
    upto = cut.offsets.to_numpy().astype(np.int64)
    upto = upto - upto[0]
    if b"" in words:  # white space at an end leaves an empty word
        full = code != words.index(b"")
        upto = np.concatenate([[0], np.cumsum(full)])[upto]
        code = code[full]
    h, sizes = table[code], np.diff(upto)
    # every place begins a shingle but the last ones of a text of five words or more
    left = np.repeat(upto[1:], sizes) - np.arange(len(h))
    width = np.minimum(sizes, WORDS)
    start = np.flatnonzero(left >= np.repeat(width, sizes))
    each = np.repeat(width, sizes)[start]
    out = each.astype(U)
    for j in range(WORDS):
        reaches = slice(None) if j == 0 else np.flatnonzero(each > j)
        out[reaches] = mix(out[reaches] + h[start[reaches] + j] * U(0x9E3779B97F4A7C15))
    ends = np.cumsum(np.where(sizes > 0, sizes - width + 1, 0))
    sets = [np.unique(out[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    return np.concatenate([np.zeros(0, U), *sets]), np.cumsum(np.fromiter(map(len, sets), np.int64, len(sets)))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a whole text's shingles."""
    return shingle_runs(pa.array([text], pa.string()))[0]


def class_of(found: np.ndarray) -> int:
    """A set's identity, as a signed 64-bit number."""
    return int(xxhash.xxh3_64_intdigest(found.tobytes())) - (1 << 63)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) * DENOMINATOR < NUMERATOR * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    inter = int((both[1:] == both[:-1]).sum())
    return inter * DENOMINATOR >= NUMERATOR * (len(a) + len(b) - inter)


def band(size: int) -> int:
    return int(np.searchsorted(BOUNDS, size, "right")) - 1


def instances(hashes: np.ndarray, ends: np.ndarray, up: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of many sets in the instance of their band (up 0) or of the next (up 1).

    Hash and number of each occupied part, where each set's parts end, how many
    parts there are, and the spare of each set: parts occupied beyond k.
    """
    size = _apart(ends)
    j = np.searchsorted(BOUNDS_ARRAY, size, "right") - 1 + up
    most = BOUNDS_ARRAY[j + 1] - 1
    parts = 33 * most // 100 + 2
    k = (3 * size + np.minimum(4 * size, 3 * most)) // 21
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
    z = mix(hashes ^ (U(0xA0761D6478BD642F) + j.astype(U))[owner])
    part = ((z >> U(32)) * parts.astype(U)[owner]) >> U(32)
    key = owner.astype(U) << U(40) | part
    order = np.argsort(key)
    key, z = key[order], mix(z[order])
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    content, part = (np.add.reduceat(z, first) if len(first) else z), key[first] & U((1 << 40) - 1)
    upto = np.searchsorted(key[first] >> U(40), np.arange(len(size)).astype(U), "right")
    return content, part, upto, parts, _apart(upto) - k


def signatures(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, number of the set) of many sets in their two instances; the last bit says whether the instance is odd."""
    sigs, owners = [], []
    size = _apart(ends)
    j = np.searchsorted(BOUNDS_ARRAY, size, "right") - 1
    for up in (0, 1):
        content, part, upto, parts, spare = instances(hashes, ends, up)
        owner = np.repeat(np.arange(len(size)), _apart(upto))
        for i in np.flatnonzero((spare <= 0) & (size > 0)).tolist():  # such a set also emits its empty parts
            empty = np.setdiff1d(np.arange(parts[i], dtype=U), part[upto[i - 1] if i else 0 : upto[i]])
            part, content, owner = np.concatenate([part, empty]), np.concatenate([content, np.zeros(len(empty), U)]), np.concatenate([owner, np.full(len(empty), i)])
        at = (j + up).astype(U)[owner]
        sig = mix(content ^ mix(part + (at << U(32))))
        sigs.append((sig & ~U(1)) | at & U(1))
        owners.append(owner)
    return np.concatenate(sigs), np.concatenate(owners)


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *more)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE):
            yield batch.slice(a, SLICE)
            trim()


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def sets_of(docs: DataFrame) -> DataFrame:
    """doc_id, n, cls, even, odd and further columns of docs: size and class of each set, and its spare parts in the even and odd instance."""
    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            hashes, ends = shingle_runs(batch.column("text"))
            size = _apart(ends)
            cls = [class_of(hashes[b - n : b]) for b, n in zip(ends.tolist(), size.tolist(), strict=True)]
            j = np.searchsorted(BOUNDS_ARRAY, size, "right") - 1
            spare = np.stack([np.where(size > 0, instances(hashes, ends, up)[4], 0) for up in (0, 1)])
            even, odd = np.where(j % 2 == 0, spare, spare[::-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size), pa.array(cls, pa.int64()), pa.array(even.astype(np.int32)), pa.array(odd.astype(np.int32)), *map(batch.column, more)],
                ["doc_id", "n", "cls", "even", "odd", *more],
            )

    return _texts(docs, *more).mapInArrow(trimmed(run), "doc_id long, n long, cls long, even int, odd int" + (f", {kinds}" if more else ""))


def packed_signatures(docs: DataFrame, labels: int) -> DataFrame:
    """label, sigs, classes: signatures of all sets, packed by label; a class counts once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs: list[np.ndarray] = []
        owners: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal sigs, owners
            s, cls = np.concatenate(sigs), np.concatenate(owners)
            label = ((s >> U(48)) % U(labels)).astype(np.uint16)
            order = np.argsort(label, kind="stable")
            s, cls, label = s[order], cls[order], label[order]
            short = ((s >> U(8)) << U(1) | (s & U(1))).view(np.uint8).reshape(-1, 8)[:, :5].copy()
            first = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]])).tolist()
            ends = [*first[1:], len(s)]
            sigs, owners = [], []
            return pa.RecordBatch.from_arrays(
                [pa.array(label[first].astype(np.int32)), pa.array([short[a:b].tobytes() for a, b in zip(first, ends, strict=True)]), pa.array([cls[a:b].tobytes() for a, b in zip(first, ends, strict=True)])],
                ["label", "sigs", "classes"],
            )

        for batch in _slices(batches):
            hashes, ends = shingle_runs(batch.column("text"))
            runs = [hashes[b - n : b] for b, n in zip(ends.tolist(), _apart(ends).tolist(), strict=True) if n]
            fresh = {c: r for c, r in zip(map(class_of, runs), runs, strict=True) if c not in seen}
            if not fresh:
                continue
            if len(seen) < 200_000:
                seen.update(fresh)
            cls, runs = np.fromiter(fresh, np.int64, len(fresh)), list(fresh.values())
            s, owner = signatures(np.concatenate(runs), np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs))))
            sigs.append(s)
            owners.append(cls[owner])
            if sum(map(len, sigs)) >= FLUSH:
                yield flush()
        if sigs:
            yield flush()

    return _texts(docs).where("doc_id is not null").mapInArrow(trimmed(run), "label int, sigs binary, classes binary")


def _bucket_pairs(key: np.ndarray, cls: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(kind, columns x, y, odd, n) of the buckets of one label, see buckets."""
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    key, cls = key[shared], cls[order[shared]]
    order = np.lexsort((cls, key))
    key, cls = key[order], cls[order]
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])])[: len(key)]
    key, cls = key[fresh], cls[fresh]
    if not len(key):
        return
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([first, [len(key)]]))
    rank = np.arange(len(key)) - np.repeat(first, size)
    sizes = np.repeat(size, size)
    odd, pairs = (key & U(1)).astype(np.int32), []
    for step in range(1, SMALL):  # small buckets: each with the step-th before it; large ones: with the first alone
        at = np.flatnonzero((rank >= step) & (sizes <= SMALL))
        pairs.append(np.stack([cls[at - step], cls[at], odd[at], np.ones(len(at), np.int64)]))
    at = np.flatnonzero((rank > 0) & (sizes > SMALL))
    pairs.append(np.stack([cls[at - rank[at]], cls[at], odd[at], np.zeros(len(at), np.int64)]))
    x, y, half, n = np.concatenate(pairs, 1)
    if len(x):  # a bucket may hold one class only, from several tasks
        order = np.lexsort((half, y, x))
        x, y, half, n = x[order], y[order], half[order], n[order]
        start = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (half[1:] != half[:-1])]))
        yield 0, [x[start], y[start], half[start], np.add.reduceat(n, start)]
    large = np.flatnonzero(sizes > SMALL)
    yield 1, [key[large].view(np.int64), cls[large], odd[large], np.zeros(len(large), np.int64)]


def buckets(packed: DataFrame) -> DataFrame:
    """kind, x, y, odd, n: pairs of classes and how many small buckets of an instance they share (kind 0; n is 0 for a pair of a large bucket), and signature and class of members of large buckets (kind 1).

    Rows come sorted by label within partitions; one label is held at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(label: int) -> Iterator[pa.RecordBatch]:
            key, cls = np.concatenate(keys), np.concatenate(owners)
            for kind, columns in _bucket_pairs(key, cls):
                for a in range(0, len(columns[0]), 50_000):
                    some = [c[a : a + 50_000] for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some[0]), kind, np.int32)), pa.array(some[0]), pa.array(some[1]), pa.array(some[2].astype(np.int32)), pa.array(some[3])], ["kind", "x", "y", "odd", "n"])

        keys, owners, held = [], [], None
        for batch in batches:
            for i in range(batch.num_rows):
                label, s, c = (batch.column(k)[i].as_py() for k in range(3))
                if label != held and keys:
                    yield from out(held)
                    keys, owners = [], []
                held = label
                raw = np.zeros((len(s) // 5, 8), np.uint8)
                raw[:, :5] = np.frombuffer(s, np.uint8).reshape(-1, 5)
                keys.append(raw.view(U).ravel() | (U(label) << U(40)))
                owners.append(np.frombuffer(c, np.int64))
        if keys:
            yield from out(held)

    return packed.mapInArrow(trimmed(run), "kind int, x long, y long, odd int, n long")


def contents(docs: DataFrame, wanted: DataFrame, classes: DataFrame, work: Workspace) -> DataFrame:
    """cls, content: the sets of the classes wanted (cls), stored; their texts are read again."""
    reps = work.store(classes.join(wanted, "cls", "left_semi").select("node").distinct(), "reps")
    few = reps.count() <= BROADCAST_IDS
    texts = _texts(docs).join(F.broadcast(reps) if few else reps, F.col("doc_id") == F.col("node"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            hashes, ends = shingle_runs(batch.column("text"))
            found = [hashes[b - n : b] for b, n in zip(ends.tolist(), _apart(ends).tolist(), strict=True)]
            if found:
                yield _batch([(class_of(s), s.tobytes()) for s in found], [pa.int64(), pa.binary()], ["cls", "content"])

    return work.store(texts.select("text").mapInArrow(trimmed(run), "cls long, content binary").dropDuplicates(["cls"]), "sets")


def verified(pairs: DataFrame, sets: DataFrame, work: Workspace) -> DataFrame:
    """The pairs (x, y) of classes whose sets (cls, content) link, compared in full."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x").to_numpy(), batch.column("y").to_numpy()
            good = [linked(np.frombuffer(a.as_buffer(), U), np.frombuffer(b.as_buffer(), U)) for a, b in zip(batch.column("a"), batch.column("b"), strict=True)]
            if any(good):
                yield pa.RecordBatch.from_arrays([pa.array(x[good]), pa.array(y[good])], ["x", "y"])

    a, b = sets.select(F.col("cls").alias("x"), F.col("content").alias("a")), sets.select(F.col("cls").alias("y"), F.col("content").alias("b"))
    # one content travels with each pair, the other comes from its own side
    both = pairs.select(F.greatest("x", "y").alias("y"), F.least("x", "y").alias("x")).join(b, "y").join(a, "x").select("x", "y", "a", "b")
    return work.store(both.mapInArrow(trimmed(compare), "x long, y long"), "links")


def _size_step(size) -> F.Column:
    return F.floor(F.log(size.cast("double")) / F.lit(float(np.log(SIZE_STEP)))).cast("int")


def ordered_sets(sets: DataFrame, work: Workspace) -> DataFrame:
    """cls, size, common, probe, n_index of the sets (cls, content) that can link with another of them.

    common: how many shingles some other set holds too; probe: those of them
    that lie in the prefix as the larger set, rarest first; n_index: how many
    of these lie in the prefix as the smaller one.  Single shingles take the
    first places of a prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, raw in zip(batch.column("cls").to_pylist(), batch.column("content"), strict=True):
                h = np.frombuffer(raw.as_buffer(), np.int64)
                for a in range(0, len(h), 65_536):
                    yield pa.RecordBatch.from_arrays([pa.array(h[a : a + 65_536]), pa.array(np.full(len(h[a : a + 65_536]), cls, np.int64))], ["h", "cls"])

    size = F.col("size")
    sized = sets.select("cls", "content", F.expr("cast(octet_length(content) / 8 as long)").alias("size"))
    # sets too much of which no other one holds are left out by counts alone; the rest is counted anew among themselves
    single = sets.mapInArrow(trimmed(run), "h long, cls long").groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("cls").alias("cls")).where("m = 1").groupBy("cls").agg(F.count(F.lit(1)).alias("single"))
    sized = sized.join(single, "cls", "left").where((size - F.coalesce("single", F.lit(0))) * DENOMINATOR >= size * NUMERATOR).drop("single")
    sized = able = work.store(sized, "able")
    each = work.store(sized.select("cls", "content").mapInArrow(trimmed(run), "h long, cls long"), "shingles")
    held = each.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    common = each.join(held, "h").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("m", "h"))).alias("order"))
    sized = sized.select("cls", "size").join(common, "cls").withColumn("common", F.size("order").cast("long"))
    first = lambda share: F.greatest(size - F.ceil(size * share[0] / share[1]) + 1 - (size - F.col("common")), F.lit(0))
    larger, smaller = (NUMERATOR, DENOMINATOR), (2 * NUMERATOR, NUMERATOR + DENOMINATOR)
    probe = F.transform(F.slice("order", F.lit(1), first(larger).cast("int")), lambda s: s["h"])
    out = work.store(sized.where(F.col("common") * DENOMINATOR >= size * NUMERATOR).select("cls", "size", "common", probe.alias("probe"), first(smaller).cast("int").alias("n_index")), "ordered")
    work.drop(each, able)
    return out


def crossing_pairs(ordered: DataFrame, roots: DataFrame, pivots: bool = False) -> DataFrame:
    """x, y: pairs of ordered sets of different roots (cls, root) that can link; with pivots only those with one set of each key.

    The pivot of a key is the set that has most in common with others.
    """
    sized, size = ordered.join(roots, "cls"), F.col("size")
    entries = sized.where("n_index > 0").select(F.col("cls").alias("y"), F.col("root").alias("s"), F.col("size").alias("q"), F.col("common").alias("d"), _size_step(size).alias("step"), F.explode(F.slice("probe", F.lit(1), F.col("n_index"))).alias("h"))
    if pivots:
        entries = entries.groupBy("h", "step").agg(F.max(F.struct("d", "y", "s", "q")).alias("b")).select("h", "step", "b.*")
    least = F.ceil(size * NUMERATOR / DENOMINATOR)
    most = F.least(size, F.floor(F.col("common") * (NUMERATOR + DENOMINATOR) / NUMERATOR).cast("long") - size)
    probes = sized.where(most >= least).select(F.col("cls").alias("x"), F.col("root").alias("r"), F.col("size").alias("p"), F.col("common").alias("c"), least.alias("least"), F.explode(F.sequence(_size_step(least), _size_step(most))).alias("step"), "probe")
    # partners of a step are no smaller than its lower end, so fewer places of the larger set are needed
    smallest = F.greatest(F.col("least"), F.floor(F.pow(F.lit(SIZE_STEP), F.col("step"))))
    places = F.col("p") - F.ceil((F.col("p") + smallest) * NUMERATOR / (NUMERATOR + DENOMINATOR)) + 1 - (F.col("p") - F.col("c"))
    probes = probes.select("x", "r", "p", "c", "step", F.explode(F.slice("probe", F.lit(1), F.greatest(places, F.lit(0)).cast("int"))).alias("h"))
    # a probe meets the labels that a key holds before their sets, so sets of its own are never paired
    probes = probes.join(entries.select("h", "step", "s").distinct(), ["h", "step"]).where("r != s")
    can = (F.least("c", "d") * (NUMERATOR + DENOMINATOR) >= (F.col("p") + F.col("q")) * NUMERATOR) & (F.col("q") <= F.col("p")) & (F.col("q") * DENOMINATOR >= F.col("p") * NUMERATOR)
    met = probes.join(entries, ["h", "step", "s"]).where(can)
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def near_labels(edges: DataFrame, work: Workspace) -> DataFrame:
    """node, root: the smallest node within two edges (a, b), or the node itself.

    Nodes with one label lie in one component, so pairs of them need no
    comparison; that a component has several labels costs comparisons only.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("label"))
    out = both.join(one, "b").groupBy("a").agg(F.min("label").alias("label"))
    return work.store(out.select(F.col("a").alias("node"), F.least("a", "label").alias("root")), "labels")


def classes_and_roots(docs: DataFrame) -> tuple[DataFrame, DataFrame, Workspace]:
    """Rows (see sets_of), and root and component_id of each class (c) that holds a document; both stored."""
    spark = docs.sparkSession
    work, p = Workspace(spark, "ngram-join"), partitions(spark)
    rows = work.store(sets_of(docs), "rows")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("node"), F.max("n").alias("n"), F.max("even").alias("even"), F.max("odd").alias("odd"))
    classes = work.store(classes, "classes")
    packed = packed_signatures(docs.select("doc_id", "text"), min(1 << 15, 8 * p)).repartition(p, "label").sortWithinPartitions("label")
    found = work.store(buckets(packed), "buckets")
    members = found.where("kind = 1").select(F.col("x").alias("sig"), F.col("y").alias("cls"), "odd")
    counted = members.groupBy("cls", "odd").agg(F.count(F.lit(1)).alias("large"))
    spares = classes.select("cls", "n", F.explode(F.array(F.struct(F.lit(0).alias("odd"), F.col("even").alias("spare")), F.struct(F.lit(1).alias("odd"), F.col("odd").alias("spare")))).alias("s"))
    spares = work.store(spares.select("cls", "n", "s.odd", "s.spare").join(counted, ["cls", "odd"], "left").withColumn("large", F.coalesce("large", F.lit(0))), "spares")
    side = lambda c: spares.select(F.col("cls").alias(c), "odd", F.col("n").alias(f"n{c}"), F.col("spare").alias(f"s{c}"), F.col("large").alias(f"l{c}"))
    shared = found.where("kind = 0").groupBy("x", "y", "odd").agg(F.sum("n").alias("n")).join(side("x"), ["x", "odd"]).join(side("y"), ["y", "odd"])
    enough = F.col("n") + F.least("lx", "ly") >= F.greatest("sx", "sy", F.lit(1))
    near = F.least("nx", "ny") * DENOMINATOR >= F.greatest("nx", "ny") * NUMERATOR
    pairs = work.store(shared.where(enough & near).select("x", "y").distinct(), "pairs")
    sets = contents(docs, pairs.select(F.explode(F.array("x", "y")).alias("cls")).distinct(), classes, work)
    links = verified(pairs, sets, work)
    work.drop(sets)
    edges = links.select(F.col("x").alias("a"), F.col("y").alias("b"))
    roots = near_labels(edges, work)

    # Members of large buckets that smaller ones do not settle, and their labels so far.
    unsettled = spares.where("large > 0 and large >= spare").select("cls", "odd")
    left = members.join(unsettled, ["cls", "odd"]).join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("sig", "cls", F.coalesce("root", "cls").alias("root"))
    left = work.store(left, "unsettled")
    mixed = left.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("sig")
    left = work.store(left.join(mixed, "sig", "left_semi").select("cls", "root").distinct(), "mixed")
    if left.limit(1).count():
        sets = contents(docs, left.select("cls"), classes, work)
        ordered = ordered_sets(sets, work)
        members = left.select("cls")
        done = None
        for pivots in (True, False):  # most true copies find their label by the pivots, and are not paired after that
            of = members.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"))
            more = crossing_pairs(ordered, of, pivots)
            more = work.store(more if done is None else more.join(done, ["x", "y"], "left_anti"), "crossing")
            done = more
            edges = edges.unionByName(verified(more, sets, work).select(F.col("x").alias("a"), F.col("y").alias("b")))
            roots = near_labels(edges, work) if pivots else roots
        work.drop(sets)
    roots = connected_components(edges, work)
    of_class = classes.select(F.col("cls").alias("c"), "node").join(roots.withColumnRenamed("node", "c"), "c", "left").select("c", "node", F.coalesce("root", "c").alias("root"))
    least = of_class.groupBy("root").agg(F.min("node").alias("component_id"))
    of_class = work.store(of_class.join(least, "root").select("c", "root", "component_id"), "components")
    work.keep_only(rows, of_class)
    return rows, of_class, work


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of documents (doc_id, text)."""
    rows, of_class, _ = classes_and_roots(docs.select("doc_id", "text"))
    own = (F.col("cls") == F.col("c")) & (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return rows.join(of_class, own, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def first_of_groups(docs: DataFrame) -> DataFrame:
    """Of each component one document, with all columns: the smallest doc_id, of rows that repeat it the one whose text has the smallest hash.

    Rows with a null doc_id, without text or without words are in no
    component and stay; of rows that repeat doc_id and text one stays.
    """
    tag = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows, of_class, work = classes_and_roots(docs.select("doc_id", "text", tag.alias("tag")))
    member = rows.where("n > 0 and doc_id is not null").join(of_class, F.col("cls") == F.col("c"))
    each = member.groupBy("root", "doc_id", "tag").agg(F.count(F.lit(1)).alias("copies"))
    first = each.groupBy("root").agg(F.min(F.struct("doc_id", "tag")).alias("first"), F.sum("copies").alias("rows")).where("rows > 1").drop("rows")
    touched = each.join(first, "root").select(F.col("doc_id").alias("_at"), F.col("tag").alias("_tag"), ((F.col("doc_id") == F.col("first.doc_id")) & (F.col("tag") == F.col("first.tag"))).alias("_stays"), F.col("copies").alias("_copies"))
    touched = work.store(touched.where("not _stays or _copies > 1"), "touched")
    gone = touched.where("not _stays")
    out = docs.join(gone, (F.col("doc_id").cast("long") == F.col("_at")) & (tag == F.col("_tag")), "left_anti")
    repeated = touched.where("_stays")
    if not repeated.limit(1).count():
        return out
    same = (F.col("doc_id").cast("long") == F.col("_at")) & (tag == F.col("_tag"))
    once = out.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return out.join(repeated, same, "left_anti").unionByName(once)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_shingles, component_id."""
    return jaccard_components(load(spark, sf_dir, "documents", "doc_id", "text"))
