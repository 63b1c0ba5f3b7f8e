"""Stupid-backoff scores, by joining exploded n-grams with hash-partitioned count tables.

The model is the corpus itself.  A document is scored against the counts of
all others: its own occurrences are taken off every count, or each n-gram
would have been seen.  With c the remaining count, N the remaining number of
words and B = 0.4 the back-off,

    S(w | u v) = c(u v w) / c(u v)        if c(u v w) > 0
               = B * c(v w) / c(v)        else if c(v w) > 0
               = B * B * max(c(w), 0.5) / max(N, 1)   otherwise

and a document's score is the mean of ln S over its words; a word with less
than two words before it begins at the order that it has.

Relations, each n-gram a 40-bit hash under one of the hash labels (two a
shuffle partition, so about one n-gram in 200,000 shares both with another):

1. ``exploded``: documents are dealt to groups by their hash; a group gives,
   for each label, its distinct n-grams and how often it has them, packed.
2. ``counted``: per label the groups' counts are added up, and every group
   gets back the totals of its own n-grams: the join, on (label, n-gram).
3. ``scored``: the totals meet the group's documents, own counts are taken
   off, and the logarithms are summed per document.

Counts are combined in each group before the shuffle, so a frequent n-gram is
one entry a group, however often it occurs.

Defined cases: a null or wordless text has no words and a null score; a null
doc_id is scored and carried; repeated rows are documents of their own, so
they see each other's counts; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import load, partitions, text_or_empty, trim
from tramline.llm.ngram_join import mix

ORDER = 3
BACKOFF = 0.4
FLOOR = 0.5
#: Bits of an n-gram within its label.
VALUE = 40
#: Bytes of text that a partition of two groups holds, about, at most.
GROUP_BYTES = 24 << 20
SCORES = "doc_id long, n_words long, n_backoff2 long, n_backoff1 long, score double"
U = np.uint64


def grams(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the hash at each word of all texts (0 where the text has too few words before it), and the texts' lengths.

    Words are lower-cased and split at white space; each distinct one is hashed once.
    """
    cut = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")))
    codes = cut.flatten().dictionary_encode()
    words = codes.dictionary.cast(pa.binary()).to_pylist()
    code, upto = codes.indices.to_numpy(), cut.offsets.to_numpy().astype(np.int64)
    upto = upto - upto[0]
    if b"" in words:  # white space at an end leaves an empty word
        full = code != words.index(b"")
        upto, code = np.concatenate([[0], np.cumsum(full)])[upto], code[full]
    sizes = np.diff(upto)
    flat = (np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words)) | U(1))[code]
    place = np.arange(len(flat)) - np.repeat(upto[:-1], sizes)
    out, last = [], flat
    for order in range(1, ORDER + 1):
        if order > 1:
            last = np.concatenate([np.zeros(1, U), last[:-1]])[: len(flat)]
            last = mix(last + flat * U(0x9E3779B97F4A7C15) + U(order))
        out.append(np.where(place >= order - 1, last | U(1), U(0)))
    return out, sizes


def pack(values: np.ndarray) -> bytes:
    """Ascending numbers as differences of as few bytes as the largest needs."""
    gaps = np.diff(values, prepend=U(0)).astype("<u8")
    width = max(1, -(-int(gaps.max()).bit_length() // 8)) if len(gaps) else 1
    return bytes([width]) + gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    raw[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(raw.view("<u8").ravel(), dtype=U)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts, nearly all 1: a byte each, 255 standing for one of the wide counts at the end."""
    small = np.minimum(counts, 255).astype(np.uint8)
    wide = counts[small == 255].astype("<i8")
    return len(counts).to_bytes(8, "little") + small.tobytes() + wide.tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    out = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", offset=8 + n)
    return out


def _keys(gram: np.ndarray, labels: int) -> np.ndarray:
    """Label (upper bits) and n-gram within it (VALUE bits, never 0) in one number."""
    value = np.maximum((gram >> U(1)) & U((1 << VALUE) - 1), U(1))
    return ((gram >> U(48)) % U(labels)) << U(VALUE) | value


def _own(gram: list[np.ndarray], labels: int, places: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Distinct keys of a group, ascending, their counts, and, if asked for, which of them stands at each place of each order; key 0 counts the words."""
    every = np.concatenate([g[g > 0] for g in gram])
    if not places:
        key = np.sort(_keys(every, labels))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        at = None
    else:
        plain = _keys(every, labels)
        order = np.argsort(plain)
        key = plain[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        first, at = np.flatnonzero(new), np.empty(len(key), np.int32)
        at[order] = np.cumsum(new)
    counts = np.diff(np.concatenate([first, [len(key)]]))
    return np.concatenate([np.zeros(1, U), key[first]]), np.concatenate([[len(gram[0])], counts]), at


def evenly(spark: SparkSession, n: int, each: int) -> list[int]:
    """each * n numbers, of which Spark's hash partitioning over n partitions deals each to every partition."""
    ids = spark.range(n * (8 * each + 32)).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("part"))
    found = ids.groupBy("part").agg(F.slice(F.array_sort(F.collect_list("id")), 1, each).alias("ids")).orderBy("part").collect()
    return [r.ids[k] for k in range(each) for r in found if len(r.ids) > k]


def exploded(groups: DataFrame, labels: list[int]) -> DataFrame:
    """label, grp, grams, counts: what the documents (grp, doc_id, text) of each group have, packed by label."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        gram, _ = grams(table.column("text").combine_chunks())
        keys, counts, _ = _own(gram, len(labels))
        label = (keys >> U(VALUE)).astype(np.int32)
        value = keys & U((1 << VALUE) - 1)
        first = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]])).tolist()
        cut = list(zip(first, [*first[1:], len(label)], strict=True))
        return pa.table(
            {
                "label": pa.array([labels[k] for k in label[first].tolist()], pa.int64()),
                "nth": pa.array(label[first]),
                "grp": pa.array([key[0].as_py()] * len(cut), pa.int64()),
                "grams": pa.array([pack(value[a:b]) for a, b in cut], pa.binary()),
                "counts": pa.array([pack_counts(counts[a:b]) for a, b in cut], pa.binary()),
            }
        )

    return groups.groupBy("grp").applyInArrow(run, "label long, nth int, grp long, grams binary, counts binary")


def counted(packed: DataFrame) -> DataFrame:
    """grp, nth, totals: for each group the corpus counts of its n-grams of a label, in its order."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sets = [unpack(x) for x in table.column("grams").to_pylist()]
        ends = np.cumsum([len(s) for s in sets]).tolist()
        value = np.concatenate(sets)
        del sets
        order = np.argsort(value)
        value = value[order]
        new = np.concatenate([[True], value[1:] != value[:-1]])
        counts = np.concatenate([unpack_counts(x) for x in table.column("counts").to_pylist()])[order]
        sums = np.add.reduceat(counts, np.flatnonzero(new))
        total = np.empty(len(value), np.int64)
        total[order] = sums[np.cumsum(new) - 1]
        out = [pack_counts(total[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return pa.table({"grp": table.column("grp"), "nth": table.column("nth"), "totals": pa.array(out, pa.binary())})

    return packed.groupBy("label").applyInArrow(run, "grp long, nth int, totals binary")


def _others(at: np.ndarray, doc: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Count of each word's n-gram in other documents; at: its place in total, or -1."""
    out = np.zeros(len(at), np.int64)
    some = np.flatnonzero(at >= 0)
    some = some[total[at[some]] > 1]  # a count of 1 is the document's own
    if len(some):
        pair = doc[some] * len(total) + at[some]
        order = np.argsort(pair)
        pair = pair[order]
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        own = np.empty(len(some), np.int64)
        own[order] = np.repeat(np.diff(np.concatenate([first, [len(pair)]])), np.diff(np.concatenate([first, [len(pair)]])))
        out[some] = total[at[some]] - own
    return out


def score_texts(gram: list[np.ndarray], sizes: np.ndarray, at: np.ndarray, total: np.ndarray, backoff: float = BACKOFF) -> list[tuple]:
    """(words, backed off once, twice, score) of each text, from the corpus counts of the group's keys and the key at each place."""
    n, doc = len(gram[0]), np.repeat(np.arange(len(sizes)), sizes)
    if not n:
        return [(0, 0, 0, None)] * len(sizes)
    c, start = [], 0
    for g in gram:
        has = np.flatnonzero(g > 0)
        place = np.full(n, -1, np.int64)
        place[has] = at[start : start + len(has)]
        start += len(has)
        c.append(_others(place, doc, total))
    before = lambda x: np.concatenate([[0], x[:-1]])
    rest = np.maximum(int(total[0]) - sizes[doc], 1)
    s = backoff * backoff * np.maximum(c[0], FLOOR) / rest
    place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    s = np.where(place == 0, s / backoff / backoff, np.where(place == 1, s / backoff, s))
    with np.errstate(divide="ignore", invalid="ignore"):
        two = (c[1] > 0) & (place >= 1)
        s = np.where(two, np.where(place == 1, 1.0, backoff) * c[1] / np.maximum(before(c[0]), 1), s)
        three = (c[2] > 0) & (place >= 2)
        s = np.where(three, c[2] / np.maximum(before(c[1]), 1), s)
    m = len(sizes)
    sums = np.bincount(doc, np.log(s), m)
    once = np.bincount(doc, two & ~three & (place >= 2), m).astype(int)
    twice = np.bincount(doc, ~two & ~three & (place >= 1), m).astype(int)
    return [(int(k), int(a), int(b), float(x / k) if k else None) for k, a, b, x in zip(sizes, once, twice, sums, strict=True)]


def stupid_backoff(docs: DataFrame, backoff: float = BACKOFF) -> DataFrame:
    """SCORES, a row for each row of documents (doc_id, text)."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    held = keyed.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    n = max(partitions(spark), -(-held // GROUP_BYTES))
    numbers = evenly(spark, n, 2)
    nth = F.pmod(F.xxhash64("doc_id", "text"), F.lit(len(numbers))).cast("int")
    groups = keyed.withColumn("grp", F.get(F.lit(numbers).cast("array<bigint>"), nth)).repartition(n, "grp")
    totals = counted(exploded(groups, numbers).repartition(n, "label"))
    names = [c.split()[0] for c in SCORES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]

    def run(key: tuple, own: pa.Table, answers: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        gram, sizes = grams(own.column("text").combine_chunks())
        keys, _, at = _own(gram, len(numbers), places=True)
        by_label = dict(zip(answers.column("nth").to_pylist(), answers.column("totals").to_pylist(), strict=True))
        total = np.concatenate([unpack_counts(by_label[k]) for k in sorted(by_label)])
        if len(keys) != len(total):
            raise RuntimeError("the totals of a group do not fit its n-grams")
        trim()
        rows = [(d, *r) for d, r in zip(own.column("doc_id").to_pylist(), score_texts(gram, sizes, at, total, backoff), strict=True)]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return groups.groupBy("grp").cogroup(totals.repartition(n, "grp").groupBy("grp")).applyInArrow(run, SCORES)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: SCORES."""
    return stupid_backoff(load(spark, sf_dir, "documents", "doc_id", "text"))
