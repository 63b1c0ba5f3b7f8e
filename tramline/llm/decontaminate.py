"""Benchmark decontamination by template canonicalisation.

Words become lower-case literals without outer punctuation; numbers, names
(capitalised words that neither open a sentence nor are all capitals) and units become typed
placeholders.  Windows of five template words are hashed and joined between
documents and benchmark items.  A matched window counts if its slots agree
with those matched before: within one document and item an item's value always
stands for one value of the document and the reverse, which holds for a
verbatim copy and for a re-parameterised question but not for chance matches.
An item is found in a document when at least 75 % of its distinct windows
count.

Item windows are a table, and so are the windows of documents; they meet in a
hash join.  Where the distinct window hashes of all items are at most
``MAX_HASHES``, executors hold them and put out only those windows of a
document that are among them; beyond that all windows are joined.  Pairs of
document and item that share enough windows are verified one pair at a time.

Defined cases: null texts count as empty; an item or text with fewer than five
words is one window of all its words, one without words matches nothing;
items with equal text are each found, rows that repeat an item_id and its text
count once; a null item_id is left out; repeated documents are each reported;
empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import Workspace, load, text_or_empty, trimmed

WINDOW = 5
SIMILAR = 0.75
#: Distinct hashes of item windows (8 bytes each) that executors hold at most.
MAX_HASHES = 2_000_000
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds lb lbs oz ounce ounces ton tons "
    "ml l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months "
    "year years kmh mph hz w kw v a j kj cal kcal % percent $ € £ usd eur dollar dollars euro euros cent cents degree degrees °c °f".split()
)
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half".split())
NUMBER = re.compile(r"[-+]?[$€£]?[0-9][0-9.,:/]*(%|st|nd|rd|th)?")
OUTER = "\"'`“”‘’„«»()[]{}<>.,;:!?…*_#|"
ENDS = tuple(".!?:\"”»")
NUM, NAME, UNIT = 1, 2, 3
FOUND = "doc_id long, item_id long, n_windows int, n_matched int, n_verbatim int, similarity double"
U = np.uint64


class _Words(dict):
    """Word -> literal hash with flags in its low bits: 1 capitalised, 2 ends a sentence; placeholders are small."""

    def __missing__(self, word: str) -> int:
        bare = word.strip(OUTER)
        low = bare.lower()
        if NUMBER.fullmatch(bare) or low in NUMBER_WORDS:
            kind = NUM << 2
        elif low in UNITS:
            kind = UNIT << 2
        else:
            kind = (xxhash.xxh3_64_intdigest(low) | (1 << 10)) & ~3 & ((1 << 63) - 1)
            if bare[:1].isupper() and not bare.isupper():
                kind |= 1
        out = kind | (2 if word.endswith(ENDS) else 0)
        if len(self) > 200_000:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out


_WORDS = _Words()


def template(text: str | None, opening: bool = True, names: bool = True) -> tuple[list[str], np.ndarray]:
    """The words of a text, and the template word of each as a number; opening: the first word opens a sentence; names: they become placeholders."""
    words = (text or "").split()
    got = np.fromiter(map(_WORDS.__getitem__, words), np.int64, len(words))
    opens = np.full(len(words), opening)
    opens[1:] = got[:-1] & 2 > 0
    return words, np.where((got & 1 > 0) & ~opens & names, NAME << 2, got & ~np.int64(3))


def windows(kinds: np.ndarray) -> np.ndarray:
    """Hash of each run of WINDOW template words; a shorter text is one run."""
    if not len(kinds):
        return np.zeros(0, U)
    size, h = min(WINDOW, len(kinds)), np.zeros(len(kinds) - min(WINDOW, len(kinds)) + 1, U)
    for j in range(size):
        h = (h ^ kinds[j : len(kinds) - size + 1 + j].astype(U)) * U(0x9E3779B97F4A7C15)
        h ^= h >> U(31)
    return (h ^ U(size)) * U(0xD6E8FEB86659FD93)


def readings(text: str | None) -> tuple[list[str], np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Words, template words and window hashes of an item, and (hash, place) of all readings of it.

    An item may stand inside a sentence of a document, where its first word
    reads as a name, or in capitals throughout, where no word does; its windows
    are therefore kept in these readings too.
    """
    words, kinds = template(text)
    own = windows(kinds)
    found = {(h, pos) for pos, h in enumerate(own.tolist())}
    if len(own):
        found.add((int(windows(template(text, False)[1][:WINDOW])[0]), 0))
        found |= {(h, pos) for pos, h in enumerate(windows(template(text, names=False)[1]).tolist())}
    return words, kinds, own, sorted(found, key=lambda x: (x[1], x[0]))


ITEMS = "h long, item long, item_id long, pos int, own long, total int, kinds array<bigint>, words array<string>"
HITS = "row long, doc_id long, tag long, h long, at int, kinds array<bigint>, words array<string>"


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def item_windows(benchmark: DataFrame) -> DataFrame:
    """ITEMS: every window of every item (item_id, text) in all readings, with its words and the hash of its own reading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, item_id, text in zip(*(batch.column(c).to_pylist() for c in ("item", "item_id", "text")), strict=True):
                words, kinds, own, found = readings(text)
                total = len(set(own.tolist()))
                for h, pos in found:
                    rows.append((_signed(h), item, item_id, pos, _signed(int(own[pos])), total, kinds[pos : pos + WINDOW].tolist(), words[pos : pos + WINDOW]))
            if rows:
                yield _table(rows, ITEMS)

    own = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text")).distinct()
    return own.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").mapInArrow(trimmed(run), ITEMS)


def document_windows(docs: DataFrame, hashes: np.ndarray | None) -> DataFrame:
    """HITS: the windows of documents that are among the sorted hashes, all without them; row numbers the documents."""
    sent = None if hashes is None else docs.sparkSession.sparkContext.broadcast(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, serial = None if sent is None else sent.value, TaskContext.get().partitionId() << 33
        if known is not None:
            maybe = np.zeros(1 << 20, bool)
            maybe[(known >> U(44)).astype(np.int64)] = True
        for batch in batches:
            rows = []
            for doc_id, tag, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "text")), strict=True):
                serial += 1
                words, kinds = template(text)
                h = windows(kinds)
                at = np.arange(len(h))
                if known is not None:
                    at = np.flatnonzero(maybe[(h >> U(44)).astype(np.int64)]) if len(known) else at[:0]
                    at = at[known[np.minimum(np.searchsorted(known, h[at]), len(known) - 1)] == h[at]] if len(at) else at
                for p in at.tolist():
                    rows.append((serial, doc_id, tag, _signed(int(h[p])), p, kinds[p : p + WINDOW].tolist(), words[p : p + WINDOW]))
                if len(rows) >= 20_000:
                    yield _table(rows, HITS)
                    rows = []
            if rows:
                yield _table(rows, HITS)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("tag"), text_or_empty().alias("text"))
    return own.mapInArrow(trimmed(run), HITS)


def agreeing(pairs: list[tuple]) -> tuple[set[int], set[int]]:
    """Own hashes of the item windows that count, and of those that are verbatim.

    pairs: (place in the document, place in the item, own hash, and kinds and
    words of both windows).  Runs at one shift are taken longest first; a window
    counts if its slots agree with those that counted before.
    """
    runs: dict[int, list[tuple]] = defaultdict(list)
    for x in pairs:
        runs[x[0] - x[1]].append(x)
    there: dict[tuple, str] = {}
    back: dict[tuple, str] = {}
    counted, verbatim = set(), set()
    bare = lambda w: w.strip(OUTER).lower()
    for shift in sorted(runs, key=lambda s: (-len(runs[s]), s)):
        for _, _, own, kinds, words, doc_kinds, doc_words in sorted(runs[shift], key=lambda x: x[:2]):
            slots = [(k, bare(a), bare(b)) for k, a, j, b in zip(kinds, words, doc_kinds, doc_words, strict=False) if k <= UNIT << 2 and j == k]
            if all(there.get((k, a), b) == b and back.get((k, b), a) == a for k, a, b in slots):
                there |= {(k, a): b for k, a, b in slots}
                back |= {(k, b): a for k, a, b in slots}
                counted.add(own)
                if all(a == b for _, a, b in slots):
                    verbatim.add(own)
    return counted, verbatim


def _verified(key: tuple, table: pa.Table) -> pa.Table:
    columns = ("at", "pos", "own", "kinds", "words", "doc_kinds", "doc_words")
    counted, verbatim = agreeing(list(zip(*(table.column(c).to_pylist() for c in columns), strict=True)))
    first = table.slice(0, 1).to_pylist()[0]
    hit = len(counted) >= SIMILAR * first["total"]
    row = (first["doc_id"], first["item_id"], first["total"], len(counted), len(verbatim), len(counted) / first["total"], first["tag"])
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64()]
    return pa.table([pa.array([v] if hit else [], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in f"{FOUND}, tag long".split(", ")])


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, most: int = MAX_HASHES) -> DataFrame:
    """FOUND, and the hash of the document's text (tag), stored: a row for each document and benchmark item found in it."""
    work = Workspace(docs.sparkSession, "decontaminate")
    items = work.store(item_windows(benchmark), "items")
    distinct = items.select("h").distinct()
    few = distinct.count() <= most
    hashes = np.sort(np.array([r.h for r in distinct.collect()], np.int64).view(U)) if few else None
    hits = work.store(document_windows(docs, hashes), "hits")
    both = hits.withColumnsRenamed({"kinds": "doc_kinds", "words": "doc_words"}).join(items, "h")
    enough = both.groupBy("row", "item").agg(F.count_distinct("own").alias("n"), F.max("total").alias("t")).where(F.col("n") >= F.lit(SIMILAR) * F.col("t")).select("row", "item")
    asked = both.join(enough, ["row", "item"], "left_semi")
    out = work.store(asked.groupBy("row", "item").applyInArrow(_verified, f"{FOUND}, tag long"), "found")
    work.keep_only(out)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, most: int = MAX_HASHES) -> DataFrame:
    """FOUND: a row for each document and benchmark item found in it."""
    return contaminated_rows(docs, benchmark, most).drop("tag")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, most: int = MAX_HASHES) -> DataFrame:
    """The documents in which no benchmark item is found, with all their columns."""
    gone = contaminated_rows(docs, benchmark, most).select(F.col("doc_id").alias("_gone_id"), F.col("tag").alias("_gone_tag")).distinct()
    tag = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col("_gone_id")) & (tag == F.col("_gone_tag")), "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item found in it: FOUND."""
    return contaminated(load(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "benchmark", "item_id", "text"))
