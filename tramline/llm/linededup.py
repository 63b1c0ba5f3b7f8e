"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations only.

Lines are compared in lower case with white space made single blanks.  A line
is dropped when an equal line stood at an earlier place, or when an earlier
distinct line lies within one edit (substitution, insertion, deletion) of it.
Every line that is not blank takes part in the exact comparison, at any length
and in any script.  The unit of an edit is a word in lines of at least
``MIN_WORDS`` words, and a character in all others, which covers short lines
and scripts without spaces; one edit must be a small part of a line, so lines
of fewer than ``MIN_CHARS`` characters have no near ones.  Lines of different
units are not near each other.  Place is (doc_id, the text's checksum, line
number), null doc_ids last: rows that share a doc_id, or have none, stay apart.

Each distinct line emits its variants within the bound, the line itself and
the line without unit i, as hashed keys.  Equal keys join: two lines of n
units that agree without unit i differ in that unit; a line that equals
another without unit i is one insertion away.  Per key the earliest place is
taken by a plain minimum, which combines before the shuffle, so no pairs are
made within a key and a key that many lines share costs no more than its rows.
The pair of a line and its earliest partner is then verified unit by unit.

Two lines within one edit have an equal first or second half, of lengths that
differ by at most the edit; lines whose halves no other distinct line shares
have no partner and emit no variants.

What goes is marked by row and by the line itself, so a line goes only if it,
and not its number alone, was found elsewhere.

Defined cases: a null text has no lines and stays null; blank lines are
kept; rows of equal doc_id and text are one place and are kept or dropped
alike, others are told apart whatever their doc_ids; an empty table gives no
rows; a column ``_lines`` of the table gives way to the counts, other columns
may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.llm.common import Workspace, load

#: Words from which a line's unit is the word; characters below which a line without so many words has no near lines.
MIN_WORDS, MIN_CHARS = 5, 10
#: Lines named in a table that goes to all executors, at most (about 60 bytes each); beyond it the texts are shuffled instead.
BROADCAST_LINES = 1_000_000
LINE_BITS, ROW_BITS = 1 << 32, 1 << 28


def _row(text="text"):
    """28 bits of a text's checksum: with the doc_id, the row that a line stands in."""
    return F.conv(F.left(F.md5(F.col(text)), F.lit(7)), 16, 10).cast("long")


def _plain(text):
    """A text in lower case, white space within its lines made single blanks, ends not trimmed; rewritten only where it holds what is to be replaced."""
    other = "\t\x0b\x0c\r"
    has = F.lit(False)
    for c in other:
        has = has | F.contains(text, F.lit(c))
    lower = F.lower(text)
    one = F.when(has, F.translate(lower, other, "    ")).otherwise(lower)
    return F.when(has | F.contains(text, F.lit("  ")), F.regexp_replace(one, "  +", " ")).otherwise(lower)


def _normal(docs: DataFrame, *more: str) -> DataFrame:
    """doc, row, the lines of its text as _plain makes them, and further columns."""
    return docs.select(F.col("doc_id").cast("long").alias("doc"), _row().alias("row"), F.split(_plain(F.col("text")), "\n").alias("lines"), *more)


def _place(doc, row, line_no):
    """A place as one number that sorts by doc_id, null ones last, row and line number."""
    at = F.coalesce(doc.cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)"))
    at = (at * F.lit(ROW_BITS).cast("decimal(9,0)") + row.cast("decimal(9,0)")).cast("decimal(28,0)")
    return (at * F.lit(LINE_BITS).cast("decimal(10,0)") + line_no.cast("decimal(10,0)")).cast("decimal(38,0)")


def _row_of(place):
    """(doc, row, line number) of a place."""
    bits = lambda n: F.lit(n).cast("decimal(10,0)")
    line_no = F.pmod(place, bits(LINE_BITS))
    at = ((place - line_no) / bits(LINE_BITS)).cast("decimal(28,0)")
    row = F.pmod(at, bits(ROW_BITS))
    doc = ((at - row) / bits(ROW_BITS)).cast("decimal(20,0)")
    return F.when(doc < F.lit(str(1 << 63)).cast("decimal(20,0)"), doc.cast("long")), row.cast("long"), line_no.cast("int")


def _mark(line_no, norm_hash):
    """What tells a line of a row from every other: its number and itself."""
    return F.xxhash64(line_no.cast("int"), norm_hash)


def line_table(docs: DataFrame) -> DataFrame:
    """Places of the lines that are not blank: doc, row, line_no, k1, k2 (hash pair), and hashes of the halves of those that can have near lines."""
    lines = _normal(docs).select("doc", "row", F.posexplode_outer("lines").alias("line_no", "line"))  # the outer form adds no filter that would rewrite the text again
    norm = F.col("norm")
    rows = lines.select("doc", "row", "line_no", F.trim("line").alias("norm")).where(norm != "")
    rows = rows.withColumn("words", F.octet_length(norm) - F.octet_length(F.replace(norm, F.lit(" "), F.lit(""))) + 1)
    by_word = F.col("words") >= MIN_WORDS
    rows = rows.withColumn("n", F.when(by_word, F.col("words")).otherwise(F.char_length(norm)))
    lower, small = F.expr("cast(n div 2 as int)"), F.expr("cast((n - 1) div 2 as int)")
    first = lambda k: F.when(by_word, F.call_function("substring_index", norm, F.lit(" "), k)).otherwise(F.left(norm, k))
    last = lambda k: F.when(by_word, F.call_function("substring_index", norm, F.lit(" "), -k)).otherwise(F.right(norm, k))
    head = lambda k: F.xxhash64(F.lit("a"), by_word, k, first(k))
    tail = lambda k: F.xxhash64(F.lit("b"), by_word, k, last(k))
    halves = F.array_distinct(F.array(head(lower), head(small), tail(F.col("n") - lower), tail(F.col("n") - 1 - small)))
    near = by_word | (F.col("n") >= MIN_CHARS)
    return rows.select("doc", "row", "line_no", F.xxhash64(norm).alias("k1"), F.hash(norm).alias("k2"), F.when(near, halves).otherwise(F.array().cast("array<bigint>")).alias("halves"))


def _to_all(table: DataFrame, lines: int) -> DataFrame:
    """The table, for broadcast where the lines it names are few enough."""
    return F.broadcast(table) if lines <= BROADCAST_LINES else table


def near_lines(docs: DataFrame, places: DataFrame, distinct: DataFrame, work: Workspace) -> DataFrame:
    """Keys (k1, k2) of the distinct lines that have an earlier line within one edit."""
    half = places.select("k1", "k2", F.explode("halves").alias("half"))
    shared = half.groupBy("half").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a != b").select("half")
    wanted = half.join(shared, "half", "left_semi").select("k1", "k2").distinct()
    doc, row, line_no = _row_of(F.col("first"))
    named = distinct.join(wanted, ["k1", "k2"], "left_semi").select("k1", "k2", "first", line_no.alias("line_no"), doc.alias("at"), row.alias("in"))
    by_row = work.store(named.groupBy("at", "in").agg(F.collect_list(F.struct("line_no", "k1", "k2", "first")).alias("wanted")), "wanted")
    lines_named = by_row.agg(F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()[0]
    texts = docs.select("doc_id", "text").join(_to_all(by_row, lines_named), F.col("doc_id").cast("long").eqNullSafe(F.col("at")) & (_row() == F.col("in")))
    each = _normal(texts, "wanted").select("lines", F.explode("wanted").alias("w"))
    rows = each.select("w.k1", "w.k2", F.col("w.first").alias("own"), F.trim(F.get("lines", F.col("w.line_no"))).alias("norm"))
    lines = rows.where((F.xxhash64("norm") == F.col("k1")) & (F.hash("norm") == F.col("k2"))).dropDuplicates(["k1", "k2"])
    words = F.split("norm", " ")
    by_word = F.size(words) >= MIN_WORDS
    units = F.when(by_word, words).otherwise(F.regexp_extract_all("norm", F.lit("(?s)."), F.lit(0)))
    lines = work.store(lines.select("k1", "k2", "own", by_word.alias("by_word"), units.alias("units")).withColumn("n", F.size("units")), "lines")

    word = lines.select("k1", "k2", "n", "own", "by_word", F.posexplode("units").alias("i", "w"))
    word = word.select("k1", "k2", "n", "own", "i", F.xxhash64("w", "i", "by_word").alias("here"), F.xxhash64("w", F.col("i") - 1, "by_word").alias("before"))
    line = Window.partitionBy("k1", "k2")
    upto = line.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    sums = word.withColumns({"a": F.expr("bit_xor(here)").over(upto), "b": F.expr("bit_xor(before)").over(upto), "all_b": F.expr("bit_xor(before)").over(line)})
    x = lambda *c: F.expr(" ^ ".join(c))
    without = sums.select("own", (F.col("n") - 1).alias("len"), F.col("i").alias("pos"), x("a", "here", "all_b", "b").alias("key"))
    whole = sums.where("i = n - 1").select("own", F.col("n").alias("len"), F.lit(-1).alias("pos"), F.col("a").alias("key"))
    variants = work.store(without.unionByName(whole), "variants")

    slot = variants.groupBy("key", "len", "pos").agg(F.min("own").alias("first"), F.count(F.lit(1)).alias("rows"))
    both = slot.groupBy("key", "len").agg(F.min(F.when(F.col("pos") < 0, F.col("first"))).alias("full"), F.min(F.when(F.col("pos") >= 0, F.col("first"))).alias("cut"), F.sum("rows").alias("rows")).where("rows > 1")
    both = work.store(both.drop("rows"), "met")
    met = variants.join(both, ["key", "len"])
    same = met.where("pos >= 0").groupBy("key", "len", "pos").agg(F.min("own").alias("same"))
    met = met.join(same, ["key", "len", "pos"], "left")
    other = F.when(F.col("pos") < 0, F.col("cut")).otherwise(F.least("full", "same"))
    pairs = met.select("own", other.alias("other")).where("other < own").groupBy("own").agg(F.min("other").alias("other"))
    b = lines.select(F.col("own").alias("other"), F.col("units").alias("y"), F.col("by_word").alias("b2"))
    both = pairs.join(lines.select("own", "k1", "k2", "by_word", F.col("units").alias("x")), "own").join(b, "other").where("by_word = b2")
    return both.where(within_one(F.col("x"), F.col("y"))).select("k1", "k2").distinct()


def within_one(x, y):
    """Whether two arrays of units lie within one edit, compared unit by unit."""
    p = F.array_position(F.zip_with(x, y, lambda a, b: ~a.eqNullSafe(b)), True).cast("int")  # first difference from 1, 0 if none
    rest = lambda v, skip: F.slice(v, p + skip, F.greatest(F.size(v), F.lit(1)))
    return F.when(p == 0, F.lit(True)).when(F.size(x) == F.size(y), rest(x, 1) == rest(y, 1)).when(F.size(x) == F.size(y) + 1, rest(x, 1) == rest(y, 0)).when(F.size(y) == F.size(x) + 1, rest(y, 1) == rest(x, 0)).otherwise(False)


def dropped_lines(docs: DataFrame, work: Workspace) -> DataFrame:
    """doc, row, exact and near: the marks of the lines that go, by reason, of each row that loses lines."""
    places = work.store(line_table(docs), "places")
    place = _place(F.col("doc"), F.col("row"), F.col("line_no"))
    distinct = places.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("rows"))
    distinct = work.store(distinct, "distinct")
    near = work.store(near_lines(docs, places, distinct, work), "near")
    work.keep_only(places, distinct, near)
    marked = distinct.select("k1", "k2", "first", "rows").join(near.withColumn("near", F.lit(True)), ["k1", "k2"], "left").where("rows > 1 or near").drop("rows")
    gone = places.select("doc", "row", "line_no", "k1", "k2").join(marked, ["k1", "k2"]).where(F.coalesce("near", F.lit(False)) | (place != F.col("first")))
    mark, near = _mark(F.col("line_no"), F.col("k1")), F.coalesce("near", F.lit(False))
    return gone.groupBy("doc", "row").agg(F.collect_set(F.when(~near, mark)).alias("exact"), F.collect_set(F.when(near, mark)).alias("near"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Documents with all their columns, text without the lines that go; n_lines, n_exact and n_near are added as struct _lines."""
    work = Workspace(docs.sparkSession, "line-dedup")
    gone = work.store(dropped_lines(docs.select("doc_id", "text"), work), "gone")
    work.keep_only(gone)
    lines_gone = gone.agg(F.coalesce(F.sum(F.size("exact") + F.size("near")), F.lit(0))).first()[0]
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("of"), "doc_id", "text")
    met = own.join(_to_all(gone, lines_gone), F.col("doc_id").cast("long").eqNullSafe(F.col("doc")) & (_row() == F.col("row")), "left")
    none = F.array().cast("array<bigint>")
    out = met.select("of", "text", F.coalesce("exact", none).alias("exact"), F.coalesce("near", none).alias("near"))
    marks = F.array_union("exact", "near")
    lines = F.split("text", "\n")
    normal = F.split(_plain(F.col("text")), "\n")
    # both are cut at the same line ends, so the lines pair up
    pairs = F.filter(F.transform(F.arrays_zip(lines.alias("line"), normal.alias("norm")), lambda p, i: F.struct(p["line"].alias("line"), _mark(i, F.xxhash64(F.trim(p["norm"]))).alias("mark"))), lambda p: ~F.array_contains(marks, p["mark"]))
    text = F.when((F.size("exact") == 0) & (F.size("near") == 0), F.col("text")).otherwise(F.concat_ws("\n", F.transform(pairs, lambda p: p["line"])))
    counts = F.struct(F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.size("exact").alias("n_exact"), F.size("near").alias("n_near"))
    out = out.select("of", text.alias("text"), counts.alias("counts"))
    return out.select(*(F.col("text") if c == "text" else F.col("of")[c].alias(c) for c in docs.columns if c != "_lines"), F.col("counts").alias("_lines"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, text without the lines that go, n_lines, n_exact, n_near."""
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", "_lines.n_lines", "_lines.n_exact", "_lines.n_near")
