"""Spelling variants: words one edit apart, and the form each is a variant of.

Words are counted within each task and summed by Spark.  Two words of edit
distance 1 differ in at most two bigrams of each, and the bigrams they share
stand in the same order in both.  So of the three rarest bigrams of a word, in
one order over all words (frequency, then bigram, then position), at least one
is shared and is among the three rarest of the other word too, at the same
position or, behind an inserted code point, one further.  (Frequencies are
those of the bigrams; counted by position as well, the order would change with
the shift.)  Words meet in a hash join on (bigram, position, length); what
meets is told apart by the sets of its letters and bigrams, kept as bits, and
then by the edit distance.  No list of words that share a bigram is made.

Forms lead from word to word of at least ``RATIO`` times the count, so chains
are short; they are followed by doubling, each round stored.

Defined cases: a null text has no words; a null doc_id stands as an empty
string before the colon; repeated rows count each; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import Workspace, load, text_or_empty, trimmed

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: One run in so many, by its checksum, loses a code point.
TYPO = 199
#: Code points and occurrences of a word, and how many times as frequent its form is.
LEAST, OCCURRENCES, RATIO = 6, 5, 5
#: Bigrams joined on: one more than an edit can touch.
RARE = 3
#: Counts held by a task before it puts them out.
HELD = 200_000


def with_typo(doc_id: str, word: str) -> str:
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % TYPO:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def words_of(doc_id: int | None, text: str, typos: bool) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of a text; a word may come more than once."""
    given = "" if doc_id is None else str(doc_id)
    for run, n in Counter(RUN.findall(text)).items():
        word = run.lower() if run.isascii() else run.translate(LOWER)
        yield (with_typo(given, word) if typos else word), n


def vocabulary(docs: DataFrame, typos: bool = False, least: int = LEAST, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n): words of at least so many code points and occurrences in the texts of documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                for word, n in words_of(doc_id, text.as_py(), typos):
                    if len(word) >= least:
                        held[word] += n
            if len(held) >= HELD:
                yield out()
        yield out()

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(trimmed(run), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def _bit(code: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(code, F.lit(64)).cast("int"))


def rarest_bigrams(words: DataFrame, rare: int = RARE) -> DataFrame:
    """Words (word, n) with their length, their rarest bigrams and the sets of their letters and bigrams as bits.

    There are at most 90 * 90 bigrams of the letters that words consist of, so their counts are broadcast.
    """
    pos = F.sequence(F.lit(1), F.length("word") - 1)
    bigrams = words.where(F.length("word") > 1).select("word", "n", F.explode(pos).alias("pos")).withColumn("gram", F.expr("substring(word, pos, 2)"))
    counts = bigrams.groupBy("gram").agg(F.count("*").alias("freq"))
    return (
        bigrams.join(F.broadcast(counts), "gram")
        .groupBy("word", "n")
        .agg(
            F.slice(F.sort_array(F.collect_list(F.struct("freq", "gram", "pos"))), 1, rare).alias("rare"),
            F.bit_or(_bit(F.xxhash64("gram"))).alias("grams"),
            F.bit_or(_bit(F.ascii("gram")).bitwiseOR(_bit(F.ascii(F.expr("substring(gram, 2, 1)"))))).alias("letters"),
        )
        .withColumn("length", F.length("word"))
    )


def one_edit_pairs(rarest: DataFrame) -> DataFrame:
    """(a, b, a_n, b_n): each pair of words one edit apart, once, the shorter first or the smaller of equal length; of rarest_bigrams."""
    given = ["word", "n", "length", "letters", "grams"]
    each = rarest.select(*given, F.explode("rare").alias("r"))
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in given]
    at = lambda shift, more: F.xxhash64("r.gram", F.col("r.pos") + shift, F.col("length") + more)
    a = each.select(*side("a"), F.explode(F.array(at(0, 0), at(0, 1), at(1, 1))).alias("key"))
    b = each.select(*side("b"), at(0, 0).alias("key"))
    differ = lambda c: F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}")))
    near = (differ("letters") <= 2) & (differ("grams") <= 4) & ((F.col("a_length") < F.col("b_length")) | (F.col("a_word") < F.col("b_word")))
    met = a.join(b, "key").where(near & (F.levenshtein("a_word", "b_word", 1) == 1))
    return met.select(F.col("a_word").alias("a"), F.col("b_word").alias("b"), "a_n", "b_n").dropDuplicates(["a", "b"])


def follow(forms: DataFrame, work: Workspace) -> DataFrame:
    """(word, root) of forms (word, form): the last of each chain, by doubling."""
    now = work.store(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        last, now = now, work.store(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        work.drop(last)
        if not now.where("moved").limit(1).count():
            return now.drop("moved")


def variants(docs: DataFrame, typos: bool = False, least: int = LEAST, occurrences: int = OCCURRENCES, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of documents (doc_id, text); an edit is told by three bigrams, so least is 4 or more."""
    if least < RARE + 1:
        raise ValueError("words need three bigrams")
    work = Workspace(docs.sparkSession, "spelling")
    words = work.store(vocabulary(docs, typos, least, occurrences), "words")
    rarest = work.store(rarest_bigrams(words), "rarest")
    pairs = work.store(one_edit_pairs(rarest), "pairs")
    work.drop(rarest)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m")))).alias("p")).select("p.*")
    first = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("first"))
    known = words.join(first, "word", "left").withColumn("of", F.when(-F.col("first.less") >= ratio * F.col("n"), F.col("first")))
    known = work.store(known.select("word", F.col("of.other").alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("of.less")).alias("form_n")), "forms")
    work.drop(words, pairs)
    roots = follow(known.where(F.col("form").isNotNull()), work)
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all whole documents, one occurrence in some two hundred misspelt, with their forms and roots."""
    return variants(load(spark, sf_dir, "documents", "doc_id", "text"), typos=True)
