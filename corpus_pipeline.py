"""From documents to packed training windows, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns what it keeps, with the columns of documents, all but the last.
``run`` writes each stage's result as Parquet into the shared folder and hands
it, reread, to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import Workspace, load
from tramline.llm.decontaminate import drop_contaminated
from tramline.llm.linededup import dedup_lines
from tramline.llm.ngram_join import first_of_groups
from tramline.llm.packing import pack_documents
from tramline.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels table, accepts and does not find toxic."""
    return keep_good(docs, load(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stood, or nearly stood, at an earlier place; n_chars follows the text.

    A document that had words and has lost all of them goes.
    """
    words = F.col("text").rlike("[^ \\t\\n\\x0B\\f\\r]")
    out = dedup_lines(docs)
    lost = (F.col("_lines.n_exact") + F.col("_lines.n_near")) > 0
    out = out.where(~lost | words).withColumn("n_chars", F.when(lost, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop("_lines")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 5-word shingles at 0.75, the one with the smallest doc_id."""
    return first_of_groups(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of the benchmark table is found."""
    return drop_contaminated(docs, load(spark, sf_dir, "benchmark", "item_id", "text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, dealt to windows of 2048 ids."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: SQL cannot express the trained and the packing stage; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the packed pieces."""
    work = Workspace(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
