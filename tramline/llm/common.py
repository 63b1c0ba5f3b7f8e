"""What the training-data operators share: reading tables, the shared folder, stored intermediates."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Batches for Python of at most 4 MB: long texts come in tens of thousands of bytes each."""
    if spark.conf.get("tramline.batches", "") != "bounded":
        spark.conf.set("tramline.batches", "bounded")
        spark.conf.set(BATCH_BYTES, str(4 << 20))


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; any further ones, whatever their names, are not read."""
    bound_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, with its scheme: spark.checkpoint.dir; on one machine without a cluster, one of our own where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN_DIR:
            _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="tramline-"))
        return _OWN_DIR[0]
    if "://" not in named:  # as Spark reads it: in its default file system
        path = spark._jvm.org.apache.hadoop.fs.Path(named)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        named = path.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()
    if named.startswith("file:/") and not named.startswith("file://"):
        named = "file://" + named[5:]
    return named.rstrip("/")


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions the cluster asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Workspace:
    """Stored intermediate tables of one operator call.

    ``store`` writes a DataFrame as Parquet into the shared folder and returns
    it reread: its lineage ends there, so a lost executor costs a reread and
    not a recomputation.  ``drop`` removes tables that no later step reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        bound_batches(spark)
        self.spark = spark
        self.uri = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.serial = 0
        self.stored: list[str] = []

    def path(self, name: str) -> str:
        self.serial += 1
        return f"{self.uri}/{self.serial:03d}-{name}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tramline_path = path
        self.stored.append(path)
        return out

    def keep_only(self, *tables: DataFrame) -> None:
        """Remove all stored tables but these."""
        kept = {t._tramline_path for t in tables}
        for path in self.stored:
            if path not in kept:
                self.delete(path)
        self.stored = [p for p in self.stored if p in kept]

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.delete(getattr(t, "_tramline_path", None))

    def delete(self, path: str | None) -> None:
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI that executors write their own files to."""
    from pyarrow import fs

    if uri.startswith(("s3a://", "s3n://")):
        uri = "s3" + uri[3:]
    return fs.FileSystem.from_uri(uri)


def trim() -> None:
    """Give memory that Arrow and the C library hold but no longer use back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run):
    """A function over batches that trims its worker's memory after the last one: workers wait idle between stages."""

    def wrapped(batches):
        yield from run(batches)
        trim()

    return wrapped


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
