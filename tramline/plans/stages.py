"""Stored intermediates for iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, with its scheme; on one machine without a cluster, one of our own where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _OWN[:] = _OWN or ["file://" + tempfile.mkdtemp(prefix="tramline-")]
        base = _OWN[0]
    return f"{qualified(spark, base)}/stages"


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme; one without is taken as Spark takes it, in its default file system."""
    if "://" not in path:
        given = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = given.getFileSystem(spark._jsc.hadoopConfiguration())
        path = given.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return path.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and reread."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Remove what stored wrote for these frames, once nothing that is still to run reads it."""
    for df in frames:
        if path := getattr(df, "_stored_at", None):
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
