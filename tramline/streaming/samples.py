"""Streams of arrivals: first answers kept within a time, and counts by sample window."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh(stream: DataFrame, keys: list[str], at: str, ttl: str = "60 seconds") -> DataFrame:
    """The first row of each key within the time after it, as a cache with that time to live would answer."""
    return stream.withWatermark(at, ttl).dropDuplicatesWithinWatermark(keys)


def by_window(stream: DataFrame, keys: list[str], at: str, value: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Count, smallest and largest value per window and key; rows later than late are left out."""
    w = stream.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), *keys)
    out = w.agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "least", "most")


def minute_key(at, *parts):
    """The key of a cached answer: its parts and the minute asked for."""
    return F.concat_ws(":", *parts, F.date_format(F.date_trunc("minute", at), "yyyy-MM-dd'T'HH:mm"))


GAPS = "key string, n long, first_s long, last_s long, max_gap_s long"
GAP_STATE = "n long, first_s long, last_s long, max_gap_s long"


def gaps(stream: DataFrame, key: str, at: str, idle: str = "1 hour") -> DataFrame:
    """Per key, after each micro-batch that holds it: how many times so far, the first, the last and the widest gap between neighbours.

    Times of one key are taken in order within a batch; one that comes after a
    later one counts, and widens no gap.  State goes when a key has been idle
    for the time given, by the stream's watermark.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    limit_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def update(group, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        n, first, last, gap = state.get if state.exists else (0, None, None, None)
        seconds = sorted(int(x) for pdf in batches for x in pdf["_s"])
        for s in seconds:
            if last is not None and s >= last:
                gap = max(gap or 0, s - last)
            first, last, n = s if first is None else min(first, s), s if last is None else max(last, s), n + 1
        state.update((n, first, last, gap))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), last * 1000) + limit_ms)
        yield pd.DataFrame({"key": [group[0]], "n": [n], "first_s": [first], "last_s": [last], "max_gap_s": pd.array([gap], "Int64")})

    rows = stream.withWatermark(at, idle).select(F.col(key).cast("string").alias("key"), at, F.unix_seconds(F.col(at).cast("timestamp")).alias("_s"))
    return rows.groupBy("key").applyInPandasWithState(update, GAPS, GAP_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def log_samples(stream: DataFrame, folder: str, checkpoint: str):
    """Write a stream's samples as compressed JSON lines, a folder for each micro-batch, which a repeated batch writes anew; the query."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{folder}/batch={number}", compression="gzip")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(result: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a streaming frame over what is there now; its output as a table in memory."""
    query = result.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return result.sparkSession.table(name)
