"""Changes to snapshot tables as functions from frames to frames, and their publication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States from which a snapshot may go live.
READY = ("metrics_ready", "routing_ready", "imported", "normalized")


def first_wins(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row a key, the first by order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def insert_new(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Rows of new whose key old lacks, first ones win, added to old."""
    return old.unionByName(first_wins(new, keys, order).join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of old with their key; new has one row a key."""
    kept = old.join(new.select(*keys), keys, "left_anti")
    return kept.unionByName(new.select(*old.columns))


def replace_source(old: DataFrame, new: DataFrame, keys: list[str], source: str, now: Column) -> DataFrame:
    """Upsert that marks rows of the sources in new which new lacks as deleted, and revives those it has."""
    out = upsert(old, new.withColumn("deleted_at", F.lit(None).cast("timestamp")), keys)
    have = new.select(*keys).withColumn("_have", F.lit(True))
    sources = new.select(source).distinct().withColumn("_source", F.lit(True))
    gone = F.coalesce("_source", F.lit(False)) & F.col("_have").isNull() & F.col("deleted_at").isNull()
    joined = out.join(have, keys, "left").join(sources, source, "left")
    return joined.withColumn("deleted_at", F.when(gone, now).otherwise(F.col("deleted_at"))).select(*old.columns)


def drop_sources(old: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """Old rows of sources that new does not bring."""
    return old.join(new.select(source).distinct(), source, "left_anti")


def patch(df: DataFrame, key: Column, values: dict, clearable: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a key with new values: a clearable column takes null, any other keeps its own then; absent ones stay."""
    changed = {c: F.when(key, F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items() if v is not None or c in clearable}
    return df.withColumns(changed)


def soft_delete(df: DataFrame, key: Column, now: Column) -> DataFrame:
    return df.withColumn("deleted_at", F.when(key & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at")))


def activate(control: DataFrame, snapshot: str) -> DataFrame:
    """The control table with one snapshot live and the one before archived; raises if it is missing or not ready."""
    row = control.where(F.col("public_id") == snapshot).select("status").first()
    if row is None:
        raise LookupError(f"no snapshot {snapshot}")
    if row.status not in READY:
        raise ValueError(f"snapshot {snapshot} is {row.status}")
    return set_active(control, F.col("public_id") == snapshot)


def set_active(control: DataFrame, chosen: Column) -> DataFrame:
    status = F.when(chosen, "active").when(F.col("status") == "active", "archived").otherwise(F.col("status"))
    return control.withColumns({"status": status, "is_active": chosen})


def supersede_runs(runs: DataFrame, run: str, now: Column) -> DataFrame:
    """Other runs still running become failed."""
    stale = (F.col("status") == "running") & (F.col("id") != run)
    return runs.withColumns({"status": F.when(stale, "failed").otherwise(F.col("status")), "completed_at": F.when(stale, now).otherwise(F.col("completed_at"))})


def merged_report(old: Column, new: Column) -> Column:
    """Two maps as one, keys of the second win."""
    keep = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return F.map_concat(F.coalesce(keep, F.create_map().cast("map<string,string>")), new)


def write_snapshot(tables: dict[str, DataFrame], base: str, snapshot: str) -> None:
    """Each table under base, its partition of that snapshot replaced as a whole; the control row is published after."""
    for name, df in tables.items():
        df.withColumn("snapshot_id", F.lit(snapshot)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(f"{base}/{name}")


def write_samples(samples: DataFrame, path: str) -> None:
    samples.write.mode("overwrite").json(path, compression="gzip")


def counts_by(df: DataFrame, columns: list[str]) -> DataFrame:
    """kind, value and n: how often each value of each column occurs, null as ``unknown``; one pass over df."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in columns)))
    return df.select(pairs.alias("p")).groupBy("p.kind", "p.value").agg(F.count(F.lit(1)).alias("n"))


def gates(checks: dict[str, Column], df: DataFrame) -> dict[str, bool]:
    """Whether each condition over all rows holds, in one pass."""
    row = df.agg(*(F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items())).first()
    return row.asDict()


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
