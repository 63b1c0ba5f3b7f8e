"""Points by the thousand in one place, and feeds written by many tasks."""

import zipfile

from pyspark.sql import functions as F

from tramline.functions.geo import haversine_m
from tramline.operators import rail
from tramline.plans import feeds


def test_copies_in_one_place_do_not_multiply(spark):
    # all pairs of these are 10 billion, which nothing here could look at
    place = lambda n: spark.range(n).select("id", F.lit(9.0).alias("lon"), F.lit(53.0).alias("lat"))
    got = rail.nearest_within(place(100_000).withColumnRenamed("id", "a"), place(100_000).withColumnRenamed("id", "b"), 100.0, 0.1, 3, "a", "b")
    n = got.groupBy("rank", "b").agg(F.count(F.lit(1)).alias("n"), F.max("distance_m").alias("d")).collect()
    assert sorted((r["rank"], r["b"], r["n"], r["d"]) for r in n) == [(i + 1, i, 100_000, 0.0) for i in range(3)]


def test_nearest_equals_all_pairs(spark):
    at = lambda name, n, k: spark.range(n).select((F.col("id") % (n - 2)).alias(name), (9 + F.col("id") * k % 7 / 20.0).alias("lon"), F.when(F.col("id") != 5, 53 + F.col("id") * k % 5 / 30.0).alias("lat"))
    left, right = at("a", 60, 3), at("b", 40, 2)
    got = rail.nearest_within(left, right, 6000.0, 0.1, 3, "a", "b")
    pairs = left.crossJoin(right.select("b", F.col("lon").alias("x"), F.col("lat").alias("y"))).select("a", "b", haversine_m(F.col("lon"), F.col("lat"), F.col("x"), F.col("y")).alias("d")).where("d <= 6000").collect()
    wanted = []
    for a in {p.a for p in pairs}:
        wanted += [(a, i + 1, b, d) for i, (d, b) in enumerate(sorted((p.d, p.b) for p in pairs if p.a == a)[:3])]
    assert wanted and sorted((r.a, r["rank"], r.b, r.distance_m) for r in got.collect()) == sorted(wanted)


def test_members_of_a_feed_come_from_many_tasks(spark, monkeypatch):
    rows = spark.range(20).select(F.col("id").cast("string").alias("stop_id"), F.lit('a "b", c').alias("stop_name")).repartition(4)
    monkeypatch.setattr(feeds, "feed", lambda spark, d: {"stops": rows, "agency": rows.limit(0)})
    archive = feeds.written_archive(spark, "")
    with zipfile.ZipFile(archive) as z:
        assert not any(n.endswith("agency.txt") for n in z.namelist())
        lines = z.read("inner/stops.txt").decode().splitlines()
    assert lines[0] == "stop_id,stop_name" and sorted(lines[1:]) == sorted(f'{i},"a ""b"", c"' for i in range(20))
    import glob
    import os

    assert len(glob.glob(f"{os.path.dirname(archive)}/stops/part-*.csv")) == 4
