"""Travel-time statistics over departure samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least reachable shares at which median and ninetieth percentile are published.
MEDIAN_RATIO, P90_RATIO = 0.5, 0.9


def nearest_rank(column: str | Column, q: float) -> Column:
    """The value at rank ceil(q * n) of the non-null values."""
    if not 0 < q <= 1:
        raise ValueError("q lies in (0, 1]")
    col = F.col(column) if isinstance(column, str) else column
    return F.element_at(F.array_sort(F.collect_list(col)), F.greatest(F.ceil(F.count(col) * F.lit(q)).cast("int"), F.lit(1)))


def travel_time_statistics(samples: DataFrame, keys: list[str], gate_median: bool = True) -> DataFrame:
    """Counts, ratio, times, transfers and waits per key.

    samples: requested_s, first_departure_s, arrival_s, transfers, direct,
    initial_wait_s, walk_s, in_vehicle_s.  A sample is reachable if its total is
    there and not negative; without samples the ratio is 0.  The median is null
    below a reachable share of 0.5 (with gate_median), the ninetieth percentile
    below 0.9.  Averages of the parts are over samples with an arrival.
    """
    total = F.col("arrival_s") - F.col("requested_s")
    ok = F.when(total >= 0, total)
    arrived = lambda c: F.avg(F.when(total.isNotNull(), F.col(c).cast("double")))
    out = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count(ok).alias("reachable_count"),
        F.min(ok).alias("fastest_s"),
        F.max(ok).alias("slowest_s"),
        F.avg(ok).alias("average_s"),
        F.median(ok).alias("median_s"),
        F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY CASE WHEN arrival_s - requested_s >= 0 THEN arrival_s - requested_s END)").alias("p90_s"),
        arrived("transfers").alias("average_transfers"),
        F.min(F.when(total.isNotNull(), F.col("transfers"))).alias("min_transfers"),
        F.avg(F.when(total.isNotNull(), F.col("direct").cast("int").cast("double"))).alias("direct_ratio"),
        arrived("initial_wait_s").alias("average_wait_s"),
        arrived("walk_s").alias("average_walk_s"),
        arrived("in_vehicle_s").alias("average_in_vehicle_s"),
        F.min("first_departure_s").alias("first_departure_s"),
        F.max("first_departure_s").alias("last_departure_s"),
    )
    ratio = F.col("reachable_count") / F.greatest(F.col("sample_count"), F.lit(1))
    out = out.withColumn("reachable_ratio", ratio)
    publish_median = F.col("reachable_ratio") >= MEDIAN_RATIO
    publish_p90 = F.col("reachable_ratio") >= P90_RATIO
    return out.withColumns(
        {
            "median_publishable": publish_median,
            "p90_publishable": publish_p90,
            "median_s": F.when(publish_median, F.col("median_s")) if gate_median else F.col("median_s"),
            "p90_s": F.when(publish_p90, F.col("p90_s")),
        }
    )


def best_per_place(arrivals: DataFrame, max_seconds: int | None = None) -> DataFrame:
    """sample, place, seconds, legs, stop: of each sample and place the fastest arrival, the first of equal ones.

    arrivals: sample, place, stop, seconds, legs, position.
    """
    rows = arrivals.where("place is not null and seconds is not null")
    if max_seconds is not None:
        rows = rows.where(F.col("seconds") <= max_seconds)
    best = rows.groupBy("sample", "place").agg(F.min(F.struct("seconds", "position", "legs", "stop")).alias("b"))
    return best.select("sample", "place", "b.seconds", "b.legs", "b.stop")


def widest_gap(times: DataFrame, keys: list[str], at: str) -> DataFrame:
    """keys, max_gap: the longest step between neighbouring times; null with fewer than two."""
    step = F.col(at) - F.lag(at).over(Window.partitionBy(*keys).orderBy(at))
    return times.withColumn("_step", step).groupBy(*keys).agg(F.max("_step").alias("max_gap"))


def service_summary(targets: DataFrame, best: DataFrame, sample_count: int) -> DataFrame:
    """A row for each target place, reached or not: counts, fastest, first and last sample, widest gap, fewest transfers."""
    step = F.col("sample") - F.lag("sample").over(Window.partitionBy("place").orderBy("sample"))
    transfers = F.greatest(F.col("legs") - 1, F.lit(0))
    found = best.withColumn("_step", step).groupBy("place").agg(
        F.count(F.lit(1)).alias("reachable_count"),
        F.min("seconds").alias("fastest_s"),
        F.avg("seconds").alias("average_s"),
        F.median("seconds").alias("median_s"),
        F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY seconds)").alias("p90_s"),
        F.min("sample").alias("first_sample"),
        F.max("sample").alias("last_sample"),
        F.max("_step").alias("max_gap"),
        F.min(transfers).alias("min_transfers"),
        F.count_if(transfers == 0).alias("direct_count"),
    )
    out = targets.select("place").distinct().join(found, "place", "left").withColumns({"reachable_count": F.coalesce("reachable_count", F.lit(0)), "direct_count": F.coalesce("direct_count", F.lit(0)), "sample_count": F.lit(sample_count)})
    ratio = F.col("reachable_count") / F.greatest(F.col("sample_count"), F.lit(1))
    return out.withColumn("reachable_ratio", ratio).withColumns({"median_s": F.when(ratio >= MEDIAN_RATIO, F.col("median_s")), "p90_s": F.when(ratio >= P90_RATIO, F.col("p90_s"))})
