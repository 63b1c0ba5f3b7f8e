"""Order along chains and rings of rows that each name their next one, by doubling.

Every round each row learns what the row it points to knows, and points twice
as far: the number of rounds is the logarithm of the longest chain, and each
round is one join on ids, stored, whatever the shape of the chains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.plans.stages import release


def _double(links: DataFrame, store) -> DataFrame:
    """id, to, steps, low, open of links (id, next), once every row of a chain points to its end and every row of a ring knows its smallest id; the latter stay open."""
    first = links.select(
        "id",
        F.coalesce("next", "id").alias("to"),
        F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("steps"),
        F.col("id").alias("low"),
        F.col("next").isNotNull().alias("open"),
    )
    now = store(first)
    while True:
        ahead = now.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"), F.col("low").alias("_low"), F.col("open").alias("_open"))
        going, still = now.where("open").join(ahead, "to"), now.where("not open").withColumn("moved", F.lit(False))
        low = F.least("low", "_low")
        after = going.select("id", F.col("_to").alias("to"), (F.col("steps") + F.col("_steps")).alias("steps"), low.alias("low"), F.col("_open").alias("open"), (~F.col("_open") | (low != F.col("low"))).alias("moved"))
        last, now = now, store(still.unionByName(after))
        release(last)
        if not now.where("moved").limit(1).count():
            return now.drop("moved")


def ranked(links: DataFrame, store) -> DataFrame:
    """id, last, left, ring of links (id, next): the end of each row's chain and the steps to it; a ring begins at its smallest id.

    Each id is the next of one row at most.  store(df) writes a frame and
    returns it reread.
    """
    known = _double(links, store)
    rings = known.where("open").select("id", F.col("low").alias("_low"))
    ends = known.where("not open").select("id", F.col("to").alias("last"), F.col("steps").alias("left"), F.lit(False).alias("ring"))
    if not rings.limit(1).count():
        return ends
    cut = links.join(rings, "id").select("id", F.when(F.col("next") != F.col("_low"), F.col("next")).alias("next"))
    cut = _double(cut, store).select("id", F.col("to").alias("last"), F.col("steps").alias("left"), F.lit(True).alias("ring"))
    return ends.unionByName(cut)


def joined_points(parts: Column) -> Column:
    """One line of lines that each begin where the one before ends."""
    return F.flatten(F.transform(parts, lambda line, i: F.when(i == 0, line).otherwise(F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))))))
