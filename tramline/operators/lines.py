"""Lines, and edges of graphs, put together at the places where exactly two of them end."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.operators.chains import joined_points, ranked
from tramline.plans.stages import release

#: A group of no more parts than this is put together within its row, a larger one in rounds of joins.
FEW_PARTS = 64
CHAINS = T.ArrayType(T.StructType().add("least", "integer").add("steps", T.ArrayType(T.StructType().add("nth", "integer").add("back", "boolean"))))


def chained(parts: DataFrame, store, stay: DataFrame | None = None) -> DataFrame:
    """g, part, chain, nth, back of parts (g, part, first, last): where each stands in its chain, and whether it is run from last to first.

    Parts join at a place where two ends of the same g meet and no third, but
    at none of stay (g, at).  A chain is named by its smallest part and runs in
    that one's direction; a ring begins with it.  A part closed in itself is a
    chain of its own, and both its ends count.  Ends are counted, not listed,
    so any number of them may meet in a place.
    """
    closed = F.col("first") == F.col("last")
    ends = parts.select("g", "part", F.posexplode(F.array("first", "last")).alias("end", "at"), closed.alias("closed"))
    meet = ends.groupBy("g", "at").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("part", "end")).alias("a"), F.max(F.struct("part", "end")).alias("b"), F.bool_or("closed").alias("closed"))
    meet = meet.where("n = 2 and not closed")
    meet = meet if stay is None else meet.join(stay, ["g", "at"], "left_anti")
    # who arrives at a's end leaves by b's: forward from its first point, backward from its last
    dart = lambda x, backward: F.struct("g", x["part"].alias("part"), backward.alias("back"))
    arrives, leaves = lambda x: dart(x, x["end"] == 0), lambda x: dart(x, x["end"] == 1)
    a, b = F.col("a"), F.col("b")
    steps = meet.select(F.explode(F.array(F.struct(arrives(a).alias("id"), leaves(b).alias("next")), F.struct(arrives(b).alias("id"), leaves(a).alias("next")))).alias("s")).select("s.*")
    steps = store(steps)
    # both ways along every part that joins another
    met = steps.select("id.g", "id.part").unionByName(steps.select("next.g", "next.part")).distinct()
    darts = met.select(F.explode(F.array(F.struct("g", "part", F.lit(False).alias("back")), F.struct("g", "part", F.lit(True).alias("back")))).alias("id"))
    order = store(ranked(darts.join(steps, "id", "left"), store))
    least = order.groupBy("last").agg(F.min(F.struct("id.part", "id.back")).alias("least")).where("not least.back")  # the others are the same chains the other way round
    on = order.join(least, "last").select("id.g", "id.part", F.col("least.part").alias("chain"), (-F.col("left")).alias("nth"), "id.back")
    alone = parts.join(met, ["g", "part"], "left_anti").select("g", "part", F.col("part").alias("chain"), F.lit(0).cast("long").alias("nth"), F.lit(False).alias("back"))
    return on.unionByName(alone)


def chains_of(ends: list) -> list[dict]:
    """The chains of a few parts (first, last; in order of their numbers) as chained makes them: the place of each one's smallest part, and its parts in order."""
    at = lambda p: p if p is None else tuple("nan" if x != x else x for x in p)
    ends = [(at(first), at(last)) for first, last in ends]
    closed = [None if None in pair else pair[0] == pair[1] for pair in ends]
    meet: dict = {}
    for i, pair in enumerate(ends):
        for end in (0, 1):
            meet.setdefault(pair[end], []).append((i, end))
    other = {}
    for met in meet.values():
        kinds = [closed[i] for i, _ in met]
        if len(met) == 2 and True not in kinds and False in kinds:
            other[met[0]], other[met[1]] = met[1], met[0]
    out, done = [], set()
    for least in range(len(ends)):
        if least in done:
            continue
        start = (least, 0)  # the end that a part is entered by
        while (before := other.get(start)) is not None:
            start = (before[0], 1 - before[1])
            if start[0] == least:
                break
        steps, now = [], start
        while now is not None and now[0] not in done:
            done.add(now[0])
            steps.append({"nth": now[0], "back": now[1] == 1})
            now = other.get((now[0], 1 - now[1]))
        out.append({"least": least, "steps": steps})
    return out


@F.arrow_udf(CHAINS)
def _chains(ends: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("least", pa.int32()), ("steps", pa.list_(pa.struct([("nth", pa.int32()), ("back", pa.bool_())])))]))
    return pa.array([chains_of(e) for e in ends.to_pylist()], kind)


def _merged_few(kept: DataFrame, by: list[str]) -> DataFrame:
    """by, part, line of groups that each fit a row."""
    place = lambda p: F.when(p.isNotNull(), F.array(p["lon"], p["lat"]))
    ends = lambda x: F.array(place(F.get(x["line"], F.lit(0))), place(F.get(x["line"], F.size(x["line"]) - 1)))
    groups = kept.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("part", "line"))).alias("p"))
    each = groups.withColumn("c", _chains(F.transform("p", ends))).select(*by, "p", F.explode("c").alias("c"))
    line = lambda s: F.when(s["back"], F.reverse(F.get("p", s["nth"])["line"])).otherwise(F.get("p", s["nth"])["line"])
    return each.select(*by, F.get("p", F.col("c.least"))["part"].alias("part"), joined_points(F.transform("c.steps", line)).alias("line"))


def _merged_many(kept: DataFrame, by: list[str], store) -> DataFrame:
    """by, part, line of groups (g) of any size."""
    order = chained(kept.select("g", "part", F.get("line", F.lit(0)).alias("first"), F.get("line", F.size("line") - 1).alias("last")), store)
    line = F.when(F.col("back"), F.reverse("line")).otherwise(F.col("line"))
    chains = order.join(kept.select("g", "part", "line"), ["g", "part"]).groupBy("g", "chain").agg(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))).alias("parts"))
    return chains.select(*(F.col("g")[c].alias(c) for c in by), F.col("chain").alias("part"), joined_points(F.transform("parts", lambda p: p["line"])).alias("line"))


def merge_lines(lines: DataFrame, by: list[str], store) -> DataFrame:
    """by, part, line of lines (by, part, line), part a number of its own within by: chains as long as they come, of lines in any order and direction.

    Places are equal if their coordinates are.  A merged line carries its
    smallest part; lines of fewer than two points are left out.  See chained.
    Groups of a few parts move once; only larger ones take part in the rounds.
    """
    group = F.struct(*by) if by else F.lit(0)
    kept = lines.where(F.size("line") >= 2).select(*by, "part", "line")
    sizes = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW_PARTS)
    large = store(sizes.select(group.alias("g")))
    if not large.limit(1).count():
        release(large)
        return _merged_few(kept, by)
    kept = kept.withColumn("g", group)
    return _merged_few(kept.join(large, "g", "left_anti"), by).unionByName(_merged_many(kept.join(large, "g", "left_semi"), by, store))
