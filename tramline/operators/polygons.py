"""Union of polygons that share borders: what two of them share goes, what is left is traced to rings."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.geo import bound
from tramline.operators.chains import joined_points, ranked


def _steps(ring: Column) -> tuple[Column, Column]:
    """The points that a ring's borders start from, and those that they lead to."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.slice(ring, 1, n), F.slice(ring, 2, n)


def signed_area(ring: Column) -> Column:
    """Twice the area within a closed ring on the plane of its coordinates, positive if it runs anticlockwise."""
    return bound(ring, lambda r: F.when(F.size(r) >= 3, bound(F.get(r, F.lit(0)), lambda first: _area_from(r, first))).otherwise(F.lit(0.0)))


def _area_from(ring: Column, first: Column) -> Column:
    steps = F.zip_with(*_steps(ring), lambda a, b: (a["lon"] - first["lon"]) * (b["lat"] - first["lat"]) - (b["lon"] - first["lon"]) * (a["lat"] - first["lat"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def valid_ring(ring: Column) -> Column:
    """A closed ring without points that repeat the one before; null if it encloses nothing."""
    apart = lambda r: F.filter(r, lambda p, i: (i == 0) | (p != F.get(r, i - 1)))
    closed = lambda keep: F.when(F.get(keep, F.lit(0)) == F.get(keep, F.size(keep) - 1), keep).otherwise(F.concat(keep, F.slice(keep, 1, 1)))
    whole = lambda r: bound(bound(apart(r), closed), lambda c: F.when((F.size(r) >= 3) & (F.size(c) >= 4) & (signed_area(c) != 0), c))
    return bound(ring, whole)


def union_polygons(rings: DataFrame, by: list[str], store) -> DataFrame:
    """by, outer, ring of the union within by of rings (by, polygon, nth, ring); nth 0 is a polygon's outer ring, others are its holes.

    All rings are turned to have the inside on their left.  A border between
    two polygons is then run both ways and goes; one run twice the same way is
    kept once.  What is left is traced, at places where several rings touch by
    the next border clockwise, so that rings touch but do not cross.  Outer
    rings run anticlockwise, holes clockwise, each from its smallest point on;
    corners on a straight border stay.

    Borders are shared where their corners are equal, as in official maps;
    polygons that overlap otherwise keep both their outlines.  Rings that
    enclose nothing are left out.  Long stretches of one input ring are moved
    as one, so the rounds of tracing see stretches, not corners.
    """
    group = F.struct(*by) if by else F.lit(0)
    # exploded, so that each ring is worked on once, not again for the filter
    whole = F.explode(F.filter(F.array(valid_ring(F.col("ring"))), lambda r: r.isNotNull()))
    fine = rings.select(group.alias("g"), F.struct("polygon", "nth").alias("of"), (F.col("nth") == 0).alias("outer"), whole.alias("ring"))
    turned = bound(F.col("ring"), lambda r: F.when((signed_area(r) > 0) == F.col("outer"), r).otherwise(F.reverse(r)))
    fine = fine.select("g", "of", turned.alias("ring"))
    pairs = bound(F.col("ring"), lambda r: F.zip_with(*_steps(r), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    edges = fine.select("g", "of", F.posexplode(pairs).alias("nth", "e")).select("g", F.struct("of", "nth").alias("id"), "e.a", "e.b")
    up = F.col("a") < F.col("b")
    net = edges.groupBy("g", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.sum(F.when(up, 1).otherwise(-1)).alias("net"), F.min(F.when(up, F.col("id"))).alias("ups"), F.min(F.when(~up, F.col("id"))).alias("downs"))
    net = net.where("net != 0")
    ahead = F.col("net") > 0
    left = store(net.select("g", F.when(ahead, F.col("ups")).otherwise(F.col("downs")).alias("id"), F.when(ahead, F.col("lo")).otherwise(F.col("hi")).alias("a"), F.when(ahead, F.col("hi")).otherwise(F.col("lo")).alias("b")))
    # around each corner, clockwise: what arrives goes on with what leaves next
    angle = lambda p, q: F.atan2(q["lat"] - p["lat"], q["lon"] - p["lon"])
    end = lambda at, other, leaves: left.select("g", F.col(at).alias("at"), F.col(other).alias("other"), "id", F.lit(leaves).alias("leaves"), angle(F.col(at), F.col(other)).alias("angle"))
    around = Window.partitionBy("g", "at").orderBy(F.desc("angle"), "leaves", "id")
    out = F.when(F.col("leaves"), F.col("id"))
    turn = F.coalesce(F.first(out, ignorenulls=True).over(around.rowsBetween(1, Window.unboundedFollowing)), F.first(out, ignorenulls=True).over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = end("b", "a", False).unionByName(end("a", "b", True)).withColumn("next", turn).where("not leaves")
    rows = rows.select("g", "id.of", "id.nth", F.col("other").alias("a"), F.col("at").alias("b"), "next")
    # stretches: a border that the next one of the same input ring follows is one with it
    along = Window.partitionBy("g", "of").orderBy("nth")
    rows = rows.withColumn("_begins", F.coalesce(F.lag("next").over(along) != F.struct("of", "nth"), F.lit(True)))
    rows = rows.withColumn("start", F.last(F.when(F.col("_begins"), F.col("nth")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ways = rows.groupBy("g", "of", "start").agg(F.array_sort(F.collect_list(F.struct("nth", "a", "b"))).alias("way"), F.max(F.struct("nth", "next"))["next"].alias("next"))
    points = F.concat(F.slice(F.transform("way", lambda w: w["a"]), 1, 1), F.transform("way", lambda w: w["b"]))
    stretches = store(ways.select("g", F.struct("of", F.col("start").alias("nth")).alias("stretch"), points.alias("points"), "next"))
    # most are rings of their own, which need no order
    alone = F.coalesce(F.col("next") == F.col("stretch"), F.lit(False))
    parts = stretches.where(~alone)
    name = lambda c: F.struct("g", F.col(c).alias("of"))
    order = ranked(parts.select(name("stretch").alias("id"), F.when(F.col("next").isNotNull(), name("next")).alias("next")), store)
    traced = order.join(parts.select(name("stretch").alias("id"), "points"), "id")
    traced = traced.groupBy("id.g", "last").agg(F.array_sort(F.collect_list(F.struct((-F.col("left")).alias("nth"), "points"))).alias("parts"))
    traced = traced.select("g", joined_points(F.transform("parts", lambda p: p["points"])).alias("ring"))
    traced = traced.unionByName(stretches.where(alone).select("g", F.col("points").alias("ring"))).select("g", from_smallest(F.col("ring")).alias("ring"))
    return traced.select(*(F.col("g")[c].alias(c) for c in by), (signed_area(F.col("ring")) > 0).alias("outer"), "ring")


def from_smallest(ring: Column) -> Column:
    """A closed ring turned to begin, and end, at its smallest point."""

    def turned(points: Column, at: Column) -> Column:
        return F.concat(F.slice(points, at, F.size(points) - at + 1), F.slice(points, 1, at - 1))

    def whole(points: Column) -> Column:
        return bound(F.array_position(points, F.array_min(points)).cast("int"), lambda at: F.concat(turned(points, at), F.slice(points, at, F.lit(1))))

    return bound(bound(ring, lambda r: F.slice(r, 1, F.size(r) - 1)), whole)


def sphere_area_m2(ring: Column, radius: float = 6371008.8) -> Column:
    """Area within a ring on the sphere, positive if it runs anticlockwise."""
    parts = F.zip_with(*_steps(ring), lambda a, b: F.radians(b["lon"] - a["lon"]) * (2 + F.sin(F.radians(a["lat"])) + F.sin(F.radians(b["lat"]))))
    return -F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) * (radius * radius / 2)


def polygon_areas(union: DataFrame, by: list[str]) -> DataFrame:
    """by, area_m2 and numbers of outer rings, holes and corners of a union."""
    return union.groupBy(*by).agg(F.sum(sphere_area_m2(F.col("ring"))).alias("area_m2"), F.count_if("outer").alias("outer_rings"), F.count_if(~F.col("outer")).alias("holes"), F.sum(F.size("ring") - 1).alias("corners"))
