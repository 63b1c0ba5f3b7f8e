"""Rail geometry: a graph from tracks, snapping of stops, components, shortest paths and match confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.geo import cell, haversine_m, line_length, mercator
from tramline.operators.lines import chained, merge_lines
from tramline.plans.stages import release, stored

#: Track kinds taken, service kinds made dear, and by how much.
RAILWAYS = ("rail", "light_rail", "subway", "tram")
SERVICE = ("yard", "siding", "spur", "crossover")
SERVICE_FACTOR = 8
SNAP_M, SNAP_DEGREES, SNAPS = 800.0, 0.01, 3
#: Where no node has more arcs than this, a stored round of the search follows four of them one after the other.
FEW_ARCS = 16
#: Named corridors as boxes (west, south, east, north).
CORRIDORS = {"hamburg-kiel": (9.55, 53.50, 10.45, 54.45), "hamburg-buechen": (9.85, 53.25, 10.95, 53.75)}


def box_of(bbox: str | None = None, corridor: str | None = None) -> tuple[float, ...] | None:
    """The box of ``west,south,east,north`` or of a corridor; not both."""
    if bbox and corridor:
        raise ValueError("either a box or a corridor, not both")
    if corridor:
        if corridor not in CORRIDORS:
            raise ValueError(f"unknown corridor {corridor}; known are {', '.join(sorted(CORRIDORS))}")
        return CORRIDORS[corridor]
    if not bbox:
        return None
    parts = tuple(float(x) for x in bbox.split(","))
    if len(parts) != 4:
        raise ValueError("a box is west,south,east,north")
    return parts


def meets_box(line: Column, box: tuple[float, ...]) -> Column:
    """Whether a line has a point in a box: a corner of it inside, or a step that crosses the box."""
    w, s, e, n = box

    def step(a: Column, b: Column) -> Column:
        # the part of the step, from 0 to 1, that lies between two parallel sides, for both axes
        lo, hi = F.lit(0.0), F.lit(1.0)
        out = F.lit(False)
        for c, low, high in (("lon", w, e), ("lat", s, n)):
            d = b[c] - a[c]
            out = out | ((d == 0) & ~a[c].between(low, high))
            t, u = (low - a[c]) / F.nullif(d, F.lit(0.0)), (high - a[c]) / F.nullif(d, F.lit(0.0))
            lo, hi = F.greatest(lo, F.least(t, u)), F.least(hi, F.greatest(t, u))
        return ~out & (lo <= hi)

    steps = F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line) - 1), step)
    return F.when(F.size(line) >= 2, F.exists(steps, lambda x: x)).otherwise(F.exists(line, lambda p: p["lon"].between(w, e) & p["lat"].between(s, n)))


def selected_patterns(patterns: DataFrame, routes: DataFrame, modes: list[str], labels: str | None = None, box: tuple[float, ...] | None = None) -> DataFrame:
    """Patterns (line) with their route's mode, of the modes, labels (comma-separated) and box wanted."""
    wanted = [x.strip() for x in (labels or "").split(",") if x.strip()]
    label = F.coalesce(F.nullif("short_name", F.lit("")), F.nullif("long_name", F.lit("")), "route_id")
    chosen = routes.where(F.col("mode").isin(modes) & (label.isin(wanted) if wanted else F.lit(True))).select("route_id", "mode")
    out = patterns.join(chosen, "route_id")
    return out.where(F.col("line").isNotNull() & meets_box(F.col("line"), box)) if box else out


def without(matches: DataFrame, patterns: DataFrame) -> DataFrame:
    """Matches but for those of the patterns that are to be matched anew."""
    return matches.join(patterns.select("pattern_id"), "pattern_id", "left_anti")


def way_parts(ways: DataFrame) -> DataFrame:
    """Ways (id, tags, parts: lines) with one row a line; parts that follow each other end to start are one."""

    def merge(done: Column, part: Column) -> Column:
        last = F.element_at(done, -1)
        follows = (F.size(done) > 0) & (F.element_at(last, -1) == F.element_at(part, 1))
        longer = F.concat(last, F.slice(part, 2, F.size(part) - 1))
        return F.when(F.coalesce(follows, F.lit(False)), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(part)))

    parts = F.filter("parts", lambda p: F.size(p) >= 2)
    kind = ways.schema["parts"].dataType.simpleString()
    merged = F.aggregate(parts, F.array().cast(kind), merge)
    return ways.withColumn("_m", merged).select(*(c for c in ways.columns if c != "parts"), F.posexplode("_m").alias("part", "line"))


def merged_ways(ways: DataFrame, store) -> DataFrame:
    """Ways (id, tags, parts: lines) with one row a line (id, tags, part, line); parts in any order and direction are one where they meet, see merge_lines."""
    each = ways.select("id", F.posexplode("parts").alias("part", "line"))
    return ways.select("id", "tags").join(merge_lines(each, ["id"], store), "id").select("id", "tags", "part", "line")


def rail_ways(ways: DataFrame) -> DataFrame:
    """Ways (id, tags map, line) that carry trains today, at least 10 m long."""
    tag = lambda k: F.coalesce(F.try_element_at("tags", F.lit(k)), F.lit(""))
    alive = F.lit(True)
    for k in ("abandoned", "construction", "disused", "razed"):
        alive = alive & (tag(k) == "")
    kept = ways.where(tag("railway").isin(*RAILWAYS) & alive & (F.size("line") >= 2))
    return kept.withColumns({"is_service": tag("service").isin(*SERVICE), "length_m": line_length(F.col("line"))}).where("length_m >= 10")


def node_key(point: Column) -> Column:
    return F.concat_ws(":", F.round(point["lon"], 7), F.round(point["lat"], 7))


def rail_edges(ways: DataFrame) -> DataFrame:
    """edge_id, source, target, length_m, cost, is_service, line; loops on one node are left out."""
    out = ways.select(F.col("id").alias("edge_id"), node_key(F.element_at("line", 1)).alias("source"), node_key(F.element_at("line", -1)).alias("target"), "length_m", (F.col("length_m") * F.when(F.col("is_service"), SERVICE_FACTOR).otherwise(1)).alias("cost"), "is_service", "line")
    return out.where("source != target")


def nearest_within(left: DataFrame, right: DataFrame, meters: float, size: float, most: int, left_id: str, right_id: str) -> DataFrame:
    """left_id, right_id, distance_m, rank: the nearest points (id, lon, lat) of right, by a grid of cells not smaller than the reach.

    Each place of right lies in one cell and each of left asks nine, so the
    join is on equal cells; a crowded cell is split by the adaptive skew join.
    Points of left in one place ask once, and of points of right in one place
    only the first by id can be among the nearest, so copies do not multiply.
    """
    lx, ly = cell(F.col("lon"), F.col("lat"), size)
    near = F.sequence(F.lit(-1), F.lit(1))
    asks = left.select("lon", "lat").distinct().select(F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), lx.alias("_x"), ly.alias("_y")).withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near))
    asks = asks.select("_lon", "_lat", (F.col("_x") + F.col("_dx")).alias("_x"), (F.col("_y") + F.col("_dy")).alias("_y"))
    first = F.row_number().over(Window.partitionBy("lon", "lat").orderBy(right_id))
    here = right.select(right_id, "lon", "lat").withColumn("_nth", first).where(F.col("_nth") <= most).select(right_id, "lon", "lat", lx.alias("_x"), ly.alias("_y"))
    close = (F.abs(F.col("lon") - F.col("_lon")) <= size) & (F.abs(F.col("lat") - F.col("_lat")) <= size)
    d = haversine_m(F.col("_lon"), F.col("_lat"), F.col("lon"), F.col("lat"))
    rows = asks.join(here, ["_x", "_y"]).where(close).select("_lon", "_lat", right_id, d.alias("distance_m")).where(F.col("distance_m") <= meters)
    ranked = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("distance_m", right_id))
    rows = rows.withColumn("rank", ranked("_lon", "_lat")).where(F.col("rank") <= most).drop("rank")
    own = left.select(F.col(left_id), F.col("lon").alias("_lon"), F.col("lat").alias("_lat")).hint("merge").join(rows, ["_lon", "_lat"]).select(left_id, right_id, "distance_m")
    return own.withColumn("rank", ranked(left_id)).where(F.col("rank") <= most)


def rail_vertices(edges: DataFrame) -> DataFrame:
    """node, lon, lat of each end of an edge, once."""
    end = lambda node, i: edges.select(F.col(node).alias("node"), F.element_at("line", i)["lon"].alias("lon"), F.element_at("line", i)["lat"].alias("lat"))
    return end("source", 1).unionByName(end("target", -1)).groupBy("node").agg(F.min("lon").alias("lon"), F.min("lat").alias("lat"))


def _steps(edges: DataFrame, size: float) -> DataFrame:
    """edge_id, nth, ends (ax, ay, bx, by) of each step of a line, and a cell (_x, _y) that it passes; long steps lie in pieces of at most a cell."""
    ends = F.arrays_zip(F.slice("line", 1, F.size("line") - 1).alias("a"), F.slice("line", 2, F.size("line") - 1).alias("b"))
    rows = edges.where(F.size("line") >= 2).select("edge_id", F.posexplode(ends).alias("nth", "s"))
    rows = rows.select("edge_id", "nth", F.col("s.a.lon").alias("ax"), F.col("s.a.lat").alias("ay"), F.col("s.b.lon").alias("bx"), F.col("s.b.lat").alias("by"))
    n = F.greatest(F.ceil(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))) / size), F.lit(1))
    rows = rows.withColumn("_n", n.cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = lambda a, b, i: F.floor((F.col(a) + (F.col(b) - F.col(a)) * i / F.col("_n")) / size).cast("long")
    span = lambda a, b: F.sequence(F.least(at(a, b, F.col("_i")), at(a, b, F.col("_i") + 1)), F.greatest(at(a, b, F.col("_i")), at(a, b, F.col("_i") + 1)))
    cells = rows.withColumn("_x", F.explode(span("ax", "bx"))).withColumn("_y", F.explode(span("ay", "by")))
    return cells.drop("_n", "_i").distinct()


def nearest_on_step(lon: Column, lat: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """The point of a step from a to b that is nearest to a place, on a plane around the place."""
    k = F.cos(F.radians(lat))
    dx, dy = (bx - ax) * k, by - ay
    along = ((lon - ax) * k * dx + (lat - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    return ax + (bx - ax) * t, ay + (by - ay) * t


def snap_stops(stops: DataFrame, edges: DataFrame, meters: float = SNAP_M, degrees: float = SNAP_DEGREES) -> DataFrame:
    """public_id, edge_id, vertex, distance_m, rank, confidence, lon, lat: the three nearest edges of each stop by their nearest point, with the nearer end.

    Steps of lines and stops meet in cells twice the reach wide.
    """
    size = 2 * degrees
    near = F.sequence(F.lit(-1), F.lit(1))
    x, y = cell(F.col("lon"), F.col("lat"), size)
    asks = stops.select("public_id", "lon", "lat", F.explode(F.transform(near, lambda d: x + d)).alias("_x"), y.alias("_cy"))
    asks = asks.select("public_id", "lon", "lat", "_x", F.explode(F.transform(near, lambda d: F.col("_cy") + d)).alias("_y"))
    met = asks.join(_steps(edges, size), ["_x", "_y"])
    px, py = nearest_on_step(*(F.col(c) for c in ("lon", "lat", "ax", "ay", "bx", "by")))
    met = met.withColumns({"px": px, "py": py})
    d = haversine_m(F.col("lon"), F.col("lat"), F.col("px"), F.col("py"))
    close = (F.hypot(F.col("px") - F.col("lon"), F.col("py") - F.col("lat")) <= degrees) & (d <= meters)
    best = met.where(close).groupBy("public_id", "edge_id").agg(F.min(F.struct(d.alias("distance_m"), "px", "py")).alias("b"))
    best = best.join(edges.select("edge_id", "is_service", "source", "target", F.element_at("line", 1).alias("first"), F.element_at("line", -1).alias("last")), "edge_id").join(stops.select("public_id", "lon", "lat"), "public_id")
    rank = F.row_number().over(Window.partitionBy("public_id").orderBy("b.distance_m", "is_service", "edge_id"))
    to = lambda p: haversine_m(F.col("lon"), F.col("lat"), p["lon"], p["lat"])
    nearer = F.when(to(F.col("first")) <= to(F.col("last")), F.col("source")).otherwise(F.col("target"))
    confidence = F.greatest(F.lit(0.0), 1 - F.col("b.distance_m") / meters)
    out = best.withColumn("rank", rank).where(F.col("rank") <= SNAPS)
    return out.select("public_id", "edge_id", nearer.alias("vertex"), F.col("b.distance_m").alias("distance_m"), "rank", confidence.alias("confidence"), F.col("b.px").alias("lon"), F.col("b.py").alias("lat"))


def components(edges: DataFrame, store) -> DataFrame:
    """node, component: the smallest node reachable.

    Each round, every node joins its smallest neighbour, if that is smaller,
    and the edges left between the groups are the next round's, each once.
    Two rounds leave at most half the nodes, so all rounds together move
    edges and nodes a few times, not once a round.
    store(df) writes a frame and returns it reread.
    """
    ends = store(edges.select(F.least("source", "target").alias("low"), F.greatest("source", "target").alias("high")))
    now, levels = ends, []
    while now.where("low != high").limit(1).count():
        apart = now.where("low != high")
        joins = _to_ends(store(apart.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("to"))), store)
        levels.append(joins)
        high, low = joins.select(F.col("node").alias("high"), F.col("to").alias("_high")), joins.select(F.col("node").alias("low"), F.col("to").alias("_low"))
        a, b = F.col("_high"), F.coalesce("_low", "low")
        met = apart.join(high, "high").join(low, "low", "left").select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
        last, now = now, store(met.where("low != high").distinct())
        if last is not ends:
            release(last)
    nodes = ends.select(F.col("low").alias("node")).unionByName(ends.select(F.col("high").alias("node"))).distinct()
    known = None
    for joins in reversed(levels):  # where a group joined another one later on, its nodes are that one's
        if known is not None:
            further = known.select(F.col("node").alias("to"), F.col("component").alias("_to"))
            known = known.unionByName(joins.join(further, "to", "left").select("node", F.coalesce("_to", "to").alias("component")))
        else:
            known = joins.withColumnRenamed("to", "component")
        known = store(known) if joins is not levels[0] else known
    if known is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(known, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _to_ends(joins: DataFrame, store) -> DataFrame:
    """node, to of joins (node, to) that lead to no node twice: the end of each one's way, by jumps twice as long each time."""
    while True:
        beyond = joins.select(F.col("node").alias("to"), F.col("to").alias("_to"))
        if not joins.join(beyond, "to", "left_semi").limit(1).count():
            return joins
        last, joins = joins, store(joins.join(beyond, "to", "left").select("node", F.coalesce("_to", "to").alias("to")))
        release(last)


def contracted(edges: DataFrame, stay: DataFrame, store) -> tuple[DataFrame, DataFrame]:
    """(ways, members) of edges (edge_id, source, target, cost): edges put together over nodes where two meet, but not over those of stay (node).

    ways: way, source, target, cost; members: way, nth, edge_id, cost, in the
    order from source to target.  Only edges with an end at such a node are
    put in order; all others are ways as they are.
    """
    through = edges.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    through = store(through.select("node").join(stay, "node", "left_anti"))
    at = lambda end: through.select(F.col("node").alias(end), F.lit(True).alias(f"_{end}"))
    rows = edges.select(F.col("edge_id").cast("string").alias("edge_id"), "source", "target", "cost").join(at("source"), "source", "left").join(at("target"), "target", "left")
    touches = F.coalesce("_source", "_target").isNotNull()
    parts = store(rows.where(touches).select(F.lit(0).alias("g"), F.col("edge_id").alias("part"), F.col("source").alias("first"), F.col("target").alias("last"), "cost"))
    alone = rows.where(~touches).select(F.col("edge_id").alias("way"), "source", "target", "cost")
    # ends are counted among all edges, so the parts join at the nodes found above only
    others = parts.select("g", F.explode(F.array("first", "last")).alias("at")).distinct().join(through.withColumnRenamed("node", "at"), "at", "left_anti").select("g", "at")
    order = chained(parts.drop("cost"), store, others)
    rows = store(order.join(parts, ["g", "part"]).select(F.col("chain").alias("way"), "nth", F.col("part").alias("edge_id"), "cost", F.when(F.col("back"), F.col("last")).otherwise(F.col("first")).alias("source"), F.when(F.col("back"), F.col("first")).otherwise(F.col("last")).alias("target")))
    ways = rows.groupBy("way").agg(F.min_by("source", "nth").alias("source"), F.max_by("target", "nth").alias("target"), F.sum("cost").alias("cost"))
    own = alone.select("way", F.lit(0).cast("long").alias("nth"), F.col("way").alias("edge_id"), "cost")
    return ways.unionByName(alone), rows.select("way", "nth", "edge_id", "cost").unionByName(own)


def cheapest(arcs: DataFrame, asked: DataFrame, store) -> DataFrame:
    """source, target, cost, path of pairs (source, target) over arcs (a, b, cost, way, back): the cheapest path, as its arcs' (way, back).

    All sources are searched at once.  A round follows the arcs from the nodes
    reached at less cost than before; a node is reached within its source's
    bound only, which begins small, grows fourfold until the source's targets are
    found, and falls to the dearest of them once all are known.  So what is
    held of a source is what lies not much farther than its targets, whatever
    the size of the graph.  A node knows the arc it was reached by; paths are
    then followed back from the targets alone.  Costs are not negative.
    """
    grade = lambda cost: F.floor(F.log2(F.greatest(cost, F.lit(1e-9))) / 2).cast("int")
    arcs = store(arcs.withColumn("grade", grade(F.col("cost"))))
    of_node = arcs.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"), F.min("grade").alias("grade"))
    scale = of_node.agg((F.sum("cost") / F.sum("n")).alias("mean"), F.sum("cost").alias("total"), F.min("grade").alias("low"), F.max("n").alias("degree")).first()
    node, way = arcs.schema["a"].dataType.simpleString(), arcs.schema["way"].dataType.simpleString()
    none = f"array<struct<way:{way},back:boolean>>"
    if scale.mean is None:
        return asked.select("source", "target", F.lit(0.0).alias("cost"), F.array().cast(none).alias("path")).limit(0)
    left = store(asked.distinct())
    start = left.select("source", F.col("source").alias("node"), F.lit(0.0).alias("cost"), F.lit(True).alias("fresh"), F.lit(None).cast(way).alias("way"), F.lit(None).cast("boolean").alias("back"), F.lit(None).cast(node).alias("came")).distinct()
    known, bound, found = store(start), scale.mean, None
    while True:
        while known.where("fresh").limit(1).count():
            at = left.join(known.select("source", F.col("node").alias("target"), "cost"), ["source", "target"], "left")
            dearest = at.groupBy("source").agg(F.max("cost").alias("dearest"), F.count_if(F.col("cost").isNull()).alias("missing"))
            bounds = dearest.select("source", F.when(F.col("missing") == 0, F.least(F.col("dearest"), F.lit(bound))).otherwise(F.lit(bound)).alias("bound"))
            known, last = _further(known, bounds, arcs, grade, scale.low, 4 if scale.degree <= FEW_ARCS else 1, store), known
            release(last)
        reached = followed_back(left.join(known.withColumnRenamed("node", "target").select("source", "target", "cost"), ["source", "target"]), known, none, store)
        last, found = found, store(reached if found is None else found.unionByName(reached))
        release(last, reached)
        last, left = left, store(left.join(found, ["source", "target"], "left_anti"))
        release(last)
        if bound > scale.total or not left.limit(1).count():
            return found
        bound *= 4
        last, known = known, store(known.join(left.select("source").distinct(), "source", "left_semi").withColumn("fresh", F.lit(True)))
        release(last)


def _further(known: DataFrame, bounds: DataFrame, arcs: DataFrame, grade, low: int, arcs_at_once: int, store) -> DataFrame:
    """known (source, node, cost, fresh, way, back, came) after so many arcs from its fresh nodes, each within its source's bound.

    A row is passed on beside what it offers, so that several arcs are one
    plan without reading a round twice; at equal cost what was known before
    is kept, as false comes before true.
    """
    for _ in range(arcs_at_once):
        # a node asks for arcs of the grades that its bound leaves room for, not for all of a junction's
        room = F.when(F.col("fresh") & (F.col("cost") <= F.col("bound")), F.sequence(F.lit(low), F.greatest(F.lit(low), grade(F.col("bound") - F.col("cost")))))
        asks = known.join(bounds, "source", "left").withColumn("grade", F.explode_outer(room))
        met = asks.alias("f").join(arcs.alias("r"), (F.col("f.node") == F.col("r.a")) & (F.col("f.grade") == F.col("r.grade")) & (F.col("f.cost") + F.col("r.cost") <= F.col("f.bound")), "left")
        own = F.struct(F.col("f.node").alias("node"), F.struct(F.col("f.cost").alias("cost"), F.lit(False).alias("fresh"), F.col("f.way").alias("way"), F.col("f.back").alias("back"), F.col("f.came").alias("came")).alias("best"))
        offer = F.struct(F.col("r.b").alias("node"), F.struct((F.col("f.cost") + F.col("r.cost")).alias("cost"), F.lit(True).alias("fresh"), F.col("r.way").alias("way"), F.col("r.back").alias("back"), F.col("f.node").alias("came")).alias("best"))
        rows = met.select("f.source", F.explode(F.when(F.col("r.b").isNull(), F.array(own)).otherwise(F.array(own, offer))).alias("x"))
        known = rows.groupBy("source", "x.node").agg(F.min("x.best").alias("best")).select("source", "node", "best.*")
    return store(known)


def followed_back(pairs: DataFrame, known: DataFrame, none: str, store) -> DataFrame:
    """source, target, cost, path of pairs (source, target, cost), by the arcs by which their nodes were reached."""
    now = store(pairs.select("source", "target", "cost", F.col("target").alias("node"), F.array().cast(none).alias("path")))
    came = known.where("came is not null").select("source", "node", "way", "back", "came")
    path = F.when(F.col("came").isNull(), F.col("path")).otherwise(F.concat(F.array(F.struct("way", "back")), "path"))
    while now.where("node != source").limit(1).count():
        further = now
        for _ in range(4):  # arcs followed between two stored rounds
            further = further.join(came, ["source", "node"], "left").select("source", "target", "cost", F.coalesce("came", "node").alias("node"), path.alias("path"))
        last, now = now, store(further)
        release(last)
    return now.drop("node")


def shortest_paths(edges: DataFrame, pairs: DataFrame, labels: DataFrame, store=stored) -> DataFrame:
    """source, target, step, edge_id, cost along the cheapest way of each pair within one component, edges both ways.

    Nodes where two edges meet are passed over first, so a search takes as many
    rounds as its way has junctions.
    """
    of = labels.withColumnRenamed("node", "source")
    other = labels.select(F.col("node").alias("target"), F.col("component").alias("c2"))
    asked = pairs.select("source", "target").distinct().where("source != target").join(of, "source").join(other, "target").where("component = c2")
    asked = store(asked.select("source", "target", "component"))
    own = edges.select("edge_id", "source", "target", "cost")
    if labels.join(asked.select("component").distinct(), "component", "left_anti").limit(1).count():
        own = store(edges.join(of, "source").join(asked.select("component").distinct(), "component", "left_semi").select(*own.columns))
    stay = asked.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    ways, members = contracted(own, stay, store)
    ways = store(ways.where("source != target"))
    both = ways.select(F.col("source").alias("a"), F.col("target").alias("b"), "cost", "way", F.lit(False).alias("back")).unionByName(ways.select(F.col("target").alias("a"), F.col("source").alias("b"), "cost", "way", F.lit(True).alias("back")))
    arcs = both.groupBy("a", "b").agg(F.min(F.struct("cost", "way", "back")).alias("x")).select("a", "b", "x.cost", "x.way", "x.back")
    found = cheapest(arcs, asked.select("source", "target"), store)
    on = found.select("source", "target", F.posexplode("path").alias("nth_way", "p")).select("source", "target", "nth_way", "p.way", "p.back")
    on = on.join(members, "way").withColumn("within", F.when(F.col("back"), -F.col("nth")).otherwise(F.col("nth")))
    step = F.row_number().over(Window.partitionBy("source", "target").orderBy("nth_way", "within")) - 1
    return on.select("source", "target", step.alias("step"), "edge_id", "cost")


def met_paths(edges: DataFrame, pairs: DataFrame, store=stored) -> DataFrame:
    """source, target, step, edge_id, cost as of shortest_paths, for graphs whose nodes have any number of edges and whose components are not known.

    Both ends of a pair are searched from, each within half a bound, and the
    pair's way is the cheapest one on which they meet, so no end goes through
    the nodes that lie near it but on no way.  The bound begins at the least
    that two edges cost and doubles until all pairs are found: a way within it
    has no edge dearer than it, so dearer edges are stored only once a pair is
    left.  At the first bound that finds no pair, components are found, to
    leave out pairs without a way.  Costs are not negative.
    """
    edges = edges.select(F.col("edge_id").cast("string").alias("edge_id"), "source", "target", "cost").where(F.col("cost") < float("inf"))
    left = store(pairs.select("source", "target").distinct().where("source != target"))
    scale = edges.agg(F.min("cost").alias("least"), F.min(F.when(F.col("cost") > 0, F.col("cost"))).alias("step")).first()
    bound = 2 * (scale.step or 0.0)
    ends = left.select(F.explode(F.array("source", "target")).alias("source")).distinct()
    way = {"way": F.lit(None).cast("string"), "came": F.lit(None).cast(edges.schema["source"].dataType)}
    known = store(ends.select("source", F.col("source").alias("node"), F.lit(0.0).alias("cost"), F.lit(True).alias("fresh"), *(c.alias(n) for n, c in way.items())))
    found, total, labelled = None, None, False
    while True:
        near = store(edges.where(F.col("cost") <= bound))
        arcs = near.select(F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("target").alias("b")), F.struct(F.col("target").alias("a"), F.col("source").alias("b")))).alias("x"), F.col("cost").alias("arc"), F.col("edge_id").alias("way")).select("x.*", "arc", "way")
        # a little more than half, so that what rounding moves over the middle is known from both ends
        half = bound / 2 * (1 + 1e-9)
        on = F.col("fresh") & (F.col("cost") + scale.least <= half) if scale.least is not None else F.lit(False)
        while known.where(on).limit(1).count():
            known, last = store(_offered(known, known.where(on), arcs, half)), known
            release(last)
        met = store(_met(left, known, arcs, bound))
        ways = store(_met_ways(met, known, store).join(near.select("edge_id", "cost"), "edge_id").select("source", "target", "step", "edge_id", "cost"))
        found = ways if found is None else found.unionByName(ways)
        last, left = left, store(left.join(met, ["source", "target"], "left_anti"))
        none = not met.limit(1).count()
        release(last, near, met)
        if not left.limit(1).count() or (total is not None and bound > total):
            return found
        if total is None:
            edges = store(edges)
            total = edges.agg(F.coalesce(F.sum("cost"), F.lit(0.0))).first()[0]
        if none and not labelled:
            labels, labelled = store(components(edges, store)), True
            of, other = labels.toDF("source", "component"), labels.toDF("target", "component")
            last, left = left, store(left.join(of, "source").join(other, ["target", "component"]).select("source", "target"))
            release(last, labels)
            if not left.limit(1).count():
                return found
        bound *= 2
        ends = left.select(F.explode(F.array("source", "target")).alias("source")).distinct()
        last, known = known, store(known.join(ends, "source", "left_semi").withColumn("fresh", F.lit(True)))
        release(last)


def _offered(known: DataFrame, fresh: DataFrame, arcs: DataFrame, most: float) -> DataFrame:
    """known (source, node, cost, fresh, way, came) after one arc (a, b, arc, way) from the fresh nodes, at no more than most; at equal cost what was known before is kept."""
    row = lambda cost, fresh, came: F.struct(cost.alias("cost"), fresh.alias("fresh"), F.col("way"), came.alias("came")).alias("best")
    offers = fresh.select("source", "node", "cost").join(arcs, (F.col("node") == F.col("a")) & (F.col("cost") + F.col("arc") <= most))
    offers = offers.select("source", F.col("b").alias("node"), row(F.col("cost") + F.col("arc"), F.lit(True), F.col("node")))
    own = known.select("source", "node", row(F.col("cost"), F.lit(False), F.col("came")))
    return own.unionByName(offers).groupBy("source", "node").agg(F.min("best").alias("best")).select("source", "node", "best.*")


def _met(pairs: DataFrame, known: DataFrame, arcs: DataFrame, bound: float) -> DataFrame:
    """source, target, u, v, way of pairs within the bound: their cheapest way leads to u, over the edge way to v and on; u is v and way none where the ends meet in a node.

    An edge joins what is known of both ends only where no node of the way is
    known from both: then each of its nodes costs less than half the bound,
    and with the edge more than half.
    """
    of = lambda df, end, at, cost: df.select(F.col("source").alias(end), F.col("node").alias(at), F.col("cost").alias(cost))
    within = known.where(F.col("cost") < bound / 2)
    nodes = pairs.join(of(known, "source", "u", "c"), "source").join(of(known, "target", "u", "e"), ["target", "u"]).select("source", "target", (F.col("c") + F.col("e")).alias("cost"), "u", F.col("u").alias("v"), F.lit(None).cast("string").alias("way"))
    over = pairs.join(of(within, "source", "a", "c"), "source").join(arcs, "a").where((F.col("c") + F.col("arc") >= bound / 2) & (F.col("c") + F.col("arc") <= bound)).withColumnsRenamed({"a": "u", "b": "v"})
    over = over.join(of(within, "target", "v", "e"), ["target", "v"]).select("source", "target", (F.col("c") + F.col("arc") + F.col("e")).alias("cost"), "u", "v", "way")
    best = nodes.unionByName(over).where(F.col("cost") <= bound).groupBy("source", "target").agg(F.min(F.struct("cost", "u", "v", "way")).alias("x"))
    return best.select("source", "target", "x.u", "x.v", "x.way")


def _met_ways(met: DataFrame, known: DataFrame, store) -> DataFrame:
    """source, target, step, edge_id of what _met returns, by the arcs by which the nodes were reached from either end."""
    side = lambda second, end, at: met.select("source", "target", F.lit(second).alias("second"), F.col(end).alias("end"), F.col(at).alias("node"), F.array().cast("array<string>").alias("path"))
    now = store(side(False, "source", "u").unionByName(side(True, "target", "v")))
    came = known.select(F.col("source").alias("end"), "node", "way", "came")
    while now.where("node != end").limit(1).count():
        further = now.where("node != end").join(came, ["end", "node"]).select("source", "target", "second", "end", F.col("came").alias("node"), F.concat("path", F.array("way")).alias("path"))
        last, now = now, store(further.unionByName(now.where("node = end")))
        release(last)
    halves = [now.where(F.col("second") == second).select("source", "target", F.col("path").alias(name)) for second, name in ((False, "p"), (True, "q"))]
    middle = F.when(F.col("way").isNull(), F.array().cast("array<string>")).otherwise(F.array("way"))
    path = F.concat(F.reverse("p"), middle, "q")
    return met.join(halves[0], ["source", "target"]).join(halves[1], ["source", "target"]).select("source", "target", F.posexplode(path).alias("step", "edge_id"))


def confidence(max_snap_m: Column, failed: Column, total: Column, detour: Column, uses_service: Column, hausdorff_m: Column) -> Column:
    """How well a pattern's line matches the rails, from 0 to 1."""
    share = F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(1.0)).otherwise(failed / total)
    loss = (
        F.coalesce(max_snap_m, F.lit(SNAP_M)) / 800 * 0.25
        + share * 0.45
        + F.greatest(F.coalesce(detour, F.lit(10.0)) - 1.8, F.lit(0.0)) * 0.15
        + F.when(uses_service, 0.08).otherwise(0.0)
        + F.least(F.coalesce(hausdorff_m, F.lit(0.0)) / 5000, F.lit(0.25))
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - loss))


def match_status(score: Column, has_line: Column) -> Column:
    return F.when(~has_line, "fallback").when(score >= 0.70, "osm_reconstructed").when(score >= 0.45, "osm_reconstructed_low_confidence").otherwise("fallback")


def hausdorff(a: Column, b: Column) -> Column:
    """Largest distance on the Mercator map, in its metres, from a vertex of one line to the nearest vertex of the other."""
    flat = lambda line: F.transform(line, lambda p: F.struct(*(c.alias(n) for c, n in zip(mercator(p["lon"], p["lat"]), "xy", strict=True))))
    far = lambda p, q: F.array_max(F.transform(p, lambda u: F.array_min(F.transform(q, lambda v: F.hypot(u["x"] - v["x"], u["y"] - v["y"])))))
    return F.greatest(far(flat(a), flat(b)), far(flat(b), flat(a)))


def pattern_segments(stops_of: DataFrame, snaps: DataFrame, places: DataFrame, limit: int | None = None) -> DataFrame:
    """pattern_id, stop_sequence, source, target, distance_m, straight_m: each stop of a pattern with the next one.

    snaps count by their first rank.  limit keeps so many stops in order of
    pattern and sequence, after each has found its next one.
    """
    first = snaps.where("rank = 1").select(F.col("public_id").alias("stop_place_id"), "vertex", "distance_m")
    at = places.select(F.col("public_id").alias("stop_place_id"), "lon", "lat")
    rows = stops_of.join(at, "stop_place_id").join(first, "stop_place_id", "left")
    w = Window.partitionBy("pattern_id").orderBy("stop_sequence")
    following = {"target": F.lead("vertex").over(w), "_lon": F.lead("lon").over(w), "_lat": F.lead("lat").over(w)}
    rows = rows.withColumns(following)
    if limit is not None:
        rows = rows.orderBy("pattern_id", "stop_sequence").limit(limit)
    straight = haversine_m(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat"))
    return rows.where("_lon is not null").select("pattern_id", "stop_sequence", F.col("vertex").alias("source"), "target", "distance_m", straight.alias("straight_m"))


def match_statistics(segments: DataFrame, paths: DataFrame) -> DataFrame:
    """Per pattern: all, unsnapped and unrouted segments, mean and largest snap distance, straight length.

    paths: pattern_id, stop_sequence of every segment for which a way was found;
    a segment from a vertex to itself is neither routed nor failed.
    """
    routed = paths.select("pattern_id", "stop_sequence").distinct().withColumn("_routed", F.lit(True))
    rows = segments.join(routed, ["pattern_id", "stop_sequence"], "left")
    unsnapped = F.col("source").isNull() | F.col("target").isNull()
    unrouted = ~unsnapped & (F.col("source") != F.col("target")) & F.col("_routed").isNull()
    return rows.groupBy("pattern_id").agg(
        F.count(F.lit(1)).alias("total_segments"),
        F.count_if(unsnapped).alias("unsnapped_segments"),
        F.count_if(unrouted).alias("unrouted_segments"),
        F.avg("distance_m").alias("mean_snap_m"),
        F.max("distance_m").alias("max_snap_m"),
        F.sum("straight_m").alias("straight_m"),
    )


def match_lines(paths: DataFrame) -> DataFrame:
    """pattern_id, lines (in order of the way), routed_m, uses_service of path edges (pattern_id, stop_sequence, step, line, length_m, is_service)."""
    parts = F.array_sort(F.collect_list(F.struct("stop_sequence", "step", "line")))
    return paths.groupBy("pattern_id").agg(F.transform(parts, lambda x: x["line"]).alias("lines"), F.sum("length_m").alias("routed_m"), F.bool_or("is_service").alias("uses_service"))


def rated(statistics: DataFrame, lines: DataFrame, patterns: DataFrame) -> DataFrame:
    """The row of each matched pattern: lines, confidence, status, counts, detour and distance from its own line."""
    out = statistics.join(lines, "pattern_id", "left").join(patterns.select("pattern_id", "line"), "pattern_id", "left")
    failed = F.col("unsnapped_segments") + F.col("unrouted_segments")
    detour = F.col("routed_m") / F.nullif("straight_m", F.lit(0.0))
    apart = F.when(F.col("lines").isNotNull() & F.col("line").isNotNull(), hausdorff(F.flatten("lines"), F.col("line")))
    score = confidence(F.col("max_snap_m"), failed, F.col("total_segments"), detour, F.coalesce("uses_service", F.lit(False)), apart)
    return out.select("pattern_id", "lines", score.alias("confidence"), match_status(score, F.col("lines").isNotNull()).alias("status"), failed.alias("failed_segments"), "total_segments", "mean_snap_m", "max_snap_m", detour.alias("detour"), apart.alias("apart_m"))


def match_patterns(patterns: DataFrame, stops_of: DataFrame, places: DataFrame, snaps: DataFrame, edges: DataFrame, store, limit: int | None = None) -> DataFrame:
    """Patterns (pattern_id, line) matched to the rails: the row of each, see rated.  store as in components."""
    own = stops_of.join(patterns.select("pattern_id"), "pattern_id", "left_semi")
    segments = store(pattern_segments(own, snaps, places, limit))
    labels = store(components(edges, store))
    asked = segments.where("source is not null and target is not null and source != target")
    ways = store(shortest_paths(edges, asked.select("source", "target").distinct(), labels, store))
    detail = edges.select(F.col("edge_id").cast("string").alias("edge_id"), "line", "length_m", "is_service")
    paths = asked.join(ways, ["source", "target"]).join(detail, "edge_id").select("pattern_id", "stop_sequence", "step", "line", "length_m", "is_service")
    paths = store(paths)
    return rated(match_statistics(segments, paths), match_lines(paths), patterns)


def summary(edges: DataFrame, vertices: DataFrame, snaps: DataFrame, matches: DataFrame) -> DataFrame:
    """One row of counts over the rail tables."""
    n = lambda df, name, c=None: df.agg((F.count(F.lit(1)) if c is None else F.count_if(c)).alias(name))
    status = lambda s: F.count_if(F.col("status") == s)
    found = matches.agg(status("osm_reconstructed").alias("reconstructed_patterns"), status("osm_reconstructed_low_confidence").alias("low_confidence_patterns"), status("fallback").alias("fallback_patterns"))
    out = n(vertices, "rail_vertices")
    for other in (n(edges, "rail_edges"), n(snaps, "snapped_stops", F.col("rank") == 1), found):  # one row each
        out = out.crossJoin(other)
    return out
