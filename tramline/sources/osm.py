"""Map extracts: named objects and railway lines, from PBF files or from prepared JSON lines or Parquet.

Lines of ways are put together by a join of their references with the places
of nodes; no table of nodes is held anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "array<struct<lon:double,lat:double>>"
OBJECTS = f"osm_type string, osm_id long, lon double, lat double, tags map<string,string>, nodes {POINTS}"
LINES = f"osm_id long, tags map<string,string>, parts array<{POINTS}>"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Columns of the schema; a file may lack some of them."""
    if not path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(schema).json(path)
    df = spark.read.parquet(path)
    columns = [c.split(maxsplit=1) for c in schema.split(", ")]
    return df.select(*((F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in columns))


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """osm_type, osm_id, name, tags, nodes of the named nodes and ways; relations are left out.

    A node without a list of nodes is its own only one.
    """
    rows = _read(spark, path, OBJECTS).where(F.col("osm_type").isin("node", "way"))
    own = F.array(F.struct("lon", "lat"))
    nodes = F.when(F.size("nodes") > 0, F.col("nodes")).when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), own).otherwise(F.array().cast(POINTS))
    named = F.nullif(F.trim(F.try_element_at("tags", F.lit("name"))), F.lit(""))
    return rows.select("osm_type", "osm_id", named.alias("name"), "tags", nodes.alias("nodes")).where("name is not null")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """id, tags, parts of railway lines, as way_parts takes them; lines without a part of two points are left out."""
    rows = _read(spark, path, LINES)
    return rows.select(F.col("osm_id").alias("id"), "tags", "parts").where(F.exists("parts", lambda p: F.size(p) >= 2))


# --- from the objects of a PBF file (kind, id, tags, lon, lat, refs, members) ------


def once(objects: DataFrame) -> DataFrame:
    """Objects without those that another file of the same extract holds too."""
    return objects.dropDuplicates(["kind", "id"])


def way_lines(objects: DataFrame, wanted: Column | None = None) -> DataFrame:
    """id, tags, line, missing of the ways (wanted: those alone): the places of their nodes in order.

    A node that the extract lacks is left out and counted as missing; a node
    referenced twice stands twice.  A way without any known node has an empty line.
    """
    ways = objects.where("kind = 'way'")
    ways = ways if wanted is None else ways.where(wanted)
    places = objects.where("kind = 'node' and lon is not null and lat is not null").select(F.col("id").alias("ref"), "lon", "lat").dropDuplicates(["ref"])
    asked = ways.select("id", F.posexplode("refs").alias("nth", "ref"))
    found = asked.join(places, "ref").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("nth", "lon", "lat"))).alias("found"))
    line = F.transform(F.coalesce("found", F.array().cast("array<struct<nth:int,lon:double,lat:double>>")), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    out = ways.select("id", "tags", F.coalesce(F.size("refs"), F.lit(0)).alias("asked")).join(found, "id", "left")
    return out.select("id", "tags", line.alias("line"), (F.col("asked") - F.coalesce(F.size("found"), F.lit(0))).alias("missing"))


def tag_of(name: str) -> Column:
    return F.try_element_at("tags", F.lit(name))


def matching(objects: DataFrame, wanted: Column) -> DataFrame:
    """The objects wanted and what they need: members of relations, nodes of ways; each once, as a filter by tags writes them."""
    chosen = objects.where(wanted)
    members = chosen.where("kind = 'relation'").select(F.explode("members").alias("m")).select("m.kind", F.col("m.ref").alias("id"))
    own = chosen.select("kind", "id").unionByName(members).distinct()
    ways = objects.where("kind = 'way'").join(own.where("kind = 'way'").select("id"), "id", "left_semi")
    nodes = ways.select(F.lit("node").alias("kind"), F.explode("refs").alias("id"))
    return once(objects.join(own.unionByName(nodes).distinct(), ["kind", "id"], "left_semi").select(*objects.columns))


def named_objects(objects: DataFrame) -> DataFrame:
    """osm_type, osm_id, name, tags, nodes of the named nodes and ways of an extract, as read_objects gives them."""
    name = F.nullif(F.trim(tag_of("name")), F.lit(""))
    points = objects.where("kind = 'node'").where(name.isNotNull()).select("id", "tags", F.array(F.struct("lon", "lat")).alias("line"))
    lines = way_lines(objects, name.isNotNull()).select("id", "tags", "line")
    both = points.withColumn("osm_type", F.lit("node")).unionByName(lines.withColumn("osm_type", F.lit("way")))
    return both.select("osm_type", F.col("id").alias("osm_id"), name.alias("name"), "tags", F.col("line").alias("nodes"))


def railway_lines(objects: DataFrame) -> DataFrame:
    """id, tags, parts of the ways of an extract that have a railway tag, as read_lines gives them."""
    lines = way_lines(objects, tag_of("railway").isNotNull())
    return lines.where(F.size("line") >= 2).select("id", "tags", F.array("line").alias("parts"))
