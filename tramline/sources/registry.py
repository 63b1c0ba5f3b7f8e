"""The registry of raw sources: a small JSON manifest, checks of files by content, and boundary layers."""

from __future__ import annotations

import hashlib
import json
import os
import time
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions.text import blank_to_null
from tramline.operators.polygons import union_polygons
from tramline.plans.stages import stored
from tramline.sources import geopackage
from tramline.sources.gtfs import MARKER, REQUIRED, validate_folder

#: States by the first two digits of the official key, and their names.
STATE_KEYS = {"02": "DE-HH", "03": "DE-NI", "01": "DE-SH", "13": "DE-MV", "04": "DE-HB"}
STATE_NAMES = {"DE-HH": "Hamburg", "DE-NI": "Niedersachsen", "DE-SH": "Schleswig-Holstein", "DE-MV": "Mecklenburg-Vorpommern", "DE-HB": "Bremen"}
ZIP_HEAD = b"PK\x03\x04"


def read_manifest(path: str) -> dict:
    if not os.path.exists(path):
        return {"generated_at": None, "sources": []}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def write_manifest(path: str, manifest: dict) -> dict:
    """Store the manifest with its time of writing; readers see the old or the new one, never half of it."""
    manifest = manifest | {"generated_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump(manifest, f, indent=2, ensure_ascii=False)
    os.replace(f"{path}.new", path)
    return manifest


def upsert_source(manifest: dict, entry: dict) -> dict:
    """The manifest with the entry in place of the one with its key, sorted by key."""
    by_key = {s["source_key"]: s for s in manifest["sources"]} | {entry["source_key"]: entry}
    return manifest | {"sources": [by_key[k] for k in sorted(by_key)]}


def source_metadata(manifest: dict, key: str) -> dict:
    return next((s for s in manifest["sources"] if s["source_key"] == key), {})


def manifest_table(spark: SparkSession, manifest: dict) -> DataFrame:
    """source_key, format, file_name, sha256, validation_status, valid_from and valid_until of each source."""
    names = ["source_key", "format", "file_name", "sha256", "validation_status", "valid_from", "valid_until"]
    return spark.createDataFrame([tuple(s.get(n) for n in names) for s in manifest["sources"]], ", ".join(f"{n} string" for n in names))


def digest(path: str, algorithm: str = "sha256") -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, algorithm).hexdigest()


def check_file(path: str, kind: str, md5: str | None = None) -> dict:
    """What a downloaded file says of itself: size, SHA-256, members, and a status.

    kind is ``zip``, ``gtfs`` (a ZIP with the required feed files), ``boundaries``
    (a ZIP with a GeoPackage) or ``osm.pbf``.  Content of another kind raises; an
    MD5 that differs from the one published makes the status ``warning``.
    """
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    with open(path, "rb") as f:
        head = f.read(32)
    out = {"file_size_bytes": os.path.getsize(path), "sha256": digest(path), "validation_status": "validated", "notes": None}
    if kind in ("zip", "gtfs", "boundaries"):
        if head[:4] != ZIP_HEAD:
            raise ValueError(f"{path} is no ZIP")
        with zipfile.ZipFile(path) as z:
            if bad := z.testzip():
                raise ValueError(f"{path}: {bad} is damaged")
            names = {os.path.basename(n) for n in z.namelist()}
        if kind == "gtfs" and (missing := {f"{m}.txt" for m in REQUIRED} - names):
            raise ValueError(f"{path} lacks {', '.join(sorted(missing))}")
        if kind == "boundaries" and not any(n.endswith(".gpkg") for n in names):
            raise ValueError(f"{path} holds no GeoPackage")
    elif head.lstrip().startswith(b"<"):
        raise ValueError(f"{path} is a page, not data")
    if md5 and (own := digest(path, "md5")) != md5:
        out |= {"validation_status": "warning", "notes": f"MD5 {own} differs from the published {md5}"}
    return out


def validate_sources(folder: str | None, fixture: str | None = None) -> list[str]:
    """Digests of the feed folders that are there; a folder named but absent raises."""
    if folder and not os.path.exists(folder):
        raise FileNotFoundError(folder)
    return [validate_folder(f if os.path.isdir(f) else os.path.dirname(f)) for f in (folder, fixture) if f and os.path.exists(f)]


def extract_boundaries(archive: str, folder: str) -> str:
    """Unpack a boundary archive once; the path of its first GeoPackage."""
    if not os.path.exists(marker := os.path.join(folder, MARKER)):
        os.makedirs(folder, exist_ok=True)
        with zipfile.ZipFile(archive) as z:
            if bad := z.testzip():
                raise ValueError(f"{archive}: {bad} is damaged")
            z.extractall(folder)
        open(marker, "w").close()
    found = sorted(os.path.join(d, n) for d, _, names in os.walk(folder) for n in names if n.endswith(".gpkg"))
    if not found:
        raise FileNotFoundError(f"{archive} holds no GeoPackage")
    return found[0]


def choose_layer(layers: list[tuple[str, str]]) -> str:
    """Of (name, type) the first layer whose name holds ``lan``, else the first of features."""
    found = [n for n, _ in layers if "lan" in n.lower()] or [n for n, kind in layers if kind == "features"]
    if not found:
        raise ValueError("no layer of features")
    return found[0]


def geopackage_layers(path: str) -> list[tuple[str, str]]:
    import contextlib
    import sqlite3

    with contextlib.closing(sqlite3.connect(path)) as db:
        return db.execute("SELECT table_name, data_type FROM gpkg_contents").fetchall()


def state_of_key(key: Column, name: Column) -> Column:
    """State of a boundary by its official key or its name; the first rule that fits counts."""
    out = F.lit(None).cast("string")
    for prefix, code in reversed(STATE_KEYS.items()):
        out = F.when(F.coalesce(key.startswith(prefix), F.lit(False)) | (F.lower(name) == STATE_NAMES[code].lower()), code).otherwise(out)
    return out


def boundaries(spark: SparkSession, path: str) -> DataFrame:
    """name, key, polygon, nth, ring (points of lon, lat) of each ring, nth 0 the outer one, of a GeoJSON or GeoPackage file of polygons, read by executors."""
    if path.lower().endswith(".gpkg"):
        rows = geopackage.read_geopackage(spark, path, choose_layer(geopackage.layers(path)))
        rings = rows.where(F.col("kind").isin("Polygon", "MultiPolygon")).select("properties", F.col("fid").alias("feature"), F.explode("parts").alias("p"))
        rings = rings.select("properties", "feature", F.col("p.part").alias("part"), F.col("p.nth").alias("nth"), F.col("p.points").alias("ring"))
    else:
        # geometry stays text until its kind is known: a polygon's rings lie one level deeper in a multipolygon
        raw = spark.read.text(path, wholetext=True)
        shape = "struct<features:array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>"
        rows = raw.select(F.posexplode(F.from_json("value", shape)["features"]).alias("feature", "f"))
        many = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
        one = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
        polygons = F.when(F.col("f.geometry.type") == "MultiPolygon", many).when(F.col("f.geometry.type") == "Polygon", F.array(one))
        parts = rows.select(F.col("f.properties").alias("properties"), "feature", F.posexplode(polygons).alias("part", "rings"))
        parts = parts.select("properties", "feature", "part", F.posexplode("rings").alias("nth", "points"))
        ring = F.transform("points", lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))
        rings = parts.select("properties", "feature", "part", "nth", ring.alias("ring"))
    prop = lambda *names: F.coalesce(*(blank_to_null(F.try_element_at("properties", F.lit(n))) for n in names))
    return rings.select(
        prop("GEN", "gen", "BEZ", "bez", "name").alias("name"),
        prop("AGS", "ags", "ARS", "ars", "SN_L", "sn_l", "key").alias("key"),
        F.struct(F.col("feature").cast("long").alias("feature"), F.col("part").cast("int").alias("part")).alias("polygon"),
        F.col("nth").cast("int").alias("nth"),
        "ring",
    )


def dissolve(rings: DataFrame, store=stored) -> DataFrame:
    """state_code, name, official_key, rings: the union of all polygons of a state, holes among its rings, for tests by even and odd."""
    mapped = rings.withColumn("state_code", state_of_key(F.col("key"), F.col("name"))).where("state_code is not null")
    named = mapped.groupBy("state_code").agg(F.max("name").alias("name"), F.min("key").alias("official_key"))
    united = union_polygons(mapped.select("state_code", "polygon", "nth", "ring"), ["state_code"], store)
    shapes = united.groupBy("state_code").agg(F.array_sort(F.collect_list("ring")).alias("rings"))
    return named.join(shapes, "state_code").select("state_code", "name", "official_key", "rings")
