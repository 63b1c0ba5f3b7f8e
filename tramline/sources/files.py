"""Point-of-interest inputs: delimited text, JSON, GeoJSON and archives of them, by suffix."""

from __future__ import annotations

import json
import os
import re
import zipfile

from pyspark.sql import DataFrame, SparkSession

from tramline.sources.gtfs import read_csv


def sniff(path: str, choices: str = ",;\t") -> str:
    """The delimiter of a file's first 4 KiB: the one that splits most of its lines into equally many parts, more than one; else by the header."""
    with open(path, encoding="utf-8-sig") as f:
        lines = [x for x in f.read(4096).split("\n") if x.strip()]
    lines = lines[:-1] if len(lines) > 2 else lines  # the last may be cut
    unquoted = [re.sub(r'"(?:[^"]|"")*"', "", x) for x in lines]
    score = lambda c: (sum(x.count(c) == unquoted[0].count(c) for x in unquoted) if unquoted and c in unquoted[0] else 0, unquoted[0].count(c) if unquoted else 0)
    return max(choices, key=score)


def _rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Records of any keys as a table of text, nested values as JSON."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    schema = ", ".join(f"`{n}` string" for n in names) or "empty string"
    return spark.createDataFrame([tuple(text(r.get(n)) for n in names) for r in rows], schema)


def _features(data: dict, points_only: bool) -> list[dict]:
    out = []
    for f in data.get("features", []):
        geometry, props = f.get("geometry") or {}, dict(f.get("properties") or {})
        at = geometry.get("coordinates") or []
        point = geometry.get("type") == "Point" and len(at) >= 2
        if point:
            props |= {"__lon": at[0], "__lat": at[1]}
        if point or not points_only:
            out.append(props)
    return out


def read_json(spark: SparkSession, path: str, points_only: bool = True) -> DataFrame:
    """A list of records, a feature collection, or an object with a ``places`` list."""
    with open(path, encoding="utf-8-sig") as f:
        data = json.load(f)
    if isinstance(data, dict) and data.get("type") == "FeatureCollection":
        return _rows(spark, _features(data, points_only))
    if isinstance(data, dict) and isinstance(data.get("places"), list):
        data = data["places"]
    if not isinstance(data, list):
        raise ValueError(f"{path}: neither a list, nor features, nor places")
    return _rows(spark, [r for r in data if isinstance(r, dict)])


def read_any(spark: SparkSession, path: str, points_only: bool = True) -> DataFrame:
    """Read by suffix; a ZIP is read by its first member of a known suffix, unpacked beside it."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix in (".csv", ".tsv"):
        return read_csv(spark, path, "\t" if suffix == ".tsv" else sniff(path))
    if suffix in (".json", ".geojson"):
        return read_json(spark, path, points_only)
    if suffix == ".zip":
        with zipfile.ZipFile(path) as z:
            for name in sorted(z.namelist()):
                if os.path.splitext(name)[1].lower() in (".csv", ".json", ".geojson"):
                    return read_any(spark, z.extract(name, f"{path}.members"), points_only)
    raise ValueError(f"{path}: no reader for {suffix or 'files without suffix'}")


def resolve(explicit: str | None, variable: str, defaults: list[str], allow_missing: bool = False) -> str | None:
    """The path given, else by environment variable, else the first default that exists."""
    if found := explicit or os.environ.get(variable) or next((d for d in defaults if os.path.exists(d)), None):
        return found
    if allow_missing:
        return None
    raise FileNotFoundError(f"no source: give a path or set {variable}")


def profile(path: str, name: str) -> dict:
    """A routing profile by id from a YAML file with a ``profiles`` list."""
    import yaml

    with open(path, encoding="utf-8") as f:
        for p in yaml.safe_load(f)["profiles"]:
            if p["id"] == name:
                return p
    raise KeyError(f"{path} has no profile {name}")
