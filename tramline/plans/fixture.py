"""A few rows in memory that the service's questions can be asked of, without an import."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tramline.plans.api import PLACE_COLUMNS, Tables

SNAPSHOT = "fixture-synthetic-2026-07"
#: The fixture's stops, metrics and place.
STOPS = [
    ("de:02000:8002549", "Hamburg Hbf", "de:02000:8002549", 53.552733, 10.006909, "DE-HH", ["ICE", "RE", "S", "U", "BUS"], "dhid"),
    ("de:01056:9001", "Aumuehle Testbahnhof", "de:01056:9001", 53.529, 10.314, "DE-SH", ["RE", "BUS"], "dhid"),
    ("de:02000:8002550", "Bergedorf Fixture", "de:02000:8002550", 53.4897, 10.2039, "DE-HH", ["RE", "S", "BUS"], "dhid"),
    ("de:01056:9100", "Busdorf Mitte", None, 53.545, 10.39, "DE-SH", ["BUS"], "missing_dhid"),
]
METRICS = [("de:01056:9001", 2400, 18), ("de:02000:8002550", 1500, 24), ("de:01056:9100", 3480, 0)]
PLACE = ("gut-testfeld", "Gut Testfeld", "gut", "SH", None, None, 10.31, 53.61, None)


def fixture(spark: SparkSession) -> Tables:
    """Tables of the fixture's snapshot, which is live."""
    now = F.lit("2026-06-24 08:05:00").cast("timestamp")
    stops = spark.createDataFrame(STOPS, "public_id string, name string, dhid string, lat double, lon double, state_code string, modes array<string>, identity_quality string")
    metrics = spark.createDataFrame(METRICS, "destination string, fastest_s int, direct_count long")
    frames = {
        "snapshots": spark.createDataFrame([(SNAPSHOT, "active", True)], "public_id string, status string, is_active boolean"),
        "stop_places": stops.withColumns({"is_display_stop": F.lit(True), "snapshot_id": F.lit(SNAPSHOT)}),
        "od_metrics": metrics.withColumns({"profile": F.lit("regular_tue_thu"), "metric_run_id": F.lit("fixture"), "computed_at": now, "snapshot_id": F.lit(SNAPSHOT)}),
        "places": spark.createDataFrame([PLACE], PLACE_COLUMNS),
    }
    return Tables(frames)
