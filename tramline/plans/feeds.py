"""Queries over a feed that is written as a ZIP of text files, unpacked, checked and read again."""

from __future__ import annotations

import glob
import shutil
import uuid
import zipfile

from pyspark.sql import functions as F

from tramline.operators import normalise
from tramline.plans.catalog import query
from tramline.plans.schedule import FEED, feed
from tramline.plans.stages import folder
from tramline.sources import gtfs


def written_archive(spark, d: str) -> str:
    """The path of a ZIP of the feed's members in the shared folder; some members lie in a folder within it, and one file is none of a feed's."""
    base = folder(spark).removeprefix("file://")
    if "://" in base:
        raise ValueError("archives are written to a shared mount")
    base = f"{base}/feed-{uuid.uuid4().hex}"
    heads = {}
    for name, df in feed(spark, d).items():
        if df.limit(1).count():
            df.write.csv(f"file://{base}/{name}", quote='"', escape='"', emptyValue="")
            heads[name] = ",".join(df.columns) + "\n"
    archive = f"{base}/feed.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for name, head in sorted(heads.items()):
            with z.open(f"inner/{name}.txt" if name > "s" else f"{name}.txt", "w", force_zip64=True) as out:
                out.write(head.encode())
                for path in sorted(glob.glob(f"{base}/{name}/part-*.csv")):  # as many as tasks wrote, none of them whole in one task
                    with open(path, "rb") as src:
                        shutil.copyfileobj(src, out)
        z.writestr("calendar.txt", ",".join(gtfs.MEMBERS["calendar"].split()) + "\n")
        z.writestr("licence.txt", "none\n")
    return archive


def read_archive(spark, archive: str):
    unpacked = gtfs.extract_feed(archive, f"{archive}.members")
    gtfs.validate_folder(unpacked)
    return gtfs.read_feed(spark, unpacked)


@query(f"WITH {FEED} SELECT place AS stop_place_id, count(*) AS calls, sum(arrival_s)::BIGINT AS arrivals, count(DISTINCT trip_id) AS trips FROM calls GROUP BY place")
def archive_calls(spark, d):
    """Stop times per place of a feed read from its archive and normalised."""
    t = normalise.normalise(read_archive(spark, written_archive(spark, d)))["stop_times"]
    return t.groupBy("stop_place_id").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("arrival_s").cast("long")).alias("arrivals"), F.count_distinct("trip_id").alias("trips"))


@query(f"""WITH {FEED} SELECT (SELECT count(*) FROM stops) AS stops, (SELECT count(*) FROM stops WHERE station) AS parents, (SELECT count(*) FROM stops WHERE parent IS NOT NULL) AS children, (SELECT count(*) FROM part) AS routes,
  count(DISTINCT trip_id) AS trips, count(DISTINCT trip_id) AS trips_without_shape, count(*) AS stop_times, count(*) FILTER (WHERE departure_s >= 86400) AS departures_after_midnight, count(*) AS archive_rows FROM times""")
def archive_inspection(spark, d):
    """What a feed's archive says of itself once it is read, and the stop times that its file holds."""
    archive = written_archive(spark, d)
    rows = gtfs.archive_counts(archive)["stop_times.txt"]
    out = gtfs.inspect_feed(read_archive(spark, archive))
    return out.select("stops", "parents", "children", "routes", "trips", "trips_without_shape", "stop_times", "departures_after_midnight", F.lit(rows).cast("long").alias("archive_rows"))
