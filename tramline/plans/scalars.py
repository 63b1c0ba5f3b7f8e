"""Queries over the scalar functions, extraction and statistics, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tramline.functions import geo, modes, text, times
from tramline.operators import calendar, journeys, metrics, metrics_run, normalise, poi, rail, research, routing, store
from tramline.plans import api
from tramline.plans.catalog import PLACES, SAMPLES, ST, places, query, samples, stop_times, table
from tramline.plans.stages import folder
from tramline.sources import gtfs

# --- times and labels ---------------------------------------------------------------


@query("""WITH s AS (SELECT o_orderkey, CAST((o_orderkey * 977) % 100000 AS INTEGER) AS s FROM orders)
SELECT o_orderkey, lpad(CAST((s // 60) % 1440 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((s // 60) % 60 AS VARCHAR), 2, '0') AS clock, CAST(floor(s / 60 + 0.5) AS BIGINT) || ' min' AS minutes,
  CASE WHEN floor(s / 60 + 0.5) < 60 THEN CAST(floor(s / 60 + 0.5) AS BIGINT) || ' min' ELSE CAST(floor(floor(s / 60 + 0.5) / 60) AS BIGINT) || ' h ' || lpad(CAST(CAST(floor(s / 60 + 0.5) AS BIGINT) % 60 AS VARCHAR), 2, '0') || ' min' END AS duration,
  CASE WHEN floor((s - 50000) / 60 + 0.5) = 0 THEN 'on time' ELSE CASE WHEN floor((s - 50000) / 60 + 0.5) > 0 THEN '+' ELSE '' END || CAST(floor((s - 50000) / 60 + 0.5) AS BIGINT) || ' min' END AS delay FROM s""")
def clock_labels(spark, d):
    """Clock, minutes, duration and delay labels of seconds; halves round up."""
    s = (F.col("o_orderkey") * 977 % 100000).cast("int")
    return table(spark, d, "orders").select("o_orderkey", times.clock_label(s).alias("clock"), times.minutes_label(s).alias("minutes"), times.duration_label(s).alias("duration"), times.delay_label(s - 50000).alias("delay"))


@query("""WITH c AS (SELECT c_custkey, (c_custkey * 7) % 34 AS h, (c_custkey * 13) % 75 AS m FROM customer), l AS (SELECT *, h || ':' || lpad(CAST(m AS VARCHAR), 2, '0') AS label FROM c)
SELECT c_custkey, CASE WHEN h <= 29 AND m < 60 THEN h * 60 + m END AS minutes, lpad(CAST(((c_custkey % 24) * 60 + 30 + c_custkey % 100 - 50 + 1440) % 1440 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(((c_custkey % 24) * 60 + 30 + c_custkey % 100 - 50 + 1440) % 60 AS VARCHAR), 2, '0') AS shifted FROM l""")
def clock_parse(spark, d):
    """Minutes of clock labels up to hour 29, and labels moved around midnight."""
    k = F.col("c_custkey")
    label = F.concat_ws(":", (k * 7 % 34).cast("string"), F.lpad((k * 13 % 75).cast("string"), 2, "0"))
    own = F.format_string("%02d:30", (k % 24).cast("int"))
    return table(spark, d, "customer").select("c_custkey", times.clock_minutes(label).cast("long").alias("minutes"), times.shift_clock(own, k % 100 - 50).alias("shifted"))


@query("""WITH t AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '8:61:00' WHEN 2 THEN ' 25:15:00' WHEN 3 THEN '07: 05 :09' ELSE (o_orderkey % 30) || ':00:30' END AS v FROM orders)
SELECT k, CASE WHEN k % 5 IN (0, 3) THEN NULL WHEN k % 5 = 1 THEN 8 * 3600 + 61 * 60 WHEN k % 5 = 2 THEN 90900 ELSE (k % 30) * 3600 + 30 END AS plain, CASE WHEN k % 5 IN (0, 1, 3) THEN NULL WHEN k % 5 = 2 THEN 90900 ELSE (k % 30) * 3600 + 30 END AS strict,
  CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN 8 * 3600 + 61 * 60 WHEN k % 5 = 2 THEN 90900 WHEN k % 5 = 3 THEN 7 * 3600 + 309 ELSE (k % 30) * 3600 + 30 END AS loose FROM t""")
def time_strictness(spark, d):
    """Schedule times at three levels of strictness; blank and malformed ones are null."""
    k = F.col("o_orderkey")
    v = F.when(k % 5 == 0, "").when(k % 5 == 1, "8:61:00").when(k % 5 == 2, " 25:15:00").when(k % 5 == 3, "07: 05 :09").otherwise(F.concat((k % 30).cast("string"), F.lit(":00:30")))
    whole = lambda c: c.cast("long")
    return table(spark, d, "orders").select(k.alias("k"), whole(times.gtfs_seconds(v)).alias("plain"), whole(times.gtfs_seconds(v, strict=True)).alias("strict"), whole(times.gtfs_seconds(v, loose=True)).alias("loose"))


@query("""WITH o AS (SELECT o_orderkey AS k, date_trunc('day', o_orderdate) AS a, date_trunc('day', o_orderdate) + to_seconds(CAST(o_orderkey % 5000 - 1000 AS BIGINT)) AS b FROM orders)
SELECT k, CASE WHEN k % 9 = 0 THEN NULL WHEN k % 5000 - 1000 >= 0 THEN k % 5000 - 1000 END AS plain, CASE WHEN k % 9 = 0 THEN NULL ELSE greatest(k % 5000 - 1000, 0) END AS clamped FROM o""")
def iso_durations(spark, d):
    """Seconds between ISO timestamps: null or 0 where negative, null where one is malformed."""
    k = F.col("o_orderkey")
    day = F.date_trunc("day", F.col("o_orderdate").cast("timestamp"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    start = F.when(k % 9 == 0, "soon").otherwise(iso(day))
    end = iso(F.timestamp_seconds(F.unix_seconds(day) + k % 5000 - 1000))
    return table(spark, d, "orders").select(k.alias("k"), times.seconds_between(start, end).alias("plain"), times.seconds_between(start, end, clamp=True).alias("clamped"))


@query("""SELECT c_custkey, strftime(CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2026-07-08 06:00:00' ELSE TIMESTAMP '2026-01-08 07:00:00' END + to_minutes(CAST(c_custkey % 600 AS BIGINT)), '%Y-%m-%d %H:%M') AS utc FROM customer""")
def local_times(spark, d):
    """Local times of a zone as UTC: two hours less in summer, one in winter."""
    k = F.col("c_custkey")
    base = F.when(k % 2 == 0, "2026-07-08 08:00:00").otherwise("2026-01-08 08:00:00").cast("timestamp_ntz")
    local = F.date_format(base + F.make_dt_interval(mins=(k % 600).cast("int")), "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, d, "customer").select("c_custkey", F.date_format(times.local_to_utc(local), "yyyy-MM-dd HH:mm").alias("utc"))


# --- names and numbers ---------------------------------------------------------------


@query("""WITH n AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN '  Große-Straße/Élan ' WHEN 1 THEN 'Hof (Nord)' WHEN 2 THEN 'A--B  c' ELSE c_name END AS v FROM customer)
SELECT k, CASE k % 4 WHEN 0 THEN 'groe_strae/elan' WHEN 1 THEN 'hof_(nord)' WHEN 2 THEN 'a_b_c' ELSE lower(v) END AS by_dash, CASE k % 4 WHEN 0 THEN 'groe strae elan' WHEN 1 THEN 'hof (nord)' WHEN 2 THEN 'a b c' ELSE lower(v) END AS by_slash,
  CASE k % 4 WHEN 0 THEN ' große-straße/élan ' WHEN 1 THEN 'hof (nord)' WHEN 2 THEN 'a--b c' ELSE lower(v) END AS squeezed FROM n""")
def name_keys(spark, d):
    """Key forms of names: words at white space and dashes, at slashes too, and lower case with single blanks."""
    k = F.col("c_custkey")
    v = F.when(k % 4 == 0, "  Große-Straße/Élan ").when(k % 4 == 1, "Hof (Nord)").when(k % 4 == 2, "A--B  c").otherwise(F.regexp_replace("c_name", "#", "#"))
    own = F.lower("c_name")
    dash, slash = text.plain_key(v), text.plain_key(v, "-/", " ")
    return table(spark, d, "customer").select(k.alias("k"), dash.alias("by_dash"), slash.alias("by_slash"), F.when(k % 4 == 3, own).otherwise(text.squeezed(v)).alias("squeezed"))


@query("""WITH n AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN replace(CAST(p_retailprice AS VARCHAR), '.', ',') WHEN 1 THEN ' 12.5 ' WHEN 2 THEN 'abc' WHEN 3 THEN '' ELSE '-7' END AS v FROM part)
SELECT k, CASE k % 5 WHEN 0 THEN CAST(replace(v, ',', '.') AS DOUBLE) WHEN 1 THEN 12.5 WHEN 4 THEN -7 END AS number FROM n""")
def number_parse(spark, d):
    """Numbers with decimal point or comma; anything else is null."""
    k = F.col("p_partkey")
    v = F.when(k % 5 == 0, F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(","))).when(k % 5 == 1, " 12.5 ").when(k % 5 == 2, "abc").when(k % 5 == 3, "").otherwise("-7")
    return table(spark, d, "part").select(k.alias("k"), text.number(v).alias("number"))


@query("""WITH c AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'A=1@O=' || c_name WHEN 1 THEN CAST(c_custkey * 100003 AS VARCHAR) WHEN 2 THEN c_name END AS v FROM customer)
SELECT k, CASE k % 4 WHEN 0 THEN true WHEN 1 THEN length(v) BETWEEN 5 AND 12 ELSE false END AS usable FROM c""")
def location_reference(spark, d):
    """Whether a text is a place reference: the long form, or 5 to 12 digits."""
    k = F.col("c_custkey")
    v = F.when(k % 4 == 0, F.concat(F.lit("A=1@O="), "c_name")).when(k % 4 == 1, (k * 100003).cast("string")).when(k % 4 == 2, F.col("c_name"))
    return table(spark, d, "customer").select(k.alias("k"), text.is_location_reference(v).alias("usable"))


@query("""WITH c AS (SELECT c_custkey AS k, (c_custkey % 11) / 10.0::DOUBLE AS s, CASE WHEN c_custkey % 3 > 0 THEN CAST((c_custkey * 31) % 1500 AS DOUBLE) END AS m FROM customer)
SELECT k, CASE WHEN s >= 0.3 OR m <= 250 THEN round(s * 100 - coalesce(m, 1000) / 25, 6) END AS score FROM c""")
def location_scores(spark, d):
    """Scores of place candidates; unlike and distant ones have none."""
    k = F.col("c_custkey")
    s, m = (k % 11) / F.lit(10.0), F.when(k % 3 > 0, (k * 31 % 1500).cast("double"))
    return table(spark, d, "customer").select(k.alias("k"), F.round(text.location_score(s, m), 6).alias("score"))


@query("""WITH a AS (SELECT c_nationkey AS request, c_custkey AS position, (c_custkey % 11) / 10.0::DOUBLE AS s, CAST((c_custkey * 31) % 1500 AS DOUBLE) AS m FROM customer),
n AS (SELECT request, position, CASE WHEN position % 3 = 0 THEN 1.0 WHEN position % 3 = 1 THEN 0.5 ELSE 0.0 END * 100 - m / 25 AS score, CASE WHEN position % 3 = 0 THEN 1.0 WHEN position % 3 = 1 THEN 0.5 ELSE 0.0 END AS sim, m FROM a)
SELECT request, arg_max(position, struct_pack(s := score, p := -position)) AS id, round(max(score), 6) AS score FROM n WHERE sim >= 0.3 OR m <= 250 GROUP BY request""")
def best_candidate(spark, d):
    """The best place candidate of each request by name and distance, the first of equal ones."""
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, "Alt Hafen").when(k % 3 == 1, "Alt Markt").otherwise("Neu Tor")
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("request"), k.alias("position"), k.alias("id"), name.alias("name"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), (k * 31 % 1500).cast("double").alias("distance"))
    wanted = c.select("request").distinct().select("request", F.lit("alt hafen").alias("name"), F.lit(53.5).alias("lat"), F.lit(10.0).alias("lon"))
    return journeys.match_places(wanted, c).select("request", "id", F.round("score", 6).alias("score"))


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS plain_differs FROM orders")
def null_safe_difference(spark, d):
    """Inequality in which null equals null."""
    k = F.col("o_orderkey")
    a = F.when(k % 2 == 0, F.lit("x"))
    b = F.when(k % 3 != 0, a).otherwise(F.when(k % 2 != 0, F.lit("y")))
    return table(spark, d, "orders").select("o_orderkey", text.differs(a, b).alias("plain_differs"))


@query("SELECT count(DISTINCT (c_mktsegment, c_nationkey)) AS keys, count(DISTINCT (c_mktsegment, c_nationkey)) AS hashes, 16 AS shortest FROM customer")
def identity_hash(spark, d):
    """Hashes that identify equal parts: as many as there are distinct parts."""
    h = text.stable_hash(F.col("c_mktsegment"), F.col("c_nationkey"))
    out = table(spark, d, "customer").agg(F.count_distinct("c_mktsegment", "c_nationkey").alias("keys"), F.count_distinct(h).alias("hashes"), F.min(F.length(h)).alias("shortest"))
    return out


@query("""WITH i AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN 'de:1:' || (10000000 + c_custkey) ELSE 'x:' || c_custkey END AS id FROM customer)
SELECT c_custkey, id AS form FROM i UNION ALL SELECT c_custkey, 'de:1:1:' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') FROM i WHERE id LIKE 'de:%'""")
def id_aliases(spark, d):
    """Each id in all its forms."""
    k = F.col("c_custkey")
    public_id = F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("de:1:"), k + 10000000)).otherwise(F.concat(F.lit("x:"), k))
    return table(spark, d, "customer").select("c_custkey", F.explode(text.id_forms(public_id)).alias("form"))


# --- categories and colours -----------------------------------------------------------

SCHOOL_LABELS = ["Gymnasium", "IGS", "Freie Waldorfschule", "Berufliches Gymnasium", "Berufsbildende Schule", "Gymnasiale Oberstufe", "Grundschule", "Stadtteilschule", "Abendgymnasium", "Schule (Gesamtschule)"]
SCHOOL_WANT = ["gymnasium", "comprehensive", "waldorf", "gymnasium", "vocational", "upper_secondary", None, "comprehensive", "upper_secondary", "comprehensive"]


def _cases(column: str, values: list) -> str:
    """A CASE over column modulo the number of values."""
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values)) + " END"


def _choice(column, values: list):
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (column % len(values) + 1).cast("int"))


@query(f"SELECT p_partkey, {_cases('p_partkey', SCHOOL_WANT)} AS category FROM part")
def school_categories(spark, d):
    """Category of school labels; unknown ones have none."""
    label = _choice(F.col("p_partkey"), SCHOOL_LABELS)
    return table(spark, d, "part").select("p_partkey", modes.school_category(text.plain_key(label, "-/")).alias("category"))


@query("""SELECT p_partkey, CASE WHEN p_partkey & 128 > 0 THEN 'vocational' WHEN p_partkey & 32 > 0 THEN 'gymnasium' WHEN p_partkey & 64 > 0 THEN 'comprehensive' WHEN p_partkey & 2048 > 0 THEN 'comprehensive' WHEN p_partkey & 1024 > 0 THEN 'comprehensive' END AS category,
  CASE WHEN p_partkey & 128 > 0 THEN 'Berufsbildende Schule' WHEN p_partkey & 32 > 0 THEN 'Gymnasium' WHEN p_partkey & 64 > 0 THEN 'Gesamtschule' WHEN p_partkey & 2048 > 0 THEN 'Gemeinschaftsschule mit Oberstufe' WHEN p_partkey & 1024 > 0 THEN 'Gemeinschaftsschule' END AS label FROM part""")
def school_bits(spark, d):
    """Category and label of coded school types, in order of their bits' rank."""
    bits = F.col("p_partkey").cast("int")
    return table(spark, d, "part").select("p_partkey", modes.school_category_of_bits(bits).alias("category"), modes.school_label_of_bits(bits).alias("label"))


STATE_TEXTS = ["Schleswig-Holstein", "hamburg", "NI", "Mecklenburg Vorpommern", "Bayern", " sh "]


@query(f"SELECT c_custkey, {_cases('c_custkey', ['SH', 'HH', 'NI', 'MV', None, 'SH'])} AS state_code FROM customer")
def state_aliases(spark, d):
    """State codes of names and codes; unknown ones have none."""
    return table(spark, d, "customer").select("c_custkey", modes.state_code(text.key_of(_choice(F.col("c_custkey"), STATE_TEXTS))).alias("state_code"))


HINT_TEXTS = ["x/schleswig-holstein/ostsee", "landsichten_schleswig_holstein", "a/niedersachsen/hamburg", "Mecklenburg-Vorpommern", "ostsee", "nordsee/hamburg"]


@query(f"SELECT c_custkey, {_cases('c_custkey', ['SH', 'SH', 'NI', 'MV', None, 'HH'])} AS state_code FROM customer")
def state_hint(spark, d):
    """States by what a source's address holds; the first hint that fits counts."""
    return table(spark, d, "customer").select("c_custkey", poi.state_of_source(F.lit("src"), _choice(F.col("c_custkey"), HINT_TEXTS)).alias("state_code"))


QUALITIES = ["official_gtfs", "stop_pair_segment", "osm_reconstructed", "osm_reconstructed_low_confidence", "stop_sequence_approximation"]


@query(f"""WITH p AS (SELECT p_partkey AS k, {_cases('p_partkey', QUALITIES)} AS q, CASE p_size % 4 WHEN 0 THEN 'BUS' WHEN 1 THEN 'TRAM' WHEN 2 THEN 'RE' ELSE 'U' END AS mode FROM part),
h AS (SELECT *, q IN ('stop_sequence_approximation', 'osm_reconstructed_low_confidence') OR (q = 'official_gtfs' AND mode NOT IN ('BUS', 'TRAM')) AS hidden FROM p)
SELECT k, NOT hidden AND q <> 'stop_pair_segment' AS shown, NOT hidden AS shown_on_rail, CASE WHEN q = 'stop_sequence_approximation' THEN '#c2410c' WHEN mode = 'BUS' THEN '#b45309' WHEN mode = 'TRAM' THEN '#7c3aed' WHEN k % 3 = 0 THEN '#123456' WHEN mode = 'RE' THEN '#2563eb' ELSE '#0ea5e9' END AS colour FROM h""")
def line_display(spark, d):
    """Whether a line is shown on the two layers, and its colour."""
    k = F.col("p_partkey")
    q = _choice(k, QUALITIES)
    mode = F.element_at(F.array(*map(F.lit, ["BUS", "TRAM", "RE", "U"])), F.col("p_size") % 4 + 1)
    return table(spark, d, "part").select(k.alias("k"), modes.geometry_visible(q, mode).alias("shown"), modes.geometry_visible(q, mode, rail_layer=True).alias("shown_on_rail"), modes.line_colour(q, mode, F.when(k % 3 == 0, "#123456")).alias("colour"))


@query("""SELECT p_partkey AS k, CASE WHEN p_partkey % 100 >= 70 AND p_partkey % 4 > 0 THEN 'osm' ELSE 'own' END AS line, CASE WHEN p_partkey % 4 = 0 THEN 'official_gtfs' WHEN p_partkey % 100 >= 70 THEN 'osm_reconstructed' WHEN p_partkey % 100 >= 45 THEN 'osm_reconstructed_low_confidence' ELSE 'official_gtfs' END AS quality FROM part""")
def display_geometry(spark, d):
    """The line to show: the match from 0.70, the own line under a doubtful label from 0.45."""
    k = F.col("p_partkey")
    line, quality = modes.display_geometry((k % 100) / F.lit(100.0), F.when(k % 4 > 0, F.lit("osm")), F.lit("own"), F.lit("official_gtfs"))
    return table(spark, d, "part").select(k.alias("k"), line.alias("line"), quality.alias("quality"))


@query("""WITH m AS (SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'TRAM' WHEN 1 THEN 'U' WHEN 3 THEN 'BUS' WHEN 4 THEN 'FERRY' WHEN 2 THEN CASE WHEN lower(p_name) LIKE 's%' THEN 'S' WHEN lower(p_name) LIKE 're%' THEN 'RE' ELSE 'RAIL' END ELSE 'OTHER' END AS mode FROM part)
SELECT * FROM m WHERE mode IN ('BUS', 'TRAM', 'ICE', 'IC', 'EC', 'RE', 'RB', 'RAIL')""")
def layer_modes(spark, d):
    """Routes whose mode is one of the layers switched on."""
    wanted = modes.modes_of_layers(text.csv_items("bus, regional,,bus"))
    out = table(spark, d, "part").select("p_partkey", modes.mode_of(F.col("p_size") % 8, F.col("p_name")).alias("mode"))
    return out.where(modes.has_mode(F.array("mode"), wanted))


@query("""SELECT p_partkey AS k, CASE p_size % 3 WHEN 0 THEN 'Gymnasium' WHEN 1 THEN 'other' ELSE 'none' END AS label, CASE WHEN p_partkey % 5 = 0 THEN 'n/a' ELSE lpad(CAST(p_partkey % 24 AS VARCHAR), 2, '0') || ':30' END AS at, CASE WHEN p_partkey % 7 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS n FROM part""")
def labels(spark, d):
    """Labels of categories, times and counts, with what stands for missing ones."""
    k = F.col("p_partkey")
    value = F.when(F.col("p_size") % 3 == 0, "gymnasium").when(F.col("p_size") % 3 == 1, "other")
    iso = F.when(k % 5 == 0, "2026").otherwise(F.concat(F.lit("2026-07-08T"), F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":30:00")))
    return table(spark, d, "part").select(k.alias("k"), modes.label_of(value, modes.SCHOOL_LABELS, "none").alias("label"), modes.time_of(iso).alias("at"), modes.count_label(F.when(k % 7 > 0, F.col("p_size"))).alias("n"))


# --- points of interest and research ---------------------------------------------------


@query("""WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'Schule ' || c_custkey END AS name, c_custkey % 4 AS t, CASE WHEN c_custkey % 9 = 0 THEN 200 ELSE 10 END AS lon FROM customer)
SELECT 'n' || k AS source_school_id, name, CASE t WHEN 0 THEN 'gymnasium' WHEN 1 THEN 'comprehensive' WHEN 2 THEN 'upper_secondary' END AS school_category, CASE t WHEN 0 THEN 'Gymnasium' WHEN 1 THEN 'IGS' ELSE 'Kolleg' END AS school_type_label, 'Weg ' || k AS address FROM c WHERE name <> '' AND t < 3 AND lon < 180""")
def school_rows(spark, d):
    """Rows of a school source under its own column names; nameless, unknown and misplaced ones are left out."""
    k = F.col("c_custkey")
    raw = table(spark, d, "customer").select(F.concat(F.lit("n"), k).alias("Schulnummer"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("Schule "), k)).alias("Name"), _choice(k, ["Gymnasium", "IGS", "Kolleg", "Grundschule"]).alias("Schulform"), F.concat(F.lit("Weg "), k).alias("Straße"), F.when(k % 9 == 0, "200").otherwise("10").alias("Längengrad"), F.lit("53,5").alias("Breitengrad"))
    return poi.schools(raw, "schools_ni", "NI").select("source_school_id", "name", "school_category", "school_type_label", "address")


@query("""WITH c AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer)
SELECT 'p' || n AS source_place_id, 'Hof ' || min(k) AS name, 'hof' AS category FROM c WHERE k % 3 <> 1 GROUP BY n""")
def place_rows(spark, d):
    """Rows of a place source: unknown categories are left out, the first of each id stays."""
    k = F.col("c_custkey")
    raw = table(spark, d, "customer").coalesce(1).orderBy("c_custkey").select(F.concat(F.lit("p"), "c_nationkey").alias("Place-ID"), F.concat(F.lit("Hof "), k).alias("Titel"), _choice(k, ["Hof", "Schloss", ""]).alias("Kategorie"), F.lit("10.5").alias("lng"), F.lit("53.5").alias("lat"))
    return poi.places(raw, "src", "hof").select("source_place_id", "name", "category")


@query("""SELECT page_id, 'listing ' || page_id AS ext, 'https://h.example/a/hof-' || page_id || '-x' AS detail_url, 'hof ' || page_id AS name FROM pages""")
def teaser_links(spark, d):
    """Candidates of listing pages by their marked links."""
    k = F.col("page_id")
    html = F.concat(F.lit('<p><a class="big teaser-card-href" href="/a/hof-'), k, F.lit('-x" id="listing '), k, F.lit('">t</a>'))
    pages = table(spark, d, "pages").select(F.lit("landsichten_sh_a").alias("source_id"), F.concat(F.lit("https://h.example/list/"), k).alias("url"), html.alias("html"), F.lit(None).cast("string").alias("error"))
    found = research.from_listings(pages)
    return found.select(F.regexp_extract("source_url", "([0-9]+)$", 1).cast("long").alias("page_id"), F.col("source_place_id").alias("ext"), "detail_url", "name")


@query("""SELECT page_id, 'h' || page_id || '-9' AS ext, CASE WHEN page_id % 2 = 0 THEN 'Hof & Mond ' || page_id ELSE 'h' || page_id END AS name FROM pages""")
def house_links(spark, d):
    """Candidates of the second kind of listing: the link's text, else the id's words."""
    k = F.col("page_id")
    anchor = F.when(k % 2 == 0, F.concat(F.lit("<b>Hof &amp;</b> Mond "), k)).otherwise("  ")
    html = F.concat(F.lit('<a href="/x/hofdetails/ukv/house/h'), k, F.lit('-9">'), anchor, F.lit("</a>"))
    pages = table(spark, d, "pages").select(F.lit("bauernhofurlaub_ni").alias("source_id"), F.concat(F.lit("https://b.example/"), k).alias("url"), html.alias("html"), F.lit(None).cast("string").alias("error"))
    return research.from_listings(pages).select(F.regexp_extract("source_url", "([0-9]+)$", 1).cast("long").alias("page_id"), F.col("source_place_id").alias("ext"), "name")


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Landreise Unterkunft ' || page_id ELSE 'Titel ' || page_id END AS name, 'https://l.example/z' || page_id AS detail_url FROM pages UNION ALL SELECT -1, 'FETCH ERROR landreise_mv', NULL""")
def facility_blocks(spark, d):
    """Candidates of the third kind of listing, by the text around each facility; a page that failed is a row."""
    k = F.col("page_id")
    title = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("<h2> Titel "), k, F.lit("</h2>")))
    html = F.concat(title, F.lit('<a href="/z'), k, F.lit('">z</a><i data-facility-id="'), k, F.lit('"></i>'))
    pages = table(spark, d, "pages").select(F.lit("landreise_sh").alias("source_id"), F.concat(F.lit("https://l.example/"), k).alias("url"), html.alias("html"), F.lit(None).cast("string").alias("error"))
    failed = spark.createDataFrame([("landreise_mv", "https://l.example/mv", None, "timeout")], "source_id string, url string, html string, error string")
    out = research.from_listings(pages.unionByName(failed))
    return out.select(F.coalesce(F.nullif(F.regexp_extract("source_url", "([0-9]+)$", 1), F.lit("")).cast("long"), F.lit(-1)).alias("page_id"), "name", "detail_url")


def _described(spark, d):
    """Pages with structured data of several shapes, by page_id modulo 4."""
    k = F.col("page_id")
    block = lambda body: F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))
    full = F.concat(F.lit('{"@graph":[{"@type":["Hotel"],"name":"N '), k, F.lit('","address":{"streetAddress":"S 1","postalCode":"24"},"url":"/own","geo":{"latitude":"53,5","longitude":10}}]}'))
    plain = F.concat(F.lit('[{"@type":"LocalBusiness","name":"L '), k, F.lit('","address":"Weg&nbsp;2,  Ort"}]'))
    html = F.when(k % 4 == 0, block(full)).when(k % 4 == 1, block(plain)).when(k % 4 == 2, block(F.lit("{broken"))).otherwise("<p>no data</p>")
    return table(spark, d, "pages").select(F.concat(F.lit("https://d.example/"), k).alias("url"), html.alias("html"), F.concat(F.lit("Listing "), k).alias("name"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'N ' || page_id ELSE 'L ' || page_id END AS name, CASE page_id % 4 WHEN 0 THEN 'S 1 24' ELSE 'Weg 2, Ort' END AS address, CASE page_id % 4 WHEN 0 THEN 'https://d.example/own' ELSE 'https://d.example/' || page_id END AS website, CASE page_id % 4 WHEN 0 THEN 10.0::DOUBLE END AS lon, CASE page_id % 4 WHEN 0 THEN 53.5::DOUBLE END AS lat FROM pages WHERE page_id % 4 < 2""")
def json_ld(spark, d):
    """What structured data says of a lodging: name, address as parts or text, own page and position."""
    out = research.structured_data(_described(spark, d))
    return out.select(F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("page_id"), "name", "address", "website", "lon", "lat")


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'N ' || page_id WHEN 1 THEN 'L ' || page_id ELSE 'Listing ' || page_id END AS name, CASE page_id % 4 WHEN 0 THEN 'structured_detail' WHEN 1 THEN 'structured_detail_without_coords' ELSE 'listing_link' END AS confidence, page_id % 4 = 3 AS has_error FROM pages""")
def enriched(spark, d):
    """Candidates with their detail pages read; failed pages are noted, silent ones change nothing."""
    pages = _described(spark, d)
    k = F.regexp_extract("url", "([0-9]+)$", 1).cast("long")
    details = pages.select("url", F.when(k % 4 < 3, F.col("html")).alias("html"), F.when(k % 4 == 3, "gone").alias("error"))
    given = {"source_id": F.lit("landreise_sh"), "source_place_id": k.cast("string"), "name": F.col("name"), "confidence": F.lit("listing_link"), "source_url": F.lit("https://d.example/l"), "detail_url": F.col("url"), "raw": F.lit("{}")}
    kinds = dict(c.split() for c in research.CANDIDATE.split(", "))
    rows = pages.select(*(given.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()))
    out = research.enrich(rows, details)
    return out.select(F.regexp_extract("detail_url", "([0-9]+)$", 1).cast("long").alias("page_id"), "name", "confidence", F.get_json_object("raw", "$.detail_error").isNotNull().alias("has_error"))


MAPPED_NAMES = ["Ferienhof Meyer", "Bauernhof Alt", "Landhof Laden", "Bauernhof Neu", "Museum"]


@query("""WITH o AS (SELECT c_custkey AS k, c_custkey % 5 AS n, c_custkey % 3 AS t FROM customer) SELECT k, n = 0 OR (n IN (1, 3) AND t = 0) AS taken FROM o""")
def farm_objects(spark, d):
    """Whether mapped objects are farm stays by name and tags."""
    k = F.col("c_custkey")
    tags = F.when(k % 3 == 0, F.create_map(F.lit("tourism"), F.lit("guest_house"))).otherwise(F.create_map(F.lit("shop"), F.lit("milk")))
    return table(spark, d, "customer").select(k.alias("k"), research.is_farm_object(_choice(k, MAPPED_NAMES), tags).alias("taken"))


@query("""SELECT c_custkey AS k, 'way/' || c_custkey AS source_place_id, 'Ferienhof ' || c_custkey AS name, 'Dorf ' || c_custkey || ' 24' AS address, 'http://w' AS website, round(10.0 + (c_custkey % 10) / 100.0::DOUBLE, 6) AS lon, 'SH' AS state_code FROM customer WHERE c_custkey % 4 > 0""")
def mapped_candidates(spark, d):
    """Mapped ways as candidates at the mean of their valid nodes; those without any are left out."""
    k = F.col("c_custkey")
    x = F.lit(10.0) + (k % 10) / 100
    node = lambda lon, lat: F.struct(lon.cast("double").alias("lon"), F.lit(lat).cast("double").alias("lat"))
    none = F.array(node(F.lit(999.0), 999.0))
    nodes = F.when(k % 4 == 0, none).otherwise(F.array(node(x - 0.01, 54.0), node(x + 0.01, 54.2), node(F.lit(999.0), 54.0)))
    tags = F.create_map(F.lit("addr:street"), F.concat(F.lit("Dorf "), k), F.lit("addr:postcode"), F.lit("24"), F.lit("contact:website"), F.lit(" http://w "))
    # a small file is one task's unless its rows are dealt out
    dealt = table(spark, d, "customer").select("c_custkey").repartition(spark.sparkContext.defaultParallelism)
    objects = dealt.select(F.lit("way").alias("osm_type"), k.alias("osm_id"), F.concat(F.lit("Ferienhof "), k).alias("name"), tags.alias("tags"), nodes.alias("nodes"))
    out = research.from_mapped(research.mapped_objects(objects))
    return out.select(F.substring_index("source_place_id", "/", -1).cast("long").alias("k"), "source_place_id", "name", "address", "website", F.round("lon", 6).alias("lon"), "state_code")


@query("""SELECT c_custkey AS k, c_custkey % 6 IN (0, 1, 2, 5) AS relevant, CASE c_custkey % 6 WHEN 2 THEN 'Der Reiterhof x' WHEN 3 THEN '' WHEN 5 THEN 'Urlaub auf dem-Bauernhof' ELSE '' END AS found FROM customer""")
def relevance(spark, d):
    """Whether candidates are farm stays: by name if mapped, by source, or by words in nested texts."""
    k = F.col("c_custkey")
    source = _choice(k, ["osm_ferienhoefe", "bauernhofurlaub_sh", "landreise_sh", "landreise_sh", "osm_ferienhoefe", "landreise_sh"])
    name = _choice(k, ["Landhof A", "X", "X", "X", "Landhof Shop", "X"])
    raw = _choice(k, ["{}", "{}", '{"a": [{"Description": "Der Reiterhof"}, {"text": "x"}], "url": {"text": "ferienhof"}}', '{"image": {"name": "ferienhof"}, "n": "ferienhof"}', "{}", '{"reviewBody": "Urlaub auf dem-Bauernhof"}'])
    rows = table(spark, d, "customer").select(k.alias("k"), source.alias("source_id"), name.alias("name"), F.lit(None).cast("string").alias("address"), raw.alias("raw"))
    return rows.select("k", research.is_relevant(rows).alias("relevant"), research.searchable_text("raw").alias("found"))


@query("""SELECT c_custkey AS k, 'https://l.example/hof-' || c_custkey || '/' AS detail_url, CASE WHEN c_custkey % 3 = 0 THEN 'Landreise Unterkunft ' || c_custkey ELSE 'Hof ' || c_custkey END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'MV' ELSE 'SH' END AS state_code FROM customer WHERE c_custkey % 5 > 0""")
def browser_records(spark, d):
    """Browser records as candidates; those without an address are left out."""
    k = F.col("c_custkey")
    fields = F.struct(F.when(k % 5 > 0, F.concat(F.lit("https://l.example/hof-"), k, F.lit("/"))).alias("detailUrl"), F.lit("landreise_sh_schleswig-holstein").alias("sourceId"), F.when(k % 3 > 0, F.concat(F.lit(" Hof <b>"), k, F.lit("</b>"))).alias("listingText"), F.when(k % 2 == 0, "MV").otherwise("XX").alias("stateCode"))
    out = research.from_browser(table(spark, d, "customer").select(F.to_json(fields).alias("record")))
    return out.select(F.regexp_extract("detail_url", "([0-9]+)/$", 1).cast("long").alias("k"), "detail_url", "name", "state_code")


# --- feeds as files --------------------------------------------------------------------


@query("""SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'Bahnhof "Süd", Halle ' || c_custkey WHEN 1 THEN 'two' || chr(10) || 'lines ' || c_custkey ELSE c_name END AS name, 53.25::DOUBLE AS lat FROM customer""")
def csv_quotes(spark, d):
    """A file with a byte-order mark, doubled quotes and quoted line breaks, written and read back."""
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit('"Bahnhof ""Süd"", Halle '), k, F.lit('"'))).when(k % 3 == 1, F.concat(F.lit('"two\nlines '), k, F.lit('"'))).otherwise(F.col("c_name"))
    lines = table(spark, d, "customer").select(F.concat_ws(",", k, name, F.lit("53.25")).alias("value"))
    head = spark.createDataFrame([("﻿stop_id,stop_name,stop_lat",)], "value string")
    path = f"{folder(spark)}/csv-{uuid.uuid4().hex}"
    whole = head.unionByName(lines).coalesce(1).agg(F.array_join(F.collect_list("value"), "\n").alias("value"))  # one small file, as a feed's
    whole.write.text(path)
    return gtfs.read_csv(spark, path).select(F.col("stop_id").cast("long").alias("k"), F.col("stop_name").alias("name"), F.col("stop_lat").cast("double").alias("lat"))


@query("""SELECT (SELECT max(r_name) FROM region) AS feed_publisher_name, (SELECT CAST(count(*) AS VARCHAR) FROM region) AS feed_version,
  min(strftime(o_orderdate, '%Y%m%d')) FILTER (WHERE o_orderstatus <> 'P') AS valid_from, max(strftime(o_orderdate, '%Y%m%d')) FILTER (WHERE o_orderstatus <> 'F') AS valid_until FROM orders""")
def feed_span(spark, d):
    """The row of feed_info with the span of the calendar, where some dates are blank or missing."""
    info = table(spark, d, "region").agg(F.max("r_name").alias("feed_publisher_name"), F.count(F.lit(1)).cast("string").alias("feed_version"))
    day = F.date_format("o_orderdate", "yyyyMMdd")
    days = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "P", " ").otherwise(day).alias("start_date"), F.when(F.col("o_orderstatus") != "F", day).alias("end_date"))
    return gtfs.feed_info({"feed_info": info, "calendar": days})


# --- statistics, runs and places --------------------------------------------------------


@query(f"""WITH {SAMPLES} SELECT destination, count(*) FILTER (WHERE total >= 0) AS reachable_count, CAST(median(total) FILTER (WHERE total >= 0) AS DOUBLE) AS median_s FROM samples GROUP BY destination""")
def ungated_median(spark, d):
    """Statistics with the median of every destination."""
    s = metrics.travel_time_statistics(samples(spark, d), ["destination"], gate_median=False)
    return s.select("destination", "reachable_count", F.col("median_s").cast("double").alias("median_s"))


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey AS profile, o_orderdate AS done FROM orders), latest AS (SELECT profile, arg_max(id, struct_pack(d := done, i := id)) AS run FROM r GROUP BY profile)
SELECT profile, count(l_linenumber) AS rows, coalesce(sum(l_linenumber), 0)::BIGINT AS total FROM latest LEFT JOIN lineitem ON l_orderkey = run GROUP BY profile""")
def latest_metrics(spark, d):
    """Metric rows of the latest run of each profile; runs without rows stay."""
    runs = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("profile")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("b")).select("profile", F.col("b.o_orderkey").alias("l_orderkey"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_linenumber").cast("long")).alias("t"))
    return runs.join(rows, "l_orderkey", "left").select("profile", F.coalesce("n", F.lit(0)).alias("rows"), F.coalesce("t", F.lit(0)).alias("total"))


@query("""WITH m AS (SELECT l_suppkey AS s, l_linenumber AS fastest_s, l_shipdate AS computed, l_orderkey AS run FROM lineitem WHERE l_suppkey = 7)
SELECT CAST(fastest_s AS INTEGER) AS fastest_s, run FROM m ORDER BY computed DESC, run, fastest_s LIMIT 1""")
def stop_metrics(spark, d):
    """The latest metric row of one stop."""
    li = table(spark, d, "lineitem")
    rows = li.select(F.col("l_suppkey").cast("string").alias("destination"), F.lit("p").alias("profile"), F.col("l_linenumber").alias("fastest_s"), F.col("l_shipdate").alias("computed_at"), F.col("l_orderkey").alias("run"))
    rows = rows.withColumn("metric_run_id", F.concat_ws("-", F.lpad(F.col("run").cast("string"), 12, "0"), "fastest_s"))
    t = api.Tables({"od_metrics": rows})
    return api.stop_metrics(t, "7", "p").select("fastest_s", "run")


@query("""SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 7 > 0 AND (c_name ILIKE '%00_1%' OR coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'weg 5' END, '') ILIKE '%00_1%') AND c_mktsegment = 'BUILDING' ORDER BY c_name, c_custkey LIMIT 100""")
def list_places(spark, d):
    """Places by name or address and category, deleted ones left out, in order of name."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "weg 5").alias("address"), F.col("c_mktsegment").alias("category"), F.lit("SH").alias("state_code"), F.when(F.col("c_custkey") % 7 == 0, F.lit("2024-01-01").cast("timestamp")).alias("deleted_at"))
    return api.list_places(api.Tables({"places": c}), "00_1", ["BUILDING"]).select("id", "name")


@query("""SELECT count(*) + 1 AS places, count(*) FILTER (WHERE c_custkey = 5) AS deleted, 'Hof Neu' AS made, CAST(NULL AS VARCHAR) AS cleared, (SELECT c_name FROM customer WHERE c_custkey = 6) AS kept FROM customer""")
def place_changes(spark, d):
    """A place made, one changed and one deleted: a cleared address is null, a null name keeps the old one."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.lit("hof").alias("category"), F.lit("SH").alias("state_code"), F.lit("weg").alias("address"), F.lit(None).cast("string").alias("website"), F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"), F.lit(None).cast("timestamp").alias("deleted_at"))
    more, new = api.create_place(c, {"name": "Hof Neu", "category": "gut", "lon": 10, "lat": 53.5, "id": "new"})
    out = api.delete_place(api.update_place(more, "6", {"name": None, "address": None}), "5", F.lit("2024-06-01").cast("timestamp"))
    six = F.col("id") == "6"
    return out.agg(F.count(F.lit(1)).alias("places"), F.count_if(F.col("deleted_at").isNotNull()).alias("deleted"), F.max(F.when(F.col("id") == "new", F.col("name"))).alias("made"), F.max(F.when(six, F.col("address"))).alias("cleared"), F.max(F.when(six, F.col("name"))).alias("kept"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey = 3 THEN 'completed' WHEN o_orderstatus = 'O' THEN 'failed' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey = 3 THEN '{"a":"1","b":"9"}' ELSE '{"a":"1","b":"2"}' END AS configuration FROM orders""")
def finish_run(spark, d):
    """One run completes with its report merged in; others that still run become failed."""
    o = table(spark, d, "orders")
    conf = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    runs = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise(F.col("o_orderstatus")).alias("status"), F.lit(None).cast("timestamp").alias("completed_at"), conf.alias("configuration"))
    out = metrics_run.finished(runs, 3, True, F.create_map(F.lit("b"), F.lit("9")), F.lit("2024-01-01").cast("timestamp"))
    return out.select("id", "status", F.to_json("configuration").alias("configuration"))


@query("""WITH a AS (SELECT l_orderkey AS sample, 'q' || s_nationkey AS place, l_quantity AS seconds, l_linenumber AS legs, l_partkey AS position FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal >= 0),
b AS (SELECT sample, place, min(struct_pack(s := seconds, p := position, l := legs)) AS x FROM a WHERE seconds <= 30 GROUP BY ALL)
SELECT 'q' || n_nationkey AS destination, count(sample) AS reachable_count, min(x.s) AS fastest_s, count(*) FILTER (WHERE x.l <= 1) AS direct_count, 'run' AS metric_run_id FROM nation LEFT JOIN b ON place = 'q' || n_nationkey WHERE n_name <> 'JAPAN' GROUP BY n_nationkey""")
def metric_rows(spark, d):
    """A metric run's rows: best arrival of each sample and place, stops without a place left out, every target a row."""
    li = table(spark, d, "lineitem")
    reached = li.select(F.col("l_orderkey").alias("sample"), F.col("l_suppkey").cast("string").alias("stop"), F.col("l_quantity").alias("seconds"), F.col("l_linenumber").alias("legs"), F.col("l_partkey").alias("position"))
    stops = table(spark, d, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").cast("string").alias("stop_id"), F.concat(F.lit("q"), "s_nationkey").alias("stop_place_id"))
    places_ = table(spark, d, "nation").select(F.concat(F.lit("q"), "n_nationkey").alias("public_id"), F.when(F.col("n_name") == "JAPAN", "BY").otherwise("SH").alias("state_code"), F.lit(True).alias("is_display_stop"))
    profile = metrics_run.Profile("p", ["2026-07-08"], 0, 3600, 300, 30)
    out = metrics_run.metric_rows(reached, stops, metrics_run.targets(places_, ["SH"]), profile, "run", "o", 12)
    return out.select("destination", "reachable_count", "fastest_s", "direct_count", "metric_run_id")


@query("""WITH d AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders), n AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM d)
SELECT date, CAST(s AS INTEGER) AS sample, CAST(i * 12 + s // 300 AS INTEGER) AS position FROM n, range(0, 3600, 300) r(s)""")
def sample_times(spark, d):
    """Departures of a profile over all days that orders were placed, numbered in order."""
    days = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).distinct().collect()  # days of a few years
    return metrics_run.sample_times(spark, metrics_run.Profile("p", [r.day for r in days], 0, 3600, 300, 30))


@query("""SELECT l_orderkey AS sample, 'scan' AS engine, '1' AS version, count(DISTINCT l_suppkey) AS reachable FROM lineitem GROUP BY l_orderkey""")
def sample_log(spark, d):
    """Lines of a run's raw log: what each sample reached."""
    return metrics_run.sample_log(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample"), F.col("l_suppkey").alias("stop")), "scan", "1")


@query("""SELECT min(CAST(o_orderdate AS DATE))::VARCHAR AS valid_from, max(CAST(o_orderdate AS DATE))::VARCHAR AS valid_until, (SELECT count(*) FROM orders) AS rows FROM orders WHERE o_orderkey % 3 > 0""")
def service_validity(spark, d):
    """First and last active service day, and the number of all rows."""
    dates = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("service_date"), (F.col("o_orderkey") % 3 > 0).alias("is_active"))
    return calendar.validity(dates).select(F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_until").cast("string").alias("valid_until"), "rows")


@query("""SELECT 'snap' AS snapshot_id, o_orderkey AS service_id, strftime(o_orderdate, '%Y-%m-%d') AS service_date, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS is_active, 'calendar' AS source FROM orders""")
def dates_to_load(spark, d):
    """Service dates as the rows of their load file, under a snapshot's id."""
    dates = table(spark, d, "orders").select(F.col("o_orderkey").alias("service_id"), F.col("o_orderdate").cast("date").alias("service_date"), (F.col("o_orderkey") % 2 == 0).alias("is_active"), F.lit("calendar").alias("source"))
    return normalise.prefixed_dates(dates, "snap")


@query("""SELECT c_mktsegment AS source, c_custkey AS id FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')""")
def replaced_sources(spark, d):
    """Rows that stay when two sources are brought anew."""
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("source"), F.col("c_custkey").alias("id"))
    return store.drop_sources(c, c.where("source in ('BUILDING', 'MACHINERY')"), "source")


# --- shapes, distances and tiles --------------------------------------------------------


@query(f"""WITH {ST}, p AS (SELECT l_orderkey AS shape_id, l_linenumber AS o, CASE WHEN l_suppkey % 50 > 0 THEN CAST(l_partkey AS DOUBLE) END AS dist FROM st),
s AS (SELECT shape_id, count(*) AS n, arg_max(coalesce(dist, -1), o) AS b, arg_min(coalesce(dist, -1), o) AS a FROM p GROUP BY shape_id HAVING count(*) >= 2)
SELECT shape_id, CAST(n AS INTEGER) AS points, CASE WHEN a >= 0 AND b >= a THEN b - a END AS distance FROM s""")
def shape_distance(spark, d):
    """Points of shapes in order and the distance their feed gives, null where it falls or is missing."""
    t = store.first_wins(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"])
    raw = t.select(F.col("l_orderkey").alias("shape_id"), F.col("l_linenumber").cast("string").alias("shape_pt_sequence"), F.lit("10.5").alias("shape_pt_lon"), F.lit("53.5").alias("shape_pt_lat"), F.when(F.col("l_suppkey") % 50 > 0, F.col("l_partkey").cast("string")).alias("shape_dist_traveled"))
    return normalise.shape_lines(raw).select("shape_id", F.size("points").alias("points"), "distance")


@query(f"""WITH {PLACES} SELECT id, round(sqrt(power((lon + 0.05 - lon) * 111320.0 * cos(radians((lat + lat + 0.02) / 2)), 2) + power(0.02 * 111320.0, 2)), 3) AS flat_m,
  round(radians(lon) * 6378137.0, 3) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 3) AS y FROM places""")
def plane_distances(spark, d):
    """Distances on a local plane, and places on the Mercator map."""
    x, y = geo.mercator(F.col("lon"), F.col("lat"))
    flat = geo.flat_m(F.col("lon"), F.col("lat"), F.col("lon") + 0.05, F.col("lat") + 0.02)
    return places(spark, d).select("id", F.round(flat, 3).alias("flat_m"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(f"""WITH {PLACES}, t AS (SELECT DISTINCT CAST(z AS INTEGER) AS z, 2 * 20037508.342789244 / power(2.0, z) AS size, lon, lat FROM places, range(0, 12) a(z)),
i AS (SELECT DISTINCT z, size, CAST(floor((radians(lon) * 6378137.0 + 20037508.342789244) / size) AS INTEGER) AS x, CAST(floor((20037508.342789244 - ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0) / size) AS INTEGER) AS y FROM t)
SELECT z, x, y, round(x * size - 20037508.342789244, 3) AS west, round(20037508.342789244 - y * size - size, 3) AS south, round(x * size - 20037508.342789244 - size * (96.0 / 2048), 3) AS west_wide FROM i""")
def tile_envelopes(spark, d):
    """Tiles that hold a place at each zoom, with their bounds, and the west one with the margin."""
    z = F.col("z")
    at = places(spark, d).select("lon", "lat", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("z"))
    x, y = geo.tile_of(F.col("lon"), F.col("lat"), z)
    held = at.select("z", x.alias("x"), y.alias("y")).distinct()
    plain, wide = (geo.tile_envelope(z, F.col("x"), F.col("y"), b) for b in (0.0, geo.BUFFER / geo.EXTENT))
    return held.select("z", "x", "y", F.round(plain["west"], 3).alias("west"), F.round(plain["south"], 3).alias("south"), F.round(wide["west"], 3).alias("west_wide"))


@query(f"""WITH {PLACES} SELECT count(*) AS inside FROM places WHERE lon BETWEEN {geo.tile_degrees(7, 67, 41)[0]!r} AND {geo.tile_degrees(7, 67, 41)[2]!r} AND lat BETWEEN {geo.tile_degrees(7, 67, 41)[1]!r} AND {geo.tile_degrees(7, 67, 41)[3]!r}""")
def points_in_tile(spark, d):
    """Places within a tile and its margin."""
    box = geo.tile_degrees(7, 67, 41)
    return places(spark, d).where(geo.in_box(F.col("lon"), F.col("lat"), box)).agg(F.count(F.lit(1)).alias("inside"))


@query("""SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'EMPTY' WHEN 1 THEN 'LINESTRING' ELSE 'MULTILINESTRING' END AS kind, CASE c_custkey % 3 WHEN 2 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS parts FROM customer""")
def line_parts(spark, d):
    """Lines of ways with parts that follow each other joined, and what the geometry is."""
    k = F.col("c_custkey")
    p = lambda x: F.struct((k + x).cast("double").alias("lon"), F.lit(53.0).alias("lat"))
    a, b, c = F.array(p(0), p(1)), F.array(p(1), p(2)), F.array(p(5), p(6))
    parts = F.when(k % 3 == 0, F.array(F.array(p(0)))).when(k % 3 == 1, F.array(a, b)).otherwise(F.array(a, b, c))
    ways = table(spark, d, "customer").select(k.alias("id"), parts.alias("parts"))
    merged = rail.way_parts(ways).groupBy("id").agg(F.collect_list("line").alias("lines"))
    both = ways.join(merged, "id", "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<array<struct<lon:double,lat:double>>>")))
    return both.select(F.col("id").alias("k"), geo.geometry_kind(F.col("lines")).alias("kind"), F.size("lines").alias("parts"))


@query(f"""WITH {PLACES} SELECT id, round(6371008.8::DOUBLE * 6371008.8::DOUBLE * radians(0.1::DOUBLE) * abs(sin(radians(lat + 0.1)) - sin(radians(lat))) / 1e6, 1) AS km2 FROM places""")
def ring_areas(spark, d):
    """Area on the sphere of a box of a tenth of a degree at each place."""
    at = lambda dx, dy: F.struct((F.col("lon") + dx).alias("lon"), (F.col("lat") + dy).alias("lat"))
    ring = F.array(at(0.0, 0.0), at(0.1, 0.0), at(0.1, 0.1), at(0.0, 0.1), at(0.0, 0.0))
    return places(spark, d).select("id", F.round(geo.ring_area_m2(ring) / 1e6, 1).alias("km2"))


@query("""SELECT count(*) AS circles, 33 AS corners FROM supplier WHERE s_suppkey % 3 < 2 AND s_suppkey % 5 > 0""")
def residential_radius(spark, d):
    """Circles around visible stops of trains, each stop once."""
    s = places(spark, d, "supplier")
    k = F.col("s_suppkey")
    stops = s.select(k.alias("public_id"), "lon", "lat", _choice(k, ["regional", "urban_rail", "bus_only"]).alias("stop_priority"), (k % 5 > 0).alias("visible"))
    out = geo.residential_circles(stops.unionByName(stops), 10)
    return out.agg(F.count(F.lit(1)).alias("circles"), F.max(F.size("ring")).alias("corners"))


# --- journeys ---------------------------------------------------------------------------


@query("""WITH c AS (SELECT conv_id AS k FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT k, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS transfers, CASE WHEN k % 2 = 0 THEN 3000 ELSE 1800 END + 0::BIGINT AS in_vehicle_s, CASE WHEN k % 3 = 0 THEN 300 END + 0::BIGINT AS walk_s, 600 + 0::BIGINT AS initial_wait_s, CASE WHEN k % 3 = 0 THEN 250.0 ELSE 0.0 END + 0.0::DOUBLE AS walk_m, k % 5 = 0 AS cancelled, 't,s,c' AS remarks FROM c""")
def live_journeys(spark, d):
    """Journey documents as itineraries: legs without time left out, sums null where no leg has a value."""
    k = F.col("conv_id")
    ride = lambda a, b, extra="": f'{{"line":{{"name":"RE"}},"departure":"2026-07-08T{a}:00+00:00","arrival":"2026-07-08T{b}:00+00:00","remarks":[{{"text":"t"}},{{"summary":"s"}},{{"code":"c"}}]{extra}}}'
    first, second = F.lit(ride("08:10", "08:40")), F.lit(',{"line":{"name":"U"},"plannedDeparture":"2026-07-08T08:50:00+00:00","plannedArrival":"2026-07-08T09:10:00+00:00"}')
    gone = F.when(k % 5 == 0, F.lit(',{"walking":false,"cancelled":true,"departure":"2026-07-08T09:30:00+00:00"}')).otherwise("")
    walk = F.when(k % 3 == 0, F.lit(',{"walking":true,"distance":250.0,"departure":"2026-07-08T09:10:00+00:00","arrival":"2026-07-08T09:15:00+00:00"}')).otherwise("")
    body = F.concat(F.lit('{"refreshToken":"r","legs":['), first, F.when(k % 2 == 0, second).otherwise(""), walk, gone, F.lit(',{"walking":true}]}'))
    rows = table(spark, d, "conversations").select("conv_id").distinct().withColumn("doc", body)
    out = journeys.itineraries(rows, "doc", F.lit("2026-07-08T08:00:00+00:00"))
    return out.select(k.alias("k"), "transfers", "in_vehicle_s", "walk_s", "initial_wait_s", "walk_m", "cancelled", F.array_join("remarks", ",").alias("remarks"))


@query("""SELECT conv_id AS k, s AS sequence, CASE s WHEN 1 THEN 'transit' ELSE 'transfer' END AS leg_type, CASE s WHEN 1 THEN 'RE 7' END AS route_name, CASE s WHEN 1 THEN 1800 ELSE 600 END + 0::BIGINT AS duration_s, CASE s WHEN 1 THEN 120 ELSE 0 END + 0::BIGINT AS departure_delay_s, CASE s WHEN 1 THEN '3' END AS platform_from, s = 2 AND conv_id % 2 = 0 AS cancelled FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES (1), (2)) v(s)""")
def provider_sections(spark, d):
    """Sections of the second provider's journeys: local times, delays, platforms; one without time is left out."""
    k = F.col("conv_id")
    first = '{"startHalt":{"name":"A","abfahrt":{"sollzeit":"2026-07-08T08:00:00","echtzeit":"2026-07-08T08:02:00"}},"zielHalt":{"ankunft":{"sollzeit":"2026-07-08T08:32:00"}},"verkehrsmittel":{"kategorie":"RE","nummer":"7"},"halte":[{"gleis":"3"},{"gleis":"5"}]}'
    second = F.concat(F.lit(',{"startHalt":{"abfahrt":{"sollzeit":"2026-07-08T08:40:00"}},"abschnittsDauer":600,"verkehrsmittel":{},"destinationCancelled":'), F.when(k % 2 == 0, "true").otherwise("false"), F.lit("}"))
    body = F.concat(F.lit('{"ctxRecon":"x","verbindungsAbschnitte":['), F.lit(first), second, F.lit(',{"startHalt":{"name":"B"}}]}'))
    rows = table(spark, d, "conversations").select("conv_id").distinct().withColumn("doc", body)
    out = journeys.sections(rows, "doc")
    return out.select(k.alias("k"), "sequence", "leg_type", "route_name", "duration_s", "departure_delay_s", "platform_from", "cancelled")


@query("""SELECT conv_id AS k, CAST(r AS INTEGER) AS rank, CASE r WHEN 0 THEN 'earliest_arrival' ELSE 'fewest_transfers' END AS kind, 3600 + r * 60 + 0::BIGINT AS duration_s, 120 + 0::BIGINT AS initial_walk_s, 480 + r * 60 + 0::BIGINT AS initial_wait_s, 1800 + 0::BIGINT AS in_vehicle_s, 420 + 0::BIGINT AS walk_s, CASE WHEN r = 1 THEN 5 ELSE 0 END AS transfers FROM (SELECT DISTINCT conv_id FROM conversations), range(4) v(r)""")
def planned_options(spark, d):
    """Options of a planner's answer with derived waits, the first four."""
    option = lambda r: (
        f'{{"endTime":"2026-07-08T09:{r:02d}:00Z"' + (',"transfers":5' if r == 1 else "") + ',"legs":[{"mode":"WALK","duration":120,"distance":90.0},'
        f'{{"mode":"RE","startTime":"2026-07-08T08:{10 + r}:00Z","duration":1800}},{{"mode":"WALK","duration":300}}]}}'
    )
    body = '{"itineraries":[' + ",".join(option(r) for r in range(6)) + "]}"
    rows = table(spark, d, "conversations").select("conv_id").distinct().withColumn("doc", F.lit(body))
    out = journeys.planned_options(rows, "doc", F.lit("2026-07-08T08:00:00Z"))
    return out.select(F.col("conv_id").alias("k"), "rank", "kind", "duration_s", "initial_walk_s", "initial_wait_s", "in_vehicle_s", "walk_s", "transfers")


@query("""SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'nearby' WHEN 2 THEN 'named' ELSE 'unmapped' END AS how, CASE c_custkey % 4 WHEN 0 THEN CAST(8000000 + c_custkey AS VARCHAR) WHEN 1 THEN 'n' || c_custkey WHEN 2 THEN 'm' || c_custkey END AS location FROM customer""")
def stop_resolution(spark, d):
    """The provider's id of stops: their own number, else nearby, else by name, else none."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    public = F.when(k % 4 == 0, F.concat(F.lit("de:"), k + 8000000)).otherwise(F.concat(F.lit("x"), k))
    stops = c.select(public.alias("public_id"), F.lit("Alt Hafen").alias("name"), F.lit(53.5).alias("lat"), F.lit(10.0).alias("lon"))
    found = lambda prefix, rest, meters: c.where(k % 4 == rest).select(public.alias("request"), F.lit(0).alias("position"), F.concat(F.lit(prefix), k).alias("id"), F.lit("Alt Hafen").alias("name"), F.lit(53.5).alias("lat"), F.lit(10.0).alias("lon"), F.lit(meters).cast("double").alias("distance"))
    out = journeys.resolved_stops(stops, found("n", 1, 100), found("m", 2, None))
    return c.select(k.alias("k"), public.alias("public_id")).join(out, "public_id").select("k", "how", "location")


@query("""SELECT c_custkey AS k, CAST((c_custkey * 3) % 60 + 360 AS INTEGER) AS earliest, CAST((c_custkey * 3) % 60 + 420 AS INTEGER) AS latest FROM customer""")
def departure_spans(spark, d):
    """Earliest and latest minute of alternative departures; malformed ones are left out."""
    k = F.col("c_custkey")
    minute = F.lpad((k * 3 % 60).cast("string"), 2, "0")
    options = F.array(F.concat(F.lit("7:"), minute), F.lit("soon"), F.concat(F.lit("06:"), minute))
    return table(spark, d, "customer").select(k.alias("k"), times.departure_span(options).alias("s")).select("k", "s.earliest", "s.latest")


@query(f"""WITH {PLACES} SELECT id, round(1.3 * 2 * 6371008.8 * asin(sqrt(power(sin(radians(0.1::DOUBLE) / 2), 2))), 2) AS meters, round(1.3 * 2 * 6371008.8 * asin(sqrt(power(sin(radians(0.1::DOUBLE) / 2), 2))) / (70.0 / 3.6), 2) AS seconds FROM places""")
def drive_estimate(spark, d):
    """Estimated drives of a tenth of a degree north."""
    m, s = routing.estimated_drive(F.col("lon"), F.lit(53.0), F.col("lon"), F.lit(53.1))
    return places(spark, d).select("id", F.round(m, 2).alias("meters"), F.round(s, 2).alias("seconds"))


@query("""SELECT event_type, CAST(count(DISTINCT user_id || ':' || strftime(ts, '%Y-%m-%dT%H:%M')) AS BIGINT) AS keys FROM events GROUP BY event_type""")
def minute_keys(spark, d):
    """Answers that a cache keyed by user and minute would hold, by event type."""
    from tramline.streaming.samples import minute_key

    key = minute_key(F.col("ts").cast("timestamp"), F.col("user_id").cast("string"))
    return table(spark, d, "events").groupBy("event_type").agg(F.count_distinct(key).alias("keys"))


@query("""SELECT l_orderkey AS pattern_id, count(*) AS n FROM (SELECT l_orderkey, l_linenumber, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nxt FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_linenumber, l_suppkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey) ORDER BY l_orderkey, l_linenumber LIMIT 500) WHERE nxt IS NOT NULL GROUP BY l_orderkey""")
def limited_segments(spark, d):
    """Segments of the first 500 stops in order of pattern: the limit counts stops, after each has found its next."""
    t = stop_times(spark, d)
    calls = t.select(F.col("trip_id").alias("pattern_id"), "stop_sequence", F.col("stop").alias("stop_place_id"))
    stops = places(spark, d, "supplier").select(F.col("s_suppkey").alias("public_id"), "lon", "lat")
    snaps = stops.limit(0).select("public_id", F.lit(1).alias("vertex"), F.lit(1.0).alias("distance_m"), F.lit(1).alias("rank"))
    return rail.pattern_segments(calls, snaps, stops, 500).groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 's' || o_orderkey AS public_id, n_name AS source_key, upper(n_name) || '!' AS source_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)""")
def live_snapshot(spark, d):
    """The live one of as many snapshots as there are orders, with its source, and none other."""
    source = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("source_key"))
    orders = table(spark, d, "orders")
    last = orders.agg(F.max("o_orderkey").alias("last"))
    control = orders.join(source, "o_custkey", "left").crossJoin(F.broadcast(last))  # one row
    live = F.col("o_orderkey") == F.col("last")
    control = control.select(F.concat(F.lit("s"), "o_orderkey").alias("public_id"), F.when(live, "active").otherwise("archived").alias("status"), live.alias("is_active"), "source_key", F.col("o_orderdate").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_until"), F.lit("{}").alias("quality_report"))
    sources = table(spark, d, "nation").select(F.col("n_name").alias("source_key"), F.concat(F.upper("n_name"), F.lit("!")).alias("name"), F.lit("l").alias("license"), F.lit("a").alias("attribution"))
    t = api.Tables({"snapshots": control, "sources": sources})
    chosen = api.snapshot_of(t).select("public_id")
    return api.current_snapshot(t).join(chosen, "public_id").select("public_id", "source_key", "source_name")


@query("""SELECT c_custkey AS pattern_id FROM customer WHERE c_custkey % 3 = 0 OR c_mktsegment <> 'BUILDING'""")
def matches_kept(spark, d):
    """Matches that stay when the patterns of one selection are matched anew."""
    c = table(spark, d, "customer")
    patterns = c.select(F.col("c_custkey").alias("pattern_id"), F.concat(F.lit("r"), F.col("c_custkey") % 3).alias("route_id"), F.lit(None).cast("array<struct<lon:double,lat:double>>").alias("line"), F.col("c_mktsegment").alias("seg"))
    routes = spark.createDataFrame([("r0", "RB", None, "BUS"), ("r1", "RE1", None, "RE"), ("r2", "", "RE1", "RE")], "route_id string, short_name string, long_name string, mode string")
    chosen = rail.selected_patterns(patterns, routes, ["RE"], "RE1, RE9").where("seg = 'BUILDING'")
    return rail.without(c.select(F.col("c_custkey").alias("pattern_id")), chosen)


@query("""WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events), g AS (SELECT user_id, s, s - lag(s) OVER (PARTITION BY user_id ORDER BY s) AS gap FROM e)
SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n, min(s) AS first_s, max(s) AS last_s, max(gap) AS max_gap_s FROM g GROUP BY user_id""")
def stream_gaps(spark, d):
    """A stream of events, read at once: how often each user came, from when to when, and the widest gap."""
    from tramline.streaming.samples import gaps, run_once

    path = f"{folder(spark)}/events-{uuid.uuid4().hex}"
    table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(path)
    name = f"gaps_{uuid.uuid4().hex}"
    return run_once(gaps(stream, "user_id", "ts", "10000 days"), name, f"{folder(spark)}/{name}", "update")


@query("""SELECT count(*) AS n, sum(event_id)::BIGINT AS total FROM events""")
def stream_log(spark, d):
    """A stream's rows written as compressed lines by micro-batch, read back."""
    from tramline.streaming.samples import log_samples

    base = f"{folder(spark)}/log-{uuid.uuid4().hex}"
    table(spark, d, "events").select("event_id").write.parquet(f"{base}/in")
    log_samples(spark.readStream.schema("event_id long").parquet(f"{base}/in"), f"{base}/out", f"{base}/state").awaitTermination()
    out = spark.read.schema("event_id long").json(f"{base}/out")
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("total"))



@query("""SELECT c_custkey AS osm_id, CASE WHEN c_custkey % 3 = 0 THEN 'node' ELSE 'way' END AS osm_type, 'Hof ' || c_custkey AS name, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS nodes FROM customer WHERE c_custkey % 3 < 2 AND c_custkey % 5 > 0""")
def map_objects(spark, d):
    """Named nodes and ways of an extract written and read back; relations and nameless ones are left out."""
    from tramline.sources import osm

    k = F.col("c_custkey")
    at = lambda x: F.struct((k % 90 + x).cast("double").alias("lon"), F.lit(53.0).alias("lat"))
    tags = F.when(k % 5 > 0, F.create_map(F.lit("name"), F.concat(F.lit(" Hof "), k))).otherwise(F.create_map(F.lit("shop"), F.lit("x")))
    kind = F.when(k % 3 == 0, "node").when(k % 3 == 1, "way").otherwise("relation")
    rows = table(spark, d, "customer").select(kind.alias("osm_type"), k.alias("osm_id"), F.lit(10.0).alias("lon"), F.lit(53.0).alias("lat"), tags.alias("tags"), F.when(k % 3 == 1, F.array(at(0), at(1))).alias("nodes"))
    path = f"{folder(spark)}/objects-{uuid.uuid4().hex}"
    rows.write.json(path)
    return osm.read_objects(spark, path).select("osm_id", "osm_type", "name", F.size("nodes").alias("nodes"))


@query("""SELECT p_partkey AS id, 2 AS parts FROM part WHERE p_partkey % 2 = 0""")
def map_lines(spark, d):
    """Railway lines of a Parquet extract; those without two points are left out."""
    from tramline.sources import osm

    k = F.col("p_partkey")
    p = lambda x: F.struct((k + x).cast("double").alias("lon"), F.lit(53.0).alias("lat"))
    parts = F.when(k % 2 == 0, F.array(F.array(p(0), p(1)), F.array(p(3), p(4)))).otherwise(F.array(F.array(p(0))))
    path = f"{folder(spark)}/lines-{uuid.uuid4().hex}.parquet"
    table(spark, d, "part").select(k.alias("osm_id"), F.create_map(F.lit("railway"), F.lit("rail")).alias("tags"), parts.alias("parts")).write.parquet(path)
    return osm.read_lines(spark, path).select("id", F.size("parts").alias("parts"))
