"""Transport modes, colours and categories: ordered rules as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mode groups of the map layers and their members.
LAYERS = {"regional": ["ICE", "IC", "EC", "RE", "RB", "RAIL"], "s-bahn": ["S", "AKN"], "u-bahn": ["U"], "bus": ["BUS", "TRAM"]}
RAIL_MODES = [*LAYERS["regional"], *LAYERS["s-bahn"], *LAYERS["u-bahn"]]
#: Longest stop-pair line that a tile shows, in metres.
LINE_CAPS = {"U": 8000, "S": 15000, "AKN": 15000}
LINE_CAP = 20000
#: Travel-time bands in minutes.
BANDS = (30, 45, 60, 75, 90)
NOTHING = "__none__"


def mode_of(route_type: Column, short_name: Column) -> Column:
    """Mode of a route from its type number and short name; the first rule that fits counts."""
    name = F.coalesce(short_name, F.lit(""))
    heavy = (route_type == 2) | route_type.between(100, 199)
    starts = lambda p: name.rlike(f"(?i)^({p})")
    return (
        F.when((route_type == 0) | route_type.between(900, 999), "TRAM")
        .when((route_type == 1) | route_type.between(400, 405), "U")
        .when(heavy & starts("ICE|IC|EC"), "ICE")
        .when(heavy & starts("S"), "S")
        .when(heavy & starts("RE"), "RE")
        .when(heavy & starts("RB"), "RB")
        .when(heavy, "RAIL")
        .when((route_type == 3) | route_type.between(700, 799), "BUS")
        .when((route_type == 4) | (route_type == 1000), "FERRY")
        .when(route_type.between(1500, 1599), "TAXI")
        .otherwise("OTHER")
    )


def _any(modes: Column, wanted: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(modes, F.array(*map(F.lit, wanted))), F.lit(False))


def is_bus_only(modes: Column) -> Column:
    """Some mode, and none beside bus and tram; an empty list is not."""
    return _any(modes, LAYERS["bus"]) & (F.size(F.array_except(modes, F.array(*map(F.lit, LAYERS["bus"])))) == 0)


def stop_priority(modes: Column) -> Column:
    return F.when(_any(modes, LAYERS["regional"]), "regional").when(_any(modes, [*LAYERS["s-bahn"], *LAYERS["u-bahn"]]), "urban_rail").when(is_bus_only(modes), "bus_only").otherwise("other")


def modes_of_layers(layers: list[str]) -> list[str]:
    """The modes of the layers switched on, each once; a value that matches no stop if there are none."""
    out = list(dict.fromkeys(m for x in layers for m in LAYERS.get(x, [])))
    return out or [NOTHING]


def has_mode(modes: Column, wanted: list[str]) -> Column:
    """Overlap with a list; an empty list filters nothing."""
    return F.arrays_overlap(modes, F.array(*map(F.lit, wanted))) if wanted else F.lit(True)


def colour(value: Column) -> Column:
    """``#RRGGBB`` from six hex digits with or without hash, else null."""
    return F.when(value.rlike("^#?[0-9A-Fa-f]{6}$"), F.concat(F.lit("#"), F.right(value, F.lit(6))))


def line_cap(mode: Column) -> Column:
    out = F.lit(LINE_CAP)
    for m, cap in LINE_CAPS.items():
        out = F.when(mode == m, cap).otherwise(out)
    return out


def band_of(seconds: Column) -> Column:
    """Upper bound in minutes of a travel time's band; 999 beyond the last, null without a time."""
    out = F.when(seconds.isNull(), None)
    for b in BANDS:
        out = out.when(seconds <= b * 60, b)
    return out.otherwise(999)


def in_bands(seconds: Column, chosen: list[int]) -> Column:
    """Half-open bands chosen by their upper minute; a missing time always passes; all bands, or an unknown list, filter nothing."""
    chosen = [b for b in BANDS if b in set(chosen)]
    if len(chosen) == len(BANDS):
        return F.lit(True)
    out = seconds.isNull()
    for b in chosen:
        i = BANDS.index(b)
        low = seconds > BANDS[i - 1] * 60 if i else F.lit(True)
        out = out | (low & (seconds <= b * 60))
    return out


def geometry_visible(quality: Column, mode: Column, rail_layer: bool = False) -> Column:
    """Whether a line is shown: no approximations or doubtful matches, plain schedule shapes for bus and tram alone."""
    hidden = quality.isin("stop_sequence_approximation", "osm_reconstructed_low_confidence") | ((quality == "official_gtfs") & ~mode.isin(LAYERS["bus"]))
    return ~hidden if rail_layer else ~hidden & (quality != "stop_pair_segment")


def display_geometry(confidence: Column, osm: Column, own: Column, own_quality: Column) -> tuple[Column, Column]:
    """(geometry, quality) to show: the rail match from 0.70, the own line under a doubtful label from 0.45, else the own line."""
    geometry = F.when((confidence >= 0.70) & osm.isNotNull(), osm).otherwise(own)
    quality = F.when((confidence >= 0.70) & osm.isNotNull(), "osm_reconstructed").when((confidence >= 0.45) & osm.isNotNull(), "osm_reconstructed_low_confidence").otherwise(own_quality)
    return geometry, quality


#: Line colours; the geometry's quality and two modes come before the route's own colour.
APPROXIMATE_COLOUR = "#c2410c"
MODE_COLOURS = {"ICE": "#dc2626", "IC": "#dc2626", "EC": "#dc2626", "RE": "#2563eb", "RB": "#1d4ed8", "RAIL": "#2563eb", "S": "#16a34a", "AKN": "#65a30d", "U": "#0ea5e9", "BUS": "#b45309", "TRAM": "#7c3aed", "FERRY": "#0891b2"}
OTHER_COLOUR = "#64748b"


def line_colour(quality: Column, mode: Column, own: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in MODE_COLOURS.items() for x in pair))
    of_mode = F.coalesce(F.try_element_at(table, mode), F.lit(OTHER_COLOUR))
    return F.when(quality == "stop_sequence_approximation", APPROXIMATE_COLOUR).when(mode.isin(LAYERS["bus"]), of_mode).otherwise(F.coalesce(own, of_mode))


#: How a school label in key form tells its category. Rules are tried in order; "words" wants one of
#: the words, or the whole label without separators; "part" wants one of the texts anywhere in it.
SCHOOL_RULES = [
    ("words", "gymnasium", ["gym", "gy", "gymnasium"]),
    ("words", "comprehensive", ["igs", "kgs", "gesamtschule", "gemeinschaftsschule"]),
    ("words", "upper_secondary", ["abg", "kol", "oberstufe", "oberstufenzentrum", "abendgymnasium", "kolleg"]),
    ("part", "waldorf", ["waldorf"]),
    ("part", "vocational", ["berufsschule", "berufsbild", "berufsfach", "berufliches_gymnasium", "berufseinstiegsschule", "berufsoberschule", "fachoberschule", "fachschule", "bbs"]),
    ("part", "comprehensive", ["gesamtschule", "gemeinschaftsschule", "stadtteilschule", "kooperative_gesamtschule", "igs", "kgs"]),
    ("part", "upper_secondary", ["oberstufe", "oberstufenzentrum", "abendgymnasium", "kolleg"]),
    ("part", "gymnasium", ["gymnasium"]),
]
#: Bits of a coded school type, in the order in which they count.
SCHOOL_BITS = [(128, "vocational"), (32, "gymnasium"), (64, "comprehensive"), (2048, "comprehensive"), (1024, "comprehensive")]
#: The states and their names.
STATES = {"HH": "hamburg", "SH": "schleswig_holstein", "MV": "mecklenburg_vorpommern", "NI": "niedersachsen"}


def school_category(key: Column) -> Column:
    """Category of a school label in key form by SCHOOL_RULES; null if none fits."""
    words, whole = F.split(key, "_"), F.replace(key, F.lit("_"), F.lit(""))
    out = F.lit(None).cast("string")
    for kind, category, texts in reversed(SCHOOL_RULES):
        if kind == "words":
            fits = F.arrays_overlap(words, F.array(*map(F.lit, texts))) | whole.isin(texts)
        else:
            fits = key.rlike("|".join(texts))
        out = F.when(fits, category).otherwise(out)
    return out


def school_category_of_bits(bits: Column) -> Column:
    out = F.lit(None).cast("string")
    for bit, category in reversed(SCHOOL_BITS):
        out = F.when(bits.bitwiseAND(bit) != 0, category).otherwise(out)
    return out


def state_code(key: Column) -> Column:
    """State code from a code or name in key form; null if unknown."""
    out = F.lit(None).cast("string")
    for code, name in STATES.items():
        out = F.when(key.isin(code.lower(), name), code).otherwise(out)
    return out


#: Labels of school categories.
SCHOOL_LABELS = {"gymnasium": "Gymnasium", "comprehensive": "Gesamtschule", "waldorf": "Waldorfschule", "vocational": "Berufsschule", "upper_secondary": "Oberstufe"}
#: Labels of the coded school types.
SCHOOL_BIT_LABELS = {32: "Gymnasium", 64: "Gesamtschule", 128: "Berufsbildende Schule", 1024: "Gemeinschaftsschule", 2048: "Gemeinschaftsschule mit Oberstufe"}


def label_of(value: Column, labels: dict[str, str], missing: str | None = None) -> Column:
    """The label of a value; the value itself where none is known, and missing for null."""
    table = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.coalesce(F.try_element_at(table, value), value, F.lit(missing))


def school_label_of_bits(bits: Column) -> Column:
    out = F.lit(None).cast("string")
    for bit, _ in reversed(SCHOOL_BITS):
        out = F.when(bits.bitwiseAND(bit) != 0, SCHOOL_BIT_LABELS[bit]).otherwise(out)
    return out


def time_of(iso: Column, missing: str = "n/a") -> Column:
    """``HH:MM`` of an ISO timestamp as it stands."""
    return F.when(F.length(iso) >= 16, F.substring(iso, 12, 5)).otherwise(F.lit(missing))


def count_label(n: Column, missing: str = "n/a") -> Column:
    return F.coalesce(n.cast("string"), F.lit(missing))
