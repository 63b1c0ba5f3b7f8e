"""Research of farm stays: listings, browser records and mapped objects to one list of candidates.

A candidate has the columns of ``CANDIDATE``; ``raw`` is the JSON that it came
from.  Pages are a table (source_id, url, html, error): whoever fetches them
stores an error in place of the page.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tramline.functions.geo import bound
from tramline.functions.text import blank_to_null, html_text, number, plain_key
from tramline.operators.poi import FARM_NAME, NOT_FARM, dedupe_best, facility_listing, listing_links, state_of_box, state_of_source

CANDIDATE = "source_id string, source_place_id string, name string, state_code string, address string, website string, lon double, lat double, confidence string, source_url string, detail_url string, evidence string, raw string"
NAMES = [c.split()[0] for c in CANDIDATE.split(", ")]
#: The states taken, and the source of mapped objects.
STATES = ["HH", "SH", "MV", "NI"]
MAPPED = "osm_ferienhoefe"
#: Sources whose listings hold farm stays only, and the words that mark one elsewhere.
TRUSTED = ["landsichten_sh_kinderhof", "landsichten_sh_bauernhof", "landsichten_mv_kinderhof", "landsichten_mv_bauernhof", "landsichten_ni_kinderhof", "landsichten_ni_bauernhof", "bauernhofurlaub_"]
KEYWORDS = ["bauernhof", "bauernhofurlaub", "ferienbauernhof", "ferienhof", "gutshof", "landgut", "landhof", "reiterhof", "urlaub auf dem bauernhof"]
#: Tags and names that make a mapped object a candidate.
MAPPED_TAGS = ["tourism apartment", "tourism guest house", "tourism chalet", "tourism hotel", "tourism camp site", "tourism caravan site", "farmyard", "guest house", "apartment", "accommodation", "farm", "equestrian"]
MAPPED_NAMES = ["ferienhof", "ferienbauernhof", "urlaubshof", "kinderbauernhof"]
#: Keys of nested records whose texts are searched, and keys that are not entered.
TEXT_KEYS = {"name", "description", "address", "streetaddress", "addresslocality", "addressregion", "reviewbody", "text"}
CLOSED_KEYS = {"url", "href", "detailurl", "sourceurl", "image", "logo", "context"}
#: Item kinds that name a lodging, kinds whose address is not the lodging's, and marks of addresses that are none.
LODGING = {"LodgingBusiness", "LocalBusiness", "Hotel"}
NOT_LODGING = {"ImageObject", "Organization"}
NOT_SITE = ("imgcdn.", "#ratings")


@F.pandas_udf(StringType())
def absolute_url(base: pd.Series, url: pd.Series) -> pd.Series:
    """A link of a page as a full address; null without a link."""
    return pd.Series([urljoin(b or "", html.unescape(u)) if u else None for b, u in zip(base, url, strict=True)], dtype=object)


def place_id(source: Column, value: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", source, value).cast("binary")), 1, 16)


def _candidates(df: DataFrame, **columns: Column) -> DataFrame:
    kinds = dict(c.split() for c in CANDIDATE.split(", "))
    return df.select(*(columns.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in NAMES))


def from_listings(pages: DataFrame) -> DataFrame:
    """Candidates of all listing pages, each source by its own marks; a page that could not be fetched is a row of its own."""
    kinds = {"landsichten": ("teaser", "landsichten teaser-card-href"), "bauernhofurlaub": ("house", "bauernhofurlaub house link"), "landreise": (None, "landreise data-facility-id")}
    failed = pages.where("error is not null")
    out = _candidates(
        failed,
        source_id=F.col("source_id"),
        source_place_id=place_id(F.col("source_id"), F.lit("fetch-error")),
        name=F.concat(F.lit("FETCH ERROR "), "source_id"),
        state_code=state_of_source(F.col("source_id"), F.col("url")),
        website=F.col("url"),
        confidence=F.lit("fetch_error"),
        source_url=F.col("url"),
        evidence=F.col("error"),
        raw=F.to_json(F.struct("error")),
    )
    sources = pages.select("url", "source_id")
    for prefix, (kind, evidence) in kinds.items():
        own = pages.where(F.col("source_id").startswith(prefix) & F.col("error").isNull())
        links = (listing_links(own, kind) if kind else facility_listing(own)).join(sources, "url")
        detail = F.when(F.col("href").isNotNull(), absolute_url("url", "href"))
        key = F.col("external_id")
        raw = F.to_json(F.struct("external_id", "href") if kind else F.struct(key.alias("facility_id")))
        rows = links.withColumn("detail", detail)
        out = out.unionByName(
            _candidates(
                rows,
                source_id=F.col("source_id"),
                source_place_id=key,
                name=F.col("name"),
                state_code=state_of_source(F.col("source_id"), F.col("url")),
                website=F.coalesce("detail", "url") if kind is None else F.col("detail"),
                confidence=F.lit("listing_link"),
                source_url=F.col("url"),
                detail_url=F.col("detail"),
                evidence=F.lit(evidence),
                raw=raw,
            )
        )
    return out


def from_browser(records: DataFrame) -> DataFrame:
    """Candidates of browser records (JSON text in ``record``); those without address or source are left out."""
    get = lambda k: F.get_json_object("record", f"$.{k}")
    rows = records.select("record", get("detailUrl").alias("detail"), get("sourceId").alias("source"), get("listingText").alias("text"), get("stateCode").alias("state"), get("url").alias("url")).where("detail is not null and source is not null")
    number_of = F.regexp_replace(F.substring_index("detail", "-", -1), "^/+|/+$", "")
    return _candidates(
        rows,
        source_id=F.col("source"),
        source_place_id=place_id(F.col("source"), F.col("detail")),
        name=html_text(F.coalesce(F.nullif("text", F.lit("")), F.concat(F.lit("Landreise Unterkunft "), number_of))),
        state_code=F.when(F.col("state").isin(STATES), F.col("state")).otherwise(state_of_source(F.col("source"), F.col("detail"))),
        website=F.col("detail"),
        confidence=F.lit("browser_listing_link"),
        source_url=F.coalesce(F.nullif("url", F.lit("")), "detail"),
        detail_url=F.col("detail"),
        evidence=F.lit("landreise browser-rendered listing"),
        raw=F.col("record"),
    )


def first_tag(tags: Column, keys: list[str]) -> Column:
    return F.coalesce(*(blank_to_null(F.try_element_at(tags, F.lit(k))) for k in keys))


def tag_address(tags: Column) -> Column:
    """Street, number, postcode and town of a tag map, those that are there; null without any."""
    parts = [blank_to_null(F.try_element_at(tags, F.lit(f"addr:{k}"))) for k in ("street", "housenumber", "postcode", "city")]
    return blank_to_null(F.concat_ws(" ", *parts))


def from_mapped(records: DataFrame) -> DataFrame:
    """Candidates of mapped objects (JSON text in ``record``); a name, a position and a state that is taken are needed."""
    # a generator reads a record once, whatever is asked of it afterwards
    read = records.select("record", F.json_tuple("record", "name", "lat", "lon", "state_code", "osm_type", "osm_id", "tags").alias("name", "_lat", "_lon", "state", "_type", "_id", "_tags"))
    tags = F.from_json("_tags", "map<string,string>")
    rows = read.select("record", "name", number(F.col("_lat")).alias("lat"), number(F.col("_lon")).alias("lon"), "state", F.concat_ws("/", "_type", "_id").alias("at"), F.coalesce(tags, F.create_map().cast("map<string,string>")).alias("tags"))
    rows = rows.where(F.col("name").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("state").isin(STATES))
    return _candidates(
        rows,
        source_id=F.lit(MAPPED),
        source_place_id=F.col("at"),
        name=html_text(F.col("name")),
        state_code=F.col("state"),
        address=tag_address(F.col("tags")),
        website=first_tag(F.col("tags"), ["website", "contact:website", "url"]),
        lon=F.col("lon"),
        lat=F.col("lat"),
        confidence=F.lit("osm_name_match"),
        source_url=F.lit("data/raw/osm/germany-latest.osm.pbf"),
        detail_url=F.concat(F.lit("https://www.openstreetmap.org/"), "at"),
        evidence=F.lit("OpenStreetMap name/tag match"),
        raw=F.col("record"),
    )


def is_farm_object(name: Column, tags: Column) -> Column:
    """Whether a mapped object is a farm stay by its name and, unless the name says it all, its tags."""
    words = F.array_join(F.transform(F.map_entries(tags), lambda e: F.concat_ws(" ", e["key"], F.replace(e["value"], F.lit("_"), F.lit(" ")))), " ")
    text, own = plain_key(words, "-/", " "), plain_key(name, "-/", " ")
    holds = lambda c, terms: bound(c, lambda whole: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(whole, t)))
    return name.rlike(FARM_NAME) & ~name.rlike(NOT_FARM) & (F.coalesce(holds(text, MAPPED_TAGS), F.lit(False)) | holds(own, MAPPED_NAMES))


def mapped_objects(objects: DataFrame) -> DataFrame:
    """Records of mapped nodes and ways (osm_type, osm_id, name, tags, nodes) that are farm stays in the states taken.

    A way lies at the mean of its valid nodes, a node at its only one; without any it is left out.
    """
    valid = F.filter("nodes", lambda n: n["lon"].between(-180, 180) & n["lat"].between(-90, 90))
    mean = lambda v, c: F.aggregate(v, F.lit(0.0), lambda s, n: s + n[c]) / F.size(v)
    at = lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"), state_of_box(p["lon"], p["lat"]).alias("state_code"))
    spot = lambda v: bound(F.struct(mean(v, "lon").alias("lon"), mean(v, "lat").alias("lat")), at)
    taken = lambda p: F.filter(F.array(p), lambda x: x["state_code"].isNotNull())
    farm = F.col("osm_type").isin("node", "way") & is_farm_object(F.col("name"), F.col("tags"))
    spots = taken(bound(valid, lambda v: F.when(F.size(v) > 0, spot(v))))
    # exploded, so that an object is judged and placed once and where its rows have been dealt to, not again for a filter moved ahead of that
    rows = objects.select("osm_type", "osm_id", "name", "tags", F.explode(F.when(farm, spots)).alias("p"))
    return rows.select(F.to_json(F.struct("osm_type", "osm_id", "name", "p.lat", "p.lon", "p.state_code", "tags")).alias("record"))


class _Scripts(HTMLParser):
    """The contents of a page's structured-data scripts."""

    def __init__(self):
        super().__init__()
        self.inside, self.found = False, []

    def handle_starttag(self, tag, attrs):
        self.inside = tag == "script" and (dict(attrs).get("type") or "").lower() == "application/ld+json"
        if self.inside:
            self.found.append("")

    def handle_data(self, data):
        if self.inside:
            self.found[-1] += data

    def handle_endtag(self, tag):
        self.inside = False


def _clean(text: str) -> str:
    return " ".join(html.unescape(re.sub("<[^>]*>", " ", text)).split())


def _decimal(value) -> float | None:
    try:
        return float(str(value).replace(",", "."))
    except ValueError:
        return None


class Lodging:
    """What the items of a page's structured data say of one lodging, taken in order of the document."""

    def __init__(self, name: str | None, site: str | None):
        self.name, self.site, self.base = name, site, site
        self.address = self.lon = self.lat = None

    def read(self, value) -> None:
        if isinstance(value, list):
            for v in value:
                self.read(v)
        elif isinstance(value, dict):
            self._item(value)
            for v in value.values():
                self.read(v)

    def _item(self, item: dict) -> None:
        kind = item.get("@type")
        kinds = set(map(str, kind)) if isinstance(kind, list) else {str(kind)}
        lodging = bool(kinds & LODGING)
        unnamed = not self.name or self.name.startswith("Landreise Unterkunft") or "©" in self.name
        if isinstance(item.get("name"), str) and (lodging or unnamed):
            self.name = _clean(item["name"])
        url = item.get("url")
        if isinstance(url, str) and url and (lodging or not kinds & NOT_LODGING) and not any(x in url for x in NOT_SITE):
            self.site = urljoin(self.base or "", html.unescape(url))
        address = item.get("address")
        if isinstance(address, dict):
            address = " ".join(str(address[k]).strip() for k in ("streetAddress", "postalCode", "addressLocality") if address.get(k)) or None
        if isinstance(address, str):
            self.address = _clean(address)
        geo = item.get("geo")
        if self.lon is None and isinstance(geo, dict):
            lon, lat = _decimal(geo.get("longitude")), _decimal(geo.get("latitude"))
            if lon is not None and lat is not None:
                self.lon, self.lat = lon, lat


def structured_data(pages: DataFrame) -> DataFrame:
    """url, name, address, website, lon, lat, raw of what a page's JSON-LD says; blocks that are no JSON are skipped.

    pages: url, html, and name (of the listing) where there is one; pages
    without a block, or whose lodging stays without a name, give no row.
    """
    if "name" not in pages.columns:
        pages = pages.withColumn("name", F.lit(None).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for url, page, name in zip(pdf["url"], pdf["html"], pdf["name"], strict=True):
                parser, blocks = _Scripts(), []
                parser.feed(page or "")
                for text in parser.found:
                    try:
                        blocks.append(json.loads(html.unescape(text.strip()), strict=False))
                    except ValueError:
                        continue
                found = Lodging(name, url)
                found.read(blocks)
                if blocks and found.name:
                    rows.append((url, found.name, found.address, found.site, found.lon, found.lat, json.dumps({"json_ld": blocks}, ensure_ascii=False)))
            yield pd.DataFrame(rows, columns=["url", "name", "address", "website", "lon", "lat", "raw"])

    return pages.select("url", "html", "name").mapInPandas(run, "url string, name string, address string, website string, lon double, lat double, raw string")


@F.pandas_udf(StringType())
def merged_json(first: pd.Series, second: pd.Series) -> pd.Series:
    """Two JSON objects as one, keys of the second win; null counts as empty."""
    return pd.Series([json.dumps({**json.loads(a or "{}"), **json.loads(b or "{}")}, ensure_ascii=False) for a, b in zip(first, second, strict=True)], dtype=object)


def enrich(candidates: DataFrame, details: DataFrame, most: int | None = None) -> DataFrame:
    """Candidates with what their detail page (url, html, error) says.

    Mapped objects, rows without a detail page and, if most is given, those
    after the first so many pages by source and id stay as they are; an error
    of the page is kept in raw.
    """
    asked = candidates.where(F.col("detail_url").isNotNull() & (F.col("source_id") != MAPPED)).join(details.withColumnRenamed("url", "detail_url"), "detail_url")
    good = asked.where("error is null")
    if most is not None:
        good = good.orderBy("source_id", "source_place_id").limit(most)
    read = structured_data(good.select(F.col("detail_url").alias("url"), "html", "name").dropDuplicates(["url"]))
    renamed = read.select(F.col("url").alias("detail_url"), *(F.col(c).alias(f"_{c}") for c in ("name", "address", "website", "lon", "lat", "raw")))
    errors = asked.where("error is not null").select("detail_url", F.col("error").alias("_error")).dropDuplicates(["detail_url"])
    open_row = F.col("source_id") != MAPPED
    out = candidates.join(renamed, "detail_url", "left").join(errors, "detail_url", "left")
    has = open_row & F.col("_name").isNotNull()
    failed = open_row & F.col("_error").isNotNull()
    structured = F.when(F.col("_lon").isNotNull(), "structured_detail").otherwise("structured_detail_without_coords")
    pick = lambda c: F.when(has, F.col(f"_{c}")).otherwise(F.col(c))
    changed = {c: pick(c) for c in ("name", "address", "website", "lon", "lat")} | {
        "state_code": F.when(has, state_of_source(F.col("source_id"), F.col("source_url"))).otherwise(F.col("state_code")),
        "source_place_id": F.when(has, place_id(F.col("source_id"), F.col("detail_url"))).otherwise(F.col("source_place_id")),
        "confidence": F.when(has, structured).otherwise(F.col("confidence")),
        "evidence": F.when(has, F.lit("application/ld+json")).otherwise(F.col("evidence")),
        "raw": F.when(has, merged_json("raw", "_raw")).when(failed, merged_json("raw", F.to_json(F.struct(F.col("_error").alias("detail_error"))))).otherwise(F.col("raw")),
    }
    return out.withColumns(changed).select(*NAMES)


@F.pandas_udf(StringType())
def searchable_text(raw: pd.Series) -> pd.Series:
    """The texts under the keys that describe a place, from nested JSON; addresses of pages and pictures are not entered."""
    plain = lambda k: " ".join(re.split(r"[\s/-]+", k.casefold())).strip()

    def texts(value, key):
        if isinstance(value, dict):
            for k, v in value.items():
                if (p := plain(str(k))) not in CLOSED_KEYS:
                    yield from texts(v, p)
        elif isinstance(value, list):
            for v in value:
                yield from texts(v, key)
        elif key in TEXT_KEYS and isinstance(value, str | int | float):
            yield str(value)

    return pd.Series([" ".join(texts(json.loads(x), None)) if x else "" for x in raw], dtype=object)


def is_relevant(df: DataFrame) -> Column:
    """Whether a candidate is a farm stay: by name if mapped, by its source, or by a keyword in name, address or raw texts."""
    text = plain_key(F.concat_ws(" ", "name", F.coalesce("address", F.lit("")), searchable_text("raw")), "-/", " ")
    named = F.col("name").rlike(FARM_NAME) & ~F.col("name").rlike(NOT_FARM)
    trusted = F.lit(False)
    for prefix in TRUSTED:
        trusted = trusted | F.col("source_id").startswith(prefix)
    return F.when(F.col("source_id") == MAPPED, named).otherwise(trusted | text.rlike("|".join(KEYWORDS)))


def collect(pages: DataFrame, browser: DataFrame, mapped: DataFrame, details: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(all candidates, the best of each): every source together, detail pages read."""
    every = from_listings(pages).unionByName(from_browser(browser)).unionByName(from_mapped(mapped))
    read = enrich(every, details, most)
    place = F.concat_ws("|", "source_id", "source_place_id", "name")
    return read, dedupe_best(read.withColumn("_place", place), "_place").drop("_place")


def importable(candidates: DataFrame) -> DataFrame:
    """What the candidates' CSV holds: relevant ones with a position in a state that is taken."""
    rows = candidates.where(F.col("state_code").isin(STATES) & F.col("lat").isNotNull() & F.col("lon").isNotNull()).where(is_relevant(candidates))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select("source_place_id", "name", F.lit("ferienhof").alias("category"), "state_code", blank("address"), blank("website"), "lat", "lon", F.lit("ferienhoefe_web_research").alias("source_id"), "confidence", "source_url", blank("detail_url"), "evidence")


def write_candidates(candidates: DataFrame, path: str) -> None:
    importable(candidates).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')
