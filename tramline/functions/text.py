"""Names, ids, numbers and labels as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Latin letters with marks and the letters they reduce to; the sharp s has no such letter and is dropped.
MARKED = "áàâãåāăąçćčďđéèêëēėęěíìîïīįłñńňóòôõőōøŕřśšşťţúùûűūůýÿžźżäöü"
PLAIN = "aaaaaaaacccddeeeeeeeeiiiiiilnnnooooooorrsssttuuuuuuyyzzzaou"


def blank_to_null(value: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.trim(value), F.lit(""))


def first_filled(df: DataFrame, names: list[str]) -> Column:
    """The first of the named columns that is there and not blank, in order of names."""
    found = [blank_to_null(df[n].cast("string")) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def squeezed(value: Column) -> Column:
    """Lower case with runs of white space made one blank; not trimmed."""
    return F.lower(F.regexp_replace(value, r"\s+", " "))


def key_of(value: Column, separator: str = "_") -> Column:
    """ASCII lower case, other characters to one separator, none at the ends."""
    plain = F.translate(F.translate(F.lower(value), MARKED, PLAIN), "ß", "")
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", separator), f"^{separator}+|{separator}+$", "")


def plain_key(value: Column, signs: str = "-", separator: str = "_") -> Column:
    """ASCII lower case in which only white space and the signs named separate words; other signs stay."""
    plain = F.regexp_replace(F.translate(F.translate(F.lower(value), MARKED, PLAIN), "ß", ""), "[^\\x00-\\x7F]+", "")
    return F.regexp_replace(F.regexp_replace(F.translate(plain, signs, " " * len(signs)), r"^\s+|\s+$", ""), r"\s+", separator)


def field_key(name: str) -> str:
    """The key form of a column name: ASCII lower case, words joined by one underscore."""
    import re
    import unicodedata

    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().casefold()
    return "_".join(w for w in re.split(r"[\s-]+", plain) if w)


def stable_hash(*parts: Column) -> Column:
    """16 hex digits that are equal for equal parts, as an identity."""
    return F.lpad(F.lower(F.hex(F.xxhash64(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))), 16, "0")


def differs(a: Column, b: Column) -> Column:
    """Inequality in which null equals null and nothing else."""
    return ~a.eqNullSafe(b)


def german_name(value: Column) -> Column:
    """Name for comparison: ae, oe, ue, ss for umlauts and sharp s, hbf spelt out, other marks dropped, words by blanks."""
    out = F.lower(value)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(F.translate(out, MARKED, PLAIN), r"\bhbf\b", "hauptbahnhof")
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def dice(a: Column, b: Column) -> Column:
    """Similarity of two normalised names: 1 if equal, 0.85 if one holds the other, else the Dice share of their words."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    x, y = words(a), words(b)
    total = F.size(x) + F.size(y)
    share = F.when(total == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / total)
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).when(F.contains(a, b) | F.contains(b, a), 0.85).otherwise(share)


def location_score(similarity: Column, meters: Column) -> Column:
    """Similarity in percent less a 25th of the distance, 1000 m where it is unknown; null unless similar or near enough."""
    score = similarity * 100 - F.coalesce(meters, F.lit(1000.0)) / 25
    return F.when((similarity >= 0.3) | (meters <= 250), score)


def stop_numbers(value: Column) -> Column:
    """All runs of 7 or 8 digits, the leading 1 of an 8-digit one dropped, each once."""
    runs = F.regexp_extract_all(value, F.lit("[0-9]{7,8}"), F.lit(0))
    return F.array_distinct(F.transform(runs, lambda x: F.when((F.length(x) == 8) & x.startswith("1"), F.substring(x, 2, 7)).otherwise(x)))


def is_location_reference(value: Column) -> Column:
    """Whether a text is usable as a place reference: the long form, or 5 to 12 digits."""
    return F.coalesce(value.startswith("A=") | value.rlike("^[0-9]{5,12}$"), F.lit(False))


def number(value: Column) -> Column:
    """A number with decimal point or comma; null if it is none."""
    return F.replace(F.trim(value), F.lit(","), F.lit(".")).try_cast("double")


def stable_id(given: Column | None, *parts: Column) -> Column:
    """The given id, or 16 hex digits of the SHA-1 of the parts, joined by bars."""
    made = F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts)).cast("binary")), 1, 16)
    return made if given is None else F.coalesce(blank_to_null(given), made)


def coordinate_text(value: Column) -> Column:
    return F.format_string("%.7f", value)


#: Entities that html_text resolves; the ampersand comes last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&auml;": "ä", "&ouml;": "ö", "&uuml;": "ü", "&Auml;": "Ä", "&Ouml;": "Ö", "&Uuml;": "Ü", "&szlig;": "ß", "&amp;": "&"}


def html_text(html: Column) -> Column:
    """Text of an HTML fragment: tags become one blank, entities are resolved, white space is squeezed and trimmed."""
    out = F.regexp_replace(html, "<[^>]*>", " ")
    out = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), out)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def route_label(short: Column, long: Column, source_id: Column, mode: Column) -> Column:
    return F.concat(F.coalesce(blank_to_null(short), blank_to_null(long), source_id), F.lit(" · "), mode)


def route_summary(label_list: Column, total: Column, more: str = "+{n} more", shown: int = 5) -> Column:
    """``a, b, +n more`` from a comma-joined list and the number of all."""
    rest = total - F.least(total, F.lit(shown))
    extra = F.concat(F.lit(", " + more.split("{n}")[0]), rest.cast("string"), F.lit(more.split("{n}")[1]))
    return F.when(rest > 0, F.concat(label_list, extra)).otherwise(label_list)


def contains_pattern(value: Column, query: str) -> Column:
    """Case-blind substring search in which ``%`` and ``_`` of the query stay wildcards."""
    return value.ilike(f"%{query}%")


def csv_items(value: str | None) -> list[str]:
    """The filled parts of a comma-separated parameter."""
    return [p.strip() for p in (value or "").split(",") if p.strip()]


def one_of(column: Column, wanted: list) -> Column:
    """Membership in a list; an empty list filters nothing."""
    return column.isin(wanted) if wanted else F.lit(True)


def id_aliases(public_id: str) -> list[str]:
    """An id and, for one that ends in 1 and seven digits after a colon, its form with ``1:`` before the digits."""
    head, colon, tail = public_id.rpartition(":")
    return [public_id, f"{head}:1:{tail[1:]}"] if colon and len(tail) == 8 and tail.isdigit() and tail[0] == "1" else [public_id]


def id_forms(public_id: Column) -> Column:
    """The same over a column: all forms of each id."""
    return F.when(public_id.rlike(":1[0-9]{7}$"), F.array(public_id, F.regexp_replace(public_id, ":1([0-9]{7})$", ":1:$1"))).otherwise(F.array(public_id))
