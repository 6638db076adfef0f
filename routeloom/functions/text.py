"""Names, durations and identifiers as column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations that are spelled out when road names are compared.
ABBREVIATIONS = {
    "r": "rua", "av": "avenida", "avn": "avenida", "al": "alameda", "tv": "travessa", "trav": "travessa", "pc": "praca",
    "pca": "praca", "rod": "rodovia", "estr": "estrada", "est": "estrada", "prof": "professor", "profa": "professora",
    "dr": "doutor", "dra": "doutora", "eng": "engenheiro", "sen": "senador", "pe": "padre", "sta": "santa", "sto": "santo",
    "s": "sao",
}


def _accents() -> tuple[str, str]:
    """Characters of the Latin and Greek blocks with one base letter, and those letters."""
    of, to = [], []
    for i in (*range(0xC0, 0x250), *range(0x370, 0x400), *range(0x1E00, 0x2000)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(i):
            of.append(chr(i))
            to.append(base)
    return "".join(of), "".join(to)


_OF, _TO = _accents()


def strip_accents(s: Column) -> Column:
    """Letters without their marks, composed or combining."""
    return F.regexp_replace(F.translate(s, _OF, _TO), r"\p{M}+", "")


def normalized_name(s: Column) -> Column:
    """Form of a road name that is used to compare names; empty for null."""
    plain = F.lower(strip_accents(F.coalesce(s, F.lit(""))))
    plain = F.regexp_replace(plain, r"(?U)[^\w\s-]", " ")
    plain = F.regexp_replace(plain, r"[-_]", " ")
    words = F.filter(F.split(plain, r"(?U)\s+"), lambda w: w != "")
    table = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def first_value(a: Column) -> Column:
    """First element that is neither null nor empty."""
    return F.try_element_at(F.filter(a, lambda x: x.isNotNull() & (x != "")), F.lit(1))


def road_identity(name: Column, official: Column, ref: Column, alt: Column, highway: Column, osmid: Column) -> Column:
    """Struct road_id, road_name, ref, highway of a road from its (single) attributes.

    The name decides, then the official name, the reference, the alternative name, the id and last the class.
    """
    some = lambda c: F.when(c.isNotNull() & (c != ""), c)
    name, official, ref, alt, highway = map(some, (name, official, ref, alt, highway))
    shown = F.coalesce(name, official, ref, alt)
    kind = F.when(name.isNull() & official.isNull() & ref.isNotNull(), "ref:").otherwise("name:")
    what = F.coalesce(highway, F.lit("via"))
    unnamed = F.when(osmid.isNotNull(), F.concat(F.lit("osm:"), osmid.cast("string"))).otherwise(F.concat(F.lit("class:"), what))
    label = F.when(osmid.isNotNull(), F.concat(F.lit("unnamed OSM "), osmid.cast("string"))).otherwise(F.concat(F.lit("unnamed "), what))
    return F.struct(
        F.when(shown.isNotNull(), F.concat(kind, normalized_name(shown))).otherwise(unnamed).alias("road_id"),
        F.coalesce(shown, label).alias("road_name"),
        F.coalesce(ref, F.lit("")).alias("ref"),
        F.coalesce(highway, F.lit("")).alias("highway"),
    )


def duration(seconds: Column) -> Column:
    """HH:MM:SS with as many hours as needed (half seconds to even); ``-`` for null."""
    s = F.rint(seconds).cast("long")
    h, m = F.floor(s / 3600).cast("long"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("long")
    return F.when(seconds.isNull(), "-").otherwise(F.format_string("%02d:%02d:%02d", h, m, F.pmod(s, F.lit(60))))


def video_id(file_name: Column) -> Column:
    """Camera id at the start of a file name (GX, GH, GP or GL and four digits or more), else the name without suffix."""
    found = F.regexp_extract(file_name, r"(?i)^(G[XHLP]\d{4,})", 1)
    return F.when(found != "", found).otherwise(F.regexp_replace(file_name, r"(?<=.)\.[^.]*$", ""))


def plain_file_name(name: str) -> str:
    """:func:`safe_file_name` of one name (driver side)."""
    return re.sub(r'[<>:"/\\|?*\x00-\x1f]', "_", name).strip().rstrip(".") or "file"


def safe_file_name(name: Column) -> Column:
    """Name without characters that a file system refuses."""
    base = F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_")
    base = F.regexp_replace(F.regexp_replace(base, r"(?U)^\s+|\s+$", ""), r"\.+$", "")
    return F.when(base == "", "file").otherwise(base)
