"""GPX files as points: one distributed scan that hashes, decodes and parses every file.

Points keep file order across tracks and segments.  A file that is not XML gives one row with ``error`` set and no points.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.operators import kinematics

_POINT = "_lat: STRING, _lon: STRING, ele: STRING, time: STRING, fix: STRING, hdop: STRING, extensions: STRING"
_SCHEMA = f"trk ARRAY<STRUCT<trkseg: ARRAY<STRUCT<trkpt: ARRAY<STRUCT<{_POINT}>>>>>>, _corrupt_record STRING"


def find(path: str, recursive: bool = True) -> list[str]:
    """Sorted GPX files of a folder (or the one file given), any case of the suffix."""
    p = Path(path)
    if p.is_file():
        return [str(p)] if p.suffix.lower() == ".gpx" else []
    if not p.is_dir():
        return []
    return sorted(str(f) for f in (p.rglob("*") if recursive else p.glob("*")) if f.is_file() and f.suffix.lower() == ".gpx")


def scan(spark: SparkSession, path: str | list[str], recursive: bool = True) -> DataFrame:
    """One row per file: path, name, bytes, file_hash, error and the parsed tree ``gpx``."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.[gG][pP][xX]")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
    )
    return parse(files.select("path", "length", "content"))


def parse(files: DataFrame) -> DataFrame:
    """Rows (path, length, content) with name, bytes, file_hash, error and the parsed tree ``gpx``."""
    # default namespaces, bytes that are no UTF-8, and a byte order mark do not stop the parser
    xml = F.make_valid_utf8(F.col("content").cast("string"))
    tree = F.from_xml(xml, F.lit(_SCHEMA), {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    out = files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("file_hash"),
        tree.alias("gpx"), F.substring(xml, 1, 4096).contains("<gpx").alias("__root"),
    )
    broken = F.col("gpx").isNull() | F.col("gpx._corrupt_record").isNotNull() | ~F.col("__root")
    return out.withColumn("error", F.when(broken, F.lit("not a readable GPX file"))).drop("__root")


def _extension(field: str) -> Column:
    return F.nullif(F.regexp_extract("p.extensions", rf"<(?:[\w.-]+:)?{field}\b[^>]*>\s*([^<]*?)\s*<", 1), F.lit(""))


def points(files: DataFrame) -> DataFrame:
    """Raw points of scanned files: file_id (the path), trk, seg, pt, lat, lon, ele, t, fix, hdop."""
    rows = files.select(F.col("path").alias("file_id"), F.posexplode_outer("gpx.trk").alias("trk", "k"))
    rows = rows.select("file_id", "trk", F.posexplode_outer("k.trkseg").alias("seg", "s"))
    rows = rows.select("file_id", "trk", "seg", F.posexplode_outer("s.trkpt").alias("pt", "p"))
    number = lambda c: F.expr(f"try_cast({c} AS DOUBLE)")
    when = F.to_utc_timestamp(F.expr("try_cast(p.time AS TIMESTAMP)"), F.current_timezone())
    return rows.select(
        "file_id", "trk", "seg", F.col("pt").cast("long").alias("pt"), number("p._lat").alias("lat"), number("p._lon").alias("lon"),
        number("p.ele").alias("ele"), when.cast("timestamp_ntz").alias("t"), F.coalesce("p.fix", _extension("fix")).alias("fix"),
        F.coalesce(number("p.hdop"), _extension("hdop").try_cast("double")).alias("hdop"),
    )


def read(spark: SparkSession, path: str | list[str], recursive: bool = True) -> DataFrame:
    return points(scan(spark, path, recursive))


def inspect(spark: SparkSession, path: str | list[str], recursive: bool = True) -> DataFrame:
    """Figures of every readable file, and the error of the others."""
    files = scan(spark, path, recursive)
    figures = kinematics.inspect(points(files.where("error is null")))
    shape = files.select(
        F.col("path").alias("file_id"), "name", "file_hash", "error",
        F.coalesce(F.size("gpx.trk"), F.lit(0)).alias("tracks"),
        F.coalesce(F.aggregate("gpx.trk", F.lit(0), lambda n, t: n + F.coalesce(F.size(t["trkseg"]), F.lit(0))), F.lit(0)).alias("segments"),
    )
    out = shape.join(figures.drop("n_tracks", "n_segments"), "file_id", "left")
    return out.withColumnsRenamed({"tracks": "n_tracks", "segments": "n_segments"})
