"""Distance, heading and speed of every point against the one before, and a file's figures.

One window per file; segments and tracks inside a file do not reset it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routeloom.functions import geo

JUMP_KMH = 400.0


def number(points: DataFrame, *order: str) -> DataFrame:
    """Points numbered from 0 in each file as ``idx``."""
    return points.withColumn("idx", (F.row_number().over(W.partitionBy("file_id").orderBy(*order)) - 1).cast("long"))


def seconds_between(a, b):
    """Seconds from timestamp a to b."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if isinstance(c, str) else F.unix_micros(c.cast("timestamp"))
    return (micros(b) - micros(a)) / 1e6


def kinematics(points: DataFrame) -> DataFrame:
    """Adds dist_prev_m, dist_cum_m, speed_kmh and bearing to points with file_id, idx, lat, lon, t."""
    by = W.partitionBy("file_id").orderBy("idx")
    before = {c: F.lag(c).over(by) for c in ("lat", "lon", "t")}
    own = points.withColumns({f"__{c}": x for c, x in before.items()})
    hop = geo.haversine_m("__lat", "__lon", "lat", "lon")
    head = F.when(F.col("__lat").isNotNull(), geo.bearing_deg("__lat", "__lon", "lat", "lon"))
    own = own.withColumns({"__d": hop, "__b": head, "__dt": seconds_between("__t", "t")})
    total = F.sum(F.coalesce("__d", F.lit(0.0))).over(by.rowsBetween(W.unboundedPreceding, W.currentRow))
    own = own.withColumns({
        "dist_prev_m": F.coalesce("__d", F.lit(0.0)),
        "dist_cum_m": total,
        "speed_kmh": F.when(F.col("__dt") > 0, F.col("__d") / F.col("__dt") * 3.6),
        "bearing": F.coalesce("__b", F.lead("__b").over(by)),
    })
    return own.drop("__lat", "__lon", "__t", "__d", "__b", "__dt")


def valid_points(raw: DataFrame) -> DataFrame:
    """Raw points with a valid coordinate, numbered in file order."""
    return number(raw.where(geo.valid_coordinate("lat", "lon")), "trk", "seg", "pt")


def inspect(raw: DataFrame) -> DataFrame:
    """One row per file: counts, extent, times, distance, present fields and anomalies."""
    counts = raw.groupBy("file_id").agg(
        F.countDistinct("trk").alias("n_tracks"),
        F.countDistinct("trk", "seg").alias("n_segments"),
        F.count_if(F.col("pt").isNotNull() & ~geo.valid_coordinate("lat", "lon")).alias("n_invalid"),
    )
    by = W.partitionBy("file_id").orderBy("idx")
    same = (F.col("lat") == F.lag("lat").over(by)) & (F.col("lon") == F.lag("lon").over(by))
    points = kinematics(valid_points(raw)).withColumn("same", F.coalesce(same, F.lit(False)))
    has = lambda c, name: F.when(F.count(c) > 0, name)
    figures = points.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_points"),
        *[f(c).alias(f"{c}_{n}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))],
        F.min("t").alias("t_first"),
        F.max("t").alias("t_last"),
        F.sum("dist_prev_m").alias("distance_m"),
        F.count_if(F.col("speed_kmh") > JUMP_KMH).alias("n_jumps"),
        F.count_if("same").alias("n_repeats"),
        F.array_compact(F.array(has("ele", "ele"), has("fix", "fix"), has("hdop", "hdop"), has("t", "time"))).alias("fields"),
    )
    out = counts.join(figures, "file_id", "left").withColumns({
        "n_points": F.coalesce("n_points", F.lit(0)),
        "distance_m": F.coalesce("distance_m", F.lit(0.0)),
        "duration_s": seconds_between("t_first", "t_last"),
        "has_time": F.col("t_first").isNotNull(),
        "fields": F.coalesce("fields", F.array().cast("array<string>")),
    })
    return out.withColumn("anomalies", anomalies())


def anomalies():
    """Texts for what is odd in a file, from the columns of :func:`inspect`."""
    some = lambda c, what: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(what)))
    return F.array_compact(F.array(
        some("n_jumps", " speed jump(s) above 400 km/h"),
        some("n_repeats", " repeated consecutive point(s)"),
        some("n_invalid", " invalid coordinate(s) ignored"),
        F.when(F.col("n_points") == 0, F.lit("no valid point")),
    ))
