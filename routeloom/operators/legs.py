"""Legs: consecutive points on one road, their figures and their confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routeloom.config import Settings
from routeloom.functions import geo
from routeloom.operators.kinematics import seconds_between

HIGH, MEDIUM, LOW, UNIDENTIFIED = "high", "medium", "low", "unidentified"


def with_legs(points: DataFrame, road: str = "leg_road") -> DataFrame:
    """Adds leg_no from 1: a new leg starts where the road changes (unknown is a value)."""
    by = W.partitionBy("file_id").orderBy("idx")
    changed = F.lag("idx").over(by).isNull() | ~F.col(road).eqNullSafe(F.lag(road).over(by))
    return points.withColumn("leg_no", F.sum(F.when(changed, 1).otherwise(0)).over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))


def legs(matched: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per leg of matched points.

    Distances and geometry take in points that smoothing gave to the leg, with their own roads.
    """
    own = with_legs(matched)
    first = lambda c: F.min_by(c, "idx")
    last = lambda c: F.max_by(c, "idx")
    turn = geo.angle_difference(F.col("bearing"), F.col("chosen.road_bearing"))
    mine = F.col("chosen.road_id") == F.col("leg_road")
    near = F.struct(F.round("chosen.distance_m", 6), "idx")
    place = F.when(F.col("chosen").isNull() | F.col("leg_road").isNull(), F.struct("lon", "lat")).otherwise(
        F.struct(F.col("foot_lon").alias("lon"), F.col("foot_lat").alias("lat"))
    )
    out = own.groupBy("file_id", "leg_no").agg(
        F.any_value("leg_road").alias("road_id"),
        F.coalesce(F.min_by(F.when(mine, F.col("chosen")), F.when(mine, near)), F.min_by(F.col("chosen"), F.when(F.col("chosen").isNotNull(), F.col("idx")))).alias("road"),
        first("t").alias("t_in"), last("t").alias("t_out"),
        F.sum("dist_prev_m").alias("distance_m"),
        first("lat").alias("lat_first"), first("lon").alias("lon_first"), last("lat").alias("lat_last"), last("lon").alias("lon_last"),
        F.count(F.lit(1)).alias("n_points"),
        F.coalesce(F.avg("road_m"), F.lit(0.0)).alias("mean_m"), F.coalesce(F.max("road_m"), F.lit(0.0)).alias("max_m"),
        F.avg(turn).alias("turn_deg"), F.avg("margin").alias("mean_margin"),
        F.array_sort(F.collect_list("idx")).alias("indices"),
        F.transform(F.array_sort(F.collect_list(F.struct("idx", place.alias("p")))), lambda p: p["p"]).alias("geometry"),
    )
    known = F.col("road_id").isNotNull()
    out = out.select(
        "file_id", "leg_no", "road_id",
        F.when(known, F.col("road.road_name")).otherwise("unidentified").alias("road_name"),
        *[F.when(known, F.col(f"road.{c}")).alias(c) for c in ("ref", "highway", "osmid")],
        "t_in", "t_out", seconds_between("t_in", "t_out").alias("duration_s"), "distance_m",
        "lat_first", "lon_first", "lat_last", "lon_last", "n_points",
        F.when(known, F.col("mean_m")).otherwise(0.0).alias("mean_m"), F.when(known, F.col("max_m")).otherwise(0.0).alias("max_m"),
        F.when(known, F.col("turn_deg")).alias("turn_deg"), F.when(known, F.col("mean_margin")).alias("mean_margin"),
        "indices", "geometry",
    )
    return classify(out, s)


def classify(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Adds confidence and notes to legs by explicit rules; unknown turns count as 0 and unknown margins as good."""
    c = s.confidence
    turn = F.coalesce("turn_deg", F.lit(0.0))
    margin = F.coalesce("mean_margin", F.lit(c.margin_high))
    mean, n = F.col("mean_m"), F.col("n_points")
    known = F.col("road_id").isNotNull() & (F.col("road_id") != "")
    high = (mean <= c.mean_high_m) & (F.col("max_m") <= c.max_high_m) & (turn <= c.heading_high_deg) & (n >= c.min_points) & (margin >= c.margin_high)
    medium = (mean <= c.mean_medium_m) & (turn <= c.heading_medium_deg) & (n >= 2)
    level = F.when(~known, UNIDENTIFIED).when(high, HIGH).when(medium, MEDIUM).otherwise(LOW)
    rows = rows.withColumn("confidence", level)
    is_medium, is_low = F.col("confidence") == MEDIUM, F.col("confidence") == LOW
    why = F.array_join(F.array_compact(F.array(
        F.when(is_medium & (mean > c.mean_high_m), F.lit("high mean distance")),
        F.when(is_medium & (turn > c.heading_high_deg), F.lit("diverging heading")),
        F.when(is_medium & (margin < c.margin_high), F.lit("competing road nearby")),
        F.when(is_low & (mean > c.mean_medium_m), F.concat(F.lit("points far from the road (mean "), F.rint(mean).cast("int").cast("string"), F.lit(" m)"))),
        F.when(is_low & (turn > c.heading_medium_deg), F.lit("strongly diverging heading")),
        F.when(is_low & (n < 2), F.lit("very short leg (few points)")),
    )), "; ")
    untimed = F.when(F.col("t_in").isNull(), F.lit("no time in the file")) if "t_in" in rows.columns else F.lit(None).cast("string")
    notes = F.concat_ws(" | ", untimed, F.when(why != "", why))
    return rows.withColumn("notes", F.when(F.col("confidence") == UNIDENTIFIED, F.lit("no candidate road within the radius")).otherwise(notes))


def confidence_summary(rows: DataFrame) -> DataFrame:
    """Legs of each file by confidence."""
    return rows.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_legs"), *[F.count_if(F.col("confidence") == x).alias(f"n_{x}") for x in (HIGH, MEDIUM, LOW, UNIDENTIFIED)]
    )


def route_text(rows: DataFrame, width: int = 120) -> DataFrame:
    """Road names of a file in order, as one text of at most ``width`` characters."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("leg_no", "road_name"))), lambda x: x["road_name"])
    return rows.groupBy("file_id").agg(F.substring(F.array_join(names, " > "), 1, width).alias("route"))
