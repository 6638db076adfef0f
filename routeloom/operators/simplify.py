"""Simplification: curve and speed anchors, Douglas-Peucker, distance sampling, and thinning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeloom.config import Settings
from routeloom.functions import geo
from routeloom.operators import kernels
from routeloom.operators.kinematics import kinematics, number

SPEED_STEP_KMH = 15.0


def with_metres(points: DataFrame) -> DataFrame:
    """Adds epsg (UTM zone of the centre of the file's extent), x and y."""
    whole = W.partitionBy("file_id")
    mid = lambda c: (F.min(c).over(whole) + F.max(c).over(whole)) / 2
    own = points.withColumn("epsg", geo.utm_epsg(mid("lat"), mid("lon")))
    x, y = geo.to_utm("lat", "lon", "epsg")
    return own.withColumns({"x": x, "y": y})


def mark_anchors(points: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Adds ``anchor``: an inner point where the heading turns or the speed steps."""
    by = W.partitionBy("file_id").orderBy("idx")
    turn = geo.angle_difference(F.col("bearing"), F.lead("bearing").over(by)) >= s.curve_deg
    step = F.abs(F.col("speed_kmh") - F.lag("speed_kmh").over(by)) >= SPEED_STEP_KMH
    inner = F.lag("idx").over(by).isNotNull() & F.lead("idx").over(by).isNotNull()
    return points.withColumn("anchor", inner & (F.coalesce(turn, F.lit(False)) | F.coalesce(step, F.lit(False))))


def mark_kept(points: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Adds sampled, peucker and kept (all criteria, thinned) to points with x, y and anchor."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        x, y, anchor = (table[c].to_numpy() for c in ("x", "y", "anchor"))
        if len(x) <= 2:
            marks = [np.ones(len(x), bool)] * 3
        else:
            ends = np.zeros(len(x), bool)
            ends[[0, -1]] = True
            sampled = kernels.spaced_points(x, y, s.spacing_m)
            peucker = kernels.douglas_peucker(x, y, s.simplify_tolerance_m)
            least = max(1.0, 0.3 * s.spacing_m)
            marks = [sampled, peucker, kernels.thinned(x, y, anchor | sampled | peucker | ends, anchor | ends, least)]
        for name, mark in zip(("sampled", "peucker", "kept"), marks, strict=True):
            table = table.append_column(name, pa.array(mark))
        return table

    schema = T.StructType([*points.schema.fields, *(T.StructField(c, T.BooleanType()) for c in ("sampled", "peucker", "kept"))])
    return points.groupBy("file_id").applyInArrow(run, schema)


def simplify(cleaned: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Kept points of cleaned tracks, renumbered, with new kinematics."""
    marked = mark_kept(mark_anchors(with_metres(cleaned), s), s)
    return kinematics(number(marked.where("kept").drop("anchor", "sampled", "peucker", "kept"), "idx"))


def simplify_stats(original: DataFrame, cleaned: DataFrame, simplified: DataFrame) -> DataFrame:
    """Points of each file at each stage, and the reduction against the original in percent."""
    count = lambda df, name: df.groupBy("file_id").agg(F.count(F.lit(1)).alias(name))
    out = count(original, "n_original").join(count(cleaned, "n_cleaned"), "file_id", "left").join(count(simplified, "n_simplified"), "file_id", "left")
    out = out.na.fill(0, ["n_cleaned", "n_simplified"])
    left = 100.0 * (1 - F.col("n_simplified") / F.col("n_original"))
    return out.withColumn("reduction_percent", F.when(F.col("n_original") > 0, left).otherwise(0.0))
