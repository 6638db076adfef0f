"""Cleaning: invalid and imprecise points, repeats, spikes and idle clusters, and what each removed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routeloom.config import Settings
from routeloom.functions import geo
from routeloom.operators import kernels
from routeloom.operators.kinematics import kinematics, number

#: So many spikes are listed in the cleaning figures.
SPIKES_LISTED = 20


def precise(points: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Valid coordinates whose dilution of precision is unknown or small enough."""
    poor = F.coalesce(F.col("hdop") > s.cleaning.max_hdop, F.lit(False))
    return points.where(geo.valid_coordinate("lat", "lon") & ~poor)


def drop_repeats(points: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Drops points that repeat the last *kept* one of their file."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        lat, lon = table["lat"].to_numpy(), table["lon"].to_numpy()
        return table.filter(pa.array(kernels.distinct_points(lat, lon, kernels.micros(table["t"]), s.cleaning.duplicate_m)))

    return points.groupBy("file_id").applyInArrow(run, points.schema)


def mark_spikes(points: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Adds ``spike``: both hops of an inner point are faster than the limit."""
    by = W.partitionBy("file_id").orderBy("idx")
    fast = (F.col("speed_kmh") > s.max_speed_kmh) & (F.lead("speed_kmh").over(by) > s.max_speed_kmh)
    inner = F.lag("idx").over(by).isNotNull()
    return points.withColumn("spike", F.coalesce(fast & inner, F.lit(False)))


def mark_idle(points: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Adds ``idle``: an inner point of a run of slow points of full length (its ends stay)."""
    by = W.partitionBy("file_id").orderBy("idx")
    whole = W.partitionBy("file_id")
    slow = F.coalesce(F.col("speed_kmh") < s.cleaning.idle_kmh, F.lit(False))
    own = points.withColumn("__slow", slow)
    own = own.withColumn("__run", F.sum(F.when(F.col("__slow"), 0).otherwise(1)).over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    run = W.partitionBy("file_id", "__run", "__slow")
    place, size = F.row_number().over(run.orderBy("idx")), F.count(F.lit(1)).over(run)
    cut = F.col("__slow") & (size >= s.cleaning.idle_points) & (place > 1) & (place < size) & (F.count(F.lit(1)).over(whole) >= 3)
    return own.withColumn("idle", cut).drop("__slow", "__run")


def clean(points: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Points (numbered, valid or not) after all cleaning steps, renumbered, with kinematics."""
    columns = points.columns
    kept = drop_repeats(number(precise(points, s), "idx"), s)
    kept = mark_spikes(kinematics(number(kept, "idx")), s).where(~F.col("spike")).select(columns)
    kept = mark_idle(kinematics(number(kept, "idx")), s).where(~F.col("idle")).select(columns)
    return kinematics(number(kept, "idx"))


def with_reason(points: DataFrame, s: Settings = Settings()) -> DataFrame:
    """file_id, reason and idx of every point: why it was dropped (null if it stays) and its number at that step.

    Every step runs once: dropped points are carried along as a track of their own beside those that go on.
    """
    poor = ~geo.valid_coordinate("lat", "lon") | F.coalesce(F.col("hdop") > s.cleaning.max_hdop, F.lit(False))
    own = points.withColumn("reason", F.when(poor, "invalid")).withColumn("at", F.col("idx"))
    columns = own.columns

    def repeats(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        going = table["reason"].is_null().to_numpy()
        lat, lon, t = table["lat"].to_numpy()[going], table["lon"].to_numpy()[going], kernels.micros(table["t"])[going]
        reason = np.array(table["reason"].to_pylist(), object)
        reason[np.flatnonzero(going)[~kernels.distinct_points(lat, lon, t, s.cleaning.duplicate_m)]] = "repeat"
        return table.set_column(table.schema.get_field_index("reason"), "reason", pa.array(reason.tolist(), pa.string()))

    def step(df: DataFrame, mark, name: str) -> DataFrame:
        track = F.struct("file_id", F.col("reason").isNotNull().alias("gone"))
        marked = mark(kinematics(number(df.withColumn("file_id", track), "idx")), s)
        gone = F.col("file_id.gone")
        marked = marked.withColumns({"reason": F.when(~gone & F.col(name), name).otherwise(F.col("reason")), "at": F.when(gone, F.col("at")).otherwise(F.col("idx"))})
        return marked.withColumn("file_id", F.col("file_id.file_id")).select(columns)

    out = own.groupBy("file_id").applyInArrow(repeats, own.schema)
    out = step(step(out, mark_spikes, "spike"), mark_idle, "idle")
    return out.select("file_id", "reason", F.col("at").alias("idx"))


def clean_stats(points: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per file: points in and out, how many each step removed, and where the first 20 spikes were."""
    count = lambda reason: F.count_if(F.col("reason") == reason)
    spikes = F.array_sort(F.collect_list(F.when(F.col("reason") == "spike", F.col("idx"))))
    return with_reason(points, s).groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_in"), F.count_if(F.col("reason").isNull()).alias("n_out"), count("invalid").alias("removed_invalid"),
        count("repeat").alias("removed_repeats"), count("spike").alias("removed_spikes"), count("idle").alias("removed_idle"),
        F.slice(spikes, 1, SPIKES_LISTED).alias("spike_indices"),
    )
