"""Kinematics of live positions (an extension: the batch analysis is the reference behaviour).

``latest_hops`` keeps the last position of each device as state and emits distance, heading and speed of every new one; positions
later than the watermark are dropped.  :func:`write` starts a stream with a trigger.  ``activity`` counts positions and distance in event-time windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from routeloom.operators.kernels import haversine

IDLE_MS = 3_600_000
HOPS = "file_id long, t timestamp, lat double, lon double, dist_prev_m double, speed_kmh double"


def _hops(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    own = pd.concat(list(frames)).sort_values("t")
    last = state.get if state.exists else None
    lat, lon, t = own["lat"].to_numpy(), own["lon"].to_numpy(), own["t"].astype("datetime64[us]").astype("int64").to_numpy()
    before = last or (np.nan, np.nan, 0)
    d = haversine(np.append(before[0], lat[:-1]), np.append(before[1], lon[:-1]), lat, lon)
    seconds = (t - np.append(before[2], t[:-1])) / 1e6
    with np.errstate(divide="ignore", invalid="ignore"):
        speed = np.where((seconds > 0) & ~np.isnan(d), d / seconds * 3.6, np.nan)
    state.update((float(lat[-1]), float(lon[-1]), int(t[-1])))
    state.setTimeoutTimestamp(max(int(t[-1]) // 1000 + IDLE_MS, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"file_id": key[0], "t": own["t"], "lat": lat, "lon": lon, "dist_prev_m": np.nan_to_num(d), "speed_kmh": speed})


def latest_hops(points: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Streaming rows (file_id, t, lat, lon) with their hop from the device's position before; a device loses its state an hour of event time after its last one.

    Time is the data's, not the clock's, so a stream without new rows has nothing to do and starts no batches.
    """
    own = points.withWatermark("t", delay).select("file_id", "t", "lat", "lon")
    return own.groupBy("file_id").applyInPandasWithState(_hops, HOPS, "lat double, lon double, t long", "append", GroupStateTimeout.EventTimeTimeout)


def activity(points: DataFrame, window: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Positions of each device per event-time window."""
    return points.withWatermark("t", delay).groupBy("file_id", F.window("t", window)).agg(F.count(F.lit(1)).alias("n_points"))


def write(rows: DataFrame, path: str, checkpoint: str, every: str | None = "1 minute") -> StreamingQuery:
    """Append a stream's rows to Parquet files, a batch ``every`` so often, or (None) all there is and then stop."""
    out = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()
