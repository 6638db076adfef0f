"""A session, and small worlds in metres: named corners, streets between them, and paths that a receiver follows."""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from routeloom.session import session, ship  # noqa: E402

#: Where the small worlds lie: latitude, longitude, and degrees a metre to the east and to the north.
HOME = (46.81, 7.12)
EAST, NORTH = np.degrees(1 / 6371000 / np.cos(np.radians(HOME[0]))), np.degrees(1 / 6371000)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session(
        "local[4]", 4, spark__ui__enabled="false", spark__driver__memory="4g", spark__sql__autoBroadcastJoinThreshold="1m",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()


def degrees(xy) -> np.ndarray:
    """(lon, lat) rows of (x, y) rows in metres."""
    return np.asarray(xy, float).reshape(-1, 2) * [EAST, NORTH] + [HOME[1], HOME[0]]


def town(spark, corners: dict[str, tuple[float, float]], streets: list[dict]):
    """Edges of streets; a street has ``via`` (corners, as "a b c"), perhaps ``only`` (one direction), and attributes."""
    number = {c: 7 * n + 3 for n, c in enumerate(sorted(corners))}
    rows = []
    for n, street in enumerate(streets):
        via = street["via"].split()
        hops = list(zip(via, via[1:], strict=False))
        for a, b in hops if street.get("only") else hops + [(b, a) for a, b in hops]:
            line = [{"lon": float(lon), "lat": float(lat)} for lon, lat in degrees([corners[a], corners[b]])]
            length = float(np.hypot(*np.subtract(corners[a], corners[b])))
            rows.append((number[a], number[b], 0, 50 + n, street.get("name"), street.get("ref"), street.get("highway", "tertiary"), length, line))
    kinds = "u long, v long, k int, osmid long, name string, ref string, highway string, length_m double, geometry array<struct<lon: double, lat: double>>"
    return spark.createDataFrame(rows, kinds)


def path(*turns: tuple[float, float], every: float = 4.0, sway=None) -> np.ndarray:
    """Points each ``every`` metres along straight ways between the turns, moved aside by ``sway`` (one number a point)."""
    turns = np.array(turns, float)
    hop = np.diff(turns, axis=0)
    upto = np.concatenate(([0], np.cumsum(np.hypot(*hop.T))))
    s = np.append(np.arange(0, upto[-1], every), upto[-1])
    out = np.stack([np.interp(s, upto, turns[:, i]) for i in (0, 1)], axis=1)
    if sway is not None:
        way = hop[np.clip(np.searchsorted(upto, s, "right") - 1, 0, len(hop) - 1)]
        aside = np.stack((-way[:, 1], way[:, 0]), axis=1) / np.hypot(*way.T)[:, None]
        out += aside * np.resize(sway, len(s))[:, None]
    return out


def recorded(spark, tracks: dict, clock=None):
    """Raw points of tracks (rows of x, y); ``clock`` gives a track's seconds, False for no times, else there is a point a second."""
    rows = []
    for file, xy in tracks.items():
        at = degrees(xy)
        seconds = range(len(at)) if clock is None else clock[file] if clock else [None] * len(at)
        for i, ((lon, lat), s) in enumerate(zip(at.tolist(), seconds, strict=True)):
            rows.append((file, 0, i // 40, i, lat, lon, None, None if s is None else float(s), None, 0.9))
    df = spark.createDataFrame(rows, "file_id string, trk int, seg int, pt long, lat double, lon double, ele double, s double, fix string, hdop double")
    from pyspark.sql import functions as F

    t = F.timestamp_seconds(F.lit(1_750_000_000) + F.col("s")).cast("timestamp_ntz")
    return df.select("file_id", "trk", "seg", "pt", "lat", "lon", "ele", t.alias("t"), "fix", "hdop")
