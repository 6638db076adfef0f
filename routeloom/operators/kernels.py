"""Sequential rules over the points of one track, as plain functions of numpy arrays.

These depend on what was kept before, which no window frame can say; they run once per track inside
``groupBy('file_id').applyInArrow`` and are linear in the track (Douglas-Peucker: one pass per split level).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

_EARTH_M = 6371000.0


def haversine(lat1, lon1, lat2, lon2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * _EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def distinct_points(lat: np.ndarray, lon: np.ndarray, t: np.ndarray, near_m: float, same_m: float = 0.05) -> np.ndarray:
    """Keeps a point unless it repeats the last kept one: at the same time within ``near_m``, or within ``same_m``.

    ``t`` is in microseconds, the least integer where unknown (never the same time).
    """
    keep = np.zeros(len(lat), bool)
    unknown = np.iinfo(np.int64).min
    same_m = min(same_m, near_m)
    phi, lam, when = np.radians(lat).tolist(), np.radians(lon).tolist(), t.tolist()
    sin, cos, asin, sqrt = math.sin, math.cos, math.asin, math.sqrt
    last = -1
    for i in range(len(phi)):
        if last >= 0:
            h = sin((phi[i] - phi[last]) / 2) ** 2 + cos(phi[last]) * cos(phi[i]) * sin((lam[i] - lam[last]) / 2) ** 2
            d = 2 * _EARTH_M * asin(min(1.0, sqrt(h)))
            if d <= (near_m if when[i] == when[last] and when[i] != unknown else same_m):
                continue
        keep[i] = True
        last = i
    return keep


def spaced_points(x: np.ndarray, y: np.ndarray, spacing: float) -> np.ndarray:
    """First and last point and, along the way, each point at which the path since the last one reaches ``spacing``."""
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    way = 0.0
    for i, hop in enumerate(np.hypot(np.diff(x), np.diff(y)).tolist(), 1):
        way += hop
        if way >= spacing:
            keep[i] = True
            way = 0.0
    return keep


def douglas_peucker(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Points that keep every other one within ``tolerance`` of its chord; of equally far points the first (to 1e-6 m)."""
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    open_ = [(0, len(x) - 1)]
    while open_:
        a, b = open_.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        long2 = dx * dx + dy * dy
        s = np.clip((px * dx + py * dy) / long2, 0, 1) if long2 > 0 else 0.0
        d = np.hypot(px - s * dx, py - s * dy)
        far = int(np.argmax(np.round(d, 6)))
        if d[far] > tolerance:
            far += a + 1
            keep[far] = True
            open_ += [(a, far), (far, b)]
    return keep


def thinned(x: np.ndarray, y: np.ndarray, kept: np.ndarray, protected: np.ndarray, least: float) -> np.ndarray:
    """Of the kept points, drops those nearer than ``least`` to the last one left, unless protected."""
    out = np.zeros(len(x), bool)
    last = -1
    for i in np.flatnonzero(kept).tolist():
        if last < 0 or protected[i] or np.hypot(x[i] - x[last], y[i] - y[last]) >= least:
            out[i] = True
            last = i
    return out


def smoothed(road: list, distance: list[float], least: float, rounds: int = 100) -> list:
    """Road of every point after short runs were given to a neighbour.

    Each round looks for the first run of an identified road shorter than ``least`` that has another road
    next to it: the same on both sides, else the longer neighbour (the one before on a tie), else the only one.
    """
    runs: list[list] = []  # road, distance, points
    for r, d in zip(road, distance, strict=True):
        if runs and runs[-1][0] == r:
            runs[-1][1].append(d)
        else:
            runs.append([r, [d]])
    for _ in range(rounds):
        for i, (r, d) in enumerate(runs):
            if r is None or sum(d) >= least:
                continue
            before = runs[i - 1][0] if i else None
            after = runs[i + 1][0] if i + 1 < len(runs) else None
            if before is not None and after is not None and before != after:
                new = before if sum(runs[i - 1][1]) >= sum(runs[i + 1][1]) else after
            else:
                new = before if before is not None else after
            if new is not None and new != r:
                runs[i][0] = new
                break
        else:
            break
        merged: list[list] = []
        for r, d in runs:
            if merged and merged[-1][0] == r:
                merged[-1][1] += d
            else:
                merged.append([r, list(d)])
        runs = merged
    return [r for r, d in runs for _ in d]


def micros(column: pa.ChunkedArray) -> np.ndarray:
    """Timestamps as microseconds; the least integer for null."""
    return column.cast(pa.timestamp("us")).cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()
