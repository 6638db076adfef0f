"""Cleaning and simplification: faults planted at random in random drives, and properties of the kernels."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from routeloom.operators import clean, kernels, kinematics, simplify
from routeloom.plans.analysis import Analysis
from tests.conftest import degrees, path, recorded


def drive(rng, legs=6):
    """A drive of right angles and straight stretches at 7 m a second."""
    at, turns, way = np.zeros(2), [np.zeros(2)], np.array([1.0, 0.0])
    for _ in range(legs):
        at = at + way * rng.integers(12, 30) * 7.0
        turns.append(at)
        way = np.array([-way[1], way[0]]) * rng.choice([-1, 1])
    return path(*turns, every=7.0)


def planted(rng):
    """A drive with faults at places of their own: (x, y), seconds, and how many points each rule has to drop."""
    base = drive(rng)
    rows = [(x, y, float(i)) for i, (x, y) in enumerate(base)]
    places = rng.permutation(np.arange(5, len(base) - 5, 6))
    repeats, spikes, stays = places[:4], places[4:7], places[7:9]
    out, shift, idle = [], 0.0, 0
    for i, (x, y, s) in enumerate(rows):
        if i in spikes:
            angle, far = rng.uniform(0, 6.28), rng.uniform(1500, 4000)
            out.append((x + far * np.cos(angle), y + far * np.sin(angle), s + shift))
            continue
        out.append((x, y, s + shift))
        if i in repeats:
            out.append((x, y, s + shift))
        if i in stays:  # stands still, with a receiver that wanders by some centimetres
            n = int(rng.integers(8, 15))
            for k in range(1, n + 1):
                out.append((x + 0.1 * (-1) ** k, y + 0.1 * (k % 2), s + shift + k))
            shift += n
            idle += n - 2
    xy, seconds = np.array(out)[:, :2], np.array(out)[:, 2]
    return xy, seconds, {"removed_repeats": len(repeats), "removed_spikes": len(spikes), "removed_idle": idle}


def test_planted_faults_are_found(spark):
    rng = np.random.default_rng(31)
    worlds = {f"d{k}": planted(rng) for k in range(6)}
    a = Analysis(recorded(spark, {k: w[0] for k, w in worlds.items()}, {k: w[1] for k, w in worlds.items()}))
    stats = {r["file_id"]: r.asDict() for r in clean.clean_stats(a.original).collect()}
    for name, (xy, _, want) in worlds.items():
        assert {k: stats[name][k] for k in want} == want, name
        assert stats[name]["n_in"] == len(xy) and stats[name]["n_out"] == len(xy) - sum(want.values()) and stats[name]["removed_invalid"] == 0
        assert len(stats[name]["spike_indices"]) == want["removed_spikes"]
    kept = {r["file_id"]: r["n"] for r in a.cleaned.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kept == {name: stats[name]["n_out"] for name in worlds}


def test_spike_indices_are_the_first_twenty(spark):
    rng = np.random.default_rng(5)
    xy = path((0, 0), (2100, 0), every=7.0)
    at = np.arange(4, 300, 9)
    xy[at] += rng.uniform(2000, 3000, (len(at), 2))
    got = clean.clean_stats(kinematics.valid_points(recorded(spark, {"x": xy}))).first()
    assert got["removed_spikes"] == len(at) and got["spike_indices"] == at[:20].tolist()


def test_simplified_tracks_stay_close_and_keep_their_corners(spark):
    rng = np.random.default_rng(8)
    drives = {f"d{k}": drive(rng) for k in range(4)} | {"straight": path((0, 0), (900, 300), every=2.0), "one": np.zeros((1, 2)), "two": np.array([[0, 0], [9, 0]])}
    a = Analysis(recorded(spark, drives))
    kept = {}
    for r in a.simplified.orderBy("file_id", "idx").collect():
        kept.setdefault(r["file_id"], []).append(r["pt"])
    for name, xy in drives.items():
        at = kept[name]
        assert at[0] == 0 and at[-1] == len(xy) - 1 and at == sorted(set(at))
        for p, q in zip(at, at[1:], strict=False):  # what was left out lies by the line between its neighbours
            way = xy[q] - xy[p]
            aside = np.abs(np.cross(way, xy[p : q + 1] - xy[p])) / max(1e-9, np.hypot(*way))
            assert aside.max() <= 3.5 + 10.0 * (q - p > 30), name
    counts = {r["file_id"]: r for r in a.counts.collect()}
    assert counts["straight"]["reduction_percent"] > 60 and (counts["one"]["n_simplified"], counts["two"]["n_simplified"]) == (1, 2)


def test_figures_without_times(spark):
    xy = np.array([[0, 0], [30, 0], [30, 40], [30, 40]])
    out = kinematics.inspect(recorded(spark, {"x": xy}, clock=False)).first()
    assert out["duration_s"] is None and not out["has_time"] and out["fields"] == ["hdop"] and out["n_repeats"] == 1
    assert out["distance_m"] == pytest.approx(70, abs=0.05)
    rows = kinematics.kinematics(kinematics.valid_points(recorded(spark, {"x": xy}, clock=False))).orderBy("idx").collect()
    assert all(r["speed_kmh"] is None for r in rows)
    assert rows[0]["bearing"] == pytest.approx(90, abs=0.05) and rows[2]["bearing"] == pytest.approx(0, abs=0.05)


def test_speed_and_heading_in_every_direction(spark):
    turns = {f"h{h}": np.array([[0, 0], [50 * np.sin(np.radians(h)), 50 * np.cos(np.radians(h))]]) for h in range(0, 360, 40)}
    rows = kinematics.kinematics(kinematics.valid_points(recorded(spark, turns, {k: [0, 9] for k in turns}))).where("idx = 1").collect()
    assert len(rows) == 9
    for r in rows:
        assert r["speed_kmh"] == pytest.approx(20, abs=0.01) and abs((r["bearing"] - int(r["file_id"][1:]) + 180) % 360 - 180) < 0.1


def test_nothing_in_nothing_out(spark):
    a = Analysis(recorded(spark, {"x": [[0, 0]]}).where("false"))
    assert [f.count() for f in (a.files, a.cleaned, a.simplified)] == [0, 0, 0] and clean.clean_stats(a.original).count() == 0


walk = st.lists(st.tuples(st.integers(-40, 40), st.integers(-40, 40)), min_size=3, max_size=60)


@settings(max_examples=60, deadline=None)
@given(walk)
def test_peucker_leaves_out_only_near_points(steps):
    x, y = np.cumsum(np.array(steps, float), axis=0).T
    at = np.flatnonzero(kernels.douglas_peucker(x, y, 3.0))
    assert at[0] == 0 and at[-1] == len(x) - 1
    z = x + 1j * y
    for a, b in zip(at, at[1:], strict=False):
        d = z[b] - z[a]
        s = np.clip(((z[a : b + 1] - z[a]) * np.conj(d)).real / abs(d) ** 2, 0, 1) if d else 0.0
        assert np.abs(z[a : b + 1] - z[a] - s * d).max() <= 3.0 + 1e-5


@settings(max_examples=60, deadline=None)
@given(walk, st.floats(1, 60))
def test_samples_are_spaced(steps, spacing):
    x, y = np.cumsum(np.array(steps, float), axis=0).T
    way = np.concatenate(([0], np.cumsum(np.hypot(np.diff(x), np.diff(y)))))
    keep = np.flatnonzero(kernels.spaced_points(x, y, spacing))
    assert (np.diff(way[keep])[:-1] >= spacing - 1e-9).all()


def regrouped(road, dist, least):
    """The smoothing rule on a list of points, looked at afresh after every change."""
    road = list(road)
    for _ in range(100):
        edges = [0, *(i for i in range(1, len(road)) if road[i] != road[i - 1]), len(road)]
        spans = [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]
        far = [sum(dist[a:b]) for a, b in spans]
        for n, (a, b) in enumerate(spans):
            near = [m for m in (n - 1, n + 1) if 0 <= m < len(spans) and road[spans[m][0]] is not None]
            if road[a] is not None and far[n] < least and near:
                best = near[0] if far[near[0]] >= far[near[-1]] else near[-1]
                road[a:b] = [road[spans[best][0]]] * (b - a)
                break
        else:
            break
    return road


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, "a", "b", "c"]), st.integers(0, 15)), max_size=40))
def test_smoothing_against_a_plain_version(rows):
    road, dist = [r for r, _ in rows], [float(d) for _, d in rows]
    assert kernels.smoothed(road, dist, 20.0) == regrouped(road, dist, 20.0)


def test_utm_against_known_points(spark):
    """Two published points, and round trips over the globe."""
    from routeloom.functions import geo

    known = spark.createDataFrame([(43.642567, -79.387139), (0.0, 3.0)], "lat double, lon double").withColumn("epsg", geo.utm_epsg("lat", "lon"))
    x, y = geo.to_utm("lat", "lon", "epsg")
    rows = known.select("epsg", x.alias("x"), y.alias("y")).orderBy("epsg").collect()
    assert [r["epsg"] for r in rows] == [32617, 32631]
    assert rows[0]["x"] == pytest.approx(630084.30, abs=0.01) and rows[0]["y"] == pytest.approx(4833438.59, abs=0.01)
    assert rows[1]["x"] == pytest.approx(500000, abs=1e-6) and rows[1]["y"] == pytest.approx(0, abs=1e-6)
    rng = np.random.default_rng(2)
    some = spark.createDataFrame([(float(a), float(o)) for a, o in zip(rng.uniform(-79, 83, 200), rng.uniform(-180, 180, 200), strict=True)], "lat double, lon double")
    some = some.withColumn("epsg", geo.utm_epsg("lat", "lon"))
    x, y = geo.to_utm("lat", "lon", "epsg")
    lat, lon = geo.from_utm("x", "y", "epsg")
    back = some.withColumns({"x": x, "y": y}).select(F.max(F.abs(lat - F.col("lat"))), F.max(F.abs(lon - F.col("lon")))).first()
    assert max(back) < 1e-9


def test_kept_points_come_from_the_three_rules(spark):
    a = Analysis(recorded(spark, {"x": path((0, 0), (200, 0), (260, 180), every=2.0, sway=[0, 1.2, -0.8, 2.0, 0.4])}))
    marked = simplify.mark_kept(simplify.mark_anchors(simplify.with_metres(a.cleaned))).orderBy("idx").collect()
    assert all(r["sampled"] or r["peucker"] or r["anchor"] for r in marked if r["kept"]) and marked[0]["kept"] and marked[-1]["kept"]
    assert degrees([[0, 0]]).shape == (1, 2)
