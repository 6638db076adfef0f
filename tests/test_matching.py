"""Map matching, legs and confidence in small towns; the decoder against exhaustive search."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pytest

from routeloom.config import Matching
from routeloom.operators import legs, matching
from routeloom.plans.analysis import Analysis
from tests.conftest import path, recorded, town

CORNERS = {"a": (0, 0), "b": (240, 0), "c": (240, 210), "d": (0, 210), "e": (480, 0), "f": (0, 22), "g": (240, 22), "h": (700, 700), "i": (900, 700)}
STREETS = [
    {"via": "a b e", "name": "Mill Lane"}, {"via": "b c", "name": "Well Street"}, {"via": "c d", "ref": "K 9"}, {"via": "f g", "name": "Back Row"},
    {"via": "h i", "name": "Far Way", "only": True},
]


@pytest.fixture(scope="module")
def drives(spark):
    rng = np.random.default_rng(12)
    tracks = {
        "beside": path((5, 2), (235, 2), every=3.0, sway=rng.uniform(-2.5, 2.5, 50)),
        "round": path((30, 0), (240, 0), (240, 210), (20, 210), every=3.0),
        "shaky": path((260, 0), (470, 0), every=3.0, sway=7 * np.sin(np.arange(90))),
        "field": path((100, 450), (300, 450), every=5.0),
        "against": path((895, 701), (705, 701), every=4.0),
    }
    a = Analysis(recorded(spark, tracks), town(spark, CORNERS, STREETS))
    out: dict = {}
    for r in a.legs.orderBy("file_id", "leg_no").collect():
        out.setdefault(r["file_id"], []).append(r)
    return a, out


def test_roads_of_drives(drives):
    _, got = drives
    names = {k: [r["road_name"] for r in v] for k, v in got.items()}
    assert names["beside"] == ["Mill Lane"] and names["round"] == ["Mill Lane", "Well Street", "K 9"] and names["shaky"] == ["Mill Lane"]
    assert names["field"] == ["unidentified"] and got["field"][0]["confidence"] == "unidentified" and got["field"][0]["road_id"] is None
    assert names["against"] == ["Far Way"] and got["against"][0]["confidence"] == "low" and "strongly diverging heading" in got["against"][0]["notes"]
    assert got["round"][2]["road_id"] == "ref:k 9" and got["round"][1]["t_in"] is not None and got["round"][1]["confidence"] == "high"


def test_legs_divide_the_track(drives):
    a, got = drives
    n = {r["file_id"]: r["count"] for r in a.simplified.groupBy("file_id").count().collect()}
    for file, own in got.items():
        assert sorted(i for r in own for i in r["indices"]) == list(range(n[file])) and all(len(r["geometry"]) == r["n_points"] for r in own)
    far = {r["file_id"]: r["d"] for r in a.simplified.groupBy("file_id").agg({"dist_prev_m": "sum"}).withColumnRenamed("sum(dist_prev_m)", "d").collect()}
    assert all(sum(r["distance_m"] for r in own) == pytest.approx(far[file]) for file, own in got.items())
    status = {r["file_id"]: r["status"] for r in a.status.collect()}
    assert status["field"] == "partial" and status["round"] == "ok"


def _steps(rows):
    """Steps from lists of (u, v, k, fraction, length, emission)."""
    kinds = pa.list_(pa.struct([("u", pa.int64()), ("v", pa.int64()), ("k", pa.int64()), ("fraction", pa.float64()), ("route_length_m", pa.float64()), ("emission", pa.float64())]))
    names = ("u", "v", "k", "fraction", "route_length_m", "emission")
    return matching.Steps.of(pa.array([[dict(zip(names, c, strict=True)) for c in own] for own in rows], kinds))


def _way(net, p, q, hop, m):
    """Score of going from candidate p to candidate q, spelled out."""
    cutoff = max(m.cutoff_min_m, m.cutoff_factor * hop + m.cutoff_min_m)
    if p[:3] == q[:3]:
        way = abs(q[3] - p[3]) * p[4]
    else:
        d = net.distances(p[1], cutoff).get(q[0])
        if d is None or d > cutoff:
            return matching.UNREACHABLE
        way = p[4] * (1 - p[3]) + d + q[4] * q[3]
    return -abs(way - hop) / m.beta_m


def test_decoder_against_exhaustive_search():
    rng = np.random.default_rng(5)
    m, found = Matching(), 0
    for _ in range(150):
        n = 6
        links = [(int(a), int(b), float(d)) for a, b, d in zip(rng.integers(1, n, 9), rng.integers(1, n, 9), rng.uniform(8, 45, 9), strict=True)]
        net = matching.Network(*zip(*links, strict=True))
        rows = [[(int(rng.integers(1, n)), int(rng.integers(1, n)), k, float(rng.random()), 25.0, -4 * float(rng.random())) for k in range(rng.integers(1, 4))] for _ in range(rng.integers(1, 6))]
        hops = np.concatenate(([0.0], rng.uniform(1, 40, len(rows) - 1)))

        def total(way, rows=rows, hops=hops, net=net):
            own = [r[i] for r, i in zip(rows, way, strict=True)]
            return sum(c[5] for c in own) + sum(_way(net, p, q, h, m) for p, q, h in zip(own, own[1:], hops[1:], strict=False))

        best = max(total(w) for w in itertools.product(*(range(len(r)) for r in rows)))
        if best > -1e8:  # no step that nothing reaches
            found += 1
            assert total(matching.decode(_steps(rows), hops, net, m)) == pytest.approx(best, abs=1e-4)
    assert found > 50


def test_a_break_leads_back_to_the_nearest_candidate():
    net = matching.Network([1], [2], [30.0])
    rows = [[(1, 2, 0, 0.5, 10.0, -6.0), (3, 4, 0, 0.5, 10.0, -1.5)], [(7, 8, 0, 0.5, 10.0, -3.0), (9, 10, 0, 0.5, 10.0, -2.0)]]
    assert matching.decode(_steps(rows), np.array([0.0, 5.0]), net, Matching()) == [0, 1]


def test_distances_within_a_cutoff():
    rng = np.random.default_rng(3)
    links = [(int(a), int(b), float(d)) for a, b, d in zip(rng.integers(0, 12, 40), rng.integers(0, 12, 40), rng.uniform(1, 30, 40), strict=True)]
    full = np.full((12, 12), np.inf)
    np.fill_diagonal(full, 0)
    for a, b, d in links:
        full[a, b] = min(full[a, b], d)
    for k in range(12):
        full = np.minimum(full, full[:, k : k + 1] + full[k : k + 1])
    net = matching.Network(*zip(*links, strict=True))
    a, b, cutoff = rng.integers(0, 12, 300), rng.integers(0, 12, 300), rng.uniform(0, 80, 300)
    got = net.between(a, b, cutoff)
    assert np.allclose(np.where(full[a, b] <= cutoff, full[a, b], np.inf), got)


@pytest.mark.parametrize(
    ("mean", "most", "n", "turn", "margin", "level", "note"),
    [
        (7.9, 19.0, 3, 24.0, 1.6, "high", ""),
        (7.9, 19.0, 3, None, None, "high", ""),
        (8.1, 19.0, 9, 26.0, 1.4, "medium", "high mean distance; diverging heading; competing road nearby"),
        (7.0, 20.1, 9, 10.0, 9.0, "medium", ""),
        (18.6, 30.0, 9, 10.0, 9.0, "low", "points far from the road (mean 19 m)"),
        (5.0, 6.0, 9, 56.0, 9.0, "low", "strongly diverging heading"),
        (5.0, 6.0, 1, 0.0, 9.0, "low", "very short leg (few points)"),
    ],
)
def test_confidence_levels(spark, mean, most, n, turn, margin, level, note):
    kinds = "road_id string, mean_m double, max_m double, n_points int, turn_deg double, mean_margin double"
    rows = legs.classify(spark.createDataFrame([("name:x", mean, most, n, turn, margin), (None, mean, most, n, turn, margin)], kinds)).collect()
    assert (rows[0]["confidence"], rows[0]["notes"]) == (level, note) and rows[1]["confidence"] == "unidentified"


def test_identity_of_a_road(spark):
    from routeloom.operators.candidates import with_identity

    kinds = "u int, name array<string>, official_name string, ref string, alt_name string, highway string, osmid array<long>"
    rows = [
        (1, ["", "Grand'Rue Éléonore"], "Official", "D 4", None, "primary", [8, 9]), (2, None, None, "D 4", "Old Road", "primary", [8]), (3, [], None, None, "Old Road", None, [8]),
        (4, None, None, None, None, "track", [8, 9]), (5, None, None, None, None, "track", None), (6, None, None, None, None, None, None),
    ]
    got = {r["u"]: (r["road_id"], r["road_name"]) for r in with_identity(spark.createDataFrame(rows, kinds)).collect()}
    assert got[1] == ("name:grand rue eleonore", "Grand'Rue Éléonore") and got[2] == ("ref:d 4", "D 4") and got[3] == ("name:old road", "Old Road")
    assert got[4] == ("osm:8", "unnamed OSM 8") and got[5] == ("class:track", "unnamed track") and got[6][0] == "class:via"
