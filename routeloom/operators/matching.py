"""Map matching: a hidden Markov model over road candidates, decoded by Viterbi.

Files of one area are decoded together, a few ten thousand points at a time, with the part of the road network that their steps can reach,
joined to them by grid cell: no task needs the whole network, and no file has a copy of its own.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeloom.config import Matching, Settings
from routeloom.functions import geo
from routeloom.operators import kernels

UNREACHABLE = -1e9
_REACH_CELL_DEG = 0.01
_GROUP_POINTS = 4096


class Network:
    """Directed distances from a node within a cutoff, remembered per node."""

    def __init__(self, u: list, v: list, length: list):
        self.out: dict = {}
        for a, b, d in zip(u, v, length, strict=True):
            self.out.setdefault(a, []).append((b, d))
        self.known: dict = {}

    def distances(self, node, cutoff: float) -> dict:
        """Distances of nodes within ``cutoff`` (and perhaps some farther ones)."""
        reach, found = self.known.get(node, (-1.0, {}))
        if reach >= cutoff:
            return found
        found, heap = {}, [(0.0, node)]
        while heap:
            d, at = heapq.heappop(heap)
            if at in found:
                continue
            found[at] = d
            for to, step in self.out.get(at, ()):
                if to not in found and d + step <= cutoff:
                    heapq.heappush(heap, (d + step, to))
        self.known[node] = cutoff, found
        return found


    def between(self, a: np.ndarray, b: np.ndarray, cutoff: np.ndarray) -> np.ndarray:
        """Distance from node a[i] to node b[i] if it is within cutoff[i], else infinite."""
        heads, which = np.unique(a, return_inverse=True)
        widest = np.zeros(len(heads))
        np.maximum.at(widest, which, cutoff)
        pairs, pair_of = np.unique(np.stack((which, b)), axis=1, return_inverse=True)
        inf, reach = float("inf"), [self.distances(h, c) for h, c in zip(heads.tolist(), widest.tolist(), strict=True)]
        d = np.array([reach[h].get(to, inf) for h, to in zip(*pairs.tolist(), strict=True)])[pair_of.ravel()]
        return np.where(d <= cutoff, d, np.inf)


@dataclass
class Steps:
    """Candidates of consecutive points as flat arrays; those of point t are at ``offs[t]`` to ``offs[t + 1]``."""

    u: np.ndarray
    v: np.ndarray
    k: np.ndarray
    fraction: np.ndarray
    length: np.ndarray
    emission: np.ndarray
    offs: np.ndarray

    @classmethod
    def of(cls, candidates: pa.ListArray) -> Steps:
        flat = candidates.flatten()
        number = lambda c, kind: flat.field(c).to_numpy(zero_copy_only=False).astype(kind)
        offs = np.concatenate(([0], np.cumsum(candidates.value_lengths().fill_null(0).to_numpy())))
        return cls(*(number(c, np.int64) for c in ("u", "v", "k")), *(number(c, float) for c in ("fraction", "route_length_m", "emission")), offs)

    def part(self, a: int, b: int) -> Steps:
        """Points a to b - 1."""
        lo, hi = self.offs[a], self.offs[b]
        return Steps(*(x[lo:hi] for x in (self.u, self.v, self.k, self.fraction, self.length, self.emission)), self.offs[a : b + 1] - lo)


def cutoff_m(hop: np.ndarray, m: Matching) -> np.ndarray:
    return np.maximum(m.cutoff_min_m, m.cutoff_factor * np.asarray(hop, float) + m.cutoff_min_m)


def transitions(c: Steps, hops: np.ndarray, net: Network, m: Matching) -> list[np.ndarray]:
    """For every point but the first a matrix of scores (candidates of the point before by own candidates).

    The way between two projections follows the roads within the step's cutoff; one edge may be driven either way.
    """
    n = np.diff(c.offs)
    sizes = n[:-1] * n[1:]
    step = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(step)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    a, b = c.offs[step] + place // n[step + 1], c.offs[step + 1] + place % n[step + 1]
    hop = hops[1:][step]
    if not len(a):
        return []
    same = (c.u[a] == c.u[b]) & (c.v[a] == c.v[b]) & (c.k[a] == c.k[b])
    between = net.between(c.v[a], c.u[b], cutoff_m(hop, m))
    way = np.where(same, np.abs(c.fraction[b] - c.fraction[a]) * c.length[a], c.length[a] * (1 - c.fraction[a]) + between + c.length[b] * c.fraction[b])
    score = np.where(np.isinf(way), UNREACHABLE, -np.abs(way - hop) / max(1e-3, m.beta_m))
    return [x.reshape(n[t], n[t + 1]) for t, x in enumerate(np.split(score, np.cumsum(sizes)[:-1]))]


def decode(c: Steps, hops: np.ndarray, net: Network, m: Matching) -> list[int]:
    """Chosen candidate of each point of a run in which every point has some.

    A step that nothing reaches restarts from its emissions.  Going back, a state without a predecessor leads to the
    nearest candidate (number 0) of the point before.  Scores are rounded to 1e-6, so equal ways tie and the first wins.
    """
    emission = np.split(c.emission, c.offs[1:-1])
    score, back = np.round(emission[0], 6), []
    for way, own in zip(transitions(c, hops, net, m), emission[1:], strict=True):
        total = np.round(np.where(score > UNREACHABLE / 2, score, -np.inf)[:, None] + way, 6)
        best, source = total.max(axis=0), total.argmax(axis=0)
        lost = best <= UNREACHABLE
        score = np.round(np.where(lost, UNREACHABLE, best) + own, 6)
        source[lost] = -1
        if (score <= UNREACHABLE / 2).all():
            score, source = np.round(own, 6), np.full(len(own), -1)
        back.append(source)
    path = [int(score.argmax())]
    for source in reversed(back):
        path.append(max(0, int(source[path[-1]])))
    return path[::-1]


def edges_near(centres: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Keys (as of_key), from, to, length of the edges that start in a grid cell within ``radius_m`` of a centre (keys, lat, lon, radius_m)."""
    own = centres.withColumn("__r", F.col("radius_m") / (geo.DEGREE_KM * 1000))
    wide = F.col("__r") / F.greatest(F.lit(0.05), F.cos(F.radians("lat")))
    cells = lambda c, r: F.sequence(F.floor((F.col(c) - r) / _REACH_CELL_DEG).cast("long"), F.floor((F.col(c) + r) / _REACH_CELL_DEG).cast("long"))
    near = own.select(*keys, F.explode(cells("lon", wide)).alias("gx"), "lat", "__r")
    near = near.select(*keys, "gx", F.explode(cells("lat", F.col("__r"))).alias("gy")).distinct()
    start = F.element_at("geometry", 1)
    net = edges.select(
        F.floor(start["lon"] / _REACH_CELL_DEG).cast("long").alias("gx"), F.floor(start["lat"] / _REACH_CELL_DEG).cast("long").alias("gy"),
        F.col("u").cast("long").alias("from"), F.col("v").cast("long").alias("to"), F.coalesce(F.expr("try_cast(length_m AS DOUBLE)"), F.lit(1.0)).alias("length"),
    )
    return near.join(net, ["gx", "gy"]).select(*[F.col(k).alias(f"of_{k}") for k in keys], "from", "to", "length")


def distances(nodes: DataFrame, edges: DataFrame, far_m: float) -> DataFrame:
    """source, to and dist of all nodes (node_id, lat, lon) within ``far_m`` along the roads."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        net = Network(*(right[c].to_pylist() for c in ("from", "to", "length")))
        out = [(s, to, d) for s in left["source"].to_pylist() for to, d in net.distances(s, far_m).items() if d <= far_m]
        return pa.table({n: pa.array(x, k) for n, x, k in zip(("source", "to", "dist"), zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    cell = lambda c: F.floor(F.col(c) / _REACH_CELL_DEG).cast("long")
    centres = nodes.select(F.col("node_id").alias("source"), cell("lon").alias("cx"), cell("lat").alias("cy"), "lat", "lon", F.lit(far_m).alias("radius_m"))
    near = edges_near(centres, edges, ["cx", "cy"])
    return centres.groupBy("cx", "cy").cogroup(near.groupBy("of_cx", "of_cy")).applyInArrow(run, "source long, to long, dist double")


def reachable_edges(points: DataFrame, edges: DataFrame, s: Settings = Settings()) -> DataFrame:
    """of_area, of_part, from, to, length of the edges that the steps of each group of files can use (points of :func:`in_groups`).

    Every way of a step starts at the head of a candidate and stays within the step's cutoff of it.
    """
    m = s.matching
    by = W.partitionBy("file_id").orderBy("idx")
    hop = F.hypot(F.lead("x").over(by) - F.col("x"), F.lead("y").over(by) - F.col("y"))
    longest = F.array_max(F.transform("candidates", lambda c: c["route_length_m"]))
    radius = F.greatest(F.lit(m.cutoff_min_m), m.cutoff_factor * hop + m.cutoff_min_m) + longest + s.max_distance_m
    return edges_near(points.where(F.size("candidates") > 0).withColumn("radius_m", F.coalesce(radius, F.lit(0.0))), edges, ["area", "part"])


def in_groups(points: DataFrame) -> DataFrame:
    """Points with part: files of an area are dealt to as many parts as its points need."""
    parts = points.groupBy("area").agg(F.ceil(F.count(F.lit(1)) / _GROUP_POINTS).alias("parts"))
    return points.join(parts, "area").withColumn("part", F.pmod(F.xxhash64("file_id"), F.col("parts"))).drop("parts")


def match(points: DataFrame, edges: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Points with candidates (and their file's area), and state (number of the chosen one), leg_road (its road after smoothing), second and margin."""
    m = s.matching
    points = in_groups(points)
    kept = [f for f in points.schema.fields if f.name not in ("area", "part")]
    schema = T.StructType([*kept, T.StructField("state", T.IntegerType()), T.StructField("leg_road", T.StringType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([("file_id", "ascending"), ("idx", "ascending")]).select([f.name for f in kept])
        net = Network(*(right[c].to_pylist() for c in ("from", "to", "length")))
        candidates = left["candidates"].combine_chunks()
        steps = Steps.of(candidates)
        x, y = left["x"].to_numpy(), left["y"].to_numpy()
        hops = np.concatenate(([0.0], np.hypot(np.diff(x), np.diff(y))))
        n = np.diff(steps.offs)
        file = left["file_id"].combine_chunks().dictionary_encode().indices.to_numpy()
        begins = np.concatenate(([True], file[1:] != file[:-1]))
        # runs of points with candidates inside a file
        some = n > 0
        starts = np.flatnonzero(some & (begins | ~np.concatenate(([False], some[:-1]))))
        ends = np.flatnonzero(some & np.concatenate((begins[1:] | ~some[1:], [True]))) + 1
        state = np.full(len(n), -1, np.int64)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            state[a:b] = decode(steps.part(a, b), hops[a:b], net, m)
        known = state >= 0
        names = candidates.flatten().field("road_id").take(pa.array(steps.offs[:-1][known] + state[known])).to_pylist()
        chosen: list = [None] * len(n)
        for i, name in zip(np.flatnonzero(known).tolist(), names, strict=True):
            chosen[i] = name
        far, roads = left["dist_prev_m"].to_pylist(), []
        for a, b in zip(np.flatnonzero(begins).tolist(), [*np.flatnonzero(begins)[1:].tolist(), len(n)], strict=True):
            roads += kernels.smoothed(chosen[a:b], far[a:b], s.min_leg_m)
        return left.append_column("state", pa.array(state, pa.int32(), mask=~known)).append_column("leg_road", pa.array(roads, pa.string()))

    local = reachable_edges(points, edges, s)
    done = points.groupBy("area", "part").cogroup(local.groupBy("of_area", "of_part")).applyInArrow(run, schema)
    return describe(done)


def describe(matched: DataFrame) -> DataFrame:
    """Adds chosen, second (best emission among the others), margin, road_m, foot_lat, foot_lon (on the chosen road) and reason."""
    chosen = F.get("candidates", F.col("state"))
    others = F.filter("candidates", lambda c, i: i != F.col("state"))
    best = F.element_at(F.array_sort(F.transform(others, lambda c, i: F.struct((-F.round(c["emission"], 6)).alias("a"), i.alias("i"), c.alias("c")))), 1)
    out = matched.withColumn("chosen", F.when(F.col("state").isNotNull(), chosen))
    out = out.withColumn("second", F.when(F.col("state").isNotNull() & (F.size("candidates") > 1), best["c"]))
    lat, lon = geo.from_utm("chosen.foot_x", "chosen.foot_y", "epsg")
    return out.withColumns({
        "foot_lat": lat,
        "foot_lon": lon,
        "margin": F.col("chosen.emission") - F.col("second.emission"),
        "road_m": F.col("chosen.distance_m"),
        "reason": F.when(F.col("state").isNull(), F.lit("no road within the radius")).otherwise(F.lit("")),
    })
