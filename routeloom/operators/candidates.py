"""Roads near every point: a range join on grid cells, then exact distances.

Road pieces are listed under every cell that a disc of the search radius around them meets, one row a cell; a point looks up its own
cell only.  So the join is an equi-join on (zone, cell) after which a point has all its pieces in its row: roads are
replicated a few times, points never, nothing is grouped by point, and a crowded cell is an ordinary skewed key that adaptive
execution splits on the points' side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.config import Settings
from routeloom.functions import geo, text

CELL_M = 100.0


def with_identity(edges: DataFrame) -> DataFrame:
    """Adds road_id, road_name, ref and highway to edges; attributes may be scalars or arrays, or be absent."""
    kinds = dict(edges.dtypes)

    def one(c: str):
        if c not in kinds:
            return F.lit(None).cast("string")
        return text.first_value(F.col(c).cast("array<string>")) if kinds[c].startswith("array") else F.col(c).cast("string")

    who = text.road_identity(*[one(c) for c in ("name", "official_name", "ref", "alt_name", "highway", "osmid")])
    rest = [c for c in edges.columns if c not in ("name", "official_name", "alt_name", "ref", "highway", "osmid", "road_id", "road_name")]
    return edges.select(*rest, one("osmid").alias("osmid"), who.alias("__who")).select(*rest, "osmid", "__who.*")


def road_pieces(edges: DataFrame, radius_m: float) -> DataFrame:
    """Straight pieces of edges in metres, one row per cell that may see them.

    An edge near a zone border is listed in both zones.
    """
    own = with_identity(edges)
    at = F.element_at("geometry", 1)
    zones = F.array_distinct(F.array(*[geo.utm_epsg(at["lat"], at["lon"] + d) for d in (-0.1, 0.1)]))
    own = own.withColumn("epsg", F.explode(zones))
    hops = F.transform(F.sequence(F.lit(1), F.size("geometry") - 1), lambda i: F.struct(
        F.get("geometry", i - 1).alias("a"), F.get("geometry", i).alias("b")))
    own = own.select("*", F.posexplode(hops).alias("piece", "hop")).drop("geometry")
    x1, y1 = geo.to_utm(F.col("hop.a.lat"), F.col("hop.a.lon"), "epsg")
    x2, y2 = geo.to_utm(F.col("hop.b.lat"), F.col("hop.b.lon"), "epsg")
    own = own.withColumns({"x1": x1, "y1": y1, "x2": x2, "y2": y2}).drop("hop")
    own = own.withColumn("piece_m", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    from pyspark.sql import Window as W

    edge = W.partitionBy("u", "v", "k", "epsg")
    before = edge.orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    own = own.withColumns({
        "piece_from_m": F.coalesce(F.sum("piece_m").over(before), F.lit(0.0)),
        "index_length_m": F.coalesce(F.expr("try_cast(length_m AS DOUBLE)"), F.sum("piece_m").over(edge)),
        "route_length_m": F.coalesce(F.expr("try_cast(length_m AS DOUBLE)"), F.lit(1.0)),
    })
    cells = lambda a, b: F.sequence(
        F.floor((F.least(a, b) - radius_m) / CELL_M).cast("long"), F.floor((F.greatest(a, b) + radius_m) / CELL_M).cast("long"))
    own = own.withColumn("cx", F.explode(cells("x1", "x2"))).withColumn("cy", F.explode(cells("y1", "y2")))
    middle = (F.col("cx") + 0.5) * CELL_M, (F.col("cy") + 0.5) * CELL_M
    share = _share(*middle, F.col)
    near = F.hypot(middle[0] - (F.col("x1") + share * (F.col("x2") - F.col("x1"))), middle[1] - (F.col("y1") + share * (F.col("y2") - F.col("y1"))))
    return own.where(near <= radius_m + CELL_M * 0.7072)


def _share(x, y, of):
    """How far along the piece (0 to 1) the foot of a point lies; ``of`` gives the piece's columns."""
    dx, dy = of("x2") - of("x1"), of("y2") - of("y1")
    long2 = dx * dx + dy * dy
    share = F.when(long2 > 0, ((x - of("x1")) * dx + (y - of("y1")) * dy) / long2).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))


_PIECE = ("u", "v", "k", "piece", "road_id", "road_name", "ref", "highway", "osmid", "x1", "y1", "x2", "y2", "piece_m", "piece_from_m", "index_length_m", "route_length_m", "road_bearing", "bonus")


def with_candidates(points: DataFrame, edges: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Points with epsg, x, y and ``candidates``: the nearest roads, best distance first, with emission scores.

    ``points`` has epsg (the zone to match in).  Points without a road in reach get an empty array.
    """
    m = s.matching
    columns = [c for c in points.columns if c not in ("x", "y", "epsg")]
    x, y = geo.to_utm("lat", "lon", "epsg")
    own = points.select("file_id", "idx", "epsg", F.struct(*columns).alias("point")).withColumns({
        "px": geo.to_utm(F.col("point.lat"), F.col("point.lon"), "epsg")[0], "py": geo.to_utm(F.col("point.lat"), F.col("point.lon"), "epsg")[1],
    })
    own = own.withColumns({"cx": F.floor(F.col("px") / CELL_M).cast("long"), "cy": F.floor(F.col("py") / CELL_M).cast("long")})
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    bonus = F.create_map(*[F.lit(v) for kv in m.class_bonus.items() for v in kv])
    pieces = road_pieces(edges, s.max_distance_m).withColumns({
        "road_bearing": F.pmod(F.degrees(F.atan2(dx, dy)) + 360.0, F.lit(360.0)),
        "bonus": F.coalesce(F.try_element_at(bonus, F.col("highway")), F.lit(0.0)),
    })
    cells = pieces.groupBy("epsg", "cx", "cy").agg(F.collect_list(F.struct(*_PIECE)).alias("pieces"))
    by_point = own.join(cells, ["epsg", "cx", "cy"], "left")
    px, py = F.col("px"), F.col("py")

    def foot(p):
        share = _share(px, py, p.getField)
        return F.struct(p.alias("p"), (p["x1"] + share * (p["x2"] - p["x1"])).alias("x"), (p["y1"] + share * (p["y2"] - p["y1"])).alias("y"), share.alias("share"))

    def far(f):
        return F.struct(f["p"].alias("p"), f["x"].alias("x"), f["y"].alias("y"), f["share"].alias("share"), F.hypot(px - f["x"], py - f["y"]).alias("d"))

    def hit(f):
        p, d = f["p"], f["d"]
        score = -0.5 * F.pow(d / max(1e-3, m.sigma_gps_m), 2) + p["bonus"]
        if m.heading_weight > 0:
            turn = geo.angle_difference(F.col("point.bearing"), p["road_bearing"])
            score = score + F.coalesce(m.heading_weight * -0.5 * F.pow(turn / max(1e-3, m.sigma_heading_deg), 2), F.lit(0.0))
        way = p["piece_from_m"] + f["share"] * p["piece_m"]
        return F.struct(
            p["u"].alias("u"), p["v"].alias("v"), p["k"].alias("k"), F.round(d, 6).alias("near"), p["piece"].alias("piece"), F.round(d, 3).alias("rank"), d.alias("distance_m"),
            *[p[c].alias(c) for c in ("road_id", "road_name", "ref", "highway", "osmid", "road_bearing")],
            F.when(p["index_length_m"] > 0, way / p["index_length_m"]).otherwise(0.0).alias("fraction"),
            f["x"].alias("foot_x"), f["y"].alias("foot_y"), p["route_length_m"].alias("route_length_m"), score.alias("emission"),
        )

    # a point without a road in reach has an empty list
    found = F.filter(F.transform(F.transform("pieces", foot), far), lambda f: f["d"] <= s.max_distance_m)
    by_point = by_point.withColumn("hits", F.array_sort(F.transform(found, hit)))
    by_point = by_point.withColumn("hits", F.coalesce("hits", F.array().cast(by_point.schema["hits"].dataType))).drop("pieces")
    # nearest piece of each edge, then the inner radius if it has any, then the nearest few
    same = lambda a, b: reduce(lambda p, q: p & q, [a[c] == b[c] for c in ("u", "v", "k")])
    own_hits = F.filter("hits", lambda h, i: (i == 0) | ~same(h, F.get("hits", i - 1)))
    by_point = by_point.withColumn("hits", own_hits)
    inner = F.exists("hits", lambda h: h["distance_m"] <= s.candidate_radius_m)
    by_point = by_point.withColumn("hits", F.when(inner, F.filter("hits", lambda h: h["distance_m"] <= s.candidate_radius_m)).otherwise(F.col("hits")))
    ranked = F.array_sort(F.transform("hits", lambda h: F.struct(h["rank"].alias("rank"), h["u"].alias("u"), h["v"].alias("v"), h["k"].alias("k"), h.alias("hit"))))
    out = by_point.withColumn("candidates", F.transform(F.slice(ranked, 1, m.max_candidates), lambda r: r["hit"]))
    return out.select(*[F.col(f"point.{c}") for c in columns], "epsg", F.col("px").alias("x"), F.col("py").alias("y"), "candidates")
