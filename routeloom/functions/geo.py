"""Geodesy as column expressions: great-circle measures, UTM and tiles.

Everything here is whole-stage codegen arithmetic; there is no Python on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Mean earth radius, and the WGS84 ellipsoid with the UTM scale and origin.
EARTH_M = 6371000.0
AXIS_M, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, EAST_M, SOUTH_M = 0.9996, 500000.0, 10000000.0
DEGREE_KM = 111.32

_N = FLATTENING / (2 - FLATTENING)
#: Rectifying radius and the coefficients of the fourth-order Krueger series, as polynomials in the third flattening.
RECTIFYING_M = AXIS_M / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)


def _series(*rows: tuple[float, ...]) -> tuple[float, ...]:
    return tuple(sum(c * _N ** (i + 1) for i, c in enumerate(r)) for r in rows)


ALPHA = _series((1 / 2, -2 / 3, 5 / 16, 41 / 180), (0, 13 / 48, -3 / 5, 557 / 1440), (0, 0, 61 / 240, -103 / 140), (0, 0, 0, 49561 / 161280))
BETA = _series((1 / 2, -2 / 3, 37 / 96, -1 / 360), (0, 1 / 48, 1 / 15, -437 / 1440), (0, 0, 17 / 480, -37 / 840), (0, 0, 0, 4397 / 161280))
DELTA = _series((2, -2 / 3, -2, 116 / 45), (0, 7 / 3, -8 / 5, -227 / 45), (0, 0, 56 / 15, -136 / 35), (0, 0, 0, 4279 / 630))
ECCENTRIC = 2 * math.sqrt(_N) / (1 + _N)


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres; null if a coordinate is null."""
    a1, o1, a2, o2 = map(_c, (lat1, lon1, lat2, lon2))
    p1, p2 = F.radians(a1), F.radians(a2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(o2 - o1) / 2), 2)
    known = a1.isNotNull() & o1.isNotNull() & a2.isNotNull() & o2.isNotNull()
    return F.when(known, 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing 0..360 from north; 0 for equal points."""
    a1, o1, a2, o2 = map(_c, (lat1, lon1, lat2, lon2))
    p1, p2, d = F.radians(a1), F.radians(a2), F.radians(o2 - o1)
    y = F.sin(d) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def angle_difference(a, b) -> Column:
    """Smallest angle between two headings, 0..180."""
    d = F.pmod(_c(a) - _c(b), F.lit(360.0))
    return F.when(d.isNotNull(), F.least(d, 360.0 - d))


def axis_difference(a, b) -> Column:
    """Smallest angle between two undirected lines, 0..90."""
    d = angle_difference(a, b)
    return F.when(d.isNotNull(), F.least(d, 180.0 - d))


def valid_coordinate(lat, lon) -> Column:
    """Known, a number, in range, and not the (0, 0) that receivers write without a fix."""
    a, o = _c(lat), _c(lon)
    real = a.isNotNull() & o.isNotNull() & ~F.isnan(a) & ~F.isnan(o)
    inside = a.between(-90, 90) & o.between(-180, 180)
    return F.coalesce(real & inside & ~((F.abs(a) < 1e-7) & (F.abs(o) < 1e-7)), F.lit(False))


def utm_zone(lon) -> Column:
    z = F.floor((_c(lon) + 180.0) / 6.0).cast("int") + 1
    return F.greatest(F.lit(1), F.least(F.lit(60), z))


def utm_epsg(lat, lon) -> Column:
    return F.when(_c(lat) >= 0, 32600 + utm_zone(lon)).otherwise(32700 + utm_zone(lon))


def central_meridian(epsg) -> Column:
    return F.pmod(_c(epsg), F.lit(100)) * 6.0 - 183.0


def _north0(epsg) -> Column:
    return F.when(_c(epsg) >= 32700, SOUTH_M).otherwise(0.0)


def to_utm(lat, lon, epsg) -> tuple[Column, Column]:
    """(x, y) metres in the UTM zone ``epsg``."""
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon) - central_meridian(epsg))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - ECCENTRIC * F.atanh(ECCENTRIC * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    k = SCALE * RECTIFYING_M
    return EAST_M + k * x, _north0(epsg) + k * y


def from_utm(x, y, epsg) -> tuple[Column, Column]:
    """(lat, lon) degrees of metres in the UTM zone ``epsg``."""
    k = SCALE * RECTIFYING_M
    xi, eta = (_c(y) - _north0(epsg)) / k, (_c(x) - EAST_M) / k
    xi0, eta0 = xi, eta
    for j, b in enumerate(BETA, 1):
        xi0 = xi0 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta0 = eta0 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    phi = chi
    for j, d in enumerate(DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.degrees(phi), central_meridian(epsg) + F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0)))


def to_local(lat, lon, lat0, lon0) -> tuple[Column, Column]:
    """(x, y) metres east and north of an origin, azimuthal equidistant on the sphere."""
    d = haversine_m(lat0, lon0, lat, lon)
    b = F.radians(bearing_deg(lat0, lon0, lat, lon))
    return d * F.sin(b), d * F.cos(b)


def tile_index(degrees, km: float) -> Column:
    return F.floor(_c(degrees) / (km / DEGREE_KM)).cast("long")


def tile_id(ix, iy, km: float) -> Column:
    return F.concat(F.lit(f"t{km:g}k_"), _c(ix).cast("string"), F.lit("_"), _c(iy).cast("string"))


def register(spark: SparkSession) -> None:
    """SQL functions rl_haversine, rl_bearing, rl_angle, rl_valid_coordinate, rl_utm_epsg and rl_tile."""
    d = "DOUBLE"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION rl_haversine(a1 {d}, o1 {d}, a2 {d}, o2 {d}) RETURNS {d} RETURN
        CASE WHEN a1 + o1 + a2 + o2 IS NOT NULL THEN 2 * {EARTH_M}D * asin(least(1D, sqrt(pow(sin(radians(a2 - a1) / 2), 2)
        + cos(radians(a1)) * cos(radians(a2)) * pow(sin(radians(o2 - o1) / 2), 2)))) END""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION rl_bearing(a1 {d}, o1 {d}, a2 {d}, o2 {d}) RETURNS {d} RETURN
        pmod(degrees(atan2(sin(radians(o2 - o1)) * cos(radians(a2)), cos(radians(a1)) * sin(radians(a2))
        - sin(radians(a1)) * cos(radians(a2)) * cos(radians(o2 - o1)))) + 360D, 360D)""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION rl_angle(a {d}, b {d}) RETURNS {d} RETURN
        CASE WHEN a + b IS NOT NULL THEN least(pmod(a - b, 360D), 360D - pmod(a - b, 360D)) END""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION rl_valid_coordinate(a {d}, o {d}) RETURNS BOOLEAN RETURN
        coalesce(NOT isnan(a) AND NOT isnan(o) AND a BETWEEN -90 AND 90 AND o BETWEEN -180 AND 180
        AND NOT (abs(a) < 1e-7D AND abs(o) < 1e-7D), false)""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION rl_utm_epsg(a {d}, o {d}) RETURNS INT RETURN
        IF(a >= 0, 32600, 32700) + greatest(1, least(60, CAST(floor((o + 180D) / 6D) AS INT) + 1))""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION rl_tile(a {d}, o {d}, km {d}) RETURNS STRUCT<ix: BIGINT, iy: BIGINT> RETURN
        named_struct('ix', floor(o / (km / {DEGREE_KM}D)), 'iy', floor(a / (km / {DEGREE_KM}D)))""")
