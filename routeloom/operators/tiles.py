"""Map tiles: which ones a track needs, and the state machine of the tile cache."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routeloom.config import Settings
from routeloom.functions import geo


#: Files whose centres lie in one cell of this size are matched together, so that their roads are read once.
AREA_DEG = 0.25


def _edges(s: Settings, lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column) -> dict[str, Column]:
    """First and last tile index in both directions of a buffered extent."""
    high = s.road_buffer_m / (geo.DEGREE_KM * 1000)
    wide = high / F.greatest(F.lit(0.1), F.cos(F.radians((lat_min + lat_max) / 2)))
    return {
        "ix0": geo.tile_index(lon_min - wide, s.tile_km), "ix1": geo.tile_index(lon_max + wide, s.tile_km),
        "iy0": geo.tile_index(lat_min - high, s.tile_km), "iy1": geo.tile_index(lat_max + high, s.tile_km),
    }


def tile_ranges(points: DataFrame, s: Settings = Settings()) -> DataFrame:
    """file_id, ix0, ix1, iy0, iy1 and epsg (zone of the centre of the file's tiles)."""
    box = points.groupBy("file_id").agg(F.min("lat").alias("a0"), F.max("lat").alias("a1"), F.min("lon").alias("o0"), F.max("lon").alias("o1"))
    out = box.select("file_id", *[c.alias(n) for n, c in _edges(s, F.col("a0"), F.col("a1"), F.col("o0"), F.col("o1")).items()])
    step = s.tile_km / geo.DEGREE_KM
    mid = lambda a, b: (F.col(a) + F.col(b) + 1) / 2 * step
    return out.withColumn("epsg", geo.utm_epsg(mid("iy0", "iy1"), mid("ix0", "ix1")))


def with_zone(points: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Points with epsg (the zone of the centre of their file's tiles) and area (a grid cell of that centre), by a window over the file."""
    whole = W.partitionBy("file_id")
    box = [f(c).over(whole) for c in ("lat", "lon") for f in (F.min, F.max)]
    own = points.drop("epsg").withColumns(dict(zip(("__a0", "__a1", "__o0", "__o1"), box, strict=True)))
    e = _edges(s, *map(F.col, ("__a0", "__a1", "__o0", "__o1")))
    step = s.tile_km / geo.DEGREE_KM
    mid = lambda a, b: (a + b + 1) / 2 * step
    lat, lon = mid(e["iy0"], e["iy1"]), mid(e["ix0"], e["ix1"])
    own = own.withColumns({"epsg": geo.utm_epsg(lat, lon), "area": F.floor(lat / AREA_DEG) * 100_000 + F.floor(lon / AREA_DEG)})
    return own.drop("__a0", "__a1", "__o0", "__o1")


def tiles_of_tracks(points: DataFrame, s: Settings = Settings()) -> DataFrame:
    """file_id, ix, iy, tile_id and bounds of all tiles that each file needs."""
    out = tile_ranges(points, s).select("file_id", F.explode(F.sequence("ix0", "ix1")).alias("ix"), "iy0", "iy1")
    return with_bounds(out.select("file_id", "ix", F.explode(F.sequence("iy0", "iy1")).alias("iy")), s)


def with_bounds(tiles: DataFrame, s: Settings = Settings()) -> DataFrame:
    step = s.tile_km / geo.DEGREE_KM
    return tiles.withColumns({
        "tile_id": geo.tile_id("ix", "iy", s.tile_km),
        "lon_min": F.col("ix") * step, "lat_min": F.col("iy") * step,
        "lon_max": (F.col("ix") + 1) * step, "lat_max": (F.col("iy") + 1) * step,
    })


def union_of_tiles(tiles: DataFrame) -> DataFrame:
    """Every tile of a batch once."""
    return tiles.select("tile_id", "ix", "iy").distinct()


def tile_of(lat: float, lon: float, km: float) -> str:
    """Id of the tile of one coordinate (driver side)."""
    step = km / geo.DEGREE_KM
    return f"t{km:g}k_{math.floor(lon / step)}_{math.floor(lat / step)}"


def latest(catalog: DataFrame) -> DataFrame:
    """The newest row of every tile: later versions replace earlier ones."""
    columns = [c for c in catalog.columns if c != "tile_id"]
    best = catalog.groupBy("tile_id").agg(F.max_by(F.struct(*columns), F.col("version")).alias("row"))
    return best.select("tile_id", "row.*")


def decide(tiles: DataFrame, catalog: DataFrame, now: Column, s: Settings = Settings(), stored: DataFrame | None = None) -> DataFrame:
    """tile_id, state, age_days, outcome (reused, missing, download) and usable.

    A tile is reused when its row is young enough, not to be refreshed, and empty or stored.  ``stored``
    lists tile ids whose roads exist; None means all.  An expired tile is *missing* offline and still usable, since roads are
    loaded by state alone.
    """
    own = tiles.select("tile_id").distinct().join(latest(catalog), "tile_id", "left")
    if stored is None:
        own = own.withColumn("stored", F.lit(True))
    else:
        own = own.join(stored.select("tile_id", F.lit(True).alias("stored")), "tile_id", "left").withColumn("stored", F.coalesce("stored", F.lit(False)))
    age = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("downloaded").cast("timestamp"))) / 86400e6).cast("long")
    valid = F.col("state").isin("ok", "empty") & (age <= s.cache_days)
    reused = F.coalesce(valid & ((F.col("state") == "empty") | F.col("stored")), F.lit(False)) & F.lit(not s.refresh_cache)
    return own.select(
        "tile_id", "state", age.alias("age_days"),
        F.when(reused, "reused").otherwise("missing" if s.offline else "download").alias("outcome"),
        F.coalesce(F.col("state") == "ok", F.lit(False)).alias("usable"),
    )


def apply_downloads(catalog: DataFrame, results: DataFrame) -> DataFrame:
    """The catalogue after downloads (tile_id, version, roads, error, downloaded): ok, empty, or error over any older state."""
    state = F.when(F.col("error").isNotNull(), "error").when(F.col("roads") > 0, "ok").otherwise("empty")
    rows = results.select("tile_id", "version", state.alias("state"), "downloaded", F.coalesce("roads", F.lit(0)).cast("long").alias("roads"))
    return latest(catalog.select("tile_id", "version", "state", "downloaded", F.col("roads").cast("long").alias("roads")).unionByName(rows))
