"""Virtual tracks, streets and a tile catalogue derived from the test tables by integer arithmetic.

Coordinates are running sums of integers in units of 1e-5 degree, so any engine computes the same points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from routeloom.functions import geo


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw points of one track per user: file_id, trk, seg, pt, lat, lon, ele, t, fix, hdop."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", F.col("user_id").alias("file_id"))
    by = W.partitionBy("file_id").orderBy("ts", "event_id")
    i, k, f = F.col("i"), F.col("event_id"), F.col("file_id")
    e = e.withColumn("i", (F.row_number().over(by) - 1).cast("long"))
    idle = (f % 3 == 0) & (i % 20).between(8, 14)
    e = e.withColumn("step", F.when((i == 0) | idle, 0).otherwise(6)).withColumn("leg", F.floor(i / 20) % 4)
    leg, step = F.col("leg"), F.col("step")
    run = by.rowsBetween(W.unboundedPreceding, W.currentRow)
    east = F.sum(F.when(leg.isin(0, 2), step).otherwise(0)).over(run)
    north = F.sum(F.when(leg == 1, step).when(leg == 3, -step).otherwise(0)).over(run)
    jitter = (k * 31) % 3 - 1
    spike = F.when((k % 211 == 0) & (i > 0), 5000).otherwise(0)
    lat = -302000 + (F.floor(f / 12) % 12) * 120 + north + F.when(leg.isin(0, 2), jitter).otherwise(0) + spike
    lon = -5994000 + (f % 12) * 120 + east + F.when(leg.isin(1, 3), jitter).otherwise(0)
    lost, wrong = k % 307 == 0, k % 311 == 0
    seconds = i - F.when((k % 41 == 0) & (i > 0), 1).otherwise(0)
    start = F.lit("2026-07-01 12:00:00").cast("timestamp_ntz")
    return e.select(
        "file_id",
        F.lit(0).alias("trk"),
        F.floor(i / 50).cast("int").alias("seg"),
        i.alias("pt"),
        F.when(lost, 0.0).when(wrong, 95.0).otherwise(lat.cast("double") / 100000).alias("lat"),
        F.when(lost, 0.0).otherwise(lon.cast("double") / 100000).alias("lon"),
        F.lit(None).cast("double").alias("ele"),
        F.when(f % 25 != 7, start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)).alias("t"),
        F.lit(None).cast("string").alias("fix"),
        F.when(k % 97 == 0, 45.0).otherwise(1 + (k % 20).cast("double") / 10).alias("hdop"),
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, pos) of 34 streets with 16 blocks each."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k")).where("k <= 16")
    line = n.select(F.explode(F.array(F.col("k"), F.col("k") + 17)).alias("line"))
    return line.crossJoin(n.where("k < 16").select(F.col("k").alias("pos")))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("a")).where("a <= 16")
    grid = n.crossJoin(n.select(F.col("a").alias("b")))
    return grid.select(
        (F.col("a") * 100 + F.col("b")).alias("node_id"),
        ((-5994000 + 120 * F.col("a")).cast("double") / 100000).alias("lon"),
        ((-302000 + 120 * F.col("b")).cast("double") / 100000).alias("lat"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges with attributes: u, v, k, osmid, name, ref, highway, length_m and geometry (lon, lat)."""
    line, pos = F.col("line"), F.col("pos")
    level, flat = line % 17, line < 17
    node = lambda p: F.when(flat, p * 100 + level).otherwise(level * 100 + p)
    one = _lines(spark, sf_dir).select(line, node(pos).alias("p"), node(pos + 1).alias("q"))
    way = F.when(line % 7 == 3, F.array(F.struct(F.col("p").alias("u"), F.col("q").alias("v")))).otherwise(
        F.array(F.struct(F.col("p").alias("u"), F.col("q").alias("v")), F.struct(F.col("q").alias("u"), F.col("p").alias("v")))
    )
    d = one.select("line", F.explode(way).alias("w")).select("line", "w.u", "w.v")
    deg = lambda c, base: (base + 120 * c).cast("double") / 100000
    u, v = F.col("u"), F.col("v")
    ulon, ulat = deg(F.floor(u / 100), -5994000), deg(u % 100, -302000)
    vlon, vlat = deg(F.floor(v / 100), -5994000), deg(v % 100, -302000)
    name = (
        F.when(line % 6 >= 4, F.lit(None))
        .when(line % 4 == 0, F.concat(F.lit("Av. São João "), line.cast("string")))
        .when(line % 4 == 1, F.concat(F.lit("R. Conceição-"), line.cast("string")))
        .otherwise(F.concat(F.lit("Estr. do Açaí "), line.cast("string")))
    )
    kinds = F.array(*map(F.lit, ("primary", "secondary", "tertiary", "residential", "service")))
    return d.select(
        "u", "v", F.lit(0).alias("k"), (1000 + line).alias("osmid"), name.alias("name"),
        F.when(line % 6 == 4, F.concat(F.lit("BR-"), line.cast("string"))).alias("ref"),
        F.element_at(kinds, (line % 5 + 1).cast("int")).alias("highway"),
        geo.haversine_m(ulat, ulon, vlat, vlon).alias("length_m"),
        F.array(F.struct(ulon.alias("lon"), ulat.alias("lat")), F.struct(vlon.alias("lon"), vlat.alias("lat"))).alias("geometry"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile catalogue rows from suppliers: state by key modulo 5 (4 has no row); newer rows repeat some tiles."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("k"))
    k = F.col("k")
    day = F.lit("2026-07-01 00:00:00").cast("timestamp_ntz")
    return s.where("k % 5 < 4").select(
        F.concat(F.lit("t5k_"), (-1335 + k % 9).cast("string"), F.lit("_"), (-68 + F.floor(k / 9) % 7).cast("string")).alias("tile_id"),
        k.alias("version"),
        F.when(k % 5 == 1, "empty").when(k % 5 == 2, "error").otherwise("ok").alias("state"),
        (day - F.make_dt_interval((k % 4) * 40 + F.when(k % 5 == 3, 100).otherwise(0))).alias("downloaded"),
        F.when(k % 5 == 0, 10 + k).otherwise(0).alias("roads"),
    )
