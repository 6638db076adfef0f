"""Report tables: files, legs, points, alerts, technical JSON and map layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.functions import geo, text
from routeloom.operators.legs import confidence_summary

OK, PARTIAL, ERROR, PENDING = "ok", "partial", "error", "pending"


def file_status(files: DataFrame, cleaned: DataFrame, legs: DataFrame) -> DataFrame:
    """file_id and status: error below two points after cleaning, partial without an identified leg, else ok."""
    left = cleaned.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    known = legs.groupBy("file_id").agg(F.count_if(F.col("confidence") != "unidentified").alias("n_known"))
    out = files.select("file_id").join(left, "file_id", "left").join(known, "file_id", "left")
    status = F.when(F.coalesce("n", F.lit(0)) < 2, ERROR).when(F.coalesce("n_known", F.lit(0)) == 0, PARTIAL).otherwise(OK)
    return out.select("file_id", status.alias("status"))


def status_counts(status: DataFrame) -> DataFrame:
    return status.agg(F.count(F.lit(1)).alias("n_files"), *[F.count_if(F.col("status") == x).alias(f"n_{x}") for x in (OK, PARTIAL, ERROR)])


def summary(files: DataFrame, counts: DataFrame, legs: DataFrame, status: DataFrame) -> DataFrame:
    """One row per file (files of ``inspect``, perhaps with ``name`` and ``map``, the path of its map page; counts of ``simplify_stats``)."""
    out = files.join(counts, "file_id", "left").join(confidence_summary(legs), "file_id", "left").join(status, "file_id", "left")
    numbers = ["n_original", "n_cleaned", "n_simplified", "n_legs", "n_high", "n_medium", "n_low", "n_unidentified"]
    out = out.na.fill(0, numbers)
    name = F.col("name") if "name" in files.columns else F.col("file_id").cast("string")
    return out.select(
        "file_id", text.video_id(name).alias("video_id"), "t_first", "t_last", text.duration(F.col("duration_s")).alias("duration"),
        F.round("distance_m", 1).alias("distance_m"), *numbers, "status", F.array_join("anomalies", "; ").alias("notes"),
        (F.col("map") if "map" in files.columns else F.lit(None).cast("string")).alias("map"),
    )


def leg_rows(legs: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One row per leg, rounded for a report; ``names`` (file_id, name) gives the camera ids."""
    if names is not None:
        legs = legs.join(names.select("file_id", F.col("name").alias("__name")), "file_id", "left")
    name = F.coalesce("__name", F.col("file_id").cast("string")) if names is not None else F.col("file_id").cast("string")
    return legs.select(
        "file_id", text.video_id(name).alias("video_id"), "leg_no", "road_name", "ref", "highway", F.coalesce("osmid", F.lit("")).alias("osmid"), "t_in", "t_out",
        text.duration(F.col("duration_s")).alias("duration"), F.round("distance_m", 1).alias("distance_m"),
        "lat_first", "lon_first", "lat_last", "lon_last", "n_points",
        F.round("mean_m", 2).alias("mean_m"), F.round("max_m", 2).alias("max_m"), "confidence", "notes",
    )


def point_rows(matched: DataFrame, legs: DataFrame) -> DataFrame:
    """One row per simplified point with the confidence of its leg."""
    of = legs.select("file_id", F.explode("indices").alias("idx"), "confidence")
    return matched.join(of, ["file_id", "idx"], "left").select(
        "file_id", "idx", "t", "lat", "lon", F.round("dist_cum_m", 1).alias("dist_cum_m"), F.round("speed_kmh", 1).alias("speed_kmh"),
        F.round("bearing", 1).alias("bearing"), F.coalesce("chosen.road_name", F.lit("")).alias("road_name"),
        F.coalesce("chosen.osmid", F.lit("")).alias("osmid"), F.round("road_m", 2).alias("road_m"),
        F.coalesce("second.road_name", F.lit("")).alias("second_road"), F.round("margin", 3).alias("margin"),
        F.coalesce("confidence", F.lit("")).alias("confidence"), "reason",
    )


def alerts(files: DataFrame, cleaned: DataFrame, status: DataFrame, repeats: DataFrame | None = None) -> DataFrame:
    """file_id, stage, kind, message, action: one row per alert."""
    row = lambda stage, kind, message, action: F.struct(*[F.lit(x).alias(n) for x, n in zip((stage, kind, message, action), ("stage", "kind", "message", "action"), strict=True)])
    n = cleaned.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    base = files.select("file_id", "n_points", "has_time", "lon_min", "lon_max").join(n, "file_id", "left").join(status, "file_id", "left")
    found = F.array_compact(F.array(
        F.when(~F.col("has_time"), row("read", "ALERT", "no times in the file", "check the recording")),
        F.when(F.col("n_points") == 0, row("read", "ERROR", "no valid point in the file", "the file is empty or has no valid coordinates")),
        F.when((F.col("n_points") > 0) & (F.coalesce("n", F.lit(0)) < 2), row("clean", "ERROR", "fewer than two points after cleaning", "")),
        F.when(geo.utm_zone("lon_min") != geo.utm_zone("lon_max"), row("read", "ALERT", "the extent spans several UTM zones", "distances far from the chosen zone are less exact")),
        F.when(F.col("status") == PARTIAL, row("roads", "ALERT", "no road identified", "run online or refresh the cache")),
    ))
    out = base.select("file_id", F.explode(found).alias("a")).select("file_id", "a.*")
    if repeats is not None:
        again = repeats.where("repeated").select(
            "file_id", F.lit("catalog").alias("stage"), F.lit("INFO").alias("kind"),
            F.concat(F.lit("processed before (run "), F.col("prior_id").cast("string"), F.lit(")")).alias("message"),
            F.lit("processed again with the current settings").alias("action"),
        )
        out = out.unionByName(again)
    return out


def alert_rows(found: DataFrame, processed: Column | None = None) -> DataFrame:
    """Alerts for a report with ``at``, their own time or else the time of processing; one line says so when there are none."""
    now = F.current_timestamp().cast("timestamp_ntz") if processed is None else processed
    found = found.withColumn("at", F.coalesce("at", now) if "at" in found.columns else now)
    none = found.sparkSession.range(1).join(found.limit(1).select(F.lit(1).alias("some")), F.lit(True), "left").where("some is null")
    line = none.select(*[F.lit("no error or alert" if c == "message" else None).cast(t).alias(c) for c, t in found.dtypes])
    return found.unionByName(line.withColumn("at", now))


def technical_json(files: DataFrame, counts: DataFrame, legs: DataFrame, found: DataFrame, status: DataFrame, settings: str = "{}") -> DataFrame:
    """file_id and json: identity, metadata, settings, statistics, legs and alerts of each file."""
    leg = F.struct(*[c for c in leg_rows(legs).columns if c not in ("file_id", "video_id")])
    by_leg = leg_rows(legs).groupBy("file_id").agg(F.array_sort(F.collect_list(leg)).alias("legs"))
    by_alert = found.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("stage", "kind", "message", "action"))).alias("alerts"))
    out = files.join(counts, "file_id", "left").join(status, "file_id", "left").join(by_leg, "file_id", "left").join(by_alert, "file_id", "left")
    meta = F.struct("n_tracks", "n_segments", "n_points", "t_first", "t_last", "duration_s", F.round("distance_m", 1).alias("distance_m"), "fields", "has_time", "anomalies")
    stats = F.struct("n_original", "n_cleaned", "n_simplified", F.round("reduction_percent", 2).alias("reduction_percent"))
    body = F.struct(
        F.col("file_id").alias("file"), "status", meta.alias("metadata"), F.lit(settings).alias("settings"), stats.alias("statistics"), "legs", "alerts"
    )
    return out.select("file_id", F.to_json(body).alias("json"))


def centres(original: DataFrame, cleaned: DataFrame, simplified: DataFrame) -> DataFrame:
    """file_id, lat and lon: mean of a file's simplified points, of its cleaned ones without those, else of all."""
    mean = lambda df, n: df.groupBy("file_id").agg(F.struct(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")).alias(f"c{n}"))
    out = mean(original, 0).join(mean(cleaned, 1), "file_id", "left").join(mean(simplified, 2), "file_id", "left")
    return out.select("file_id", F.coalesce("c2", "c1", "c0").alias("c")).select("file_id", "c.*")


def leg_info() -> Column:
    """What a map says about a leg."""
    return F.concat_ws(
        " | ", F.col("road_name"), F.nullif(F.col("ref"), F.lit("")), F.col("highway"), F.concat(F.round("distance_m", 1), F.lit(" m")),
        text.duration(F.col("duration_s")), F.concat(F.lit("mean "), F.round("mean_m", 1), F.lit(" m off")), F.col("confidence"), F.nullif(F.col("notes"), F.lit("")),
    )


def layers(original: DataFrame, cleaned: DataFrame, simplified: DataFrame, matched: DataFrame, legs: DataFrame) -> DataFrame:
    """Map layers: file_id, layer, ord, kind (line or point), name, confidence, info, coordinates (lon, lat)."""
    spot = F.struct("lon", "lat")

    def line(df: DataFrame, layer: str) -> DataFrame:
        way = F.transform(F.array_sort(F.collect_list(F.struct("idx", spot.alias("p")))), lambda x: x["p"])
        return df.groupBy("file_id").agg(way.alias("coordinates")).select(
            "file_id", F.lit(layer).alias("layer"), F.lit(0).cast("long").alias("ord"), F.lit("line").alias("kind"), F.lit("").alias("name"),
            F.lit("").alias("confidence"), F.lit("").alias("info"), "coordinates",
        )

    way = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("leg_no", "geometry"))), lambda x: x["geometry"]))
    fitted = legs.groupBy("file_id").agg(way.alias("coordinates")).select(
        "file_id", F.lit("fitted").alias("layer"), F.lit(0).cast("long").alias("ord"), F.lit("line").alias("kind"), F.lit("").alias("name"), F.lit("").alias("confidence"), F.lit("").alias("info"), "coordinates"
    )
    own = legs.select("file_id", F.lit("legs").alias("layer"), F.col("leg_no").cast("long").alias("ord"), F.lit("line").alias("kind"), F.col("road_name").alias("name"), "confidence", leg_info().alias("info"), F.col("geometry").alias("coordinates"))
    lost = matched.where("state is null").select(
        "file_id", F.lit("problems").alias("layer"), F.col("idx").alias("ord"), F.lit("point").alias("kind"), F.col("reason").alias("name"), F.lit("").alias("confidence"), F.lit("").alias("info"), F.array(spot).alias("coordinates")
    )
    out = line(original, "original").unionByName(line(cleaned, "cleaned")).unionByName(line(simplified, "simplified"))
    out = out.unionByName(fitted).unionByName(own)
    return out.where(F.size("coordinates") >= 2).unionByName(lost)
