"""The registered queries over virtual tracks, streets and catalogues (see ``fixtures``), one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom import fixtures
from routeloom.config import Settings, identity
from routeloom.functions import geo, text
from routeloom.operators import catalog, clean, kinematics, legs, matching, reports, simplify, tiles
from routeloom.plans.analysis import Analysis
from routeloom.sources import gpx, roads

_ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    _ALL[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_ALL)


def _analysis(spark: SparkSession, d: str) -> Analysis:
    return Analysis(fixtures.tracks(spark, d), fixtures.edges(spark, d))


def _r(c: str, n: int = 3):
    return F.round(c, n).alias(c)


# ---- reading and kinematics


@query
def inspect_tracks(spark, d):
    out = kinematics.inspect(fixtures.tracks(spark, d))
    return out.select(
        "file_id", "n_tracks", "n_segments", "n_invalid", "n_points", "lat_min", "lat_max", "lon_min", "lon_max", "t_first", "t_last",
        "duration_s", _r("distance_m", 2), "n_jumps", "n_repeats", "has_time", F.array_join("fields", ",").alias("fields"),
    )


@query
def anomaly_report(spark, d):
    out = kinematics.inspect(fixtures.tracks(spark, d))
    return out.where(F.size("anomalies") > 0).select("file_id", F.posexplode("anomalies").alias("ord", "anomaly"))


@query
def valid_points(spark, d):
    return kinematics.valid_points(fixtures.tracks(spark, d)).select("file_id", "idx", "seg", "lat", "lon", "t", "hdop")


@query
def point_kinematics(spark, d):
    out = kinematics.kinematics(kinematics.valid_points(fixtures.tracks(spark, d)))
    return out.select("file_id", "idx", _r("dist_prev_m"), _r("dist_cum_m"), _r("speed_kmh"), _r("bearing"))


@query
def geo_measures(spark, d):
    t = fixtures.tracks(spark, d).where(geo.valid_coordinate("lat", "lon"))
    home = (F.lit(-2.875), F.lit(-59.75))
    b = geo.bearing_deg(*home, "lat", "lon")
    x, y = geo.to_local("lat", "lon", *home)
    return t.select(
        "file_id", "pt", F.round(geo.haversine_m(*home, "lat", "lon"), 3).alias("home_m"), F.round(b, 3).alias("home_bearing"),
        F.round(geo.angle_difference(b, F.lit(350.0)), 3).alias("turn"), F.round(geo.axis_difference(b, F.lit(350.0)), 3).alias("axis"),
        F.round(x, 3).alias("east_m"), F.round(y, 3).alias("north_m"),
    )


@query
def sql_functions(spark, d):
    geo.register(spark)
    fixtures.tracks(spark, d).createOrReplaceTempView("rl_points")
    return spark.sql("""
        SELECT file_id, pt, rl_valid_coordinate(lat, lon) AS ok, round(rl_haversine(-2.875D, -59.75D, lat, lon), 2) AS home_m,
               rl_utm_epsg(lat, lon) AS epsg, rl_tile(lat, lon, 5D).ix AS ix, rl_tile(lat, lon, 5D).iy AS iy
        FROM rl_points""")


# ---- cleaning


@query
def precise_points(spark, d):
    return clean.precise(kinematics.valid_points(fixtures.tracks(spark, d))).select("file_id", "idx", "hdop")


@query
def dedup_keep_last(spark, d):
    points = kinematics.number(clean.precise(kinematics.valid_points(fixtures.tracks(spark, d))), "idx")
    return clean.drop_repeats(points).select("file_id", "idx", "pt")


def _deduplicated(spark, d) -> DataFrame:
    points = kinematics.number(clean.precise(kinematics.valid_points(fixtures.tracks(spark, d))), "idx")
    return kinematics.kinematics(kinematics.number(clean.drop_repeats(points), "idx"))


@query
def spike_filter(spark, d):
    return clean.mark_spikes(_deduplicated(spark, d)).select("file_id", "idx", "pt", "spike")


@query
def idle_thinning(spark, d):
    points = clean.mark_spikes(_deduplicated(spark, d)).where("not spike").select("file_id", "idx", "pt", "lat", "lon", "t")
    return clean.mark_idle(kinematics.kinematics(kinematics.number(points, "idx"))).select("file_id", "idx", "pt", "idle")


@query
def clean_pipeline(spark, d):
    out = _analysis(spark, d).cleaned
    return out.select("file_id", "idx", "pt", _r("dist_prev_m"), _r("dist_cum_m"), _r("speed_kmh"), _r("bearing"))


@query
def clean_pipeline_stats(spark, d):
    out = clean.clean_stats(kinematics.valid_points(fixtures.tracks(spark, d)))
    return out.withColumn("spike_indices", F.array_join(F.col("spike_indices").cast("array<string>"), ","))


# ---- coordinate systems


@query
def utm_zone(spark, d):
    t = fixtures.tracks(spark, d).where(geo.valid_coordinate("lat", "lon"))
    lon = F.col("lon") + F.col("file_id") % 50
    return t.select("file_id", "pt", geo.utm_zone(lon).alias("zone"), geo.utm_epsg(F.col("lat") + F.col("file_id") % 7, lon).alias("epsg"))


@query
def utm_project(spark, d):
    t = simplify.with_metres(kinematics.valid_points(fixtures.tracks(spark, d)))
    return t.select("file_id", "idx", "epsg", _r("x"), _r("y"))


@query
def utm_roundtrip(spark, d):
    t = simplify.with_metres(kinematics.valid_points(fixtures.tracks(spark, d)))
    lat, lon = geo.from_utm("x", "y", "epsg")
    return t.select("file_id", "idx", F.round(lat, 8).alias("lat"), F.round(lon, 8).alias("lon"))


# ---- simplification


@query
def curve_anchors(spark, d):
    return simplify.mark_anchors(_analysis(spark, d).cleaned).select("file_id", "idx", "anchor")


def _marked(spark, d) -> DataFrame:
    return simplify.mark_kept(simplify.mark_anchors(simplify.with_metres(_analysis(spark, d).cleaned)))


@query
def distance_sampling(spark, d):
    return _marked(spark, d).where("sampled").select("file_id", "idx")


@query
def douglas_peucker(spark, d):
    return _marked(spark, d).where("peucker").select("file_id", "idx")


@query
def thin_close_points(spark, d):
    return _marked(spark, d).where("kept").select("file_id", "idx")


@query
def simplify_stats(spark, d):
    return _analysis(spark, d).counts.withColumn("reduction_percent", F.round("reduction_percent", 3))


# ---- tiles and catalogue


@query
def tile_assignment(spark, d):
    t = fixtures.tracks(spark, d).where(geo.valid_coordinate("lat", "lon"))
    ix, iy = geo.tile_index("lon", 5.0), geo.tile_index("lat", 5.0)
    return t.select("file_id", "pt", ix.alias("ix"), iy.alias("iy"), geo.tile_id(ix, iy, 5.0).alias("tile_id"))


@query
def tiles_for_tracks(spark, d):
    out = tiles.tiles_of_tracks(kinematics.valid_points(fixtures.tracks(spark, d)))
    return out.select("file_id", "ix", "iy", "tile_id", *[_r(c, 6) for c in ("lon_min", "lat_min", "lon_max", "lat_max")])


@query
def tile_union(spark, d):
    return tiles.union_of_tiles(tiles.tiles_of_tracks(kinematics.valid_points(fixtures.tracks(spark, d))))


@query
def tile_upsert_latest(spark, d):
    return tiles.latest(fixtures.catalog(spark, d))


_NOW = "2026-07-01 06:00:00"


def _needed(spark, d) -> DataFrame:
    return tiles.tiles_of_tracks(kinematics.valid_points(fixtures.tracks(spark, d)))


@query
def tile_cache_decision(spark, d):
    out = tiles.decide(_needed(spark, d), fixtures.catalog(spark, d), F.lit(_NOW).cast("timestamp_ntz"))
    return out.withColumn("age_days", F.coalesce("age_days", F.lit(-1)))


@query
def tile_cache_offline(spark, d):
    stored = tiles.latest(fixtures.catalog(spark, d)).where("version % 2 = 1")
    out = tiles.decide(_needed(spark, d), fixtures.catalog(spark, d), F.lit(_NOW).cast("timestamp_ntz"), Settings(offline=True), stored)
    return out.withColumn("age_days", F.coalesce("age_days", F.lit(-1)))


@query
def tile_outcome_counts(spark, d):
    out = tiles.decide(_needed(spark, d), fixtures.catalog(spark, d), F.lit(_NOW).cast("timestamp_ntz"))
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if("usable").alias("n_usable"))


@query
def tile_downloads(spark, d):
    k = F.col("version")
    results = tiles.latest(fixtures.catalog(spark, d)).select(
        "tile_id", (k + 1000).alias("version"), F.when(k % 3 == 0, F.lit("timeout")).alias("error"), F.when(k % 3 == 1, 7).alias("roads"),
        F.lit(_NOW).cast("timestamp_ntz").alias("downloaded"),
    )
    return tiles.apply_downloads(fixtures.catalog(spark, d), results).select("tile_id", "version", "state", "roads")


@query
def base_versions(spark, d):
    out = catalog.base_version(_needed(spark, d).select("file_id", "tile_id"), fixtures.catalog(spark, d))
    return out.withColumn("base_version", F.col("base_version").cast("string"))


def _history(spark, d) -> tuple[DataFrame, DataFrame]:
    files = fixtures.tracks(spark, d).select("file_id").distinct()
    own = files.select("file_id", F.sha2(F.concat(F.lit("track "), (F.col("file_id") % 40).cast("string")), 256).alias("file_hash"), F.lit("a").alias("config_hash"))
    past = spark.read.parquet(f"{d}/customer.parquet").select(
        F.col("c_custkey").cast("long").alias("id"), F.sha2(F.concat(F.lit("track "), (F.col("c_custkey") % 60).cast("string")), 256).alias("file_hash"),
        F.when(F.col("c_custkey") % 3 == 0, "b").otherwise("a").alias("config_hash"),
    )
    return own, past


@query
def repeat_detection(spark, d):
    return catalog.previous_runs(*_history(spark, d)).select("file_id", "file_hash", F.coalesce("prior_id", F.lit(-1)).alias("prior_id"), "repeated")


@query
def download_errors(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("tile_id"), F.col("text").alias("message"))
    return catalog.truncated(t).select("tile_id", F.sha2("message", 256).alias("message_sha256"), F.length("message").cast("long").alias("n"))


# ---- text


def _names(spark, d) -> DataFrame:
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    lead = F.element_at(F.array(*map(F.lit, ("Av.", "R.", "Estr.", "Prof. Dr.", "Pça", "S. João -", ""))), (F.col("k") % 7 + 1).cast("int"))
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("long").alias("k"), F.col("p_name").alias("n_name"))
    raw = F.concat(lead, F.lit(" "), F.col("n_name"), F.lit(" _Ção-Él'ñ  "), (F.col("k") % 5).cast("string"))
    return n.unionByName(p.select((F.col("k") + 1000).alias("k"), "n_name")).select("k", F.when(F.col("k") % 11 != 3, raw).alias("name"))


@query
def normalize_road_names(spark, d):
    return _names(spark, d).select("k", text.strip_accents(F.col("name")).alias("plain"), text.normalized_name(F.col("name")).alias("normalized"))


@query
def road_identity(spark, d):
    n = _names(spark, d)
    k = F.col("k")
    pick = lambda m, c: F.when(k % m == 0, c)
    who = text.road_identity(
        pick(2, F.col("name")), pick(3, F.concat(F.lit("Oficial "), k.cast("string"))), pick(5, F.concat(F.lit("BR-"), k.cast("string"))),
        pick(7, F.lit("Alt. da Sé")), pick(4, F.lit("primary")), pick(13, k),
    )
    return n.select("k", who.alias("w")).select("k", "w.*")


@query
def video_id(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("k"))
    lead = F.element_at(F.array(*map(F.lit, ("GX0", "gh12", "GL", "trip.v", "GP9"))), (F.col("k") % 5 + 1).cast("int"))
    name = F.concat(lead, F.lpad((F.col("k") % 1000).cast("string"), 3, "0"), F.when(F.col("k") % 7 == 0, "").otherwise(".gpx"))
    return o.select("k", name.alias("name"), text.video_id(name).alias("video_id"))


@query
def format_duration(spark, d):
    l = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * F.col("l_orderkey") / 2).alias("s"))  # noqa: E741
    return l.select("l_orderkey", "l_linenumber", text.duration(F.when(F.col("l_orderkey") % 9 != 0, F.col("s"))).alias("duration"))


@query
def safe_file_name(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("long").alias("k"), "p_name")
    tail = F.element_at(F.array(*map(F.lit, ("...", '<a>:"b"', "/x\\y|?*", "  ", "."))), (F.col("k") % 5 + 1).cast("int"))
    return p.select("k", text.safe_file_name(F.when(F.col("k") % 13 == 0, F.lit(" ... ")).otherwise(F.concat("p_name", tail))).alias("name"))


@query
def config_identity(spark, d):
    n = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").cast("long").alias("k"))
    hashes = [identity(Settings(spacing_m=10.0 + i)) for i in range(5)]
    return n.select("k", F.element_at(F.array(*map(F.lit, hashes)), (F.col("k") + 1).cast("int")).alias("config_hash"))


# ---- roads and matching


@query
def road_edges(spark, d):
    from routeloom.operators.candidates import with_identity

    return with_identity(fixtures.edges(spark, d)).select("u", "v", "k", "osmid", "road_id", "road_name", "ref", "highway", _r("length_m"))


def _candidates(spark, d) -> DataFrame:
    return _analysis(spark, d).located.select("file_id", "idx", F.posexplode("candidates").alias("pos", "c"))


@query
def candidate_edges(spark, d):
    out = _candidates(spark, d)
    return out.select("file_id", "idx", "pos", "c.u", "c.v", "c.k", F.round("c.distance_m", 3).alias("distance_m"), F.round("c.road_bearing", 3).alias("road_bearing"), F.round("c.fraction", 4).alias("fraction"))


@query
def emission_scores(spark, d):
    return _candidates(spark, d).select("file_id", "idx", "pos", F.round("c.emission", 3).alias("emission"))


@query
def nearest_roads(spark, d):
    out = _analysis(spark, d).located
    return out.select("file_id", "idx", F.size("candidates").cast("long").alias("n"), F.round(F.array_min(F.transform("candidates", lambda c: c["distance_m"])), 3).alias("nearest_m"))


@query
def network_distances(spark, d):
    """Distances up to 450 m between all nodes."""
    return matching.distances(fixtures.nodes(spark, d), fixtures.edges(spark, d), 450.0).select("source", "to", _r("dist"))


@query
def viterbi_path(spark, d):
    out = _analysis(spark, d).matched
    none = F.lit(-1).cast("long")
    return out.select(
        "file_id", "idx", F.coalesce(F.col("state").cast("long"), none).alias("state"), F.coalesce("chosen.u", none).alias("u"),
        F.coalesce("chosen.v", none).alias("v"), F.col("chosen.road_id").alias("road_id"),
    )


@query
def match_margins(spark, d):
    out = _analysis(spark, d).matched
    return out.select("file_id", "idx", F.round("road_m", 3).alias("road_m"), F.round("margin", 3).alias("margin"), "reason")


@query
def road_runs(spark, d):
    out = legs.with_legs(_analysis(spark, d).matched.withColumn("road", F.col("chosen.road_id")), "road")
    return out.groupBy("file_id", "leg_no").agg(F.any_value("road").alias("road"), F.count(F.lit(1)).alias("n"), F.round(F.sum("dist_prev_m"), 2).alias("distance_m"))


@query
def smooth_runs(spark, d):
    return legs.with_legs(_analysis(spark, d).matched).select("file_id", "idx", "leg_road", "leg_no")


@query
def legs_table(spark, d):
    return _analysis(spark, d).legs.select(
        "file_id", "leg_no", "road_id", "road_name", "ref", "highway", "osmid", "t_in", "t_out", "duration_s", _r("distance_m", 2), "n_points",
        "lat_first", "lon_first", "lat_last", "lon_last", _r("mean_m", 2), _r("max_m", 2), F.size("indices").cast("long").alias("n_indices"),
        F.size("geometry").cast("long").alias("n_geometry"),
    )


@query
def leg_confidence(spark, d):
    return _analysis(spark, d).legs.select("file_id", "leg_no", _r("turn_deg", 2), _r("mean_margin", 2), "confidence", "notes")


@query
def confidence_summary(spark, d):
    return legs.confidence_summary(_analysis(spark, d).legs)


@query
def route_string(spark, d):
    return legs.route_text(_analysis(spark, d).legs)


# ---- reports


@query
def report_summary(spark, d):
    a = _analysis(spark, d)
    return reports.summary(a.files, a.counts, a.legs, a.status)


@query
def report_legs(spark, d):
    return reports.leg_rows(_analysis(spark, d).legs).select("file_id", "video_id", "leg_no", "road_name", "duration", "distance_m", "mean_m", "max_m", "confidence", "notes")


@query
def report_points(spark, d):
    a = _analysis(spark, d)
    return reports.point_rows(a.matched, a.legs)


@query
def report_alerts(spark, d):
    out = reports.alert_rows(_analysis(spark, d).alerts, F.lit(_NOW).cast("timestamp_ntz"))
    return out.withColumn("file_id", F.col("file_id").cast("string"))


@query
def batch_status(spark, d):
    return reports.status_counts(_analysis(spark, d).status)


@query
def route_json(spark, d):
    """What the technical JSON of each file says, read back from its text."""
    a = _analysis(spark, d)
    out = reports.technical_json(a.files, a.counts, a.legs, a.alerts, a.status, '{"spacing_m": 10}')
    kind = (
        "file STRING, status STRING, metadata STRUCT<n_segments: LONG, n_points: LONG, t_first: STRING, duration_s: DOUBLE, distance_m: DOUBLE, has_time: BOOLEAN, anomalies: ARRAY<STRING>>, "
        "settings STRING, statistics STRUCT<n_original: LONG, n_cleaned: LONG, n_simplified: LONG, reduction_percent: DOUBLE>, "
        "legs ARRAY<STRUCT<leg_no: LONG, road_name: STRING, distance_m: DOUBLE, n_points: LONG, confidence: STRING>>, alerts ARRAY<STRUCT<message: STRING>>"
    )
    j = out.select("file_id", F.from_json("json", kind).alias("j"))
    leg = lambda x: F.concat_ws(":", x["leg_no"], x["road_name"], x["n_points"], x["confidence"])
    return j.select(
        F.col("j.file").cast("long").alias("file_id"), "j.status", "j.settings", "j.metadata.n_segments", "j.metadata.n_points", "j.metadata.duration_s", "j.metadata.distance_m", "j.metadata.has_time",
        F.array_join("j.metadata.anomalies", "; ").alias("anomalies"), "j.statistics.n_original", "j.statistics.n_cleaned", "j.statistics.n_simplified", "j.statistics.reduction_percent",
        F.coalesce(F.array_join(F.transform("j.legs", leg), "|"), F.lit("")).alias("legs"),
        F.round(F.coalesce(F.aggregate("j.legs", F.lit(0.0), lambda n, x: n + x["distance_m"]), F.lit(0.0)), 1).alias("legs_m"),
        F.coalesce(F.array_join(F.transform("j.alerts", lambda x: x["message"]), "|"), F.lit("")).alias("alerts"),
    )


@query
def map_centres(spark, d):
    a = _analysis(spark, d)
    return reports.centres(a.original, a.cleaned, a.simplified).select("file_id", _r("lat", 7), _r("lon", 7))


def _gpx_files(spark, d) -> DataFrame:
    """Every track as the bytes of a GPX file; every seventh file is damaged."""
    t = fixtures.tracks(spark, d)
    time = F.coalesce(F.concat(F.lit("<time>"), F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z</time>")), F.lit(""))
    hdop = F.when(F.col("pt") % 2 == 0, F.format_string("<hdop>%.1f</hdop>", "hdop")).otherwise(F.format_string("<extensions><x:hdop>%.1f</x:hdop></extensions>", "hdop"))
    point = F.concat(F.format_string('<trkpt lat="%.5f" lon="%.5f">', "lat", "lon"), time, hdop, F.lit("</trkpt>"))
    seg = t.groupBy("file_id", "seg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pt", point.alias("x")))), lambda p: p["x"]), "").alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "x"))), lambda s: F.concat(F.lit("<trkseg>"), s["x"], F.lit("</trkseg>"))), "")
    own = seg.groupBy("file_id").agg(F.concat(F.lit('<gpx xmlns="http://www.topografix.com/GPX/1/1" xmlns:x="x"><trk>'), body, F.lit("</trk></gpx>")).alias("xml"))
    own = own.withColumn("xml", F.when(F.col("file_id") % 7 == 3, F.substring("xml", 1, 200)).otherwise(F.col("xml")))
    content = F.encode("xml", "UTF-8")
    return own.select(F.concat(F.lit("/in/"), F.col("file_id").cast("string"), F.lit(".gpx")).alias("path"), F.length(content).cast("long").alias("length"), content.alias("content"))


@query
def gpx_files(spark, d):
    out = gpx.parse(_gpx_files(spark, d))
    return out.select("name", "bytes", "file_hash", F.col("error").isNotNull().alias("broken"))


@query
def gpx_points(spark, d):
    out = gpx.points(gpx.parse(_gpx_files(spark, d)).where("error is null"))
    name = F.regexp_extract("file_id", r"(\d+)\.gpx$", 1).cast("long")
    return out.select(name.alias("file_id"), "trk", "seg", "pt", "lat", "lon", "t", "hdop")


@query
def graphml_edges(spark, d):
    """The streets as GraphML text of two overlapping tiles, read back and united: the later tile wins."""
    e, n = fixtures.edges(spark, d), fixtures.nodes(spark, d)
    keys = "".join(f'<key id="{c}" for="edge" attr.name="{c}"/>' for c in ("name", "highway", "length", "osmid")) + '<key id="x" for="node" attr.name="x"/><key id="y" for="node" attr.name="y"/>'
    node = F.format_string('<node id="%d"><data key="x">%.5f</data><data key="y">%.5f</data></node>', "node_id", "lon", "lat")
    nodes = n.agg(F.array_join(F.array_sort(F.collect_list(node)), "").alias("nodes"))
    e = e.select("*", F.explode(F.array(F.lit("t1"), F.lit("t2"))).alias("tile")).where("tile = 't1' or u % 3 = 0")
    name = F.when(F.col("name").isNull(), "").when(F.col("u") % 2 == 0, F.concat(F.lit("<data key=\"name\">['"), "name", F.lit("', 'other']</data>"))).otherwise(F.concat(F.lit('<data key="name">'), "name", F.lit("</data>")))
    edge = F.concat(F.format_string('<edge id="0" source="%d" target="%d">', "u", "v"), name, F.lit('<data key="highway">'), F.concat(F.col("highway"), F.lit("_"), F.col("tile")), F.lit("</data></edge>"))
    files = e.groupBy("tile").agg(F.array_join(F.array_sort(F.collect_list(edge)), "").alias("edges")).join(nodes)
    xml = F.concat(F.lit(f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph>'), "nodes", "edges", F.lit("</graph></graphml>"))
    trees = roads.graphml_trees(files.select(F.concat(F.lit("/in/"), "tile", F.lit(".graphml")).alias("path"), F.encode(xml, "UTF-8").alias("content")))
    out = roads.distinct_edges(roads.graphml_edges(trees))
    at = lambda i, c: F.element_at("geometry", i)[c].alias(f"{c}_{'ab'[i - 1]}")
    return out.select("u", "v", "tile_id", F.array_join("name", "/").alias("name"), F.array_join("highway", "/").alias("highway"), at(1, "lon"), at(1, "lat"), at(2, "lon"), at(2, "lat"))


@query
def map_layers(spark, d):
    a = _analysis(spark, d)
    out = reports.layers(a.original, a.cleaned, a.simplified, a.matched, a.legs)
    return out.select("file_id", "layer", "ord", "kind", "name", "confidence", F.size("coordinates").cast("long").alias("n"), F.element_at(F.split("info", r" \| "), -1).alias("last_info"))
