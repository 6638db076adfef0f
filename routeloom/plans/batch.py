"""A batch of GPX files: analyse, write the reports, record the runs.

``out``, the road folder and the catalogue have to be reachable from every executor under the same path: map pages, layer
databases and JSON are written by the executors, each file as a whole and under a name that is fixed before, so a
task that runs twice writes the same file.  Only the workbook and one small row a file and output pass through the driver.
"""

from __future__ import annotations

import datetime as dt
import json
import logging
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.config import Settings, as_dict, identity
from routeloom.functions import text
from routeloom.operators import catalog as history
from routeloom.operators import legs as leg_ops
from routeloom.operators import reports, tiles
from routeloom.plans.analysis import Analysis
from routeloom.sources import gpx, roads, sinks

log = logging.getLogger("routeloom")


@dataclass
class Reporter:
    """Callbacks of a running batch; ``cancelled`` is asked between steps and, twice a second, while jobs run."""

    log: Callable[[str], None] = log.info
    progress: Callable[[int, int], None] = lambda done, total: None
    cancelled: Callable[[], bool] = lambda: False


class Cancelled(Exception):
    """The batch was cancelled while a job ran."""


@dataclass
class BatchResult:
    files: list[dict] = field(default_factory=list)
    outputs: list[str] = field(default_factory=list)
    #: Outputs that could not be written, and what went wrong with tiles: stage, kind, message, action and file_id.
    alerts: list[dict] = field(default_factory=list)
    tiles: dict[str, int] = field(default_factory=dict)

    @property
    def exit_code(self) -> int:
        return int(any(f["status"] == reports.ERROR for f in self.files))


@contextmanager
def cancellable(spark: SparkSession, say: Reporter) -> Iterator[None]:
    """Jobs started inside belong to one group, which is cancelled as soon as the reporter says so."""
    group, over, hit = f"routeloom-{uuid.uuid4().hex[:8]}", threading.Event(), threading.Event()

    def watch() -> None:
        while not over.wait(0.5):
            if say.cancelled():
                hit.set()
                spark.sparkContext.cancelJobGroup(group)

    spark.sparkContext.setJobGroup(group, "analysis of a batch", interruptOnCancel=True)
    guard = threading.Thread(target=watch, daemon=True)
    guard.start()
    try:
        yield
    except Exception as e:
        if hit.is_set():
            raise Cancelled from e
        raise
    finally:
        over.set()
        guard.join()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def prepare_tiles(
    spark: SparkSession, needed: DataFrame, folder: str, store: history.Catalog, settings: Settings, staged: str | None
) -> tuple[DataFrame, dict[str, int], list[dict]]:
    """The cache decision for the tiles of a batch: which may be used, how many had which outcome, and alerts.

    Tiles to download are taken from ``staged`` street graphs; the outcome goes to the catalogue, errors to its log.  Roads are
    used by the state of their tile alone, so an expired tile still serves offline.
    """
    now = F.current_timestamp().cast("timestamp_ntz")
    decided = tiles.decide(needed, store.tile_rows(), now, settings, roads.stored_tiles(spark, folder)).persist()
    outcome = {r["outcome"]: r["n"] for r in decided.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
    alerts = []
    if outcome.get("download") and staged is not None:
        results = roads.ingest(spark, staged, decided.where("outcome = 'download'"), folder, int(time.time() * 1000))
        store.upsert_tiles(tiles.apply_downloads(spark.createDataFrame([], history.TILES), results))
        broken = results.where("error is not null")
        store.log_errors(broken.select("tile_id", F.col("downloaded").alias("at"), F.col("error").alias("message")))
        alerts += [_alert("tiles", "ERROR", f"tile {r['tile_id']}: {r['error']}", "stage the tile's street graph") for r in broken.orderBy("tile_id").collect()]
    elif outcome.get("download"):
        alerts.append(_alert("tiles", "ALERT", f"{outcome['download']} tile(s) to download, and no staged street graphs given", "stage street graphs"))
    if outcome.get("missing"):
        alerts.append(_alert("tiles", "ALERT", f"{outcome['missing']} tile(s) missing or expired offline", "run online"))
    usable = needed.join(tiles.latest(store.tile_rows()).where("state = 'ok'").select("tile_id"), "tile_id", "left_semi")
    return _few(usable), outcome, alerts


def _few(tile_ids: DataFrame) -> DataFrame:
    """The tile ids of a batch, one short row each, as a frame of their own: later plans do not carry how they were found."""
    return tile_ids.sparkSession.createDataFrame(sorted(tuple(r) for r in tile_ids.select("tile_id").distinct().collect()), "tile_id string")


def _alert(stage: str, kind: str, message: str, action: str, file_id: str | None = None) -> dict:
    return {"file_id": file_id, "stage": stage, "kind": kind, "message": message, "action": action}


def _planned(files: list[dict], out: Path) -> dict[str, dict[str, str]]:
    """Paths of every file's outputs: no two files share one, and none exists yet."""
    taken, plan = {p.name for p in out.iterdir()}, {}
    for f in files:
        base = text.plain_file_name(Path(f["name"]).stem)
        plan[f["file_id"]] = {}
        for kind, pattern in (("map", "map_{}.html"), ("geopackage", "route_{}.gpkg"), ("json", "{}.json")):
            n, name = 0, pattern.format(base)
            while name in taken:
                n, name = n + 1, pattern.format(f"{base}_{n + 1}")
            taken.add(name)
            plan[f["file_id"]][kind] = str(out / name)
    return plan


def _write(kinds: dict[str, Callable[[dict], None]]):
    """Writes outputs on the executors; a failure becomes a row and stops nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for batch in batches:
            for row in batch.to_pylist():
                for kind, write in kinds.items():
                    try:
                        write(row)
                        done.append((row["file_id"], kind, row[f"path_{kind}"], None))
                    except Exception as e:  # noqa: BLE001 - one output must not stop the others
                        done.append((row["file_id"], kind, row[f"path_{kind}"], f"{type(e).__name__}: {e}"[:500]))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in range(4)], ["file_id", "kind", "path", "error"])

    return run


def _map(row: dict) -> None:
    at = row["centre"]
    sinks.map_page(row["path_map"], row["name"], row["layers"], (at["lon"], at["lat"]) if at else None)


def _geopackage(row: dict) -> None:
    sinks.geopackage(row["path_geopackage"], row["layers"])


def _json(row: dict) -> None:
    sinks.replace_file(row["path_json"], json.dumps(json.loads(row["json"]), indent=2, ensure_ascii=False).encode())


def run(
    spark: SparkSession, paths: list[str], edges: DataFrame | str, out: str | Path, settings: Settings = Settings(), catalog: str | None = None,
    reporter: Reporter | None = None, staged: str | None = None,
) -> BatchResult:
    """Analyse files and write workbook, map pages, JSON and (if asked) layer databases to ``out``.

    ``edges`` is a frame or a folder of edges by tile; of a folder only the tiles the batch needs are read and, with a ``catalog``, only those
    whose state allows it (see :func:`prepare_tiles`).  A file that cannot be read, an output that cannot be written and a
    road folder that is not there never stop the rest: they become alerts.
    """
    say = reporter or Reporter()
    result = BatchResult()
    if say.cancelled() or not paths:
        return result
    try:
        with cancellable(spark, say):
            _run(spark, paths, edges, Path(out), settings, catalog, say, staged, result)
    except Cancelled:
        say.log("cancelled")
    return result


def _run(
    spark: SparkSession, paths: list[str], edges: DataFrame | str, out: Path, settings: Settings, catalog: str | None, say: Reporter, staged: str | None, result: BatchResult
) -> None:
    out.mkdir(parents=True, exist_ok=True)
    files = gpx.scan(spark, paths).persist()
    a = Analysis(gpx.points(files.where("error is null")), None, settings)
    store = history.Catalog(spark, catalog) if catalog else None
    if isinstance(edges, str):
        try:
            needed = _few(tiles.tiles_of_tracks(a.simplified, settings))
            if store is not None:
                needed, result.tiles, found = prepare_tiles(spark, needed, edges, store, settings, staged)
                result.alerts += found
            edges = roads.kept_edges(spark, edges, needed)
        except Exception as e:  # noqa: BLE001 - without roads there still are reports
            if say.cancelled():
                raise
            result.alerts.append(_alert("tiles", "ERROR", f"no roads: {type(e).__name__}: {e}"[:500], "check the road folder"))
            edges = spark.createDataFrame([], roads.EDGES)
    a.edges = edges
    names = files.select(F.col("path").alias("file_id"), "name", "file_hash", "error")
    repeats = None
    if store is not None:
        own = names.withColumn("config_hash", F.lit(identity(settings)))
        repeats = history.previous_runs(own.select("file_id", "file_hash", "config_hash"), store.files())
    found = reports.alerts(a.files, a.cleaned, a.status, repeats)
    broken = names.where("error is not null").select("file_id", F.lit("read").alias("stage"), F.lit("ERROR").alias("kind"), F.col("error").alias("message"), F.lit("the file may be damaged").alias("action"))
    found = found.unionByName(broken).persist()
    status = names.join(a.status, "file_id", "left").withColumn("status", F.when(F.col("error").isNotNull(), reports.ERROR).otherwise(F.coalesce("status", F.lit(reports.ERROR))))
    say.log(f"{len(paths)} file(s)")
    routes = leg_ops.route_text(a.legs)
    listed = status.join(routes, "file_id", "left").select("file_id", "name", "file_hash", "status", F.coalesce("route", F.lit("")).alias("route"))
    result.files += [r.asDict() for r in listed.orderBy("file_id").toLocalIterator()]
    if say.cancelled():
        return
    plan = _planned(result.files, out)
    kinds = "file_id string, name string, path_map string, path_geopackage string, path_json string"
    planned = spark.createDataFrame([(f["file_id"], f["name"], *plan[f["file_id"]].values()) for f in result.files], kinds)
    wanted = {"map": _map} if settings.outputs.map_html else {}
    wanted |= {"geopackage": _geopackage} if settings.outputs.geopackage else {}
    drawn: dict[str, str] = {}

    def write(rows: DataFrame, kinds: dict) -> None:
        for r in rows.mapInArrow(_write(kinds), "file_id string, kind string, path string, error string").orderBy("path").collect():
            if r["error"]:
                result.alerts.append(_alert("output", "ERROR", f"{r['kind']}: {r['error']}", "check the output folder", r["file_id"]))
            else:
                result.outputs.append(r["path"])
                if r["kind"] == "map":
                    drawn[r["file_id"]] = r["path"]
        say.progress(len({*drawn}), len(result.files))

    if wanted:
        layer = reports.layers(a.original, a.cleaned, a.simplified, a.matched, a.legs)
        of_file = layer.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("layer", "ord", "file_id", "kind", "name", "confidence", "info", "coordinates"))).alias("layers"))
        centre = reports.centres(a.original, a.cleaned, a.simplified).select("file_id", F.struct("lat", "lon").alias("centre"))
        write(of_file.join(centre, "file_id", "left").join(planned, "file_id"), wanted)
    if say.cancelled():
        return
    if settings.outputs.technical_json:
        body = reports.technical_json(a.files, a.counts, a.legs, found, a.status, json.dumps(as_dict(settings)))
        write(body.join(planned, "file_id"), {"json": _json})
    if settings.outputs.excel:
        try:
            result.outputs.append(str(_workbook(spark, a, names, found, drawn, out, settings, result)))
        except Exception as e:  # noqa: BLE001 - a failing workbook leaves the other outputs
            if say.cancelled():
                raise
            result.alerts.append(_alert("output", "ERROR", f"workbook: {type(e).__name__}: {e}"[:500], "check the output folder"))
    if store is not None:
        _register(a, status, settings, store)
    a.release()
    found.unpersist()
    files.unpersist()


def _workbook(spark: SparkSession, a: Analysis, names: DataFrame, found: DataFrame, drawn: dict[str, str], out: Path, settings: Settings, result: BatchResult) -> Path:
    maps = spark.createDataFrame(list(drawn.items()), "file_id string, map string")
    total = a.files.join(names.select("file_id", "name"), "file_id").join(maps, "file_id", "left")
    sheets = {
        "summary": reports.summary(total, a.counts, a.legs, a.status).orderBy("file_id"),
        "roads travelled": reports.leg_rows(a.legs, names).orderBy("file_id", "leg_no"),
    }
    if settings.point_diagnostics:
        sheets["point diagnostics"] = reports.point_rows(a.matched, a.legs).orderBy("file_id", "idx")
    later = spark.createDataFrame([tuple(x[c] for c in ("file_id", "stage", "kind", "message", "action")) for x in result.alerts], "file_id string, stage string, kind string, message string, action string")
    sheets["errors and alerts"] = reports.alert_rows(found.unionByName(later))
    stamp = dt.datetime.now().strftime("%d%m%Y_%H%M%S")
    return sinks.workbook(out / f"routes_{stamp}.xlsx", sheets)


def _register(a: Analysis, status: DataFrame, settings: Settings, store: history.Catalog) -> None:
    """Add the runs to the history.  Ids are the time in microseconds and a 64-bit hash's leading digits of the run and file, so a
    later batch has larger ids and batches at one time do not meet."""
    now, batch = time.time_ns() // 1000, uuid.uuid4().hex
    counts = leg_ops.confidence_summary(a.legs)
    rows = status.join(a.files.select("file_id", "n_points", "distance_m"), "file_id", "left").join(counts, "file_id", "left")
    store.register_files(rows.select(
        (F.lit(now) * 4096 + F.pmod(F.xxhash64(F.lit(batch), F.col("file_id")), F.lit(4096))).alias("id"), F.col("file_id").alias("path"), "name", "file_hash", F.lit(identity(settings)).alias("config_hash"),
        F.current_timestamp().cast("timestamp_ntz").alias("processed"), F.lit(json.dumps(as_dict(settings))).alias("config"), "status",
        F.coalesce("n_points", F.lit(0)).alias("n_points"), F.coalesce("n_legs", F.lit(0)).alias("n_legs"), F.coalesce("distance_m", F.lit(0.0)).alias("distance_m"),
        F.to_json(F.struct("n_high", "n_medium", "n_low", "n_unidentified")).alias("summary"), F.lit(settings.program_version).alias("program_version"),
    ))
