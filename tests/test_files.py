"""GPX and road files in, reports and history out."""

from __future__ import annotations

import json
import logging
import sqlite3
import threading
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeloom import cli, config
from routeloom.operators import tiles
from routeloom.operators.catalog import Catalog, cache_size
from routeloom.plans import batch
from routeloom.sources import gpx, roads, sinks
from tests.conftest import HOME, degrees, path, town

CORNERS = {"p": (0, 0), "q": (260, 0), "r": (260, 230), "s": (520, 0)}
STREETS = [{"via": "p q s", "name": "Quay"}, {"via": "q r", "name": "Hill Road", "highway": "primary"}]


def trail(*parts, extra="", start=1_750_000_000) -> str:
    """A GPX text: tracks of segments of rows (x, y in metres); ``extra`` goes into every point."""
    at, out = 0, []
    for track in parts:
        out.append("<trk>")
        for segment in track:
            out.append("<trkseg>")
            for lon, lat in degrees(segment):
                stamp = np.datetime64(start + at, "s")
                out.append(f'<trkpt lat="{lat:.8f}" lon="{lon:.8f}"><time>{stamp}Z</time>{extra}</trkpt>')
                at += 1
            out.append("</trkseg>")
        out.append("</trk>")
    return '<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/0">' + "".join(out) + "</gpx>"


@pytest.fixture
def folder(tmp_path):
    """Files of many kinds: two tracks with three segments, no times, no points, no XML, an old byte, and one deeper down."""
    inner = tmp_path / "in/more"
    inner.mkdir(parents=True)
    two = trail([path((0, 0), (40, 0), every=8.0), [(48, 0), (48, 0), (48, 8)]], [[(48, 16), (48, 24)]], extra="<hdop>3.4</hdop><ele>431.5</ele>")
    (tmp_path / "in/two.gpx").write_text(two)
    (tmp_path / "in/no times.GPX").write_text('<gpx><trk><trkseg><trkpt lat="46.8" lon="7.1"/><trkpt lat="99" lon="7.1"/><trkpt lat="46.8002" lon="7.1"/></trkseg></trk></gpx>')
    (tmp_path / "in/hollow.gpx").write_text("<gpx><trk><trkseg/></trk></gpx>")
    (tmp_path / "in/torn.gpx").write_text(two[: len(two) // 2])
    (inner / "latin.gpx").write_bytes(trail([[(0, 0), (9, 0), (18, 0)]], extra="<name>été</name>").encode("latin-1"))
    return tmp_path / "in"


def test_find_and_inspect(spark, folder):
    names = lambda found: [f.rsplit("/", 1)[-1] for f in found]
    assert names(gpx.find(str(folder))) == ["hollow.gpx", "latin.gpx", "no times.GPX", "torn.gpx", "two.gpx"]
    assert "latin.gpx" not in names(gpx.find(str(folder), recursive=False)) and gpx.find(str(folder / "two.gpx")) and gpx.find(str(folder / "gone")) == []
    got = {r["name"]: r for r in gpx.inspect(spark, str(folder)).collect()}
    two = got["two.gpx"]
    assert (two["n_tracks"], two["n_segments"], two["n_points"], two["n_repeats"], two["fields"]) == (2, 3, 11, 1, ["ele", "hdop", "time"])
    assert two["duration_s"] == 10 and two["distance_m"] == pytest.approx(72, abs=0.05)
    plain = got["no times.GPX"]
    assert (plain["n_points"], plain["n_invalid"], plain["duration_s"], plain["has_time"]) == (2, 1, None, False) and plain["anomalies"] == ["1 invalid coordinate(s) ignored"]
    assert got["hollow.gpx"]["anomalies"] == ["no valid point"] and got["hollow.gpx"]["n_segments"] == 1
    assert got["torn.gpx"]["error"] and got["latin.gpx"]["n_points"] == 3 and got["latin.gpx"]["error"] is None


def test_precision_and_fix_from_extensions(spark, tmp_path):
    (tmp_path / "x.gpx").write_text(
        trail([[(0, 0)]], extra="<fix>3d</fix><hdop>1.5</hdop>").replace("</trkseg>", "")
        .replace("</trk></gpx>", '<trkpt lat="1" lon="2"><extensions><g:data><g:hdop>7.25</g:hdop><g:fix>2d</g:fix></g:data></extensions></trkpt><trkpt lat="1" lon="2"><hdop>bad</hdop></trkpt></trkseg></trk></gpx>')
        .replace("<gpx ", '<gpx xmlns:g="urn:g" ')
    )
    rows = gpx.read(spark, str(tmp_path / "x.gpx")).orderBy("pt").collect()
    assert [(r["hdop"], r["fix"]) for r in rows] == [(1.5, "3d"), (7.25, "2d"), (None, None)]


@pytest.fixture
def drives(folder):
    """Adds two drives through the town to the folder."""
    (folder / "GH014242.gpx").write_text(trail([path((20, 0), (260, 0), (260, 200), every=5.0)]))
    (folder / "more/GH014242.gpx").write_text(trail([path((300, 1), (500, 1), every=5.0)]))
    return gpx.find(str(folder))


def test_batch_reports_and_history(spark, drives, tmp_path):
    out, cat = tmp_path / "out", str(tmp_path / "cat")
    s = config.put(config.put(config.Settings(), "outputs.geopackage", True), "point_diagnostics", True)
    edges = town(spark, CORNERS, STREETS)
    result = batch.run(spark, drives, edges, out, s, cat)
    state = {f["file_id"].rsplit("/in/", 1)[-1].replace("%20", " "): f for f in result.files}
    assert {k: f["status"] for k, f in state.items()} == {
        "GH014242.gpx": "ok", "more/GH014242.gpx": "ok", "two.gpx": "ok", "more/latin.gpx": "ok", "no times.GPX": "partial", "hollow.gpx": "error", "torn.gpx": "error",
    }
    assert state["GH014242.gpx"]["route"] == "Quay > Hill Road" and result.exit_code == 1
    made = {p.rsplit("/", 1)[-1] for p in result.outputs}
    assert {"map_GH014242.html", "map_GH014242_1.html", "GH014242.json", "GH014242_1.json", "route_two.gpkg"} <= made and not any(p.name.startswith(".") for p in out.iterdir())
    with zipfile.ZipFile(next(p for p in result.outputs if p.endswith(".xlsx"))) as z:
        sheet = [z.read(f"xl/worksheets/sheet{k}.xml").decode() for k in (1, 2, 3, 4)]
        assert "Hill Road" in sheet[1] and "GH014242" in sheet[1] and "map_GH014242.html" in sheet[0] and 'state="frozen"' in sheet[0] and "<cols>" in sheet[2]
        assert 'numFmtId="164"' in z.read("xl/styles.xml").decode() and 's="5"' in sheet[0] and 's="2"' in sheet[1]
    page = next(open(p).read() for p in result.outputs if p.endswith("map_GH014242.html"))
    assert "Hill Road | primary" in page and "tile.openstreetmap.org" in page and "centre=[7.12" in page
    con = sqlite3.connect(next(p for p in result.outputs if p.endswith("route_GH014242.gpkg")))
    assert {"original", "cleaned", "simplified", "fitted", "legs"} == {t for (t,) in con.execute("select table_name from gpkg_contents")}
    body = json.load(open(next(p for p in result.outputs if p.endswith("/GH014242.json"))))
    assert [x["road_name"] for x in body["legs"]] == ["Quay", "Hill Road"] and json.loads(body["settings"])["spacing_m"] == 10
    again = batch.run(spark, drives[:1], edges, out, config.Settings(), cat)
    runs = Catalog(spark, cat).files().orderBy("id").collect()
    assert len(runs) == len(drives) + 1 and len({r["id"] for r in runs}) == len(runs) and runs[-1]["path"] == again.files[0]["file_id"]


def test_a_failing_output_stops_nothing(spark, drives, tmp_path, monkeypatch):
    out = tmp_path / "out"

    def broken(*a, **k):
        raise OSError("disk full")

    monkeypatch.setattr(sinks, "workbook", broken)
    (out / "map_two.html").mkdir(parents=True)  # a folder stands where a map page would go: another name is taken
    result = batch.run(spark, [f for f in drives if f.endswith("two.gpx")], town(spark, CORNERS, STREETS), out, config.put(config.Settings(), "outputs.technical_json", False))
    assert [x["message"] for x in result.alerts] == ["workbook: OSError: disk full"] and any(p.endswith("map_two_1.html") for p in result.outputs)
    lost = batch.run(spark, drives[:1], str(tmp_path / "no roads"), tmp_path / "other", config.Settings(outputs=config.Outputs(excel=False, map_html=False)))
    assert lost.alerts[0]["stage"] == "tiles" and lost.files[0]["status"] in ("partial", "error") and any(p.endswith(".json") for p in lost.outputs)


def test_cancelling(spark, drives, tmp_path):
    edges = town(spark, CORNERS, STREETS)
    assert batch.run(spark, drives, edges, tmp_path / "a", reporter=batch.Reporter(cancelled=lambda: True)).files == []
    stop = threading.Event()
    threading.Timer(1.5, stop.set).start()
    result = batch.run(spark, drives, edges, tmp_path / "b", reporter=batch.Reporter(cancelled=stop.is_set))
    assert not any(p.endswith(".xlsx") for p in result.outputs)
    assert spark.range(10).count() == 10


def graph(streets: str) -> str:
    lon, lat = degrees([[0, 0], [260, 0], [260, 230]]).T
    nodes = "".join(f'<node id="{i}"><data key="x">{a:.8f}</data><data key="y">{b:.8f}</data></node>' for i, (a, b) in enumerate(zip(lon, lat, strict=True)))
    keys = "".join(f'<key id="{k}" for="node" attr.name="{k}"/>' for k in "xy") + "".join(f'<key id="{k}" for="edge" attr.name="{k}"/>' for k in ("name", "length", "geometry"))
    return f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">{nodes}{streets}</graph></graphml>'


def test_tiles_of_a_batch(spark, drives, tmp_path):
    """Tiles come from staged graphs once, are reused, go missing offline, and errors are logged."""
    staged, folder, cat, out = tmp_path / "staged", str(tmp_path / "roads"), str(tmp_path / "cat"), tmp_path / "out"
    staged.mkdir()
    here = tiles.tile_of(*HOME, 5.0)
    both = '<edge id="0" source="0" target="1"><data key="name">Quay</data></edge><edge id="0" source="1" target="0"><data key="name">Quay</data></edge><edge id="0" source="1" target="2"><data key="name">[\'Hill Road\', \'B 7\']</data><data key="length">231.5</data></edge>'
    (staged / f"{here}.graphml").write_text(graph(both))
    one = [f for f in drives if f.endswith("in/GH014242.gpx")]
    quiet = config.Settings(outputs=config.Outputs(excel=False, map_html=False, technical_json=False))
    first = batch.run(spark, one, folder, out, quiet, cat, staged=str(staged))
    n = sum(first.tiles.values())
    assert first.tiles == {"download": n} and first.files[0]["route"] == "Quay > Hill Road"
    rows = {r["tile_id"]: r for r in Catalog(spark, cat).tiles().collect()}
    assert len(rows) == n and rows[here]["state"] == "ok" and rows[here]["roads"] == 3 and sum(r["state"] == "error" for r in rows.values()) == n - 1
    assert Catalog(spark, cat).errors().count() == n - 1 == sum("no staged file" in x["message"] for x in first.alerts)
    store, needed = Catalog(spark, cat), spark.createDataFrame([(t,) for t in rows], "tile_id string")
    usable, outcome, alerts = batch.prepare_tiles(spark, needed, folder, store, config.Settings(offline=True), None)
    assert outcome.get("reused") == 1 and outcome.get("missing", 0) == n - 1 and [r["tile_id"] for r in usable.collect()] == [here]
    assert [x["kind"] for x in alerts] == ["ALERT"] * (n > 1)
    (staged / f"{here}.graphml").write_text("<graphml torn")
    usable, outcome, alerts = batch.prepare_tiles(spark, needed, folder, store, config.Settings(refresh_cache=True), str(staged))
    assert outcome == {"download": n} and any("not a readable street graph" in x["message"] for x in alerts) and usable.count() == 0


def test_road_files(spark, tmp_path):
    (tmp_path / "t9.graphml").write_text(graph('<edge id="1" source="0" target="2"><data key="name">Arc</data><data key="geometry">LINESTRING (7.12 46.81, 7.121 46.811, 7.1234 46.8121)</data></edge><edge id="0" source="2" target="1"/>'))
    rows = {r["u"]: r for r in roads.read_graphml(spark, str(tmp_path)).collect()}
    assert rows[0]["name"] == ["Arc"] and len(rows[0]["geometry"]) == 3 and rows[0]["k"] == 1 and rows[2]["name"] is None and len(rows[2]["geometry"]) == 2
    edges = town(spark, CORNERS, STREETS[:1])
    late = edges.withColumn("highway", F.lit("primary")).withColumn("tile_id", F.lit("u2")).where("u < 20")
    roads.write_edges(edges.withColumn("tile_id", F.lit("u1")).unionByName(late), str(tmp_path / "e"))
    got = {(r["u"], r["v"]): r["highway"] for r in roads.read_edges(spark, str(tmp_path / "e")).collect()}
    assert len(got) == edges.count() and all((h == "primary") == (u < 20) for (u, _), h in got.items())
    roads.write_edges(late.withColumn("highway", F.lit("track")), str(tmp_path / "e"), "overwrite")
    assert {r["tile_id"]: r["n"] for r in spark.read.parquet(str(tmp_path / "e")).groupBy("tile_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {"u1": edges.count(), "u2": late.count()}
    wanted = spark.createDataFrame([("u1",)], "tile_id string")
    kept = roads.kept_edges(spark, str(tmp_path / "e"), wanted)
    assert roads.kept_edges(spark, str(tmp_path / "e"), wanted) is kept and kept.where("highway = 'track'").count() == 0
    roads.forget_edges()


def test_catalogue(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "cat"))
    kinds = "tile_id string, version long, state string, downloaded timestamp_ntz, roads long"
    for v, state in ((1, "ok"), (3, "error"), (2, "empty")):
        c.upsert_tiles(spark.createDataFrame([("z", v, state, None, 3), (f"y{v}", v, "ok", None, 1)], kinds))
    assert [(r["tile_id"], r["state"]) for r in c.tiles().collect()] == [("y1", "ok"), ("y2", "ok"), ("y3", "ok"), ("z", "error")]
    c.log_errors(spark.createDataFrame([("z", None, "long " * 900)], "tile_id string, at timestamp_ntz, message string"))
    assert len(c.errors().first()["message"]) == 1000 and cache_size(spark, str(tmp_path / "cat")) > 0 == cache_size(spark, str(tmp_path / "none"))
    assert c.clear_tiles() == 4 and c.tiles().count() == 0


def test_an_extent_over_two_zones_is_noted(spark):
    from routeloom.operators import kinematics, reports
    from tests.conftest import recorded

    raw = recorded(spark, {"wide": [[0, 0], [5, 0]], "near": [[0, 0], [5, 0]]})
    raw = raw.withColumn("lon", F.when((F.col("file_id") == "wide") & (F.col("pt") == 1), 5.9).otherwise(F.col("lon")))
    files = kinematics.inspect(raw)
    none = files.select("file_id", F.lit("ok").alias("status"))
    got = reports.alerts(files, kinematics.valid_points(raw), none).collect()
    assert [(r["file_id"], r["message"]) for r in got] == [("wide", "the extent spans several UTM zones")]


def test_settings(tmp_path):
    f = tmp_path / "s.json"
    f.write_text(json.dumps({"_about": "x", "tile_km": 0, "curve_deg": 181, "max_distance_m": 12, "cleaning": {"max_hdop": 9}, "matching": {"class_bonus": {"track": -1}}, "other": 3}))
    s, base = config.load(f), config.Settings()
    assert (s.tile_km, s.curve_deg, s.max_distance_m, s.cleaning.max_hdop, s.cleaning.idle_kmh) == (base.tile_km, base.curve_deg, s.candidate_radius_m, 9, base.cleaning.idle_kmh)
    assert s.matching.class_bonus["track"] == -1 and s.matching.class_bonus["trunk"] == base.matching.class_bonus["trunk"]
    f.write_text("{")
    assert config.load(f) == config.load(tmp_path / "gone") == base
    for key in ("tile_km", "matching.beta_m", "confidence.min_points", "matching.class_bonus.service"):
        assert config.get(config.put(base, key, 77), key) == 77
    assert config.get(base, "matching.nothing", "d") == "d"
    assert config.identity(config.put(base, "tile_km", 6.0)) != config.identity(base) == config.identity(config.put(base, "confidence.min_points", 9))
    config.save(s, tmp_path / "t.json")
    assert config.load(tmp_path / "t.json") == s


def test_command_line(spark, folder, tmp_path, capsys):
    assert cli.main([str(folder / "gone")]) == 2 and "no GPX" in capsys.readouterr().out
    assert cli.main([str(folder), "--inspect", "--log", str(tmp_path / "log.txt")]) == 0
    said = capsys.readouterr().out
    assert "two.gpx: 2 track(s), 3 segment(s), 11 point(s)" in said and "latin" not in said and "torn.gpx: not a readable" in said
    handler = logging.getLogger("routeloom").handlers[-1]
    assert handler.maxBytes == 2 << 20 and handler.backupCount == 5
    logging.getLogger("routeloom").removeHandler(handler)


def test_names_that_are_taken(tmp_path):
    for n in ("b.json", "b_1.json"):
        (tmp_path / n).touch()
    assert sinks.unique_path(tmp_path / "b.json").name == "b_2.json" and sinks.unique_path(tmp_path / "c.json").name == "c.json"
    sinks.replace_file(tmp_path / "b.json", b"{}")
    assert (tmp_path / "b.json").read_bytes() == b"{}" and len(list(tmp_path.iterdir())) == 2
