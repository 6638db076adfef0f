"""Command line: analyse GPX files against a road network, or only inspect them.

Exit code 0: all well; 1: some file failed; 2: no file found.
"""

from __future__ import annotations

import argparse
import dataclasses
import sys

from routeloom import config
from routeloom.plans import batch
from routeloom.session import session
from routeloom.sources import gpx, roads, sinks


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="routeloom", description="Finds the roads that GPS tracks followed.")
    p.add_argument("inputs", nargs="+", help="GPX files or folders")
    p.add_argument("--recursive", action="store_true", help="look into subfolders")
    p.add_argument("--out", default="output", help="folder for reports")
    p.add_argument("--config", help="JSON file with settings")
    p.add_argument("--roads", help="folder of road edges by tile (Parquet), or of GraphML files")
    p.add_argument("--catalog", help="folder of the tile and file history")
    p.add_argument("--staged", help="folder of GraphML files by tile, from which tiles that the catalogue lacks are taken")
    p.add_argument("--log", help="log file (2 MB, five older ones kept)")
    p.add_argument("--offline", action="store_true", help="use stored tiles only")
    p.add_argument("--refresh-cache", action="store_true", help="ignore stored tiles")
    p.add_argument("--geopackage", action="store_true", help="also write layer databases")
    p.add_argument("--diagnostics", action="store_true", help="add a sheet with every point")
    p.add_argument("--no-excel", action="store_true")
    p.add_argument("--no-map", action="store_true")
    p.add_argument("--inspect", action="store_true", help="print figures of the files and stop")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.log:
        sinks.log_to(args.log)
    files = sorted({f for i in args.inputs for f in gpx.find(i, args.recursive)})
    if not files:
        print("no GPX file found")
        return 2
    spark = session()
    if args.inspect:
        for r in gpx.inspect(spark, files).orderBy("file_id").toLocalIterator():
            if r["error"]:
                print(f"{r['name']}: {r['error']}")
            else:
                print(f"{r['name']}: {r['n_tracks']} track(s), {r['n_segments']} segment(s), {r['n_points']} point(s), {r['distance_m']:.1f} m, {'; '.join(r['anomalies']) or 'no anomaly'}")
        return 0
    s = config.load(args.config)
    outputs = dataclasses.replace(
        s.outputs, geopackage=s.outputs.geopackage or args.geopackage, excel=s.outputs.excel and not args.no_excel, map_html=s.outputs.map_html and not args.no_map
    )
    s = dataclasses.replace(
        s, outputs=outputs, offline=s.offline or args.offline, refresh_cache=s.refresh_cache or args.refresh_cache, point_diagnostics=s.point_diagnostics or args.diagnostics
    )
    if not args.roads:
        print("--roads is needed to match tracks")
        return 1
    from pathlib import Path

    edges = roads.distinct_edges(roads.read_graphml(spark, args.roads)) if any(Path(args.roads).glob("*.graphml")) else args.roads
    result = batch.run(spark, files, edges, args.out, s, args.catalog, staged=args.staged)
    count = lambda x: sum(f["status"] == x for f in result.files)
    print(f"files: {len(result.files)} | ok: {count('ok')} | partial: {count('partial')} | error: {count('error')}")
    for x in result.alerts:
        print(f"  {x['kind']} ({x['stage']}) {x['message']}")
    for f in result.files:
        print(f"  [{f['status']}] {f['name']}: {f['route'] or '(none)'}")
    return result.exit_code


if __name__ == "__main__":
    sys.exit(main())
