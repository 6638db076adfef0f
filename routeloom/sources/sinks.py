"""Files for people: workbook, map page, layer database and technical JSON.

Report tables are written by Spark as Parquet at any size; these writers stream their (report-sized) rows through the driver.
"""

from __future__ import annotations

import datetime as dt
import json
import logging
import logging.handlers
import sqlite3
import struct
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame


def unique_path(path: str | Path) -> Path:
    """The path, or with ``_1``, ``_2`` ... before the suffix if it is taken."""
    path = Path(path)
    n, out = 0, path
    while out.exists():
        n += 1
        out = path.with_name(f"{path.stem}_{n}{path.suffix}")
    return out


def _column(i: int) -> str:
    name = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        name = chr(65 + r) + name
    return name


#: Cell styles by number: number formats by decimals, and fills of confidence levels and statuses.
_DECIMALS = {1: 2, 2: 3, 3: 4}
_FILLED = {"high": 5, "ok": 5, "medium": 6, "partial": 6, "low": 7, "error": 7, "unidentified": 8, "ERROR": 7, "ALERT": 6}
_ONE_PLACE = {"distance_m", "dist_cum_m", "speed_kmh", "bearing"}
_TWO_PLACES = {"mean_m", "max_m", "road_m"}
_WIDE = {"notes", "message", "action", "road_name", "second_road", "map"}


def _style(column: str, value) -> int:
    if column in ("confidence", "status", "kind"):
        return _FILLED.get(value, 0)
    if isinstance(value, float):
        return _DECIMALS[1 if column in _ONE_PLACE else 2 if column in _TWO_PLACES else 3] if column in _ONE_PLACE | _TWO_PLACES | {"margin"} else 0
    return 0


def _cell(ref: str, value, style: int = 0) -> str:
    return _plain_cell(ref, value).replace("<c ", f'<c s="{style}" ', 1) if style else _plain_cell(ref, value)


def _plain_cell(ref: str, value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        if isinstance(value, dt.datetime):
            value = value.isoformat(sep=" ")
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'
    return f'<c r="{ref}"><v>{value!r}</v></c>'


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"


def _styles() -> str:
    colors = ("FFD9E2EC", "FFD5F0DC", "FFFCE8C8", "FFF8D3CF", "FFE3E6E8")  # header, good, fair, bad, unknown
    solid = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="{c}"/></patternFill></fill>' for c in colors)
    formats = "".join(f'<numFmt numFmtId="{163 + d}" formatCode="0.{"0" * d}"/>' for d in (1, 2, 3))
    cells = '<xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/>' + "".join(f'<xf numFmtId="{163 + d}" applyNumberFormat="1"/>' for d in (1, 2, 3))
    cells += "".join(f'<xf fillId="{k}" applyFill="1"/>' for k in (3, 4, 5, 6))
    return (
        f'<numFmts count="3">{formats}</numFmts><fonts count="2"><font/><font><b/></font></fonts><fills count="7"><fill><patternFill patternType="none"/></fill>'
        f'<fill><patternFill patternType="gray125"/></fill>{solid}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="9">{cells}</cellXfs>'
    )


_STYLES = _styles()


def write_workbook(path: str | Path, sheets: dict[str, tuple[list[str], Iterable]]) -> Path:
    """An XLSX file: for each sheet a bold frozen header row with filter, then the rows."""
    path = unique_path(path)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACK}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{names}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACK}/relationships">{rels}<Relationship Id="rId{len(sheets) + 1}" Type="{_REL}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'{_HEAD}<styleSheet xmlns="{_MAIN}">{_STYLES}</styleSheet>')
        for i, (header, rows) in enumerate(sheets.values(), 1):
            widths = "".join(f'<col min="{c}" max="{c}" width="{42 if h in _WIDE else max(11, len(h) + 4)}" customWidth="1"/>' for c, h in enumerate(header, 1))
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>{widths}</cols><sheetData>'.encode())
                cells = "".join(_cell(f"{_column(c)}1", h, 1) for c, h in enumerate(header))
                f.write(f'<row r="1">{cells}</row>'.encode())
                n = 1
                for n, row in enumerate(rows, 2):
                    cells = "".join(_cell(f"{_column(c)}{n}", v, _style(header[c], v)) for c, v in enumerate(row))
                    f.write(f'<row r="{n}">{cells}</row>'.encode())
                f.write(f'</sheetData><autoFilter ref="A1:{_column(len(header) - 1)}{n}"/></worksheet>'.encode())
    return path


def workbook(path: str | Path, tables: dict[str, DataFrame]) -> Path:
    """Report tables as sheets, row by row."""
    return write_workbook(path, {name: (df.columns, df.toLocalIterator()) for name, df in tables.items()})


COLORS = {"high": "#1e8449", "medium": "#d68910", "low": "#c0392b", "unidentified": "#7f8c8d", "": "#2471a3"}
_PAGE = """<!doctype html><html><head><meta charset="utf-8"><title>%(title)s</title>
<style>body{margin:0;font:14px sans-serif}#k{position:fixed;top:8px;right:8px;background:#fff;padding:8px;border:1px solid #999}#i{max-width:260px;margin-top:6px}svg{width:100vw;height:100vh;background:#f4f6f6}</style></head>
<body><div id="k"><b>%(title)s</b><br><div id="i"></div></div><svg id="m"></svg><script>
const layers=%(layers)s,colors=%(colors)s,centre=%(centre)s,base=%(base)s,ns='http://www.w3.org/2000/svg';
const svg=document.getElementById('m'),key=document.getElementById('k'),info=document.getElementById('i'),make=n=>document.createElementNS(ns,n);
const flat=p=>[(p[0]+180)/360,(1-Math.asinh(Math.tan(p[1]*Math.PI/180))/Math.PI)/2];
const c=flat(centre),far=Math.max(1e-6,...layers.flatMap(l=>l.coordinates).map(flat).flatMap(p=>[Math.abs(p[0]-c[0]),Math.abs(p[1]-c[1])]));
const s=500/far,at=p=>{const q=flat(p);return [(q[0]-c[0])*s,(q[1]-c[1])*s];};svg.setAttribute('viewBox','-520 -520 1040 1040');
const groups={},group=(name,shown)=>{if(!groups[name]){const g=groups[name]=make('g');svg.append(g);const b=document.createElement('label'),i=document.createElement('input');i.type='checkbox';i.checked=shown;
g.style.display=shown?'':'none';i.onchange=()=>g.style.display=i.checked?'':'none';b.append(i,' '+name);key.insertBefore(b,info);key.insertBefore(document.createElement('br'),info);}return groups[name];};
if(base){const z=Math.max(0,Math.min(18,Math.floor(Math.log2(2/far)))),n=2**z,g=group('base map',true);
for(let x=Math.floor((c[0]-far)*n);x<=(c[0]+far)*n;x++)for(let y=Math.floor((c[1]-far)*n);y<=(c[1]+far)*n;y++){const t=make('image');
t.setAttribute('href',base.replace('{z}',z).replace('{x}',x).replace('{y}',y));t.setAttribute('x',(x/n-c[0])*s);t.setAttribute('y',(y/n-c[1])*s);t.setAttribute('width',s/n);t.setAttribute('height',s/n);t.setAttribute('opacity',0.6);g.append(t);}}
const dot=(g,p,color,say)=>{const e=make('circle'),q=at(p);e.setAttribute('cx',q[0]);e.setAttribute('cy',q[1]);e.setAttribute('r',5);e.setAttribute('fill',color);tell(e,say);g.append(e);};
const tell=(e,say)=>{const t=make('title');t.textContent=say;e.append(t);e.onclick=()=>info.textContent=say;};
for(const l of layers){const g=group(l.layer,!['original','cleaned','simplified','problems'].includes(l.layer)),say=l.info||[l.name,l.confidence].join(' ');
if(l.kind==='point'){dot(g,l.coordinates[0],'#c0392b',say);continue;}
const e=make('polyline');e.setAttribute('points',l.coordinates.map(at).map(p=>p.join(',')).join(' '));e.setAttribute('fill','none');
e.setAttribute('stroke',colors[l.confidence]||'#2471a3');e.setAttribute('stroke-width',l.layer==='legs'?4:2);tell(e,say);g.append(e);}
const way=layers.find(l=>l.layer==='simplified')||layers.find(l=>l.kind==='line');
if(way){const g=group('start and end',true);dot(g,way.coordinates[0],'#1e8449','start');dot(g,way.coordinates[way.coordinates.length-1],'#1c2833','end');}
</script></body></html>"""
#: Raster tiles behind the map; they show when the page is opened with a network.
BASE_MAP = "https://tile.openstreetmap.org/{z}/{x}/{y}.png"


def map_page(path: str | Path, title: str, layers: Iterable[dict], centre: tuple[float, float] | None = None, base: str | None = BASE_MAP) -> Path:
    """A page that draws one file's layers around ``centre`` (lon, lat; else the middle of all); legs are coloured by confidence and tell
    their figures."""
    rows = [{**x, "coordinates": [[p["lon"], p["lat"]] for p in x["coordinates"]]} for x in layers]
    if centre is None:
        every = [p for x in rows for p in x["coordinates"]] or [[0.0, 0.0]]
        centre = tuple((min(p[i] for p in every) + max(p[i] for p in every)) / 2 for i in (0, 1))
    safe = lambda x: json.dumps(x).replace("</", "<\\/")
    page = _PAGE % {"title": escape(title), "layers": safe(rows), "colors": json.dumps(COLORS), "centre": json.dumps(list(centre)), "base": safe(base)}
    return replace_file(path, page.encode())


def replace_file(path: str | Path, content: bytes) -> Path:
    """Write a file as a whole: a reader sees the old one or the new one, and writing twice is as good as once."""
    path = Path(path)
    part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    part.write_bytes(content)
    part.replace(path)
    return path


def log_to(path: str | Path) -> logging.Handler:
    """Log this package to a file of at most 2 MB, with five older ones kept."""
    handler = logging.handlers.RotatingFileHandler(path, maxBytes=2 << 20, backupCount=5, encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log = logging.getLogger("routeloom")
    log.setLevel(logging.INFO)
    log.addHandler(handler)
    return handler


def _geometry(kind: str, points: list[tuple[float, float]]) -> bytes:
    """GeoPackage binary: header without envelope, then WKB in little-endian."""
    head = b"GP\x00\x01" + struct.pack("<i", 4326)
    if kind == "point":
        return head + struct.pack("<BIdd", 1, 1, *points[0])
    return head + struct.pack("<BII", 1, 2, len(points)) + b"".join(struct.pack("<dd", *p) for p in points)


def geopackage(path: str | Path, layers: Iterable[dict]) -> Path:
    """One feature table per layer in an SQLite file; an error if there is nothing to write."""
    rows: dict[str, list[dict]] = {}
    for x in layers:
        rows.setdefault(x["layer"], []).append(x)
    if not rows:
        raise ValueError("nothing to write")
    path = Path(path)
    part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    con = sqlite3.connect(part)
    con.execute("PRAGMA application_id = 1196444487")
    con.execute("PRAGMA user_version = 10300")
    con.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT, description TEXT)")
    con.execute("INSERT INTO gpkg_spatial_ref_sys VALUES ('WGS 84', 4326, 'EPSG', 4326, 'GEOGCS[\"WGS 84\",DATUM[\"WGS_1984\",SPHEROID[\"WGS 84\",6378137,298.257223563]],PRIMEM[\"Greenwich\",0],UNIT[\"degree\",0.0174532925199433]]', NULL)")
    con.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT UNIQUE, description TEXT, last_change TEXT, min_x REAL, min_y REAL, max_x REAL, max_y REAL, srs_id INTEGER)")
    con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z TINYINT, m TINYINT)")
    for layer, own in rows.items():
        kind = own[0]["kind"]
        con.execute(f'CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom BLOB, file TEXT, ord INTEGER, name TEXT, confidence TEXT)')
        every = [(p["lon"], p["lat"]) for x in own for p in x["coordinates"]]
        box = (min(p[0] for p in every), min(p[1] for p in every), max(p[0] for p in every), max(p[1] for p in every))
        con.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, '', strftime('%Y-%m-%dT%H:%M:%fZ', 'now'), ?, ?, ?, ?, 4326)", (layer, layer, *box))
        con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?, 4326, 0, 0)", (layer, "POINT" if kind == "point" else "LINESTRING"))
        con.executemany(
            f'INSERT INTO "{layer}" (geom, file, ord, name, confidence) VALUES (?, ?, ?, ?, ?)',
            [(_geometry(kind, [(p["lon"], p["lat"]) for p in x["coordinates"]]), str(x["file_id"]), x["ord"], x["name"], x["confidence"]) for x in own],
        )
    con.commit()
    con.close()
    part.replace(path)
    return path
