"""DuckDB SQL for the registered queries, built from shared common table expressions.

Independent of the Spark operators: recursive queries replace the kernels, brute-force joins the grid, and SQL arithmetic the column
expressions.
"""

from __future__ import annotations

#: Fixed values, written out here so that a wrong constant in the operators shows: the Krueger series of WGS84 (alpha 1 to 4), scale times
#: rectifying radius in metres, and the eccentricity.
_ALPHA = (8.377318206244698e-04, 7.608527773572307e-07, 1.197645503329453e-09, 2.429170607201359e-12)
_SCALED_M = 0.9996 * 6367449.145823415
_ECCENTRIC = 0.08181919084262149
_WORDS = (
    "r rua av avenida avn avenida al alameda tv travessa trav travessa pc praca pca praca rod rodovia estr estrada est estrada prof professor "
    "profa professora dr doutor dra doutora eng engenheiro sen senador pe padre sta santa sto santo s sao"
).split()
_CLASS_BONUS = {"motorway": 0.6, "trunk": 0.5, "primary": 0.4, "secondary": 0.3, "tertiary": 0.2, "residential": 0.1, "unclassified": 0.0, "service": -0.2, "living_street": 0.0}

_R = "6371000.0::DOUBLE"


def hav(a1: str, o1: str, a2: str, o2: str) -> str:
    return (
        f"(2 * {_R} * asin(least(1::DOUBLE, sqrt(pow(sin((radians({a2}) - radians({a1})) / 2), 2) + cos(radians({a1})) * cos(radians({a2})) * pow(sin(radians({o2} - {o1}) / 2), 2)))))"
    )


def fmod360(x: str) -> str:
    return f"(({x}) - 360::DOUBLE * floor(({x}) / 360::DOUBLE))"


def brg(a1: str, o1: str, a2: str, o2: str) -> str:
    y = f"sin(radians({o2} - {o1})) * cos(radians({a2}))"
    x = f"cos(radians({a1})) * sin(radians({a2})) - sin(radians({a1})) * cos(radians({a2})) * cos(radians({o2} - {o1}))"
    return fmod360(f"degrees(atan2({y}, {x})) + 360::DOUBLE")


def ang(a: str, b: str) -> str:
    d = fmod360(f"({a}) - ({b})")
    return f"(CASE WHEN ({a}) IS NOT NULL AND ({b}) IS NOT NULL THEN least({d}, 360::DOUBLE - {d}) END)"


def _f(x: float) -> str:
    return f"{x!r}::DOUBLE"


def utm(lat: str, lon: str, epsg: str, source: str, name: str) -> str:
    """CTE ``name``: ``source`` with x and y."""
    cm = f"((({epsg}) % 100) * 6.0::DOUBLE - 183.0::DOUBLE)"
    xs = " + ".join([f"{_f(a)} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(_ALPHA, 1)])
    ys = " + ".join([f"{_f(a)} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(_ALPHA, 1)])
    k = _f(_SCALED_M)
    e = _f(_ECCENTRIC)
    return f"""
{name}_a AS (SELECT *, sinh(atanh(sin(radians({lat}))) - {e} * atanh({e} * sin(radians({lat})))) AS tt, radians({lon} - {cm}) AS lam FROM {source}),
{name}_b AS (SELECT *, atan2(tt, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + tt * tt)) AS eta FROM {name}_a),
{name} AS (SELECT * EXCLUDE (tt, lam, xi, eta), 500000::DOUBLE + {k} * (eta + {xs}) AS x,
  CASE WHEN ({epsg}) >= 32700 THEN 10000000::DOUBLE ELSE 0::DOUBLE END + {k} * (xi + {ys}) AS y FROM {name}_b)"""


TRACKS = """
v0 AS (SELECT event_id AS e, user_id AS file_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS i FROM events),
v1 AS (SELECT *, CASE WHEN i = 0 OR (file_id % 3 = 0 AND i % 20 BETWEEN 8 AND 14) THEN 0 ELSE 6 END AS step, (i // 20) % 4 AS leg, (e * 31) % 3 - 1 AS jit FROM v0),
v2 AS (SELECT *, sum(CASE WHEN leg IN (0, 2) THEN step ELSE 0 END) OVER w AS ce, sum(CASE leg WHEN 1 THEN step WHEN 3 THEN -step ELSE 0 END) OVER w AS cn
  FROM v1 WINDOW w AS (PARTITION BY file_id ORDER BY i)),
raw AS (SELECT file_id, 0 AS trk, i // 50 AS seg, i AS pt,
  CASE WHEN e % 307 = 0 THEN 0::DOUBLE WHEN e % 311 = 0 THEN 95::DOUBLE ELSE CAST(-302000 + ((file_id // 12) % 12) * 120 + cn + CASE WHEN leg IN (0, 2) THEN jit ELSE 0 END
    + CASE WHEN e % 211 = 0 AND i > 0 THEN 5000 ELSE 0 END AS DOUBLE) / 100000 END AS lat,
  CASE WHEN e % 307 = 0 THEN 0::DOUBLE ELSE CAST(-5994000 + (file_id % 12) * 120 + ce + CASE WHEN leg IN (1, 3) THEN jit ELSE 0 END AS DOUBLE) / 100000 END AS lon,
  CASE WHEN file_id % 25 <> 7 THEN TIMESTAMP '2026-07-01 12:00:00' + to_seconds(i - CASE WHEN e % 41 = 0 AND i > 0 THEN 1 ELSE 0 END) END AS t,
  CASE WHEN e % 97 = 0 THEN 45::DOUBLE ELSE 1 + CAST(e % 20 AS DOUBLE) / 10 END AS hdop FROM v2),
okraw AS (SELECT * FROM raw WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (abs(lat) < 1e-7 AND abs(lon) < 1e-7)),
p0 AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY pt) - 1 AS idx FROM okraw)"""


def kin(source: str, name: str) -> str:
    return f"""
{name}_a AS (SELECT *, lag(lat) OVER w AS pl, lag(lon) OVER w AS po, lag(t) OVER w AS pt_ FROM {source} WINDOW w AS (PARTITION BY file_id ORDER BY idx)),
{name}_b AS (SELECT *, CASE WHEN pl IS NOT NULL THEN {hav("pl", "po", "lat", "lon")} END AS d_, CASE WHEN pl IS NOT NULL THEN {brg("pl", "po", "lat", "lon")} END AS b_,
  (epoch_us(t) - epoch_us(pt_)) / 1e6::DOUBLE AS dt_ FROM {name}_a),
{name} AS (SELECT * EXCLUDE (pl, po, pt_, d_, b_, dt_), coalesce(d_, 0) AS dist_prev_m, sum(coalesce(d_, 0)) OVER (PARTITION BY file_id ORDER BY idx) AS dist_cum_m,
  CASE WHEN dt_ > 0 THEN d_ / dt_ * 3.6::DOUBLE END AS speed_kmh, coalesce(b_, lead(b_) OVER (PARTITION BY file_id ORDER BY idx)) AS bearing FROM {name}_b)"""


def renumber(source: str, name: str, where: str = "true") -> str:
    return f"""
{name} AS (SELECT file_id, pt, lat, lon, t, row_number() OVER (PARTITION BY file_id ORDER BY idx) - 1 AS idx FROM {source} WHERE {where})"""


_DROP = f"({hav('r.kl', 'r.ko', 'q.lat', 'q.lon')} <= CASE WHEN q.t = r.kt THEN 0.5::DOUBLE ELSE 0.05::DOUBLE END)"
DEDUP = (
    TRACKS
    + ","
    + renumber("p0", "p1", "NOT (hdop > 30)")
    + f""",
dd AS (SELECT file_id, idx, pt, lat, lon, t, lat AS kl, lon AS ko, t AS kt, true AS keep FROM p1 WHERE idx = 0
  UNION ALL SELECT file_id, idx, pt, lat, lon, t, CASE WHEN dr THEN kl ELSE lat END, CASE WHEN dr THEN ko ELSE lon END, CASE WHEN dr THEN kt ELSE t END, NOT dr
  FROM (SELECT q.*, r.kl, r.ko, r.kt, {_DROP} AS dr FROM dd r JOIN p1 q ON q.file_id = r.file_id AND q.idx = r.idx + 1)),"""
    + renumber("dd", "p2", "keep")
)
SPIKE = (
    DEDUP
    + ","
    + kin("p2", "k2")
    + """,
sp AS (SELECT *, coalesce(speed_kmh > 200 AND lead(speed_kmh) OVER w > 200 AND lag(idx) OVER w IS NOT NULL, false) AS spike FROM k2 WINDOW w AS (PARTITION BY file_id ORDER BY idx))"""
)
IDLE = (
    SPIKE
    + ","
    + renumber("sp", "p3", "NOT spike")
    + ","
    + kin("p3", "k3")
    + """,
i1 AS (SELECT *, coalesce(speed_kmh < 1.5, false) AS slow FROM k3),
i2 AS (SELECT *, sum(CASE WHEN slow THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY idx) AS run FROM i1),
i3 AS (SELECT *, row_number() OVER (PARTITION BY file_id, run, slow ORDER BY idx) AS rn, count(*) OVER (PARTITION BY file_id, run, slow) AS rc, count(*) OVER (PARTITION BY file_id) AS fc FROM i2),
idl AS (SELECT *, slow AND rc >= 5 AND rn > 1 AND rn < rc AND fc >= 3 AS idle FROM i3)"""
)
CLEAN = IDLE + "," + renumber("idl", "p4", "NOT idle") + "," + kin("p4", "k4")
_EPSG = "CASE WHEN {a} >= 0 THEN 32600 ELSE 32700 END + greatest(1, least(60, CAST(floor(({o} + 180) / 6::DOUBLE) AS INT) + 1))"
_MID = _EPSG.format(
    a="(min(lat) OVER (PARTITION BY file_id) + max(lat) OVER (PARTITION BY file_id)) / 2",
    o="(min(lon) OVER (PARTITION BY file_id) + max(lon) OVER (PARTITION BY file_id)) / 2",
)
ANCHOR = (
    CLEAN
    + f""",
a1 AS (SELECT *, {_MID} AS epsg, lead(bearing) OVER w AS nb, lag(speed_kmh) OVER w AS ps, lag(idx) OVER w AS pi, lead(idx) OVER w AS ni FROM k4 WINDOW w AS (PARTITION BY file_id ORDER BY idx)),
a2 AS (SELECT * EXCLUDE (nb, ps, pi, ni), pi IS NOT NULL AND ni IS NOT NULL AND (coalesce({ang("bearing", "nb")} >= 20, false) OR coalesce(abs(speed_kmh - ps) >= 15, false)) AS anchor FROM a1),"""
    + utm("lat", "lon", "epsg", "a2", "m4")
)
_SEG = """CASE WHEN (bx-ax)*(bx-ax)+(by_-ay)*(by_-ay) > 0 THEN greatest(0::DOUBLE, least(1::DOUBLE, ((x-ax)*(bx-ax)+(y-ay)*(by_-ay)) / ((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)))) ELSE 0::DOUBLE END"""
SIMPLIFY = (
    ANCHOR
    + f""",
m5 AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS hop, max(idx) OVER (PARTITION BY file_id) AS last FROM m4 WINDOW w AS (PARTITION BY file_id ORDER BY idx)),
sm AS (SELECT file_id, idx, 0::DOUBLE AS way, true AS keep FROM m5 WHERE idx = 0
  UNION ALL SELECT q.file_id, q.idx, CASE WHEN r.way + q.hop >= 10 THEN 0 ELSE r.way + q.hop END, r.way + q.hop >= 10 OR q.idx = q.last FROM sm r JOIN m5 q ON q.file_id = r.file_id AND q.idx = r.idx + 1),
dp AS (SELECT file_id, 0::BIGINT AS a, last AS b FROM m5 WHERE idx = 0
  UNION ALL SELECT file_id, CASE WHEN s = 0 THEN a ELSE m END, CASE WHEN s = 0 THEN m ELSE b END FROM (
    SELECT file_id, a, b, arg_max(idx, (round(d, 6), -idx)) AS m, max(d) AS md FROM (
      SELECT file_id, a, b, idx, sqrt(pow(x - ax - sh * (bx - ax), 2) + pow(y - ay - sh * (by_ - ay), 2)) AS d FROM (
        SELECT *, {_SEG} AS sh FROM (
          SELECT g.file_id, g.a, g.b, c.idx, c.x, c.y, l.x AS ax, l.y AS ay, h.x AS bx, h.y AS by_ FROM dp g
          JOIN m5 c ON c.file_id = g.file_id AND c.idx > g.a AND c.idx < g.b JOIN m5 l ON l.file_id = g.file_id AND l.idx = g.a JOIN m5 h ON h.file_id = g.file_id AND h.idx = g.b)))
    GROUP BY file_id, a, b) CROSS JOIN (VALUES (0), (1)) z(s) WHERE md > 3),
dk AS (SELECT file_id, a AS idx FROM dp UNION SELECT file_id, b FROM dp),
u1 AS (SELECT m5.*, anchor OR idx = 0 OR idx = last AS prot FROM m5 WHERE anchor OR idx = 0 OR idx = last OR last <= 1
  OR (file_id, idx) IN (SELECT file_id, idx FROM sm WHERE keep) OR (file_id, idx) IN (SELECT file_id, idx FROM dk)),
u2 AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY idx) - 1 AS j FROM u1),
th AS (SELECT file_id, j, idx, x AS lx, y AS ly, true AS keep FROM u2 WHERE j = 0
  UNION ALL SELECT file_id, j, idx, CASE WHEN ok THEN x ELSE lx END, CASE WHEN ok THEN y ELSE ly END, ok
  FROM (SELECT q.*, r.lx, r.ly, q.prot OR sqrt(pow(q.x - r.lx, 2) + pow(q.y - r.ly, 2)) >= 3 AS ok FROM th r JOIN u2 q ON q.file_id = r.file_id AND q.j = r.j + 1)),
s5 AS (SELECT k4.file_id, k4.pt, k4.lat, k4.lon, k4.t, row_number() OVER (PARTITION BY k4.file_id ORDER BY k4.idx) - 1 AS idx FROM k4 JOIN th ON th.file_id = k4.file_id AND th.idx = k4.idx AND th.keep),"""
    + kin("s5", "k5")
)


def norm_sql(x: str) -> str:
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in zip(_WORDS[::2], _WORDS[1::2], strict=True))
    plain = f"regexp_replace(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[^\\w\\s-]', ' ', 'g'), '[-_]', ' ', 'g')"
    return f"array_to_string(list_transform(list_filter(string_split_regex({plain}, '\\s+'), lambda w: w <> ''), lambda w: CASE w {cases} ELSE w END), ' ')"


_BONUS = " ".join(f"WHEN '{k}' THEN {_f(v)}" for k, v in _CLASS_BONUS.items())


def identity_sql(name: str, official: str, ref: str, alt: str, highway: str, osmid: str) -> str:
    shown = f"coalesce({name}, {official}, {ref}, {alt})"
    return f"""CASE WHEN {shown} IS NOT NULL THEN CASE WHEN {name} IS NULL AND {official} IS NULL AND {ref} IS NOT NULL THEN 'ref:' ELSE 'name:' END || {norm_sql(shown)}
    WHEN {osmid} IS NOT NULL THEN 'osm:' || {osmid} ELSE 'class:' || coalesce({highway}, 'via') END AS road_id,
  CASE WHEN {shown} IS NOT NULL THEN {shown} WHEN {osmid} IS NOT NULL THEN 'unnamed OSM ' || {osmid} ELSE 'unnamed ' || coalesce({highway}, 'via') END AS road_name,
  coalesce({ref}, '') AS ref, coalesce({highway}, '') AS highway"""


ROADS = f"""
n0 AS (SELECT n_nationkey::BIGINT AS k FROM nation WHERE n_nationkey <= 16),
l0 AS (SELECT k + o AS line, p FROM n0, (VALUES (0), (17)) z(o), (SELECT k AS p FROM n0 WHERE k < 16)),
l1 AS (SELECT line, CASE WHEN line < 17 THEN p * 100 + line % 17 ELSE (line % 17) * 100 + p END AS p, CASE WHEN line < 17 THEN (p + 1) * 100 + line % 17 ELSE (line % 17) * 100 + p + 1 END AS q FROM l0),
l2 AS (SELECT line, p AS u, q AS v FROM l1 UNION ALL SELECT line, q, p FROM l1 WHERE line % 7 <> 3),
l3 AS (SELECT *, CAST(-5994000 + 120 * (u // 100) AS DOUBLE) / 100000 AS ulon, CAST(-302000 + 120 * (u % 100) AS DOUBLE) / 100000 AS ulat,
  CAST(-5994000 + 120 * (v // 100) AS DOUBLE) / 100000 AS vlon, CAST(-302000 + 120 * (v % 100) AS DOUBLE) / 100000 AS vlat,
  CASE WHEN line % 6 >= 4 THEN NULL WHEN line % 4 = 0 THEN 'Av. São João ' || line WHEN line % 4 = 1 THEN 'R. Conceição-' || line ELSE 'Estr. do Açaí ' || line END AS nm,
  CASE WHEN line % 6 = 4 THEN 'BR-' || line END AS rf, ['primary', 'secondary', 'tertiary', 'residential', 'service'][line % 5 + 1] AS hw FROM l2),
roads AS (SELECT u, v, 0 AS k, CAST(1000 + line AS VARCHAR) AS osmid, {identity_sql("nm", "CAST(NULL AS VARCHAR)", "rf", "CAST(NULL AS VARCHAR)", "hw", "CAST(1000 + line AS VARCHAR)")},
  {hav("ulat", "ulon", "vlat", "vlon")} AS length_m, ulat, ulon, vlat, vlon FROM l3)"""
CANDIDATES = (
    SIMPLIFY
    + ","
    + ROADS
    + ","
    + utm("lat", "lon", "32721", "k5", "k6")
    + ","
    + utm("ulat", "ulon", "32721", "roads", "ra")
    + ","
    + "rb AS (SELECT * EXCLUDE (x, y), x AS ax, y AS ay FROM ra),"
    + utm("vlat", "vlon", "32721", "rb", "rc")
    + f""",
rd AS (SELECT * EXCLUDE (x, y), x AS bx, y AS by_ FROM rc),
c0 AS (SELECT p.file_id, p.idx, p.x, p.y, p.bearing, r.* FROM k6 p JOIN rd r ON p.x BETWEEN least(ax, bx) - 51 AND greatest(ax, bx) + 51 AND p.y BETWEEN least(ay, by_) - 51 AND greatest(ay, by_) + 51),
c1 AS (SELECT *, {_SEG} AS sh, sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)) AS pm FROM c0),
c2 AS (SELECT *, ax + sh * (bx - ax) AS fx, ay + sh * (by_ - ay) AS fy, sqrt(pow(x - ax - sh * (bx - ax), 2) + pow(y - ay - sh * (by_ - ay), 2)) AS distance_m,
  sh * pm / length_m AS fraction, {fmod360("degrees(atan2(bx - ax, by_ - ay)) + 360::DOUBLE")} AS road_bearing FROM c1),
c3 AS (SELECT *, min(distance_m) OVER (PARTITION BY file_id, idx) AS near FROM c2 WHERE distance_m <= 50),
c4 AS (SELECT *, row_number() OVER (PARTITION BY file_id, idx ORDER BY round(distance_m, 3), u, v, k) - 1 AS pos FROM c3 WHERE near > 30 OR distance_m <= 30),
cand AS (SELECT *, -0.5::DOUBLE * pow(distance_m / 12, 2) + coalesce(-0.5::DOUBLE * pow({ang("bearing", "road_bearing")} / 45, 2), 0) + CASE highway {_BONUS} ELSE 0 END AS emission FROM c4 WHERE pos < 8)"""
)
NETWORK = """
nd0 AS (SELECT a.k * 100 + b.k AS source, a.k * 100 + b.k AS target, 0::DOUBLE AS dist FROM n0 a, n0 b
  UNION ALL SELECT source, v, min(dist + length_m) FROM nd0 JOIN roads ON u = target WHERE dist + length_m <= {far} GROUP BY source, v),
net AS (SELECT source, target, min(dist) AS dist FROM nd0 GROUP BY ALL)"""
MATCH = (
    CANDIDATES
    + ","
    + NETWORK.format(far=700)
    + """,
w0 AS (SELECT DISTINCT file_id, idx FROM cand),
w1 AS (SELECT *, idx - row_number() OVER (PARTITION BY file_id ORDER BY idx) AS run FROM w0),
w2 AS (SELECT *, row_number() OVER (PARTITION BY file_id, run ORDER BY idx) - 1 AS t_ FROM w1),
st AS (SELECT c.*, w2.run, w2.t_ FROM cand c JOIN w2 USING (file_id, idx)),
tr0 AS (SELECT b.file_id, b.run, b.t_, a.pos AS a, b.pos AS b, b.emission, a.u AS au, a.v AS av, a.k AS ak, b.u AS bu, b.v AS bv, b.k AS bk, a.fraction AS af, b.fraction AS bf, a.length_m AS al, b.length_m AS bl,
  sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS hop FROM st a JOIN st b ON a.file_id = b.file_id AND a.run = b.run AND b.t_ = a.t_ + 1),
tr1 AS (SELECT tr0.*, CASE WHEN au = bu AND av = bv AND ak = bk THEN abs(bf - af) * al WHEN dist <= greatest(60::DOUBLE, 3 * hop + 60) THEN al * (1 - af) + dist + bl * bf END AS way
  FROM tr0 LEFT JOIN net ON source = av AND target = bu),
tr AS (SELECT *, CASE WHEN way IS NULL THEN -1e9::DOUBLE ELSE -abs(way - hop) / 12 END AS trans FROM tr1),
vit AS (SELECT file_id, run, t_, pos AS b, round(emission, 6) AS score, -1::BIGINT AS bp FROM st WHERE t_ = 0
  UNION ALL SELECT file_id, run, t_, b, CASE WHEN bad THEN round(emission, 6) ELSE sc END, CASE WHEN bad THEN -1 ELSE bp END FROM (
    SELECT *, max(sc) OVER (PARTITION BY file_id, run) <= -5e8 AS bad FROM (
      SELECT file_id, run, t_, b, emission, round(greatest(-1e9::DOUBLE, coalesce(top, -1e9::DOUBLE)) + emission, 6) AS sc, CASE WHEN top > -1e9 THEN best ELSE -1 END AS bp FROM (
        SELECT tr.file_id, tr.run, tr.t_, tr.b, tr.emission, max(round(v.score + tr.trans, 6)) FILTER (v.score > -5e8) AS top,
          arg_max(tr.a, (round(v.score + tr.trans, 6), -tr.a)) FILTER (v.score > -5e8) AS best
        FROM vit v JOIN tr ON tr.file_id = v.file_id AND tr.run = v.run AND tr.t_ = v.t_ + 1 AND tr.a = v.b GROUP BY ALL)))),
ends AS (SELECT file_id, run, max(t_) AS t_ FROM vit GROUP BY ALL),
bk AS (SELECT file_id, run, t_, arg_max(b, (score, -b)) AS s FROM vit JOIN ends USING (file_id, run, t_) GROUP BY ALL
  UNION ALL SELECT v.file_id, v.run, v.t_ - 1, greatest(0, v.bp) FROM bk JOIN vit v ON v.file_id = bk.file_id AND v.run = bk.run AND v.t_ = bk.t_ AND v.b = bk.s WHERE v.t_ > 0),
ch AS (SELECT st.* FROM st JOIN bk ON st.file_id = bk.file_id AND st.run = bk.run AND st.t_ = bk.t_ AND st.pos = bk.s),
se AS (SELECT st.file_id, st.idx, arg_max(st.pos, (round(st.emission, 6), -st.pos)) AS pos FROM st JOIN ch ON ch.file_id = st.file_id AND ch.idx = st.idx AND ch.pos <> st.pos GROUP BY ALL),
mt AS (SELECT k6.*, ch.pos AS state, ch.u, ch.v, ch.road_id, ch.road_name, ch.ref, ch.highway, ch.osmid, ch.road_bearing, ch.distance_m AS road_m, s2.road_name AS second_road, ch.emission - s2.emission AS margin
  FROM k6 LEFT JOIN ch ON ch.file_id = k6.file_id AND ch.idx = k6.idx LEFT JOIN se ON se.file_id = k6.file_id AND se.idx = k6.idx
  LEFT JOIN st s2 ON s2.file_id = se.file_id AND s2.idx = se.idx AND s2.pos = se.pos)"""
)


def runs(source: str, road: str, name: str) -> str:
    return f"""
{name}_a AS (SELECT *, lag(idx) OVER w IS NULL OR {road} IS DISTINCT FROM lag({road}) OVER w AS new FROM {source} WINDOW w AS (PARTITION BY file_id ORDER BY idx)),
{name} AS (SELECT * EXCLUDE (new), sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY idx) AS leg_no FROM {name}_a)"""


_REPL = "(CASE WHEN i > 1 AND rs[i - 1].r IS NOT NULL AND i < len(rs) AND rs[i + 1].r IS NOT NULL THEN CASE WHEN rs[i - 1].r = rs[i + 1].r OR rs[i - 1].d >= rs[i + 1].d THEN rs[i - 1].r ELSE rs[i + 1].r END WHEN i > 1 AND rs[i - 1].r IS NOT NULL THEN rs[i - 1].r WHEN i < len(rs) THEN rs[i + 1].r END)"
LEGS = (
    MATCH
    + ","
    + runs("mt", "road_id", "g0")
    + f""",
g1 AS (SELECT file_id, leg_no, any_value(road_id) AS r, sum(dist_prev_m ORDER BY idx) AS d, count(*) AS n FROM g0 GROUP BY ALL),
g2 AS (SELECT file_id, list(struct_pack(r := r, d := d, n := n) ORDER BY leg_no) AS rs FROM g1 GROUP BY ALL),
fx AS (SELECT file_id, rs, 0 AS round_no FROM g2
  UNION ALL SELECT file_id, list_reduce(list_transform(rs, lambda x, i: [CASE WHEN i = hit THEN struct_pack(r := new, d := x.d, n := x.n) ELSE x END]),
      lambda acc, x: CASE WHEN acc[len(acc)].r IS NOT DISTINCT FROM x[1].r THEN list_append(acc[1:len(acc) - 1], struct_pack(r := x[1].r, d := acc[len(acc)].d + x[1].d, n := acc[len(acc)].n + x[1].n)) ELSE list_concat(acc, x) END),
    round_no + 1
  FROM (SELECT *, {_REPL.replace("i -", "hit -").replace("i +", "hit +").replace("i <", "hit <").replace("i >", "hit >")} AS new FROM (
    SELECT file_id, rs, round_no, list_filter(range(1, len(rs) + 1), lambda i: rs[i].r IS NOT NULL AND rs[i].d < 20 AND {_REPL} IS NOT NULL)[1] AS hit FROM fx WHERE round_no < 100) WHERE hit IS NOT NULL)),
fl AS (SELECT file_id, arg_max(rs, round_no) AS rs FROM fx GROUP BY ALL),
fr AS (SELECT file_id, unnest(range(1, len(rs) + 1)) AS j, rs FROM fl),
fs AS (SELECT file_id, j AS leg_no, rs[j].r AS leg_road, list_sum(list_transform(rs[1:j], lambda x: x.n)) AS upto, rs[j].n AS n FROM fr),
ml AS (SELECT mt.*, fs.leg_road, fs.leg_no FROM mt JOIN fs ON fs.file_id = mt.file_id AND mt.idx >= upto - n AND mt.idx < upto),
lg0 AS (SELECT file_id, leg_no, any_value(leg_road) AS road_id,
  coalesce(arg_min((road_name, ref, highway, osmid), (round(road_m, 6), idx)) FILTER (road_id = leg_road), arg_min((road_name, ref, highway, osmid), idx) FILTER (state IS NOT NULL)) AS rd,
  arg_min_null(t, idx) AS t_in, arg_max_null(t, idx) AS t_out, sum(dist_prev_m) AS distance_m, count(*) AS n_points,
  arg_min(lat, idx) AS lat_first, arg_min(lon, idx) AS lon_first, arg_max(lat, idx) AS lat_last, arg_max(lon, idx) AS lon_last,
  coalesce(avg(road_m), 0) AS mean0, coalesce(max(road_m), 0) AS max0, avg({ang("bearing", "road_bearing")}) AS turn0, avg(margin) AS margin0 FROM ml GROUP BY ALL),
lg1 AS (SELECT *, road_id IS NOT NULL AS known, CASE WHEN road_id IS NULL THEN 0::DOUBLE ELSE mean0 END AS mean_m, CASE WHEN road_id IS NULL THEN 0::DOUBLE ELSE max0 END AS max_m,
  CASE WHEN road_id IS NOT NULL THEN turn0 END AS turn_deg, CASE WHEN road_id IS NOT NULL THEN margin0 END AS mean_margin, (epoch_us(t_out) - epoch_us(t_in)) / 1e6::DOUBLE AS duration_s FROM lg0),
lg2 AS (SELECT *, CASE WHEN NOT known THEN 'unidentified'
  WHEN mean_m <= 8 AND max_m <= 20 AND coalesce(turn_deg, 0) <= 25 AND n_points >= 3 AND coalesce(mean_margin, 1.5) >= 1.5 THEN 'high'
  WHEN mean_m <= 18 AND coalesce(turn_deg, 0) <= 55 AND n_points >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM lg1),
lg3 AS (SELECT *, CASE confidence WHEN 'medium' THEN concat_ws('; ', CASE WHEN mean_m > 8 THEN 'high mean distance' END, CASE WHEN turn_deg > 25 THEN 'diverging heading' END, CASE WHEN mean_margin < 1.5 THEN 'competing road nearby' END)
  WHEN 'low' THEN concat_ws('; ', CASE WHEN mean_m > 18 THEN 'points far from the road (mean ' || CAST(round_even(mean_m, 0) AS INT) || ' m)' END, CASE WHEN turn_deg > 55 THEN 'strongly diverging heading' END, CASE WHEN n_points < 2 THEN 'very short leg (few points)' END) ELSE '' END AS why FROM lg2),
lg AS (SELECT *, CASE WHEN known THEN rd[1] ELSE 'unidentified' END AS road_name, CASE WHEN known THEN rd[2] END AS ref, CASE WHEN known THEN rd[3] END AS highway, CASE WHEN known THEN rd[4] END AS osmid,
  CASE WHEN NOT known THEN 'no candidate road within the radius' ELSE concat_ws(' | ', CASE WHEN t_in IS NULL THEN 'no time in the file' END, CASE WHEN why <> '' THEN why END) END AS notes FROM lg3)"""
)


def dur(x: str) -> str:
    s = f"CAST(round_even({x}, 0) AS BIGINT)"
    return f"(CASE WHEN {x} IS NULL THEN '-' ELSE printf('%02d:%02d:%02d', {s} // 3600, ({s} % 3600) // 60, {s} % 60) END)"


INSPECT = (
    TRACKS
    + ","
    + kin("p0", "k0")
    + """,
s0 AS (SELECT *, coalesce(lat = lag(lat) OVER w AND lon = lag(lon) OVER w, false) AS same FROM k0 WINDOW w AS (PARTITION BY file_id ORDER BY idx)),
f0 AS (SELECT file_id, count(DISTINCT trk) AS n_tracks, count(DISTINCT (trk, seg)) AS n_segments, count(*) AS n_raw FROM raw GROUP BY ALL),
f1 AS (SELECT file_id, count(*) AS n_points, min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max, min(t) AS t_first, max(t) AS t_last, sum(dist_prev_m) AS dist,
  count(*) FILTER (speed_kmh > 400) AS n_jumps, count(*) FILTER (same) AS n_repeats, count(hdop) AS nh, count(t) AS nt FROM s0 GROUP BY ALL),
f AS (SELECT file_id, n_tracks, n_segments, n_raw - coalesce(n_points, 0) AS n_invalid, coalesce(n_points, 0) AS n_points, lat_min, lat_max, lon_min, lon_max, t_first, t_last,
  (epoch_us(t_last) - epoch_us(t_first)) / 1e6::DOUBLE AS duration_s, round(coalesce(dist, 0), 2) AS distance_m, coalesce(dist, 0) AS dist0, n_jumps, n_repeats, t_first IS NOT NULL AS has_time,
  concat_ws(',', CASE WHEN nh > 0 THEN 'hdop' END, CASE WHEN nt > 0 THEN 'time' END) AS fields FROM f0 LEFT JOIN f1 USING (file_id)),
an AS (SELECT file_id, list_filter([CASE WHEN n_jumps > 0 THEN n_jumps || ' speed jump(s) above 400 km/h' END, CASE WHEN n_repeats > 0 THEN n_repeats || ' repeated consecutive point(s)' END,
  CASE WHEN n_invalid > 0 THEN n_invalid || ' invalid coordinate(s) ignored' END, CASE WHEN n_points = 0 THEN 'no valid point' END], lambda x: x IS NOT NULL) AS a FROM f)"""
)
_WIDE = "300 / 111320::DOUBLE"
_STEP = "(5 / 111.32::DOUBLE)"


def tiles_of(source: str) -> str:
    return f"""
t0 AS (SELECT file_id, min(lat) AS a0, max(lat) AS a1, min(lon) AS o0, max(lon) AS o1 FROM {source} GROUP BY ALL),
t1 AS (SELECT *, {_WIDE} / greatest(0.1::DOUBLE, cos(radians((a0 + a1) / 2))) AS wide FROM t0),
t2 AS (SELECT file_id, unnest(range(CAST(floor((o0 - wide) / {_STEP}) AS BIGINT), CAST(floor((o1 + wide) / {_STEP}) AS BIGINT) + 1)) AS ix, a0, a1 FROM t1),
t3 AS (SELECT file_id, ix, unnest(range(CAST(floor((a0 - {_WIDE}) / {_STEP}) AS BIGINT), CAST(floor((a1 + {_WIDE}) / {_STEP}) AS BIGINT) + 1)) AS iy FROM t2),
tl AS (SELECT *, 't5k_' || ix || '_' || iy AS tile_id, ix * {_STEP} AS lon_min, iy * {_STEP} AS lat_min, (ix + 1) * {_STEP} AS lon_max, (iy + 1) * {_STEP} AS lat_max FROM t3)"""


CATALOG = """
cg AS (SELECT 't5k_' || (-1335 + s_suppkey % 9) || '_' || (-68 + (s_suppkey // 9) % 7) AS tile_id, s_suppkey::BIGINT AS version, CASE s_suppkey % 5 WHEN 1 THEN 'empty' WHEN 2 THEN 'error' ELSE 'ok' END AS state,
  TIMESTAMP '2026-07-01 00:00:00' - to_days(CAST((s_suppkey % 4) * 40 + CASE WHEN s_suppkey % 5 = 3 THEN 100 ELSE 0 END AS INTEGER)) AS downloaded, CASE WHEN s_suppkey % 5 = 0 THEN 10 + s_suppkey ELSE 0 END AS roads
  FROM supplier WHERE s_suppkey % 5 < 4),
cl AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY version DESC) AS rn FROM cg) WHERE rn = 1)"""
_AGE = "CAST(floor((epoch_us(TIMESTAMP '2026-07-01 06:00:00') - epoch_us(downloaded)) / 86400e6) AS BIGINT)"
DECIDE = (
    TRACKS
    + ","
    + tiles_of("p0")
    + ","
    + CATALOG
    + f""",
dc AS (SELECT w.tile_id, state, {_AGE} AS age_days, CASE WHEN state IN ('ok', 'empty') AND {_AGE} <= 90 THEN 'reused' ELSE 'download' END AS outcome, coalesce(state = 'ok', false) AS usable
  FROM (SELECT DISTINCT tile_id FROM tl) w LEFT JOIN cl USING (tile_id))"""
)
_NAMES = """
nx AS (SELECT n_nationkey::BIGINT AS k, n_name AS s FROM nation UNION ALL SELECT p_partkey + 1000, p_name FROM part),
nm AS (SELECT k, CASE WHEN k % 11 <> 3 THEN ['Av.', 'R.', 'Estr.', 'Prof. Dr.', 'Pça', 'S. João -', ''][k % 7 + 1] || ' ' || s || ' _Ção-Él''ñ  ' || (k % 5) END AS name FROM nx)"""
STATUS = (
    LEGS
    + """,
fz AS (SELECT DISTINCT file_id FROM raw),
sx AS (SELECT file_id, CASE WHEN coalesce(n, 0) < 2 THEN 'error' WHEN coalesce(nk, 0) = 0 THEN 'partial' ELSE 'ok' END AS status FROM fz
  LEFT JOIN (SELECT file_id, count(*) AS n FROM k4 GROUP BY ALL) USING (file_id) LEFT JOIN (SELECT file_id, count(*) FILTER (known) AS nk FROM lg GROUP BY ALL) USING (file_id))"""
)
COUNTS = """
q0 AS (SELECT file_id, count(*) AS n_original FROM p0 GROUP BY ALL), q1 AS (SELECT file_id, count(*) AS n_cleaned FROM k4 GROUP BY ALL), q2 AS (SELECT file_id, count(*) AS n_simplified FROM k5 GROUP BY ALL),
qs AS (SELECT file_id, n_original, coalesce(n_cleaned, 0) AS n_cleaned, coalesce(n_simplified, 0) AS n_simplified, 100 * (1 - coalesce(n_simplified, 0) / n_original::DOUBLE) AS reduction_percent
  FROM q0 LEFT JOIN q1 USING (file_id) LEFT JOIN q2 USING (file_id))"""
CONF = """cs AS (SELECT file_id, count(*) AS n_legs, count(*) FILTER (confidence = 'high') AS n_high, count(*) FILTER (confidence = 'medium') AS n_medium, count(*) FILTER (confidence = 'low') AS n_low,
  count(*) FILTER (confidence = 'unidentified') AS n_unidentified FROM lg GROUP BY ALL)"""


def _inspect_tail() -> str:
    """The parts of INSPECT behind TRACKS."""
    return INSPECT[len(TRACKS) :]


def _with(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"


def _home() -> str:
    b = brg("-2.875::DOUBLE", "-59.75::DOUBLE", "lat", "lon")
    h = hav("-2.875::DOUBLE", "-59.75::DOUBLE", "lat", "lon")
    a = ang(b, "350::DOUBLE")
    return f"""SELECT file_id, pt, round({h}, 3) AS home_m, round({b}, 3) AS home_bearing, round({a}, 3) AS turn, round(least({a}, 180 - {a}), 3) AS axis,
      round({h} * sin(radians({b})), 3) AS east_m, round({h} * cos(radians({b})), 3) AS north_m FROM okraw"""


def oracle_sql() -> dict[str, str]:
    kcols = "round(dist_prev_m, 3) AS dist_prev_m, round(dist_cum_m, 3) AS dist_cum_m, round(speed_kmh, 3) AS speed_kmh, round(bearing, 3) AS bearing"
    found_epsg = _EPSG.format(a="(lat + file_id % 7)", o="(lon + file_id % 50)")
    d = {
        "inspect_tracks": _with(INSPECT, "SELECT * EXCLUDE (dist0) FROM f"),
        "anomaly_report": _with(INSPECT, "SELECT file_id, unnest(range(0, len(a)))::INT AS ord, unnest(a) AS anomaly FROM an"),
        "valid_points": _with(TRACKS, "SELECT file_id, idx, seg, lat, lon, t, hdop FROM p0"),
        "point_kinematics": _with(TRACKS + "," + kin("p0", "k0"), f"SELECT file_id, idx, {kcols} FROM k0"),
        "geo_measures": _with(TRACKS, _home()),
        "sql_functions": _with(
            TRACKS,
            f"""SELECT file_id, pt, lat BETWEEN -90 AND 90 AND NOT (lat = 0 AND lon = 0) AS ok, round({hav("-2.875::DOUBLE", "-59.75::DOUBLE", "lat", "lon")}, 2) AS home_m,
            {_EPSG.format(a="lat", o="lon")} AS epsg, CAST(floor(lon / {_STEP}) AS BIGINT) AS ix, CAST(floor(lat / {_STEP}) AS BIGINT) AS iy FROM raw""",
        ),
        "precise_points": _with(TRACKS, "SELECT file_id, idx, hdop FROM p0 WHERE NOT (hdop > 30)"),
        "dedup_keep_last": _with(DEDUP, "SELECT file_id, idx, pt FROM dd WHERE keep"),
        "spike_filter": _with(SPIKE, "SELECT file_id, idx, pt, spike FROM sp"),
        "idle_thinning": _with(IDLE, "SELECT file_id, idx, pt, idle FROM idl"),
        "clean_pipeline": _with(CLEAN, f"SELECT file_id, idx, pt, {kcols} FROM k4"),
        "clean_pipeline_stats": _with(
            CLEAN,
            """SELECT file_id, n_in, n_out, n_in - n1 AS removed_invalid, n1 - n2 AS removed_repeats, n2 - n3 AS removed_spikes, n3 - n_out AS removed_idle,
            coalesce((SELECT string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) FROM (SELECT file_id AS g, idx, row_number() OVER (PARTITION BY file_id ORDER BY idx) AS rn FROM sp WHERE spike) z WHERE g = y.file_id AND rn <= 20), '') AS spike_indices FROM (
            SELECT a.file_id, a.n AS n_in, coalesce(b.n, 0) AS n1, coalesce(c.n, 0) AS n2, coalesce(e.n, 0) AS n3, coalesce(g.n, 0) AS n_out FROM (SELECT file_id, count(*) n FROM p0 GROUP BY ALL) a
            LEFT JOIN (SELECT file_id, count(*) n FROM p1 GROUP BY ALL) b USING (file_id) LEFT JOIN (SELECT file_id, count(*) n FROM p2 GROUP BY ALL) c USING (file_id)
            LEFT JOIN (SELECT file_id, count(*) n FROM p3 GROUP BY ALL) e USING (file_id) LEFT JOIN (SELECT file_id, count(*) n FROM p4 GROUP BY ALL) g USING (file_id)) y""",
        ),
        "utm_zone": _with(TRACKS, f"SELECT file_id, pt, greatest(1, least(60, CAST(floor((lon + file_id % 50 + 180) / 6::DOUBLE) AS INT) + 1)) AS zone, {found_epsg} AS epsg FROM okraw"),
        "utm_project": _with(TRACKS + f", pz AS (SELECT *, {_MID} AS epsg FROM p0)," + utm("lat", "lon", "epsg", "pz", "pu"), "SELECT file_id, idx, epsg, round(x, 3) AS x, round(y, 3) AS y FROM pu"),
        "utm_roundtrip": _with(TRACKS, "SELECT file_id, idx, round(lat, 8) AS lat, round(lon, 8) AS lon FROM p0"),
        "curve_anchors": _with(ANCHOR, "SELECT file_id, idx, anchor FROM a2"),
        "distance_sampling": _with(SIMPLIFY, "SELECT file_id, idx FROM sm WHERE keep"),
        "douglas_peucker": _with(SIMPLIFY, "SELECT file_id, idx FROM dk"),
        "thin_close_points": _with(SIMPLIFY, "SELECT file_id, idx FROM th WHERE keep"),
        "simplify_stats": _with(SIMPLIFY + "," + COUNTS, "SELECT file_id, n_original, n_cleaned, n_simplified, round(reduction_percent, 3) AS reduction_percent FROM qs"),
        "tile_assignment": _with(TRACKS, f"SELECT file_id, pt, CAST(floor(lon / {_STEP}) AS BIGINT) AS ix, CAST(floor(lat / {_STEP}) AS BIGINT) AS iy, 't5k_' || CAST(floor(lon / {_STEP}) AS BIGINT) || '_' || CAST(floor(lat / {_STEP}) AS BIGINT) AS tile_id FROM okraw"),
        "tiles_for_tracks": _with(TRACKS + "," + tiles_of("p0"), "SELECT file_id, ix, iy, tile_id, round(lon_min, 6) AS lon_min, round(lat_min, 6) AS lat_min, round(lon_max, 6) AS lon_max, round(lat_max, 6) AS lat_max FROM tl"),
        "tile_union": _with(TRACKS + "," + tiles_of("p0"), "SELECT DISTINCT tile_id, ix, iy FROM tl"),
        "tile_upsert_latest": _with(CATALOG, "SELECT tile_id, version, state, downloaded, roads FROM cl"),
        "tile_cache_decision": _with(DECIDE, "SELECT * REPLACE (coalesce(age_days, -1) AS age_days) FROM dc"),
        "tile_cache_offline": _with(
            DECIDE,
            f"""SELECT w.tile_id, state, coalesce({_AGE}, -1) AS age_days, CASE WHEN state IN ('ok', 'empty') AND {_AGE} <= 90 AND (state = 'empty' OR version % 2 = 1) THEN 'reused' ELSE 'missing' END AS outcome,
            coalesce(state = 'ok', false) AS usable FROM (SELECT DISTINCT tile_id FROM tl) w LEFT JOIN cl USING (tile_id)""",
        ),
        "tile_outcome_counts": _with(DECIDE, "SELECT outcome, count(*) AS n, count(*) FILTER (usable) AS n_usable FROM dc GROUP BY ALL"),
        "tile_downloads": _with(CATALOG, "SELECT tile_id, version + 1000 AS version, CASE WHEN version % 3 = 0 THEN 'error' WHEN version % 3 = 1 THEN 'ok' ELSE 'empty' END AS state, CASE WHEN version % 3 = 1 THEN 7 ELSE 0 END AS roads FROM cl"),
        "base_versions": _with(TRACKS + "," + tiles_of("p0") + "," + CATALOG, "SELECT file_id, CAST(CAST(max(downloaded) AS DATE) AS VARCHAR) AS base_version FROM tl JOIN cl USING (tile_id) GROUP BY ALL"),
        "repeat_detection": """WITH f AS (SELECT DISTINCT user_id AS file_id, sha256('track ' || (user_id % 40)) AS file_hash, 'a' AS config_hash FROM events),
          p AS (SELECT sha256('track ' || (c_custkey % 60)) AS file_hash, CASE WHEN c_custkey % 3 = 0 THEN 'b' ELSE 'a' END AS config_hash, max(c_custkey) AS prior_id FROM customer GROUP BY ALL)
          SELECT file_id, file_hash, coalesce(prior_id, -1) AS prior_id, prior_id IS NOT NULL AS repeated FROM f LEFT JOIN p USING (file_hash, config_hash)""",
        "download_errors": "SELECT CAST(doc_id AS VARCHAR) AS tile_id, sha256(substr(text, 1, 1000)) AS message_sha256, length(substr(text, 1, 1000)) AS n FROM documents",
        "normalize_road_names": _with(_NAMES, f"SELECT k, strip_accents(name) AS plain, {norm_sql('name')} AS normalized FROM nm"),
        "road_identity": _with(
            _NAMES,
            f"""SELECT k, {identity_sql("n_", "o_", "r_", "a_", "h_", "i_")} FROM (SELECT k, CASE WHEN k % 2 = 0 THEN name END AS n_, CASE WHEN k % 3 = 0 THEN 'Oficial ' || k END AS o_,
            CASE WHEN k % 5 = 0 THEN 'BR-' || k END AS r_, CASE WHEN k % 7 = 0 THEN 'Alt. da Sé' END AS a_, CASE WHEN k % 4 = 0 THEN 'primary' END AS h_, CASE WHEN k % 13 = 0 THEN CAST(k AS VARCHAR) END AS i_ FROM nm)""",
        ),
        "video_id": """SELECT k, name, CASE WHEN regexp_extract(name, '(?i)^(G[XHLP]\\d{4,})', 1) <> '' THEN regexp_extract(name, '(?i)^(G[XHLP]\\d{4,})', 1) ELSE regexp_replace(name, '(.)\\.[^.]*$', '\\1') END AS video_id
          FROM (SELECT o_orderkey AS k, ['GX0', 'gh12', 'GL', 'trip.v', 'GP9'][o_orderkey % 5 + 1] || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '.gpx' END AS name FROM orders)""",
        "format_duration": f"SELECT l_orderkey, l_linenumber, {dur('s')} AS duration FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 9 <> 0 THEN l_quantity * l_orderkey / 2 END AS s FROM lineitem)",
        "safe_file_name": """SELECT k, CASE WHEN s = '' THEN 'file' ELSE s END AS name FROM (SELECT k, rtrim(trim(regexp_replace(n, '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g')), '.') AS s FROM (
          SELECT p_partkey AS k, CASE WHEN p_partkey % 13 = 0 THEN ' ... ' ELSE p_name || ['...', '<a>:"b"', '/x\\y|?*', '  ', '.'][p_partkey % 5 + 1] END AS n FROM part))""",
        "config_identity": """SELECT r_regionkey::BIGINT AS k, left(sha256('{"candidate_radius_m": 30.0, "curve_deg": 20.0, "matching": {"beta_m": 12.0, "class_bonus": {'
            || '"living_street": 0.0, "motorway": 0.6, "primary": 0.4, "residential": 0.1, "secondary": 0.3, "service": -0.2, "tertiary": 0.2, "trunk": 0.5, "unclassified": 0.0}, '
            || '"cutoff_factor": 3.0, "cutoff_min_m": 60.0, "heading_weight": 1.0, "max_candidates": 8, "sigma_gps_m": 12.0, "sigma_heading_deg": 45.0}, '
            || '"max_distance_m": 50.0, "max_speed_kmh": 200.0, "min_leg_m": 20.0, "road_buffer_m": 300.0, "simplify_tolerance_m": 3.0, "spacing_m": '
            || (10 + r_regionkey) || '.0, "tile_km": 5.0}'), 16) AS config_hash FROM region""",
        "road_edges": _with(ROADS, "SELECT u, v, k, osmid, road_id, road_name, ref, highway, round(length_m, 3) AS length_m FROM roads"),
        "candidate_edges": _with(CANDIDATES, "SELECT file_id, idx, pos, u, v, k, round(distance_m, 3) AS distance_m, round(road_bearing, 3) AS road_bearing, round(fraction, 4) AS fraction FROM cand"),
        "emission_scores": _with(CANDIDATES, "SELECT file_id, idx, pos, round(emission, 3) AS emission FROM cand"),
        "nearest_roads": _with(CANDIDATES, "SELECT file_id, idx, count(pos) AS n, round(min(distance_m), 3) AS nearest_m FROM k6 LEFT JOIN cand USING (file_id, idx) GROUP BY ALL"),
        "network_distances": _with(ROADS + "," + NETWORK.format(far=450), "SELECT source, target AS \"to\", round(dist, 3) AS dist FROM net"),
        "viterbi_path": _with(MATCH, "SELECT file_id, idx, coalesce(state, -1) AS state, coalesce(u, -1) AS u, coalesce(v, -1) AS v, road_id FROM mt"),
        "match_margins": _with(MATCH, "SELECT file_id, idx, round(road_m, 3) AS road_m, round(margin, 3) AS margin, CASE WHEN state IS NULL THEN 'no road within the radius' ELSE '' END AS reason FROM mt"),
        "road_runs": _with(MATCH + "," + runs("mt", "road_id", "g0"), "SELECT file_id, leg_no, any_value(road_id) AS road, count(*) AS n, round(sum(dist_prev_m), 2) AS distance_m FROM g0 GROUP BY ALL"),
        "smooth_runs": _with(LEGS, "SELECT file_id, idx, leg_road, leg_no FROM ml"),
        "legs_table": _with(
            LEGS,
            """SELECT file_id, leg_no, road_id, road_name, ref, highway, osmid, t_in, t_out, duration_s, round(distance_m, 2) AS distance_m, n_points, lat_first, lon_first, lat_last, lon_last,
            round(mean_m, 2) AS mean_m, round(max_m, 2) AS max_m, n_points AS n_indices, n_points AS n_geometry FROM lg""",
        ),
        "leg_confidence": _with(LEGS, "SELECT file_id, leg_no, round(turn_deg, 2) AS turn_deg, round(mean_margin, 2) AS mean_margin, confidence, notes FROM lg"),
        "confidence_summary": _with(LEGS + "," + CONF, "SELECT * FROM cs"),
        "route_string": _with(LEGS, "SELECT file_id, substr(string_agg(road_name, ' > ' ORDER BY leg_no), 1, 120) AS route FROM lg GROUP BY ALL"),
        "report_legs": _with(LEGS, f"SELECT file_id, CAST(file_id AS VARCHAR) AS video_id, leg_no, road_name, {dur('duration_s')} AS duration, round(distance_m, 1) AS distance_m, round(mean_m, 2) AS mean_m, round(max_m, 2) AS max_m, confidence, notes FROM lg"),
        "report_points": _with(
            LEGS,
            """SELECT ml.file_id, idx, t, lat, lon, round(dist_cum_m, 1) AS dist_cum_m, round(speed_kmh, 1) AS speed_kmh, round(bearing, 1) AS bearing, coalesce(ml.road_name, '') AS road_name, coalesce(ml.osmid, '') AS osmid,
            round(road_m, 2) AS road_m, coalesce(second_road, '') AS second_road, round(margin, 3) AS margin, confidence, CASE WHEN state IS NULL THEN 'no road within the radius' ELSE '' END AS reason
            FROM ml JOIN lg ON lg.file_id = ml.file_id AND lg.leg_no = ml.leg_no""",
        ),
        "batch_status": _with(STATUS, "SELECT count(*) AS n_files, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'partial') AS n_partial, count(*) FILTER (status = 'error') AS n_error FROM sx"),
        "report_summary": _with(
            STATUS + "," + COUNTS + "," + CONF + _inspect_tail(),
            f"""SELECT file_id, CAST(file_id AS VARCHAR) AS video_id, t_first, t_last, {dur("duration_s")} AS duration, round(dist0, 1) AS distance_m, coalesce(n_original, 0) AS n_original, coalesce(n_cleaned, 0) AS n_cleaned,
            coalesce(n_simplified, 0) AS n_simplified, coalesce(n_legs, 0) AS n_legs, coalesce(n_high, 0) AS n_high, coalesce(n_medium, 0) AS n_medium, coalesce(n_low, 0) AS n_low, coalesce(n_unidentified, 0) AS n_unidentified,
            status, array_to_string(a, '; ') AS notes, CAST(NULL AS VARCHAR) AS map FROM f LEFT JOIN qs USING (file_id) LEFT JOIN cs USING (file_id) LEFT JOIN sx USING (file_id) LEFT JOIN an USING (file_id)""",
        ),
        "report_alerts": _with(
            STATUS + _inspect_tail(),
            """, al AS (SELECT file_id, 'read' AS stage, 'ALERT' AS kind, 'no times in the file' AS message, 'check the recording' AS action FROM f WHERE NOT has_time
            UNION ALL SELECT file_id, 'read', 'ERROR', 'no valid point in the file', 'the file is empty or has no valid coordinates' FROM f WHERE n_points = 0
            UNION ALL SELECT f.file_id, 'clean', 'ERROR', 'fewer than two points after cleaning', '' FROM f LEFT JOIN (SELECT file_id, count(*) AS n FROM k4 GROUP BY ALL) c USING (file_id) WHERE n_points > 0 AND coalesce(n, 0) < 2
            UNION ALL SELECT file_id, 'roads', 'ALERT', 'no road identified', 'run online or refresh the cache' FROM sx WHERE status = 'partial')
            SELECT CAST(file_id AS VARCHAR) AS file_id, stage, kind, message, action, TIMESTAMP '2026-07-01 06:00:00' AS at FROM al
            UNION ALL SELECT NULL, NULL, NULL, 'no error or alert', NULL, TIMESTAMP '2026-07-01 06:00:00' WHERE NOT EXISTS (SELECT 1 FROM al)""",
        ),
        "route_json": _with(
            STATUS + "," + COUNTS + _inspect_tail(),
            """, al AS (SELECT file_id, 'read' AS stage, 'ALERT' AS kind, 'no times in the file' AS message FROM f WHERE NOT has_time UNION ALL SELECT file_id, 'read', 'ERROR', 'no valid point in the file' FROM f WHERE n_points = 0
            UNION ALL SELECT f.file_id, 'clean', 'ERROR', 'fewer than two points after cleaning' FROM f LEFT JOIN q1 USING (file_id) WHERE n_points > 0 AND coalesce(n_cleaned, 0) < 2
            UNION ALL SELECT file_id, 'roads', 'ALERT', 'no road identified' FROM sx WHERE status = 'partial'),
            ja AS (SELECT file_id, string_agg(message, '|' ORDER BY stage, kind, message) AS alerts FROM al GROUP BY ALL),
            jl AS (SELECT file_id, string_agg(leg_no || ':' || road_name || ':' || n_points || ':' || confidence, '|' ORDER BY leg_no) AS legs, sum(round(distance_m, 1)) AS m FROM lg GROUP BY ALL)
            SELECT file_id, status, '{"spacing_m": 10}' AS settings, n_segments, n_points, duration_s, round(dist0, 1) AS distance_m, has_time, array_to_string(a, '; ') AS anomalies, n_original, n_cleaned, n_simplified,
              round(reduction_percent, 2) AS reduction_percent, coalesce(legs, '') AS legs, round(coalesce(m, 0), 1) AS legs_m, coalesce(alerts, '') AS alerts
            FROM f LEFT JOIN an USING (file_id) LEFT JOIN sx USING (file_id) LEFT JOIN qs USING (file_id) LEFT JOIN jl USING (file_id) LEFT JOIN ja USING (file_id)""",
        ),
        "map_centres": _with(SIMPLIFY, "SELECT file_id, round(coalesce(c.a, b.a, p.a), 7) AS lat, round(coalesce(c.o, b.o, p.o), 7) AS lon FROM (SELECT file_id, avg(lat) AS a, avg(lon) AS o FROM p0 GROUP BY ALL) p LEFT JOIN (SELECT file_id, avg(lat) AS a, avg(lon) AS o FROM k4 GROUP BY ALL) b USING (file_id) LEFT JOIN (SELECT file_id, avg(lat) AS a, avg(lon) AS o FROM k5 GROUP BY ALL) c USING (file_id)"),
        "gpx_files": _with(
            TRACKS,
            """, px AS (SELECT file_id, seg, pt, printf('<trkpt lat="%.5f" lon="%.5f">', lat, lon) || coalesce('<time>' || strftime(t, '%Y-%m-%dT%H:%M:%S') || 'Z</time>', '')
              || CASE WHEN pt % 2 = 0 THEN printf('<hdop>%.1f</hdop>', hdop) ELSE printf('<extensions><x:hdop>%.1f</x:hdop></extensions>', hdop) END || '</trkpt>' AS x FROM raw),
            sx AS (SELECT file_id, seg, '<trkseg>' || string_agg(x, '' ORDER BY pt) || '</trkseg>' AS x FROM px GROUP BY ALL),
            fx AS (SELECT file_id, '<gpx xmlns="http://www.topografix.com/GPX/1/1" xmlns:x="x"><trk>' || string_agg(x, '' ORDER BY seg) || '</trk></gpx>' AS whole FROM sx GROUP BY ALL),
            gx AS (SELECT file_id, CASE WHEN file_id % 7 = 3 THEN substr(whole, 1, 200) ELSE whole END AS xml FROM fx)
            SELECT file_id || '.gpx' AS name, length(xml) AS bytes, sha256(xml) AS file_hash, file_id % 7 = 3 AS broken FROM gx""",
        ),
        "gpx_points": _with(TRACKS, "SELECT file_id, trk, seg, pt % 50 AS pt, round(lat, 5) AS lat, round(lon, 5) AS lon, t, hdop FROM raw WHERE file_id % 7 <> 3"),
        "graphml_edges": _with(
            ROADS,
            """SELECT u, v, CASE WHEN u % 3 = 0 THEN 't2' ELSE 't1' END AS tile_id, CASE WHEN u % 2 = 0 THEN nm || '/other' ELSE nm END AS name, hw || CASE WHEN u % 3 = 0 THEN '_t2' ELSE '_t1' END AS highway,
            round(ulon, 5) AS lon_a, round(ulat, 5) AS lat_a, round(vlon, 5) AS lon_b, round(vlat, 5) AS lat_b FROM l3""",
        ),
        "map_layers": _with(
            LEGS,
            """SELECT *, CASE WHEN layer = 'legs' THEN CASE confidence WHEN 'unidentified' THEN 'no candidate road within the radius'
              ELSE (SELECT coalesce(nullif(string_split(notes, ' | ')[-1], ''), confidence) FROM lg WHERE lg.file_id = z.file_id AND lg.leg_no = z.ord) END ELSE '' END AS last_info
            FROM (SELECT file_id, 'original' AS layer, 0::BIGINT AS ord, 'line' AS kind, '' AS name, '' AS confidence, count(*) AS n FROM p0 GROUP BY ALL
            UNION ALL SELECT file_id, 'cleaned', 0, 'line', '', '', count(*) FROM k4 GROUP BY ALL UNION ALL SELECT file_id, 'simplified', 0, 'line', '', '', count(*) FROM k5 GROUP BY ALL
            UNION ALL SELECT file_id, 'fitted', 0, 'line', '', '', count(*) FROM k5 GROUP BY ALL UNION ALL SELECT file_id, 'legs', leg_no, 'line', road_name, confidence, n_points FROM lg) z WHERE n >= 2
            UNION ALL SELECT file_id, 'problems', idx, 'point', 'no road within the radius', '', 1, '' FROM mt WHERE state IS NULL""",
        ),
    }
    return d
