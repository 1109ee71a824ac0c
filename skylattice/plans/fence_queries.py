"""Queries over fences as polygons, grown fences, flight plans, upserts at size, signatures, geometry values and layouts, each with its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice import runtime
from skylattice.functions import wkb
from skylattice.operators import buffer, fences, flight, signatures, zones
from skylattice.plans import derived
from skylattice.plans.derived import BOUNDS, FINE, SQL_EVENTS, SQL_POI, SQL_RING, SQL_ZONES, sql_grid
from skylattice.plans.geo_queries import ORACLES, query
from skylattice.plans.geo_queries import _records as zone_records
from skylattice.sources import layout, merge

# Fences against fences

#: New fences: pentagons, every other one with a square hole large enough to hold small zones.
_CORNERS = ((0.0, 0.0), (0.9, -0.2), (1.2, 0.5), (0.5, 0.9), (-0.2, 0.6), (0.0, 0.0))
_HOLE = ((0.15, 0.15), (0.75, 0.15), (0.75, 0.65), (0.15, 0.65), (0.15, 0.15))
_NEW = "c_custkey AS new_id, CAST(c_custkey%3+1 AS INT) AS fence_type, 112.5e0+(c_custkey%53)/1e1 AS x, 31e0+(c_custkey%41)/1e1 AS y"


def new_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = runtime.table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").selectExpr(*_NEW.split(", "))
    ring = lambda corners: F.array(*[F.array(F.col("x") + dx, F.col("y") + dy) for dx, dy in corners])
    polygons = F.when(F.col("new_id") % 20 == 0, F.array(F.array(ring(_CORNERS), ring(_HOLE)))).otherwise(F.array(F.array(ring(_CORNERS))))
    return made.select("new_id", "fence_type", polygons.alias("polygons"))


def _sql_values(corners: tuple) -> str:
    return ", ".join(f"({i}, {a!r}e0, {b!r}e0, {c!r}e0, {d!r}e0)" for i, ((a, b), (c, d)) in enumerate(zip(corners, corners[1:])))


_SQL_NEW = f"""new AS (SELECT {_NEW} FROM customer WHERE c_custkey%10=0),
    piece AS (SELECT new_id, fence_type, x+a AS x1, y+b AS y1, x+c AS x2, y+d AS y2 FROM new, (VALUES {_sql_values(_CORNERS)}) AS t(i, a, b, c, d)
      UNION ALL SELECT new_id, fence_type, x+a, y+b, x+c, y+d FROM new, (VALUES {_sql_values(_HOLE)}) AS t(i, a, b, c, d) WHERE new_id%20=0)"""
_SIDE = "(({a}.x2-{a}.x1)*({b}.{y}-{a}.y1)-({a}.y2-{a}.y1)*({b}.{x}-{a}.x1))"
_TOUCH = "least(p.x1,p.x2)<=greatest(e.x1,e.x2) AND greatest(p.x1,p.x2)>=least(e.x1,e.x2) AND least(p.y1,p.y2)<=greatest(e.y1,e.y2) AND greatest(p.y1,p.y2)>=least(e.y1,e.y2) AND " + " AND ".join(
    _SIDE.format(a=a, b=b, x="x1", y="y1") + "*" + _SIDE.format(a=a, b=b, x="x2", y="y2") + "<=0" for a, b in (("p", "e"), ("e", "p"))
)
_CUTS = "(({e}.y1>{y})<>({e}.y2>{y})) AND {x}<({e}.x2-{e}.x1)*({y}-{e}.y1)/nullif({e}.y2-{e}.y1, 0e0)+{e}.x1"
_SQL_SHARED = f"""shared AS (SELECT DISTINCT new_id, e.area_id FROM piece p, edge e WHERE {_TOUCH}
    UNION SELECT new_id, area_id FROM new, edge e WHERE {_CUTS.format(e='e', x='new.x', y='new.y')} GROUP BY ALL HAVING count(*)%2=1
    UNION SELECT new_id, area_id FROM piece p, (SELECT * FROM ring WHERE i=0) c WHERE {_CUTS.format(e='p', x='c.x', y='c.y')} GROUP BY ALL HAVING count(*)%2=1)"""


@query(f"""WITH {SQL_RING}, {_SQL_NEW}, {_SQL_SHARED}
    SELECT new_id, area_id FROM shared JOIN new USING (new_id) JOIN box USING (area_id) WHERE new.fence_type=2 AND box.fence_type=1 OR new.fence_type=3 AND box.fence_type IN (1, 2)""")
def fence_polygon_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New fences, some with holes, that share a point with fences they must not meet."""
    return fences.polygon_conflicts(new_fences(spark, sf_dir), derived.fences(spark, sf_dir))


@query(f"WITH {SQL_RING}, {_SQL_NEW}, {_SQL_SHARED} SELECT new_id AS project_id, area_id, fence_type FROM shared JOIN box USING (area_id) WHERE fence_type IN (1, 3)")
def fence_project_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No-fly and trial fences that share a point with a project's area."""
    areas = new_fences(spark, sf_dir).select(F.col("new_id").alias("project_id"), "polygons")
    return fences.polygons_of_project(derived.fences(spark, sf_dir), areas).select("project_id", "area_id", "fence_type")

# Grown fences

_GROW, _QUARTER = 2_000.0, 64
_CHORDS = -(-10 * _QUARTER // 90)  # of an arc of 10 degrees, at each of the 36 corners of a zone
_NEAR = "greatest(0e0, least(1e0, ((lng-x1)*s*(x2-x1)*s+(lat-y1)*(y2-y1))/(power((x2-x1)*s,2)+power(y2-y1,2))))"


@query(f"""WITH {SQL_RING}, {SQL_POI}, m AS (SELECT e.*, cos(radians((lat_min+lat_max)/2)) AS s, (lng_min+lng_max)/2 AS x0, (lat_min+lat_max)/2 AS y0 FROM edge e JOIN box USING (area_id)),
    whole AS (SELECT area_id, sum(((x1-x0)*(y2-y0)-(x2-x0)*(y1-y0))*s)/2*111000e0*111000e0 AS area, sum(sqrt(power((x2-x1)*s,2)+power(y2-y1,2)))*111000e0 AS length FROM m GROUP BY area_id),
    away AS (SELECT area_id, poi_id, sqrt(power((lng-x1-{_NEAR}*(x2-x1))*s,2)+power(lat-y1-{_NEAR}*(y2-y1),2))*111000e0 AS d, ((y1>lat)<>(y2>lat)) AND lng<(x2-x1)*(lat-y1)/nullif(y2-y1, 0e0)+x1 AS cuts FROM m, poi),
    near AS (SELECT area_id, count(*) AS n FROM (SELECT area_id FROM away GROUP BY area_id, poi_id HAVING min(d)<={_GROW!r}e0 OR count_if(cuts)%2=1) GROUP BY area_id)
    SELECT area_id, round((area+length*{_GROW!r}e0+36*{_CHORDS}*power({_GROW!r}e0,2)*sin(radians(10e0/{_CHORDS}))/2)/1e4) AS hectares, coalesce(n, 0) AS n_points,
      greatest(0e0, (area_id%5)*1e3-{_GROW!r}e0) AS low_m, (area_id%5)*1e3+{_GROW!r}e0+500e0 AS high_m FROM whole LEFT JOIN near USING (area_id)""")
def fence_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fence grown by 2 km: its area, the points in it, and its heights."""
    low = (F.col("area_id") % 5) * 1e3
    there = runtime.written(buffer.grown_solid(derived.fences(spark, sf_dir), _GROW, low, low + 500, _QUARTER), "grown")
    found = fences.counted_in_fences(derived.poi(spark, sf_dir), there)
    return found.select("area_id", F.round(F.col("area_m2") / 1e4).alias("hectares"), "n_points", "low_m", "high_m")


# Flight plans

#: Nodes 50 km apart in three layers; a smooth plan climbs one degree at most, so a climb takes two cells.
LATTICE = flight.Lattice(BOUNDS, FINE, [100.0, 1600.0, 3100.0], True, 1.0)
_HEIGHT = "1000e0+(area_id%4)*800e0"
_REACH, _SEARCH = 32, 3


def heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fences that plans keep out of (no-fly and controlled), with heights."""
    return derived.fences(spark, sf_dir).where("fence_type IN (1, 2)").select("area_id", "polygons", F.expr(_HEIGHT).alias("height"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan from end to end of each route, and one that begins far outside."""
    asked = runtime.table(spark, sf_dir, "nation").selectExpr(*derived.ROUTES.split(", "))
    far = F.when(F.col("route_id") % 10 == 9, F.col("y1") - 20).otherwise(F.col("y1"))
    return asked.select("route_id", far.alias("lat"), F.col("x1").alias("lng"), F.lit(50.0).alias("alt"), F.col("y2").alias("lat2"), F.col("x2").alias("lng2"), F.lit(50.0).alias("alt2"))


def _flat(a: str, b: str) -> str:
    return f"sqrt(power(({b}.lat-{a}.lat)*111000e0,2)+power(({b}.lng-{a}.lng)*111000e0*cos(radians(({a}.lat+{b}.lat)/2)),2))"


def _sql_cut(lines: str, key: str, name: str) -> str:
    """`name`: keys of lines (x1, y1, x2, y2, low) that a fence higher than low touches or holds the beginning of."""
    return f"""{name} AS MATERIALIZED (SELECT DISTINCT {key} FROM {lines} p, wall e WHERE height>low AND {_TOUCH}
      UNION SELECT {key} FROM (SELECT {key}, e.area_id FROM {lines} p, wall e WHERE height>low AND {_CUTS.format(e='e', x='p.x1', y='p.y1')} GROUP BY ALL HAVING count(*)%2=1))"""


def _sql_near(lat: str, lng: str, alt: str) -> str:
    south, north, west, east = BOUNDS
    place = f"(SELECT route_id, {lat} AS lat, {lng} AS lng, {alt} AS alt FROM asked)"
    return f"""SELECT p.route_id, min(row(CAST(round(sqrt(power({_flat('p', 'q')},2)+power(q.alt-p.alt,2))*1000) AS BIGINT), node)) AS m
      FROM {place} p, grid_n, free q WHERE abs(q.i-floor(({north}e0-p.lat)/(({north}e0-{south}e0)/nl)))<={_SEARCH} AND abs(q.j-floor((p.lng-{west}e0)/(({east}e0-{west}e0)/ng)))<={_SEARCH} GROUP BY p.route_id"""


_FOLLOWS = "({b}.h=-9 OR (abs((({a}.h-{b}.h+4)%8+8)%8-4)<=1 AND {a}.v*{b}.v>=0))"
_SQL_LATTICE = f"""{SQL_RING}, {sql_grid(FINE)},
    wall AS MATERIALIZED (SELECT edge.*, {_HEIGHT} AS height FROM edge WHERE area_id%3+1 IN (1, 2)),
    held AS (SELECT idx, max(height) AS top FROM (SELECT idx, area_id, height FROM grid p, wall e WHERE {_CUTS.format(e='e', x='p.lng', y='p.lat')} GROUP BY ALL HAVING count(*)%2=1) GROUP BY idx),
    free AS MATERIALIZED (SELECT (idx-1)*{len(LATTICE.altitudes)}+k AS node, (idx-1)//ng AS i, (idx-1)%ng AS j, k, lat, lng, alt
      FROM grid LEFT JOIN held USING (idx), grid_n, (VALUES {', '.join(f'({k}, {a!r}e0)' for k, a in enumerate(LATTICE.altitudes))}) AS t(k, alt) WHERE top IS NULL OR alt>=top),
    moved AS MATERIALIZED (SELECT p.node AS a, q.node AS b, h, v, p.lng AS x1, p.lat AS y1, q.lng AS x2, q.lat AS y2, least(p.alt, q.alt) AS low, CAST(round(sqrt(power({_flat('p', 'q')},2)+power(q.alt-p.alt,2))*1000) AS BIGINT) AS mm
      FROM free p JOIN (VALUES {', '.join(map(str, LATTICE.moves()))}) AS t(k, h, v, di, dj, dk) USING (k) JOIN free q ON q.i=p.i+di AND q.j=p.j+dj AND q.k=p.k+dk),
    {_sql_cut('moved', 'a, b', 'cut')},
    link AS MATERIALIZED (SELECT a, b, h, v, mm FROM moved ANTI JOIN cut USING (a, b))"""
_SQL_WAYS = f"""asked AS (SELECT route_id, CASE WHEN route_id%10=9 THEN y1-20 ELSE y1 END AS lat, x1 AS lng, 50e0 AS alt, y2 AS lat2, x2 AS lng2, 50e0 AS alt2 FROM (SELECT {derived.ROUTES} FROM nation)),
    ends AS MATERIALIZED (SELECT a.route_id, a.m[2] AS first, b.m[2] AS last FROM ({_sql_near('lat', 'lng', 'alt')}) a JOIN ({_sql_near('lat2', 'lng2', 'alt2')}) b USING (route_id)),
    d(route_id, node, h, v, mm) USING KEY (route_id, node, h, v) AS (SELECT route_id, first, -9, -9, CAST(0 AS BIGINT) FROM ends
      UNION SELECT n.* FROM (SELECT d.route_id, l.b AS node, l.h, l.v, min(d.mm+l.mm) AS mm FROM d JOIN link l ON l.a=d.node AND {_FOLLOWS.format(a='l', b='d')} GROUP BY ALL) n
        LEFT JOIN recurring.d AS o ON o.route_id=n.route_id AND o.node=n.node AND o.h=n.h AND o.v=n.v WHERE o.mm IS NULL OR n.mm<o.mm),
    state AS MATERIALIZED (SELECT * FROM d),
    prev AS MATERIALIZED (SELECT s.route_id, s.node, s.h, s.v, min(row(p.node, p.h, p.v)) AS m FROM state p JOIN link l ON l.a=p.node AND {_FOLLOWS.format(a='l', b='p')}
      JOIN state s ON s.route_id=p.route_id AND s.node=l.b AND s.h=l.h AND s.v=l.v AND s.mm=p.mm+l.mm GROUP BY ALL),
    back(route_id, node, h, v, pos) AS (SELECT route_id, m[2], m[3], m[4], 0 FROM (SELECT s.route_id, min(row(mm, node, h, v)) AS m FROM state s JOIN ends ON ends.route_id=s.route_id AND last=node GROUP BY s.route_id)
      UNION ALL SELECT b.route_id, m[1], m[2], m[3], pos+1 FROM back b JOIN prev p ON p.route_id=b.route_id AND p.node=b.node AND p.h=b.h AND p.v=b.v),
    way AS MATERIALIZED (SELECT route_id, max(pos) OVER (PARTITION BY route_id)-pos AS step, lat, lng, alt FROM back JOIN free USING (node))"""
_SQL_PULLED = f"""pair AS MATERIALIZED (SELECT a.route_id, a.step, b.step AS dest, a.lng AS x1, a.lat AS y1, b.lng AS x2, b.lat AS y2, least(a.alt, b.alt) AS low, abs(a.alt-b.alt)<={LATTICE.tan * (1 + 1e-9)!r}*{_flat('a', 'b')} AS flat
      FROM way a JOIN way b ON a.route_id=b.route_id AND b.step BETWEEN a.step+1 AND a.step+{_REACH}),
    {_sql_cut('pair', 'route_id, step, dest', 'hidden')},
    onward AS MATERIALIZED (SELECT route_id, step, max(dest) AS dest FROM (SELECT route_id, step, dest FROM pair WHERE dest=step+1 UNION ALL SELECT route_id, step, dest FROM pair ANTI JOIN hidden USING (route_id, step, dest) WHERE flat) GROUP BY ALL),
    stay(route_id, step) AS (SELECT route_id, step FROM way WHERE step=0 UNION ALL SELECT s.route_id, dest FROM stay s JOIN onward o ON o.route_id=s.route_id AND o.step=s.step),
    point AS (SELECT way.* FROM way JOIN stay USING (route_id, step) UNION ALL SELECT route_id, -1, lat, lng, alt FROM asked UNION ALL SELECT route_id, 1000000, lat2, lng2, alt2 FROM asked)"""


@query(f"""WITH RECURSIVE {_SQL_LATTICE}, {_SQL_WAYS}, {_SQL_PULLED}
    SELECT route_id, row_number() OVER (PARTITION BY route_id ORDER BY step)-1 AS step, round(lat, 6) AS lat, round(lng, 6) AS lng, alt, route_id IN (SELECT route_id FROM way) AS found FROM point""")
def flight_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smooth plans of all routes over BOUNDS in three layers, around fences with heights, pulled straight."""
    made = flight.plans(spark, requests(spark, sf_dir), LATTICE, heights(spark, sf_dir), _SEARCH, _REACH)
    return made.select("route_id", "step", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "alt", "found")


# Upserts at size


@query(f"""WITH {SQL_EVENTS}, w AS (SELECT *, k IS NOT NULL AND k<>'' AS whole FROM ev)
    SELECT event_id, k, round(value, 6) AS value FROM w WHERE NOT whole
    UNION ALL SELECT event_id, k, round(value, 6) FROM (SELECT * FROM w WHERE whole QUALIFY row_number() OVER (PARTITION BY k ORDER BY CASE event_id%4 WHEN 0 THEN 1 ELSE 0 END DESC, event_id DESC)=1)""")
def upsert_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three quarters of the events by key as a table, then the rest put in or over them: only the parts that they touch are rewritten."""
    events = derived.events(spark, sf_dir).select("event_id", "k", "value")
    kept = merge.KeyedTable(spark, f"{runtime.shared_dir(spark)}/skylattice/events-{uuid.uuid4().hex}", ["k"], "event_id", parts=16)
    kept.create(events.where("event_id % 4 <> 0"))
    kept.upsert(events.where("event_id % 4 = 0"))
    return kept.read().select("event_id", "k", F.round("value", 6).alias("value"))


# Signatures of routines

_ARGS = (
    "", "p_id int4 DEFAULT 0, VARIADIC names varchar(20)[]", "IN a numeric(10,2) = 3.5, OUT b text, INOUT c timestamp(3) with time zone", "a text DEFAULT 'x, y (z'::text, b date DEFAULT now()",
    '"My, name" my_type, double precision', "a int8[][], b bool",
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_types(args: str) -> str:
    """argument_types() in DuckDB's words."""
    s = signatures
    flat = f"regexp_replace(regexp_replace({args}, {_quoted(s.LITERAL)}, '''''', 'g'), {_quoted(s.QUOTED)}, 'q', 'g')"
    flat = f"lower({flat})"
    for _ in range(s.DEPTH):
        flat = f"regexp_replace({flat}, {_quoted(s.BRACKETS)}, '', 'g')"
    known = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in s.TYPES.items()) + "}"
    words = f"regexp_replace(trim(regexp_replace(trim(regexp_replace(a, '\\s+', ' ', 'g')), {_quoted(s.DEFAULT)}, '')), {_quoted(s.MODE)}, '')"
    bare = f"trim(regexp_replace({words}, {_quoted(s.ARRAY)}, ''))"
    bare_kind = f"coalesce({known}[{bare}], {known}[regexp_replace({bare}, '^\\S+\\s+', '')], regexp_replace({bare}, '^\\S+\\s+', ''))"
    one = f"{bare_kind} || CASE WHEN regexp_matches({words}, {_quoted(s.ARRAY)}) THEN '[]' ELSE '' END"
    return f"list_transform(list_filter(string_split({flat}, ','), lambda a: trim(a)<>'' AND NOT regexp_matches(trim(a), '^out\\s')), lambda a: {one})"


_SQL_ARGS = "CASE p_partkey%6 " + " ".join(f"WHEN {i} THEN {_quoted(a)}" for i, a in enumerate(_ARGS)) + " END"
_SPARK_ARGS = "CASE p_partkey%6 " + " ".join("WHEN {} THEN '{}'".format(i, a.replace("\\", "\\\\").replace("'", "\\'")) for i, a in enumerate(_ARGS)) + " END"


@query(f"WITH t AS (SELECT p_partkey AS routine_id, 'f'||(p_partkey%50) AS name, {_SQL_ARGS} AS args FROM part) SELECT routine_id, name||'('||array_to_string({_sql_types('args')}, ', ')||')' AS signature FROM t")
def routine_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Argument lists as databases print them, as signatures."""
    routines = runtime.table(spark, sf_dir, "part").selectExpr("p_partkey AS routine_id", "concat('f', p_partkey % 50) AS name", f"{_SPARK_ARGS} AS args")
    return routines.select("routine_id", signatures.signature(F.col("name"), F.col("args")).alias("signature"))


_OVERLOADS = ("a int4", "a int8 DEFAULT 0", "double precision", "x text", "varchar, b text", "text, varchar(9)")
_PASSED = (("smallint",), ("integer",), ("numeric",), ("character",), ("date",), ("character", "character"), ("text", "character varying"), ())
_COSTS = " ".join(f"WHEN p='{a}' AND t='{b}' THEN {j - i}" for group in signatures.WIDENING for i, a in enumerate(group) for j, b in enumerate(group) if i < j)


@query(f"""WITH routine AS (SELECT n_regionkey AS r, a AS args, {_sql_types('a')} AS types FROM (SELECT DISTINCT n_regionkey FROM nation), (VALUES {', '.join(f'({_quoted(a)})' for a in _OVERLOADS)}) AS t(a)),
    call AS (SELECT c_custkey AS call_id, c_nationkey%5 AS r, CASE c_custkey%8 {' '.join(f'WHEN {i} THEN {list(p)!r}::VARCHAR[]' for i, p in enumerate(_PASSED))} END AS passed FROM customer),
    tried AS (SELECT call_id, args, list_transform(list_zip(passed, types), lambda z: z) AS z FROM call JOIN routine USING (r) WHERE len(passed)=len(types)),
    fit AS (SELECT call_id, args, sum(c) AS cost FROM (SELECT call_id, args, CASE WHEN p=t THEN 0 {_COSTS} END AS c FROM (SELECT call_id, args, unnest(z)[1] AS p, unnest(z)[2] AS t FROM tried)) GROUP BY ALL HAVING count(*)=count(c)),
    best AS (SELECT call_id, min(args) AS args FROM (SELECT *, min(cost) OVER (PARTITION BY call_id) AS least FROM fit) WHERE cost=least GROUP BY call_id HAVING count(*)=1)
    SELECT call_id, args FROM call LEFT JOIN best USING (call_id)""")
def overload_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by types and the overload that each means, if there is one."""
    schemas = runtime.table(spark, sf_dir, "nation").selectExpr("CAST(n_regionkey AS STRING) AS schema").distinct()
    routines = schemas.select("schema", F.lit("f").alias("name"), F.explode(F.array(*[F.lit(a) for a in _OVERLOADS])).alias("args"))
    passed = F.lit(None).cast("array<string>")
    for i, p in enumerate(_PASSED):
        passed = F.when(F.col("c_custkey") % 8 == i, F.array(*[F.lit(t) for t in p]).cast("array<string>")).otherwise(passed)
    calls = runtime.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("call_id"), (F.col("c_nationkey") % 5).cast("string").alias("schema"), F.lit("f").alias("name"), passed.alias("passed"))
    return signatures.resolved(calls, routines).select("call_id", "args")


# Geometry values and layouts

_BOXES = "n_nationkey AS box_id, 112.5e0+(n_nationkey%25)/5e0 AS lng_min, 113.1e0+(n_nationkey%25)/5e0 AS lng_max, 31e0+(n_nationkey%7)/2e0 AS lat_min, 31.6e0+(n_nationkey%7)/2e0 AS lat_max"


@query(f"""SELECT area_id, 'SRID=4326;'||geom AS geom, '0106000020E6100000' AS head, 13+CASE WHEN geom LIKE '%)),((%' THEN 2 ELSE 1 END*13+16*(length(geom)-length(replace(geom, ' ', ''))) AS n_bytes
    FROM ({ORACLES['zone_wkt']}) WHERE geom IS NOT NULL""")
def zone_geometry_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every zone's WKT read, written as extended WKB, read again and written as WKT."""
    rows = zones.table_rows(zones.features(zone_records(spark, sf_dir))).where("geom IS NOT NULL").select("area_id", wkb.from_wkt(F.concat(F.lit("SRID=4326;"), F.col("geom"))).alias("g"))
    packed = rows.select("area_id", wkb.to_wkb("g").alias("b"))
    back = packed.select("area_id", "b", wkb.from_wkb("b").alias("g"))
    return back.select("area_id", wkb.to_wkt(F.col("g")).alias("geom"), F.hex(F.substring("b", 1, 9)).alias("head"), F.octet_length("b").cast("long").alias("n_bytes"))


@query(f"WITH {SQL_POI}, b AS (SELECT {_BOXES} FROM nation) SELECT box_id, poi_id FROM poi JOIN b ON lng BETWEEN lng_min AND lng_max AND lat BETWEEN lat_min AND lat_max")
def points_by_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points laid out along the curve, and those in boxes found by opening the files that the boxes meet."""
    path = f"{runtime.shared_dir(spark)}/skylattice/points-{uuid.uuid4().hex}"
    layout.save(derived.poi(spark, sf_dir), path, BOUNDS, 32)
    boxes = runtime.table(spark, sf_dir, "nation").selectExpr(*_BOXES.split(", "))
    return layout.in_boxes(spark, path, boxes).select("box_id", "poi_id")


_CITY = "CASE area_id%4 WHEN 0 THEN n_name WHEN 1 THEN n_name||' CITY' WHEN 2 THEN 'NOWHERE' END"


@query(f"""WITH {SQL_ZONES}, z AS (SELECT area_id, {_CITY} AS city FROM zones JOIN nation ON n_nationkey=area_id%25),
    near AS (SELECT area_id, n_nationkey FROM z JOIN nation ON city=n_name OR starts_with(city, left(n_name, length(n_name)-1)) QUALIFY row_number() OVER (PARTITION BY area_id ORDER BY city<>n_name, -length(n_name), n_name)=1)
    SELECT area_id, city, CAST(n_nationkey AS VARCHAR) AS shicode FROM z LEFT JOIN near USING (area_id)""")
def zone_region_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones with the codes of their cities from a table, by name or its beginning."""
    nation = runtime.table(spark, sf_dir, "nation")
    own = derived.zones(spark, sf_dir).join(nation, F.col("area_id") % 25 == F.col("n_nationkey")).selectExpr("area_id", f"{_CITY} AS city", "CAST(NULL AS STRING) AS shicode")
    return zones.with_lookup(own, nation.selectExpr("n_name AS name", "n_nationkey AS shicode"))
