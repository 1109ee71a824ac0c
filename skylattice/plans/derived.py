"""Geodata derived from the driver tables by rule: the same expressions in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice import runtime
from skylattice.functions.geo import Bounds, circle_ring, envelope

BOUNDS = Bounds(31.4, 36.4, 110.4, 116.7)
CELL = 200_000.0
FINE = 50_000.0

POINT = "110e0 + (({k}*37)%670)/1e2 AS lng, 31.4e0 + (({k}*53)%500)/1e2 AS lat"
POI = "c_custkey AS poi_id, c_name AS name, c_mktsegment AS type_code, c_nationkey AS nation, " + POINT.format(k="c_custkey")
ZONES = "s_suppkey AS area_id, s_name AS name, 113e0+(s_suppkey%50)/1e1 AS lng, 31e0+(s_suppkey%37)/1e1 AS lat, 5000e0+(s_suppkey%40)*500e0 AS radius, CAST(s_suppkey%3 AS INT) AS shape, CAST(s_suppkey%11 AS INT) AS level"
ROUTES = "n_nationkey AS route_id, 110e0+((n_nationkey*37)%67)/1e1 AS x1, 31.4e0+((n_nationkey*53)%50)/1e1 AS y1, 110e0+((n_nationkey*29+31)%67)/1e1 AS x2, 31.4e0+((n_nationkey*17+23)%50)/1e1 AS y2"
#: Keys of events: some missing, some empty.
EVENTS = "event_id, ts, CASE WHEN event_id%11=0 THEN NULL WHEN event_id%13=0 THEN '' ELSE CAST(user_id AS {text}) END AS k, value"
SIDES = "lat_min, lat_max, lng_min, lng_max"


def poi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.table(spark, sf_dir, "customer").selectExpr(*POI.split(", "))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.table(spark, sf_dir, "supplier").selectExpr(*ZONES.split(", "))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.table(spark, sf_dir, "events").selectExpr(*EVENTS.format(text="STRING").split(", "))


def fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every zone as a circle: area_id, fence_type, polygons, sides."""
    ring = zones(spark, sf_dir).withColumn("ring", circle_ring(F.col("lat"), F.col("lng"), F.col("radius")))
    return ring.select("area_id", (F.col("area_id") % 3 + 1).cast("int").alias("fence_type"), F.array(F.array("ring")).alias("polygons"), *envelope(F.col("ring")))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """route_id and a line of three points: two ends and a bend."""
    ends = runtime.table(spark, sf_dir, "nation").selectExpr(*ROUTES.split(", "))
    bend = F.array((F.col("x1") + F.col("x2")) / 2 + 0.3, (F.col("y1") + F.col("y2")) / 2)
    return ends.select("route_id", F.array(F.array("x1", "y1"), bend, F.array("x2", "y2")).alias("line"))


def sql_grid(cell: float, b: Bounds = BOUNDS, name: str = "grid") -> str:
    """CTEs for grid(): `name`(idx, lat, lng)."""
    south, north, west, east = (f"{x!r}e0" for x in b)
    km = f"{cell / 1000!r}e0"
    return f"""{name}_n AS (SELECT CAST(floor(({north}-{south})*111e0/{km})+1 AS BIGINT) AS nl, CAST(floor(({east}-{west})*111e0*abs(cos(radians(({south}+{north})/2)))/{km})+1 AS BIGINT) AS ng),
    {name} AS (SELECT i*ng+j+1 AS idx, {north}-i*(({north}-{south})/nl)-(({north}-{south})/nl)/2 AS lat, {west}+j*(({east}-{west})/ng)+(({east}-{west})/ng)/2 AS lng
      FROM {name}_n, unnest(range(nl)) AS a(i), unnest(range(ng)) AS b(j))"""


def sql_cells(cell: float, b: Bounds = BOUNDS) -> str:
    """CTEs for pipelines.cells(): cells(idx, sides)."""
    r = f"{cell / 2 / 1000!r}e0"
    return sql_grid(cell, b) + f""",
    cells AS (SELECT idx, lat-{r}/111e0 AS lat_min, lat+{r}/111e0 AS lat_max, lng-{r}/(111e0*abs(cos(radians(lat)))) AS lng_min, lng+{r}/(111e0*abs(cos(radians(lat)))) AS lng_max FROM grid)"""


SQL_POI = f"poi AS (SELECT {POI} FROM customer)"
SQL_ZONES = f"zones AS (SELECT {ZONES} FROM supplier)"
SQL_EVENTS = f"ev AS (SELECT {EVENTS.format(text='VARCHAR')} FROM events)"
SQL_RING = SQL_ZONES + """,
    ring AS (SELECT area_id, i, lng+(radius/111000e0)*cos((i%36)*(2*pi()/36))/cos(radians(lat)) AS x, lat+(radius/111000e0)*sin((i%36)*(2*pi()/36)) AS y FROM zones, range(37) AS t(i)),
    edge AS (SELECT a.area_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM ring a JOIN ring b ON a.area_id=b.area_id AND b.i=a.i+1),
    box AS (SELECT area_id, CAST(area_id%3+1 AS INT) AS fence_type, min(y) AS lat_min, max(y) AS lat_max, min(x) AS lng_min, max(x) AS lng_max FROM ring GROUP BY ALL)"""
SQL_HITS = "hits AS (SELECT poi.*, idx FROM poi JOIN cells ON lat BETWEEN lat_min AND lat_max AND lng BETWEEN lng_min AND lng_max)"
SQL_FIRST = "firsts AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY poi_id ORDER BY idx)=1)"
SQL_ROUTES = f"""ends AS (SELECT {ROUTES} FROM nation),
    leg AS (SELECT route_id, x1, y1, (x1+x2)/2+0.3e0 AS x2, (y1+y2)/2 AS y2 FROM ends UNION ALL SELECT route_id, (x1+x2)/2+0.3e0, (y1+y2)/2, x2, y2 FROM ends)"""
