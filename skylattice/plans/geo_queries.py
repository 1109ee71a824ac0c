"""Queries over geodata derived from the driver tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice import runtime
from skylattice.functions import geo, values
from skylattice.operators import catalog, dedupe, fences, overlap, poi, regions, requests, route, schedule, spatial_join, type_tree, zones
from skylattice.plans import derived, pipelines
from skylattice.plans.derived import BOUNDS, CELL, FINE, SQL_EVENTS, SQL_FIRST, SQL_HITS, SQL_POI, SQL_RING, SQL_ROUTES, SQL_ZONES, sql_cells, sql_grid
from skylattice.sources import dimensions, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable], Callable]:
    """Register a query under its function's name, with its SQL."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def sql_rounded(columns: str, places: int = 6) -> str:
    return ", ".join(f"round({c}, {places}) AS {c}" for c in columns.split(", "))


# Grid and request plans


@query(f"""WITH {SQL_POI}, {sql_cells(CELL)}, {SQL_HITS}, {SQL_FIRST}
    SELECT type_code, count(*) AS n, round(count(*)*100e0/sum(count(*)) OVER (), 1) AS percentage FROM firsts GROUP BY type_code""")
def region_grid_poi_type_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, grid, squares, containment, first hit of each point, types with shares."""
    return pipelines.region_type_stats(derived.poi(spark, sf_dir), BOUNDS, CELL)


@query(f"WITH {sql_grid(FINE)} SELECT idx, {sql_rounded('lat, lng')} FROM grid")
def grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(geo.grid(spark, BOUNDS, FINE), "lat", "lng")


@query("""WITH b AS (SELECT n_regionkey AS region, 20e0+n_regionkey*3 AS lat_min, 22e0+n_regionkey*3.5 AS lat_max, 100e0+n_regionkey AS lng_min, 103e0+n_regionkey*1.5 AS lng_max FROM nation GROUP BY n_regionkey),
    n AS (SELECT *, CAST(floor((lat_max-lat_min)*111e0/100e0)+1 AS BIGINT) AS nl, CAST(floor((lng_max-lng_min)*111e0*abs(cos(radians((lat_min+lat_max)/2)))/100e0)+1 AS BIGINT) AS ng FROM b)
    SELECT region, i*ng+j+1 AS idx, round(lat_max-i*((lat_max-lat_min)/nl)-((lat_max-lat_min)/nl)/2, 6) AS lat, round(lng_min+j*((lng_max-lng_min)/ng)+((lng_max-lng_min)/ng)/2, 6) AS lng
    FROM n, unnest(range(nl)) AS x(i), unnest(range(ng)) AS y(j)""")
def grids_of_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid for every row of a table of regions."""
    box = [F.lit(20.0) + F.col("region") * 3, F.lit(22.0) + F.col("region") * 3.5, F.lit(100.0) + F.col("region"), F.lit(103.0) + F.col("region") * 1.5]
    named = [c.alias(n) for c, n in zip(box, regions.SIDES)]
    table = runtime.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region")).distinct().select("region", *named)
    return rounded(geo.grids(table, F.lit(100_000.0)), "lat", "lng").select("region", "idx", "lat", "lng")


@query(f"WITH {sql_cells(CELL)} SELECT idx, {sql_rounded(derived.SIDES)} FROM cells")
def cell_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pipelines.cells(spark, BOUNDS, CELL), *regions.SIDES)


def _d(c: str) -> str:
    return f"CAST(CAST({c} AS DECIMAL(18,6)) AS VARCHAR)"


@query(f"""WITH {sql_cells(CELL)}, t AS (SELECT idx, {_d('lat_min')} AS s, {_d('lat_max')} AS n, {_d('lng_min')} AS w, {_d('lng_max')} AS e FROM cells)
    SELECT idx, w||','||s||','||e||','||n AS map_bound, w||','||n||'|'||e||','||s AS corners, w||','||n||','||e||','||n||','||e||','||s||','||w||','||s||','||w||','||n AS polygon FROM t""")
def cell_request_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    squares = pipelines.cells(spark, BOUNDS, CELL)
    return squares.select("idx", geo.map_bound(text=geo.fixed).alias("map_bound"), geo.corner_pair(geo.fixed).alias("corners"), geo.closed_polygon(geo.fixed).alias("polygon"))


@query(f"""WITH {sql_cells(CELL)}, t AS (SELECT idx, {_d('lat_min')} AS s, {_d('lat_max')} AS n, {_d('lng_min')} AS w, {_d('lng_max')} AS e FROM cells)
    SELECT idx, r_regionkey AS kw,
      '{{"queryType":"2",'||k||'"mapBound":"'||w||','||s||','||e||','||n||'","level":"12"}}' AS bounds,
      '{{"queryType":"10",'||k||'"show":"2","polygon":"'||w||','||n||','||e||','||n||','||e||','||s||','||w||','||s||','||w||','||n||'"}}' AS polygon,
      '{{"ltlat":"'||n||'","ltlng":"'||w||'","rblat":"'||s||'","rblng":"'||e||'","zones_mode":"flysafe_website","drone":"dji-mavic-3","level":"0,1,2,3,7,8,10"}}' AS zones
    FROM t CROSS JOIN (SELECT r_regionkey, CASE WHEN r_regionkey=0 THEN '' ELSE '"keyWord":"'||r_name||'",' END AS k FROM region)""")
def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell with every keyword (an empty one is no keyword) as a request of each kind."""
    words = runtime.table(spark, sf_dir, "region").selectExpr("r_regionkey AS kw", "CASE WHEN r_regionkey = 0 THEN '' ELSE r_name END AS keyword")
    asked = poi.cells_by_keyword(pipelines.cells(spark, BOUNDS, CELL), words)
    word = F.col("keyword")
    return asked.select(
        "idx", "kw", requests.b_in_bounds(word, number=geo.fixed).alias("bounds"), requests.b_in_polygon(word, show="2", number=geo.fixed).alias("polygon"),
        requests.zones_in_bounds(number=geo.fixed).alias("zones"),
    )


@query(f"""WITH {SQL_POI}, t AS (SELECT poi_id, {_d('lng')}||','||{_d('lat')} AS p, type_code, name FROM poi)
    SELECT poi_id, '{{"location":"'||p||'","radius":"1000","types":"'||type_code||'","extensions":"all","output":"json"}}' AS a,
      '{{"queryType":"3","keyWord":"'||name||'","dataTypes":"1","pointLonlat":"'||p||'","queryRadius":"1000","level":"12"}}' AS b,
      '{{"polygon":"'||p||'","output":"json","types":"'||type_code||'|x"}}' AS joined FROM t""")
def around_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request around every point with its type, and one with several types in one text."""
    lat, lng, radius = F.col("lat"), F.col("lng"), F.lit(1000)
    at = F.concat_ws(",", geo.fixed(lng), geo.fixed(lat))
    return derived.poi(spark, sf_dir).select(
        "poi_id", requests.a_around(lat, lng, radius, F.col("type_code"), number=geo.fixed).alias("a"),
        requests.b_around(lat, lng, radius, F.col("name"), data_types="1", number=geo.fixed).alias("b"),
        requests.a_in_polygon(at, F.array("type_code", F.lit("x"))).alias("joined"),
    )


@query(f"WITH {SQL_POI} SELECT poi_id, type_code FROM poi WHERE type_code IN ('BUILDING', 'MACHINERY')")
def points_of_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.of_types(derived.poi(spark, sf_dir), ["BUILDING", "MACHINERY"]).select("poi_id", "type_code")


@query("SELECT CAST(r_regionkey AS VARCHAR) AS code, r_name AS name, 'answer' AS origin FROM region UNION ALL SELECT code, name, 'shipped' FROM (VALUES "
       + ", ".join(f"('{code}', '{name}')" for code, name, _ in dimensions.TYPES_B) + ") AS t(code, name)")
def types_or_shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of an answer, and of one that failed."""
    record = F.to_json(F.struct(F.col("r_regionkey").cast("string").alias("code"), F.col("r_name").alias("name"), F.array().cast("array<struct<code:string,name:string>>").alias("subtypes")))
    answered = runtime.table(spark, sf_dir, "region").select(F.lit("ok").alias("status"), record.alias("record"))
    failed = answered.withColumn("status", F.lit("failed"))
    part = lambda df, origin: dimensions.types_or_shipped(df, "b").select("code", "name", F.lit(origin).alias("origin"))
    return part(answered, "answer").unionByName(part(failed, "shipped"))


@query("SELECT n_name AS name, n_nationkey AS slug, n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_nationkey IS NOT NULL) AS listed FROM nation")
def listed_or_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted keys, and whether a list holds them."""
    wanted = runtime.table(spark, sf_dir, "nation").selectExpr("n_name AS name", "n_nationkey AS slug")
    return dimensions.with_membership(wanted, runtime.table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS slug"), "slug")


@query(f"""WITH {SQL_POI} SELECT poi_id, CASE WHEN poi_id%7<>0 THEN 'SRID=4326;POINT('||{_d('lng')}||' '||{_d('lat')}||')' END AS point FROM poi""")
def points_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.poi(spark, sf_dir).select("poi_id", geo.point_text(F.col("lng"), F.when(F.col("poi_id") % 7 != 0, F.col("lat"))).alias("point"))


@query("SELECT strftime(ts, '%Y%m%d') AS day, count(*) AS n FROM events GROUP BY day")
def events_by_day_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.table(spark, sf_dir, "events").groupBy(values.day_stamp(F.col("ts")).alias("day")).agg(F.count("*").alias("n"))


@query(f"WITH {sql_grid(CELL)} SELECT idx, r_regionkey AS kw, r_name AS keyword FROM grid CROSS JOIN region")
def cell_keyword_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = runtime.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("kw"), F.col("r_name").alias("keyword"))
    return poi.cells_by_keyword(geo.grid(spark, BOUNDS, CELL).select("idx"), words)


@query("""WITH t AS (SELECT user_id, count(*) AS total FROM events GROUP BY user_id), p AS (SELECT user_id, total, greatest(1, CAST(ceil(total/25e0) AS INT)) AS last FROM t)
    SELECT user_id, CAST(page AS INT) AS page, CAST((page-1)*25 AS INT) AS start FROM p, unnest(range(1, last+1)) AS x(page)""")
def page_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = runtime.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("total"))
    return schedule.pages(totals, F.col("total"), 25).drop("total")


@query("SELECT n_nationkey, CAST(t AS INT) AS try, CAST(10*power(2, t) AS BIGINT) AS wait_s FROM nation, range(5) AS r(t)")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.waits(runtime.table(spark, sf_dir, "nation").select("n_nationkey"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 100 OFFSET 300")
def page_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourth page of a hundred rows: paging is the feature."""
    return schedule.page_of(runtime.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], 100, 4)


# Containment


@query(f"WITH {SQL_POI}, {sql_cells(FINE)}, {SQL_HITS} SELECT poi_id, idx FROM hits")
def point_in_rect_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.cell_hits(derived.poi(spark, sf_dir), pipelines.cells(spark, BOUNDS, FINE), FINE).select("poi_id", "idx")


@query(f"WITH {SQL_POI}, {sql_cells(FINE)}, {SQL_HITS} SELECT idx, type_code, count(*) AS n FROM hits GROUP BY ALL")
def cell_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = pipelines.cell_hits(derived.poi(spark, sf_dir), pipelines.cells(spark, BOUNDS, FINE), FINE)
    return poi.type_counts(hits, "idx")


@query(f"WITH {SQL_POI}, {sql_cells(CELL)} SELECT poi_id FROM poi WHERE NOT EXISTS (SELECT 1 FROM cells WHERE lat BETWEEN lat_min AND lat_max AND lng BETWEEN lng_min AND lng_max)")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that no square holds."""
    return spatial_join.uncovered(derived.poi(spark, sf_dir), pipelines.cells(spark, BOUNDS, CELL), pipelines.bucket_width(CELL), "poi_id").select("poi_id")


@query(f"""WITH {SQL_POI}, {sql_cells(CELL)}, {SQL_HITS}, {SQL_FIRST}
    SELECT (SELECT count(*) FROM cells) AS total_cells, (SELECT count(DISTINCT idx) FROM hits) AS hit_cells, (SELECT count(*) FROM cells)-(SELECT count(DISTINCT idx) FROM hits) AS empty_cells,
    (SELECT count(*) FROM hits) AS before, (SELECT count(*) FROM firsts) AS after, (SELECT count(*) FROM firsts)-(SELECT count(*) FROM firsts WHERE starts_with(type_code, 'BUILD')) AS filtered_out""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    squares = pipelines.cells(spark, BOUNDS, CELL)
    hits = runtime.written(pipelines.cell_hits(derived.poi(spark, sf_dir), squares, CELL), "hits")
    unique = dedupe.first_wins(hits, ["poi_id"], ["idx"])
    kept = poi.in_region(unique.withColumn("city", F.col("type_code")), "BUILDX", "city")
    return poi.run_metrics(hits, unique, kept, squares)


@query(f"WITH {SQL_POI} SELECT poi_id FROM poi WHERE sqrt(power((lat-34e0)*111000e0,2)+power((lng-113.5e0)*111000e0*cos(radians(34e0)),2)) <= 120000e0")
def around_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poi.around(derived.poi(spark, sf_dir), 34.0, 113.5, 120_000.0).select("poi_id")


# Keyed dedupe


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)=1")
def first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.first_wins(runtime.table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query(f"""WITH {SQL_EVENTS} SELECT event_id FROM ev WHERE k IS NULL OR k='' UNION ALL
    SELECT event_id FROM (SELECT * FROM ev WHERE k<>'' QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts, event_id)=1)""")
def first_wins_null_key_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.first_wins(derived.events(spark, sf_dir), ["k"], ["ts", "event_id"]).select("event_id")


@query(f"WITH {SQL_EVENTS} SELECT event_id FROM ev WHERE k<>'' QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts, event_id)=1")
def first_wins_null_key_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.first_wins(derived.events(spark, sf_dir), ["k"], ["ts", "event_id"], keep_missing=False).select("event_id")


@query("""WITH u AS (SELECT event_type AS platform, CASE WHEN event_id%17=0 THEN NULL ELSE CAST(user_id%97 AS VARCHAR) END AS k, event_id, value FROM events)
    SELECT platform, k, event_id, value FROM u WHERE k IS NULL UNION ALL
    SELECT platform, k, event_id, value FROM (SELECT * FROM u WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY platform, k ORDER BY event_id DESC)=1)""")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runtime.table(spark, sf_dir, "events").selectExpr("event_type AS platform", "CASE WHEN event_id%17=0 THEN NULL ELSE CAST(user_id%97 AS STRING) END AS k", "event_id", "value")
    return sinks.upserted(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), ["platform", "k"], "event_id")


@query(f"""WITH {SQL_RING}, {sql_cells(CELL)}
    SELECT area_id, min(idx) AS idx FROM box JOIN cells c ON box.lng_min<=c.lng_max AND box.lng_max>=c.lng_min AND box.lat_min<=c.lat_max AND box.lat_max>=c.lat_min GROUP BY area_id""")
def zone_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones that meet a cell, each once with its first cell."""
    return pipelines.region_zones(derived.fences(spark, sf_dir), BOUNDS, CELL).select("area_id", "idx")


# Regions


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("code"))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("string").alias("code"))


@query("""SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) AS code, CASE WHEN n_name='NATION_1' THEN 1 ELSE 2 END AS rank FROM nation WHERE contains(n_name, 'NATION_1')
    ORDER BY rank, name LIMIT 3""")
def region_lookup_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best matches: the limit is the feature. The underscore is an ordinary letter."""
    return regions.best_matches(_nations(spark, sf_dir), "NATION_1", 3)


@query("""SELECT level, code, name FROM (SELECT 'city' AS level, CAST(n_nationkey AS VARCHAR) AS code, n_name AS name, 0 AS o FROM nation WHERE n_name='NATION_7'
    UNION ALL SELECT 'province', CAST(r_regionkey AS VARCHAR), r_name, 1 FROM region WHERE r_name='NATION_7') ORDER BY o, code LIMIT 1""")
def region_code_city_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.code_of(_nations(spark, sf_dir), _regions(spark, sf_dir), "NATION_7")


@query("""SELECT name, code, level FROM (SELECT r_name AS name, CAST(r_regionkey AS VARCHAR) AS code, 'province' AS level, 0 AS o, CASE WHEN r_name='NATION_2' THEN 1 ELSE 2 END AS k FROM region WHERE contains(r_name, 'NATION_2')
    UNION ALL SELECT n_name, CAST(n_nationkey AS VARCHAR), 'city', 1, CASE WHEN n_name='NATION_2' THEN 1 ELSE 2 END FROM nation WHERE contains(n_name, 'NATION_2')) ORDER BY o, k, name LIMIT 1""")
def region_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Province first, then city, then the configured regions."""
    configured = spark.createDataFrame([(k, k) for k in dimensions.REGIONS], "name string, code string")
    return regions.resolve(_regions(spark, sf_dir), _nations(spark, sf_dir), configured, "NATION_2")


@query(f"WITH {SQL_POI} SELECT nation, min(lat) AS lat_min, max(lat) AS lat_max, min(lng) AS lng_min, max(lng) AS lng_max FROM poi GROUP BY nation")
def region_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.bounds_of(derived.poi(spark, sf_dir), "nation")


@query("SELECT n_nationkey, n_name AS city FROM nation WHERE trim(n_name)='NATION_12' OR starts_with(trim(n_name), 'NATION_1')")
def region_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poi.in_region(runtime.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("city")), "NATION_12", "city")


# Records of providers

_RAW_A = [
    "CASE WHEN c_custkey%13=0 THEN NULL ELSE concat('a', CAST(c_custkey AS {t})) END AS id", "c_name AS name", "c_mktsegment AS typecode", "concat('type ', c_mktsegment) AS type",
    "concat(CAST(CAST(110e0+((c_custkey*37)%670)/1e2 AS DECIMAL(12,2)) AS {t}), CASE WHEN c_custkey%5=0 THEN '' ELSE ',' END, CAST(CAST(31.4e0+((c_custkey*53)%500)/1e2 AS DECIMAL(12,2)) AS {t})) AS location",
    "'P' AS pname", "concat('C', CAST(c_nationkey AS {t})) AS cityname", "'D' AS adname", "CASE WHEN c_custkey%3=0 THEN '' ELSE concat('road ', CAST(c_custkey AS {t})) END AS address", "'elsewhere' AS addr",
]
_RAW_B = [
    "CASE WHEN s_suppkey%4=0 THEN '' ELSE concat('h', CAST(s_suppkey AS {t})) END AS hotPointID", "concat('b', CAST(s_suppkey AS {t})) AS id", "s_name AS name", "CAST(NULL AS {t}) AS typeCode",
    "concat('00', CAST(s_nationkey AS {t})) AS alt_code", "'' AS typeName", "'kind' AS type", "CASE WHEN s_suppkey%3=0 THEN '' ELSE '113.25' END AS lon", "'114.5' AS lng", "CASE WHEN s_suppkey%7=0 THEN 'north' ELSE '34.75' END AS lat",
    "'P' AS province", "'C' AS city", "CASE WHEN s_suppkey%2=0 THEN NULL ELSE 'county' END AS county", "'district' AS district", "CAST(NULL AS {t}) AS address", "'addr' AS addr",
]


@query(f"""WITH a AS (SELECT {', '.join(_RAW_A).format(t='VARCHAR')} FROM customer), b AS (SELECT {', '.join(_RAW_B).format(t='VARCHAR')} FROM supplier)
    SELECT 'a' AS source_platform, id AS poi_id, name, typecode AS type_code, type AS type_name, coalesce(nullif(address, ''), addr) AS address, pname AS province, cityname AS city, adname AS district,
      CASE WHEN contains(location, ',') THEN CAST(split_part(location, ',', 1) AS DOUBLE) END AS lng, CASE WHEN contains(location, ',') THEN CAST(split_part(location, ',', 2) AS DOUBLE) END AS lat FROM a
    UNION ALL SELECT 'b', coalesce(nullif(hotPointID, ''), id), name, coalesce(typeCode, alt_code), coalesce(nullif(typeName, ''), type), coalesce(address, addr), province, city, coalesce(county, district),
      CASE WHEN lat='north' THEN NULL ELSE CAST(coalesce(nullif(lon, ''), lng) AS DOUBLE) END, CASE WHEN lat='north' THEN NULL ELSE CAST(lat AS DOUBLE) END FROM b""")
def poi_unified_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = runtime.table(spark, sf_dir, "customer").selectExpr(*(e.format(t="STRING") for e in _RAW_A))
    b = runtime.table(spark, sf_dir, "supplier").selectExpr(*(e.format(t="STRING") for e in _RAW_B))
    b = b.withColumn("typeCode", F.coalesce("typeCode", "alt_code"))
    return poi.from_provider_a(a).unionByName(poi.from_provider_b(b)).drop("raw_data", "metadata")


_LOCATIONS = "CASE c_custkey%7 WHEN 0 THEN '113.6,34.7' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN '113.6' WHEN 4 THEN '113.6,34.7,9' WHEN 5 THEN 'x,34.7' ELSE ' 0 , -1.5' END"


@query(f"""WITH t AS (SELECT c_custkey, {_LOCATIONS} AS l FROM customer), p AS (SELECT c_custkey, TRY_CAST(trim(split_part(l, ',', 1)) AS DOUBLE) AS x, TRY_CAST(trim(substr(l, length(split_part(l, ',', 1))+2)) AS DOUBLE) AS y FROM t)
    SELECT c_custkey, CASE WHEN y IS NOT NULL THEN x END AS lng, CASE WHEN x IS NOT NULL THEN y END AS lat FROM p""")
def lnglat_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = values.lng_lat(F.col("l"))
    return runtime.table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_LOCATIONS} AS l").select("c_custkey", at["lng"].alias("lng"), at["lat"].alias("lat"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS nothing FROM events")
def raw_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records kept as JSON give their fields back."""
    kept = poi.from_provider_a(runtime.table(spark, sf_dir, "events").withColumnRenamed("event_id", "id"), raw="props")
    kept = kept.select(F.col("poi_id").cast("long").alias("event_id"), F.col("raw_data").alias("raw"))
    return kept.select("event_id", F.get_json_object("raw", "$.k").cast("long").alias("k"), F.get_json_object("raw", "$.none").alias("nothing"))


@query("""SELECT event_id, coalesce(event_type IN ('view', 'click'), false) AS fine_a,
    coalesce((CASE WHEN event_id%5=0 THEN NULL WHEN event_id%5=1 THEN 301012 WHEN event_id%5=2 THEN 0 ELSE 1000 END) IN (0, 1000) AND user_id%3=1, false) AS fine_b FROM events""")
def response_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which responses count, of both providers."""
    ev = runtime.table(spark, sf_dir, "events")
    infocode = F.expr("CASE WHEN event_id%5=0 THEN NULL WHEN event_id%5=1 THEN 301012 WHEN event_id%5=2 THEN 0 ELSE 1000 END")
    fine_a = poi.valid_a(F.when(F.col("event_type").isin("view", "click"), "1").otherwise("0"))
    return ev.select("event_id", fine_a.alias("fine_a"), poi.valid_b(infocode, F.lit(None).cast("int"), (F.col("user_id") % 3).cast("int")).alias("fine_b"))


@query(f"WITH {SQL_POI} SELECT poi_id FROM poi WHERE contains(name, '99') OR contains(type_code, '99')")
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poi.with_keyword(derived.poi(spark, sf_dir).withColumn("type_name", F.col("type_code")), "99").select("poi_id")


@query(f"""WITH {SQL_POI}, {sql_cells(CELL)}, {SQL_HITS}, f AS (SELECT * FROM hits WHERE nation%5=0 AND idx<>5), s AS (SELECT * FROM hits WHERE nation%5<>0)
    SELECT idx, poi_id FROM f UNION ALL SELECT idx, poi_id FROM s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.idx=s.idx)""")
def fallback_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells without a hit of the first search take those of the second."""
    hits = pipelines.cell_hits(derived.poi(spark, sf_dir), pipelines.cells(spark, BOUNDS, CELL), CELL)
    return poi.with_fallback(hits.where("nation % 5 = 0 AND idx <> 5"), hits.where("nation % 5 <> 0"), "idx").select("idx", "poi_id")


# Types


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region -> nation as a flat tree, nested."""
    return type_tree.nest(_flat(spark, sf_dir))


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = runtime.table(spark, sf_dir, "region").selectExpr("concat('R', r_regionkey) AS type_code", "r_name AS type_name", "CAST(NULL AS STRING) AS parent_code", "1 AS level")
    sub = runtime.table(spark, sf_dir, "nation").selectExpr("concat('N', n_nationkey) AS type_code", "n_name AS type_name", "concat('R', n_regionkey) AS parent_code", "2 AS level")
    return top.unionByName(sub)


_SQL_FLAT = "flat AS (SELECT 'R'||r_regionkey AS type_code, r_name AS type_name, NULL AS parent_code, 1 AS level FROM region UNION ALL SELECT 'N'||n_nationkey, n_name, 'R'||n_regionkey, 2 FROM nation)"


@query(f"WITH {_SQL_FLAT} SELECT type_code, type_name, parent_code, level FROM flat")
def type_tree_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return type_tree.flatten(_tree(spark, sf_dir))


@query(f"""WITH {_SQL_FLAT} SELECT p.type_code AS code, p.type_name AS name, count(c.type_code) AS n, string_agg(c.type_code||' '||c.type_name, ';' ORDER BY c.type_code) AS children
    FROM flat p LEFT JOIN flat c ON c.parent_code=p.type_code WHERE p.level=1 GROUP BY ALL""")
def type_tree_nest(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = F.array_join(F.transform("subtypes", lambda s: F.concat_ws(" ", s["code"], s["name"])), ";")
    return _tree(spark, sf_dir).select("code", "name", F.size("subtypes").cast("long").alias("n"), joined.alias("children"))


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS keywords FROM (SELECT user_id, event_type, min(event_id) AS first FROM events WHERE event_type<>'error' GROUP BY ALL) GROUP BY user_id""")
def keyword_ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keywords of each user in order of first occurrence; errors count as empty."""
    word = F.struct("event_id", F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("w"))
    lists = runtime.table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(word)).alias("ws"))
    words = values.distinct_keywords(F.transform("ws", lambda s: s["w"]))
    return lists.select("user_id", F.array_join(words, ",").alias("keywords")).where("keywords <> ''")


@query("""SELECT t.code AS parent, s.code AS code, s.name AS name FROM (VALUES """ + ", ".join(f"('{c}', {[{'code': a, 'name': b} for a, b in subs]})" for c, _, subs in dimensions.TYPES_B) + """) AS t(code, subs), unnest(t.subs) AS u(s)""")
def shipped_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subtypes of provider B that ship with the library."""
    flat = type_tree.flatten(dimensions.type_tree(spark, "b")).where("level = 2")
    return flat.select(F.col("parent_code").alias("parent"), F.col("type_code").alias("code"), F.col("type_name").alias("name"))


@query(f"""WITH {_SQL_FLAT}, p AS (SELECT c_custkey, CASE WHEN c_custkey%3=0 THEN 'N'||c_nationkey WHEN c_custkey%3=1 THEN 'R'||c_custkey%9 ELSE 'X' END AS type_code FROM customer)
    SELECT c_custkey, p.type_code, coalesce(flat.type_name, p.type_code) AS type_name FROM p LEFT JOIN flat ON flat.type_code=p.type_code""")
def type_name_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = runtime.table(spark, sf_dir, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey%3=0 THEN concat('N', c_nationkey) WHEN c_custkey%3=1 THEN concat('R', c_custkey%9) ELSE 'X' END AS type_code")
    return poi.with_type_name(codes, _tree(spark, sf_dir))


@query(f"""WITH {SQL_ZONES} SELECT area_id, CASE level {' '.join(f"WHEN {k} THEN '{v}'" for k, v in dimensions.LEVELS.items())} END AS level_name FROM zones""")
def level_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.zones(spark, sf_dir).select("area_id", dimensions.label(F.col("level"), dimensions.LEVELS).alias("level_name"))


@query(f"WITH {SQL_ZONES} SELECT area_id, level FROM zones WHERE level IN ({', '.join(map(str, dimensions.LEVELS))})")
def zones_at_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.at_levels(derived.zones(spark, sf_dir)).select("area_id", "level")


# Zones


@query(f"WITH {SQL_RING} SELECT area_id, CAST(i AS INT) AS i, {sql_rounded('x, y')} FROM ring")
def circle_ring_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = derived.zones(spark, sf_dir).select("area_id", F.posexplode(geo.circle_ring(F.col("lat"), F.col("lng"), F.col("radius"))).alias("i", "p"))
    return rounded(ring.select("area_id", "i", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y")), "x", "y")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone records: circles, polygons, points, one or two sub-areas, nothing usable."""
    square = F.array(F.array(*[F.array(F.col("lng") + dx, F.col("lat") + dy) for dx, dy in ((0.0, 0.0), (0.5, 0.0), (0.5, 0.5), (0.0, 0.0))]))
    none = F.lit(None)
    sub = lambda shape, points: F.struct(shape.cast("int").alias("shape"), none.cast("double").alias("lat"), none.cast("double").alias("lng"), none.cast("double").alias("radius"), points.cast(zones.RINGS).alias("polygon_points"))
    kind = F.col("area_id") % 7
    subs = F.when(kind == 4, F.array(sub(none, square))).when(kind == 5, F.array(sub(F.lit(2), none), sub(F.lit(1), square), sub(F.lit(0), none)))
    own = {
        "shape": F.when(kind == 1, 1).when(kind == 2, 0).when(kind == 3, none.cast("int")).otherwise(2),
        "polygon_points": F.when(kind == 1, square),
        "lat": F.when(kind != 6, F.col("lat")),
        "sub_areas": subs,
        "type": F.lit(10), **{c: none.cast("string") for c in ("color", "country", "city", "address", "description", "url")}, **{c: none.cast("double") for c in ("height", "begin_at", "end_at", "data_source")},
    }
    return derived.zones(spark, sf_dir).withColumns(own)


_SQL_SQUARE = "'('||" + "||','||".join(f"CAST(CAST(lng+{dx} AS DECIMAL(18,6)) AS VARCHAR)||' '||CAST(CAST(lat+{dy} AS DECIMAL(18,6)) AS VARCHAR)" for dx, dy in (("0e0", "0e0"), ("0.5e0", "0e0"), ("0.5e0", "0.5e0"), ("0e0", "0e0"))) + "||')'"


@query(f"""WITH {SQL_RING}, c AS (SELECT area_id, '('||string_agg(CAST(CAST(x AS DECIMAL(18,6)) AS VARCHAR)||' '||CAST(CAST(y AS DECIMAL(18,6)) AS VARCHAR), ',' ORDER BY i)||')' AS circle FROM ring GROUP BY area_id),
    k AS (SELECT zones.area_id, level, radius, circle, {_SQL_SQUARE} AS square, zones.area_id%7 AS kind FROM zones JOIN c ON c.area_id=zones.area_id)
    SELECT area_id, CASE kind WHEN 2 THEN 'Point' WHEN 5 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind,
      CASE WHEN kind IN (0, 3) THEN 'MULTIPOLYGON(('||circle||'))' WHEN kind IN (1, 4) THEN 'MULTIPOLYGON(('||square||'))' WHEN kind=5 THEN 'MULTIPOLYGON(('||circle||'),('||square||'))' END AS geom FROM k WHERE kind<>6""")
def zone_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometry of every kind of record and its WKT."""
    found = zones.features(_records(spark, sf_dir))
    rows = zones.table_rows(found).select("area_id", "geom")
    return found.select("area_id", F.col("geometry.kind").alias("kind")).join(rows, "area_id")


@query(f"""WITH {SQL_RING}, {SQL_POI} SELECT poi_id, area_id FROM poi, edge WHERE ((y1>lat)<>(y2>lat)) AND lng<(x2-x1)*(lat-y1)/nullif(y2-y1, 0e0)+x1 GROUP BY ALL HAVING count(*)%2=1""")
def point_in_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fences.points_in_fences(derived.poi(spark, sf_dir), derived.fences(spark, sf_dir)).select("poi_id", "area_id")


@query(f"""WITH {SQL_RING}, {SQL_POI}, p AS (SELECT poi_id, area_id FROM poi, edge WHERE ((y1>lat)<>(y2>lat)) AND lng<(x2-x1)*(lat-y1)/nullif(y2-y1, 0e0)+x1 GROUP BY ALL HAVING count(*)%2=1)
    SELECT zones.area_id, count(poi_id) AS n FROM zones LEFT JOIN p ON p.area_id=zones.area_id GROUP BY ALL""")
def point_in_zone_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fences.counted_in_fences(derived.poi(spark, sf_dir), derived.fences(spark, sf_dir)).select("area_id", F.col("n_points").alias("n"))


_SQL_NEW = "new AS (SELECT n_nationkey AS new_id, CAST(n_nationkey%3+1 AS INT) AS new_type, 112.5e0+(n_nationkey%25)/5e0 AS lng_min, 113.1e0+(n_nationkey%25)/5e0 AS lng_max, 31e0+(n_nationkey%7)/2e0 AS lat_min, 31.6e0+(n_nationkey%7)/2e0 AS lat_max FROM nation)"
_SQL_MEET = "new.lng_min<=box.lng_max AND new.lng_max>=box.lng_min AND new.lat_min<=box.lat_max AND new.lat_max>=box.lat_min"


def _new_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.table(spark, sf_dir, "nation").selectExpr("n_nationkey AS new_id", "CAST(n_nationkey%3+1 AS INT) AS fence_type", "112.5e0+(n_nationkey%25)/5e0 AS lng_min", "113.1e0+(n_nationkey%25)/5e0 AS lng_max", "31e0+(n_nationkey%7)/2e0 AS lat_min", "31.6e0+(n_nationkey%7)/2e0 AS lat_max")


@query(f"WITH {SQL_RING}, {_SQL_NEW} SELECT new_id, area_id FROM new JOIN box ON {_SQL_MEET} WHERE new_type=2 AND box.fence_type=1 OR new_type=3 AND box.fence_type IN (1, 2)")
def fence_conflict_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = derived.fences(spark, sf_dir).drop("polygons").withColumnRenamed("fence_type", "right_type")
    return fences.conflicts(_new_fences(spark, sf_dir), there).select("new_id", "area_id")


@query(f"WITH {SQL_RING}, {_SQL_NEW} SELECT new_id AS project_id, area_id, box.fence_type FROM new JOIN box ON {_SQL_MEET} WHERE box.fence_type IN (1, 3)")
def fence_project_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = _new_fences(spark, sf_dir).withColumnRenamed("new_id", "project_id").drop("fence_type")
    return fences.of_project(derived.fences(spark, sf_dir).drop("polygons"), areas).select("project_id", "area_id", "fence_type")


_SQL_CROSS = """((l.x2-l.x1)*(e.y1-l.y1)-(l.y2-l.y1)*(e.x1-l.x1))*((l.x2-l.x1)*(e.y2-l.y1)-(l.y2-l.y1)*(e.x2-l.x1))<0
    AND ((e.x2-e.x1)*(l.y1-e.y1)-(e.y2-e.y1)*(l.x1-e.x1))*((e.x2-e.x1)*(l.y2-e.y1)-(e.y2-e.y1)*(l.x2-e.x1))<0"""
_SQL_ACROSS = f"""across AS (SELECT DISTINCT route_id, area_id FROM leg l, edge e WHERE {_SQL_CROSS}
    UNION SELECT route_id, area_id FROM ends, edge e WHERE ((e.y1>ends.y1)<>(e.y2>ends.y1)) AND ends.x1<(e.x2-e.x1)*(ends.y1-e.y1)/nullif(e.y2-e.y1, 0e0)+e.x1 GROUP BY ALL HAVING count(*)%2=1)"""


@query(f"WITH {SQL_RING}, {SQL_ROUTES}, {_SQL_ACROSS} SELECT route_id, area_id FROM across")
def route_crosses_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes that cross a fence's edge or begin inside it."""
    return fences.routes_across(derived.routes(spark, sf_dir), derived.fences(spark, sf_dir)).select("route_id", "area_id")


def _sql_gap(p: str, q: str, a: str) -> str:
    """Metres from the point (p, q) to the piece a, with the cosine s."""
    along = f"greatest(0e0, least(1e0, coalesce((({p}-{a}.x1)*s*({a}.x2-{a}.x1)*s+({q}-{a}.y1)*({a}.y2-{a}.y1))/nullif(power(({a}.x2-{a}.x1)*s,2)+power({a}.y2-{a}.y1,2),0e0),0e0)))"
    return f"sqrt(power(({p}-{a}.x1)*s-{along}*({a}.x2-{a}.x1)*s,2)+power(({q}-{a}.y1)-{along}*({a}.y2-{a}.y1),2))*111000e0"


@query(f"""WITH {SQL_RING}, {SQL_ROUTES}, {_SQL_ACROSS}, legs AS (SELECT *, cos(radians((min(least(y1,y2)) OVER (PARTITION BY route_id)+max(greatest(y1,y2)) OVER (PARTITION BY route_id))/2)) AS s FROM leg),
    near AS (SELECT route_id, area_id, min(least({_sql_gap('l.x1', 'l.y1', 'e')}, {_sql_gap('l.x2', 'l.y2', 'e')}, {_sql_gap('e.x1', 'e.y1', 'l')}, {_sql_gap('e.x2', 'e.y2', 'l')})) AS m FROM legs l, edge e GROUP BY ALL)
    SELECT route_id, area_id FROM across UNION SELECT route_id, area_id FROM near WHERE m<=20000e0""")
def route_near_zone_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes that come within 20 km of a fence."""
    near = overlap.lines_near(derived.routes(spark, sf_dir), F.col("route_id"), derived.fences(spark, sf_dir), F.col("area_id"), 20_000.0)
    return near.select(F.col("left").alias("route_id"), F.col("right").alias("area_id"))


# Routes on a grid

_BOX = geo.Bounds(31.0, 32.0, 113.0, 114.0)
_STEP = 15_000.0
_ROUNDS = 16


def _sql_relaxed() -> str:
    first = "d0 AS (SELECT min(idx) AS node, 0e0 AS cost FROM free)"
    later = [f"d{i + 1} AS (SELECT node, min(cost) AS cost FROM (SELECT node, cost FROM d{i} UNION ALL SELECT link.b, d.cost+link.cost FROM d{i} d JOIN link ON link.a=d.node) GROUP BY node)" for i in range(_ROUNDS)]
    return ", ".join([first, *later])


@query(f"""WITH {SQL_RING}, {sql_grid(_STEP, _BOX)}, held AS (SELECT DISTINCT idx FROM (SELECT idx, area_id FROM grid, edge WHERE ((y1>lat)<>(y2>lat)) AND lng<(x2-x1)*(lat-y1)/nullif(y2-y1, 0e0)+x1 GROUP BY ALL HAVING count(*)%2=1)),
    free AS (SELECT idx, (idx-1)//ng AS i, (idx-1)%ng AS j, lat, lng FROM grid, grid_n WHERE idx NOT IN (SELECT idx FROM held)),
    link AS (SELECT p.idx AS a, q.idx AS b, sqrt(power((q.lng-p.lng)*111000e0*cos(radians((q.lat+p.lat)/2)),2)+power((q.lat-p.lat)*111000e0,2)) AS cost FROM free p JOIN free q ON abs(p.i-q.i)<=1 AND abs(p.j-q.j)<=1 AND p.idx<>q.idx),
    {_sql_relaxed()} SELECT node-1 AS node, round(cost, 3) AS cost FROM d{_ROUNDS}""")
def shortest_path_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest way from the first free node to every node, around fences."""
    free = runtime.written(route.nodes(spark, _BOX, _STEP, [50.0], derived.fences(spark, sf_dir)), "nodes")
    start = free.agg(F.min("node")).first()[0]
    return route.cheapest(route.neighbours(free), start).select("node", F.round("cost", 3).alias("cost"))


# Names of catalog objects

_NAMES = "CASE n_nationkey%5 WHEN 0 THEN 'f' WHEN 1 THEN 's.f' WHEN 2 THEN 's.f()' WHEN 3 THEN concat('s.f', '(integer, text)') ELSE 'a\"b.c(x' END"


@query(f"""WITH t AS (SELECT n_nationkey, {_NAMES} AS o FROM nation), h AS (SELECT n_nationkey, o, split_part(o, '(', 1) AS h FROM t)
    SELECT n_nationkey, CASE WHEN contains(h, '.') THEN split_part(h, '.', 1) ELSE 'public' END AS schema, CASE WHEN contains(h, '.') THEN split_part(h, '.', 2) ELSE h END AS name,
    CASE WHEN contains(o, '(') THEN rtrim(split_part(o, '(', 2), ')') END AS args FROM h""")
def catalog_object_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = values.object_name(F.col("o"))
    return runtime.table(spark, sf_dir, "nation").selectExpr("n_nationkey", f"{_NAMES} AS o").select("n_nationkey", *[o[c].alias(c) for c in ("schema", "name", "args")])


@query(f"""SELECT n_nationkey, '"'||replace({_NAMES}, '"', '""')||'"' AS quoted FROM nation""")
def quoted_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.table(spark, sf_dir, "nation").selectExpr("n_nationkey", f"{_NAMES} AS o").select("n_nationkey", values.quoted(F.col("o")).alias("quoted"))


@query("""SELECT c_custkey, 'there' AS state FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey)
    UNION ALL SELECT c_custkey, 'missing' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey)""")
def catalog_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the wanted objects exist, with customers for objects and orders for the catalog."""
    wanted, there = runtime.table(spark, sf_dir, "customer").select("c_custkey"), runtime.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    keys = ["c_custkey"]
    return catalog.known(wanted, there, keys).withColumn("state", F.lit("there")).unionByName(catalog.missing(wanted, there, keys).withColumn("state", F.lit("missing")))


@query("""SELECT r_name AS schema, n_name AS name, CAST(n_nationkey AS VARCHAR) AS args, 'body of '||n_name AS definition FROM nation JOIN region ON n_regionkey=r_regionkey""")
def catalog_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routines with the names of their schemas."""
    routines = runtime.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("namespace_id"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("args"), F.concat(F.lit("body of "), "n_name").alias("definition"))
    namespaces = runtime.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("namespace_id"), F.col("r_name").alias("schema"))
    return catalog.definitions(routines, namespaces)
