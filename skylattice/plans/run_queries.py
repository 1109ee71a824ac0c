"""Queries over whole runs and what they write: answers, places, bounds, regions, tables, files and copies of schemas, each with its DuckDB SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice import runtime
from skylattice.functions import geo
from skylattice.operators import catalog, flight, poi, type_tree, zones
from skylattice.plans import derived, pipelines
from skylattice.plans.derived import BOUNDS, CELL, SQL_HITS, SQL_POI, SQL_RING, SQL_ROUTES, SQL_ZONES, sql_cells
from skylattice.plans.geo_queries import _SQL_FLAT, ORACLES, QUERIES, _d, _tree, query
from skylattice.plans.geo_queries import _records as zone_records
from skylattice.sources import sinks
from skylattice.sources.dimensions import LEVELS


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{runtime.shared_dir(spark)}/skylattice/{name}-{uuid.uuid4().hex}"


# Answers and requests

_LEVEL_NAMES = "CASE level " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in LEVELS.items()) + " END"


@query(f"""WITH {SQL_ZONES}, first AS (SELECT area_id, min(i) AS idx FROM (SELECT area_id, unnest([area_id//20, area_id//20+1]) AS i FROM zones) WHERE i%7 NOT IN (3, 5) AND area_id<>0 GROUP BY area_id)
    SELECT area_id, name, level, {_LEVEL_NAMES} AS level_name, 'ten' AS type_name, CAST(idx AS VARCHAR) AS color, '420100' AS shicode, geom
    FROM ({ORACLES['zone_wkt']}) JOIN zones USING (area_id) JOIN first USING (area_id)""")
def zone_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of cells as text, where each zone is in two of them, some failed and some are no JSON: the first of each zone as a row of the table."""
    records = zone_records(spark, sf_dir)
    there = F.explode(F.array(F.floor(F.col("area_id") / 20), F.floor(F.col("area_id") / 20) + 1)).alias("idx")
    landed = records.select(*records.columns, there).withColumn("color", F.col("idx").cast("string"))
    areas = landed.groupBy("idx").agg(F.collect_list(F.struct(*records.columns)).alias("areas"))  # a cell has 40 zones at most
    body = F.to_json(F.struct(F.when(F.col("idx") % 7 == 3, 301).otherwise(0).alias("code"), F.struct("areas").alias("data")))
    answers = areas.select("idx", F.when(F.col("idx") % 7 == 5, F.concat(F.lit("<html>"), body)).otherwise(body).alias("body"))
    found = zones.features(zones.from_answers(answers, keep=("idx",)), {10: "ten"}, keep=("idx",))
    return zones.table_rows(zones.unique(found, ["idx"]), {"shicode": "420100"}).select("area_id", "name", "level", "level_name", "type_name", "color", "shicode", "geom")


_SIDES = "lat-50e0/111e0 AS s, lat+50e0/111e0 AS n, lng-50e0/(111e0*abs(cos(radians(lat)))) AS w, lng+50e0/(111e0*abs(cos(radians(lat)))) AS e"


@query(f"""WITH t AS (SELECT region, idx, {_d('s')} AS s, {_d('n')} AS n, {_d('w')} AS w, {_d('e')} AS e FROM (SELECT region, idx, {_SIDES} FROM ({ORACLES['grids_of_regions']})))
    SELECT region, idx, w||','||n||'|'||e||','||s AS corners, w||','||s||','||e||','||n AS map_bound FROM t""")
def region_cell_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of every region of a table as the texts that requests carry."""
    centres = QUERIES["grids_of_regions"](spark, sf_dir)
    squares = centres.select("region", "idx", *geo.rectangle(F.col("lat"), F.col("lng"), 50_000.0))
    return squares.select("region", "idx", geo.corner_pair(geo.fixed).alias("corners"), geo.map_bound(text=geo.fixed).alias("map_bound"))


# Runs

_PLACE = (32.0, 113.5, 100_000.0)


@query(f"""WITH {SQL_POI}, {sql_cells(CELL)}, {SQL_HITS}
    SELECT poi_id, idx FROM hits WHERE sqrt(power((lat-{_PLACE[0]}e0)*111000e0,2)+power((lng-{_PLACE[1]}e0)*111000e0*cos(radians({_PLACE[0]}e0)),2))<={_PLACE[2]}e0""")
def place_points_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points around a place, found by cells: a run around a place keeps repeats."""
    hits = pipelines.cell_hits(derived.poi(spark, sf_dir), pipelines.cells(spark, BOUNDS, CELL), CELL)
    return pipelines.points_around(hits, *_PLACE).select("poi_id", "idx")


_FAR = f"{_PLACE[2] / 1000!r}e0/111e0"


@query(f"""WITH {SQL_RING} SELECT area_id, fence_type FROM box WHERE lat_max>={_PLACE[0]}e0-{_FAR} AND lat_min<={_PLACE[0]}e0+{_FAR}
    AND lng_max>={_PLACE[1]}e0-{_FAR}/abs(cos(radians({_PLACE[0]}e0))) AND lng_min<={_PLACE[1]}e0+{_FAR}/abs(cos(radians({_PLACE[0]}e0)))""")
def place_zones_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones that meet the square around a place."""
    return pipelines.zones_around(derived.fences(spark, sf_dir), *_PLACE).select("area_id", "fence_type")


@query(f"""WITH {SQL_RING}, {sql_cells(CELL)} SELECT area_id, min(idx) AS idx FROM box b JOIN cells c
    ON b.lat_max>=c.lat_min AND b.lat_min<=c.lat_max AND b.lng_max>=c.lng_min AND b.lng_min<=c.lng_max WHERE area_id<>0 GROUP BY area_id""")
def region_zones_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones of a region, each from the first cell that it meets."""
    return pipelines.region_zones(derived.fences(spark, sf_dir), BOUNDS, CELL).select("area_id", "idx")


@query(f"""WITH {SQL_POI}, {sql_cells(CELL)}, {SQL_HITS}, h AS (SELECT *, unnest([poi_id%3, poi_id%3+1]) AS kw FROM hits), f AS (SELECT * FROM h WHERE nation%5=0 AND idx<>5), s AS (SELECT * FROM h WHERE nation%5<>0),
    u AS (SELECT * FROM f UNION ALL SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.idx=s.idx)) SELECT poi_id, idx, kw FROM u QUALIFY row_number() OVER (PARTITION BY poi_id ORDER BY idx, kw)=1""")
def bounds_points_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a rectangle asked for by keywords: for cells without any those of the second search, then the first of each."""
    hits = pipelines.cell_hits(derived.poi(spark, sf_dir), pipelines.cells(spark, BOUNDS, CELL), CELL)
    third = F.col("poi_id") % 3
    asked = hits.withColumn("kw", F.explode(F.array(third, third + 1))).withColumns({"page": F.lit(1), "pos": F.col("poi_id")})
    return pipelines.bounds_points(asked.where("nation % 5 = 0 AND idx <> 5"), asked.where("nation % 5 <> 0")).select("poi_id", "idx", "kw")


# What runs write


@query(f"""WITH {SQL_POI}, {sql_cells(CELL)}, {SQL_HITS} SELECT poi_id, min(idx) AS idx, n_name AS city, type_code, count(*) OVER () AS saved, 'points of NATION_1X, x''s' AS about, 'from the provider' AS said
    FROM hits JOIN nation ON n_nationkey=nation WHERE starts_with(n_name, 'NATION_1') GROUP BY ALL""")
def region_points_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region's run down to its table: named by its code and keyword, parted by type, with comments, counted as it is written, read again."""
    nations = runtime.table(spark, sf_dir, "nation").selectExpr("n_nationkey AS nation", "n_name AS city")
    found = pipelines.region_points(derived.poi(spark, sf_dir).join(nations, "nation"), BOUNDS, CELL, name="NATION_1X", level="city")
    table = f"{poi.target_table('420100', 'x')}_{uuid.uuid4().hex}"
    saved = sinks.save_table(found.select("poi_id", "idx", "city", "type_code"), table, "points of NATION_1X, x's", {"poi_id": "from the provider"}, by=("type_code",))
    there = spark.table(table)
    about, said = spark.catalog.getTable(table).description, there.schema["poi_id"].metadata["comment"]
    return there.select("poi_id", "idx", "city", "type_code", F.lit(saved).alias("saved"), F.lit(about).alias("about"), F.lit(said).alias("said"))


@query(f"""WITH {SQL_RING} SELECT area_id, name, CASE area_id%7 WHEN 2 THEN 'Point' WHEN 5 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind,
      CASE area_id%7 WHEN 2 THEN 1 WHEN 1 THEN 4 WHEN 4 THEN 4 WHEN 5 THEN 41 ELSE 37 END AS corners, round(CASE WHEN area_id%7 IN (1, 2, 4) THEN lng ELSE lng_min END, 6) AS west
    FROM zones JOIN box USING (area_id) WHERE area_id%7<>6""")
def zone_geojson_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones written as GeoJSON features, a line each, and read again."""
    path = scratch(spark, "geojson")
    sinks.geojson_lines(zones.features(zone_records(spark, sf_dir))).write.text(path)
    kind, at = F.get_json_object("value", "$.geometry.type"), F.get_json_object("value", "$.geometry.coordinates")
    deep = lambda n: F.from_json(at, "array<" * n + "double" + ">" * n)
    corners = F.when(kind == "Point", F.array(deep(1))).when(kind == "Polygon", F.flatten(deep(3))).otherwise(F.flatten(F.flatten(deep(4))))
    read = spark.read.text(path).select(F.from_json(F.get_json_object("value", "$.properties"), "area_id long, name string").alias("p"), kind.alias("kind"), corners.alias("c"))
    west = F.array_min(F.transform("c", lambda p: F.get(p, F.lit(0))))
    return read.select("p.area_id", "p.name", "kind", F.size("c").alias("corners"), F.round(west, 6).alias("west"))


@query(f"WITH {SQL_POI} SELECT poi_id, name, type_code, round(lng, 6) AS lng, round(lat, 6) AS lat, count(*) OVER () AS saved FROM poi")
def points_json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written as JSON lines, counted as they are written, and read again."""
    found, path = derived.poi(spark, sf_dir), scratch(spark, "json")
    saved = sinks.save_json(found, path)
    read = spark.read.schema(found.schema).json(path)
    return read.select("poi_id", "name", "type_code", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"), F.lit(saved).alias("saved"))


@query(f"""WITH {_SQL_FLAT}, {SQL_ZONES} SELECT 'table' AS kind, 'kinds' AS name, count(*) AS n, count(*) AS said FROM flat UNION ALL SELECT 'table', 'places', 2*count(*), 2*count(*) FROM nation
    UNION ALL SELECT 'table', 'zones', count(*), count(*) FROM zones UNION ALL SELECT 'view', 'a_high', count(*), NULL FROM zones WHERE level>5 AND radius>=10000
    UNION ALL SELECT 'view', 'b_wide', count(*), NULL FROM zones WHERE radius>=10000 UNION ALL SELECT 'function', 'twice', CAST(sum(2*n_nationkey) AS BIGINT), NULL FROM nation""")
def schema_copied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema's tables, functions and views found, copied to another and counted there; one table is added to a second time."""
    mark = uuid.uuid4().hex
    source, target = f"from_{mark}", f"to_{mark}"
    spark.sql(f"CREATE SCHEMA {source}")
    nations = runtime.table(spark, sf_dir, "nation")
    for name, rows in (("kinds", type_tree.flatten(_tree(spark, sf_dir))), ("places", nations), ("zones", derived.zones(spark, sf_dir))):
        sinks.save_table(rows, f"{source}.{name}")
    catalog.sync_functions(spark, {"twice": "(x BIGINT) RETURNS BIGINT RETURN x * 2"}, source)
    catalog.sync_views(spark, {"a_high": "SELECT * FROM b_wide WHERE level > 5", "b_wide": "SELECT * FROM zones WHERE radius >= 10000"}, source)

    there = catalog.objects(spark, [source])
    said = catalog.sync_tables(spark, catalog.chosen([], there, "table"), source, target).where("name <> 'places'")
    said = said.unionByName(catalog.sync_tables(spark, catalog.chosen(["places"], there, "table"), source, target, clean=False))
    catalog.sync_functions(spark, catalog.function_signatures(spark, catalog.chosen([], there, "function"), source), target)
    catalog.sync_views(spark, catalog.view_bodies(spark, catalog.chosen([], there, "view"), source), target)

    names = [(r["kind"], r["name"]) for r in catalog.objects(spark, [target]).where("kind <> 'function'").collect()]  # names of catalog objects, not data
    counted = [spark.table(f"{target}.{name}").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), "n") for kind, name in names]
    counted.append(nations.select(F.expr(f"{target}.twice(n_nationkey)").alias("x")).agg(F.sum("x").alias("n")).select(F.lit("function").alias("kind"), F.lit("twice").alias("name"), "n"))
    return reduce(DataFrame.unionByName, counted).join(said.select("name", F.col("rows").alias("said")), "name", "left").select("kind", "name", "n", "said")


@query(f"""WITH {SQL_ROUTES}, p AS (SELECT route_id, 0 AS step, x1 AS x, y1 AS y FROM ends UNION ALL SELECT route_id, 1, (x1+x2)/2+0.3e0, (y1+y2)/2 FROM ends UNION ALL SELECT route_id, 2, x2, y2 FROM ends)
    SELECT route_id, '['||string_agg('{{"lng":'||{_d('x')}||',"lat":'||{_d('y')}||',"alt":'||{_d('50e0+step*10e0')}||'}}', ',' ORDER BY step)||']' AS plan FROM p GROUP BY route_id""")
def routes_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of routes as JSON arrays of points."""
    points = derived.routes(spark, sf_dir).select("route_id", F.posexplode("line").alias("step", "p"))
    six = lambda c: c.cast("decimal(18,6)")
    plan = points.select("route_id", F.lit(True).alias("found"), "step", six(F.get("p", F.lit(0))).alias("lng"), six(F.get("p", F.lit(1))).alias("lat"), six(F.lit(50.0) + F.col("step") * 10.0).alias("alt"))
    return flight.as_json(plan).select("route_id", "plan")
