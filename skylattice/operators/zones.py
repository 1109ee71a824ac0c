"""Restricted zones: geometry from loosely typed records, properties, labels, rows for a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.geo import circle_ring, envelope, multipolygon_wkt
from skylattice.operators.dedupe import first_wins
from skylattice.sources.dimensions import LEVELS, label

RINGS = "array<array<array<double>>>"
#: A zone record as providers send it.
SCHEMA = f"""area_id long, name string, type int, level int, shape int, lat double, lng double, radius double, polygon_points {RINGS},
    color string, country string, city string, address string, description string, url string, height double, begin_at double, end_at double,
    data_source double, sub_areas array<struct<shape: int, lat: double, lng: double, radius: double, polygon_points: {RINGS}>>"""
#: A geometry: a point has one coordinate in one ring of one polygon, a polygon is one polygon.
GEOMETRY = f"struct<kind: string, polygons: array<{RINGS}>>"
#: An answer, by the provider's field names.
ANSWER = f"code int, data struct<areas: array<struct<{SCHEMA}>>>"
PROPERTIES = ("area_id", "name", "type", "level", "level_name", "type_name", "color", "country", "city", "address", "description", "height", "radius", "begin_at", "end_at", "data_source", "url")


def given(c: Column, zero_is_missing: bool) -> Column:
    """True for a number that is there; older tables take 0 for missing."""
    return c.isNotNull() & (c != 0) if zero_is_missing else c.isNotNull()


def circle(lat: Column, lng: Column, radius: Column, zero_is_missing: bool) -> Column:
    """A polygon, or null where a value is missing; a radius of 0 is no circle in either case."""
    whole = given(lat, zero_is_missing) & given(lng, zero_is_missing) & given(radius, True)
    return F.when(whole, F.array(circle_ring(lat, lng, radius)))


def geometry(zero_is_missing: bool = False) -> Column:
    """The geometry of a record, null where nothing can be made of it.

    Sub-areas come first (a shape that isn't said is a polygon; place and radius are the zone's where the sub-area has none): one
    gives a polygon, several a multi-polygon. Else the zone's own shape (not said: a circle): polygon, circle, or the bare point.
    """
    lat, lng, radius, points = F.col("lat"), F.col("lng"), F.col("radius"), F.col("polygon_points")

    def part(s: Column) -> Column:
        shape = F.coalesce(s["shape"], F.lit(1))
        made = circle(F.coalesce(s["lat"], lat), F.coalesce(s["lng"], lng), F.coalesce(s["radius"], radius), zero_is_missing)
        return F.when((shape == 1) & (F.size(s["polygon_points"]) > 0), s["polygon_points"]).when(shape == 2, made)

    parts = F.filter(F.transform(F.coalesce("sub_areas", F.array().cast(f"array<struct<shape: int, lat: double, lng: double, radius: double, polygon_points: {RINGS}>>")), part), lambda p: p.isNotNull())
    shape = F.coalesce("shape", F.lit(2))
    own = circle(lat, lng, radius, zero_is_missing)
    made = lambda kind, polygons: F.struct(F.lit(kind).alias("kind"), polygons.alias("polygons"))
    return (
        F.when(F.size(parts) == 1, made("Polygon", parts))
        .when(F.size(parts) > 1, made("MultiPolygon", parts))
        .when((shape == 1) & (F.size(points) > 0), made("Polygon", F.array(points)))
        .when((shape == 2) & own.isNotNull(), made("Polygon", F.array(own)))
        .when(given(lat, zero_is_missing) & given(lng, zero_is_missing), made("Point", F.array(F.array(F.array(F.array(lng, lat))))))
    )


def from_answers(answers: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """The records of answers (JSON texts) with code 0, a row each, with the columns of the answer that are to be kept.

    One that is null, no JSON, failed or without areas gives none.
    """
    read = answers.select(*keep, F.from_json(body, ANSWER).alias("_answer")).where("_answer.code = 0")
    return read.select(*keep, F.explode("_answer.data.areas").alias("_area")).select(*keep, "_area.*")


def features(areas: DataFrame, type_labels: dict[int, str] | None = None, zero_is_missing: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """PROPERTIES, geometry and its box of the records that have a geometry; keep: columns that go along."""
    made = areas.withColumn("geometry", geometry(zero_is_missing)).where("geometry IS NOT NULL")
    made = made.withColumn("level_name", label(F.col("level"), LEVELS)).withColumn("type_name", label(F.col("type"), type_labels or {}))
    return made.select(*keep, *PROPERTIES, "geometry", *envelope(F.flatten(F.flatten(F.col("geometry.polygons")))))


def unique(found: DataFrame, order: list[str]) -> DataFrame:
    """The first of each area_id in order; zones without one, or with 0, are left out."""
    return first_wins(found.where("area_id <> 0"), ["area_id"], order, keep_missing=False)


def at_levels(areas: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """Records of some levels (all known ones unless said): a filter that Parquet can skip by."""
    return areas.where(F.col("level").isin(*(LEVELS if levels is None else levels)))


def table_rows(found: DataFrame, region: dict[str, str | None] | None = None, holes: bool = True) -> DataFrame:
    """Rows of the zone table: properties under the table's names, the region's codes, the geometry as WKT (a bare point has none)."""
    region = region or {}
    wkt = F.when(F.col("geometry.kind") != "Point", multipolygon_wkt(F.col("geometry.polygons"), holes))
    constant = [F.lit(region.get(c)).cast("string").alias(c) for c in ("shiid", "shicode", "shiname", "shengcode", "shengid", "shengname")]
    own = [F.col(c).alias({"description": "descriptio", "data_source": "data_sourc"}.get(c, c)) for c in PROPERTIES]
    return found.select(*own, *constant, wkt.alias("geom"))


def with_lookup(rows: DataFrame, lookup: DataFrame, key: str = "city") -> DataFrame:
    """table_rows() with the region's codes of lookup(name, shiid, shicode, ...): by the name of each zone's city, or all but the last letter of the looked-up name as its beginning.

    Of several the name itself counts before its beginning, then the longer, then the one that sorts first. Rows without one keep what they have.
    A lookup has a row a city, and zones are joined with it by the first letter, so that no zone meets all of them.
    """
    columns = [c for c in lookup.columns if c != "name"]
    named = lookup.select(F.trim("name").alias("_name"), *[F.col(c).cast("string").alias(f"_{c}") for c in columns]).where("_name <> ''")
    stem = F.expr("substring(_name, 1, greatest(length(_name) - 1, 1))")
    mine = rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_own", F.trim(key))
    near = mine.select("_id", "_own").where("_own <> ''").join(named, F.substring("_own", 1, 1) == F.substring("_name", 1, 1)).where((F.col("_own") == F.col("_name")) | F.col("_own").startswith(stem))
    order = F.struct((F.col("_own") != F.col("_name")).alias("other"), (-F.length("_name")).alias("short"), F.col("_name"), *[F.col(f"_{c}") for c in columns])
    best = near.groupBy("_id").agg(F.min(order).alias("_best"))
    joined = mine.join(best, "_id", "left")
    return joined.select(*[F.coalesce(F.col(f"_best._{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])
