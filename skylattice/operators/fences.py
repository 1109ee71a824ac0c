"""Fences: points in polygons, routes across and near them, conflicts, fences of a project.

The behaviour follows documented rules; the design is our own. Rings are arrays of [lng, lat]. Every join goes by buckets, with the exact
test on the pair, written with array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.geo import METRES
from skylattice.operators.overlap import expanded, figures, meeting, meeting_rows, named
from skylattice.operators.spatial_join import SIDES, meeting_rectangles, points_in_rectangles

#: Kinds of fences; a new fence of a kind must not meet fences of the kinds listed.
NO_FLY, CONTROLLED, TRIAL = 1, 2, 3
FORBIDDEN = {NO_FLY: (), CONTROLLED: (NO_FLY,), TRIAL: (NO_FLY, CONTROLLED)}


def edges(ring: Column) -> Column:
    """The ring's or line's pieces: array of struct<x1, y1, x2, y2>."""
    n = F.size(ring)
    at = lambda i, k: F.get(F.get(ring, i), F.lit(k))
    piece = lambda i: F.struct(at(i - 1, 0).alias("x1"), at(i - 1, 1).alias("y1"), at(i, 0).alias("x2"), at(i, 1).alias("y2"))
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), piece)).otherwise(F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>"))


def in_ring(lng: Column, lat: Column, ring: Column) -> Column:
    """True for a point inside by the even-odd rule."""
    crosses = lambda e: ((e["y1"] > lat) != (e["y2"] > lat)) & (lng < (e["x2"] - e["x1"]) * (lat - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])
    return F.size(F.filter(edges(ring), crosses)) % 2 == 1


def in_polygons(lng: Column, lat: Column, polygons: Column) -> Column:
    """True for a point in any polygon: in its outer ring and in no other, by the even-odd rule over its rings."""
    rings = lambda p: F.size(F.filter(p, lambda r: in_ring(lng, lat, r))) % 2 == 1
    return F.exists(polygons, rings)


def side(x1: Column, y1: Column, x2: Column, y2: Column, x: Column, y: Column) -> Column:
    return (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)


def cross(a: Column, b: Column) -> Column:
    """True for two pieces that cross: each one's ends lie on different sides of the other."""
    one = side(a["x1"], a["y1"], a["x2"], a["y2"], b["x1"], b["y1"]) * side(a["x1"], a["y1"], a["x2"], a["y2"], b["x2"], b["y2"])
    two = side(b["x1"], b["y1"], b["x2"], b["y2"], a["x1"], a["y1"]) * side(b["x1"], b["y1"], b["x2"], b["y2"], a["x2"], a["y2"])
    return (one < 0) & (two < 0)


def gap_m(e: Column, lng: Column, lat: Column, shrink: Column) -> Column:
    """Metres from a point to a piece, planar; shrink: the cosine that scales longitudes."""
    x, y = lng * shrink, lat
    x1, dx, dy = e["x1"] * shrink, (e["x2"] - e["x1"]) * shrink, e["y2"] - e["y1"]
    along = F.coalesce(((x - x1) * dx + (y - e["y1"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    px, py = x - x1 - t * dx, y - e["y1"] - t * dy
    return F.sqrt(px * px + py * py) * METRES


def shaped(fences: DataFrame) -> DataFrame:
    """fences with the name of their polygons and sides."""
    return fences.withColumn("_shape", named(F.struct("polygons", *SIDES)))


def places_in_shapes(places: DataFrame, known: DataFrame, width: float) -> DataFrame:
    """Columns of places(lat, lng, ...) and the `_shape` of those of shaped() that hold them; each shape is tested once."""
    shapes = known.groupBy("_shape").agg(*[F.first(c).alias(c) for c in ("polygons", *SIDES)])
    held = points_in_rectangles(places, shapes, width).where(in_polygons(F.col("lng"), F.col("lat"), F.col("polygons")))
    return held.select(*places.columns, "_shape")


def points_in_fences(points: DataFrame, fences: DataFrame, width: float = 0.5) -> DataFrame:
    """Pairs of points(lat, lng, ...) and the fences(polygons, sides, ...) that hold them: different places are tested against different shapes, then joined with the rows."""
    known = shaped(fences)
    held = places_in_shapes(points.select("lat", "lng").distinct(), known, width)
    return held.join(known, "_shape").join(points, ["lat", "lng"]).select(*points.columns, *fences.columns)


def counted_in_fences(points: DataFrame, fences: DataFrame, width: float = 0.5) -> DataFrame:
    """fences(polygons, sides, ...) with n_points, the number of points(lat, lng) they hold; no pair is listed."""
    known = shaped(fences)
    held = places_in_shapes(points.groupBy("lat", "lng").agg(F.count("*").alias("n_points")), known, width)
    found = known.join(held.groupBy("_shape").agg(F.sum("n_points").alias("n_points")), "_shape", "left")
    return found.select(*fences.columns, F.coalesce("n_points", F.lit(0).cast("long")).alias("n_points"))


PIECES = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def boxed(lines: DataFrame, margin_m: float = 0.0) -> DataFrame:
    """lines(line: array of [lng, lat]) with their pieces (a lone point is one of no length) and the sides of their boxes, grown by a margin."""
    of = lambda k: F.transform("line", lambda p: F.get(p, F.lit(k)))
    x, y = (F.get(F.get("line", F.lit(0)), F.lit(k)) for k in (0, 1))
    point = F.array(F.struct(x.alias("x1"), y.alias("y1"), x.alias("x2"), y.alias("y2"))).cast(PIECES)
    dlat = margin_m / METRES
    grown = lines.withColumn("pieces", F.when(F.size("line") == 1, point).otherwise(edges(F.col("line"))))
    grown = grown.withColumn("lat_min", F.array_min(of(1)) - dlat).withColumn("lat_max", F.array_max(of(1)) + dlat)
    dlng = F.lit(dlat) / F.cos(F.radians(F.least(F.greatest(F.abs("lat_min"), F.abs("lat_max")), F.lit(89.0))))
    return grown.withColumn("margin_lng", dlng).withColumn("lng_min", F.array_min(of(0)) - dlng).withColumn("lng_max", F.array_max(of(0)) + dlng)


def met(routes: DataFrame, fences: DataFrame, margin_m: float, width: float) -> DataFrame:
    """Pairs of routes and fences whose boxes meet, with `near`, the route's pieces that meet the fence's grown box, and `sides_of`, the fence's pieces.

    Both sides' pieces are columns before the join, so no piece is made twice.
    """
    ready = fences.withColumn("sides_of", F.flatten(F.transform(F.flatten("polygons"), edges)))
    found = meeting_rectangles(boxed(routes, margin_m), ready, width)
    dlat = F.lit(margin_m / METRES)
    south, north = F.col("right_lat_min") - dlat, F.col("right_lat_max") + dlat
    west, east = F.col("right_lng_min") - F.col("margin_lng"), F.col("right_lng_max") + F.col("margin_lng")
    close = lambda p: (F.greatest(p["y1"], p["y2"]) >= south) & (F.least(p["y1"], p["y2"]) <= north) & (F.greatest(p["x1"], p["x2"]) >= west) & (F.least(p["x1"], p["x2"]) <= east)
    return found.withColumn("near", F.filter("pieces", close))


def enters() -> Column:
    """True if a line crosses an edge of the polygons or begins inside them; of met()."""
    first = F.get("line", F.lit(0))
    crossing = F.exists("near", lambda p: F.exists("sides_of", lambda e: cross(p, e)))
    return crossing | in_polygons(F.get(first, F.lit(0)), F.get(first, F.lit(1)), F.col("polygons"))


def comes_near(buffer_m: float) -> Column:
    """True if a line comes within buffer_m metres of the edges of polygons: ends of pieces to pieces, both ways; of met()."""
    shrink = F.cos(F.radians((F.col("lat_min") + F.col("lat_max")) / 2))
    ends = lambda e, p: (gap_m(e, p["x1"], p["y1"], shrink) <= buffer_m) | (gap_m(e, p["x2"], p["y2"], shrink) <= buffer_m)
    return F.exists("near", lambda p: F.exists("sides_of", lambda e: ends(e, p) | ends(p, e)))


def routes_across(routes: DataFrame, fences: DataFrame, width: float = 0.5) -> DataFrame:
    """Pairs of routes(line, ...) and the fences(polygons, sides, ...) they enter."""
    return met(routes, fences, 0.0, width).where(enters()).drop("pieces", "near", "sides_of", "margin_lng")


def routes_near(routes: DataFrame, fences: DataFrame, buffer_m: float, width: float = 0.5) -> DataFrame:
    """Pairs of routes and the fences that, grown by buffer_m metres, they touch. The grown fence is never built: its distance is tested."""
    return met(routes, fences, float(buffer_m), width).where(enters() | comes_near(float(buffer_m))).drop("pieces", "near", "sides_of", "margin_lng")


def conflicts(new: DataFrame, fences: DataFrame, width: float = 0.5) -> DataFrame:
    """Pairs of new fences (fence_type, sides, ...) and the others (right_type, sides, ...) that they meet and must not."""
    bad = F.lit(False)
    for kind, others in FORBIDDEN.items():
        if others:
            bad = bad | ((F.col("fence_type") == kind) & F.col("right_type").isin(*others))
    return meeting_rectangles(new, fences, width).where(bad)


def of_project(fences: DataFrame, area: DataFrame, kinds: tuple[int, ...] = (NO_FLY, TRIAL), width: float = 0.5) -> DataFrame:
    """Fences of some kinds that meet a project's area: area(project_id, sides), fences(fence_type, sides, ...)."""
    return meeting_rectangles(fences.where(F.col("fence_type").isin(*kinds)), area.select("project_id", *SIDES), width)


def polygon_conflicts(new: DataFrame, fences: DataFrame, width: float = 0.25) -> DataFrame:
    """new_id and area_id of new fences (new_id, fence_type, polygons) and others (area_id, fence_type, polygons) that they share a point with and must not."""
    (own, a), (there, b) = figures(new, F.col("new_id"), "new_id", "fence_type"), figures(fences, F.col("area_id"), "area_id", "fence_type")
    bad = F.lit(False)
    for kind, others in FORBIDDEN.items():
        if others:
            bad = bad | ((F.col("left_kind") == kind) & F.col("right_kind").isin(*others))
    found = meeting_rows(a.withColumnRenamed("fence_type", "left_kind"), b.withColumnRenamed("fence_type", "right_kind"), bad, width)
    return expanded(found, own, there).select("new_id", "area_id")


def polygons_of_project(fences: DataFrame, areas: DataFrame, kinds: tuple[int, ...] = (NO_FLY, TRIAL), width: float = 0.25) -> DataFrame:
    """project_id and the fences of some kinds whose polygons share a point with the project's area: areas(project_id, polygons), fences(area_id, fence_type, polygons, ...)."""
    chosen = fences.where(F.col("fence_type").isin(*kinds))
    (own, a), (there, b) = figures(areas, F.col("project_id"), "project_id"), figures(chosen, F.col("area_id"), "area_id")
    rest = [c for c in fences.columns if c != "area_id"]
    # the fences' columns are joined while each fence is still one row
    return expanded(meeting(a, b, width), own, there.join(chosen, "area_id")).select("area_id", "project_id", *rest)


def save_project_fences(found: DataFrame, schema: str, projects: list[str] | None = None) -> list[str]:
    """Replace the fences of the projects in polygons_of_project() in `schema.gis_electric_fence`, partitioned by project; others stay.

    projects: those to have a view of their own, named `gis_electric_fence_{project_id}`. Returns the views' names.
    """
    bad = [p for p in projects or [] if not p.replace("_", "").isalnum()]
    if bad:
        raise ValueError(f"no name for a table: {bad[0]}")
    spark = found.sparkSession
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
    table, ordered = f"{schema}.gis_electric_fence", [c for c in found.columns if c != "project_id"] + ["project_id"]
    writer = found.select(*ordered).withColumn("project_id", F.col("project_id").cast("string")).repartition("project_id", F.col("area_id") % 8)
    if spark.catalog.tableExists(table):
        mode = "spark.sql.sources.partitionOverwriteMode"  # insertInto() reads it from the session only
        before = spark.conf.get(mode)
        spark.conf.set(mode, "dynamic")
        try:
            writer.write.mode("overwrite").insertInto(table)
        finally:
            spark.conf.set(mode, before)
        left = {r[0] for r in found.where(F.col("project_id").cast("string").isin(projects)).select(F.col("project_id").cast("string")).distinct().collect()} if projects else set()
        for p in set(projects or []) - left:  # named projects that no fence meets any more
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (project_id = '{p}')")
    else:
        writer.write.partitionBy("project_id").saveAsTable(table)
    made = []
    for p in projects or []:
        spark.sql(f"CREATE OR REPLACE VIEW {schema}.gis_electric_fence_{p} AS SELECT * FROM {table} WHERE project_id = '{p}'")
        made.append(f"{schema}.gis_electric_fence_{p}")
    return made
