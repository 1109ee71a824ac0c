"""Whole runs over landed records: region, grid, containment, dedupe, filter, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions.geo import Bounds, grid, rectangle
from skylattice.operators.dedupe import first_wins
from skylattice.operators.poi import around, in_region, type_shares, with_fallback
from skylattice.operators.spatial_join import meeting_rectangles, points_in_rectangles
from skylattice.operators.zones import unique


def cells(spark: SparkSession, bounds: Bounds, cell_m: float, compat: bool = False) -> DataFrame:
    """idx and the sides of each cell's square: full cell size around the centre, so neighbours overlap."""
    return grid(spark, bounds, cell_m, compat).select("idx", *rectangle(F.col("lat"), F.col("lng"), cell_m / 2))


def bucket_width(cell_m: float) -> float:
    """Degrees of a bucket about as wide as a cell."""
    return max(cell_m / 111_000.0, 1e-3)


def cell_hits(points: DataFrame, squares: DataFrame, cell_m: float) -> DataFrame:
    """points with the idx of every cell that holds them."""
    return points_in_rectangles(points, squares, bucket_width(cell_m)).drop("lat_min", "lat_max", "lng_min", "lng_max")


def region_points(points: DataFrame, bounds: Bounds, cell_m: float, key: str = "poi_id", name: str | None = None, level: str | None = None, compat: bool = False) -> DataFrame:
    """Points of a region: found by cell, the first hit of each key in order of cell, then the region filter."""
    hits = cell_hits(points, cells(points.sparkSession, bounds, cell_m, compat), cell_m)
    found = first_wins(hits, [key], ["idx"])
    return in_region(found, name, level) if name else found


def points_around(points: DataFrame, lat: float, lng: float, radius_m: float) -> DataFrame:
    """Points of a run around one place: all hits, repeats of a key included."""
    return around(points, lat, lng, radius_m)


def zones_around(found: DataFrame, lat: float, lng: float, radius_m: float) -> DataFrame:
    """Zones (with the sides of their boxes) that meet the square around a place, repeats included."""
    south, north, west, east = rectangle(F.lit(float(lat)), F.lit(float(lng)), radius_m)
    return found.where((F.col("lat_max") >= south) & (F.col("lat_min") <= north) & (F.col("lng_max") >= west) & (F.col("lng_min") <= east))


def region_type_stats(points: DataFrame, bounds: Bounds, cell_m: float, key: str = "poi_id") -> DataFrame:
    """Count and percentage of each type in a region, most frequent first."""
    return type_shares(region_points(points, bounds, cell_m, key)).orderBy(F.desc("n"), "type_code")


def bounds_points(first: DataFrame, second: DataFrame, key: str = "poi_id") -> DataFrame:
    """Points by cell (idx) of one search, for cells without any those of another, then the first of each key."""
    return first_wins(with_fallback(first, second, "idx"), [key], ["idx", "kw", "page", "pos"])


def region_zones(found: DataFrame, bounds: Bounds, cell_m: float) -> DataFrame:
    """Zones (with the sides of their boxes) that meet a cell, the first hit of each area_id in order of cell."""
    squares = cells(found.sparkSession, bounds, cell_m)
    hits = meeting_rectangles(found, squares, bucket_width(cell_m))
    return unique(hits, ["idx"]).drop("right_lat_min", "right_lat_max", "right_lng_min", "right_lng_max")
