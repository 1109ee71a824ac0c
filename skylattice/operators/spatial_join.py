"""Range joins of points and rectangles by buckets: an equi-join on the bucket, then the exact test.

A point lies in one bucket and a rectangle in all it touches, so a pair meets once. Two rectangles meet in several buckets; the pair
counts only in the bucket of the south-west corner of what they share, so nothing needs a distinct. A bucket with very many points is
split by adaptive execution, as both sides of the join are plain shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("lat_min", "lat_max", "lng_min", "lng_max")


def bucket(c: Column, width: float) -> Column:
    return F.floor(c / F.lit(float(width)))


def spread(rects: DataFrame, width: float) -> DataFrame:
    """rects once for each bucket it touches, with _bx and _by."""
    along = lambda low, high: F.explode(F.sequence(bucket(F.col(low), width), bucket(F.col(high), width)))
    valid = rects.where("lat_min <= lat_max AND lng_min <= lng_max")  # drops nulls too: they contain nothing
    return valid.withColumn("_bx", along("lng_min", "lng_max")).withColumn("_by", along("lat_min", "lat_max"))


def points_in_rectangles(points: DataFrame, rects: DataFrame, width: float) -> DataFrame:
    """points(lat, lng, ...) joined with the rects(lat_min, lat_max, lng_min, lng_max, ...) that hold them, edges included. Other columns must differ."""
    dealt = points.withColumn("_bx", bucket(F.col("lng"), width)).withColumn("_by", bucket(F.col("lat"), width))
    inside = F.col("lat").between(F.col("lat_min"), F.col("lat_max")) & F.col("lng").between(F.col("lng_min"), F.col("lng_max"))
    return dealt.join(spread(rects, width), ["_bx", "_by"]).where(inside).drop("_bx", "_by")


def meeting_rectangles(left: DataFrame, right: DataFrame, width: float) -> DataFrame:
    """Pairs of rectangles that share a point; right's sides are renamed to right_lat_min and so on. Other columns must differ."""
    a = spread(left, width)
    b = spread(right, width).withColumnsRenamed({c: f"right_{c}" for c in SIDES})
    low_lng, low_lat = F.greatest("lng_min", "right_lng_min"), F.greatest("lat_min", "right_lat_min")
    meet = (low_lng <= F.least("lng_max", "right_lng_max")) & (low_lat <= F.least("lat_max", "right_lat_max"))
    once = (bucket(low_lng, width) == F.col("_bx")) & (bucket(low_lat, width) == F.col("_by"))
    return a.join(b, ["_bx", "_by"]).where(meet & once).drop("_bx", "_by")


def uncovered(points: DataFrame, rects: DataFrame, width: float, key: str) -> DataFrame:
    """The points that no rectangle holds; key names a point."""
    found = points_in_rectangles(points.select(key, "lat", "lng"), rects.select(*SIDES), width).select(key)
    return points.join(found, key, "left_anti")
