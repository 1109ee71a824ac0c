"""Lines and polygons against polygons, exactly, by joins of single pieces.

Rings are dealt out as pieces, a row each, into the buckets that a piece passes through (not all of its box, so that a long piece costs
its length). Pieces of both sides meet in a bucket and are tested with plain column arithmetic. Two polygons share a point if pieces of
theirs do, touching included, or if a corner of one part lies inside the other by the even-odd rule over all rings of a polygon; so what
lies in a hole is outside. Keys can be structs. Null and empty geometries meet nothing.

Geometry is compared once for each different shape: rows are grouped by a name of their exact coordinates, pairs are found and made distinct
between shapes, and only then joined with the keys of the rows. A key has one shape, so the pairs of keys need no distinct of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.geo import METRES
from skylattice.operators.spatial_join import bucket, points_in_rectangles

#: Degrees that bucket borders are widened by, against rounding.
SLACK = 1e-9


def named(of: Column) -> Column:
    """128 bits of SHA-256 over the exact values: equal ones share the name."""
    return F.substring(F.unhex(F.sha2(of.cast("string"), 256)), 1, 16)


def figures(df: DataFrame, key: Column, name: str, *rest: str) -> tuple[DataFrame, DataFrame]:
    """Rows and shapes of df(polygons, rest): `name` (the key, once) with its shape, and the different shapes with polygons and rest (numbers).

    All rows of a key make up one shape.
    """
    whole = df.where("polygons IS NOT NULL").groupBy(key.alias(name)).agg(F.sort_array(F.collect_set(F.struct("polygons", *rest))).alias("of"))
    found = whole.withColumn("shape", named(F.col("of")))
    return found.select(name, "shape"), found.groupBy("shape").agg(F.first("of").alias("of")).select("shape", F.inline("of"))


def expanded(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of shapes (left, right) as pairs of the rows that have them: left(shape, ...), right(shape, ...). Other columns must differ.

    A task holds its share of the rows in a hash table and streams the pairs past it: what grows with both sides is never sorted or held.
    """
    held = pairs.join(right.withColumnRenamed("shape", "right").hint("shuffle_hash"), "right").drop("right")
    return held.join(left.withColumnRenamed("shape", "left").hint("shuffle_hash"), "left").drop("left")


def pieces(df: DataFrame, key: Column, polygons: Column) -> DataFrame:
    """key, part (number of the polygon), x1, y1, x2, y2 of every piece of every ring."""
    rings = df.select(key.alias("key"), F.posexplode(polygons).alias("part", "rings")).select("key", "part", F.explode("rings").alias("ring"))
    n = F.greatest(F.size("ring") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice("ring", F.lit(1), n).alias("a"), F.slice("ring", F.lit(2), n).alias("b"))
    at = lambda p, i: F.get(F.col(f"p.{p}"), F.lit(i))
    return rings.select("key", "part", F.explode(pairs).alias("p")).select("key", "part", at("a", 0).alias("x1"), at("a", 1).alias("y1"), at("b", 0).alias("x2"), at("b", 1).alias("y2"))


def dealt(found: DataFrame, width: float) -> DataFrame:
    """pieces once for each bucket they pass through, with _bx and _by."""
    low, high = F.least("x1", "x2"), F.greatest("x1", "x2")
    columns = found.withColumn("_bx", F.explode(F.sequence(bucket(low - SLACK, width), bucket(high + SLACK, width))))
    slope = (F.col("y2") - F.col("y1")) / F.nullif(F.col("x2") - F.col("x1"), F.lit(0.0))
    at = lambda x: F.col("y1") + (F.least(F.greatest(x, low), high) - F.col("x1")) * slope
    west, east = at(F.col("_bx") * F.lit(float(width))), at((F.col("_bx") + 1) * F.lit(float(width)))
    # an upright piece has no slope: all of its height
    south = F.when(slope.isNull(), F.least("y1", "y2")).otherwise(F.least(west, east)) - SLACK
    north = F.when(slope.isNull(), F.greatest("y1", "y2")).otherwise(F.greatest(west, east)) + SLACK
    return columns.withColumn("_by", F.explode(F.sequence(bucket(south, width), bucket(north, width))))


def share_a_point(a: str, b: str) -> Column:
    """True for two pieces (aliases) that cross or touch."""
    x1, y1, x2, y2 = (F.col(f"{a}.{c}") for c in ("x1", "y1", "x2", "y2"))
    u1, v1, u2, v2 = (F.col(f"{b}.{c}") for c in ("x1", "y1", "x2", "y2"))
    side = lambda p, q, r, s, x, y: (r - p) * (y - q) - (s - q) * (x - p)
    boxes = (F.least(x1, x2) <= F.greatest(u1, u2)) & (F.greatest(x1, x2) >= F.least(u1, u2)) & (F.least(y1, y2) <= F.greatest(v1, v2)) & (F.greatest(y1, y2) >= F.least(v1, v2))
    apart = (side(x1, y1, x2, y2, u1, v1) * side(x1, y1, x2, y2, u2, v2) > 0) | (side(u1, v1, u2, v2, x1, y1) * side(u1, v1, u2, v2, x2, y2) > 0)
    return boxes & ~apart


def tasks(df: DataFrame) -> int:
    """Tasks for joins whose rows are many more than their input's size says, so that adaptive execution makes too few."""
    return df.sparkSession.sparkContext.defaultParallelism * 4


def touching(left: DataFrame, right: DataFrame, width: float) -> DataFrame:
    """Distinct left and right (keys) of pieces that share a point."""
    a = dealt(left, width).withColumnRenamed("key", "left").repartition(tasks(left), "_bx", "_by").alias("a")
    b = dealt(right, width).withColumnRenamed("key", "right").alias("b")
    near = a.join(b, [F.col("a._bx") == F.col("b._bx"), F.col("a._by") == F.col("b._by")])
    return near.where(share_a_point("a", "b")).select("left", "right").distinct()


def holding(points: DataFrame, of: DataFrame, width: float) -> DataFrame:
    """Distinct left (key of points(left, x, y)) and right (key of pieces) of points inside a polygon, by the even-odd rule.

    A point is joined with the boxes that hold it, then with their polygon's pieces; crossings are counted before the shuffle.
    """
    sides = [F.min(F.least("y1", "y2")).alias("lat_min"), F.max(F.greatest("y1", "y2")).alias("lat_max"), F.min(F.least("x1", "x2")).alias("lng_min"), F.max(F.greatest("x1", "x2")).alias("lng_max")]
    boxes = of.groupBy("key", "part").agg(*sides)
    inside = points_in_rectangles(points.select("left", F.col("x").alias("lng"), F.col("y").alias("lat")), boxes, width).select("left", "lng", "lat", "key", "part").repartition(tasks(of), "key", "part")
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    crosses = ((y1 > F.col("lat")) != (y2 > F.col("lat"))) & (F.col("lng") < (x2 - x1) * (F.col("lat") - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1)
    counted = inside.join(of, ["key", "part"]).groupBy("left", "lng", "lat", "key", "part").agg(F.count_if(crosses).alias("n"))
    return counted.where("n % 2 = 1").select("left", F.col("key").alias("right")).distinct()


def corners(df: DataFrame, key: Column, polygons: Column) -> DataFrame:
    """left (the key), x, y: the first corner of each polygon of each row."""
    first = df.select(key.alias("left"), F.explode(polygons).alias("rings")).select("left", F.get(F.get("rings", F.lit(0)), F.lit(0)).alias("p"))
    return first.select("left", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")


def meeting(left: DataFrame, right: DataFrame, width: float = 0.25) -> DataFrame:
    """Distinct left and right of shapes(shape, polygons) that share a point."""
    key, polygons = F.col("shape"), F.col("polygons")
    a, b = pieces(left, key, polygons), pieces(right, key, polygons)
    found = touching(a, b, width).unionByName(holding(corners(left, key, polygons), b, width))
    turned = holding(corners(right, key, polygons), a, width).select(F.col("right").alias("left"), F.col("left").alias("right"))
    return found.unionByName(turned).distinct()


def meeting_rows(left: DataFrame, right: DataFrame, allowed: Column, width: float = 0.25) -> DataFrame:
    """Distinct left and right of shapes that have rows (shape, polygons, left_kind; right_kind) which share a point and are allowed; equal polygons of many kinds are compared once."""
    a, b = left.withColumn("_of", named(F.col("polygons"))), right.withColumn("_of", named(F.col("polygons")))
    once = lambda df: df.groupBy(F.col("_of").alias("shape")).agg(F.first("polygons").alias("polygons")).where("shape IS NOT NULL")
    pairs = meeting(once(a), once(b), width).select(F.col("left").alias("_one"), F.col("right").alias("_two"))
    found = pairs.join(a.select(F.col("_of").alias("_one"), F.col("shape").alias("left"), "left_kind"), "_one").join(b.select(F.col("_of").alias("_two"), F.col("shape").alias("right"), "right_kind"), "_two")
    return found.where(allowed).select("left", "right").distinct()


def overlapping(left: DataFrame, left_key: Column, right: DataFrame, right_key: Column, width: float = 0.25) -> DataFrame:
    """Distinct left and right (keys) of rows whose `polygons` share a point."""
    (own, a), (there, b) = figures(left, left_key, "_left"), figures(right, right_key, "_right")
    return expanded(meeting(a, b, width), own, there).select(F.col("_left").alias("left"), F.col("_right").alias("right"))


def of_keys(found: DataFrame, keys: DataFrame) -> DataFrame:
    """left and right (_key) of left and right (shapes)."""
    return found.join(keys.withColumnRenamed("shape", "right"), "right").select("left", F.col("_key").alias("right"))


def lines_across(lines: DataFrame, key: Column, fences: DataFrame, fence_key: Column, width: float = 0.25) -> DataFrame:
    """Distinct left (key of lines with x1, y1, x2, y2) and right (key of fences with `polygons`) of straight lines that touch a fence or begin in it."""
    own = lines.select(key.alias("key"), "x1", "y1", "x2", "y2")
    keys, shapes = figures(fences, fence_key, "_key")
    there = pieces(shapes, F.col("shape"), F.col("polygons"))
    starts = own.select(F.col("key").alias("left"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    found = touching(own, there, width).unionByName(holding(starts, there, width)).distinct()
    return of_keys(found, keys)


def gap_m(a: str, b: str, shrink: Column) -> Column:
    """The least distance in metres of the ends of one piece (alias) to another piece, planar; shrink: the cosine that scales longitudes."""
    x1, y1, x2, y2 = (F.col(f"{a}.{c}") for c in ("x1", "y1", "x2", "y2"))
    dx, dy = (x2 - x1) * shrink, y2 - y1

    def of(x: Column, y: Column) -> Column:
        along = F.coalesce(((x - x1) * shrink * dx + (y - y1) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
        t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
        px, py = (x - x1) * shrink - t * dx, y - y1 - t * dy
        return px * px + py * py

    return F.sqrt(F.least(of(F.col(f"{b}.x1"), F.col(f"{b}.y1")), of(F.col(f"{b}.x2"), F.col(f"{b}.y2")))) * METRES


def lines_near(lines: DataFrame, key: Column, fences: DataFrame, fence_key: Column, metres: float, width: float = 0.25) -> DataFrame:
    """Distinct left (key of lines with `line`, an array of [lng, lat]) and right (key of fences with `polygons`) of lines that come within so many metres of a fence, or enter it.

    Pieces of both sides meet in the buckets of the lines' pieces, grown by the distance, and are measured with plain arithmetic. A lone point counts
    as a piece without length. The cosine is that of the middle of the line's box.
    """
    point = F.when(F.size("line") == 1, F.concat("line", "line")).otherwise(F.col("line"))
    lat = F.transform("line", lambda p: F.get(p, F.lit(1)))
    of = lines.select(F.struct(key.alias("key"), F.cos(F.radians((F.array_min(lat) + F.array_max(lat)) / 2)).alias("shrink")).alias("k"), F.array(F.array(point)).alias("polygons"))
    keys, shapes = figures(fences, fence_key, "_key")
    own, there = pieces(of, F.col("k"), F.col("polygons")), pieces(shapes, F.col("shape"), F.col("polygons"))
    tall = F.lit(metres / METRES)
    # at the latitude of the piece's far end, where a metre is most degrees
    wide = tall / F.cos(F.radians(F.least(F.greatest(F.abs("y1"), F.abs("y2")) + tall, F.lit(89.0))))
    wide = F.greatest(wide, tall / F.col("key.shrink"))
    a = own.withColumn("lat_min", F.least("y1", "y2") - tall).withColumn("lat_max", F.greatest("y1", "y2") + tall).withColumn("lng_min", F.least("x1", "x2") - wide).withColumn("lng_max", F.greatest("x1", "x2") + wide)
    by = lambda low, high: F.explode(F.sequence(bucket(F.col(low), width), bucket(F.col(high), width)))
    a = a.withColumn("_bx", by("lng_min", "lng_max")).withColumn("_by", by("lat_min", "lat_max")).alias("a")
    b = dealt(there, width).alias("b")
    boxes = (F.least("b.x1", "b.x2") <= F.col("a.lng_max")) & (F.greatest("b.x1", "b.x2") >= F.col("a.lng_min")) & (F.least("b.y1", "b.y2") <= F.col("a.lat_max")) & (F.greatest("b.y1", "b.y2") >= F.col("a.lat_min"))
    shrink = F.col("a.key.shrink")
    close = F.least(gap_m("a", "b", shrink), gap_m("b", "a", shrink)) <= metres
    near = a.join(b, [F.col("a._bx") == F.col("b._bx"), F.col("a._by") == F.col("b._by")]).where(boxes & (share_a_point("a", "b") | close))
    first = of.select(F.col("k").alias("left"), F.get(F.get(F.get(F.get("polygons", F.lit(0)), F.lit(0)), F.lit(0)), F.lit(0)).alias("x"), F.get(F.get(F.get(F.get("polygons", F.lit(0)), F.lit(0)), F.lit(0)), F.lit(1)).alias("y"))
    found = near.select(F.col("a.key.key").alias("left"), F.col("b.key").alias("right")).unionByName(holding(first, there, width).select("left.key", "right").withColumnRenamed("key", "left"))
    return of_keys(found.distinct(), keys)
