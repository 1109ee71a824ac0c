"""Planar geometry on longitude and latitude as column functions: 111 km a degree, longitude shrunk by the cosine of the latitude."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KM = 111.0
METRES = KM * 1000.0
#: Corners of the polygon that stands for a circle.
CORNERS = 36


class Bounds(NamedTuple):
    """South, north, west, east in degrees."""

    lat_min: float
    lat_max: float
    lng_min: float
    lng_max: float


def counts(bounds: Bounds, cell_m: float) -> tuple[int, int]:
    """Rows and columns of a grid of cells of cell_m metres."""
    if cell_m <= 0:
        raise ValueError("cells need a size above 0")
    km, middle = cell_m / 1000.0, (bounds.lat_min + bounds.lat_max) / 2
    lat = int((bounds.lat_max - bounds.lat_min) * KM / km) + 1
    lng = int((bounds.lng_max - bounds.lng_min) * KM * abs(math.cos(math.radians(middle))) / km) + 1
    return max(1, lat), max(1, lng)


def grid(spark: SparkSession, bounds: Bounds, cell_m: float, compat: bool = False) -> DataFrame:
    """idx, lat, lng: cell centres row by row from the north-west, numbered from 1.

    compat: a lone row or column is centred on its northern or western edge, as older tables have it. The grid comes from range(),
    so it is dealt out over tasks and its size is known to the optimiser.
    """
    rows, cols = counts(bounds, cell_m)
    half = lambda n: 0.0 if compat and n == 1 else (1.0 / n) / 2
    tall, wide = bounds.lat_max - bounds.lat_min, bounds.lng_max - bounds.lng_min
    i, j = F.floor(F.col("id") / F.lit(cols)), F.pmod(F.col("id"), F.lit(cols))
    step = lambda extent, n: 0.0 if n == 1 else extent / n
    lat = F.lit(bounds.lat_max) - i * F.lit(step(tall, rows)) - F.lit(step(tall, rows) / 2 if rows > 1 else tall * half(1))
    lng = F.lit(bounds.lng_min) + j * F.lit(step(wide, cols)) + F.lit(step(wide, cols) / 2 if cols > 1 else wide * half(1))
    clamp = lambda x, low, high: F.least(F.greatest(x, F.lit(low)), F.lit(high))
    return spark.range(rows * cols).select(
        (F.col("id") + 1).alias("idx"), clamp(lat, bounds.lat_min, bounds.lat_max).alias("lat"), clamp(lng, bounds.lng_min, bounds.lng_max).alias("lng")
    )


def grids(regions: DataFrame, cell_m: Column) -> DataFrame:
    """regions' columns and idx, lat, lng: one row per cell of every region (lat_min, lat_max, lng_min, lng_max); each region counts from 1."""
    km = cell_m / 1000.0
    tall, wide = F.col("lat_max") - F.col("lat_min"), F.col("lng_max") - F.col("lng_min")
    rows = F.greatest(F.lit(1), (tall * KM / km).cast("int") + 1)
    cols = F.greatest(F.lit(1), (wide * KM * F.abs(F.cos(F.radians((F.col("lat_min") + F.col("lat_max")) / 2))) / km).cast("int") + 1)
    sized = regions.select("*", rows.alias("_rows"), cols.alias("_cols"))
    cells = sized.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_cols") - 1)))
    lat_step, lng_step = tall / F.col("_rows"), wide / F.col("_cols")
    return cells.select(
        *regions.columns,
        (F.col("_i").cast("long") * F.col("_cols") + F.col("_j") + 1).alias("idx"),
        (F.col("lat_max") - F.col("_i") * lat_step - lat_step / 2).alias("lat"),
        (F.col("lng_min") + F.col("_j") * lng_step + lng_step / 2).alias("lng"),
    )


def rectangle(lat: Column, lng: Column, radius_m: Column | float) -> list[Column]:
    """lat_min, lat_max, lng_min, lng_max of the square that reaches radius_m metres from a centre."""
    r = (radius_m if isinstance(radius_m, Column) else F.lit(float(radius_m))) / 1000.0
    dlat, dlng = r / KM, r / (F.lit(KM) * F.abs(F.cos(F.radians(lat))))
    return [(lat - dlat).alias("lat_min"), (lat + dlat).alias("lat_max"), (lng - dlng).alias("lng_min"), (lng + dlng).alias("lng_max")]


def circle_ring(lat: Column, lng: Column, radius_m: Column) -> Column:
    """Closed ring of CORNERS corners, counter-clockwise from due east: array of [lng, lat]."""
    r = radius_m / METRES
    turn = lambda i: (i % CORNERS) * F.lit(2 * math.pi / CORNERS)
    return F.transform(
        F.sequence(F.lit(0), F.lit(CORNERS)),
        lambda i: F.array(lng + r * F.cos(turn(i)) / F.cos(F.radians(lat)), lat + r * F.sin(turn(i))),
    )


def fixed(x: Column, places: int = 6) -> Column:
    """A number with so many decimals."""
    return x.cast(f"decimal(18,{places})").cast("string")


def point_text(lng: Column, lat: Column) -> Column:
    """A point as extended WKT in degrees (SRID 4326), six decimals; null where a coordinate is missing."""
    return F.concat(F.lit("SRID=4326;POINT("), fixed(lng), F.lit(" "), fixed(lat), F.lit(")"))


def map_bound(b: Bounds | None = None, text=lambda c: c.cast("string")) -> Column:
    """`west,south,east,north` of columns lat_min .. lng_max."""
    return F.concat_ws(",", *(text(F.col(c)) for c in ("lng_min", "lat_min", "lng_max", "lat_max")))


def corner_pair(text=lambda c: c.cast("string")) -> Column:
    """`west,north|east,south`."""
    point = lambda x, y: F.concat_ws(",", text(F.col(x)), text(F.col(y)))
    return F.concat_ws("|", point("lng_min", "lat_max"), point("lng_max", "lat_min"))


def closed_polygon(text=lambda c: c.cast("string")) -> Column:
    """The rectangle's five points from the north-west over the north-east, closed."""
    ring = [("lng_min", "lat_max"), ("lng_max", "lat_max"), ("lng_max", "lat_min"), ("lng_min", "lat_min"), ("lng_min", "lat_max")]
    return F.concat_ws(",", *(text(F.col(c)) for p in ring for c in p))


def metres_between(lat: Column, lng: Column, lat2: Column, lng2: Column) -> Column:
    """Planar distance in metres, with the first point's latitude."""
    dy, dx = (lat2 - lat) * METRES, (lng2 - lng) * METRES * F.cos(F.radians(lat))
    return F.sqrt(dx * dx + dy * dy)


def envelope(points: Column) -> list[Column]:
    """lat_min, lat_max, lng_min, lng_max of an array of [lng, lat]."""
    of = lambda i: F.transform(points, lambda p: F.get(p, F.lit(i)))
    return [F.array_min(of(1)).alias("lat_min"), F.array_max(of(1)).alias("lat_max"), F.array_min(of(0)).alias("lng_min"), F.array_max(of(0)).alias("lng_max")]


def multipolygon_wkt(polygons: Column, holes: bool = True) -> Column:
    """WKT of an array of polygons (arrays of rings of [lng, lat]), six decimals; holes=False keeps outer rings only."""
    point = lambda p: F.concat_ws(" ", fixed(F.get(p, F.lit(0))), fixed(F.get(p, F.lit(1))))
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, point), ","), F.lit(")"))
    rings = lambda p: F.transform(p if holes else F.slice(p, 1, 1), ring)
    polygon = lambda p: F.concat(F.lit("("), F.array_join(rings(p), ","), F.lit(")"))
    return F.when(F.size(polygons) > 0, F.concat(F.lit("MULTIPOLYGON("), F.array_join(F.transform(polygons, polygon), ","), F.lit(")")))
