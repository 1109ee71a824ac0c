"""Finding a region by name: ranked matches, codes, bounds, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("lat_min", "lat_max", "lng_min", "lng_max")


def match_rank(name: Column, wanted: str) -> Column:
    """1 for the name itself, 2 for a name that contains it (its % and _ are ordinary letters), else null."""
    return F.when(name == wanted, 1).when(F.contains(name, F.lit(wanted)), 2)


def best_matches(regions: DataFrame, wanted: str, n: int = 1) -> DataFrame:
    """The n best of regions(name, ...) with `rank`; ties go to the name that sorts first."""
    return regions.withColumn("rank", match_rank(F.col("name"), wanted)).where("rank IS NOT NULL").orderBy("rank", "name").limit(n)


def resolve(provinces: DataFrame, cities: DataFrame, configured: DataFrame, wanted: str) -> DataFrame:
    """One row, or none: the best province, else the best city, else a configured region; with its `level`."""
    found = None
    for order, (level, df) in enumerate((("province", provinces), ("city", cities), ("config", configured))):
        part = best_matches(df, wanted).withColumn("level", F.lit(level)).withColumn("_order", F.lit(order))
        found = part if found is None else found.unionByName(part, allowMissingColumns=True)
    return found.orderBy("_order").limit(1).drop("_order", "rank")


def code_of(cities: DataFrame, provinces: DataFrame, wanted: str) -> DataFrame:
    """level, code, name of the region with exactly this name, cities first."""
    part = lambda df, level, order: df.where(F.col("name") == wanted).select(F.lit(level).alias("level"), "code", "name", F.lit(order).alias("_order"))
    return part(cities, "city", 0).unionByName(part(provinces, "province", 1)).orderBy("_order", "code").limit(1).drop("_order")


def bounds_of(points: DataFrame, *keys: str) -> DataFrame:
    """keys and the least and largest latitude and longitude of points."""
    return points.groupBy(*keys).agg(F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lng").alias("lng_min"), F.max("lng").alias("lng_max"))
