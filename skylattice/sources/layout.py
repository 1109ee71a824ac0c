"""Points laid out along a space-filling curve, with a box for each file, so that box searches read few files.

Longitude and latitude are cut into 2^16 steps each and their bits interleaved (Morton order), all in column functions. Rows are
dealt out by ranges of that number and sorted by it, so a crowded place takes more files and not larger ones. The boxes of the files, one row a
file, are a small table beside the rows; a search asks it first and opens the files that its boxes meet, and no others.

Defined results: rows without a place are kept in files without a box; no search finds them. Places outside the bounds count as on their edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions.geo import Bounds
from skylattice.operators.spatial_join import SIDES, meeting_rectangles, points_in_rectangles

BITS = 16
#: Files that are named one by one; a search that meets more reads the folder.
NAMED = 10_000
#: Masks that spread 16 bits over 32.
SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def curve(lng: Column, lat: Column, bounds: Bounds) -> Column:
    """The place along the curve: 0 to 2^32 - 1."""

    def steps(c: Column, low: float, high: float) -> Column:
        x = F.floor((c - F.lit(low)) / F.lit(high - low) * (1 << BITS))
        x = F.when(c.isNotNull(), F.least(F.greatest(x, F.lit(0)), F.lit((1 << BITS) - 1)).cast("long"))
        for by, mask in SPREAD:
            x = x.bitwiseOR(F.shiftleft(x, by)).bitwiseAND(F.lit(mask).cast("long"))
        return x

    return steps(lng, bounds.lng_min, bounds.lng_max).bitwiseOR(F.shiftleft(steps(lat, bounds.lat_min, bounds.lat_max), 1))


def save(points: DataFrame, path: str, bounds: Bounds, files: int) -> None:
    """points(lat, lng, ...) as about so many Parquet files along the curve, and the boxes of the files."""
    along = points.withColumn("_at", curve(F.col("lng"), F.col("lat"), bounds))
    along.repartitionByRange(files, "_at", F.xxhash64(*points.columns)).sortWithinPartitions("_at").drop("_at").write.parquet(f"{path}/rows")
    spark = points.sparkSession
    held = spark.read.schema(points.schema).parquet(f"{path}/rows").select("lat", "lng", F.col("_metadata.file_path").alias("file")).where("lat IS NOT NULL AND lng IS NOT NULL")
    sides = [F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lng").alias("lng_min"), F.max("lng").alias("lng_max")]
    held.groupBy("file").agg(*sides).coalesce(1).write.parquet(f"{path}/boxes")  # one row a file


def read(spark: SparkSession, path: str, boxes: DataFrame, width: float = 0.5) -> DataFrame:
    """The rows of the files that meet one of boxes(lat_min, lat_max, lng_min, lng_max)."""
    files = spark.read.parquet(f"{path}/boxes")
    met = meeting_rectangles(files, boxes.select(*SIDES), width).select("file").distinct()
    names = [r[0] for r in met.limit(NAMED + 1).collect()]  # names of files
    schema = spark.read.parquet(f"{path}/rows").schema
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(names if len(names) <= NAMED else [f"{path}/rows"]))


def in_boxes(spark: SparkSession, path: str, boxes: DataFrame, width: float = 0.5) -> DataFrame:
    """The points in boxes(lat_min, ..., other columns), edges included: points' columns and the boxes' others, from as few files as can be."""
    return points_in_rectangles(read(spark, path, boxes, width), boxes, width).drop(*SIDES)
