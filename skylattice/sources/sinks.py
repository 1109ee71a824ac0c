"""Writing points, zones and types as tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from skylattice.operators.dedupe import last_wins


def save_table(df: DataFrame, table: str, comment: str = "", column_comments: dict[str, str] | None = None, by: tuple[str, ...] = (), mode: str = "overwrite") -> int:
    """A table with comments, partitioned by some columns: what was there is replaced, or added to. Returns the rows written, counted as they are."""
    seen = Observation()
    df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    for c, said in (column_comments or {}).items():
        df = df.withMetadata(c, {"comment": said})
    writer = df.write.mode(mode)
    if by:
        writer = writer.partitionBy(*by)
    writer.saveAsTable(table)
    if comment:
        df.sparkSession.sql(f"COMMENT ON TABLE {table} IS '{comment.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}'")
    return seen.get["rows"]


def save_json(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """JSON lines files in a folder, letters as they are. Returns the rows written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).json(path)
    return seen.get["rows"]


def upserted(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """old after new's rows were put in or over it, in order of seq."""
    return last_wins(old.unionByName(new), keys, [seq])


def geojson_lines(features: DataFrame) -> DataFrame:
    """`value`: one GeoJSON feature a row, from zones.features(); write it with .write.text()."""
    kind = F.col("geometry.kind")
    polygons = F.to_json("geometry.polygons")
    # a polygon is written with one pair of brackets less than a multi-polygon, a point with three less
    bare = lambda n: F.substring(polygons, F.lit(1 + n), F.length(polygons) - 2 * n)
    coordinates = F.when(kind == "Point", bare(3)).when(kind == "Polygon", bare(1)).otherwise(polygons)
    properties = F.to_json(F.struct(*[c for c in features.columns if c not in ("geometry", "lat_min", "lat_max", "lng_min", "lng_max")]))
    return features.select(F.concat(F.lit('{"type":"Feature","geometry":{"type":"'), kind, F.lit('","coordinates":'), coordinates, F.lit('},"properties":'), properties, F.lit("}")).alias("value"))
