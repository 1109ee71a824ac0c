"""Points of interest of two providers: validity, one schema, filters, statistics, names, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skylattice.functions.values import first_number, first_text, is_everything, lng_lat, percentage

#: Columns of a point after unification; `raw` and `metadata` hold JSON.
COLUMNS = ("source_platform", "poi_id", "name", "type_code", "type_name", "address", "province", "city", "district", "lng", "lat", "raw_data", "metadata")


#: Names of tables.
TABLE, KEYWORDS = "gis_poi_gd_{}", "_keywords"


class Fields:
    """A provider's records by field name, case and all: names that differ in case alone are different fields, and any may be absent."""

    def __init__(self, df: DataFrame) -> None:
        self.names = {name: f"_c{i}" for i, name in enumerate(df.columns)}
        self.df = df.toDF(*self.names.values()) if len(self.names) == len(df.columns) else df

    def __call__(self, name: str) -> Column:
        return F.col(self.names[name]).cast("string") if name in self.names else F.lit(None).cast("string")

    def raw(self, name: str | None) -> Column:
        """The record as it came: the field named, or all fields as JSON."""
        return self(name) if name else F.to_json(F.struct(*[F.col(c).alias(n) for n, c in self.names.items()]))


def from_provider_a(df: DataFrame, platform: str = "a", metadata: Column | None = None, raw: str | None = None) -> DataFrame:
    """Records with `location` as "lng,lat". A bad coordinate gives null, the record stays."""
    c = Fields(df)
    at = lng_lat(c("location"))
    return c.df.select(
        F.lit(platform).alias("source_platform"), c("id").alias("poi_id"), c("name").alias("name"), c("typecode").alias("type_code"), c("type").alias("type_name"),
        first_text(c("address"), c("addr")).alias("address"), c("pname").alias("province"), c("cityname").alias("city"), c("adname").alias("district"),
        at["lng"].alias("lng"), at["lat"].alias("lat"), c.raw(raw).alias("raw_data"), (F.lit("{}") if metadata is None else metadata).alias("metadata"),
    )


def from_provider_b(df: DataFrame, platform: str = "b", metadata: Column | None = None, raw: str | None = None, zero_is_missing: bool = False) -> DataFrame:
    """Records with several names for a field: the first that isn't missing counts."""
    c = Fields(df)
    lng, lat = first_number(c("lon"), c("lng"), c("longitude"), zero_is_missing=zero_is_missing), first_number(c("lat"), c("latitude"), zero_is_missing=zero_is_missing)
    both = lng.isNotNull() & lat.isNotNull()
    return c.df.select(
        F.lit(platform).alias("source_platform"), first_text(c("hotPointID"), c("id")).alias("poi_id"), c("name").alias("name"),
        first_text(c("typeCode"), c("typecode")).alias("type_code"), first_text(c("typeName"), c("type")).alias("type_name"),
        first_text(c("address"), c("addr")).alias("address"), c("province").alias("province"), c("city").alias("city"), first_text(c("county"), c("district")).alias("district"),
        F.when(both, lng).alias("lng"), F.when(both, lat).alias("lat"), c.raw(raw).alias("raw_data"), (F.lit("{}") if metadata is None else metadata).alias("metadata"),
    )


def valid_a(status: Column) -> Column:
    """A provider A response counts if its status is 1."""
    return F.coalesce(status.cast("string") == "1", F.lit(False))


def valid_b(infocode: Column, code: Column, result_type: Column) -> Column:
    """A provider B response counts if its codes are 0 or 1000 (a missing infocode is none) and it holds points."""
    fine = infocode.isin(0, 1000) & (code.isNull() | code.isin(0, 1000)) & (result_type == 1)
    return F.coalesce(fine, F.lit(False))


def records(responses: DataFrame, valid: Column) -> DataFrame:
    """The records of valid responses with the place of each: responses(idx, kw, page, pois array) -> idx, kw, page, pos, poi."""
    return responses.where(valid).select("idx", "kw", "page", F.posexplode("pois").alias("pos", "poi"))


def in_region(df: DataFrame, name: str, level: str | None) -> DataFrame:
    """Rows of a city or province (level), by equal name or by all but its last letter as a prefix; any other level keeps all.

    The prefix of a one-letter name would be empty: then only equality counts.
    """
    if level not in ("city", "province"):
        return df
    place, stem = F.trim(F.col(level)), name[:-1]
    return df.where((place == name) | place.startswith(stem)) if stem else df.where(place == name)


def around(df: DataFrame, lat: float, lng: float, radius_m: float) -> DataFrame:
    """Rows within radius_m metres of a point; the square around it comes first, as Parquet can skip by it."""
    from skylattice.functions.geo import metres_between, rectangle

    south, north, west, east = rectangle(F.lit(float(lat)), F.lit(float(lng)), radius_m)
    near = F.col("lat").between(south, north) & F.col("lng").between(west, east)
    return df.where(near).where(metres_between(F.lit(float(lat)), F.lit(float(lng)), F.col("lat"), F.col("lng")) <= float(radius_m))


def with_keyword(df: DataFrame, keyword: str | None) -> DataFrame:
    """Rows whose name or type name holds the keyword; none, empty or one that asks for everything keeps all."""
    if not keyword:
        return df
    holds = F.contains(F.col("name"), F.lit(keyword)) | F.contains(F.col("type_name"), F.lit(keyword))
    return df.where(is_everything(F.lit(keyword)) | F.coalesce(holds, F.lit(False)))


def type_counts(df: DataFrame, *by: str, type_col: str = "type_code") -> DataFrame:
    """Rows of each type (missing: unknown), for each value of `by`."""
    return df.groupBy(*by, F.coalesce(F.col(type_col), F.lit("unknown")).alias(type_col)).agg(F.count("*").alias("n"))


def type_shares(df: DataFrame, type_col: str = "type_code") -> DataFrame:
    """type_counts() of the whole and the per cent of the total; the window runs over the counts, not over the rows."""
    counts = type_counts(df, type_col=type_col)
    return counts.withColumn("percentage", percentage(F.col("n"), F.sum("n").over(W.partitionBy())))


def with_type_name(df: DataFrame, tree: DataFrame, code: str = "type_code") -> DataFrame:
    """type_name by code: a first-level name for the first six letters, else a subtype's, else the code. The tree is a small dimension table."""
    top = tree.select(F.col("code").alias("_top"), F.col("name").alias("_top_name"))
    sub = tree.select(F.explode("subtypes").alias("s")).select(F.col("s.code").alias("_sub"), F.col("s.name").alias("_sub_name"))
    joined = df.join(top, F.left(F.col(code), F.lit(6)) == F.col("_top"), "left").join(sub, F.col(code) == F.col("_sub"), "left")
    return joined.withColumn("type_name", F.coalesce("_top_name", "_sub_name", code)).drop("_top", "_top_name", "_sub", "_sub_name")


def with_fallback(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All of first, and of second what has a key that first lacks."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def cells_by_keyword(cells: DataFrame, keywords: DataFrame) -> DataFrame:
    """Every cell with every keyword (a dimension table: the requests of a run are this product)."""
    return cells.crossJoin(keywords)


def run_metrics(hits: DataFrame, unique: DataFrame, kept: DataFrame, cells: DataFrame) -> DataFrame:
    """One row: cells, cells with hits, cells without, rows before and after dedupe, rows that the region filter takes out."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    by_cell = hits.groupBy("idx").agg(F.count("*").alias("n")).agg(F.count("*").alias("hit_cells"), F.coalesce(F.sum("n"), F.lit(0)).alias("before"))
    parts = one(cells, "total_cells").crossJoin(by_cell).crossJoin(one(unique, "after")).crossJoin(one(kept, "kept"))  # of one row each
    return parts.select("total_cells", "hit_cells", (F.col("total_cells") - F.col("hit_cells")).alias("empty_cells"), "before", "after", (F.col("after") - F.col("kept")).alias("filtered_out"))


def target_table(region_code: str, keywords: str | None) -> str:
    """The table a region's points of provider A go to: of its own where a keyword narrows them. An empty keyword asks for all."""
    return TABLE.format(region_code) + (KEYWORDS if keywords else "")
