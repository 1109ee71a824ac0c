"""Requests of map searches as columns: `params` is a JSON object without the fields that are missing, one row a request.

Cells, keywords and types are joined before, so a list of keywords or types is a product of rows and not a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.geo import closed_polygon, map_bound
from skylattice.sources.dimensions import LEVELS

# Provider B's kinds of query, the zone search's mode, its drone unless said, and the level of a map.
MAP_BOUND, AROUND, POLYGON = "2", "3", "10"
ZONES_MODE, DRONE, MAP_LEVEL = "flysafe_website", "dji-mavic-3", "12"


def text(c: Column) -> Column:
    return c.cast("string")


def given(c: Column | None) -> Column:
    """A text that is there and isn't empty, else null."""
    return F.lit(None).cast("string") if c is None else F.when(c != "", c)


def params(**fields: Column) -> Column:
    """A JSON object of the fields that aren't null, in the order given."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "true"})


def _search_b(kind: str, keyword: Column | None, data_types: str | None, show: str | None, **more: Column) -> Column:
    own = {"keyWord": given(keyword), "dataTypes": given(F.lit(data_types)), "show": given(F.lit(show))}
    return params(**({"queryType": F.lit(kind)} | own | more))


def b_in_bounds(keyword: Column | None = None, level: str = MAP_LEVEL, data_types: str | None = None, show: str | None = None, number=text) -> Column:
    """Provider B's search in a rectangle (columns lat_min .. lng_max)."""
    return _search_b(MAP_BOUND, keyword, data_types, show, mapBound=map_bound(text=number), level=F.lit(level))


def b_in_polygon(keyword: Column | None = None, data_types: str | None = None, show: str | None = None, number=text) -> Column:
    """Provider B's search in the closed polygon of a rectangle."""
    return _search_b(POLYGON, keyword, data_types, show, polygon=closed_polygon(number))


def b_around(lat: Column, lng: Column, radius_m: Column, keyword: Column | None = None, level: str = MAP_LEVEL, data_types: str | None = None, show: str | None = None, number=text) -> Column:
    """Provider B's search around a place."""
    return _search_b(AROUND, keyword, data_types, show, pointLonlat=F.concat_ws(",", number(lng), number(lat)), queryRadius=radius_m.cast("string"), level=F.lit(level))


def a_around(lat: Column, lng: Column, radius_m: Column, types: Column | None = None, keyword: Column | None = None, number=text) -> Column:
    """Provider A's search around a place, of version 3: one request a type."""
    return params(location=F.concat_ws(",", number(lng), number(lat)), radius=radius_m.cast("string"), types=given(types), keywords=given(keyword), extensions=F.lit("all"), output=F.lit("json"))


def a_in_polygon(polygon: Column, types: Column | None = None, keyword: Column | None = None) -> Column:
    """Provider A's search in a polygon, of version 5: all types of an array in one request."""
    joined = None if types is None else F.array_join(types, "|")
    return params(polygon=polygon, output=F.lit("json"), keywords=given(keyword), types=given(joined))


def zones_in_bounds(drone: str = DRONE, levels: list[int] | None = None, number=text) -> Column:
    """The zone search in a rectangle, for a drone and some levels (all known ones unless said)."""
    wanted = ",".join(map(str, LEVELS if levels is None else levels))
    sides = {"ltlat": "lat_max", "ltlng": "lng_min", "rblat": "lat_min", "rblng": "lng_max"}
    return params(**{n: number(F.col(c)) for n, c in sides.items()}, zones_mode=F.lit(ZONES_MODE), drone=F.lit(drone), level=F.lit(wanted))


def of_types(df: DataFrame, wanted: list[str], type_col: str = "type_code") -> DataFrame:
    """Rows of some types (all where none are named): the filter that stands for the types of a request, and that Parquet can skip by."""
    return df.where(F.col(type_col).isin(*wanted)) if wanted else df
