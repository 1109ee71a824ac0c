"""Column functions for loosely typed provider records and object names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords that ask for everything.
EVERYTHING = ("all", "全部")


def truthy(c: Column) -> Column:
    """Null for an empty string or a JSON list or object without content, as these mean "missing"; else the string."""
    return F.when(~F.trim(c).isin("", "[]", "{}"), c)


def first_text(*columns: Column) -> Column:
    """The first string that isn't missing."""
    return F.coalesce(*map(truthy, columns))


def number(c: Column) -> Column:
    """The number that a string spells; null for anything else, NaN and infinity included."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def first_number(*columns: Column, zero_is_missing: bool = False) -> Column:
    """The first of some strings that spells a number."""
    found = map(number, columns)
    return F.coalesce(*(F.nullif(x, F.lit(0.0)) for x in found) if zero_is_missing else found)


def lng_lat(location: Column) -> Column:
    """struct<lng, lat> of "lng,lat", cut at the first comma; both null unless both are numbers."""
    parts = F.split(location, ",", 2)
    lng, lat = number(F.trim(F.get(parts, F.lit(0)))), number(F.trim(F.get(parts, F.lit(1))))
    both = lng.isNotNull() & lat.isNotNull()
    return F.struct(F.when(both, lng).alias("lng"), F.when(both, lat).alias("lat"))


def is_everything(keyword: Column) -> Column:
    """True for the keywords that ask for everything, whatever their quotes, spaces and case; false for null."""
    return F.coalesce(F.lower(F.btrim(F.trim(keyword), F.lit("'\""))).isin(*EVERYTHING), F.lit(False))


def distinct_keywords(keywords: Column) -> Column:
    """An array's keywords in order of first occurrence, without empty ones."""
    return F.array_distinct(F.filter(keywords, lambda k: k.isNotNull() & (k != "")))


def object_name(c: Column, default_schema: str = "public") -> Column:
    """struct<schema, name, args> of `schema.name(args)`; args is null without parentheses (all overloads)."""
    head = F.split(c, r"\(", 2)
    plain = F.trim(F.get(head, F.lit(0)))
    dotted = F.contains(plain, F.lit("."))
    parts = F.split(plain, r"\.", 2)
    return F.struct(
        F.when(dotted, F.get(parts, F.lit(0))).otherwise(F.lit(default_schema)).alias("schema"),
        F.when(dotted, F.get(parts, F.lit(1))).otherwise(plain).alias("name"),
        F.rtrim(F.get(head, F.lit(1)), F.lit(")")).alias("args"),
    )


def quoted(c: Column) -> Column:
    """A quoted identifier."""
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def percentage(part: Column, whole: Column) -> Column:
    """Per cent of the whole to one decimal; null for an empty whole."""
    return F.round(F.try_divide(part * F.lit(100.0), whole), 1)


def day_stamp(at: Column) -> Column:
    """The day of a time as eight digits."""
    return F.date_format(at, "yyyyMMdd")
