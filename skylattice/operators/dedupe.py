"""Keyed dedupe with an explicit order. Missing keys (null or empty) are no duplicates of each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def present(df: DataFrame, key: str) -> Column:
    """True where a key isn't missing."""
    kind = dict(df.dtypes)[key]
    return F.coalesce(F.col(key) != ("" if kind == "string" else 0), F.lit(False)) if kind == "string" else F.col(key).isNotNull()


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep_missing: bool) -> DataFrame:
    """The first row of each key; the window's rank limit is applied before the shuffle, so a frequent key sends one row from each task.

    keep_missing: rows in which any key is missing all stay (each is a group of its own), else none does.
    """
    whole = present(df, keys[0])
    for k in keys[1:]:
        whole = whole & present(df, k)
    rows = df.withColumn("_lone", F.when(~whole, F.monotonically_increasing_id())) if keep_missing else df.where(whole).withColumn("_lone", F.lit(None).cast("long"))
    ranked = rows.withColumn("_nth", F.row_number().over(W.partitionBy(*keys, "_lone").orderBy(*order)))
    return ranked.where("_nth = 1").drop("_nth", "_lone")


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep_missing: bool = True) -> DataFrame:
    """Of rows with equal keys the first in order stays."""
    return one_per_key(df, keys, [F.col(c).asc() for c in order], keep_missing)


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """What an upsert leaves: of rows with equal keys the last; rows with a missing key never conflict."""
    return one_per_key(df, keys, [F.col(c).desc() for c in order], True)
