"""Plans of paged requests as tables: pages, offsets, waits between tries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tries after a rate limit, and the first wait in seconds, which doubles.
TRIES, FIRST_WAIT = 5, 10


def pages(requests: DataFrame, total: Column, size: int) -> DataFrame:
    """requests with page (from 1) and start (rows before it): as many pages as a total asks for, one at least."""
    last = F.greatest(F.lit(1), F.ceil(total / F.lit(size)).cast("int"))
    return requests.withColumn("page", F.explode(F.sequence(F.lit(1), last))).withColumn("start", (F.col("page") - 1) * size)


def page_of(df: DataFrame, order: list[str], size: int, page: int) -> DataFrame:
    """One page of rows in a total order."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def waits(requests: DataFrame) -> DataFrame:
    """requests with try (from 0) and wait_s, the wait after it."""
    return requests.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(TRIES - 1)))).withColumn("wait_s", (F.lit(FIRST_WAIT) * F.pow(F.lit(2), "try")).cast("long"))
