"""Polling a search again and again: only what wasn't seen lately goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unseen(points: DataFrame, keys: list[str], time_col: str, delay: str = "1 day") -> DataFrame:
    """Of a stream's rows the first of each key within a watermark; state is bounded by the delay."""
    return points.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)
