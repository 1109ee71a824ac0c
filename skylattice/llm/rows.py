"""Rows named by what they hold, for joins back to whole rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_row(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (a 128-bit key that rows alike in id and text share), doc_id, text, and doc, the row of df as a struct: no column of df can clash."""
    doc = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc")
    doc_id, text = F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.when(text.isNull(), "n").otherwise("t"), F.coalesce(text, F.lit("")))
    return df.select(F.unhex(F.md5(name)).alias("row"), doc_id, text, doc)
