"""Exact dedup with a heavy-hitter split, in DataFrame functions only.

A frequent-items sketch (Misra-Gries counters, `approx_top_k`) proposes the digests that may be frequent; an exact count verifies
them. All digests that the sketch still counts are proposed, COUNTERS at most whatever their rank, so the winners are broadcast and
their copies are settled where they are read, without a shuffle. All other digests are counted with partial aggregation and joined
with their counts; by the sketch's guarantee none of them holds more than 3.5 / COUNTERS of the rows.

Defined results: null text counts as empty text. Rows with a null doc_id come after all others. Of rows that repeat both doc_id
and text one stays (keep_id is the same for all of them). An empty table gives an empty result. Only the id and text columns are
read, so extra columns can have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice import runtime

#: Counters of the sketch (a power of two): so many digests at most are broadcast.
COUNTERS = 4096


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One small row per document: its id, a number of the row, and the SHA-256 of its normalised text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(F.col(text_col)).cast("binary"), 256).alias("text_sha256")).withColumn("row_no", F.monotonically_increasing_id())


def winners(rows: DataFrame) -> DataFrame:
    """The frequent digests with exact counts and the row that stays; at most COUNTERS rows."""
    sketch = rows.agg(F.expr(f"approx_top_k(text_sha256, {COUNTERS}, {COUNTERS})").alias("top"))
    found = sketch.select(F.explode("top").alias("t")).select(F.col("t.item").alias("text_sha256"))
    counted = rows.join(F.broadcast(found), "text_sha256").groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.min(order()).alias("first"))
    return counted.where("group_size > 1")


def order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row_no"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row."""
    rows = runtime.written(digests(docs, id_col, text_col), "digests")
    heavy = runtime.written(winners(rows), "winners")
    settled = rows.join(F.broadcast(heavy), "text_sha256")
    rest = rows.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    groups = rest.groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.min(order()).alias("first"))
    rest = rest.join(groups, "text_sha256")
    return settled.unionByName(rest).select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row_no") == F.col("first.row_no")).alias("kept"), "text_sha256")
