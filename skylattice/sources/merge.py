"""Upserts into tables at size: only the parts that new keys may touch are rewritten.

A table is a folder of Parquet files in `parts` parts by a hash of the key, beside Bloom filters of the keys of each part (bitmaps of
Spark's own functions, 32,768 bits a row). An upsert deals its rows into the same parts and asks the filters: a part that may hold one of the new
keys is read, joined and written anew; a part that surely holds none gets its rows as more files; all other parts' files aren't touched. The
filters learn the new keys before the rows are written, so they never miss a key; one that is in a filter only costs a rewrite.

Rows whose key is missing (null, or empty for strings) are no duplicates of each other: they are added each time. Of new rows with one key the
last in order of `seq` counts. Parts that are rewritten go by Spark's dynamic overwrite: committed part by part when the job ends. A run
that is lost between its two writes is done again with the same rows: rows with keys come out the same, those without are added again.
One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice import runtime
from skylattice.operators.dedupe import last_wins, present

#: Bits of a row of a filter (fixed by Spark's bitmaps) and places that a key sets.
BITS = 32_768
PLACES = 4
PART = "part_of_key"


class KeyedTable:
    """A folder of rows by key. parts: a power of two, about one for each gigabyte; filter_rows: bitmaps a part, about one for 3,000 keys of a part."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], seq: str, parts: int = 64, filter_rows: int = 4) -> None:
        self.spark, self.path, self.keys, self.seq, self.parts, self.filter_rows = spark, path.rstrip("/"), keys, seq, parts, filter_rows

    def has_key(self, df: DataFrame) -> Column:
        whole = present(df, self.keys[0])
        for k in self.keys[1:]:
            whole = whole & present(df, k)
        return whole

    def dealt(self, df: DataFrame) -> DataFrame:
        """df with its part: by the key, or spread by the whole row where the key is missing."""
        return df.withColumn(PART, F.when(self.has_key(df), F.pmod(F.xxhash64(*self.keys), F.lit(self.parts))).otherwise(F.pmod(F.xxhash64(*sorted(df.columns)), F.lit(self.parts))).cast("int"))

    def places(self, df: DataFrame) -> DataFrame:
        """part, key_no (a hash of the key), row_no and bit of the places that each key of df sets in its part's filter."""
        keyed = df.where(self.has_key(df))
        seeds = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(i), *self.keys), F.lit(BITS * self.filter_rows)) for i in range(PLACES)])).alias("place")
        placed = keyed.select(PART, F.xxhash64(*self.keys).alias("key_no"), seeds)
        return placed.select(PART, "key_no", F.floor(F.col("place") / BITS).cast("int").alias("row_no"), (F.col("place") % BITS).alias("bit"))

    @property
    def data(self) -> str:
        return f"{self.path}/rows"

    def exists(self) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.data)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def versions(self) -> list[str]:
        """The filters' folders, oldest first; the last whole one counts."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/filters")
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(hadoop):
            return []
        found = [s.getPath() for s in fs.listStatus(hadoop)]  # two folders at most
        return sorted(str(p) for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def learn(self, rows: DataFrame) -> None:
        """Put the keys of rows into the filters: a new version beside the old one, which then goes."""
        before = self.versions()
        new = self.places(rows).groupBy(PART, "row_no").agg(F.bitmap_construct_agg("bit").alias("bits"))
        if before:
            new = self.spark.read.parquet(before[-1]).unionByName(new).groupBy(PART, "row_no").agg(F.bitmap_or_agg("bits").alias("bits"))
        number = int(before[-1].rsplit("/", 1)[1].split("-")[0]) + 1 if before else 1
        new.write.parquet(f"{self.path}/filters/{number:010d}-{uuid.uuid4().hex}")
        for old in before:
            gone = self.spark._jvm.org.apache.hadoop.fs.Path(old)
            gone.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(gone, True)

    def perhaps_held(self, rows: DataFrame) -> list[int]:
        """The parts that may hold a key of rows: a number for each part at most."""
        before = self.versions()
        if not before:
            return []
        probed = self.places(rows).join(self.spark.read.parquet(before[-1]), [PART, "row_no"])
        byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = F.getbit(byte.cast("long"), (F.col("bit") % 8).cast("int")) == 1
        held = probed.where(is_set).groupBy(PART, "key_no").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= PLACES)
        return sorted(r[0] for r in held.select(PART).distinct().collect())

    def read(self) -> DataFrame:
        """The rows, without their part."""
        return self.spark.read.parquet(self.data).drop(PART)

    def create(self, rows: DataFrame) -> None:
        """The folder's first rows."""
        if self.exists():
            raise ValueError(f"there are rows in {self.path}")
        whole = runtime.written(self.dealt(last_wins(rows, self.keys, [self.seq])), "created")
        self.learn(whole)
        whole.repartition(PART).write.partitionBy(PART).parquet(self.data)

    def upsert(self, rows: DataFrame) -> dict[str, list[int]]:
        """Put rows in or over those there: the parts rewritten and the parts only added to."""
        if not self.exists():
            self.create(rows)
            return {"rewritten": [], "added": list(range(self.parts))}
        new = runtime.written(self.dealt(last_wins(rows, self.keys, [self.seq])), "upsert")
        rewritten = self.perhaps_held(new)
        self.learn(new)
        added = sorted(r[0] for r in new.where(~F.col(PART).isin(rewritten)).select(PART).distinct().collect())  # a number a part
        if rewritten:
            old = self.spark.read.parquet(self.data).where(F.col(PART).isin(rewritten))
            mine = new.where(F.col(PART).isin(rewritten))
            gone = mine.where(self.has_key(mine)).select(PART, *self.keys)
            kept = old.join(gone, [PART, *self.keys], "left_anti")
            # a folder can't be overwritten while it is read
            whole = runtime.written(kept.unionByName(mine), "rewritten")
            whole.repartition(PART).write.partitionBy(PART).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.data)
        if added:
            new.where(F.col(PART).isin(added)).repartition(PART).write.partitionBy(PART).mode("append").parquet(self.data)
        return {"rewritten": rewritten, "added": added}
