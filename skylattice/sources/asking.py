"""Searches that can stop and go on: requests are planned once, asked in batches, and what a finished batch has found is never asked again.

A run is a folder: for each round the requests, dealt into batches by a hash, and the pages of each batch, whole once its `_SUCCESS` is there. A run
that was stopped asks the batches that aren't whole; at most the batch under way is asked again. Requests that failed don't end a run:
again() plans them as the next round, which takes the place of what they had found. All tasks together keep one rate: each of `parallel` tasks
waits `parallel` times the pause between its requests and pages. Success, empty and failed requests are counted while the pages are
written.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skylattice.sources.map_search import SCHEMA, searched

REQUESTS = "idx long, kw int, params string, batch int"
COUNTS = "round int, batch int, requests long, failed long, empty long, records long"


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


class Run:
    """One search in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, options: dict[str, str], parallel: int = 4, per_batch: int = 1000) -> None:
        self.spark, self.folder, self.parallel, self.per_batch = spark, folder.rstrip("/"), parallel, per_batch
        self.pause = float(options.get("pause_s", 0.2)) * parallel
        self.options = options | {"pause_s": str(self.pause)}

    def path(self, round_: int, what: str) -> str:
        return f"{self.folder}/round={round_}/{what}"

    def rounds(self) -> int:
        """Rounds that are planned."""
        n = 0
        while exists(self.spark, self.path(n, "requests/_SUCCESS")):
            n += 1
        return n

    def put(self, requests: DataFrame, round_: int) -> None:
        batches = max(1, -(-requests.count() // self.per_batch))
        dealt = requests.select(F.col("idx").cast("long"), F.col("kw").cast("int"), F.col("params").cast("string")).withColumn("batch", F.pmod(F.xxhash64("idx", "kw"), F.lit(batches)).cast("int"))
        dealt.repartition("batch").write.mode("overwrite").partitionBy("batch").parquet(self.path(round_, "requests"))

    def plan(self, requests: DataFrame) -> None:
        """Plan requests(idx, kw, params); each idx and kw once. A run that has a plan keeps it."""
        if not self.rounds():
            self.put(requests, 0)

    def requests(self, round_: int) -> DataFrame:
        return self.spark.read.schema(REQUESTS).parquet(self.path(round_, "requests"))

    def open_batches(self) -> list[tuple[int, int]]:
        """Round and batch of what isn't whole yet."""
        found = []
        for r in range(self.rounds()):
            found += [(r, b) for b in self.numbers(r) if not exists(self.spark, self.path(r, f"counts/batch={b}/_SUCCESS"))]
        return found

    def ask(self, batches: int | None = None) -> int:
        """Ask the open batches, or so many of them; how many are left."""
        left = self.open_batches()
        for r, b in left[:batches]:
            asked, got, pause = Observation(), Observation(), self.pause

            def spaced(rows: Iterator[pa.RecordBatch], pause: float = pause) -> Iterator[pa.RecordBatch]:
                """One request after another, with the pause between them."""
                for batch in rows:
                    for i in range(batch.num_rows):
                        yield batch.slice(i, 1)
                        time.sleep(pause)

            wanted = self.requests(r).where(F.col("batch") == b).drop("batch").observe(asked, F.count(F.lit(1)).alias("n"))
            dealt = wanted.repartition(self.parallel, "idx", "kw").mapInArrow(spaced, "idx long, kw int, params string")
            is_ = lambda s: F.count_if(F.col("status") == s)
            pages = searched(dealt, self.options).observe(got, is_("failed").alias("failed"), is_("empty").alias("empty"), is_("ok").alias("records"))
            if not exists(self.spark, self.path(r, f"pages/batch={b}/_SUCCESS")):
                pages.write.mode("overwrite").parquet(self.path(r, f"pages/batch={b}"))
                row = (r, b, asked.get["n"], got.get["failed"], got.get["empty"], got.get["records"])
            else:  # stopped between the pages and their counts
                held = self.spark.read.schema(SCHEMA).parquet(self.path(r, f"pages/batch={b}")).agg(is_("failed"), is_("empty"), is_("ok")).first()
                row = (r, b, self.requests(r).where(F.col("batch") == b).count(), *held)
            self.spark.createDataFrame([row], COUNTS).write.mode("overwrite").parquet(self.path(r, f"counts/batch={b}"))
        return len(left[batches:]) if batches is not None else 0

    def pages(self) -> DataFrame:
        """Pages of all whole batches, as the source gives them; of requests that were asked again, the last round's."""
        found = self.spark.createDataFrame([], SCHEMA)
        for r in range(self.rounds()):
            if r:
                found = found.join(self.requests(r).select("idx", "kw"), ["idx", "kw"], "left_anti")
            whole = [p for p in (self.path(r, f"pages/batch={b}") for b in self.numbers(r)) if exists(self.spark, f"{p}/_SUCCESS")]
            if whole:
                found = found.unionByName(self.spark.read.schema(SCHEMA).parquet(*whole))
        return found

    def numbers(self, round_: int) -> list[int]:
        return sorted(x[0] for x in self.requests(round_).select("batch").distinct().collect())  # a number a batch

    def again(self) -> int:
        """Plan the requests that failed as the next round; how many."""
        if self.open_batches():
            raise RuntimeError("there are batches that weren't asked yet")
        failed = self.pages().where("status = 'failed'").select("idx", "kw").distinct()
        asked = self.requests(0).select("idx", "kw", "params").join(failed, ["idx", "kw"], "left_semi")
        n = asked.count()
        if n:
            self.put(asked, self.rounds())
        return n

    def hits(self) -> DataFrame:
        """idx, kw, page, pos, record of everything found."""
        return self.pages().where("status = 'ok'").drop("status")

    def counts(self) -> DataFrame:
        """round, batch, requests, failed, empty and records of the batches asked, as counted when they were written."""
        paths = [self.path(r, f"counts/batch={b}") for r in range(self.rounds()) for b in self.numbers(r)]
        there = [p for p in paths if exists(self.spark, f"{p}/_SUCCESS")]
        return self.spark.read.schema(COUNTS).parquet(*there) if there else self.spark.createDataFrame([], COUNTS)

    def cells(self) -> DataFrame:
        """One row: total, success, empty and failed cells (idx), from the reader's status in one pass. A cell with a failed request failed; one with a record, and none that failed, is a success."""
        one = self.pages().groupBy("idx").agg(F.bool_or(F.col("status") == "failed").alias("failed"), F.bool_or(F.col("status") == "ok").alias("ok"))
        return one.agg(
            F.count(F.lit(1)).alias("total_cells"), F.count_if(F.col("ok") & ~F.col("failed")).alias("success_cells"),
            F.count_if(~F.col("ok") & ~F.col("failed")).alias("empty_cells"), F.count_if("failed").alias("failed_cells"),
        )
