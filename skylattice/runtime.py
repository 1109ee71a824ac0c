"""What every job shares: reading tables, scratch tables in the shared folder, session settings."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch sent to Python. Texts can be long, so batches are kept small.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Shrink Arrow batches to ARROW_ROWS rows unless the session asks for fewer already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now > ARROW_ROWS or now <= 0:
        spark.conf.set(key, str(ARROW_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder (spark.checkpoint.dir); a temporary one only where none is set and the master is local, as in tests; an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = "file://" + os.path.join(tempfile.mkdtemp(prefix="skylattice-"), "shared")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and is read again with its columns pruned.

    Executors can be lost afterwards: the rows are in the shared store, not on their disks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skylattice/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_under(df: DataFrame, rows: int) -> bool:
    """True if df has at most so many rows; reads no more than rows + 1 of them."""
    return df.limit(rows + 1).count() <= rows
