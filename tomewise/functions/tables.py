"""Tables written to the folder that all executors share, and numbers without gaps for their rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a local master without that setting, a new temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tomewise-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps neither repeat nor lose what led to it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dense_index(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """(key, place): places 0, 1, 2, ... of the distinct values of `key` in ascending order, null left out.

    The values are dealt out by range and numbered inside each range; the counts of the ranges before it shift a range's
    numbers. No task sees more than its range, and the driver one count for each.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_keys = df.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(parts, key).sortWithinPartitions(key)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = stored(sorted_keys.select(key, F.spark_partition_id().alias("_range"), inside.alias("_inside")), "dense-index")
    counts = {r["_range"]: r["n"] for r in numbered.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for part in sorted(counts):
        offsets.append((part, total))
        total += counts[part]
    shifts = F.broadcast(spark.createDataFrame(offsets, "_range int, _before long"))
    return numbered.join(shifts, "_range").select(key, (F.col("_before") + F.col("_inside")).alias("place"))
