"""Tables that cut lineage, written to the folder which all executors share, and connected components over them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a local master without that setting, a new temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, so that later steps survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def summed_counters(rows: DataFrame, count: Callable[[Iterator], Iterator[np.ndarray]], size: int) -> np.ndarray:
    """Sum of the arrays of `size` counters that `count` yields for each task's batches.

    Each task adds up its own; the tasks' arrays are summed by ranges of counters, so no task and not the driver
    gathers more than a fixed size for each range or in all.
    """
    ranges = min(64, size)
    bounds = np.linspace(0, size, ranges + 1).astype(int)

    def run(batches: Iterator) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for part in count(batches):
            total += part
        for r in range(ranges):
            part = total[bounds[r] : bounds[r + 1]]
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_arrays([
                    pa.array([r], pa.int32()), pa.array([at], pa.list_(pa.int32())), pa.array([part[at]], pa.list_(pa.int64())),
                ], ["range", "at", "counts"])

    def add(parts: pa.Table) -> pa.Table:
        r = parts.column("range")[0].as_py()
        at, counts = (parts.column(c).combine_chunks().flatten().to_numpy() for c in ("at", "counts"))
        total = np.zeros(bounds[r + 1] - bounds[r], dtype=np.int64)
        np.add.at(total, at, counts)
        return pa.table({"range": pa.array([r], pa.int32()), "counts": pa.array([total], pa.list_(pa.int64()))})

    sums = rows.mapInArrow(run, "range int, at array<int>, counts array<long>")
    sums = sums.groupBy("range").applyInArrow(add, "range int, counts array<long>").toArrow()
    out = np.zeros(size, dtype=np.int64)
    for r, counts in zip(sums.column("range").to_pylist(), sums.column("counts")):
        out[bounds[r] : bounds[r + 1]] = counts.values.to_numpy()
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over the edges, for every node that has an edge.

    Alternates two rewirings until nothing changes: each node hangs its larger neighbours on its smallest one, then
    itself and its smaller neighbours. A node with very many neighbours stays many rows, which the optimiser may
    split; only minima are gathered per node. Null ends and loops are ignored.
    """
    low, high = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    links = (
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(high.cast("long").alias("u"), low.cast("long").alias("v")).distinct()
    )
    links, mark = stored(links, "links"), None
    while True:
        now = links.agg(F.count("*"), F.sum("v"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now[0] == 0 or now == mark:
            break
        mark = now
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        star = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = star.distinct()
        least = star.groupBy("u").agg(F.min("v").alias("m"))
        hung = star.join(least, "u")
        links = stored(
            hung.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).distinct(),
            "links",
        )
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
