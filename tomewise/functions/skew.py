"""Bounded groups and salted keys for data in which one key may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ID_BUCKET_BITS = 16


def id_bucket(item_id: Column | str) -> Column:
    """Range bucket of an integer id.

    A (user, bucket) group of distinct item ids holds at most 2**16 rows whatever the user, and
    the buckets of one user are ordered like the ids, so running positions can be computed per
    bucket and shifted by the sizes of the buckets before it.
    """
    return F.shiftright(F.col(item_id) if isinstance(item_id, str) else item_id, ID_BUCKET_BITS)


def spread_missing(key: Column, *row_id: str) -> Column:
    """Join key for an outer lookup in which missing keys do not pile up on one task.

    A missing key can match nothing, so it is replaced by one of 4096 values that no real key has.
    """
    filler = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*row_id), F.lit(4096)).cast("string"))
    return F.coalesce(key.cast("string"), filler)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitions by the keys in the session's full number of shuffle partitions.

    Meant for compute-heavy steps on thin rows: partitions asked for by number are not merged at
    run time on account of their small size. Where the following step groups or joins by the same
    keys this is its shuffle, not one more.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def spread_unsplit(df: DataFrame) -> DataFrame:
    """Redistribute rows that arrive in fewer partitions than the cluster runs at once.

    Meant before costly per-row work on files that cannot be split; larger inputs pass unchanged.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
