"""Bounded samples of labelled documents to fit a classifier on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

ORDERS = 1 << 40


def held_out(id_col: str, folds: int) -> Column:
    """Documents whose crc32 of the id as text leaves remainder 2 are not learned from; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 2


def sample_order(id_: Column, seed: int) -> Column:
    """A number below ORDERS hashed from the id."""
    return F.pmod(F.xxhash64(id_, F.lit(seed)), F.lit(ORDERS))


def first_by_hash(rows: DataFrame, count: int, wanted: int) -> DataFrame:
    """The `wanted` rows (of about `count`) with the smallest `o`.

    Rows beyond the values that twice as many have are left out first, so that what is sorted stays as small however
    many tasks there are.
    """
    cut = min(ORDERS, int(ORDERS * 2.0 * (wanted + 100) / max(count, 1)) + 1)
    return rows.where(F.col("o") < cut).orderBy("o").limit(wanted)


def labelled_sample(
    docs: DataFrame, label: Column, per_class: int, max_chars: int, seed: int = 11, more: dict[str, Column] | None = None,
    labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> list[tuple[bytes, object, tuple]]:
    """Up to `per_class` (text, label, further labels) of every label value, by the hash of the id, in that order.

    `docs` holds what may be learned from; the label columns are its own or those of `labels`, joined by id. Rows with
    a null label or null text are no examples, nor are texts of more than `max_chars`, so the driver gets at most
    classes x per_class x max_chars. Ids are picked from thin rows; only the picked ones' texts travel.
    """
    more = more or {}
    thin = docs.withColumn("_chars", F.length(text_col)).drop(text_col).where(F.col("_chars") <= max_chars)
    if labels is not None:
        thin = thin.select(id_col, "_chars").join(labels, id_col)
    thin = thin.select(
        F.col(id_col).alias("id"), label.alias("label"), *[c.alias(f"more_{k}") for k, c in more.items()],
        sample_order(F.col(id_col), seed).alias("o"),
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull())
    classes = thin.groupBy("label").count().orderBy(F.desc("count"), "label").limit(1000).collect()
    picked = None
    for value, rows in classes:
        some = first_by_hash(thin.where(F.col("label") == F.lit(value)), rows, per_class)
        picked = some if picked is None else picked.union(some)
    if picked is None:
        return []
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = texts.join(F.broadcast(picked.dropDuplicates(["id"])), "id")  # at most classes x per_class ids
    found = chosen.where(F.length("text") <= max_chars).select("o", "text", "label", *[f"more_{k}" for k in more]).collect()
    found.sort(key=lambda r: (r[0], r[1]))
    return [(r[1].encode(), r[2], tuple(r[3:])) for r in found]


def folds(n: int, k: int, seed: int = 5) -> np.ndarray:
    """A fold number for each example, in equal shares."""
    return np.random.default_rng(seed).permutation(np.arange(n) % k)
