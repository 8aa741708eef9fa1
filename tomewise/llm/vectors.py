"""Vectors as table columns: which of them can be compared, and their arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


#: Different lengths of vectors that one table may hold.
MAX_LENGTHS = 256


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): rows whose vector is neither null, empty nor zero and holds finite numbers only; null ids are left out."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("id").isNotNull() & (F.size("vec") > 0)).where(~odd & F.exists("vec", lambda x: x != 0))


def lengths(rows: DataFrame) -> list[int]:
    """The lengths of the vectors in `vec`, ascending; an error beyond MAX_LENGTHS, as each is a space of its own."""
    found = sorted(r[0] for r in rows.select(F.size("vec")).distinct().limit(MAX_LENGTHS + 1).collect())
    if len(found) > MAX_LENGTHS:
        raise ValueError(f"vectors of more than {MAX_LENGTHS} different lengths")
    return found


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow or underflow on the way."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))
