"""Approximate nearest neighbours by cross-polytope hashing.

Pseudo-random rotations (sign flips and Hadamard transforms) turn every vector; the nearest signed axes of several
rotations together are its bucket in a table. A query looks into several buckets of every table, those that near
vectors fall into most likely first, and the candidates found are ranked exactly.

Buckets grow with the square root of the rows, probes and tables do not grow, so a query meets a share of the rows that
falls with the square root of their number. Vectors are indexed in bands of about one length, as inside a band directions
order them nearly as inner products do; a query visits every band.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tomewise.llm.tables import stored
from tomewise.llm.vectors import lengths, matrix, unit, usable

TABLES = 16
#: Buckets that a query visits in a table.
PROBES = 64
#: Buckets of a table for each square root of the rows.
BUCKETS = 32
#: Tables of up to this many rows for each of the k places are one bucket.
ENOUGH = 100
#: Vectors of this many bytes, as doubles, meet as many queries in a task, twice as many where buckets are uneven.
BLOCK_BYTES = 1 << 24
#: Vectors of a bucket from which a matrix product is cheaper than single pairs, and pairs scored at a time.
DENSE = 256
PAIRS = 1 << 15
#: Queries that are turned at a time, and whose results are merged at a time.
QUERY_BLOCK = 1024
MERGE_QUERIES = 256
ROUNDS = 3
#: Bands of lengths, each reaching down to this share of the one before; the last holds all shorter vectors.
BANDS = 24
BAND_SHARE = 0.8


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of every row, scaled to keep lengths; the width is a power of two.

    The matrix is the Kronecker product of two of about the root of its width, so a row costs width x 2 root(width).
    """
    width = rows.shape[1]
    left = 1 << ((width.bit_length() - 1) // 2)
    right = width // left
    half = rows.reshape(-1, right) @ _hadamard_matrix(right)
    half = half.reshape(-1, left, right).transpose(0, 2, 1).reshape(-1, left) @ _hadamard_matrix(left)
    return half.reshape(-1, right, left).transpose(0, 2, 1).reshape(-1, width) / np.sqrt(width)


@lru_cache
def _hadamard_matrix(width: int) -> np.ndarray:
    out = np.ones((1, 1))
    while len(out) < width:
        out = np.block([[out, out], [out, -out]])
    return out


def rotated(rows: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Unit rows turned by the pseudo-rotation of a table, padded with zeros to a power of two."""
    width = 1 << max(1, int(np.ceil(np.log2(rows.shape[1]))))
    out = np.zeros((len(rows), width))
    out[:, : rows.shape[1]] = rows
    rng = np.random.default_rng([seed, table])
    for _ in range(ROUNDS):
        out = hadamard(out * rng.choice([-1.0, 1.0], width))
    return out


def bucket_of(turned: np.ndarray) -> np.ndarray:
    """Twice the axis with the largest coordinate by magnitude, plus one if that is negative."""
    axis = np.abs(turned).argmax(axis=1)
    return 2 * axis + (turned[np.arange(len(turned)), axis] < 0)


@dataclass(frozen=True)
class Index:
    """How the vectors of a band fall into buckets: tables, signed axes of each rotation, task cells of each table."""

    band: int
    tables: int
    widths: tuple[int, ...]
    cells: int
    seed: int

    def turned(self, rows: np.ndarray, table: int) -> Iterator[tuple[int, np.ndarray]]:
        """(signed axes, coordinates) of each rotation of a table."""
        for h, width in enumerate(self.widths):
            yield width, rotated(rows, table * len(self.widths) + h, self.seed)[:, : width // 2]

    def keys(self, rows: np.ndarray, table: int) -> np.ndarray:
        """The bucket of each row in a table."""
        key = np.zeros(len(rows), dtype=np.int64)
        for width, turned in self.turned(rows, table):
            key = key * width + bucket_of(turned)
        return key

    def probed(self, rows: np.ndarray, table: int, probes: int) -> np.ndarray:
        """The `probes` likeliest buckets of each query: least sum of squared distances to the largest coordinates.

        Among the prefixes of the best buckets are only the best prefixes, so the sums are cut after every rotation.
        """
        cost, key = np.zeros((len(rows), 1)), np.zeros((len(rows), 1), dtype=np.int64)
        for width, turned in self.turned(rows, table):
            near = np.empty((len(rows), width))
            near[:, 0::2], near[:, 1::2] = turned, -turned
            far = (near.max(axis=1, keepdims=True) - near) ** 2
            some = min(width, probes)
            axis = np.argpartition(far, some - 1, axis=1)[:, :some]
            far = np.take_along_axis(far, axis, 1)
            cost = (cost[:, :, None] + far[:, None, :]).reshape(len(rows), -1)
            key = (key[:, :, None] * width + axis[:, None, :]).reshape(len(rows), -1)
            if cost.shape[1] > probes:
                best = np.argpartition(cost, probes - 1, axis=1)[:, :probes]
                cost, key = np.take_along_axis(cost, best, 1), np.take_along_axis(key, best, 1)
        return key

    def cell(self, key: np.ndarray) -> np.ndarray:
        """The task cell of a bucket."""
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(33)) % np.uint64(self.cells)).astype(np.int32)


def index_for(band: int, rows: int, dims: int, k: int, tables: int, enough: int, seed: int) -> Index:
    """Tables, buckets and cells for so many vectors of so many dimensions."""
    cells = max(1, -(-rows // max(DENSE, BLOCK_BYTES // (8 * dims))))
    if rows <= enough * k:
        return Index(band, 1, (), 1, seed)
    full = 2 << max(1, int(np.ceil(np.log2(dims))))
    wanted, widths = BUCKETS * np.sqrt(rows), []
    while wanted > full:
        widths.append(full)
        wanted /= full
    widths.append(2 * max(1, int(np.ceil(wanted / 2))))
    return Index(band, tables, tuple(widths), cells, seed)


def _hash_rows(bands: dict[int, Index]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector with its bucket in every table of its band."""
        for whole in batches:
            band = whole.column(2).to_numpy()
            for b in np.unique(band):
                batch, index = whole.filter(pa.array(band == b)), bands[int(b)]
                rows = unit(matrix(batch.column(1)))
                keys = np.column_stack([index.keys(rows, t) for t in range(index.tables)]).ravel()
                offsets = pa.array(np.arange(len(batch) + 1) * index.tables, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    *batch.columns, pa.ListArray.from_arrays(offsets, pa.array(keys)),
                    pa.ListArray.from_arrays(offsets, pa.array(index.cell(keys))),
                ], ["id", "vec", "band", "keys", "cells"])

    return run


def _probe_rows(bands: dict[int, Index], probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each band, table and cell that a query visits, with the buckets to visit there."""
        for whole in batches:
            for begin in range(0, len(whole), QUERY_BLOCK):
                batch = whole.slice(begin, QUERY_BLOCK)
                rows = unit(matrix(batch.column(1)))
                for index, t in ((i, t) for i in bands.values() for t in range(i.tables)):
                    keys = index.probed(rows, t, probes)
                    row = np.repeat(np.arange(len(batch)), keys.shape[1])
                    key, cell = keys.ravel(), index.cell(keys.ravel())
                    order = np.lexsort((key, cell, row))
                    row, key, cell = row[order], key[order], cell[order]
                    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (cell[1:] != cell[:-1]))))
                    offsets = pa.array(np.concatenate((first, [len(row)])), pa.int32())
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(row[first])), batch.column(1).take(pa.array(row[first])),
                        pa.array(np.full(len(first), index.band), pa.int32()), pa.array(np.full(len(first), t), pa.int32()),
                        pa.array(cell[first]), pa.ListArray.from_arrays(offsets, pa.array(key)),
                    ], ["id", "vec", "band", "tab", "cell", "keys"])

    return run


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of paired rows: one order of additions, so equal pairs give equal scores wherever they meet."""
    return (queries * vectors).sum(axis=1)


def _best(query: np.ndarray, found: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each query, nearest first, ties to the smaller id; a vector counts once."""
    order = np.lexsort((found, -score, query))
    q, f = query[order], found[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = (q[1:] != q[:-1]) | (f[1:] != f[:-1])  # the same vector has the same score, so it stands together
    order = order[first]
    q = query[order]
    begin = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.concatenate((begin, [len(q)]))))
    return order[rank < k]


def _dense_best(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
    """(query position, vector position, score) of each query's k best of these vectors, by a matrix product."""
    product = q @ x.T
    product[qids[:, None] == ids[None, :]] = -np.inf
    keep = product > -np.inf
    if len(ids) > k:
        kth = -np.partition(-product, k - 1, axis=1)[:, k - 1]
        slack = 1e-9 * (np.abs(q).max(axis=1) * np.abs(x).max() * x.shape[1] + 1e-300)
        keep &= product >= (kth - slack)[:, None]  # ties at the end are decided by the exact scores
    row, at = np.nonzero(keep)
    score = exact_scores(q[row], x[at])
    best = _best(row, ids[at], score, k)
    return row[best], at[best], score[best]


def _search(k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        """Each query's k best vectors of the buckets that it visits in this cell."""
        if not vectors.num_rows or not queries.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())),
                             "scores": pa.array([], pa.list_(pa.float64()))})
        key = vectors.column("key").to_numpy()
        order = np.argsort(key, kind="stable")
        key, ids, x = key[order], vectors.column("id").to_numpy()[order], matrix(vectors.column("vec"))[order]
        qids, q = queries.column("id").to_numpy(), matrix(queries.column("vec"))
        visits = queries.column("keys").combine_chunks()
        visitor = np.repeat(np.arange(len(qids)), np.diff(visits.offsets.to_numpy()))
        visited = visits.flatten().to_numpy()
        low, high = np.searchsorted(key, visited), np.searchsorted(key, visited, "right")
        rows, ats, scores = [], [], []

        def found(row, at, score):
            rows.append(row), ats.append(at), scores.append(score)

        dense = np.flatnonzero(high - low >= DENSE)
        for start in np.unique(low[dense]):
            here = visitor[dense[low[dense] == start]]
            end = np.searchsorted(key, key[start], "right")
            for p in range(0, len(here), QUERY_BLOCK):
                some = here[p : p + QUERY_BLOCK]
                for v in range(start, end, 4 * QUERY_BLOCK):
                    to = min(end, v + 4 * QUERY_BLOCK)
                    row, at, score = _dense_best(qids[some], q[some], ids[v:to], x[v:to], k)
                    found(some[row], v + at, score)
        thin = np.flatnonzero((high > low) & (high - low < DENSE))
        visitor, low, size = visitor[thin], low[thin], (high - low)[thin]
        begin = 0
        ends = np.cumsum(size)
        while begin < len(visitor):
            # Whole queries, up to about PAIRS pairs; a query has fewer than its buckets x DENSE.
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
            end = int(np.searchsorted(visitor, visitor[end - 1], "right"))
            n = size[begin:end]
            row = np.repeat(visitor[begin:end], n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[begin:end], n)
            other = ids[at] != qids[row]
            row, at = row[other], at[other]
            score = exact_scores(q[row], x[at])
            best = _best(row, ids[at], score, k)
            found(row[best], at[best], score[best])
            begin = end
        row, at, score = (np.concatenate(c) if c else np.zeros(0, t) for c, t in ((rows, int), (ats, int), (scores, float)))
        best = _best(row, ids[at], score, k)
        row, at, score = row[best], at[best], score[best]
        offsets = pa.array(np.searchsorted(row, np.arange(len(qids) + 1)), pa.int32())
        return pa.table({
            "query": pa.array(qids), "ids": pa.ListArray.from_arrays(offsets, pa.array(ids[at])),
            "scores": pa.ListArray.from_arrays(offsets, pa.array(score)),
        })

    return run


def _merge(k: int):
    def run(parts: pa.Table) -> pa.Table:
        """The k best of each query over all its buckets."""
        parts = parts.combine_chunks()
        ids, scores = (parts.column(c).combine_chunks() for c in ("ids", "scores"))
        size = np.diff(ids.offsets.to_numpy())
        query = np.repeat(parts.column("query").to_numpy(), size)
        found, score = ids.flatten().to_numpy(), scores.flatten().to_numpy()
        best = _best(query, found, score, k)
        query = query[best]
        begin = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, np.int64)
        rank = np.arange(len(query)) - np.repeat(begin, np.diff(np.concatenate((begin, [len(query)])))) + 1
        return pa.table({"query_id": pa.array(query, pa.int64()), "rank": pa.array(rank, pa.int32()),
                         "vec_id": pa.array(found[best], pa.int64()), "score": pa.array(score[best], pa.float64())})

    return run


def _met(rows: DataFrame, asked: DataFrame, dims: int, bands: dict[int, Index], k: int, probes: int) -> DataFrame:
    """The k best of each query over the buckets that it visits."""
    kind = rows.schema["vec"].dataType.simpleString()
    block = 2 * max(DENSE, BLOCK_BYTES // (8 * dims))
    hashed = stored(rows.mapInArrow(_hash_rows(bands), f"id long, vec {kind}, band int, keys array<long>, cells array<int>"), "ann-rows")
    probing = stored(
        asked.mapInArrow(_probe_rows(bands, probes), f"id long, vec {kind}, band int, tab int, cell int, keys array<long>"),
        "ann-queries")
    placed = hashed.select("id", "vec", "band", F.posexplode(F.arrays_zip("keys", "cells")).alias("tab", "at")).select(
        "id", "vec", "band", "tab", F.col("at.cells").alias("cell"), F.col("at.keys").alias("key"))
    # Only cells that need more than one block on a side are listed: few, and none where buckets are even.
    cell = ["band", "tab", "cell"]
    parts = [
        side.groupBy(*cell).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias(name)).where(F.col(name) > 1)
        for side, name in ((placed, "vector_parts"), (probing, "query_parts"))]
    split = stored(parts[0].join(parts[1], cell, "full"), "ann-blocks")

    def dealt(side: DataFrame, own: str, other: str, key: str, against: str) -> DataFrame:
        """Each row in one block of its own side, once for each block of the other."""
        cut = side.join(split, cell, "left")
        place = F.pmod(F.xxhash64("id"), F.coalesce(own, F.lit(1))).cast("int")
        return cut.withColumn(key, place).withColumn(
            against, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop("vector_parts", "query_parts")

    at = [*cell, "v", "q"]
    left, right = dealt(placed, "vector_parts", "query_parts", "v", "q"), dealt(probing, "query_parts", "vector_parts", "q", "v")
    met = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(
        _search(k), "query long, ids array<long>, scores array<double>")
    bins = max(1, -(-asked.count() // MERGE_QUERIES))
    return met.where(F.size("ids") > 0).groupBy(F.pmod(F.xxhash64("query"), F.lit(bins)).alias("bin")).applyInArrow(
        _merge(k), "query_id long, rank int, vec_id long, score double")


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, tables: int = TABLES, probes: int = PROBES, enough: int = ENOUGH,
    seed: int = 13, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows found with the largest inner product for every query row.

    Queries are rows of the table that `is_query` (over its columns) marks; a row is no candidate of its own id. The
    score is the inner product of the original vectors in double precision. A band of up to `enough` x k rows is one
    bucket. A query that finds fewer than k rows in its buckets is compared with all rows, in blocks.

    Vectors that are null, zero or not finite and null ids take no part; vectors of different lengths have no inner
    product, so each length is searched by itself. Rows that share an id must share their vector and count once. Of equal
    vectors only those with the k + 1 smallest ids are indexed: as they tie with the others for every query, no other can
    be among its k nearest. An empty table gives no rows.

    A cell of a table, and the queries that visit it, are cut into blocks that meet pairwise where they are large, so a
    direction in which a third of all vectors point is many tasks; a block passes on k rows a query.
    """
    spark = vectors.sparkSession
    marked = vectors.select(F.col(id_col), F.col(vec_col), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = stored(usable(marked, id_col, vec_col).dropDuplicates(["id"]), "ann-vectors")
    asked = usable(marked.where("is_query"), id_col, vec_col).select("id").distinct()
    asked = stored(rows.join(asked, "id", "left_semi"), "ann-asked")
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for d in lengths(rows):
        alike = F.size("vec") == d
        out = out.union(_nearest(rows.where(alike), asked.where(alike), d, k, tables, probes, enough, seed))
    return out


def _nearest(rows: DataFrame, asked: DataFrame, dims: int, k: int, tables: int, probes: int, enough: int, seed: int) -> DataFrame:
    """`nearest` among vectors of one length."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    longest = rows.agg(F.max(norm)).first()[0]
    # A length beyond the range of doubles has no logarithm or an infinite one, and goes to the last band.
    step = F.floor(F.least((F.log(F.lit(longest)) - F.log(norm)) / F.lit(-np.log(BAND_SHARE)), F.lit(BANDS - 1.0)))
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    apart = rows.withColumn("place", place).where(F.col("place") <= k + 1).drop("place").withColumn(
        "band", F.coalesce(step, F.lit(BANDS - 1)).cast("int"))
    sizes = sorted(apart.groupBy("band").count().collect())  # at most BANDS
    n = rows.count()
    bands = {b: index_for(b, size, dims, k, tables, enough, seed) for b, size in sizes}
    found = stored(_met(apart, asked, dims, bands, k, probes), "ann-found")
    if not any(index.widths for index in bands.values()):
        return found
    counts = found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("found")).where(F.col("found") >= min(k, n - 1))
    short = stored(asked.join(counts, "id", "left_anti"), "ann-short")
    if short.isEmpty():
        return found
    whole = _met(apart, short, dims, {b: Index(b, 1, (), 1, seed) for b in bands}, k, 1)
    return found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").select(*found.columns).union(whole)
