"""Similarity self-join of vectors by epsilon grid order.

Unit vectors within a cosine are within an epsilon of each other. Vectors are put in the order of their grid cells of
that width on the leading principal dimensions. The sequence is cut into intervals, and pairs of intervals are joined
recursively: a pair whose bounding boxes are more than epsilon apart is skipped with everything below it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tomewise.llm.tables import components, stored
from tomewise.llm.vectors import lengths, matrix, unit, usable

COSINE = 0.9
#: Leading principal dimensions of the grid; the sample that they are taken from.
DIMENSIONS = 6
SAMPLE_VECTORS = 8192
#: Vectors of an interval that is a row of the block table, of the intervals inside a task, and children of a node.
INTERVAL = 4096
LEAF = 512
FANOUT = 8
#: Float products this close to the limit are decided in double precision.
SLACK = 1e-4

LONGS = pa.list_(pa.int64())
BLOCKS = "block long, ids array<long>, weights array<long>, vecs array<double>, low array<double>, high array<double>"


def principal_axes(rows: np.ndarray, count: int) -> np.ndarray:
    """The leading principal axes of the rows, as columns."""
    centred = rows - rows.mean(axis=0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    return np.ascontiguousarray(axes[:, ::-1][:, :count])


def grid_cells(rows: np.ndarray, axes: np.ndarray, width: float) -> np.ndarray:
    """The cell of each unit row as one number that keeps the lexicographic order of its coordinates."""
    per_axis = 2 * int(np.ceil(1 / width)) + 2
    cell = np.clip(np.floor((rows @ axes) / width).astype(np.int64) + per_axis // 2, 0, per_axis - 1)
    out = np.zeros(len(rows), dtype=np.int64)
    for k in range(cell.shape[1]):
        out = out * per_axis + cell[:, k]
    return out


def _apart(low_a, high_a, low_b, high_b) -> np.ndarray:
    """Squared distance of bounding boxes."""
    gap = np.maximum(np.maximum(low_a - high_b, low_b - high_a), 0)
    return (gap * gap).sum(axis=-1)


class _Star:
    """Smallest linked position of each vector of two intervals, kept while their leaves are joined."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        root = self.parent[at]
        while True:
            up = self.parent[root]
            if (up == root).all():
                return root
            root = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


def join_intervals(
    ids: list[np.ndarray], weights: list[np.ndarray], rows: list[np.ndarray], axes: np.ndarray, cosine: float, itself: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join two intervals of vectors (or one with itself): (ids, linked weight of each, edges between ids).

    The edges span the linked vectors; linked weights count every link.
    """
    epsilon = 2 - 2 * cosine + 1e-9
    sides = []
    for id_, w, x in zip(ids, weights, rows):
        u = unit(x)
        turned = u @ axes
        parts = range(0, len(u), LEAF)
        low = np.array([turned[p : p + LEAF].min(axis=0) for p in parts])
        high = np.array([turned[p : p + LEAF].max(axis=0) for p in parts])
        sides.append((id_, w, u, u.astype(np.float32), low, high))
    (id_a, w_a, a, fa, low_a, high_a), (id_b, w_b, b, fb, low_b, high_b) = sides[0], sides[-1]
    shift = 0 if itself else len(a)
    count, star = np.zeros(len(a) + (0 if itself else len(b)), dtype=np.int64), _Star(len(a) + (0 if itself else len(b)))
    stack = [(0, len(low_a), 0, len(low_b))]
    while stack:
        i, ni, j, nj = stack.pop()
        if itself and j + nj <= i:
            continue
        if _apart(low_a[i : i + ni].min(0), high_a[i : i + ni].max(0), low_b[j : j + nj].min(0), high_b[j : j + nj].max(0)) > epsilon:
            continue
        if ni > 1 or nj > 1:
            hi, hj = (ni + 1) // 2, (nj + 1) // 2
            stack += [(p, m, q, n) for p, m in ((i, hi), (i + hi, ni - hi)) if m for q, n in ((j, hj), (j + hj, nj - hj)) if n]
            continue
        if itself and j < i:
            continue
        p, q = i * LEAF, j * LEAF
        product = fa[p : p + LEAF] @ fb[q : q + LEAF].T
        x, y = np.nonzero(product >= cosine - SLACK)
        close = product[x, y] < cosine + SLACK
        keep = ~close
        keep[close] = (a[p + x[close]] * b[q + y[close]]).sum(axis=1) >= cosine
        if itself and i == j:
            keep &= x < y
        x, y = p + x[keep], q + y[keep]
        if len(x):
            count += np.bincount(x, weights=w_b[y], minlength=len(count)).astype(np.int64)
            count += np.bincount(y + shift, weights=w_a[x], minlength=len(count)).astype(np.int64)
            star.link(x, y + shift)
    every = id_a if itself else np.concatenate((id_a, id_b))
    root = star.roots(np.arange(len(every)))
    moved = np.flatnonzero(root != np.arange(len(every)))
    return every, count, np.column_stack((every[moved], every[root[moved]]))


def _pack(axes: np.ndarray):
    def run(part: pa.Table) -> pa.Table:
        """One interval: its vectors in the order of the grid, and their bounding box on the leading dimensions."""
        part = part.sort_by([("cell", "ascending"), ("id", "ascending")])
        x = matrix(part.column("vec"))
        turned = unit(x) @ axes
        doubles = pa.list_(pa.float64())
        return pa.table({
            "block": part.column("block").slice(0, 1), "ids": pa.array([part.column("id").to_numpy()], LONGS),
            "weights": pa.array([part.column("weight").to_numpy()], LONGS), "vecs": pa.array([x.ravel()], doubles),
            "low": pa.array([turned.min(axis=0)], doubles), "high": pa.array([turned.max(axis=0)], doubles),
        })

    return run


def _join_pairs(axes: np.ndarray, cosine: float):
    def run(batches):
        for batch in batches:
            for row in range(len(batch)):
                itself = batch.column("i")[row].as_py() == batch.column("j")[row].as_py()
                ids, weights, rows = [], [], []
                for side in ("a", "b")[: 1 if itself else 2]:
                    ids.append(batch.column(f"ids_{side}")[row].values.to_numpy())
                    weights.append(batch.column(f"weights_{side}")[row].values.to_numpy())
                    rows.append(batch.column(f"vecs_{side}")[row].values.to_numpy().reshape(len(ids[-1]), -1))
                every, count, edges = join_intervals(ids, weights, rows, axes, cosine, itself)
                some = count > 0
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate((every[some], edges[:, 0])), pa.int64()),
                    pa.array(np.concatenate((np.zeros(some.sum(), np.int64), edges[:, 1])), pa.int64()),
                    pa.array(np.concatenate((count[some], np.zeros(len(edges), np.int64))), pa.int64()),
                ], ["id", "other", "links"])

    return run


def interval_pairs(blocks: DataFrame, blocks_count: int, epsilon: float) -> DataFrame:
    """(i, j) with i <= j: the pairs of intervals that may hold linked vectors.

    The tree over the intervals is joined from the root down: each level's remaining pairs are split into pairs of
    children by equality joins, and those whose boxes are too far apart go.
    """
    boxes = blocks.select("block", "low", "high")
    levels = [boxes]
    count = blocks_count
    while count > 1:
        m = len(blocks.select("low").first()[0])
        levels.append(levels[-1].groupBy(F.floor(F.col("block") / FANOUT).alias("block")).agg(
            F.array(*[F.min(F.col("low")[k]) for k in range(m)]).alias("low"),
            F.array(*[F.max(F.col("high")[k]) for k in range(m)]).alias("high")))
        count = -(-count // FANOUT)
    gap = F.aggregate(
        F.arrays_zip("low_i", "high_i", "low_j", "high_j"), F.lit(0.0),
        lambda total, b: total + F.pow(F.greatest(b["low_i"] - b["high_j"], b["low_j"] - b["high_i"], F.lit(0.0)), F.lit(2)))
    pairs = levels[-1].select(F.col("block").alias("i"), F.col("block").alias("j"))
    for level in reversed(levels[:-1]):
        up = level.withColumn("up", F.floor(F.col("block") / FANOUT))
        left = up.select(F.col("up").alias("i"), *[F.col(c).alias(f"{c}_i") for c in ("block", "low", "high")])
        right = up.select(F.col("up").alias("j"), *[F.col(c).alias(f"{c}_j") for c in ("block", "low", "high")])
        pairs = stored(
            pairs.join(left, "i").join(right, "j").where("block_i <= block_j").where(gap <= epsilon)
            .select(F.col("block_i").alias("i"), F.col("block_j").alias("j")), "ego-pairs")
    return pairs


def cosine_groups(
    vectors: DataFrame, cosine: float = COSINE, dimensions: int = DIMENSIONS, interval: int = INTERVAL,
    id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every id: links with cosine >= `cosine` to other vectors, the smallest
    id reachable by links (its own included), and whether that is its own.

    Null, zero or non-finite vectors link with nothing; vectors of different lengths do not link, and each length is
    joined by itself. Rows that share an id must share their vector and are one
    vector; rows with a null id stay, one for all, with null component and not kept. Equal vectors are joined once,
    weighted by how many they are. An empty table gives no rows.

    The principal dimensions come from a bounded sample; they steer only the order and the skipping, not the result.
    Cells with many vectors are several intervals, so no task holds more than two intervals of `interval` vectors.
    """
    if not -1 < cosine < 1:
        raise ValueError("the cosine must lie between -1 and 1")
    every = vectors.select(F.col(id_col).cast("long").alias("id")).distinct()
    rows = usable(vectors, id_col, vec_col).dropDuplicates(["id"])
    found = vectors.sparkSession.createDataFrame([], "id long, n_links long, component_id long")
    for d in lengths(rows):
        found = found.union(_linked(rows.where(F.size("vec") == d), cosine, dimensions, interval))
    out = every.join(found, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _linked(rows: DataFrame, cosine: float, dimensions: int, interval: int) -> DataFrame:
    """(id, n_links, component_id) of vectors of one length."""
    spark = rows.sparkSession
    alike = rows.groupBy("vec").agg(F.min("id").alias("first"), F.count("*").alias("weight"))
    alike = stored(alike, "ego-vectors")
    width = float(np.sqrt(2 - 2 * cosine))
    share = max(1, alike.count() // SAMPLE_VECTORS)
    sample = alike.where(F.pmod(F.xxhash64("first", F.lit(3)), F.lit(share)) == 0).select("vec").limit(2 * SAMPLE_VECTORS).toArrow()
    sample = unit(matrix(sample.column("vec"))) if sample.num_rows else unit(matrix(alike.select("vec").limit(1).toArrow().column("vec")))
    axes = principal_axes(sample, min(dimensions, sample.shape[1]))

    def place(batches):
        for batch in batches:
            x = unit(matrix(batch.column(1))) if len(batch) else np.zeros((0, len(axes)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(grid_cells(x, axes, width), pa.int64())], ["id", "vec", "weight", "cell"])

    kind = alike.schema["vec"].dataType.simpleString()
    placed = alike.select(F.col("first").alias("id"), "vec", "weight").mapInArrow(place, f"id long, vec {kind}, weight long, cell long")
    # The cells' counts (a fixed number of cells at most) give each cell its intervals in the order of the grid.
    counts = placed.groupBy("cell").count().orderBy("cell").collect()
    starts, at, room = [], -1, 0
    for cell, size in counts:
        if size > room:
            at, room = at + 1, interval
        pieces = -(-size // interval)
        starts.append((cell, at, pieces))
        if pieces > 1:
            at, room = at + pieces - 1, 0
        else:
            room -= size
    table = spark.createDataFrame(starts, "cell long, start long, pieces long")
    blocks = placed.join(F.broadcast(table), "cell").withColumn(
        "block", F.col("start") + F.pmod(F.xxhash64("id", F.lit(5)), F.col("pieces")))
    blocks = stored(blocks.groupBy("block").applyInArrow(_pack(axes), BLOCKS), "ego-blocks")
    pairs = interval_pairs(blocks, at + 1, 2 - 2 * cosine + 1e-9)
    sides = [blocks.select(F.col("block").alias(k), *[F.col(c).alias(f"{c}_{s}") for c in ("ids", "weights", "vecs")])
             for k, s in (("i", "a"), ("j", "b"))]
    met = pairs.join(sides[0], "i").join(sides[1], "j").mapInArrow(_join_pairs(axes, cosine), "id long, other long, links long")
    met = stored(met, "ego-links")
    links = met.where("links > 0").groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(met.where("links = 0"), "id", "other")
    merged = alike.join(links, F.col("first") == F.col("id"), "left").drop("id")
    merged = merged.join(groups, F.col("first") == F.col("node"), "left").select(
        "vec", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "first").alias("component_id"))
    return rows.join(merged, "vec").select("id", "n_links", "component_id")


def cosine_sql(cosine: float = COSINE) -> str:
    return f"""
    WITH RECURSIVE usable AS (
      SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), links AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
      ON a.vec_id < b.vec_id AND list_cosine_similarity(a.v, b.v) >= {cosine}
    ), twoway AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(id, other) AS (
      SELECT DISTINCT vec_id, vec_id FROM embeddings UNION SELECT r.id, t.b FROM reach r JOIN twoway t ON t.a = r.other
    ), low AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
    counted AS (SELECT a AS id, count(*) AS n FROM twoway GROUP BY a)
    SELECT low.id AS vec_id, coalesce(c.n, 0)::BIGINT AS n_links, low.component_id, low.id = low.component_id AS kept
    FROM low LEFT JOIN counted c ON c.id = low.id
    """
