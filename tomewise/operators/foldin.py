"""Fold-in: factor vectors for users who were not part of the factor model.

Both methods work on sorted (item, rating) lists and on item matrices that are sent to the tasks: a vector never
travels with a rating. A list is a bounded chunk of a user's ratings, and the chunks are combined exactly, so that a
user with very many ratings is spread over tasks. A matrix beyond a checked size is not sent: its chunks are dealt out
together with the lists that need them, in one pass however many chunks there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tomewise.functions.scalars import dot
from tomewise.functions.skew import ID_BUCKET_BITS, spread
from tomewise.functions.tables import dense_index, stored

EPS = 1e-6
START = 0.5
ALPHA = 0.01
ITERATIONS = 100
#: Ratings of a chunk at most.
CHUNK_LIMIT = 1 << ID_BUCKET_BITS
#: Bytes of item vectors sent to the tasks at once.
BROADCAST_LIMIT = 128 << 20
#: Ratings composed by one triangular solve; solves held at once by a task; ratings summed at once.
SOLVE_ROWS = 32
SOLVES_PER_STEP = 512
RATINGS_PER_STEP = 1 << 16
#: Parts of one user held by a task before they are multiplied into one map.
TREE_FAN_IN = 16
#: Tasks at least that share the lists of a chunk, each with its own copy of the chunk's items.
CHUNK_SHARES = 8


def factor_size(factors: DataFrame) -> tuple[int, int]:
    """Number of factor vectors and their length."""
    row = factors.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("k")).head()
    if not row["n"]:
        raise ValueError("the factor matrix is empty")
    return row["n"], row["k"]


@dataclass(frozen=True)
class ItemRange:
    """Item vectors sorted by id."""

    ids: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def collect(items: DataFrame) -> ItemRange:
        return ItemRange.of(items.select("id", F.col("features").cast("array<double>").alias("features")).toArrow())

    @staticmethod
    def of(table: pa.Table) -> ItemRange:
        table = table.sort_by("id")
        flat = pc.list_flatten(table["features"]).to_numpy()
        return ItemRange(table["id"].to_numpy(), flat.reshape(table.num_rows, -1))

    def rows(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, ids)


class Layout:
    """Ratings of known items as one sorted list for each (user, chunk), and the ranges of items that they need.

    A user cannot have more known ratings than there are items, so up to ``chunk_limit`` items all ratings of a user
    are one chunk. Beyond, items are numbered without gaps in the order of their ids, and ``chunk_limit`` consecutive
    numbers are a chunk: however far apart the ids lie, no chunk is small for it.
    """

    def __init__(self, ratings: DataFrame, item_factors: DataFrame, chunk_limit: int, broadcast_limit: int):
        self.n_items, self.rank = factor_size(item_factors)
        self.single = self.n_items <= chunk_limit
        rows = ratings.select("user_id", "book_id", F.col("rating").cast("double").alias("rating"))
        if self.single:
            rows = rows.join(item_factors.select(F.col("id").alias("book_id")), "book_id", "left_semi")
            rows = spread(rows.withColumn("chunk", F.lit(0).cast("bigint")), "user_id")
            self.chunks, self.items = 1, item_factors.withColumn("chunk", F.lit(0).cast("bigint"))
        else:
            places = dense_index(item_factors, "id").select("id", F.expr(f"place div {chunk_limit}").alias("chunk"))
            rows = spread(rows.join(places.withColumnRenamed("id", "book_id"), "book_id"), "user_id", "chunk")
            self.chunks = -(-self.n_items // chunk_limit)
            self.items = stored(item_factors.select("id", "features").join(places, "id"), "foldin-items")
        self.rows = rows
        pairs = F.array_sort(F.collect_list(F.struct("book_id", "rating")))
        lists = rows.groupBy("user_id", "chunk").agg(pairs.alias("p"))
        self.lists = lists.select("user_id", "chunk", F.col("p.book_id").alias("books"), F.col("p.rating").alias("ratings"))
        # Chunks whose items are sent together.
        per_chunk = min(chunk_limit, self.n_items) * 8 * (self.rank + 1)
        self.width = max(1, broadcast_limit // max(1, per_chunk))

    def run(self, kernel: Callable[[pa.RecordBatch, ItemRange], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """`kernel` over all lists, each with a range of items that holds its own."""
        if self.chunks <= self.width:
            return self._run_sent(kernel, schema)
        return self._run_dealt(kernel, schema)

    def _run_sent(self, kernel: Callable, schema: str) -> DataFrame:
        shared = self.lists.sparkSession.sparkContext.broadcast(ItemRange.collect(self.items))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield from kernel(batch, shared.value)

        return self.lists.mapInArrow(run, schema)

    def _run_dealt(self, kernel: Callable, schema: str) -> DataFrame:
        """Lists and items of a chunk meet in a task, the items first; a task holds one chunk of items at a time."""
        parts = int(self.lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        shares = max(CHUNK_SHARES, -(-parts // self.chunks))
        own = {c: F.col(c) for c in self.lists.columns}
        lists = self.lists.select(
            "chunk", F.pmod(F.xxhash64("user_id"), F.lit(shares)).cast("int").alias("share"), F.lit(True).alias("is_list"),
            F.col("user_id").alias("id"), "books", own.get("ratings", F.lit(None).cast("array<double>")).alias("ratings"),
            own.get("features", F.lit(None).cast("array<double>")).alias("features"))
        items = self.items.select(
            "chunk", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(False).alias("is_list"), "id",
            F.lit(None).cast("array<bigint>").alias("books"), F.lit(None).cast("array<double>").alias("ratings"),
            F.col("features").cast("array<double>").alias("features"))
        rows = lists.unionByName(items).repartition(parts, "chunk", "share").sortWithinPartitions("chunk", "share", "is_list")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, found = None, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                is_list = batch.column("is_list")
                new = pa.Table.from_batches([batch.select(["chunk", "share", "id", "features"])]).filter(pc.invert(is_list))
                if new.num_rows:
                    held, found = new if held is None else pa.concat_tables([held, new]), None
                lists = batch.filter(is_list)
                if lists.num_rows:
                    found = ItemRange.of(held) if found is None else found
                    yield from kernel(lists.rename_columns(
                        ["user_id" if c == "id" else c for c in lists.schema.names]), found)
                # What follows needs the items of the last chunk only.
                if new.num_rows:
                    last = pc.and_(*(pc.equal(held[c], batch.column(c)[-1]) for c in ("chunk", "share")))
                    if not pc.all(last).as_py():
                        held, found = held.filter(last), None

        return rows.mapInArrow(run, schema)


PREDICTION_SCHEMA = "user_id long, book_id long, prediction double"


def predict_pairs(
    rows: DataFrame, users: DataFrame, items: DataFrame, chunk_limit: int = CHUNK_LIMIT, broadcast_limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """(user_id, book_id, prediction) of the distinct pairs of ``rows`` that both matrices (id, features) know.

    A user's vector travels with the list of its books in a chunk of items, never with a row. An id that a matrix holds
    several times gives a prediction for each.
    """
    users, items = (m.where("id IS NOT NULL AND features IS NOT NULL") for m in (users, items))
    if items.isEmpty():
        return rows.sparkSession.createDataFrame([], PREDICTION_SCHEMA)
    layout = Layout(rows.where("user_id IS NOT NULL").withColumn("rating", F.lit(0)), items, chunk_limit, broadcast_limit)
    vectors = users.select(F.col("id").alias("user_id"), F.col("features").cast("array<double>").alias("features"))
    lists = layout.rows.groupBy("user_id", "chunk").agg(F.sort_array(F.collect_set("book_id")).alias("books"))
    layout.lists = lists.join(vectors, "user_id")

    def kernel(batch: pa.RecordBatch, known: ItemRange) -> Iterator[pa.RecordBatch]:
        books, vector = batch.column("books"), pc.list_flatten(batch.column("features")).to_numpy(zero_copy_only=False)
        vector, sizes = vector.reshape(batch.num_rows, -1), pc.list_value_length(books).to_numpy()
        for part in _steps(sizes, RATINGS_PER_STEP):
            some = books.slice(part.start, part.stop - part.start)
            owner, ids = pc.list_parent_indices(some).to_numpy() + part.start, pc.list_flatten(some).to_numpy()
            low, high = (np.searchsorted(known.ids, ids, side) for side in ("left", "right"))
            many = high - low
            pair = np.repeat(np.arange(len(ids)), many)
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - low, many)
            found = np.einsum("ij,ij->i", vector[owner[pair]], known.vectors[at])
            yield pa.RecordBatch.from_arrays(
                [batch.column("user_id").take(pa.array(owner[pair])).cast(pa.int64()), pa.array(ids[pair], pa.int64()), pa.array(found)],
                ["user_id", "book_id", "prediction"])

    return layout.run(kernel, PREDICTION_SCHEMA)


def _starts(table: pa.Table, *columns: str) -> np.ndarray:
    """First rows of the runs of equal values, null being one of them."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for name in columns:
        values, null = pc.fill_null(table[name], 0).to_numpy(), table[name].is_null().to_numpy()
        new[1:] |= (values[1:] != values[:-1]) | (null[1:] != null[:-1])
    return np.flatnonzero(new)


def _whole_users(parts: DataFrame, kernel: Callable, schema: str, shorten: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """`kernel` over tables that hold all parts of their users, in the order of user, alpha and chunk.

    A user whose parts go on in the next batch waits for it; beyond TREE_FAN_IN parts, `shorten` makes one for each alpha.
    """
    rows = spread(parts, "user_id").sortWithinPartitions("user_id", "alpha", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if waiting is not None:
                table = pa.concat_tables([waiting, table])
            cut = _starts(table, "user_id")[-1]
            if cut:
                yield from kernel(table.slice(0, cut))
            waiting = table.slice(cut)
            if waiting.num_rows > TREE_FAN_IN:
                waiting = shorten(waiting)
        if waiting is not None:
            yield from kernel(waiting)

    return rows.mapInArrow(run, schema)


def _steps(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Runs of lists of about `limit` in all; one list stays whole."""
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        total += size
        if total >= limit:
            yield slice(begin, i + 1)
            begin, total = i + 1, 0
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def _flat(batch: pa.RecordBatch, part: slice) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
    """The lists of a part: keys, lengths, items and ratings."""
    rows = batch.slice(part.start, part.stop - part.start)
    books, ratings = rows.column("books"), rows.column("ratings")
    return rows, pc.list_value_length(books).to_numpy(), books.flatten().to_numpy(), ratings.flatten().to_numpy()


def _vector_column(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * (values.shape[1] if values.ndim > 1 else 0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).ravel(), pa.float64()))


PART_SCHEMA = "user_id long, chunk long, alpha double, n long, s array<double>"


def foldin_nonneg(
    ratings: DataFrame,
    item_factors: DataFrame,
    alphas: Sequence[float] = (ALPHA,),
    iterations: Sequence[int] = (ITERATIONS,),
    chunk_limit: int = CHUNK_LIMIT,
    broadcast_limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """Non-negative fold-in for every (alpha, iterations): user_id, alpha, iterations, features.

    Each pass moves the vector towards t = max(r * v / |v|^2, eps) of every rating in book order:
    u <- (1 - alpha) u + alpha t. As t does not depend on u, N passes over B ratings give, with
    q = 1 - alpha, the moving average

        q^(N B) u0 + (1 - q^(N B)) / (1 - q^B) * sum_j alpha q^(B - j) t_j

    whose sum splits over ordered chunks: inside a chunk only the distance to its end counts, and
    every later chunk of n ratings multiplies what came before by q^n. ``ratings`` has one row per
    (user, book).
    """
    layout = Layout(ratings, item_factors, chunk_limit, broadcast_limit)
    alpha_values = [float(a) for a in alphas]

    def sums(batch: pa.RecordBatch, items: ItemRange) -> Iterator[pa.RecordBatch]:
        sizes = pc.list_value_length(batch.column("books")).to_numpy()
        for part in _steps(sizes, RATINGS_PER_STEP):
            rows, n, books, stars = _flat(batch, part)
            v = items.vectors[items.rows(books)]
            norm = np.einsum("ij,ij->i", v, v)
            # A zero item vector has no step; its target is eps in every dimension.
            target = np.maximum(v * (stars / np.where(norm == 0, 1.0, norm))[:, None], EPS)
            begin = np.cumsum(n) - n
            to_end = np.repeat(begin + n, n) - 1 - np.arange(len(stars))
            for alpha in alpha_values:
                weighted = target * (alpha * (1 - alpha) ** to_end.astype(np.float64))[:, None]
                yield pa.RecordBatch.from_arrays([
                    rows.column("user_id"), rows.column("chunk"), pa.array(np.full(len(n), alpha)),
                    pa.array(n, pa.int64()), _vector_column(np.add.reduceat(weighted, begin, axis=0)),
                ], ["user_id", "chunk", "alpha", "n", "s"])

    rank = layout.rank

    def join(parts: pa.Table) -> pa.Table:
        """One part for each (user, alpha): every later chunk of n ratings multiplies what came before by q^n."""
        alpha, n, begin = parts["alpha"].to_numpy(), parts["n"].to_numpy(), _starts(parts, "user_id", "alpha")
        ends = np.cumsum(n)
        last = np.concatenate((begin[1:], [len(n)])) - 1
        after = np.repeat(ends[last], np.diff(np.concatenate((begin, [len(n)])))) - ends
        s = pc.list_flatten(parts["s"]).to_numpy().reshape(-1, rank) * ((1 - alpha) ** after.astype(np.float64))[:, None]
        return pa.table({
            "user_id": parts["user_id"].take(pa.array(begin)), "chunk": parts["chunk"].to_numpy()[last], "alpha": alpha[begin],
            "n": np.add.reduceat(n, begin), "s": _vector_column(np.add.reduceat(s, begin, axis=0)),
        })

    users = layout.run(sums, PART_SCHEMA)
    if not layout.single:
        users = _whole_users(users, lambda parts: join(parts).to_batches(), PART_SCHEMA, join)
    users = users.withColumn("b", F.col("n").cast("double"))
    q = F.lit(1.0) - F.col("alpha")
    moved = users.select(
        "user_id", "alpha", "b", F.col("s").alias("moved"),
        F.explode(F.array(*[F.lit(int(i)) for i in iterations])).alias("iterations"),
    ).withColumn("rest", F.pow(q, F.col("b") * F.col("iterations")))
    scale = (F.lit(1.0) - F.col("rest")) / (F.lit(1.0) - F.pow(q, F.col("b")))
    return moved.withColumn("scale", scale).select(
        "user_id", "alpha", "iterations",
        F.transform("moved", lambda x: F.col("rest") * START + F.col("scale") * x).alias("features"),
    )


def block_maps(v: np.ndarray, r: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Affine maps u -> A u + b of blocks of ratings, from vectors (blocks, rows, rank) and ratings (blocks, rows).

    With c_j the step of rating j, c_j = 2 alpha (r_j - v_j u - sum over i < j of c_i v_i v_j), so that L c =
    2 alpha (r - V u) for the unit lower triangle L = I + 2 alpha tril(V V', -1). One solve gives the whole block:
    A = I - 2 alpha V' L^-1 V and b = 2 alpha V' L^-1 r. A row of zeros changes nothing.
    """
    rows, rank = v.shape[1:]
    lower = np.tril(v @ v.transpose(0, 2, 1), -1) * (2 * alpha) + np.eye(rows)
    solved = np.linalg.solve(lower, np.concatenate((v, r[:, :, None]), axis=2))
    made = (2 * alpha) * (v.transpose(0, 2, 1) @ solved)
    return np.eye(rank) - made[:, :, :rank], made[:, :, rank]


def rating_blocks(n: np.ndarray, vectors: np.ndarray, ratings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of n ratings cut into blocks of SOLVE_ROWS, filled up with zeros: vectors, ratings, blocks of each list."""
    blocks = -(-n // SOLVE_ROWS)
    place = np.arange(len(ratings)) - np.repeat(np.cumsum(n) - n, n)
    block, slot = np.repeat(np.cumsum(blocks) - blocks, n) + place // SOLVE_ROWS, place % SOLVE_ROWS
    v, r = np.zeros((blocks.sum(), SOLVE_ROWS, vectors.shape[1])), np.zeros((blocks.sum(), SOLVE_ROWS))
    v[block, slot], r[block, slot] = vectors, ratings
    return v, r, blocks


def part_maps(a: pa.ListArray, b: pa.ListArray, owner: np.ndarray, rank: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """One map for each owner from its parts in order: a part is a map, or fewer than `rank` vectors and their ratings.

    Neighbouring parts of ratings are one list, so that many short parts cost no more than a long one.
    """
    sizes = pc.list_value_length(a).to_numpy()
    is_map, n = sizes == rank * rank, pc.list_value_length(b).to_numpy()
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | is_map[1:] | is_map[:-1]))
    begin = np.flatnonzero(new)
    seg_map, seg_n = is_map[begin], np.add.reduceat(n, begin)
    flat_a, flat_b = pc.list_flatten(a).to_numpy(), pc.list_flatten(b).to_numpy()
    in_map = np.repeat(is_map, sizes)
    units = np.where(seg_map, 1, -(-seg_n // SOLVE_ROWS))
    offset = np.cumsum(units) - units
    unit_a, unit_b = np.empty((units.sum(), rank, rank)), np.empty((units.sum(), rank))
    if seg_map.any():
        unit_a[offset[seg_map]] = flat_a[in_map].reshape(-1, rank, rank)
        unit_b[offset[seg_map]] = flat_b[np.repeat(is_map, n)].reshape(-1, rank)
    if not seg_map.all():
        v, r, blocks = rating_blocks(seg_n[~seg_map], flat_a[~in_map].reshape(-1, rank), flat_b[~np.repeat(is_map, n)])
        at = np.repeat(offset[~seg_map] - np.cumsum(blocks) + blocks, blocks) + np.arange(blocks.sum())
        unit_a[at], unit_b[at] = block_maps(v, r, alpha)
    return tree_product(unit_a, unit_b, np.repeat(owner[begin], units))


def tree_product(a: np.ndarray, b: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One map for each owner: its maps (neighbours, in order) multiplied pair by pair, round by round."""
    while len(owner) > 1 and (owner[1:] == owner[:-1]).any():
        first = np.concatenate(([True], owner[1:] != owner[:-1]))
        place = np.arange(len(owner)) - np.maximum.accumulate(np.where(first, np.arange(len(owner)), 0))
        left = np.flatnonzero(place % 2 == 0)
        paired = np.flatnonzero((left + 1 < len(owner)) & (owner[np.minimum(left + 1, len(owner) - 1)] == owner[left]))
        one, two = left[paired], left[paired] + 1
        new_a, new_b = a[left], b[left]
        new_a[paired] = a[two] @ a[one]
        new_b[paired] = (a[two] @ b[one][:, :, None])[:, :, 0] + b[two]
        a, b, owner = new_a, new_b, owner[left]
    return a, b


def after_passes(a: np.ndarray, b: np.ndarray, passes: int) -> np.ndarray:
    """Vectors after repeating u -> a u + b, for many users at once, by repeated squaring of the maps."""
    u = np.full(b.shape, START)
    while passes:
        if passes & 1:
            u = (a @ u[:, :, None])[:, :, 0] + b
        passes >>= 1
        if passes:
            a, b = a @ a, (a @ b[:, :, None])[:, :, 0] + b
    return u


MAP_SCHEMA = "user_id long, alpha double, chunk long, a array<double>, b array<double>"
FACTOR_SCHEMA = "user_id long, alpha double, iterations int, features array<double>"


def foldin_gradient(
    ratings: DataFrame,
    item_factors: DataFrame,
    alphas: Sequence[float] = (ALPHA,),
    iterations: Sequence[int] = (ITERATIONS,),
    chunk_limit: int = CHUNK_LIMIT,
    broadcast_limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """Gradient fold-in for every (alpha, iterations): user_id, alpha, iterations, features.

    A rating r of an item v moves the vector by the affine map u <- (I - 2 alpha v v') u + 2 alpha r v. The maps of a
    block of ratings come from one triangular solve, many blocks at a time; a pass is their product, taken as a tree
    inside a chunk and over a user's chunks, and N passes are its N-th power. A chunk with fewer ratings than the rank
    travels to its user as those ratings, any other as its map. Values that diverge come out as
    non-finite numbers.
    """
    layout = Layout(ratings, item_factors, chunk_limit, broadcast_limit)
    alpha_values, pass_counts = [float(a) for a in alphas], [int(i) for i in iterations]

    def vectors(users: pa.Array, alpha: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        for passes in pass_counts:
            yield pa.RecordBatch.from_arrays([
                users, pa.array(alpha), pa.array(np.full(len(alpha), passes), pa.int32()),
                _vector_column(after_passes(a, b, passes)),
            ], ["user_id", "alpha", "iterations", "features"])

    def compose(batch: pa.RecordBatch, items: ItemRange) -> Iterator[pa.RecordBatch]:
        sizes = pc.list_value_length(batch.column("books")).to_numpy()
        if not single:
            few = pa.array(sizes < layout_rank)
            yield from thin(batch.filter(few), items)
            batch = batch.filter(pc.invert(few))
            sizes = pc.list_value_length(batch.column("books")).to_numpy()
        for part in _steps(-(-sizes // SOLVE_ROWS), SOLVES_PER_STEP):
            rows, n, books, stars = _flat(batch, part)
            v, r, blocks = rating_blocks(n, items.vectors[items.rows(books)], stars)
            owner = np.repeat(np.arange(len(n)), blocks)
            for alpha in alpha_values:
                with np.errstate(all="ignore"):
                    a, b = tree_product(*block_maps(v, r, alpha), owner)
                    if single:
                        yield from vectors(rows.column("user_id"), np.full(len(n), alpha), a, b)
                        continue
                yield pa.RecordBatch.from_arrays([
                    rows.column("user_id"), pa.array(np.full(len(n), alpha)), rows.column("chunk"),
                    _vector_column(a.reshape(len(n), -1)), _vector_column(b),
                ], ["user_id", "alpha", "chunk", "a", "b"])

    def thin(batch: pa.RecordBatch, items: ItemRange) -> Iterator[pa.RecordBatch]:
        """Lists shorter than the rank as the vectors and ratings of their rows, which are smaller than their map."""
        for part in _steps(pc.list_value_length(batch.column("books")).to_numpy(), RATINGS_PER_STEP):
            rows, n, books, stars = _flat(batch, part)
            offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            v = pa.array(items.vectors[items.rows(books)].ravel(), pa.float64())
            for alpha in alpha_values:
                yield pa.RecordBatch.from_arrays([
                    rows.column("user_id"), pa.array(np.full(len(n), alpha)), rows.column("chunk"),
                    pa.ListArray.from_arrays(pa.array(offsets * np.int32(layout_rank)), v),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(stars, pa.float64())),
                ], ["user_id", "alpha", "chunk", "a", "b"])

    layout_rank, single = layout.rank, layout.single
    if single:
        return layout.run(compose, FACTOR_SCHEMA)

    def multiply(parts: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
        """Steps of users of one alpha: their parts, the first part of each, and their maps."""
        for alpha in alpha_values:
            mine = parts.filter(pc.equal(parts["alpha"], alpha)).combine_chunks()
            if not mine.num_rows:
                continue
            begin = _starts(mine, "user_id")
            sizes = pc.list_value_length(mine["b"]).to_numpy()
            for step in _steps(np.add.reduceat(-(-sizes // SOLVE_ROWS), begin), SOLVES_PER_STEP):
                low, high = begin[step.start], begin[step.stop] if step.stop < len(begin) else mine.num_rows
                some = mine.slice(low, high - low).combine_chunks()
                first = begin[step] - low
                owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, high - low)))
                with np.errstate(all="ignore"):
                    a, b = part_maps(some["a"].combine_chunks(), some["b"].combine_chunks(), owner, layout_rank, alpha)
                yield some, first, a, b

    def finish(parts: pa.Table) -> Iterator[pa.RecordBatch]:
        for some, first, a, b in multiply(parts):
            at = some.take(pa.array(first))
            with np.errstate(all="ignore"):
                yield from vectors(at["user_id"].combine_chunks(), at["alpha"].to_numpy(), a, b)

    def shorten(parts: pa.Table) -> pa.Table:
        return pa.concat_tables([
            some.take(pa.array(first)).select(["user_id", "alpha", "chunk"])
            .append_column("a", _vector_column(a.reshape(len(a), -1))).append_column("b", _vector_column(b))
            for some, first, a, b in multiply(parts)
        ])

    return _whole_users(layout.run(compose, MAP_SCHEMA), finish, FACTOR_SCHEMA, shorten)


def foldin_error(ratings: DataFrame, item_factors: DataFrame, user_factors: DataFrame) -> DataFrame:
    """Mean squared residual over the known books of each (user, alpha, iterations)."""
    factors = item_factors.select(F.col("id").alias("book_id"), F.col("features").alias("v"))
    users = user_factors.withColumnRenamed("features", "u")
    residual = F.col("rating") - dot("u", "v")
    return (
        ratings.select("user_id", "book_id", F.col("rating").cast("double").alias("rating"))
        .join(factors, "book_id").join(users, "user_id")
        .groupBy("user_id", "alpha", "iterations")
        .agg(F.avg(residual * residual).alias("error"), F.count("*").alias("n_known"))
    )


def factors_long(user_factors: DataFrame) -> DataFrame:
    """One row per (user, setting, dimension)."""
    return user_factors.select("user_id", "alpha", "iterations", F.posexplode("features").alias("dim", "value"))
