"""Ranked lexical search over two trees: items on one side, documents on the other.

An item is the vector of its terms' weights, a document the vector of what one unit of weight would score, and a score
their inner product. A node of either tree holds the greatest coordinate of the vectors below it, so the product of two
nodes is no less than any score between them. Where it is below the weakest k-th score of the node's items, the whole
block of items by documents is passed over, and nothing that could enter a list is lost.

1. Documents are read once and projected to the terms of the items. Document counts are summed by Spark.
2. The projections are dealt out by the group of items that a document resembles most, then by length, so that the
   coordinates below a node are alike. Trees hold a few thousand documents.
3. For a start each item descends every tree along its best nodes. The k-th best of what all trees find is a score that
   the true k-th best cannot be below.
4. With these, both trees are searched from their roots. Every tree gives its best k rows for each item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tomewise.llm.tables import stored
from tomewise.llm.terms import LETTERS_DIGITS, counts_by_text, lists, term_column
from tomewise.llm.words import as_bytes, slices

TOP = 10
#: Items searched together: their terms are sent to all tasks.
ITEM_BLOCK = 1024
#: Children of a document node, from the documents upwards, the last for all levels above; children of an item node.
FAN_OUTS = (2, 2, 2, 4, 4, 8)
ITEM_FAN_OUT = 4
#: Groups of items by which documents are dealt out; cells of a tree's matrix (4 bytes each).
GROUPS = 16
CELLS = 1 << 23
SLICE_BYTES = 16 << 20

PROJECTED = "doc_id long, n long, terms array<int>, times array<long>, total boolean"
FOUND = "item int, doc_id long, score long"


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term), distinct; rows that share an id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            terms, first = term_column(texts, LETTERS_DIGITS)
            at = np.repeat(np.arange(len(texts)), np.diff(first))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), terms.cast(pa.binary())], ["item_id", "term"])

    return items.select(F.col(id_col).alias("item_id"), F.col(text_col)).mapInArrow(
        run, f"item_id {items.schema[id_col].dataType.simpleString()}, term binary").distinct()


def project(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Each document's number of terms and its counts of the vocabulary.

    Rows with `total` sum up a task: n is its terms, terms and times the documents that hold each term, and a term
    numbered one past the vocabulary its documents with any term.
    """
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(known.value, pa.large_binary())
        holding, length = np.zeros(len(words) + 1, dtype=np.int64), 0
        for batch in batches:
            ids, all_texts = batch.column(0), as_bytes(batch.column(1))
            for part in slices(all_texts, SLICE_BYTES):
                texts = all_texts[part]
                tokens, first = term_column(texts, LETTERS_DIGITS)
                n = np.diff(first)
                codes = pc.fill_null(pc.index_in(tokens, value_set=words), -1).to_numpy()
                code, text, times = counts_by_text(codes, first)
                holding[:-1] += np.bincount(code, minlength=len(words))
                holding[-1] += np.count_nonzero(n)
                length += int(n.sum())
                order = np.argsort(text, kind="stable")
                some = np.unique(text)
                begin = np.searchsorted(text[order], some)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(part.start, len(texts)).take(pa.array(some)), pa.array(n[some], pa.int64()),
                    lists(begin, code[order], pa.int32()), lists(begin, times[order], pa.int64()),
                    pa.array(np.zeros(len(some), dtype=bool)),
                ], ["doc_id", "n", "terms", "times", "total"])
        at = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([
            pa.nulls(1, pa.int64()), pa.array([length], pa.int64()), pa.array([at], pa.list_(pa.int32())),
            pa.array([holding[at]], pa.list_(pa.int64())), pa.array([True]),
        ], ["doc_id", "n", "terms", "times", "total"])

    return docs.mapInArrow(run, PROJECTED)


def unit_scores(n: np.ndarray, times: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a weight of 1 scores: (10^9 tf) div (1000 tf + 8 m), with m = 10 + (90 n N) div L."""
    if len(n) and int(n.max()) * documents * 90 < 1 << 62:
        m = 10 + 90 * n * documents // max(1, length)
    else:
        m = np.array([10 + 90 * int(x) * documents // max(1, length) for x in n], dtype=np.int64)
    return 1_000_000_000 * times // (1000 * times + 8 * m)


def by_likeness(vectors: np.ndarray, items: np.ndarray) -> list[int]:
    """Items in an order in which halves, quarters and so on are alike: halved again and again between two far ones."""
    if len(items) <= ITEM_FAN_OUT:
        return items.tolist()
    own = vectors[items]
    one = int((own @ own.sum(axis=0)).argmin())
    other = int((own @ own[one]).argmin())
    order = items[np.argsort(own @ (own[other] - own[one]), kind="stable")]
    half = len(items) // 2
    return by_likeness(vectors, order[:half]) + by_likeness(vectors, order[half:])


class ItemTree:
    """Nodes of a tree over items, level by level from the root: (terms, items below, children).

    The greatest weight of a term among items is its weight, as all items weigh it alike; a node needs its terms only.
    `groups` holds the sums of the unit vectors of up to GROUPS runs of like items.
    """

    def __init__(self, items: list[np.ndarray], weights: np.ndarray):
        vectors = np.zeros((len(items), len(weights)), dtype=np.float32)
        for i, terms in enumerate(items):
            vectors[i, terms] = weights[terms]
        vectors /= np.maximum(1e-9, np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)))
        order = by_likeness(vectors, np.arange(len(items)))
        self.groups = np.stack([vectors[part].sum(axis=0) for part in np.array_split(order, min(GROUPS, len(order)))])
        level = [(items[i], np.array([i]), []) for i in order]
        self.weights, self.levels = weights.astype(np.float64), [level]
        while len(level) > 1:
            made = []
            for at in range(0, len(level), ITEM_FAN_OUT):
                below = level[at : at + ITEM_FAN_OUT]
                made.append((
                    np.unique(np.concatenate([b[0] for b in below])), np.concatenate([b[1] for b in below]),
                    list(range(at, at + len(below)))))
            level = made
            self.levels.insert(0, level)


class DocTree:
    """Greatest coordinates of runs of documents: `levels[0]` is the root, the last level the documents themselves."""

    def __init__(self, ids: pa.Array, matrix: np.ndarray):
        self.ids, self.rows = ids, len(ids)
        self.levels, self.widths = [matrix], []
        while len(self.levels[0]) > 1:
            width = FAN_OUTS[min(len(self.widths), len(FAN_OUTS) - 1)]
            below = self.levels[0]
            self.levels.insert(0, np.maximum.reduceat(below, np.arange(0, len(below), width), axis=0))
            self.widths.insert(0, width)

    def bounds(self, level: int, nodes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Products with an item node. Sums of whole numbers below 2^53 are exact in doubles."""
        return self.levels[level][np.ix_(nodes, terms)].astype(np.float64) @ weights[terms]

    def children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        width = self.widths[level]
        below = (nodes[:, None] * width + np.arange(width)).ravel()
        return below[below < len(self.levels[level + 1])]


def trees(batches: Iterator[pa.RecordBatch], terms: int, documents: int, length: int) -> Iterator[DocTree]:
    """Trees over the documents in the order they come."""
    capacity = max(32, CELLS // max(1, terms) // 32 * 32)
    for batch in batches:
        for at in range(0, batch.num_rows, capacity):
            part = batch.slice(at, capacity)
            term, times = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
            per_doc = pc.list_value_length(part.column(2)).to_numpy()
            doc = np.repeat(np.arange(part.num_rows), per_doc)
            matrix = np.zeros((part.num_rows, terms), dtype=np.float32)  # coordinates are whole and below 2^24
            matrix[doc, term] = unit_scores(part.column(1).to_numpy()[doc], times, documents, length)
            yield DocTree(part.column(0), matrix)


class Best:
    """The best k rows of each item so far, and the scores below which nothing more can enter."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor.astype(np.float64)
        self.held: list[list[tuple[int, int | None]]] = [[] for _ in floor]

    def add(self, item: int, scores: np.ndarray, ids: list) -> None:
        rows = self.held[item] + [(-int(s), i) for s, i in zip(scores, ids) if s > 0]
        rows.sort(key=lambda r: (r[0], r[1] is None, r[1] or 0))
        self.held[item] = rows[: self.k]
        if len(rows) >= self.k:
            self.floor[item] = max(self.floor[item], -self.held[item][-1][0])

    def rows(self) -> pa.RecordBatch:
        flat = [(i, doc, -s) for i, rows in enumerate(self.held) for s, doc in rows]
        columns = zip(*flat) if flat else ([], [], [])
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])


def descend(tree: DocTree, items: ItemTree, best: Best) -> None:
    """Every item goes down along its best k nodes, so that a tree with that many documents gives it k scores."""
    deepest = len(tree.levels) - 1
    for terms, which, _ in items.levels[-1]:
        item, nodes = int(which[0]), np.zeros(1, dtype=np.int64)
        for level in range(deepest + 1):
            bounds = tree.bounds(level, nodes, terms, items.weights)
            good = np.flatnonzero((bounds > 0) & (bounds >= best.floor[item]))
            if not len(good):
                break
            if level == deepest:
                best.add(item, bounds[good], tree.ids.take(pa.array(nodes[good])).to_pylist())
            else:
                nodes = tree.children(level, nodes[good[np.argsort(-bounds[good], kind="stable")[: best.k]]])


def search(tree: DocTree, items: ItemTree, best: Best) -> np.ndarray:
    """Both trees from their roots, a level of each at a time; returns how many documents were scored and nodes bounded."""
    scored, bounded, deepest = 0, 0, len(tree.levels) - 1
    # (item level, item node, document level, document nodes)
    open_pairs = [(0, 0, 0, np.zeros(1, dtype=np.int64))]
    while open_pairs:
        item_level, item_node, level, nodes = open_pairs.pop()
        terms, which, below = items.levels[item_level][item_node]
        bounds = tree.bounds(level, nodes, terms, items.weights)
        if level == deepest and not below:
            scored += len(nodes)
            item = int(which[0])
            good = (bounds > 0) & (bounds >= best.floor[item])
            best.add(item, bounds[good], tree.ids.take(pa.array(nodes[good])).to_pylist())
            continue
        bounded += len(nodes)
        # Equal to the weakest k-th score may still win by a smaller id.
        left = nodes[(bounds > 0) & (bounds >= best.floor[which].min())]
        if not len(left):
            continue
        if level < deepest and (not below or level <= item_level):
            left, level = tree.children(level, left), level + 1
        if below:
            open_pairs += [(item_level + 1, b, level, left) for b in below]
        else:
            open_pairs.append((item_level, item_node, level, left))
    return np.array([scored, bounded])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, block: list[tuple[object, list[bytes]]], k: int, parts: int | None) -> tuple[DataFrame, tuple]:
    """(item, rank, doc_id, score) for the numbered items of a block; pairs scored, nodes bounded, and all pairs there are."""
    vocabulary = sorted({t for _, terms in block for t in terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    projected = stored(project(docs, vocabulary), "dualtree-projected")
    totals = projected.where("total")
    length = totals.agg(F.sum("n")).first()[0] or 0
    counts = totals.select(F.explode(F.arrays_zip("terms", "times")).alias("x")).groupBy("x.terms").agg(F.sum("x.times")).collect()
    holding = np.zeros(len(vocabulary) + 1, dtype=np.int64)
    for term, times in counts:
        holding[term] = times
    documents = int(holding[-1])
    weights = np.array([weight(documents, int(h)) for h in holding[:-1]], dtype=np.int64)
    terms = len(vocabulary)

    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(ItemTree([np.array(sorted(number[t] for t in x)) for _, x in block], weights))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = sent.value.groups.T.copy()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                term, times = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
                begin = np.concatenate(([0], np.cumsum(pc.list_value_length(part.column(2)).to_numpy())))[:-1]
                like = np.add.reduceat(groups[term] * (times / (times + 1.0))[:, None].astype(np.float32), begin, axis=0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(like.argmax(axis=1), pa.int32())], [*part.schema.names, "alike"])

    # Documents without any item term have no score above 0.
    thin = projected.where("NOT total AND size(terms) > 0").select("doc_id", "n", "terms", "times")
    thin = thin.mapInArrow(keyed, "doc_id long, n long, terms array<int>, times array<long>, alike int")
    order = ["alike", "n", F.xxhash64("doc_id")]
    # The number is given, as thin rows that take much work must not be merged into few tasks for their small size.
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = thin.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("alike")
    dealt = stored(dealt, "dualtree-dealt")

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        best = Best(np.zeros(len(block)), k)
        for tree in trees(batches, terms, documents, length):
            descend(tree, items, best)
        yield best.rows()

    floors = _ranked(dealt.mapInArrow(start, FOUND), k).groupBy("item").agg(F.min("score"), F.count("*")).collect()
    floor = np.zeros(len(block))
    for item, score, held in floors:
        floor[item] = score if held == k else 0

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, work, rows = sent.value, np.zeros(2, dtype=np.int64), 0
        best = Best(floor, k)
        for tree in trees(batches, terms, documents, length):
            work += search(tree, items, best)
            rows += tree.rows
        yield best.rows()
        # Rows without an item tell how much work the pruning left.
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(3, pa.int32()), pa.array([0, 1, 2], pa.int64()), pa.array([*work, rows * len(block)], pa.int64())],
            ["item", "doc_id", "score"])

    found = stored(dealt.mapInArrow(finish, FOUND), "dualtree-found")
    work = {r.doc_id: r.s for r in found.where("item IS NULL").groupBy("doc_id").agg(F.sum("score").alias("s")).collect()}
    return _ranked(found.where("item IS NOT NULL"), k), tuple(work.get(i, 0) for i in range(3))


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = TOP, item_block: int = ITEM_BLOCK, parts: int | None = None,
    work: list[tuple] | None = None,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item with a score above 0, ties to the smaller id.

    Null and empty texts have no terms: such documents are not found and not counted, such items have no rows. Rows of
    `items` that share an id (null too) are one item with the terms of all. Rows of `docs` that repeat an id are
    documents of their own; a null id comes after all others in a tie. Without documents or items there are no rows.
    Other columns are not read.

    Items are taken in blocks of `item_block`; only the terms of a block are on the driver and in every task, and the
    documents are read once for each block. `work` receives (pairs scored, node pairs bounded, pairs in all) for
    each block.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = items.schema["item_id"].dataType.simpleString()
    schema = f"item_id {kind}, rank int, doc_id long, score long"
    out = spark.createDataFrame([], schema)
    pairs = stored(item_terms(items, "item_id", "text"), "dualtree-items")
    gathered = pairs.groupBy("item_id").agg(F.collect_set("term").alias("terms")).orderBy("item_id")
    block: list[tuple[object, list[bytes]]] = []

    def flush() -> None:
        nonlocal out, block
        found, done = _search_block(docs, block, k, parts)
        if work is not None:
            work.append(done)
        names = spark.createDataFrame([(i, x[0]) for i, x in enumerate(block)], f"item int, item_id {kind}")
        out = out.union(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
        block = []

    for row in gathered.toLocalIterator():
        block.append((row.item_id, [bytes(t) for t in row.terms]))
        if len(block) == item_block:
            flush()
    if block:
        flush()
    return out


RANKED_SQL = rf"""
WITH lowered AS (
    SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents
    UNION ALL
    SELECT 'i', item_id, 0, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), words AS (
    SELECT kind, id, r, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM lowered
), item AS (SELECT DISTINCT id AS item_id, term FROM words WHERE kind = 'i'),
tf AS (SELECT r, id AS doc_id, term, count(*)::BIGINT AS tf FROM words WHERE kind = 'd' GROUP BY r, id, term),
len AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS l FROM len),
w AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM tf, total WHERE term IN (SELECT term FROM item) GROUP BY term, docs
), scored AS (
    SELECT i.item_id, tf.doc_id, tf.r,
        sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * len.n * total.docs) // total.l))))::BIGINT AS score
    FROM item i JOIN w USING (term) JOIN tf USING (term) JOIN len ON len.r = tf.r, total
    GROUP BY i.item_id, tf.doc_id, tf.r
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= {TOP}
"""
