"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

The product of the matrix with its transpose holds every overlap. It is taken in blocks, and bounds that follow from
the set sizes discard most of it unseen, without losing a pair:

1. Columns. N-grams are dealt to column blocks by hash, which count in how many documents each occurs. Overlaps come
   only from n-grams of two or more documents, so a document with fewer of these than percent of its size has no link.
2. Rows. A linked pair shares one of the `size - required + 1` rarest n-grams of either. Documents joined through
   shared rare n-grams form groups; every linked pair lies inside one.
3. Product. Each group, cut into blocks of documents of similar size, is multiplied block by block; block pairs and
   pairs whose sizes rule the similarity out are discarded, and overlaps decide the rest. A block yields a spanning
   star of its linked documents, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tomewise.llm.tables import components, stored
from tomewise.llm.words import Words, as_bytes, shingles, slices

WIDTH = 5
PERCENT = 75
#: Counters of the sketch that finds very frequent n-grams, and the share of all n-grams from which a counter is hot.
CELLS = 1 << 20
HOT_SHARE = 1 << 16
#: N-grams in a column block; documents in a row block.
COLUMN_BLOCK = 2_000_000
ROW_BLOCK = 1024
FLUSH = 1_000_000
MATRIX_CELLS = 1 << 23

LONGS = pa.list_(pa.int64())
PARTS = "bucket int, kind int, docs array<long>, runs array<int>, hashes array<long>, counts array<int>"
PARTS_ARROW = pa.schema([
    ("bucket", pa.int32()), ("kind", pa.int32()), ("docs", LONGS), ("runs", pa.list_(pa.int32())), ("hashes", LONGS),
    ("counts", pa.list_(pa.int32())),
])
SETS = "doc_id long, n long, digest binary, prefix int, grams array<long>"
SETS_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("prefix", pa.int32()), ("grams", LONGS),
])
COLD, HOT, SIZE = 0, 1, 2


def text_sets(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, ascending, one text after the other, and the size of each set."""
    words = Words(texts)
    grams, text = shingles(words.hashes(), words.first, width)
    order = np.argsort(grams)
    order = order[np.argsort(text[order], kind="stable")]
    grams, text = grams[order], text[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    return grams[new], np.bincount(text[new], minlength=len(texts))


def _documents(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, set sizes, hashes) of a run of documents."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        texts = as_bytes(batch.column(1))
        for part in slices(texts):
            grams, sizes = text_sets(texts[part], width)
            yield ids[part], sizes, grams


def gram_sketch(rows: DataFrame, width: int = WIDTH, cells: int = CELLS) -> np.ndarray:
    """How many documents' n-grams fall on each of `cells` counters: fixed-size arrays, summed by ranges of counters."""
    ranges = 64
    span = cells // ranges

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, dtype=np.int64)
        for _, _, grams in _documents(batches, width):
            counts += np.bincount((grams & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
        for r in range(ranges):
            part = counts[r * span : (r + 1) * span]
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r], pa.int32()), pa.array([at], pa.list_(pa.int32())), pa.array([part[at]], LONGS)],
                    ["range", "at", "counts"],
                )

    def add(parts: pa.Table) -> pa.Table:
        at = parts.column("at").combine_chunks().flatten().to_numpy()
        counts = parts.column("counts").combine_chunks().flatten().to_numpy()
        total = np.bincount(at, weights=counts, minlength=span).astype(np.int64)
        return pa.table({"range": parts.column("range").slice(0, 1), "counts": pa.array([total], LONGS)})

    sums = rows.mapInArrow(count, "range int, at array<int>, counts array<long>")
    sums = sums.groupBy("range").applyInArrow(add, "range int, counts array<long>").toArrow()
    out = np.zeros(cells, dtype=np.int64)
    for r, counts in zip(sums.column("range").to_pylist(), sums.column("counts")):
        out[r * span : (r + 1) * span] = counts.values.to_numpy()
    return out


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of every run of equal neighbours."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return begin, np.diff(np.concatenate((begin, [len(keys)])))


def _lists(groups: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """`values`, cut into one list for each run of `groups` (given as begins)."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate((groups, [len(values)])), pa.int32()), pa.array(values, kind))


def _packed(bucket: np.ndarray, kind: int, docs: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Rows for entries sorted by (bucket, document): documents with run lengths, hashes and counts in lists."""
    begin, _ = _runs(bucket)
    same = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (docs[1:] != docs[:-1]))) if len(docs) else np.zeros(0, bool)
    at = np.flatnonzero(same)
    run = np.diff(np.concatenate((at, [len(docs)])))
    return pa.RecordBatch.from_arrays([
        pa.array(bucket[begin], pa.int32()), pa.array(np.full(len(begin), kind), pa.int32()),
        _lists(np.searchsorted(at, begin), docs[at], pa.int64()), _lists(np.searchsorted(at, begin), run, pa.int32()),
        _lists(begin, hashes, pa.int64()),
        _lists(begin, counts, pa.int32()) if len(counts) else pa.array([[]] * len(begin), pa.list_(pa.int32())),
    ], schema=PARTS_ARROW)


def _deal(rows: DataFrame, width: int, sketch: np.ndarray, buckets: int) -> DataFrame:
    """Every document's n-grams dealt to column blocks, together with its size.

    N-grams on a hot counter are known to be shared: they need no counting and travel in a block picked by document,
    so that no block gets the documents of a very frequent n-gram.
    """
    limit = max(32, int(sketch.sum()) // HOT_SHARE)
    hot_cells = np.where(sketch > limit, np.minimum(sketch, (1 << 31) - 1), 0).astype(np.int32)
    hot = rows.sparkSession.sparkContext.broadcast(hot_cells)

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        ids, sizes, grams = (np.concatenate(part) for part in zip(*held))
        docs = np.repeat(ids, sizes)
        heat = hot.value[(grams & np.uint64(CELLS - 1)).astype(np.int64)]
        cold = heat == 0
        bucket = ((grams[cold] >> np.uint64(24)) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((docs[cold], bucket))
        none = np.zeros(0, dtype=np.int32)
        yield _packed(bucket[order], COLD, docs[cold][order], grams[cold][order].view(np.int64), none)
        for kind, d, h, c in ((HOT, docs[~cold], grams[~cold].view(np.int64), heat[~cold]), (SIZE, ids, sizes, none)):
            bucket = ((d >> 6) % buckets).astype(np.int32)
            order = np.lexsort((d, bucket))
            yield _packed(bucket[order], kind, d[order], h[order], c[order] if len(c) else none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for part in _documents(batches, width):
            held.append(part)
            total += len(part[2])
            if total >= FLUSH:
                yield from flush(held)
                held, total = [], 0
        if held:
            yield from flush(held)

    return rows.mapInArrow(run, PARTS)


def _entries(parts: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, count) of all entries of a kind."""
    some = parts.filter(pc.equal(parts.column("kind"), kind)).combine_chunks()
    docs, runs, hashes, counts = (
        pa.chunked_array([c for c in some.column(n).chunks] or [pa.array([], PARTS_ARROW.field(n).type)]).combine_chunks()
        .flatten().to_numpy() for n in ("docs", "runs", "hashes", "counts")
    )
    return np.repeat(docs, runs), hashes, counts


def _count_columns(groups: int):
    def run(parts: pa.Table) -> pa.Table:
        """Keep a column block's n-grams of two or more documents, with their counts, and deal them by document."""
        docs, hashes, _ = _entries(parts, COLD)
        order = np.argsort(hashes)
        begin, length = _runs(hashes[order])
        counts = np.repeat(length, length)
        shared = counts >= 2
        out = []
        for kind, d, h, c in (
            (COLD, docs[order][shared], hashes[order][shared], counts[shared]), (HOT, *_entries(parts, HOT)),
            (SIZE, *_entries(parts, SIZE)),
        ):
            group = ((d >> 6) % groups).astype(np.int32)
            order_ = np.lexsort((d, group))
            out.append(_packed(group[order_], kind, d[order_], h[order_], c[order_] if len(c) else c))
        return pa.Table.from_batches(out, PARTS_ARROW)

    return run


def _required(n: np.ndarray, percent: int) -> np.ndarray:
    """The smallest overlap that a link of a set of size n needs."""
    return (percent * n + 99) // 100


def _candidates(percent: int):
    def run(parts: pa.Table) -> pa.Table:
        """For each document its size and, where it can have links, its shared n-grams from rare to frequent."""
        import hashlib

        docs, hashes, counts = (np.concatenate(p) for p in zip(_entries(parts, COLD), _entries(parts, HOT)))
        size_docs, sizes, _ = _entries(parts, SIZE)
        size_docs, first = np.unique(size_docs, return_index=True)
        sizes = sizes[first]
        order = np.lexsort((hashes, counts, docs))
        docs, hashes = docs[order], hashes[order]
        new = np.ones(len(docs), dtype=bool)
        new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])  # a document given twice counts once
        docs, hashes = docs[new], hashes[new]
        at, end = np.searchsorted(docs, size_docs), np.searchsorted(docs, size_docs, side="right")
        shared, need = end - at, _required(sizes, percent)
        keep = (shared >= need) & (sizes > 0)
        digests, grams = [None] * len(sizes), [None] * len(sizes)
        for i in np.flatnonzero(keep):
            grams[i] = hashes[at[i] : end[i]]
            if shared[i] == sizes[i]:
                digests[i] = hashlib.md5(np.sort(grams[i]).tobytes(), usedforsecurity=False).digest()
        return pa.Table.from_arrays([
            pa.array(size_docs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
            pa.array(np.where(keep, shared - need + 1, 0), pa.int32()), pa.array(grams, LONGS),
        ], schema=SETS_ARROW)

    return run


def _overlaps(grams: list[np.ndarray], split: int | None = None) -> np.ndarray:
    """Overlaps of every set with every other, or of those before `split` with those from it on.

    The product runs over blocks of columns; columns of a single set are left out.
    """
    size = [len(g) for g in grams]
    row = np.repeat(np.arange(len(grams)), size)
    _, column, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    some = count[column] >= 2
    rank = np.cumsum(count >= 2) - 1
    row, column = row[some], rank[column[some]]
    m, n = len(grams), int(column.max()) + 1 if len(column) else 0
    out = np.zeros((m, m) if split is None else (split, m - split), dtype=np.float32)
    step = max(256, MATRIX_CELLS // m)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for begin in range(0, n, step):
        a, b = np.searchsorted(column, [begin, begin + step])
        block = np.zeros((m, min(step, n - begin)), dtype=np.float32)
        block[row[a:b], column[a:b] - begin] = 1
        out += block @ block.T if split is None else block[:split] @ block[split:].T
    return out


def _spanning(docs: np.ndarray, n: np.ndarray, grams: list[np.ndarray], percent: int, split: int | None = None) -> list:
    """Edges from each linked document to the smallest one that links reach inside the block."""
    over = _overlaps(grams, split)
    rows, cols = (slice(None), slice(None)) if split is None else (slice(None, split), slice(split, None))
    linked = 100 * over >= percent * (n[rows][:, None] + n[cols][None, :] - over)
    if split is None:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return []
    label = np.argsort(np.argsort(docs))
    top = len(docs)
    while True:
        before = label.copy()
        left, right = label[rows], label[cols]
        low = np.where(linked, right[None, :], top).min(1)
        label[rows] = np.minimum(left, low)
        low = np.where(linked, label[rows][:, None], top).min(0)
        label[cols] = np.minimum(label[cols], low)
        if (label == before).all():
            break
    root = np.sort(docs)[label]
    return [(d, r) for d, r in zip(docs.tolist(), root.tolist()) if d != r]


def _multiply(percent: int):
    def run(block: pa.Table) -> pa.Table:
        """Multiply each group of one task with itself and return the spanning edges."""
        block = block.sort_by([("part", "ascending"), ("doc_id", "ascending")])
        part = block.column("part").to_numpy()
        docs, n = block.column("doc_id").to_numpy(), block.column("n").to_numpy()
        lists = block.column("grams").combine_chunks()
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        edges = []
        begin, length = _runs(part)
        for b, k in zip(begin.tolist(), length.tolist()):
            if k < 2:
                continue
            sets = [flat[at[i] : at[i + 1]] for i in range(b, b + k)]
            edges += _spanning(docs[b : b + k], n[b : b + k], sets, percent)
        a, c = zip(*edges) if edges else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(c, pa.int64())})

    return run


def _linked(members: DataFrame, percent: int) -> DataFrame:
    """Spanning edges of the links inside groups; members: (sg, doc_id, n, grams)."""
    sizes = stored(members.groupBy("sg").agg(F.count("*").alias("total"), F.min("doc_id").alias("lead")), "gram-groups")
    sized = members.join(sizes, "sg")
    # Groups up to one row block: many of them to a task.
    bins = max(1, (sizes.where(f"total <= {ROW_BLOCK}").agg(F.sum("total")).first()[0] or 0) // ROW_BLOCK)
    small = sized.where(f"total <= {ROW_BLOCK}").select(
        F.pmod(F.xxhash64("sg"), F.lit(bins)).alias("bin"), F.col("sg").alias("part"), "doc_id", "n", "grams"
    )
    edges = small.groupBy("bin").applyInArrow(_multiply(percent), "a long, b long")
    if not sizes.where(f"total > {ROW_BLOCK}").limit(1).count():
        return edges
    # Larger groups: the documents linked to the group's first one are one class and need no product among
    # themselves. By the triangle inequality of the Jaccard distance, a document farther than twice the limit from
    # the first one has no link to that class.
    large = sized.where(f"total > {ROW_BLOCK}")
    lead = large.where("doc_id = lead").select("sg", F.col("grams").alias("lead_grams"), F.col("n").alias("lead_n"))
    over = F.size(F.array_intersect("grams", "lead_grams"))
    union = F.col("n") + F.col("lead_n") - F.col("over")
    large = large.join(lead, "sg").withColumn("over", over)
    large = large.withColumn("own", (100 * F.col("over") >= percent * union).cast("int"))
    twice = max(0, 2 * percent - 100)
    large = large.withColumn("near", (100 * F.col("over") >= twice * union).cast("int"))
    step = float(np.log(100 / percent) * 1.001)
    large = large.select(
        "sg", "lead", "doc_id", "n", "grams", "own", "near", F.floor(F.log("n") / step).cast("int").alias("level")
    )
    large = stored(large, "gram-large")
    stars = large.where("own = 1 AND doc_id <> lead").select(F.col("doc_id").alias("a"), F.col("lead").alias("b"))
    cells = large.groupBy("sg", "own", "level").agg(F.ceil(F.count("*") / ROW_BLOCK).cast("int").alias("subs"))
    blocks = cells.groupBy("sg").agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat_ws(":", "own", "level").alias("key"), F.col("subs").alias("value")))).alias("blocks"))
    rest = large.join(blocks, "sg")

    def subs(own: int, shift: int):
        found = F.element_at("blocks", F.concat_ws(":", F.lit(own), F.col("level") + shift))
        return F.sequence(F.lit(0), F.coalesce(found, F.lit(0)) - 1)

    def known(own: int, shift: int, made):
        there = F.element_at("blocks", F.concat_ws(":", F.lit(own), F.col("level") + shift)).isNotNull()
        return F.when(there, made).otherwise(F.array().cast("array<struct<part:string,side:int>>"))

    own_subs = F.element_at("blocks", F.concat_ws(":", "own", "level"))
    rest = rest.withColumn("sub", F.pmod(F.xxhash64("doc_id"), own_subs).cast("int"))

    def place(kind: str, level_a, level_b, sub_a, sub_b, side):
        name = F.concat_ws(":", F.lit(kind), "sg", level_a, level_b, sub_a, sub_b)
        return F.struct(name.alias("part"), side.cast("int").alias("side"))

    level = F.col("level")
    among = [  # documents outside the first one's class, with each other
        known(0, 0, F.transform(subs(0, 0), lambda t: place(
            "v", level, level, F.least("sub", t), F.greatest("sub", t), (F.col("sub") > t)))),
        known(0, 1, F.transform(subs(0, 1), lambda t: place("v", level, level + 1, F.col("sub"), t, F.lit(0)))),
        known(0, -1, F.transform(subs(0, -1), lambda t: place("v", level - 1, level, t, F.col("sub"), F.lit(1)))),
    ]
    across = [  # and with that class
        known(1, d, F.transform(subs(1, d), lambda t, d=d: place("u", level, level + d, F.col("sub"), t, F.lit(0))))
        for d in (-1, 0, 1)
    ]
    back = [
        known(0, d, F.transform(subs(0, d), lambda t, d=d: place("u", level + d, level, t, F.col("sub"), F.lit(1))))
        for d in (-1, 0, 1)
    ]
    none = F.array().cast("array<struct<part:string,side:int>>")
    places = F.when(F.col("own") == 1, F.concat(*back)).otherwise(
        F.concat(*among, F.when(F.col("near") == 1, F.concat(*across)).otherwise(none)))
    pairs = rest.withColumn("at", F.explode(places)).select(
        F.col("at.part").alias("part"), F.col("at.side").alias("side"), "doc_id", "n", "grams")
    more = pairs.groupBy("part").applyInArrow(_multiply_pair(percent), "a long, b long")
    return edges.union(stars).union(more)


def _multiply_pair(percent: int):
    def run(block: pa.Table) -> pa.Table:
        """The product of one pair of row blocks, or of one block with itself."""
        block = block.sort_by([("side", "ascending"), ("doc_id", "ascending")])
        kind, *_, sub_a, sub_b = block.column("part")[0].as_py().split(":")
        levels = block.column("part")[0].as_py().split(":")[2:4]
        itself = kind == "v" and levels[0] == levels[1] and sub_a == sub_b
        docs, n = block.column("doc_id").to_numpy(), block.column("n").to_numpy()
        cut = int((block.column("side").to_numpy() == 0).sum())
        edges = []
        if len(docs) > 1 and (itself or 0 < cut < len(docs)):
            lists = block.column("grams").combine_chunks()
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            sets = [flat[at[i] : at[i + 1]] for i in range(len(docs))]
            edges = _spanning(docs, n, sets, percent, None if itself else cut)
        a, c = zip(*edges) if edges else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(c, pa.int64())})

    return run


def jaccard_groups(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id): each document's set size and the smallest id reachable by links.

    Two documents link when 100 x intersection >= percent x union of their sets of `width`-word n-grams. Null or
    empty texts, and texts of white space, have empty sets and link with nothing; shorter texts have their whole
    sequence as one n-gram. Rows that share an id must share their text and are one document; rows without an id are
    left out. Sets are held as 64-bit hashes.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))
    sketch = gram_sketch(rows, width)
    buckets = max(4, -(-int(sketch.sum()) // COLUMN_BLOCK))
    dealt = _deal(rows, width, sketch, buckets)
    counted = dealt.groupBy("bucket").applyInArrow(_count_columns(buckets), PARTS)
    sets = stored(counted.groupBy("bucket").applyInArrow(_candidates(percent), SETS), "gram-sets")
    able = sets.where("prefix > 0")
    # Equal sets are one row of the matrix.
    alike = able.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"))
    copies = able.join(alike, "digest").where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    rows_left = able.join(copies.select(F.col("a").alias("doc_id")), "doc_id", "left_anti")
    rare = rows_left.select("doc_id", F.explode(F.slice("grams", F.lit(1), F.col("prefix"))).alias("gram"))
    heads = rare.groupBy("gram").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("tail")).where("head < tail")
    ties = rare.join(heads.select("gram", "head"), "gram").where("doc_id <> head").select("doc_id", "head").distinct()
    groups = components(ties, "doc_id", "head")
    members = rows_left.join(groups, F.col("doc_id") == F.col("node")).select(
        F.col("component").alias("sg"), "doc_id", "n", "grams")
    edges = _linked(stored(members, "gram-members"), percent).union(copies)
    found = components(edges)
    return sets.join(found, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


JACCARD_SQL = r"""
    WITH RECURSIVE words AS (
      SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
    ), grams AS (
      SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN ws ELSE ws[i : i + 4] END AS gram
      FROM words, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i) WHERE len(ws) > 0
    ), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    common AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id
      GROUP BY 1, 2
    ), links AS (
      SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
      WHERE 100 * o >= 75 * (x.n + y.n - o)
    ), twoway AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(doc_id, other) AS (
      SELECT doc_id, doc_id FROM documents
      UNION
      SELECT r.doc_id, twoway.b FROM reach r JOIN twoway ON twoway.a = r.other
    )
    SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.component_id
    FROM documents d LEFT JOIN sizes s USING (doc_id)
    JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""
