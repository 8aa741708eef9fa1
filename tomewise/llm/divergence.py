"""Divergence of the sources of each language, by Gustavson's row-wise sparse product.

1. Terms are counted in each task by (term, source) and sent, packed, to buckets of terms. A bucket adds them up, drops
   the terms of too few documents, and keeps the rest as a term-major index: a term, then the groups that hold it.
2. Each group of a bucket is a row: it scatters its terms through the index into one dense accumulator over its peers.
   A shared term adds what it changes against both baselines; the terms that a side lacks count there with the share of
   zero occurrences, which is added for all of them at once. No pair of postings becomes a row.
3. The rows of all buckets are summed by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tomewise.llm.tables import stored
from tomewise.llm.terms import LETTERS, counts_by_text, lists, sums_by_key, term_column, term_hashes
from tomewise.llm.words import as_bytes, slices

MIN_DOCS = 10
TOP_TERMS = 10
#: Documents whose terms fall to one bucket on average, and bytes of text counted together in a task.
BUCKET_DOCS = 1 << 11
SLICE_BYTES = 24 << 20

INTS, LONGS, TERMS = pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary())
COUNTS = "bucket int, terms array<binary>, posts array<int>, groups array<int>, counts array<long>, docs array<long>"
INDEX = "lang_no int, terms array<binary>, posts array<int>, groups array<int>, counts array<long>"
INDEX_ARROW = pa.schema([("lang_no", pa.int32()), ("terms", TERMS), ("posts", INTS), ("groups", INTS), ("counts", LONGS)])
ROWS = "a int, b int, value long, term binary"
RESULT = "lang string, source string, part string, item string, value long, rank int"


def share(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / total), digit by digit, so that totals up to 9 * 10^15 do not overflow."""
    out, rest = np.zeros(np.broadcast(counts, total).shape, dtype=np.int64), np.asarray(counts, dtype=np.int64) + 2
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) of shares up to 10^9 + 1."""
    return (p - q) * (p - q) // (p + q)


def partial_counts(docs: DataFrame, groups: int, buckets: int) -> DataFrame:
    """Occurrences and documents of every (term, group), summed over each stretch of a task, from (group, text)."""

    def count(texts: list[bytes], group: np.ndarray) -> Iterator[pa.RecordBatch]:
        tokens, first = term_column(texts, LETTERS)
        if not len(tokens):
            return
        coded = tokens.dictionary_encode()
        code, text, times = counts_by_text(coded.indices.to_numpy(), first)
        keys, (times, in_docs) = sums_by_key(code * groups + group[text], times, np.ones(len(times), dtype=np.int64))
        code = keys // groups
        bucket = (term_hashes(coded.dictionary) % np.uint64(buckets)).astype(np.int64)
        # Codes in the order of their buckets, then the postings in the order of their codes.
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        by = np.argsort(place[code], kind="stable")
        posts = np.bincount(place[code], minlength=len(order))
        begin = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) > 0)))
        at = np.concatenate(([0], np.cumsum(posts)))[begin]
        yield pa.RecordBatch.from_arrays([
            pa.array(bucket[order][begin], pa.int32()), lists(begin, coded.dictionary.take(pa.array(order)), pa.binary()),
            lists(begin, posts, pa.int32()), lists(at, (keys % groups)[by], pa.int32()),
            lists(at, times[by], pa.int64()), lists(at, in_docs[by], pa.int64()),
        ], ["bucket", "terms", "posts", "groups", "counts", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, numbers, size = [], [], 0
        for batch in batches:
            texts, group = as_bytes(batch.column(1)), batch.column(0).to_numpy()
            for part in slices(texts, SLICE_BYTES):
                held += texts[part]
                numbers.append(group[part])
                size += sum(map(len, texts[part]))
                if size >= SLICE_BYTES:
                    yield from count(held, np.concatenate(numbers).astype(np.int64))
                    held, numbers, size = [], [], 0
        if held:
            yield from count(held, np.concatenate(numbers).astype(np.int64))

    return docs.mapInArrow(run, COUNTS)


def term_index(counted: DataFrame, lang_of: np.ndarray, min_docs: int = MIN_DOCS) -> DataFrame:
    """The term-major index: for each bucket and language the terms of at least `min_docs` of its documents."""
    groups, langs = len(lang_of), int(lang_of.max()) + 1

    def merge(parts: pa.Table) -> pa.Table:
        terms, posts, group, counts, docs = (
            pc.list_flatten(parts.column(c).combine_chunks()) for c in ("terms", "posts", "groups", "counts", "docs"))
        coded = terms.dictionary_encode()
        code = np.repeat(coded.indices.to_numpy().astype(np.int64), posts.to_numpy())
        keys, (counts, docs) = sums_by_key(code * groups + group.to_numpy(), counts.to_numpy(), docs.to_numpy())
        code, group = keys // groups, keys % groups
        held = np.bincount(code * langs + lang_of[group], weights=docs, minlength=len(coded.dictionary) * langs)
        kept = held[code * langs + lang_of[group]] >= min_docs
        code, group, counts = code[kept], group[kept], counts[kept]
        order = np.lexsort((group, code, lang_of[group]))
        code, group, counts = code[order], group[order], counts[order]
        lang = lang_of[group]
        term = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (lang[1:] != lang[:-1])))) if len(code) else np.zeros(0, np.int64)
        begin = np.flatnonzero(np.concatenate(([True], np.diff(lang[term]) > 0))) if len(term) else np.zeros(0, np.int64)
        return pa.table({
            "lang_no": pa.array(lang[term][begin], pa.int32()),
            "terms": lists(begin, coded.dictionary.take(pa.array(code[term])), pa.binary()),
            "posts": lists(begin, np.diff(np.concatenate((term, [len(code)]))), pa.int32()),
            "groups": lists(term[begin], group, pa.int32()), "counts": lists(term[begin], counts, pa.int64()),
        }, schema=INDEX_ARROW)

    return counted.groupBy("bucket").applyInArrow(merge, INDEX)


def accumulate(index: DataFrame, totals: np.ndarray, lang_totals: np.ndarray, lang_of: np.ndarray, top: int = TOP_TERMS) -> DataFrame:
    """Rows of the product and the terms that stand out, bucket by bucket.

    With a term: group a holds it more often than its language, by `value`; the first `top` of the bucket. Without:
    what the bucket adds to (a, b). Totals are N + 2 * V of each group and of each language.
    """
    zero = share(np.zeros(len(totals), dtype=np.int64), totals)

    def shared(group: np.ndarray, counts: np.ndarray, posts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        peers = np.flatnonzero(lang_of == lang_of[group[0]])
        local = np.searchsorted(peers, group)
        p, q0 = share(counts, totals[group]), zero[peers]
        end = np.cumsum(posts)
        term = np.repeat(np.arange(len(posts)), posts)
        by_group = np.argsort(local, kind="stable")
        for own in np.split(by_group, np.flatnonzero(np.diff(local[by_group])) + 1):
            a = local[own[0]]
            none = gap(q0[a], q0)
            # The zero baseline: all of the row's terms against what every peer has of a term it lacks.
            levels, many = np.unique(p[own], return_counts=True)
            base = many @ (gap(levels[:, None], q0[None, :]) - none[None, :])
            length = posts[term[own]]
            at = np.repeat(end[term[own]] - np.cumsum(length), length) + np.arange(int(length.sum()))
            pa_, pb, b = np.repeat(p[own], length), p[at], local[at]
            row = base.copy()
            np.add.at(row, b, gap(pa_, pb) - gap(pa_, q0[b]) - gap(q0[a], pb) + none[b])
            yield np.full(len(peers), peers[a]), peers, row
            yield peers, np.full(len(peers), peers[a]), base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                terms, posts, group, counts = (batch.column(c)[i].values for c in ("terms", "posts", "groups", "counts"))
                posts, group, counts = posts.to_numpy(), group.to_numpy(), counts.to_numpy()
                if not len(group):
                    continue
                a, b, value = (np.concatenate(x) for x in zip(*shared(group, counts, posts)))
                some = (a != b) & (value != 0)
                yield pa.RecordBatch.from_arrays([
                    pa.array(a[some], pa.int32()), pa.array(b[some], pa.int32()), pa.array(value[some], pa.int64()),
                    pa.nulls(int(some.sum()), pa.binary()),
                ], ["a", "b", "value", "term"])
                term = np.repeat(np.arange(len(posts)), posts)
                whole = np.add.reduceat(counts, np.cumsum(posts) - posts)
                p, q = share(counts, totals[group]), share(whole, lang_totals[lang_of[group[0]]])[term]
                above = np.flatnonzero(p > q)
                rank = np.empty(len(terms), dtype=np.int64)
                rank[pc.sort_indices(terms).to_numpy()] = np.arange(len(terms))
                value = gap(p, q)[above]
                order = np.lexsort((rank[term[above]], -value, group[above]))
                held = group[above][order]
                first = order[np.arange(len(held)) - np.searchsorted(held, held) < top]
                yield pa.RecordBatch.from_arrays([
                    pa.array(group[above][first], pa.int32()), pa.nulls(len(first), pa.int32()), pa.array(value[first], pa.int64()),
                    terms.take(pa.array(term[above][first])),
                ], ["a", "b", "value", "term"])

    return index.mapInArrow(run, ROWS)


def divergence(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS,
    top: int = TOP_TERMS, bucket_docs: int = BUCKET_DOCS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the term shares of sources lie from each other and their language.

    Part `pair`: every other source of the language, by distance; part `term`: the `top` terms that the group holds most
    above its language. Null texts, languages and sources count as ''. A group without terms is a row like any other; in
    a language without kept terms all distances are 0. Ties go by item. Every row of `docs` counts, repeated ones too.
    An empty table gives no rows; other columns are not read.

    The list of groups comes to the driver and goes to all tasks: the result itself has as many rows for each language
    as that list has pairs. A very frequent term is one entry for each task, a source with very many rows one number.
    """
    spark = docs.sparkSession
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    known = sorted(docs.groupBy("lang", "source").count().collect(), key=lambda r: (r.lang, r.source))
    if not known:
        return spark.createDataFrame([], RESULT)
    langs = sorted({r.lang for r in known})
    lang_of = np.array([langs.index(r.lang) for r in known])
    buckets = max(8, -(-sum(r["count"] for r in known) // bucket_docs))
    names = spark.createDataFrame([(i, r.lang, r.source, int(lang_of[i])) for i, r in enumerate(known)], "g int, lang string, source string, lang_no int")
    numbered = docs.join(F.broadcast(names), ["lang", "source"]).select("g", "text")
    index = stored(term_index(partial_counts(numbered, len(known), buckets), lang_of, min_docs), "divergence-index")

    kept = np.zeros(len(langs), dtype=np.int64)
    for r in index.groupBy("lang_no").agg(F.sum(F.size("terms")).alias("v")).collect():
        kept[r.lang_no] = r.v
    own = np.zeros(len(known), dtype=np.int64)
    each = index.select(F.explode(F.arrays_zip("groups", "counts")).alias("x")).groupBy("x.groups").agg(F.sum("x.counts").alias("n"))
    for g, n in each.collect():
        own[g] = n
    lang_totals = np.bincount(lang_of, minlength=len(langs)) * 0 + 2 * kept
    np.add.at(lang_totals, lang_of, own)
    totals = np.maximum(own + 2 * kept[lang_of], 1)
    rows = stored(accumulate(index, totals, np.maximum(lang_totals, 1), lang_of, top), "divergence-rows")

    zero = share(np.zeros(len(known), dtype=np.int64), totals)
    bases = spark.createDataFrame([(i, int(zero[i]), int(kept[lang_of[i]])) for i in range(len(known))], "g int, zero long, v long")
    names = F.broadcast(names.join(bases, "g"))
    a, b = names.alias("a"), names.alias("b")
    pairs = a.join(b, (F.col("a.lang_no") == F.col("b.lang_no")) & (F.col("a.g") != F.col("b.g"))).select(
        F.col("a.g").alias("a"), F.col("b.g").alias("b"), F.col("a.lang").alias("lang"), F.col("a.source").alias("source"),
        F.col("b.source").alias("item"),
        F.expr("a.v * ((a.zero - b.zero) * (a.zero - b.zero) div (a.zero + b.zero))").alias("none"))
    sums = rows.where("term IS NULL").groupBy("a", "b").agg(F.sum("value").alias("shared"))
    pairs = pairs.join(sums, ["a", "b"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", (F.col("none") + F.coalesce("shared", F.lit(0))).alias("value"))
    order = [F.desc("value"), F.asc("item")]
    terms = rows.where("term IS NOT NULL").join(names, F.col("a") == F.col("g")).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value")
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)).cast("int")
    pairs = pairs.withColumn("rank", ranked)
    return pairs.union(terms.withColumn("rank", ranked).where(F.col("rank") <= top))


DIVERGENCE_SQL = rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
    FROM documents
), groups AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT r, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
vocabulary AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counted AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
dense AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
    FROM groups g JOIN kept k ON g.lang = k.lang
    LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), own AS (
    SELECT lang, source, term, n,
        (1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v)::HUGEINT)::HUGEINT AS p
    FROM dense JOIN vocabulary USING (lang)
), whole AS (
    SELECT lang, term, (1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v)::HUGEINT)::HUGEINT AS q
    FROM (SELECT lang, term, sum(n) AS n FROM dense GROUP BY lang, term) JOIN vocabulary USING (lang)
), far AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY a.lang, a.source, b.source
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), terms AS (
    SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
    FROM own JOIN whole USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= {TOP_TERMS}
"""
