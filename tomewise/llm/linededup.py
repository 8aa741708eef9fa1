"""Incremental, reversible line deduplication: sharded cuckoo filters in front of exact reference-count tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tomewise.llm.cuckoo import CuckooFilter
from tomewise.llm.tables import stored
from tomewise.llm.words import as_bytes

SPACE = b" \t\n\x0b\x0c\r"
MIN_POINTS = 10
SHARD_KEYS = 500_000
REFS = "key binary, doc_id long, times int"
COUNTS = "shard int, key binary, refs long, first_doc long, last_doc long"
FILTERS = "shard int, filter binary"
SCREENED = f"{COUNTS}, seen boolean, filter binary"


def line_key(line: bytes, min_points: int = MIN_POINTS) -> bytes | None:
    """16-byte digest of the stripped line with A-Z lower-cased; None where it has fewer than `min_points` code points."""
    text = line.strip(SPACE).lower()
    if len(text) < min_points or len(text) < 4 * min_points and len(text.decode("utf-8", "replace")) < min_points:
        return None
    return hashlib.md5(text, usedforsecurity=False).digest()


def line_refs(docs: DataFrame, min_points: int = MIN_POINTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc_id, times) for every line key of each row; rows without an id give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, times = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                if doc is None:
                    continue
                counts: dict[bytes, int] = {}
                for line in text.split(b"\n"):
                    key = line_key(line, min_points)
                    if key is not None:
                        counts[key] = counts.get(key, 0) + 1
                keys.extend(counts)
                ids.extend([doc] * len(counts))
                times.extend(counts.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(times, pa.int32())],
                ["key", "doc_id", "times"],
            )

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, REFS)


def _screen(new: pa.Table, old: pa.Table) -> pa.Table:
    """Mark the keys of one shard that its filter may know, and return the filter with all of them in it."""
    hashed = new.column("hash").to_numpy().view(np.uint64)
    before = CuckooFilter.from_bytes(old.column("filter")[0].as_py()) if old.num_rows else None
    seen = before.contains(hashed) if before is not None else np.zeros(len(hashed), dtype=bool)
    kept = new.drop_columns(["hash"]).append_column("seen", pa.array(seen))
    kept = kept.append_column("filter", pa.nulls(len(kept), pa.binary()))
    unseen = hashed[~seen]
    if before is None:
        blob = CuckooFilter.build(unseen).to_bytes()
    else:
        blob = before.to_bytes() if before.add(unseen) else None  # None: rebuilt from the exact table
    shard = (new if new.num_rows else old).column("shard")[0].as_py()
    extra = pa.table({
        "shard": pa.array([shard], pa.int32()), "key": pa.array([None], pa.binary()),
        "refs": pa.array([-1 if blob is None else 0], pa.int64()), "first_doc": pa.array([None], pa.int64()),
        "last_doc": pa.array([None], pa.int64()), "seen": pa.array([None], pa.bool_()),
        "filter": pa.array([blob], pa.binary()),
    })
    return pa.concat_tables([kept.select(extra.column_names), extra])


def _add(keys: pa.Table, old: pa.Table) -> pa.Table:
    """The filter of one shard with more keys in it; refs is -1 where they found no place."""
    if not old.num_rows or not keys.num_rows or old.column("filter")[0].as_py() is None:
        return old
    grown = CuckooFilter.from_bytes(old.column("filter")[0].as_py())
    fits = grown.add(keys.column("hash").to_numpy().view(np.uint64))
    return pa.table({
        "shard": old.column("shard"), "filter": pa.array([grown.to_bytes() if fits else None], pa.binary()),
        "refs": pa.array([0 if fits else -1], pa.int64()),
    })


def _build(keys: pa.Table) -> pa.Table:
    made = CuckooFilter.build(keys.column("hash").to_numpy().view(np.uint64))
    return pa.table({"shard": keys.column("shard").slice(0, 1), "filter": pa.array([made.to_bytes()], pa.binary())})


class LineIndex:
    """Which line keys the stored documents hold.

    `refs` (key, doc_id, times) is the exact table: which document holds a key, how often. `counts` (shard, key, refs,
    first_doc, last_doc) sums it up by key. `filters` holds a cuckoo filter for each shard of the keys. All are written
    to the shared folder; every change makes new tables, so an interrupted one leaves the old index whole.

    Keys are dealt to shards by hash and summed before any shuffle, so a line that a third of the documents hold is a
    single row of its shard. A shard's size follows the counted keys of the first batch, unless `shards` is given.
    """

    def __init__(
        self, spark: SparkSession, shards: int | None = None, min_points: int = MIN_POINTS, id_col: str = "doc_id",
        text_col: str = "text",
    ):
        self.spark, self.shards, self.min_points, self.id_col, self.text_col = spark, shards, min_points, id_col, text_col
        self.refs = self.counts = self.filters = None

    def _sums(self, refs: DataFrame) -> DataFrame:
        shard = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(self.shards)).cast("int")
        return refs.groupBy("key").agg(
            F.count("*").alias("refs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
        ).select(shard.alias("shard"), "key", "refs", "first_doc", "last_doc")

    def insert(self, docs: DataFrame) -> "LineIndex":
        """Add documents; an id that is already known is replaced. Rows that share an id are one document."""
        new = stored(line_refs(docs, self.min_points, self.id_col, self.text_col), "line-refs")
        if self.refs is not None:
            self.delete(docs.select(F.col(self.id_col).cast("long").alias("doc_id")))
        if self.shards is None:
            self.shards = max(8, -(-new.count() // SHARD_KEYS))
        sums = self._sums(new).withColumn("hash", F.xxhash64("key"))
        old = self.filters if self.filters is not None else self.spark.createDataFrame([], FILTERS)
        screened = stored(sums.groupBy("shard").cogroup(old.groupBy("shard")).applyInArrow(_screen, SCREENED), "line-screen")
        fresh = screened.where("key IS NOT NULL").select(*self._columns(COUNTS), "seen")
        filters = screened.where("key IS NULL").select("shard", "filter", "refs")
        if self.counts is None:
            self.counts = fresh.drop("seen")
        else:
            # Keys that no filter knows are new for certain; only the others meet the exact table.
            met = fresh.where("seen").select(*self._columns(COUNTS))
            known = self.counts.join(met.select("key"), "key", "left_semi").select(*self._columns(COUNTS))
            # Keys that the exact table does not have were known to a filter by chance: they get their own fingerprints.
            chance = met.join(self.counts.select("key"), "key", "left_anti").select("shard", F.xxhash64("key").alias("hash"))
            chance = stored(chance, "line-chance")
            if not chance.isEmpty():
                grown = chance.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(_add, "shard int, filter binary, refs long")
                filters = stored(grown, "line-grown")
            merged = known.union(met).groupBy("shard", "key").agg(
                F.sum("refs").alias("refs"), F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc")
            )
            untouched = self.counts.join(met.select("key"), "key", "left_anti").select(*self._columns(COUNTS))
            unseen = fresh.where("NOT seen").select(*self._columns(COUNTS))
            self.counts = stored(untouched.union(merged).union(unseen), "line-counts")
        self.refs = new if self.refs is None else stored(self.refs.union(new), "line-refs")
        if filters.where("refs < 0").limit(1).count():
            rebuilt = self.counts.join(filters.where("refs < 0").select("shard"), "shard", "left_semi")
            rebuilt = rebuilt.select("shard", F.xxhash64("key").alias("hash")).groupBy("shard").applyInArrow(_build, FILTERS)
            self.filters = stored(filters.where("refs = 0").select("shard", "filter").union(rebuilt), "line-filters")
        else:
            self.filters = filters.select("shard", "filter")
        return self

    def delete(self, ids: DataFrame) -> "LineIndex":
        """Take documents out by id: the rest then stands as if they had never been inserted."""
        gone = ids.select(F.col(ids.columns[0]).cast("long").alias("doc_id")).distinct()
        lost = stored(self.refs.join(gone, "doc_id", "left_semi"), "line-lost")
        kept = stored(self.refs.join(gone, "doc_id", "left_anti").select("key", "doc_id", "times"), "line-refs")
        keys = lost.select("key").distinct()
        again = self._sums(kept.join(keys, "key", "left_semi"))
        counts = self.counts.join(keys, "key", "left_anti").select(*self._columns(COUNTS)).union(again)
        counts = stored(counts, "line-counts")
        ended = keys.join(counts, "key", "left_anti").select(
            F.pmod(F.xxhash64("key", F.lit(1)), F.lit(self.shards)).cast("int").alias("shard"), F.xxhash64("key").alias("hash")
        )

        def discard(gone_keys: pa.Table, old: pa.Table) -> pa.Table:
            if not old.num_rows or not gone_keys.num_rows:
                return old
            left = CuckooFilter.from_bytes(old.column("filter")[0].as_py())
            left.discard(gone_keys.column("hash").to_numpy().view(np.uint64))
            return pa.table({"shard": old.column("shard"), "filter": pa.array([left.to_bytes()], pa.binary())})

        filters = ended.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(discard, FILTERS)
        self.filters = stored(filters, "line-filters")
        self.refs, self.counts = kept, counts
        return self

    @staticmethod
    def _columns(schema: str) -> list[str]:
        return [part.split()[0] for part in schema.split(", ")]

    def deduplicate(self, docs: DataFrame) -> DataFrame:
        """The given documents, which the index holds, with repeated lines removed: a line whose key at least two
        stored documents hold stays only in the smallest id that holds it.

        Returns the input's columns with `text` rewritten, and n_lines (before dropping) and n_dropped as longs, which
        replace columns of those names. A null or empty text is one empty line, and a null text stays null. Rows with
        a null id keep all their lines. Texts without lines left become empty.
        """
        shared = self.counts.where("first_doc <> last_doc").select("key", "first_doc")
        lose = self.refs.join(shared, "key").where("doc_id <> first_doc")
        lose = lose.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("key").alias("keys"))
        names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
        text_at, min_points = names.index(self.text_col), self.min_points
        rows = docs.select(F.struct(*names).alias("row"), F.col(self.id_col).cast("long").alias("_id"))
        both = rows.join(lose.hint("shuffle_hash"), "_id", "left").select("row.*", F.col("keys").alias("_keys"))
        schema = T.StructType([docs.schema[c] for c in names] + [
            T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

        def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                *columns, drop = batch.columns
                lines, dropped, texts = [], [], []
                valid = columns[text_at].is_valid().to_pylist()
                for text, keys, known in zip(as_bytes(columns[text_at]), drop.to_pylist(), valid):
                    parts = text.split(b"\n")
                    left = parts
                    if keys:
                        gone = set(keys)
                        left = [p for p in parts if line_key(p, min_points) not in gone]
                    lines.append(len(parts))
                    dropped.append(len(parts) - len(left))
                    texts.append((b"\n".join(left) if keys else text) if known else None)
                kind = columns[text_at].type
                columns[text_at] = pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(kind)
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], schema.names
                )

        return both.mapInArrow(rewrite, schema)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Insert all documents into a new index and deduplicate them against it."""
    index = LineIndex(docs.sparkSession, id_col=id_col, text_col=text_col).insert(docs)
    return index.deduplicate(docs)


LINES_SQL = r"""
    WITH lines AS (
      SELECT doc_id, pos, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
        LATERAL (SELECT unnest(parts) AS line, generate_subscripts(parts, 1) AS pos)
    ), shared AS (
      SELECT key, min(doc_id) AS first_doc FROM lines WHERE length(key) >= 10
      GROUP BY key HAVING count(DISTINCT doc_id) >= 2
    ), marked AS (
      SELECT l.*, coalesce(s.first_doc <> l.doc_id, false) AS gone FROM lines l LEFT JOIN shared s ON l.key = s.key
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
"""
