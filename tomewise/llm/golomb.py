"""Exact dedup by exchange of Golomb-coded fingerprints.

1. Every sender (a run of rows of one task) fingerprints its normalised texts, sorts the fingerprints, and sends each
   owner of a range of them the distinct ones as Golomb-coded gaps. Fingerprints have 10 bits more than the number of
   rows needs, so an entry takes about 12 bits whatever the size of the corpus.
2. An owner decodes what it got and replies a bitmap to each sender: which of its entries another sender has as well.
3. A sender's own repeats and the set bits are its suspects, about the true copies and one other row in a thousand.
   Only their texts are shuffled, and grouped by their bytes. No other row can have a copy.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tomewise.llm.tables import stored
from tomewise.llm.words import as_bytes

#: Rows of a sender, entries of an owner, bits of a fingerprint beyond those that number the rows.
SENDER_ROWS = 1 << 16
OWNER_ENTRIES = 1 << 22
SPARE_BITS = 10
#: Rows whose suspect bits are sent to all tasks at once: one bit a row, so 64 MB and their keys.
ROUND_ROWS = 1 << 29
BLOCK_BITS = 12

LONGS, INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
SENT = pa.schema([
    ("sender", pa.int64()), ("owner", pa.int32()), ("n", pa.int32()), ("divisor", pa.int32()), ("quotients", pa.binary()),
    ("remainders", pa.binary()), ("files", LONGS), ("rows", LONGS), ("repeats", INTS),
])
SENT_SQL = (
    "sender long, owner int, n int, divisor int, quotients binary, remainders binary, files array<long>, rows array<long>, "
    "repeats array<int>"
)
SEALED = "doc_id long, text_sha256 string, suspect boolean, normal binary"
RESULT = "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string"


def golomb_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Code ascending distinct numbers from 0: (log2 of the divisor, quotients in unary, remainders).

    The divisor is the power of two next to the mean gap times ln 2. Quotients and remainders are kept apart, which
    takes the same room and lets both be read as arrays.
    """
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    divisor = max(0, round(math.log2(max(1.0, float(gaps.mean()) * math.log(2))))) if len(gaps) else 0
    quotient = gaps >> divisor
    ends = np.cumsum(quotient + 1)
    unary = np.ones(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    unary[ends - 1] = 0
    rest = gaps & ((1 << divisor) - 1)
    bits = (rest[:, None] >> np.arange(divisor - 1, -1, -1)) & 1
    return divisor, np.packbits(unary).tobytes(), np.packbits(bits.astype(np.uint8)).tobytes()


def golomb_decode(n: int, divisor: int, quotients: bytes, remainders: bytes) -> np.ndarray:
    """The numbers that `golomb_encode` coded."""
    zeros = np.flatnonzero(np.unpackbits(np.frombuffer(quotients, dtype=np.uint8)) == 0)[:n]
    quotient = np.diff(zeros, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(remainders, dtype=np.uint8))[: n * divisor].reshape(n, divisor).astype(np.int64)
    rest = bits @ (1 << np.arange(divisor - 1, -1, -1, dtype=np.int64))
    return np.cumsum((quotient << divisor) + rest + 1) - 1


def _sender(number: int, files: np.ndarray, rows: np.ndarray, prints: np.ndarray, bits: int, owner_bits: int) -> pa.Table:
    """The messages of one sender and, in a row without an owner, what it keeps to read the replies."""
    order = np.argsort(prints, kind="stable")
    prints = prints[order]
    begin = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1])))
    entries = prints[begin].astype(np.int64)
    owner = entries >> (bits - owner_bits)
    cut = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    coded = [golomb_encode(part & ((1 << (bits - owner_bits)) - 1)) for part in np.split(entries, cut[1:])]
    count = len(cut)
    return pa.table({
        "sender": [number] * (count + 1), "owner": owner[cut].tolist() + [None],
        "n": np.diff(np.concatenate((cut, [len(entries)]))).tolist() + [None],
        "divisor": [c[0] for c in coded] + [None], "quotients": [c[1] for c in coded] + [None],
        "remainders": [c[2] for c in coded] + [None], "files": [None] * count + [files[order]],
        "rows": [None] * count + [rows[order]],
        "repeats": [None] * count + [np.diff(np.concatenate((begin, [len(prints)]))).astype(np.int32)],
    }, schema=SENT)


def fingerprints(rows: DataFrame, bits: int, owner_bits: int) -> DataFrame:
    """Messages and kept rows of every sender, from (file, row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, chunk, held = TaskContext.get().partitionId(), 0, []

        def flush(parts: list) -> list[pa.RecordBatch]:
            made = _sender(task << 24 | chunk, *(np.concatenate(x) for x in zip(*parts)), bits, owner_bits)
            return made.combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            heads = b"".join(hashlib.sha256(t.lower()).digest()[:8] for t in as_bytes(batch.column(2)))
            prints = np.frombuffer(heads, dtype=">u8").astype(np.uint64) >> np.uint64(64 - bits)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), prints))
            if sum(len(h[0]) for h in held) >= SENDER_ROWS:
                yield from flush(held)
                chunk, held = chunk + 1, []
        if held:
            yield from flush(held)

    return rows.mapInArrow(run, SENT_SQL)


def _reply(messages: pa.Table) -> pa.Table:
    """An owner's bitmaps: for each message, which of its entries stand in another message too."""
    columns = [messages.column(c).to_pylist() for c in ("n", "divisor", "quotients", "remainders")]
    entries = np.concatenate([golomb_decode(*x) for x in zip(*columns)])
    order = np.argsort(entries, kind="stable")
    same = entries[order][1:] == entries[order][:-1]
    twice = np.zeros(len(entries), dtype=np.uint8)
    twice[order[1:][same]] = 1
    twice[order[:-1][same]] = 1
    parts = np.split(twice, np.cumsum(columns[0])[:-1])
    return pa.table({
        "sender": messages.column("sender"), "owner": messages.column("owner"), "n": messages.column("n"),
        "bitmap": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary()),
    })


def _suspects(kept: pa.Table, replies: pa.Table) -> pa.Table:
    """Suspect rows of one sender as blocks of 64 words of bits by (file, row number)."""
    replies = replies.sort_by("owner")
    if not kept.num_rows:
        return pa.table({"file": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "words": pa.array([], LONGS)})
    bits = [np.unpackbits(np.frombuffer(b, dtype=np.uint8))[:n] for b, n in zip(
        replies.column("bitmap").to_pylist(), replies.column("n").to_pylist())]
    repeats = kept.column("repeats")[0].values.to_numpy()
    suspect = np.repeat(np.concatenate(bits).astype(bool) | (repeats > 1), repeats)
    files, rows = (kept.column(c)[0].values.to_numpy()[suspect] for c in ("files", "rows"))
    order = np.lexsort((rows, files))
    files, rows = files[order], rows[order]
    block = rows >> BLOCK_BITS
    begin = np.flatnonzero(np.concatenate(([True], (files[1:] != files[:-1]) | (block[1:] != block[:-1])))) if len(rows) else []
    words = np.zeros((len(begin), 64), dtype=np.uint64)
    at = np.repeat(np.arange(len(begin)), np.diff(np.concatenate((begin, [len(rows)])).astype(int)))
    np.bitwise_or.at(words, (at, rows >> 6 & 63), np.uint64(1) << (rows & 63).astype(np.uint64))
    return pa.table({
        "file": pa.array(files[begin] if len(rows) else [], pa.int64()), "block": pa.array(block[begin] if len(rows) else [], pa.int64()),
        "words": pa.array(list(words.view(np.int64)), LONGS),
    })


def suspect_bits(rows: DataFrame, count: int) -> DataFrame:
    """(file, block, words): a set bit for every row whose fingerprint occurs more than once; rows are (file, row, text)."""
    bits = min(62, max(1, math.ceil(math.log2(max(2, count)))) + SPARE_BITS)
    owner_bits = min(bits - 1, max(5, math.ceil(math.log2(max(1.0, count / OWNER_ENTRIES)))))
    sent = stored(fingerprints(rows, bits, owner_bits), "golomb-sent")
    messages = sent.where("owner IS NOT NULL").select("sender", "owner", "n", "divisor", "quotients", "remainders")
    replies = messages.groupBy("owner").applyInArrow(_reply, "sender long, owner int, n int, bitmap binary")
    kept = sent.where("owner IS NULL").select("sender", "files", "rows", "repeats")
    found = kept.groupBy("sender").cogroup(replies.groupBy("sender")).applyInArrow(
        _suspects, "file long, block long, words array<long>")
    # A block whose rows fell to several senders is put together: there are as many parts as tasks read that stretch.
    either = F.aggregate("parts", F.array_repeat(F.lit(0).cast("long"), 64), lambda a, b: F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)))
    return found.groupBy("file", "block").agg(F.collect_list("words").alias("parts")).select("file", "block", either.alias("words"))


def _seal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of every normalised text, and the text itself where it is suspect."""
    for batch in batches:
        texts = [t.lower() for t in as_bytes(batch.column(1))]
        suspect = batch.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), batch.column(2),
            pa.array([t if s else None for t, s in zip(texts, suspect)], pa.binary()),
        ], ["doc_id", "text_sha256", "suspect", "normal"])


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scan: bool = False, round_rows: int = ROUND_ROWS,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row: texts are equal when A-Z in lower case they are.

    The largest id of equal texts stays. Null text counts as empty, and empty texts equal each other. Rows without an
    id count in group_size; keep_id is null only where no row of the group has an id, and then all of them are kept.
    Rows that repeat id and text are told alike: each says whether its id stays. An empty table gives no rows; other
    columns are not read, so their names do not matter.

    Rows are found again by file and row number. `scan` says that `docs` is a plain scan of Parquet files, whose own
    numbers serve; anything else is written to the shared folder first. Suspect bits are sent to the tasks in rounds of
    whole files, `round_rows` rows each on average.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(
        [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")] if scan else []))
    if not scan:
        docs = stored(docs, "golomb-texts").select(
            "doc_id", "text", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    count = docs.count()
    bits = stored(suspect_bits(docs.select("file", "row", "text"), count), "golomb-bits")
    rounds = max(1, -(-count // round_rows))
    sealed = None
    for r in range(rounds):
        turn = F.pmod("file", F.lit(rounds)) == r
        marked = docs.where(turn).withColumn("block", F.shiftright("row", BLOCK_BITS)).join(
            F.broadcast(bits.where(turn)), ["file", "block"], "left")
        word = F.get("words", (F.shiftright("row", 6) % 64).cast("int"))
        suspect = F.coalesce(F.getbit(word, (F.col("row") % 64).cast("int")) == 1, F.lit(False))
        part = stored(marked.select("doc_id", "text", suspect.alias("suspect")).mapInArrow(_seal, SEALED), "golomb-sealed")
        sealed = part if sealed is None else sealed.union(part)
    # Bytes decide: equal fingerprints of different texts part here. The digest then names the verified group.
    groups = sealed.where("suspect").groupBy("text_sha256", "normal").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    suspects = sealed.where("suspect").select("doc_id", "text_sha256")
    told = suspects.join(groups.select("text_sha256", "keep_id", "group_size"), "text_sha256")
    alone = sealed.where("NOT suspect").select("text_sha256", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return told.select("text_sha256", "doc_id", "keep_id", "group_size").union(alone).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


EXACT_SQL = """
WITH normal AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), grouped AS (
    SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM normal GROUP BY t
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM normal JOIN grouped USING (t)
"""
