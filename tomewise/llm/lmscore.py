"""Language-model scores of whole texts: corpus counts by Spark, a gated recurrent model over them.

The model learns from every document that may be learned from. The documents are dealt to rounds by a hash of their id;
in a round each task starts from the same weights and runs truncated backpropagation over all texts of its partition,
and the tasks' weights are averaged, which gives the next round its start.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tomewise.llm.gru import LN10, GatedModel
from tomewise.llm.tables import shared_folder, stored
from tomewise.llm.words import Words, as_bytes, slices

#: The end of a text, a token like the words.
END = 0x6F9A_5D21_43C8_7E0B
#: Words with outputs of their own in the model; words whose counts are sent to every task.
MODEL_WORDS = 8192
SENT_WORDS = 200_000
#: Classes of the other words, by a hash of their last two bytes.
RARE_CLASSES = 64
#: The learning rate of each round that the documents are dealt to; after each the tasks' weights are averaged.
RATES = (0.02, 0.01, 0.005, 0.002)
#: Tokens that a task learns from at a time.
RUN_TOKENS = 2_000_000
#: Weights of a row of the tasks' tables, in rows of the model; tables that one task averages.
WEIGHT_ROWS = 1024
FAN_IN = 32
MERGE = 2_000_000
#: Text that is scored at a time.
SCORE_BYTES = 8 << 20


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash as int64, class if rare, first) of the words of each text, taken in slices that bound the work arrays."""
    parts = [_word_hashes(texts[part]) for part in slices(texts)]
    if not parts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)
    counts = np.concatenate([np.diff(first) for _, _, first in parts])
    return (np.concatenate([w for w, _, _ in parts]), np.concatenate([r for _, r, _ in parts]),
            np.concatenate(([0], np.cumsum(counts))))


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = Words(texts)
    tail = words.data[words.end - 1].astype(np.int64) if len(words.end) else np.zeros(0, dtype=np.int64)
    before = np.where(words.end - words.start > 1, words.data[np.maximum(words.end - 2, 0)], 0) if len(tail) else tail
    rare = ((before.astype(np.int64) * 257 + tail) * 40503 >> 7) % RARE_CLASSES
    return words.hashes().view(np.int64), rare, words.first


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, rare, n): occurrences of every word hash, and of the end, in all rows; summed up per task first."""

    def merged(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        word, rare, n = (np.concatenate(x) for x in zip(*held))
        word, first, which = np.unique(word, return_index=True, return_inverse=True)
        return word, rare[first], np.bincount(which, weights=n, minlength=len(word)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, texts_seen = [], 0, 0
        for batch in batches:
            texts = as_bytes(batch.column(0))
            texts_seen += len(texts)
            for part in slices(texts):
                word, rare, _ = word_hashes(texts[part])
                held.append(merged([(word, rare, np.ones(len(word)))]))
                waiting += len(held[-1][0])
                if waiting > MERGE:
                    held = [merged(held)]
                    if len(held[0][0]) > MERGE // 2:
                        yield batch_of(*held.pop())
                    waiting = sum(len(h[0]) for h in held)
        if held:
            yield batch_of(*merged(held))
        if texts_seen:
            yield batch_of(np.array([END]), np.array([0]), np.array([texts_seen]))

    def batch_of(word: np.ndarray, rare: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(word, pa.int64()), pa.array(rare, pa.int32()), pa.array(n, pa.int64())], ["word", "rare", "n"])

    parts = docs.select(text_col).mapInArrow(run, "word long, rare int, n long")
    return parts.groupBy("word").agg(F.min("rare").alias("rare"), F.sum("n").alias("n"))


@dataclass
class Scorer:
    """What every task needs: counts of the sent words, the rare classes' totals and the recurrent model."""

    words: np.ndarray  # hashes of the sent words, ascending
    counts: np.ndarray
    inputs: np.ndarray  # model input of each sent word, -1 where it has none
    tokens: int
    types: int
    rare_tokens: np.ndarray
    rare_types: np.ndarray
    model: GatedModel | None

    def ended_inputs(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The model's inputs of each text, the end (0) after its words, and where each text's begin."""
        word, rare, first = word_hashes(texts)
        at = np.minimum(np.searchsorted(self.words, word), max(len(self.words) - 1, 0))
        ids = np.where(self.words[at] == word, self.inputs[at], -1)
        ids = np.where(ids < 0, self.model.n_words + rare, ids)
        return np.insert(ids, first[1:], 0), first + np.arange(len(first))

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """For each text: tokens, known ones, sum of log10(count + 1) of the sent words, model's log10 probability but
        for the counts of the words not sent; then those words (hashes and where each text's begin)."""
        word, rare, first = word_hashes(texts)
        n = np.diff(first)
        text = np.repeat(np.arange(len(texts)), n)
        at = np.minimum(np.searchsorted(self.words, word), max(len(self.words) - 1, 0))
        sent = self.words[at] == word if len(self.words) else np.zeros(len(word), dtype=bool)
        count = np.where(sent, self.counts[at], 0) if len(self.words) else np.zeros(len(word), dtype=np.int64)
        ends = self.counts[np.searchsorted(self.words, END)] if self.types else 0
        logs = np.log10(count + 1.0)
        base = np.bincount(text, weights=logs, minlength=len(texts)) + np.log10(ends + 1.0)
        known = np.bincount(text[sent], minlength=len(texts)) + (ends > 0)
        if self.model is None:
            model = base - (n + 1) * np.log10(self.tokens + self.types + 1.0)
        else:
            ids = np.where(sent, self.inputs[at], -1)
            out = ids < 0
            ids = np.where(out, self.model.n_words + rare, ids)
            model = self.model.log_probabilities(ids, first) / LN10
            inside = logs - np.log10(self.rare_tokens + self.rare_types + 1.0)[rare]
            model += np.bincount(text[out], weights=inside[out], minlength=len(texts))
        rest = np.concatenate(([0], np.cumsum(~sent)))[first]
        return n + 1, known, base, model, word[~sent], rest


def count_step() -> Column:
    """Counts in sixteen steps to each doubling."""
    return F.floor(F.log2("n") * 16)


def count_scorer(counts: DataFrame, model_words: int = MODEL_WORDS, sent_words: int = SENT_WORDS) -> tuple[Scorer, int]:
    """The scorer for the counted words with an untrained model, and the step of counts from which words are sent.

    The driver gets at most `sent_words` words: those from a step of counts that no more than so many reach.
    """
    steps = counts.where(F.col("word") != END).groupBy(count_step().alias("step")).count().orderBy(F.desc("step"))
    cut, reached = 1 << 20, 0
    for step, words in steps.collect():  # some hundred steps, however large the counts
        if reached + words > sent_words:
            break
        cut, reached = step, reached + words
    totals = counts.agg(F.sum("n"), F.count("*")).first()
    if not totals[1]:
        none = np.zeros(0, dtype=np.int64)
        return Scorer(none, none, none, 0, 0, np.zeros(RARE_CLASSES), np.zeros(RARE_CLASSES), None), cut
    top = counts.where((count_step() >= cut) | (F.col("word") == END)).toArrow()
    words, rare, n = (top.column(c).to_numpy() for c in ("word", "rare", "n"))
    order = np.argsort(words)
    words, rare, n = words[order], rare[order], n[order]
    end = int(np.searchsorted(words, END))
    best = np.lexsort((words, -n))
    best = np.concatenate(([end], best[best != end][: model_words - 1]))
    inputs = np.full(len(words), -1, dtype=np.int64)
    inputs[best] = np.arange(len(best))
    by_class = counts.where(F.col("word") != END).groupBy("rare").agg(F.sum("n"), F.count("*")).collect()
    rare_tokens, rare_types = np.zeros(RARE_CLASSES), np.zeros(RARE_CLASSES)
    for k, tokens, types in by_class:
        rare_tokens[k], rare_types[k] = tokens, types
    modelled = best[1:]
    rare_tokens -= np.bincount(rare[modelled], weights=n[modelled], minlength=RARE_CLASSES)
    rare_types -= np.bincount(rare[modelled], minlength=RARE_CLASSES)
    model = GatedModel(n[best].astype(float), rare_tokens)
    model.ready()
    return Scorer(words, n, inputs, int(totals[0]), int(totals[1]), rare_tokens, rare_types, model), cut


def dealt_inputs(docs: DataFrame, scorer: Scorer, rounds: int, id_col: str, text_col: str) -> DataFrame:
    """(ids, round): the model's inputs of every whole text, its end last, stored by the round it is dealt to."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for part in slices(texts, SCORE_BYTES):
                ids, first = sent.value.ended_inputs(texts[part])
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([lists, batch.column(1).slice(part.start, len(lists))], ["ids", "round"])

    schema = "ids array<int>, round int"
    dealt = docs.select(text_col, F.pmod(F.xxhash64(id_col, F.lit(9)), F.lit(rounds)).cast("int").alias("round"))
    path = f"{shared_folder(docs.sparkSession)}/gru-inputs-{uuid.uuid4().hex}"
    dealt.mapInArrow(run, schema).write.partitionBy("round").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def _runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[np.ndarray]:
    """The inputs of whole texts, one after the other, in runs of `limit` or what the last text makes it."""
    held, size = [], 0
    for batch in batches:
        for one in batch.column(0):
            held.append(one.values.to_numpy())
            size += len(held[-1])
            if size >= limit:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def mean_weights(parts: DataFrame) -> DataFrame:
    """(part, seen, weights): means of the tasks' weights, each row of the model weighted by the tokens that moved it.

    `parts` holds (slot, part, seen, weights) with a slot for each task. Tables of at most `FAN_IN` tasks are averaged
    at a time, so no task gathers more, however many tasks there were.
    """

    def mean(group: pa.Table) -> pa.Table:
        seen = np.stack([x.values.to_numpy() for x in group.column("seen")])
        weights = np.stack([x.values.to_numpy() for x in group.column("weights")]).reshape(*seen.shape, -1)
        total = seen.sum(axis=0)
        share = np.where(total > 0, seen / np.maximum(total, 1e-300), 1 / len(seen))
        out = np.einsum("tr,trk->rk", share, weights).astype(np.float32)
        return pa.table({
            "slot": group.column("slot").slice(0, 1), "part": group.column("part").slice(0, 1),
            "seen": pa.array([total], pa.list_(pa.float64())), "weights": pa.array([out.ravel()], pa.list_(pa.float32())),
        })

    slots = (parts.agg(F.max("slot")).first()[0] or 0) + 1
    while True:
        parts = parts.withColumn("slot", F.floor(F.col("slot") / FAN_IN).cast("long"))
        parts = parts.groupBy("slot", "part").applyInArrow(mean, "slot long, part int, seen array<double>, weights array<float>")
        slots = -(-slots // FAN_IN)
        if slots <= 1:
            return parts.drop("slot")


def train_on_all(inputs: DataFrame, model: GatedModel, rates: tuple[float, ...] = RATES) -> GatedModel:
    """The model after one pass over all `inputs`, a round for each rate; see the module's docstring.

    A task holds the model, its moments and one run of texts. The driver gets one model a round.
    """
    spark = inputs.sparkSession
    schema = "slot long, part int, seen array<double>, weights array<float>"
    for k, rate in enumerate(rates):
        sent = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent.value.copy()
            if not own.learn(_runs(batches, RUN_TOKENS), rate):
                return
            seen, weights = own.rows()
            for part, at in enumerate(range(0, len(seen), WEIGHT_ROWS)):
                yield pa.RecordBatch.from_arrays([
                    pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([part], pa.int32()),
                    pa.array([seen[at : at + WEIGHT_ROWS]], pa.list_(pa.float64())),
                    pa.array([weights[at : at + WEIGHT_ROWS].ravel()], pa.list_(pa.float32())),
                ], ["slot", "part", "seen", "weights"])

        parts = stored(inputs.where(F.col("round") == k).select("ids").mapInArrow(run, schema), "gru-weights")
        found = sorted(mean_weights(parts).collect(), key=lambda r: r.part)  # the size of one model
        sent.destroy()
        if found:
            model = model.copy()
            model.set_rows(np.concatenate([np.asarray(r.weights, dtype=np.float32) for r in found]))
    return model.ready()


def lm_scores(
    docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", model_words: int = MODEL_WORDS,
    sent_words: int = SENT_WORDS, rates: tuple[float, ...] = RATES,
) -> DataFrame:
    """(doc_id, learned, n_tokens, n_known, train_tokens, base_score, score), one row for each input row.

    `learn` marks the rows to learn from; counts and the recurrent weights come from all of them, whole. `rates` are the
    learning rates of the rounds that they are dealt to. Words are what white space parts, A-Z
    lower-cased, held as 64-bit hashes; the end of the text is a token. base_score is the add-one score of the counts,
    score the model's log10 probability of the whole text. Null and empty texts are their end alone. Without anything
    to learn from, the score is the base score.

    Counts of the commonest words go to every task; the other words of a text are joined to the counts by a shuffle,
    so no vocabulary is too large. The weights depend on how the rows are partitioned, as tasks learn apart in a round.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learned"))
    counts = stored(word_counts(rows.where("learned"), "text"), "word-counts")
    scorer, cut = count_scorer(counts, model_words, sent_words)
    if scorer.model is not None and rates:
        inputs = dealt_inputs(rows.where("learned"), scorer, len(rates), "doc_id", "text")
        scorer = replace(scorer, model=train_on_all(inputs, scorer.model, rates))
    sent = docs.sparkSession.sparkContext.broadcast(scorer)  # at most sent_words counts and model_words outputs
    per_token = float(np.log10(scorer.tokens + scorer.types + 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for part in slices(texts, SCORE_BYTES):
                n, known, base, model, rest, at = sent.value.score(texts[part])
                size = part.stop - part.start
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(part.start, size), batch.column(2).slice(part.start, size),
                    pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base - n * per_token), pa.array(model),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(rest, pa.int64())),
                ], ["doc_id", "learned", "n_tokens", "known", "base", "model", "rest"])

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, learned boolean, n_tokens long, known long, base double, model double, rest array<long>"
    scored = stored(rows.select("doc_id", "text", "learned").mapInArrow(run, schema)
                    .withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    found = scored.select("row", F.explode("rest").alias("word")).join(counts.where(count_step() < cut).select("word", "n"), "word")
    more = found.groupBy("row").agg(F.count("*").alias("more_known"), F.sum(F.log10(F.col("n") + 1.0)).alias("more"))
    both = scored.drop("rest").join(more, "row", "left")
    return both.select(
        "doc_id", "learned", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(scorer.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("model") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
