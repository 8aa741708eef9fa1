"""Toxicity by classifier chains: linear models in sequence, each given the probabilities of the categories before it.

The features of a text are the hashes of its words and of the words' beginnings and endings, each present or absent.
A model knows those that tell its category apart in the training sample. Later models are trained with out-of-fold
probabilities of the earlier ones, as an earlier model would be overconfident on the rows it was fitted to.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tomewise.llm.samples import folds, labelled_sample
from tomewise.llm.words import Words, as_bytes, slices

#: Lengths in bytes of the beginnings and endings that are features of longer words.
BEGINNINGS = (4, 5, 6)
ENDINGS = (2, 3)
FEATURES = 4000
MIN_DOCUMENTS = 4
#: By how much a feature's likelihood ratio must exceed what the best of as many useless features would reach.
MARGIN = 2.0
FOLDS = 4
#: Bound of the training sample: documents of each label value, and characters of a document.
SAMPLE_DOCUMENTS = 5000
SAMPLE_CHARS = 20_000
TABLE_BITS = 20
#: Features are counted in 2**RANGE_BITS ranges of their hashes.
RANGE_BITS = 4
PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def text_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every feature occurrence.

    Words are taken without one ASCII punctuation mark at either end; each kind of feature has its own hashes.
    """
    words = Words(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(words.first))
    start, end = words.start, words.end
    if not len(start):
        return np.zeros(0, dtype=np.uint64), text
    long = end - start > 1
    bare_start = start + (PUNCTUATION[words.data[start]] & long)
    bare_end = end - (PUNCTUATION[words.data[end - 1]] & (end - bare_start > 1))
    hashes, owners = [words.span_hash(bare_start, bare_end)], [text]
    size = bare_end - bare_start
    for k, salt in zip(BEGINNINGS, (1, 2, 3)):
        some = size > k
        hashes.append(words.span_hash(bare_start[some], bare_start[some] + k) ^ np.uint64(salt))
        owners.append(text[some])
    size = end - start
    for k, salt in zip(ENDINGS, (4, 5)):
        some = size > k
        hashes.append(words.span_hash(end[some] - k, end[some]) ^ np.uint64(salt))
        owners.append(text[some])
    return np.concatenate(hashes), np.concatenate(owners)


class Vocabulary:
    """Known feature hashes; a bit table rules most of the others out before the search."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.bits = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.bits[self._slot(self.hashes)] = True

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def look_up(self, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(feature number, owner) of the known ones, each pair once, by owner."""
        if not len(self.hashes):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        maybe = self.bits[self._slot(hashes)]
        hashes, owner = hashes[maybe], owner[maybe]
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes
        pair = np.unique(owner[hit].astype(np.int64) * len(self.hashes) + at[hit])
        return pair % len(self.hashes), pair // len(self.hashes)


@dataclass
class Linear:
    """A logistic model over present features and dense inputs."""

    weights: np.ndarray
    dense: np.ndarray
    bias: float

    def probability(self, feature: np.ndarray, row: np.ndarray, n: int, dense: np.ndarray) -> np.ndarray:
        score = np.bincount(row, weights=self.weights[feature], minlength=n) + self.bias
        if dense.shape[1]:
            score = score + dense @ self.dense
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def fit_linear(
    feature: np.ndarray, row: np.ndarray, dense: np.ndarray, target: np.ndarray, size: int, penalty: float = 1e-4,
    rounds: int = 150, rate: float = 0.3,
) -> Linear:
    """Logistic regression with a quadratic penalty, by gradient steps scaled per coordinate (Adam)."""
    n, width = len(target), dense.shape[1]
    w = np.zeros(size + width + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    share = max(target.mean(), 1 / (n + 1))
    w[-1] = np.log(share / max(1 - share, 1 / (n + 1)))
    for t in range(1, rounds + 1):
        score = np.bincount(row, weights=w[feature], minlength=n) + w[-1] + (dense @ w[size:-1] if width else 0)
        error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - target
        grad = np.concatenate((np.bincount(feature, weights=error[row], minlength=size), dense.T @ error, [error.sum()])) / n
        grad[:-1] += penalty * w[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        w -= rate * (1 - t / (rounds + 1)) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Linear(w[:size], w[size:-1], float(w[-1]))


class Chain:
    """The models of the categories in their order; `predict` feeds each one's probabilities to the next."""

    def __init__(self, names: list[str]):
        self.names = names
        self.vocabulary: Vocabulary | None = None
        self.models: list[Linear] = []

    def fit(self, texts: list[bytes], targets: np.ndarray) -> "Chain":
        """targets: 0 or 1, documents x categories."""
        n = len(texts)
        if not n:
            self.vocabulary = Vocabulary(np.zeros(0, dtype=np.uint64))
            self.models = [Linear(np.zeros(0), np.zeros(k), 0.0) for k in range(len(self.names))]
            return self
        hashes, rows = [], []
        for part in slices(texts):
            h, owner = _distinct(*text_features(texts[part]))
            hashes.append(h)
            rows.append((owner + part.start).astype(np.int32))
        self.vocabulary = Vocabulary(_telling(hashes, rows, targets))
        feature, row = [], []
        for h, owner in zip(hashes, rows):
            f, r = self.vocabulary.look_up(h, owner)
            feature.append(f)
            row.append(r)
        del hashes, rows
        feature, row = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (feature, row))
        size = len(self.vocabulary.hashes)
        fold = folds(n, FOLDS)
        dense = np.zeros((n, 0))
        for k in range(targets.shape[1]):
            out = np.zeros(n)
            for f in range(FOLDS):
                train = fold != f
                if not train.any() or train.all():
                    continue
                at = np.cumsum(train) - 1
                inside = train[row]
                model = fit_linear(feature[inside], at[row[inside]], dense[train], targets[train, k], size)
                out[~train] = model.probability(feature, row, n, dense)[~train]
            self.models.append(fit_linear(feature, row, dense, targets[:, k], size))
            dense = np.column_stack((dense, out))
        return self

    def predict(self, texts: list[bytes]) -> np.ndarray:
        feature, row = self.vocabulary.look_up(*text_features(texts))
        dense = np.zeros((len(texts), 0))
        for model in self.models:
            dense = np.column_stack((dense, model.probability(feature, row, len(texts), dense)))
        return dense


def _distinct(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    order = order[np.argsort(owner[order], kind="stable")]
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]


def _telling(hashes: list[np.ndarray], rows: list[np.ndarray], targets: np.ndarray) -> np.ndarray:
    """The features whose presence tells most about a target, by the likelihood ratio of dependence.

    As very many features are tried, only those count whose ratio chance would hardly reach among so many. They are
    counted one range of hashes after the other, so that the work arrays stay small.
    """
    tried, known, ratios = 0, [], []
    for span in range(1 << RANGE_BITS):
        inside = [(h >> np.uint64(64 - RANGE_BITS)) == span for h in hashes]
        some = [h[i] for h, i in zip(hashes, inside)]
        if not any(map(len, some)):
            continue
        owner = np.concatenate([r[i] for r, i in zip(rows, inside)])
        values, number, count = np.unique(np.concatenate(some), return_inverse=True, return_counts=True)
        tried += len(values)
        often = count >= MIN_DOCUMENTS
        known.append(values[often])
        ratios.append([
            _ratio(count[often], np.bincount(number, weights=target[owner], minlength=len(count))[often], target)
            for target in targets.T
        ])
    if not known:
        return np.zeros(0, dtype=np.uint64)
    known, keep = np.concatenate(known), []
    for ratio in map(np.concatenate, zip(*ratios)):
        best = np.argsort(-ratio, kind="stable")[:FEATURES]
        keep.append(best[ratio[best] > 2 * np.log(max(tried, 2)) + MARGIN])
    return known[np.unique(np.concatenate(keep))]


def _ratio(count: np.ndarray, inside: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Likelihood ratio of features in `count` examples, of which `inside` are positive."""
    n, positive = len(target), target.sum()

    def part(observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return observed * np.log(np.maximum(observed, 1e-12) / np.maximum(expected, 1e-12))

    share = positive / max(n, 1)
    outside, absent, absent_out = count - inside, positive - inside, (n - positive) - (count - inside)
    return 2 * (part(inside, count * share) + part(outside, count * (1 - share))
                + part(absent, (n - count) * share) + part(absent_out, (n - count) * (1 - share)))


def fit_chain(
    docs: DataFrame, labels: DataFrame, categories: dict[str, Column], per_class: int = SAMPLE_DOCUMENTS, max_chars: int = SAMPLE_CHARS,
    id_col: str = "doc_id", text_col: str = "text",
) -> Chain:
    """Fit the chain for 0/1 columns of `labels` (joined by id), in the given order, on a bounded sample.

    The sample is balanced on the last category: up to `per_class` documents with and without it, of up to `max_chars`
    characters. A null label counts as 0 unless it is the last one's, whose rows are left out. Without any labelled
    document every probability is one half.
    """
    *before, last = categories
    sample = labelled_sample(
        docs, categories[last].cast("int"), per_class, max_chars, labels=labels, id_col=id_col, text_col=text_col,
        more={name: F.coalesce(categories[name].cast("int"), F.lit(0)) for name in before},
    )
    targets = np.array([[*more, label] for _, label, more in sample], dtype=float).reshape(-1, len(categories))
    return Chain(list(categories)).fit([text for text, _, _ in sample], targets)


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The input's columns and a double `p_<category>` for each category, which replace columns of those names.

    Every whole text is read; null counts as empty, and texts without known features get the model's base rate.
    """
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # a few thousand features
    added = [f"p_{name}" for name in chain.names]
    names = [c for c in docs.columns if c not in added]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(c, T.DoubleType()) for c in added])
    text_at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(text_at))
            found = np.concatenate([sent.value.predict(texts[p]) for p in slices(texts)] or [np.zeros((0, len(added)))])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[:, k]) for k in range(len(added)))], schema.names)

    return docs.select(*names).mapInArrow(run, schema)
