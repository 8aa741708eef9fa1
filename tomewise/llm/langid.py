"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are learned with the follow-the-regularised-leader rule under an elastic net (most stay exactly zero) and the
probabilities are calibrated by one temperature on examples set aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tomewise.llm.samples import folds, labelled_sample
from tomewise.llm.tables import summed_counters
from tomewise.llm.words import as_bytes, slices

BITS = 15
SIZE = 1 << BITS
ORDERS = (1, 2, 3)
ROWS = 64
BLOCK = 1 << 20
UNKNOWN = "und"
#: Bound of the training sample: documents of each language, and characters of a document.
SAMPLE_DOCUMENTS = 1500
SAMPLE_CHARS = 20_000
EPOCHS = 3


def gram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count) of the character n-grams of each whole text, by text; letters A-Z in lower case.

    N-grams of all orders are hashed to SIZE features. They do not reach from one text into the next.
    """
    points = [np.frombuffer(t.lower().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32) for t in texts]
    gap = np.zeros(max(ORDERS), dtype=np.uint32)
    joined = np.concatenate([x for p in points for x in (p, gap)]) if texts else gap
    length = np.fromiter((len(p) + len(gap) for p in points), dtype=np.int64, count=len(points))
    text = np.repeat(np.arange(len(texts)), length)
    counts = np.zeros(len(texts) * SIZE, dtype=np.int64)
    n = len(text)
    for begin in range(0, n, BLOCK):
        end = min(begin + BLOCK, n)
        value = np.zeros(end - begin, dtype=np.uint32)
        full = np.ones(end - begin, dtype=bool)
        for k in range(max(ORDERS)):
            stop = min(end + k, n)
            following = np.zeros(end - begin, dtype=np.uint32)
            following[: stop - begin - k] = joined[begin + k : stop]
            full &= following != 0
            value = (value ^ following) * np.uint32(0x9E3779B1)
            value ^= value >> np.uint32(15)
            if k + 1 in ORDERS:
                feature = ((value * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.int64)
                counts += np.bincount(text[begin:end][full] * SIZE + feature[full], minlength=len(counts))
    at = np.flatnonzero(counts)
    return at >> BITS, at & (SIZE - 1), counts[at]


def document_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """In how many of the rows each feature occurs; the last number is that of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray]]:
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for begin in range(0, len(texts), ROWS):
                _, feature, _ = gram_counts(texts[begin : begin + ROWS])
                rows = min(ROWS, len(texts) - begin)
                yield np.append(np.bincount(feature, minlength=SIZE), rows)

    return summed_counters(docs.select(text_col), run, SIZE + 1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class LanguageModel:
    labels: list
    weights: np.ndarray  # features and a constant x labels
    idf: np.ndarray
    temperature: float = 1.0

    def vectors(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, value): TF-IDF of unit length."""
        text, feature, count = gram_counts(texts)
        value = (1 + np.log(count)) * self.idf[feature]
        norm = np.sqrt(np.bincount(text, weights=value * value, minlength=len(texts)))
        return text, feature, value / np.maximum(norm[text], 1e-12)

    def logits(self, texts: list[bytes]) -> np.ndarray:
        out = np.tile(self.weights[-1], (len(texts), 1))
        for begin in range(0, len(texts), ROWS):
            text, feature, value = self.vectors(texts[begin : begin + ROWS])
            if len(text):
                some, at = np.unique(text, return_index=True)
                out[begin + some] += np.add.reduceat(value[:, None] * self.weights[feature], at, axis=0)
        return out

    def predict(self, texts: list[bytes]) -> tuple[list, np.ndarray]:
        """The likeliest label of each text and its calibrated probability."""
        p = softmax(self.logits(texts) / self.temperature)
        best = p.argmax(axis=1)
        return [self.labels[i] for i in best], p[np.arange(len(texts)), best]


def fit_weights(
    vectors: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, labels: int, epochs: int = EPOCHS, alpha: float = 1.0,
    beta: float = 1.0, lasso: float = 0.02, ridge: float = 0.5, seed: int = 6,
) -> np.ndarray:
    """Follow the regularised leader, one example at a time, each touching its own features only."""
    z, n = np.zeros((SIZE + 1, labels)), np.zeros((SIZE + 1, labels))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= lasso, 0.0, (np.sign(z) * lasso - z) / ((beta + np.sqrt(n)) / alpha + ridge))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(vectors)):
            feature, value = vectors[i]
            zi, ni = z[feature], n[feature]
            w = weights(zi, ni)
            error = softmax(value @ w)
            error[target[i]] -= 1
            grad = value[:, None] * error
            more = ni + grad * grad
            z[feature] = zi + grad - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[feature] = more
    return weights(z, n)


def calibrated(logits: np.ndarray, target: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""

    def loss(t: float) -> float:
        return -np.log(softmax(logits / np.exp(t))[np.arange(len(target)), target] + 1e-12).mean()

    low, high, ratio = -4.0, 2.0, (np.sqrt(5) - 1) / 2
    while high - low > 1e-3:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit_language_model(
    docs: DataFrame, label: Column, per_class: int = SAMPLE_DOCUMENTS, max_chars: int = SAMPLE_CHARS, id_col: str = "doc_id",
    text_col: str = "text",
) -> LanguageModel | None:
    """Fit to `docs`, which hold what may be learned from; None without any labelled text.

    Document frequencies come from all rows with a label; weights from up to `per_class` texts of each label with up
    to `max_chars` characters, four fifths for the weights and the rest for the temperature.
    """
    known = docs.where(label.isNotNull() & F.col(text_col).isNotNull())
    sample = labelled_sample(known, label, per_class, max_chars, id_col=id_col, text_col=text_col)
    if not sample:
        return None
    counts = document_counts(known, text_col)
    labels = sorted({y for _, y, _ in sample})
    model = LanguageModel(labels, np.zeros((SIZE + 1, len(labels))), np.log((1 + counts[-1]) / (1 + counts[:-1])) + 1)
    target = np.array([labels.index(y) for _, y, _ in sample])
    texts = [t for t, _, _ in sample]
    vectors = []
    for begin in range(0, len(texts), ROWS):
        part = texts[begin : begin + ROWS]
        text, feature, value = model.vectors(part)
        at = np.searchsorted(text, np.arange(len(part) + 1))
        vectors += [(np.append(feature[a:b], SIZE), np.append(value[a:b], 1.0)) for a, b in zip(at[:-1], at[1:])]
    aside = folds(len(texts), 5) == 0 if len(texts) >= 20 else np.zeros(len(texts), dtype=bool)
    learn = np.flatnonzero(~aside)
    model.weights = fit_weights([vectors[i] for i in learn], target[learn], len(labels))
    if aside.any():
        rest = np.flatnonzero(aside)
        model.temperature = calibrated(model.logits([texts[i] for i in rest]), target[rest])
    return model


def identify(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """The input's columns, `lang_pred` and `score` (its calibrated probability), which replace columns of those names.

    A text that is null or has no letter is `und` with score 0, as is every text when nothing was learned.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SIZE x labels numbers
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = T.StructType([docs.schema[c] for c in names] + [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    text_at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(text_at))
            lettered = [any(map(str.isalpha, t.decode("utf-8", "replace"))) for t in texts]
            labels, scores = [], []
            for part in slices(texts):
                best, p = sent.value.predict(texts[part]) if sent.value else ([None] * (part.stop - part.start), 0)
                labels += best
                scores.append(np.broadcast_to(p, len(best)))
            scores = np.concatenate(scores) if scores else np.zeros(0)
            known = np.array(lettered, dtype=bool) & (sent.value is not None)
            labels = [x if k else UNKNOWN for x, k in zip(labels, known.tolist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(labels, pa.string()), pa.array(np.where(known, scores, 0.0))], schema.names)

    return docs.select(*names).mapInArrow(run, schema)
