"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters slide over every byte of a text. Their responses are max-pooled in overlapping chunks that cover the
whole text, and the chunks' maxima and means over the text are combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tomewise.llm.samples import labelled_sample
from tomewise.llm.words import as_bytes, slices

WIDTH = 6
FILTERS = 16
#: A chunk is two neighbouring halves, so chunks overlap by one half.
HALF = 256
#: Positions whose responses are held at a time: bounds memory whatever the length of a text.
BLOCK = 128 * HALF
SLICE_BYTES = 1 << 21
#: Bound of the training sample: documents of each label, and characters of a document.
SAMPLE_DOCUMENTS = 1000
SAMPLE_CHARS = 20_000
EPOCHS = 12
BATCH = 32


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts in whole halves, each between zeros so wide that no filter lies over two texts: (bytes, first half of each)."""
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    halves = (size + WIDTH) // HALF + 1
    first = np.concatenate(([0], np.cumsum(halves)))
    out = np.zeros(first[-1] * HALF + WIDTH, dtype=np.uint8)
    for text, at in zip(texts, (first[:-1] * HALF).tolist()):
        out[at + WIDTH - 1 : at + WIDTH - 1 + len(text)] = np.frombuffer(text, dtype=np.uint8)
    return out, first


class ByteNet:
    def __init__(self, filters: int = FILTERS, seed: int = 2):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.p = {
            "taps": rng.normal(0, 0.3, (WIDTH, 256, filters)).astype(f), "bias": np.zeros(filters, dtype=f),
            "mean": rng.normal(0, 0.1, filters).astype(f), "max": rng.normal(0, 0.1, filters).astype(f),
            "out": np.zeros(1, dtype=f),
        }
        self.pairs: list[np.ndarray] = []

    def ready(self) -> "ByteNet":
        """Sum the taps of neighbouring bytes in tables, which halves the look-ups of scoring."""
        taps = self.p["taps"]
        self.pairs = [
            (taps[j][:, None, :] + taps[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, WIDTH, 2)
        ]
        return self

    def _halves(self, data: np.ndarray) -> np.ndarray:
        """Each half's largest response of every filter."""
        n = (len(data) - WIDTH) // HALF
        wide = data[:-1].astype(np.int32) * 256 + data[1:]
        out = np.empty((n, self.p["taps"].shape[2]), dtype=np.float32)
        for begin in range(0, n * HALF, BLOCK):
            end = min(begin + BLOCK, n * HALF)
            total = self.pairs[0][wide[begin:end]]
            for j, table in enumerate(self.pairs[1:], 1):
                total += table[wide[begin + 2 * j : end + 2 * j]]
            out[begin // HALF : end // HALF] = total.reshape(-1, HALF, total.shape[1]).max(axis=1)
        return out

    @staticmethod
    def _chunks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each chunk its two halves and its text."""
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        half = np.arange(first[-1])
        last = half == first[1:][text] - 1
        keep = ~last | (np.diff(first)[text] == 1)
        return half[keep], np.where(last, half, half + 1)[keep], text[keep]

    def _combine(self, chunk: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        act = np.maximum(chunk + self.p["bias"], 0)
        begin = np.searchsorted(text, np.arange(n))
        count = np.diff(np.concatenate((begin, [len(text)])))[:, None]
        mean, top = np.add.reduceat(act, begin, axis=0) / count, np.maximum.reduceat(act, begin, axis=0)
        score = mean @ self.p["mean"] + top @ self.p["max"] + self.p["out"][0]
        return act, count, mean, top, 1 / (1 + np.exp(-np.clip(score, -30, 30)))

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each whole text; an empty text is one chunk of zeros."""
        if not texts:
            return np.zeros(0)
        data, first = padded(texts)
        halves = self._halves(data)
        a, b, text = self._chunks(first)
        return self._combine(np.maximum(halves[a], halves[b]), text, len(texts))[-1].astype(float)

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, seed: int = 1) -> "ByteNet":
        """Adam on the cross entropy; gradients reach the bytes at which the filters were largest."""
        rng = np.random.default_rng(seed)
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        t, steps = 0, max(1, epochs * -(-len(texts) // BATCH))
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(texts), BATCH):
                picked = order[at : at + BATCH]
                grads = self._gradients([texts[i] for i in picked], labels[picked])
                t += 1
                step = rate * max(0.05, 1 - t / steps)
                for k, g in grads.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.p[k] -= np.float32(step) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        return self

    def _gradients(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        data, first = padded(texts)
        n = first[-1] * HALF
        total = sum(self.p["taps"][j][data[j : j + n]] for j in range(WIDTH)).reshape(first[-1], HALF, -1)
        where = total.argmax(axis=1)
        halves = np.take_along_axis(total, where[:, None, :], axis=1)[:, 0]
        where = where + (np.arange(first[-1]) * HALF)[:, None]
        a, b, text = self._chunks(first)
        right = halves[b] > halves[a]
        act, count, mean, top, p = self._combine(np.maximum(halves[a], halves[b]), text, len(texts))
        place = np.where(right, where[b], where[a])
        d = ((p - labels) / len(texts)).astype(np.float32)
        is_top = act == top[text]
        ties = np.add.reduceat(is_top.astype(np.float32), np.searchsorted(text, np.arange(len(texts))), axis=0)
        d_act = d[text][:, None] * (self.p["mean"] / count[text] + self.p["max"] * is_top / ties[text])
        d_act = np.where(act > 0, d_act, 0).astype(np.float32)
        filters = act.shape[1]
        column = np.broadcast_to(np.arange(filters), place.shape)
        taps = np.stack([
            np.bincount((data[place + j].astype(np.int64) * filters + column).ravel(), weights=d_act.ravel(), minlength=256 * filters)
            for j in range(WIDTH)
        ]).reshape(self.p["taps"].shape).astype(np.float32)
        return {
            "taps": taps + 1e-5 * self.p["taps"], "bias": d_act.sum(0), "mean": mean.T @ d, "max": top.T @ d,
            "out": d.sum(keepdims=True),
        }


def fit_quality(
    docs: DataFrame, labels: DataFrame, label: Column, per_class: int = SAMPLE_DOCUMENTS, max_chars: int = SAMPLE_CHARS, epochs: int = EPOCHS,
    id_col: str = "doc_id", text_col: str = "text",
) -> ByteNet:
    """Fit the network to up to `per_class` whole texts of each label (0 or 1) with up to `max_chars` characters.

    `docs` holds what may be learned from, `labels` the label's columns by id; rows with a null label or text are no examples. Without examples of both
    labels the network stays as it was made and says little.
    """
    sample = labelled_sample(docs, label.cast("int"), per_class, max_chars, labels=labels, id_col=id_col, text_col=text_col)
    net = ByteNet()
    if sample:
        net.fit([text for text, _, _ in sample], np.array([y for _, y, _ in sample], dtype=float), epochs)
    return net.ready()


def score(docs: DataFrame, net: ByteNet, text_col: str = "text", name: str = "score") -> DataFrame:
    """The input's columns and a double with the probability of label 1, which replaces a column of that name.

    Every byte of every text is read; null counts as empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)  # some megabytes, whatever the data
    names = [c for c in docs.columns if c != name]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(name, T.DoubleType())])
    text_at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(text_at))
            found = np.concatenate([sent.value.predict(texts[p]) for p in slices(texts, SLICE_BYTES)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], schema.names)

    return docs.select(*names).mapInArrow(run, schema)
