"""Words of many texts as arrays: a batch of documents is one byte buffer, and every step runs over the buffer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BUFFER_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes x20 and x09 to x0D end a word.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Finish 64-bit hashes so that every bit depends on every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BUFFER_BYTES + 65536)
        tables = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers[:] = tables
    return _powers[0], _powers[1]


class Words:
    """The words of a list of texts.

    `data` is the lower-cased buffer, `start` and `end` the byte range of each word, `first` (one longer than the
    texts) the number of the first word of each text. A text's words never reach into the next text.
    """

    def __init__(self, texts: list[bytes]):
        self.data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.offset = np.concatenate(([0], np.cumsum(lengths)))
        space = IS_SPACE[self.data]
        inside = np.flatnonzero(~space)
        if len(inside):
            gap = np.flatnonzero(np.diff(inside) > 1)
            self.start = inside[np.concatenate(([0], gap + 1))]
            self.end = inside[np.concatenate((gap, [len(inside) - 1]))] + 1
        else:
            self.start = self.end = np.zeros(0, dtype=np.int64)
        self.first = np.searchsorted(self.start, self.offset)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges; equal bytes give equal hashes wherever they stand."""
        power, inverse = _power_tables(len(self.data) + 1)
        if not hasattr(self, "_sums"):
            self._sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[: len(self.data)], out=self._sums[1:])
        return mix((self._sums[end] - self._sums[start]) * inverse[start] + (end - start).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of `width` words inside a text, and the number of the text of each.

    A text with fewer words than that, but at least one, gives its whole sequence as one; a text without words none.
    """
    counts = np.diff(first)
    per_text = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    text = np.repeat(np.arange(len(counts)), per_text)
    begin = np.cumsum(per_text) - per_text
    at = first[:-1][text] + np.arange(len(text)) - begin[text]
    short = counts < width
    length = np.where(short, counts, width)[text]
    padded = np.concatenate((hashes, np.zeros(width, dtype=np.uint64)))
    out = length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(width):
        part = mix(padded[at + k] + np.uint64((k + 1) * int(_BASE) % (1 << 64)))
        out += np.where(k < length, part, np.uint64(0)) if short.any() else part
    return mix(out), text


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def slices(texts: list[bytes], limit: int = BUFFER_BYTES) -> Iterator[slice]:
    """Cut a list into runs of about `limit` bytes; one text stays whole, however long."""
    begin = total = 0
    for i, t in enumerate(texts):
        total += len(t) + 1
        if total >= limit:
            yield slice(begin, i + 1)
            begin, total = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))
