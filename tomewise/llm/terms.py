"""Terms of many texts as one Arrow column: maximal runs of member bytes, A-Z lower-cased, every other byte as it is."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tomewise.llm.words import LOWER, mix


def members(excluded: list[tuple[int, int]]) -> np.ndarray:
    """Table of the bytes that may stand in a term: all but the given ranges (both ends belong to them).

    Code points from 128 are written with bytes from 128 only, so a class that holds all of them can be read bytewise.
    """
    table = np.ones(256, dtype=bool)
    for low, high in excluded:
        table[low : high + 1] = False
    return table


#: Letters and all code points from 128.
LETTERS = members([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
#: The same with the digits.
LETTERS_DIGITS = members([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def term_column(texts: list[bytes], member: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts in order, and (one longer than the texts) the number of each text's first term."""
    data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    inside = member[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    offsets = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(end - start, out=offsets[1:])
    terms = pa.Array.from_buffers(
        pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    return terms, np.searchsorted(start, np.concatenate(([0], np.cumsum(lengths))))


def term_hashes(terms: pa.Array) -> np.ndarray:
    """A 64-bit hash of each term, the same in every process."""
    offsets = np.frombuffer(terms.buffers()[1], dtype=np.int64)[terms.offset : terms.offset + len(terms) + 1]
    data = np.frombuffer(terms.buffers()[2], dtype=np.uint8) if len(terms) and terms.buffers()[2] else np.zeros(0, np.uint8)
    out = np.zeros(len(terms), dtype=np.uint64)
    length = np.diff(offsets)
    # One step for each place in a term, over the terms that reach it: there are as many steps as the longest has bytes,
    # so terms over 64 bytes are folded in by their own loop.
    alive = np.flatnonzero(length > 0)
    for place in range(64):
        alive = alive[length[alive] > place]
        if not len(alive):
            break
        out[alive] = out[alive] * np.uint64(0x100000001B3) + data[offsets[alive] + place] + np.uint64(1)
    for i in np.flatnonzero(length > 64):
        out[i] ^= np.uint64(int.from_bytes(bytes(data[offsets[i] + 64 : offsets[i + 1]]), "little") % ((1 << 61) - 1))
    return mix(out + length.astype(np.uint64))


def sums_by_key(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys, ascending, and the sum of each value column by key."""
    if not len(keys):
        return keys, [v[:0] for v in values]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[begin], [np.add.reduceat(v[order], begin) for v in values]


def counts_by_text(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, text, times) for every distinct code of each text, sorted by code; negative codes are passed over."""
    text = np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first))
    keys = (codes.astype(np.int64) << 32 | text)[codes >= 0]
    keys.sort()
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate((begin, [len(keys)])))
    return keys[begin] >> 32, keys[begin] & 0xFFFFFFFF, times


def lists(begin: np.ndarray, values: np.ndarray | pa.Array, kind: pa.DataType) -> pa.Array:
    """`values` cut into one list for each of `begin`."""
    offsets = pa.array(np.concatenate((begin, [len(values)])), pa.int32())
    return pa.ListArray.from_arrays(offsets, values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind))
