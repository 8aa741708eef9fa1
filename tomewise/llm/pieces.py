"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

Spaces become the marker, a marker is put in front of a text, and characters that no piece covers fall back to their
bytes. No piece holds a marker after another character, so a best path never crosses the start of a run of markers:
each run with the characters after it is a word that is segmented by itself, once for every distinct word of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from tomewise.llm.words import BUFFER_BYTES, as_bytes, mix

#: Stands for the marker inside this module; no UTF-8 text has this byte.
MARK = 0xFF
MARKER = "▁"
UNKNOWN_PENALTY = 10.0
UNKNOWN_TEXT = " ⁇ ".encode()
BATCH_BYTES = BUFFER_BYTES // 2
#: Alphabet of the trie: byte + 1, so that 0 is free.
SYMBOLS = 257


class DoubleArray:
    """Trie in two integer arrays: the child of state s for symbol c is base[s] + c if check of that place is s."""

    def __init__(self, keys: list[bytes], values: list[int]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for key, value in zip(keys, values):
            node = 0
            for byte in key:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][byte]
            ends[node] = value
        size = 2 * len(children) + 2 * SYMBOLS
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        check[0] = 0
        place, queue, free, cursor = {0: 0}, [0], SYMBOLS, 1
        for node in queue:
            at = place.pop(node)
            value[at] = ends[node]
            symbols = sorted(b + 1 for b in children[node])
            if not symbols:
                continue
            if len(symbols) == 1:  # single children fill the gaps that wider nodes leave
                while used[free]:
                    free += 1
                start = max(free - symbols[0], 0)
            else:
                start = cursor
            while any(used[start + c] for c in symbols):
                start += 1
                if start + SYMBOLS >= size:
                    grown = size // 2
                    base, check, value = (np.concatenate((a, np.full(grown, f, np.int32))) for a, f in ((base, 0), (check, -1), (value, -1)))
                    used.extend(bytes(grown))
                    size += grown
            base[at] = start
            if len(symbols) > 1:
                cursor = start
            for c in symbols:
                used[start + c] = 1
                check[start + c] = at
                place[children[node][c - 1]] = start + c
                queue.append(children[node][c - 1])
        self.base, self.check, self.value = base, check, value

    def matches(self, data: np.ndarray, limit: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Every key in the data that begins at one of `starts` and ends by its `limit`: (start, end, value)."""
        at, state, found = starts, np.zeros(len(starts), dtype=np.int32), []
        depth = 0
        symbol = data.astype(np.int32) + 1
        while len(at):
            inside = at + depth < limit
            at, state, limit = at[inside], state[inside], limit[inside]
            nxt = self.base[state] + symbol[at + depth]
            ok = self.check[nxt] == state
            at, state, limit = at[ok], nxt[ok], limit[ok]
            depth += 1
            value = self.value[state]
            hit = value >= 0
            found.append((at[hit], at[hit] + depth, value[hit]))
        if not found:
            empty = np.zeros(0, dtype=np.int64)
            return empty, empty, empty
        return tuple(np.concatenate(part) for part in zip(*found))


#: A file with a score below this holds ranks: no log probability of a piece is so small.
RANKS_BELOW = -1000.0


def zipf_scores(scores: list[float], kinds: list[str]) -> list[float]:
    """Log probabilities of ranked pieces: the one at place r, by falling score, has a share in proportion to 1 / r.

    A file of merges scores its pieces by minus their place, which cannot be added up as logarithms. Equal scores share
    the first of their places. Pieces that are not normal keep theirs.
    """
    normal = np.array([k == "normal" for k in kinds])
    by_fall = -np.array(scores, dtype=np.float64)
    place = 1 + np.searchsorted(np.sort(by_fall[normal]), by_fall[normal])
    out = -by_fall
    out[normal] = -np.log(place) - np.log((1 / place).sum())
    return out.tolist()


class PieceModel:
    """Vocabulary of a SentencePiece model file with byte fallback, and unigram log scores of its pieces."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], byte_ids: list[int], unknown: int):
        self.unknown, self.byte_ids = unknown, np.array(byte_ids, dtype=np.int32)
        keys, values = [], []
        surface = []
        for i, (piece, kind) in enumerate(zip(pieces, kinds)):
            raw = piece.encode().replace(MARKER.encode(), bytes([MARK]))
            if kind == "normal":
                if bytes([MARK]) in raw.lstrip(bytes([MARK])):
                    raise ValueError(f"a marker inside a piece: {piece!r}")
                keys.append(raw)
                values.append(i)
            if kind == "byte":
                raw = bytes([int(piece[3:5], 16)])
            surface.append({"control": b"", "unknown": UNKNOWN_TEXT}.get(kind, raw.replace(bytes([MARK]), b" ")))
        self.trie = DoubleArray(keys, values)
        self.score = np.array(scores, dtype=np.float64)
        self.unknown_score = float(min(self.score[values])) - UNKNOWN_PENALTY
        self.surface = np.frombuffer(b"".join(surface), dtype=np.uint8)
        self.surface_at = np.concatenate(([0], np.cumsum([len(s) for s in surface])))

    @classmethod
    def load(cls, path: str) -> "PieceModel":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds, scores, pieces, byte_ids = [], [], [], [0] * 256
        for i in range(model.get_piece_size()):
            pieces.append(model.id_to_piece(i))
            scores.append(model.get_score(i))
            kinds.append(
                "byte" if model.is_byte(i) else "control" if model.is_control(i)
                else "unknown" if model.is_unknown(i) else "unused" if model.is_unused(i) else "normal"
            )
            if kinds[-1] == "byte":
                byte_ids[int(pieces[-1][3:5], 16)] = i
        if any(s < RANKS_BELOW for s in scores):
            scores = zipf_scores(scores, kinds)
        return cls(pieces, scores, kinds, byte_ids, model.unk_id())

    def _segment(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best paths of words that lie one after the other in `data`: (ids, offsets by word)."""
        n = len(data)
        word_end = np.repeat(end, end - start)
        head = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of characters; the marker is one
        if not len(head):
            return np.zeros(0, dtype=np.int32), np.zeros(len(start) + 1, dtype=np.int64)
        begin, stop, piece = self.trie.matches(data, word_end[head], head)
        gain = self.score[piece]
        length = np.minimum(np.diff(np.concatenate((head, [n]))), word_end[head] - head)
        char_end = np.zeros(n, dtype=np.int64)
        char_end[head] = head + length
        single = np.zeros(n, dtype=bool)
        single[begin[stop == char_end[begin]]] = True
        lone = head[~single[head]]
        begin = np.concatenate((begin, lone))
        stop = np.concatenate((stop, char_end[lone]))
        piece = np.concatenate((piece, np.full(len(lone), -1)))
        gain = np.concatenate((gain, np.full(len(lone), self.unknown_score)))
        # Relax the edges by their distance from the word's start, all words at once; for one start and distance the
        # ends differ, so a round never writes a place twice. On equal scores the earlier start stays.
        offset = begin - np.repeat(start, end - start)[begin]
        order = np.argsort(offset, kind="stable")
        begin, stop, piece, gain, offset = begin[order], stop[order], piece[order], gain[order], offset[order]
        rounds = np.searchsorted(offset, np.arange(offset[-1] + 2)) if len(offset) else np.zeros(1, dtype=np.int64)
        words = np.repeat(np.arange(len(start)), end - start)
        place = np.arange(n) + words  # one place more than bytes for each word: its end
        end_place = stop + words[begin]
        begin_place = place[begin]
        best = np.full(n + len(start), -np.inf)
        best[place[start]] = 0.0
        back = np.zeros(n + len(start), dtype=np.int64)
        took = np.zeros(n + len(start), dtype=np.int32)
        for a, b in zip(rounds[:-1], rounds[1:]):
            total = best[begin_place[a:b]] + gain[a:b]
            to = end_place[a:b]
            better = total > best[to]
            to = to[better]
            best[to] = total[better]
            back[to] = begin_place[a:b][better]
            took[to] = piece[a:b][better]
        # Walk back from every end; the last step of a word is its first piece.
        at, word = end + np.arange(len(start)), np.arange(len(start))
        first = place[start]
        steps = []
        while len(word):
            steps.append((word, took[at], back[at], at))
            at = back[at]
            on = at > first[word]
            at, word = at[on], word[on]
        word = np.concatenate([s[0] for s in steps])
        ids = np.concatenate([s[1] for s in steps])
        frm = np.concatenate([s[2] for s in steps])
        to = np.concatenate([s[3] for s in steps])
        order = np.argsort(to, kind="stable")  # places grow with the words and inside them
        word, ids, frm, to = word[order], ids[order], frm[order], to[order]
        if (ids < 0).any():  # byte fallback
            width = np.where(ids < 0, to - frm, 1)
            source = np.repeat(np.arange(len(ids)), width)
            inner = np.arange(len(source)) - np.repeat(np.cumsum(width) - width, width)
            byte_at = frm[source] - word[source] + inner
            fallback = self.byte_ids[data[np.minimum(byte_at, n - 1)]]
            ids, word = np.where(ids[source] < 0, fallback, ids[source]).astype(np.int32), word[source]
        return ids.astype(np.int32), np.searchsorted(word, np.arange(len(start) + 1))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin. Empty texts have none."""
        marker = MARKER.encode()
        raw = [(b" " + t.replace(marker, b" ")) if t else b"" for t in texts]
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        text_at = np.concatenate(([0], np.cumsum(size)))
        data = np.frombuffer(b"".join(raw), dtype=np.uint8).copy()
        if not len(data):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        data[data == 32] = MARK
        mark = data == MARK
        begins = mark.copy()
        begins[1:] &= ~mark[:-1]
        begins[text_at[:-1][size > 0]] = True
        start = np.flatnonzero(begins)
        end = np.concatenate((start[1:], [len(data)]))
        _, one, which = np.unique(_span_hash(data, start, end), return_index=True, return_inverse=True)
        order = np.argsort(one, kind="stable")
        rank = np.empty(len(one), dtype=np.int64)
        rank[order] = np.arange(len(one))
        one, which = one[order], rank[which]
        length = (end - start)[one]
        local_end = np.cumsum(length)
        picked = np.repeat(start[one] - (local_end - length), length) + np.arange(local_end[-1])
        ids, offset = self._segment(data[picked], local_end - length, local_end)
        count = np.diff(offset)[which]
        total = np.cumsum(count)
        take = np.repeat(offset[which] - (total - count), count) + np.arange(total[-1])
        token_at = np.concatenate(([0], total))[np.searchsorted(start, text_at)]
        return ids[take], token_at

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Texts of runs of ids: surfaces joined, without the space that stands for the marker put in front."""
        size = np.diff(self.surface_at)[ids]
        total = np.cumsum(size)
        if not len(total):
            return [b""] * (len(offsets) - 1)
        take = np.repeat(self.surface_at[ids] - (total - size), size) + np.arange(total[-1])
        joined = self.surface[take].tobytes()
        at = np.concatenate(([0], total))[offsets].tolist()
        return [joined[a:b].removeprefix(b" ") for a, b in zip(at[:-1], at[1:])]


def _span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, by sums of place-dependent terms."""
    from tomewise.llm.words import _power_tables

    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def _loaded(path: str) -> PieceModel:
    return PieceModel.load(path)


def _groups(texts: list[bytes]) -> Iterator[slice]:
    begin = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= BATCH_BYTES:
            yield slice(begin, i + 1)
            begin, total = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def encode(docs: DataFrame, model_path: str | None = None, text_col: str = "text", check: bool = False) -> DataFrame:
    """The input's columns, `ids` (array of int) and `n_tokens` (long), which replace columns of those names.

    Whole texts, however long, in one pass without a shuffle. Null text: null ids, 0 tokens. Empty text: empty ids.
    A literal marker character in a text reads as a space, as the format has it. With `check`, `round_trip` tells
    whether decoding gives the text back (null for null). The model file (a fixed vocabulary) is read once on the
    driver and sent to the tasks.
    """
    model = docs.sparkSession.sparkContext.broadcast(_loaded(model_path or default_model_path()))
    added = [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType())]
    if check:
        added.append(T.StructField("round_trip", T.BooleanType()))
    names = [c for c in docs.columns if c not in {f.name for f in added}]
    schema = T.StructType([docs.schema[c] for c in names] + added)
    text_at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            every = as_bytes(whole.column(text_at))
            for part in _groups(every):
                batch, texts = whole.slice(part.start, part.stop - part.start), every[part]
                ids, at = model.value.encode(texts)
                valid = batch.column(text_at).is_valid()
                nulls = np.flatnonzero(~valid.to_numpy(zero_copy_only=False))
                offsets = pa.array(at, pa.int32(), mask=np.isin(np.arange(len(at)), nulls) if len(nulls) else None)
                columns = [*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(np.diff(at))]
                if check:
                    same = [a.replace(MARKER.encode(), b" ") == b for a, b in zip(texts, model.value.decode(ids, at))]
                    columns.append(pa.array([s if v else None for s, v in zip(same, valid.to_pylist())], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(*names).mapInArrow(run, schema)


def decode(tokens: DataFrame, model_path: str | None = None, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The input's columns with `text_col` set to the decoded ids (null for null ids).

    Ids outside the vocabulary are an error. Byte pieces are joined as bytes; bytes that are no UTF-8 become U+FFFD.
    """
    model = tokens.sparkSession.sparkContext.broadcast(_loaded(model_path or default_model_path()))
    names = [c for c in tokens.columns if c != text_col]
    schema = T.StructType([tokens.schema[c] for c in names] + [T.StructField(text_col, T.StringType())])
    ids_at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(ids_at)
            sizes = np.array([0 if x is None else x for x in pc.list_value_length(column).to_pylist()], dtype=np.int64)
            ids = column.flatten().to_numpy(zero_copy_only=False)
            if len(ids) and (ids.min() < 0 or ids.max() >= len(model.value.score)):
                raise ValueError("an id outside the vocabulary")
            texts = model.value.decode(ids, np.concatenate(([0], np.cumsum(sizes))))
            texts = [t.decode("utf-8", "replace") if v else None for t, v in zip(texts, column.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return tokens.select(*names).mapInArrow(run, schema)
