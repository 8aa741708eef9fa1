"""A gated recurrent language model in numpy with a class-factored output, trained by truncated backpropagation.

A word's probability is that of its class times that of the word inside the class. Frequent words are dealt to classes
by frequency, and their probabilities inside a class are a softmax of the state. Each class of rare words has fixed
inside probabilities, which the caller adds from counts, so the output covers an unbounded vocabulary.
"""

from __future__ import annotations

import copy
import heapq
from collections.abc import Callable, Iterator

import numpy as np

STREAMS = 128
MOST_STREAMS = 1024
TRUNCATE = 16
#: Lanes in which texts are scored side by side, and the states (lanes x steps) of a window that are held for its outputs.
SCORE_ROWS = 512
SCORE_STATES = 16_384
#: States whose outputs are computed together: their logits stay in a core's cache from product to sum.
OUTPUT_ROWS = 1024
LN10 = np.log(10.0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    """Of an array of its own, in place; an overflow of exp ends as 0, as it should."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _softmax_gradient(x: np.ndarray, every: np.ndarray, target: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Of the loss's mean over `n` tokens by the logits, in their place; and the loss of these rows."""
    x -= x.max(axis=1, keepdims=True)
    picked = x[every, target]
    np.exp(x, out=x)
    total = x.sum(axis=1)
    x *= (1 / (n * total))[:, None]
    x[every, target] -= np.float32(1 / n)
    return x, float((np.log(total) - picked).sum())


def _log_share(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of each row's target under the softmax of the logits, which are spent."""
    top = x.max(axis=1)
    picked = (x[np.arange(len(x)), target] - top).astype(float)
    x -= top[:, None]
    return picked - np.log(np.exp(x, out=x).sum(axis=1))


def _lanes(size: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts one lane after the other, tokens of each lane): the longest texts first, each to the lane with least so far.

    Lanes are in descending order of their tokens.
    """
    lanes = [(0, k) for k in range(min(most, len(size)))]
    texts: list[list[int]] = [[] for _ in lanes]
    for text in np.argsort(-size, kind="stable").tolist():
        load, k = lanes[0]
        heapq.heapreplace(lanes, (load + int(size[text]), k))
        texts[k].append(text)
    lanes.sort(key=lambda lane: (-lane[0], lane[1]))
    order = [text for _, k in lanes for text in texts[k]]
    return np.array(order, dtype=np.int64), np.array([load for load, _ in lanes], dtype=np.int64)


class GatedModel:
    """Inputs 0 to n_words - 1 are the frequent words, 0 being the end of a text, the others the classes of rare words.

    `class_of` gives the class of each input: classes of frequent words first, then one for each class of rare words.
    """

    def __init__(self, word_counts: np.ndarray, rare_counts: np.ndarray, hidden: int = 32, seed: int = 3):
        n, rare = len(word_counts), len(rare_counts)
        self.hidden, self.n_words = hidden, n
        self.n_top = max(1, int(np.ceil(np.sqrt(n))))
        size = -(-n // self.n_top)
        order = np.argsort(-word_counts, kind="stable")
        self.class_of = np.empty(n + rare, dtype=np.int32)
        self.slot = np.zeros(n + rare, dtype=np.int32)
        self.class_of[order] = np.arange(n) // size
        self.slot[order] = np.arange(n) % size
        self.class_of[n:] = self.n_top + np.arange(rare)
        rng = np.random.default_rng(seed)
        f = np.float32
        counts = np.concatenate((word_counts, rare_counts)).astype(float)
        by_class = np.bincount(self.class_of, weights=counts, minlength=self.n_top + rare)
        bias = np.full((self.n_top, size), -1e9)
        bias[self.class_of[:n], self.slot[:n]] = np.log(word_counts + 0.5)
        self.p = {
            "input": rng.normal(0, 0.1, (n + rare, 3 * hidden)).astype(f),
            "bias": np.concatenate((np.ones(hidden), np.zeros(2 * hidden))).astype(f),
            "state": (rng.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(f),
            "classes": np.zeros((hidden, self.n_top + rare), dtype=f),
            "class_bias": np.log(by_class + 0.5).astype(f),
            "words": np.zeros((self.n_top, hidden, size), dtype=f),
            "word_bias": bias.astype(f),
        }

    def _step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        k = self.hidden
        g = h @ self.p["state"]
        gates = sigmoid(x[:, : 2 * k] + g[:, : 2 * k])
        z, r = gates[:, :k], gates[:, k:]
        c = x[:, 2 * k :] + r * g[:, 2 * k :]
        c *= 2
        c = sigmoid(c)
        c *= 2
        c -= 1  # tanh
        return c + z * (h - c), z, r, c, g

    def train(self, ids: np.ndarray, rounds: int, rate: float = 0.01) -> float:
        """`rounds` windows over the ids, from the beginning again where they end; the rate falls. The last loss."""
        learner, loss, done = Learner(self), float("nan"), 0
        while done < rounds and len(ids) > 1:
            for loss in learner.windows(ids, STREAMS, lambda: rate * max(0.02, 1 - done / rounds)):
                done += 1
                if done == rounds:
                    break
        return loss

    def learn(self, ids: Iterator[np.ndarray], rate: float) -> int:
        """One pass over runs of whole texts, each text ended by input 0; how many ids there were.

        A run is cut into streams side by side, so many that there are some 200 windows or as many as `MOST_STREAMS`
        streams leave: memory is bounded by a run and a window.
        """
        learner, total, self.seen = Learner(self), 0, np.zeros(len(self.p["input"]))
        for run in ids:
            streams = int(np.clip(len(run) // (200 * TRUNCATE), STREAMS // 4, MOST_STREAMS))
            for _ in learner.windows(run, streams, lambda: rate):
                pass
            total += len(run)
            self.seen += np.bincount(run, minlength=len(self.seen))
        return total

    def copy(self) -> "GatedModel":
        """With parameters of its own."""
        own = copy.copy(self)
        own.p = {name: v.copy() for name, v in self.p.items()}
        return own

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """(tokens that moved it in `learn`, weights) of each row: the inputs, then the other parameters cut into rows."""
        width = 3 * self.hidden
        rest = np.concatenate([v.ravel() for name, v in self.p.items() if name != "input"])
        rest = np.pad(rest, (0, -len(rest) % width)).reshape(-1, width)
        return np.concatenate((self.seen, np.full(len(rest), self.seen.sum()))), np.concatenate((self.p["input"], rest))

    def set_rows(self, weights: np.ndarray) -> None:
        """Take the weights of `rows`, in their order."""
        at = 0
        weights = weights.ravel()
        for name in ["input", *[n for n in self.p if n != "input"]]:
            v = self.p[name]
            self.p[name] = weights[at : at + v.size].reshape(v.shape).copy()
            at += v.size

    def _window(self, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """Loss (nats per token), gradients and last state of a window: steps x streams inputs and next tokens."""
        k, p = self.hidden, self.p
        steps, streams = x.shape
        inputs = p["input"][x.ravel()]
        inputs += p["bias"]
        inputs = inputs.reshape(steps, streams, 3 * k)
        alive = (x != 0).astype(np.float32)[:, :, None]
        state, saved = np.empty((steps, streams, k), np.float32), []
        for t in range(steps):
            before = h * alive[t]
            h, z, r, c, g = self._step(inputs[t], before)
            state[t] = h
            saved.append((before, z, r, c, g[:, 2 * k :]))
        loss, d_state, grads = self._output_gradients(state.reshape(-1, k), y.ravel())
        d_state = d_state.reshape(steps, streams, k)
        d_in, d_g = np.empty((steps, streams, 3 * k), np.float32), np.empty((steps, streams, 3 * k), np.float32)
        back, dh = np.ascontiguousarray(p["state"].T), np.zeros((streams, k), np.float32)
        for t in reversed(range(steps)):
            before, z, r, c, g = saved[t]
            dh += d_state[t]
            dz, dc = dh * (before - c) * z * (1 - z), dh * (1 - z) * (1 - c * c)
            d_in[t, :, :k], d_in[t, :, 2 * k :] = dz, dc
            d_in[t, :, k : 2 * k] = dc * g * r * (1 - r)
            d_g[t, :, : 2 * k] = d_in[t, :, : 2 * k]
            d_g[t, :, 2 * k :] = dc * r
            dh *= z
            dh += d_g[t] @ back
            dh *= alive[t]
        flat = d_in.reshape(-1, 3 * k)
        grads["state"] = np.concatenate([s[0] for s in saved]).T @ d_g.reshape(-1, 3 * k)
        grads["bias"] = flat.sum(0)
        at = x.ravel()
        order = np.argsort(at.astype(np.int16) if len(p["input"]) < 1 << 15 else at, kind="stable")
        begins = np.flatnonzero(np.diff(at[order], prepend=-1))
        grads["input"] = (at[order][begins], np.add.reduceat(flat[order], begins, axis=0))
        return loss, grads, h

    def _output_gradients(self, state: np.ndarray, target: np.ndarray):
        p, n = self.p, len(target)
        order = np.argsort(self.class_of[target].astype(np.int16), kind="stable")
        state, target = state[order], target[order]
        cls, slot, every = self.class_of[target], self.slot[target], np.arange(n)
        d, loss = np.empty((n, p["classes"].shape[1]), np.float32), 0.0
        for at in range(0, n, OUTPUT_ROWS):
            rows = slice(at, min(at + OUTPUT_ROWS, n))
            x = np.matmul(state[rows], p["classes"], out=d[rows])
            x += p["class_bias"]
            loss += _softmax_gradient(x, every[: len(x)], cls[rows], n)[1]
        grads = {"classes": state.T @ d, "class_bias": d.sum(0)}
        d_state = d @ p["classes"].T
        grads["words"], grads["word_bias"] = np.zeros_like(p["words"]), np.zeros_like(p["word_bias"])
        bounds = np.searchsorted(cls, np.arange(self.n_top + 1))
        for i in np.flatnonzero(np.diff(bounds)):
            rows = slice(bounds[i], bounds[i + 1])
            s = state[rows]
            e, more = _softmax_gradient(s @ p["words"][i] + p["word_bias"][i], every[: len(s)], slot[rows], n)
            loss += more
            grads["words"][i], grads["word_bias"][i] = s.T @ e, e.sum(0)
            d_state[rows] += e @ p["words"][i].T
        out = np.empty_like(d_state)
        out[order] = d_state
        return loss / n, out, grads

    def ready(self) -> "GatedModel":
        """Fold the bias into the inputs before scoring."""
        self.folded = self.p["input"] + self.p["bias"]
        return self

    def log_probabilities(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log probability of each text, its end included: classes, and words inside frequent classes.

        `ids` hold the texts' inputs one after the other, `first` (one longer) where each begins. Texts follow each
        other in lanes of about the same length, which run side by side in windows; the state is carried across windows
        and starts anew after a text's end, so every text is scored whole and by itself.
        """
        size = np.diff(first) + 1
        total = np.zeros(len(size))
        if not len(size):
            return total
        order, load = _lanes(size, SCORE_ROWS)
        owner = np.repeat(order, size[order])
        ends = np.cumsum(size[order]) - 1
        tokens = np.zeros(len(owner), dtype=np.int64)
        words = np.ones(len(owner), dtype=bool)
        words[ends] = False
        shift = first[order] - (ends + 1 - size[order])
        tokens[words] = ids[(np.arange(len(owner)) + np.repeat(shift, size[order]))[words]]
        begin = np.cumsum(load) - load
        h = np.zeros((len(load), self.hidden), dtype=np.float32)
        last = np.zeros(len(load), dtype=np.int64)
        at = 0
        while at < load[0]:
            n = int(np.searchsorted(-load, -at, side="left"))  # lanes that reach into this window
            steps = min(max(16, SCORE_STATES // n), int(load[0]) - at)
            place = np.minimum(begin[:n] + (at + np.arange(steps)[:, None]), len(owner) - 1)
            target, texts, inside = tokens[place], owner[place], words[place]
            states, rows, wanted = [], [], []
            active = np.searchsorted(-load, -(at + np.arange(steps)), side="left").tolist()
            for t, n in enumerate(active):
                state, *_ = self._step(self.folded[last[:n]], h[:n])
                h[:n] = state
                last[:n] = target[t, :n]
                h[np.flatnonzero(~inside[t, :n])] = 0
                states.append(state)
                rows.append(texts[t, :n])
                wanted.append(target[t, :n])
            found = self._log_output(np.concatenate(states), np.concatenate(wanted))
            total += np.bincount(np.concatenate(rows), weights=found, minlength=len(total))
            at += steps
        return total

    def _log_output(self, state: np.ndarray, target: np.ndarray) -> np.ndarray:
        p = self.p
        cls = self.class_of[target]
        out = np.empty(len(cls))
        for at in range(0, len(cls), OUTPUT_ROWS):
            rows = slice(at, at + OUTPUT_ROWS)
            logits = state[rows] @ p["classes"]
            logits += p["class_bias"]
            out[rows] = _log_share(logits, cls[rows])
        order = np.argsort(cls.astype(np.int16), kind="stable")
        bounds = np.searchsorted(cls[order], np.arange(self.n_top + 1))
        for i in np.flatnonzero(np.diff(bounds)):
            rows = order[bounds[i] : bounds[i + 1]]
            logits = state[rows] @ p["words"][i]
            logits += p["word_bias"][i]
            out[rows] += _log_share(logits, self.slot[target[rows]])
        return out


class Learner:
    """Steps of Adam on a model's parameters; of the inputs only the rows seen move."""

    def __init__(self, model: GatedModel):
        self.model, self.done = model, 0
        self.moments = {name: [np.zeros_like(v), np.zeros_like(v)] for name, v in model.p.items()}

    def windows(self, ids: np.ndarray, streams: int, rate: Callable[[], float]) -> Iterator[float]:
        """Learn from texts written one after the other, each ended by input 0; yields each window's loss.

        The ids run through parallel streams in windows of `TRUNCATE` steps. The state is carried from window to
        window and starts anew after an end; gradients stop at a window's beginning. What the streams leave over is
        one more, short stream.
        """
        streams = max(1, min(streams, len(ids) // (2 * TRUNCATE)))
        width = len(ids) // streams
        for part in (ids[: streams * width].reshape(streams, width), ids[streams * width :][None, :]):
            grid = np.ascontiguousarray(np.column_stack((np.zeros(len(part), dtype=part.dtype), part)).T)
            h = np.zeros((len(part), self.model.hidden), np.float32)
            for at in range(0, part.shape[1], TRUNCATE):
                stop = min(at + TRUNCATE, part.shape[1])
                loss, grads, h = self.model._window(grid[at:stop], grid[at + 1 : stop + 1], h)
                self._apply(grads, rate())
                yield loss

    def _apply(self, grads: dict, rate: float) -> None:
        """Gradients are clipped by their common length."""
        self.done += 1
        square = sum(float(np.vdot(d, d)) for d in (g[1] if isinstance(g, tuple) else g for g in grads.values()))
        scale = np.float32(min(1.0, 1.0 / (np.sqrt(square) + 1e-9)))
        first, second = np.float32(rate / (1 - 0.9**self.done)), np.float32(1 / np.sqrt(1 - 0.99**self.done))
        for name, g in grads.items():
            at, g = g if isinstance(g, tuple) else (None, g)
            g *= scale
            m, v = self.moments[name]
            new_m, new_v = (m, v) if at is None else (m[at], v[at])  # whole tables in place, rows as copies
            new_m *= np.float32(0.9)
            new_v *= np.float32(0.99)
            step = g * np.float32(0.1)
            new_m += step
            g *= g
            g *= np.float32(0.01)
            new_v += g
            if at is not None:
                m[at], v[at] = new_m, new_v
            np.sqrt(new_v, out=g)
            g *= second
            g += np.float32(1e-6)
            np.multiply(new_m, first, out=step)
            step /= g
            if at is None:
                self.model.p[name] -= step
            else:
                self.model.p[name][at] -= step
