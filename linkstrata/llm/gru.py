"""Gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, state carried across windows.

A token is a number: below ``frequent`` it is a word of the lexicon (0 is the end of a text), otherwise ``frequent`` plus the spelling class of
a rarer word. The model gives the probability of a token's class, and of a word within its class. Every word has an embedding of its own as
input and as output; these two tables are updated row by row (Adagrad), all other parameters as a whole (Adam). The state starts at zero
in each text, takes up one token after another, and is carried on for as long as the text lasts.
"""

from __future__ import annotations

import ctypes
import heapq
from dataclasses import dataclass
from itertools import pairwise

import numpy as np

BLOCK = 512  # rows whose scores stay in a core's cache
SMALL = 60.0  # exponentials of scores up to this, and their sums, are far from the ends of the range of 32-bit numbers
ROWS = ("x", "words", "word_bias")  # one row per token or word


@dataclass(frozen=True)
class Layout:
    """``bounds`` cuts the words of the lexicon, most frequent first, into classes; ``spelling`` is the number of classes of rarer words."""

    bounds: tuple[int, ...]
    spelling: int

    @property
    def frequent(self) -> int:
        return self.bounds[-1]

    @property
    def classes(self) -> int:
        return len(self.bounds) - 1 + self.spelling

    def class_of(self) -> np.ndarray:
        """Class of each token number."""
        sizes = [b - a for a, b in pairwise(self.bounds)]
        return np.concatenate([np.repeat(np.arange(len(sizes)), sizes), len(sizes) + np.arange(self.spelling)]).astype(np.int64)


@dataclass(frozen=True)
class Settings:
    hidden: int = 16
    lanes: int = 384
    window: int = 24
    segment: int = 2048
    rate: float = 0.01
    row_rate: float = 0.05
    clip: float = 1.0
    seed: int = 7


def keep_freed_memory() -> None:
    """Has glibc keep up to 64 MB of freed memory, and take arrays of up to 32 MB from it: fresh pages for the arrays of every window took a quarter of the time."""
    trim, mapped = -1, -3  # M_TRIM_THRESHOLD, M_MMAP_THRESHOLD
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError, TypeError):  # another C library
        return
    mallopt(trim, 1 << 26)
    mallopt(mapped, 1 << 25)


def start(layout: Layout, class_bias: np.ndarray, word_bias: np.ndarray, s: Settings) -> dict[str, np.ndarray]:
    """Initial parameters; the biases carry the known frequencies, so that learning starts from a unigram model."""
    rng = np.random.default_rng(s.seed)
    h, tokens = s.hidden, layout.frequent + layout.spelling

    def small(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(h)).astype(np.float32)

    return {
        "x": small(tokens, h), "input": small(h, 3 * h), "gates": small(h, 2 * h), "candidate": small(h, h), "classes": 0.1 * small(h, layout.classes),
        "class_bias": class_bias.astype(np.float32), "words": 0.1 * small(layout.frequent, h), "word_bias": word_bias.astype(np.float32),
    }


def _sigmoid(a: np.ndarray) -> np.ndarray:
    """In place; the exponential of a score far below zero may be infinite, which gives zero."""
    np.negative(a, out=a)
    with np.errstate(over="ignore"):
        np.exp(a, out=a)
    a += 1
    return np.reciprocal(a, out=a)


def _exponentials(a: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray | float]:
    """Exponentials of the scores, in their place, summed by row; and what was taken from the scores of each row before, nothing where all are ``small``."""
    top: np.ndarray | float = 0.0
    if not small:
        top = a.max(axis=1)
        a -= top[:, None]
    np.exp(a, out=a)
    return a @ np.ones(a.shape[1], dtype=a.dtype), top


def _small(weights: np.ndarray, states: np.ndarray) -> bool:
    """Whether no score of a state, by weights of one row for each output, can be so large or small that its exponential leaves the range of the type."""
    return len(states) == 0 or bool(np.abs(weights).sum(axis=1).max(initial=0) * np.abs(states).max() < SMALL)


def _by_class(classes: np.ndarray, layout: Layout) -> np.ndarray:
    """Order of rows by class; numbers of two bytes are sorted by digits."""
    return np.argsort(classes.astype(np.uint16) if layout.classes <= 1 << 16 else classes, kind="stable")


def _with_one(a: np.ndarray) -> np.ndarray:
    """A column of ones at the end, so that a bias is one more weight."""
    return np.concatenate([a, np.ones((len(a), 1), dtype=a.dtype)], axis=1)


def _steps(p: dict, h: np.ndarray, tokens: np.ndarray, inputs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list]:
    """Runs over ``tokens`` (steps, lanes; -1 is padding): the states before each step, the state after the last, and what backpropagation needs.

    Inside, lanes are the last axis, so that gates are whole blocks of memory. ``inputs``: what each token gives to the gates and the candidate, if known.
    """
    size, (steps, lanes) = h.shape[1], tokens.shape
    before, kept = np.empty((steps, size, lanes), dtype=np.float32), []
    given = p["x"][tokens.ravel()] @ p["input"] if inputs is None else inputs[tokens.ravel()]
    given = np.ascontiguousarray(given.reshape(steps, lanes, 3 * size).transpose(0, 2, 1))
    into_gates, into_candidate = np.ascontiguousarray(p["gates"].T), np.ascontiguousarray(p["candidate"].T)
    alive = (tokens > 0).astype(np.float32)  # a text that has ended (or padding) starts anew
    h = np.ascontiguousarray(h.T)
    for t in range(steps):
        before[t] = h
        gates = into_gates @ h
        gates += given[t, :2 * size]
        _sigmoid(gates)
        z, r = gates[:size], gates[size:]
        c = into_candidate @ (r * h)
        c += given[t, 2 * size:]
        np.tanh(c, out=c)
        kept.append((z, r, c))
        h = h + z * (c - h)
        h *= alive[t]
    return np.ascontiguousarray(before.transpose(0, 2, 1)), np.ascontiguousarray(h.T), kept


def _word_rows(layout: Layout, ordered: np.ndarray):
    """(first row, last row + 1, first word, last word + 1) for each class of several words that occurs among the rows, whose classes are ``ordered``."""
    starts = np.searchsorted(ordered, np.arange(len(layout.bounds)))
    for number in np.flatnonzero(starts[1:] > starts[:-1]):
        low, high = layout.bounds[number], layout.bounds[number + 1]
        if high - low > 1:
            yield starts[number], starts[number + 1], low, high


def log_probabilities(p: dict, layout: Layout, states: np.ndarray, tokens: np.ndarray, class_of: np.ndarray) -> np.ndarray:
    """Natural log probability of each token given the state before it."""
    order = _by_class(class_of[tokens], layout)
    states, tokens = _with_one(states[order]), tokens[order]
    classes = class_of[tokens]
    top, words = np.concatenate([p["classes"], p["class_bias"][None]]), np.concatenate([p["words"], p["word_bias"][:, None]], axis=1)
    small = _small(top.T, states)
    logs = np.empty(len(tokens), dtype=states.dtype)
    for at in range(0, len(tokens), BLOCK):
        scores = states[at:at + BLOCK] @ top
        own = scores[np.arange(len(scores)), classes[at:at + BLOCK]]
        total, less = _exponentials(scores, small)
        logs[at:at + BLOCK] = own - less - np.log(total)
    small = _small(words, states)
    for first, last, low, high in _word_rows(layout, classes):
        for at in range(first, last, BLOCK):
            to = min(at + BLOCK, last)
            scores = states[at:to] @ words[low:high].T
            own = scores[np.arange(to - at), tokens[at:to] - low]
            total, less = _exponentials(scores, small)
            logs[at:to] += own - less - np.log(total)
    found = np.empty_like(logs)
    found[order] = logs
    return found


def lanes_of(texts: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Deals texts to lanes, longest first: token numbers and text numbers, both (steps, lanes), -1 where a lane has ended."""
    total = sum(map(len, texts))
    longest = max(map(len, texts))
    width = max(1, min(most, total // longest))
    loads = [(0, i) for i in range(width)]
    queues: list[list[int]] = [[] for _ in range(width)]
    for number in sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i)):
        load, lane = heapq.heappop(loads)
        queues[lane].append(number)
        heapq.heappush(loads, (load + len(texts[number]), lane))
    steps = max(load for load, _ in loads)
    tokens, owners = np.full((steps, width), -1, dtype=np.int64), np.full((steps, width), -1, dtype=np.int64)
    for lane, queue in enumerate(queues):
        if queue:
            joined = np.concatenate([texts[i] for i in queue])
            tokens[:len(joined), lane] = joined
            owners[:len(joined), lane] = np.repeat(queue, [len(texts[i]) for i in queue])
    return tokens, owners


def score_texts(p: dict, layout: Layout, texts: list[np.ndarray], most_lanes: int = 1024, batch: int = 1 << 15) -> np.ndarray:
    """Natural log probability of each whole text; the state is carried from window to window. A window has about ``batch`` tokens."""
    found = np.zeros(len(texts))
    if not texts:
        return found
    keep_freed_memory()
    class_of = layout.class_of()
    tokens, owners = lanes_of(texts, most_lanes)
    h = np.zeros((tokens.shape[1], p["candidate"].shape[0]), dtype=np.float32)
    window = max(1, batch // tokens.shape[1])
    inputs = p["x"] @ p["input"]
    for at in range(0, len(tokens), window):
        part, owner = tokens[at:at + window], owners[at:at + window].ravel()
        before, h, _ = _steps(p, h, part, inputs)
        real = owner >= 0
        logs = log_probabilities(p, layout, before.reshape(-1, h.shape[1])[real], part.ravel()[real], class_of)
        found += np.bincount(owner[real], weights=logs, minlength=len(texts))
    return found


def _gradients(p: dict, layout: Layout, h: np.ndarray, part: np.ndarray, class_of: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the mean loss of one window, and the state after it."""
    tables = {k: np.zeros_like(p[k]) for k in ROWS}

    def keep(key: str, rows, values: np.ndarray) -> None:
        tables[key][rows] = values

    g, after = _backward(p, layout, h, part, class_of, keep)
    return g | tables, after


def _backward(p: dict, layout: Layout, h: np.ndarray, part: np.ndarray, class_of: np.ndarray, on_rows) -> tuple[dict, np.ndarray]:
    """As ``_gradients``, but those of the row tables are given to ``on_rows`` (table, rows, values) once the rows have been used."""
    size = h.shape[1]
    before, after, kept = _steps(p, h, part)
    flat, tokens = before.reshape(-1, size), part.ravel()
    real = np.flatnonzero(tokens >= 0)
    scale = np.float32(1 / max(1, len(real)))
    order = real[_by_class(class_of[tokens[real]], layout)]
    states, aims = _with_one(flat[order]), tokens[order]
    classes = class_of[aims]
    top, words = np.concatenate([p["classes"], p["class_bias"][None]]), np.concatenate([p["words"], p["word_bias"][:, None]], axis=1)
    on_top, on_words, down = np.zeros_like(top), np.zeros_like(words), np.empty((len(aims), size), dtype=flat.dtype)

    def missed(scores: np.ndarray, aim: np.ndarray, small: bool) -> np.ndarray:
        total, _ = _exponentials(scores, small)
        scores *= (scale / total)[:, None]
        scores[np.arange(len(aim)), aim] -= scale
        return scores

    small = _small(top.T, states)
    for at in range(0, len(aims), BLOCK):
        rows = states[at:at + BLOCK]
        miss = missed(rows @ top, classes[at:at + BLOCK], small)
        on_top += (miss.T @ rows).T
        down[at:at + BLOCK] = miss @ p["classes"].T
    small = _small(words, states)
    for first, last, low, high in _word_rows(layout, classes):
        for at in range(first, last, BLOCK):
            to = min(at + BLOCK, last)
            miss = missed(states[at:to] @ words[low:high].T, aims[at:to] - low, small)
            down[at:to] += miss @ p["words"][low:high]
            on_words[low:high] += miss.T @ states[at:to]
    g = {"classes": on_top[:size], "class_bias": on_top[size]}
    outer = np.zeros_like(flat)
    outer[order] = down
    outer = np.ascontiguousarray(outer.reshape(before.shape).transpose(0, 2, 1))
    prior_of = np.ascontiguousarray(before.transpose(0, 2, 1))
    alive = (part > 0).astype(np.float32)
    carried = np.zeros((size, part.shape[1]), dtype=h.dtype)
    inputs, reset = np.empty((len(part), 3 * size, part.shape[1]), dtype=np.float32), np.empty((len(part), size, part.shape[1]), dtype=np.float32)
    for t in range(len(part) - 1, -1, -1):
        z, r, c = kept[t]
        prior, step = prior_of[t], inputs[t]
        new = carried * alive[t]
        pull = new * z
        step[2 * size:] = pull * (1 - c * c)
        pull *= c - prior
        step[:size] = pull * (1 - z)
        d_rh = p["candidate"] @ step[2 * size:]
        reset[t] = r * prior
        d_rh *= r
        step[size:2 * size] = d_rh * prior * (1 - r)
        carried = new * (1 - z)
        carried += d_rh
        carried += p["gates"] @ step[:2 * size]
        carried += outer[t]
    flat_inputs = inputs.transpose(0, 2, 1).reshape(-1, 3 * size)
    g["gates"] = flat.T @ flat_inputs[:, :2 * size]
    g["candidate"] = reset.transpose(0, 2, 1).reshape(-1, size).T @ flat_inputs[:, 2 * size:]
    numbers = tokens[real]
    by_number = real[np.argsort(numbers.astype(np.uint16) if layout.frequent + layout.spelling <= 1 << 16 else numbers, kind="stable")]
    ordered, flat_inputs = tokens[by_number], flat_inputs[by_number]
    g["input"] = p["x"][ordered].T @ flat_inputs
    flat_inputs = flat_inputs @ p["input"].T
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    if len(ordered):
        on_rows("x", ordered[starts], np.add.reduceat(flat_inputs, starts, axis=0))
    on_rows("words", slice(None), np.ascontiguousarray(on_words[:, :size]))
    on_rows("word_bias", slice(None), np.ascontiguousarray(on_words[:, size]))
    return {k: g[k] for k in p if k not in ROWS}, after


class Trainer:
    """Truncated backpropagation over one batch of texts after another; parameters and optimizer state go on from batch to batch.

    Texts are cut into segments for this, so that a few long ones cannot leave the other lanes idle; every token is learned from. A window has about
    ``lanes * window`` tokens, also where there are fewer lanes.
    """

    def __init__(self, p: dict, layout: Layout, s: Settings):
        keep_freed_memory()
        self.p = {k: v.copy() for k, v in p.items()}
        self.layout, self.settings, self.class_of = layout, s, layout.class_of()
        self.whole = [k for k in p if k not in ROWS]
        self.mean, self.square = {k: np.zeros_like(p[k]) for k in self.whole}, {k: np.zeros_like(p[k]) for k in self.whole}
        self.sums = {k: np.full(len(p[k]), 1e-10, dtype=np.float32) for k in ROWS}
        self.steps = self.tokens = 0

    def _on_rows(self, key: str, rows, values: np.ndarray) -> None:
        sums = self.sums[key]
        sums[rows] += values * values if values.ndim == 1 else np.einsum("ij,ij->i", values, values) / values.shape[1]
        step = np.float32(self.settings.row_rate) / np.sqrt(sums[rows])
        values *= step if values.ndim == 1 else step[:, None]
        self.p[key][rows] -= values

    def learn(self, texts: list[np.ndarray]) -> None:
        s, p = self.settings, self.p
        pieces = [t[i:i + s.segment] for t in texts for i in range(0, len(t), s.segment)]
        if not pieces:
            return
        tokens, _ = lanes_of(pieces, s.lanes)
        self.tokens += sum(map(len, texts))
        window = max(s.window, s.lanes * s.window // tokens.shape[1])
        h = np.zeros((tokens.shape[1], s.hidden), dtype=np.float32)
        for at in range(0, len(tokens), window):
            self.steps += 1
            g, h = _backward(p, self.layout, h, tokens[at:at + window], self.class_of, self._on_rows)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            shrink = np.float32(min(1.0, s.clip / norm) if norm else 1.0)
            for k in self.whole:
                v, mean, square = g[k] * shrink, self.mean[k], self.square[k]
                mean += 0.1 * (v - mean)
                square += 0.001 * (v * v - square)
                p[k] -= s.rate * (mean / (1 - 0.9 ** self.steps)) / (np.sqrt(square / (1 - 0.999 ** self.steps)) + 1e-8)


def fit(p: dict, layout: Layout, texts: list[np.ndarray], s: Settings) -> dict[str, np.ndarray]:
    """One pass over the texts; returns new parameters."""
    trainer = Trainer(p, layout, s)
    trainer.learn(texts)
    return trainer.p
