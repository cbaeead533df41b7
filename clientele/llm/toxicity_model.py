"""Convolutional text classifier in numpy: hashed word embeddings, three filter widths, max pooling.

A word's embedding is the sum of three rows of one table, found by hashing the
word, its first 4 and its first 6 bytes, so that unseen inflections of a known
stem still say something.  Texts are rows of one padded word sequence; a text
of any length is pooled in pieces of ``PIECE_WORDS``.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .common import LOWER, U64, TextBatch, hash_stream, mix64

DIM, FILTERS, WIDTHS = 16, 16, (1, 2, 3)
# Rows of the embedding table: words, 4-byte stems, 6-byte stems, and the zero row of the padding.
ROWS = (1 << 14, 1 << 13, 1 << 13)
PAD = sum(ROWS)
PIECE_WORDS = 1 << 15
_STEMS = (4, 6)
_FACTOR = hash_stream(max(_STEMS), 71) | U64(1)


def word_ids(words: TextBatch) -> np.ndarray:
    """(words, 3) table rows of every word of a batch."""
    out = np.empty((len(words.hash), 3), np.int32)
    out[:, 0] = words.hash >> U64(64 - 14)
    raw = np.append(words.raw, np.zeros(max(_STEMS), np.uint8))
    base = ROWS[0]
    with np.errstate(over="ignore"):
        for column, stem in enumerate(_STEMS, 1):
            h = np.zeros(len(words.hash), U64)
            for i in range(stem):
                h += np.where(words.length > i, LOWER[raw[words.start + i]], 0).astype(U64) * _FACTOR[i]
            out[:, column] = (mix64(h) >> U64(64 - 13)).astype(np.int32) + base
            base += ROWS[column]
    return out


def _padded(ids: np.ndarray, first: np.ndarray):
    """Pieces of the texts ``first[i]:first[i + 1]`` in one sequence, each followed by padding.

    Yields (sequence of ids, starts, stops, text of each piece); windows start in [start, stop).
    """
    reach = max(WIDTHS) - 1
    rows, starts, stops, owner, at = [], [], [], [], 0
    empty = np.full((1, 3), PAD, np.int32)
    tail = np.full((reach, 3), PAD, np.int32)
    for text, (lo, hi) in enumerate(zip(first[:-1], first[1:])):
        for a in range(lo, max(hi, lo + 1), PIECE_WORDS):
            b = min(a + PIECE_WORDS, hi)
            part = ids[a:min(b + reach, hi)] if hi > lo else empty
            rows += [part, tail]
            starts.append(at)
            stops.append(at + max(b - a, 1))
            owner.append(text)
            at += len(part) + reach
            if at >= PIECE_WORDS:
                yield np.concatenate(rows), np.array(starts), np.array(stops), np.array(owner)
                rows, starts, stops, owner, at = [], [], [], [], 0
    if rows:
        yield np.concatenate(rows), np.array(starts), np.array(stops), np.array(owner)


@dataclass
class ToxicityModel:
    embed: np.ndarray                       # (PAD + 1, DIM), the last row 0
    kernels: list[np.ndarray]               # per width: (width, DIM, FILTERS)
    biases: list[np.ndarray]                # per width: (FILTERS,)
    out: np.ndarray                         # (len(WIDTHS) * FILTERS,)
    bias: float
    langs: list[str] = field(default_factory=list)
    lang_log_prob: np.ndarray | None = None  # (word rows, languages)
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.0
    slope: float = 1.0

    def _maps(self, seq: np.ndarray):
        x = self.embed[seq].sum(axis=1)
        for width, kernel, bias in zip(WIDTHS, self.kernels, self.biases):
            n = len(x) - width + 1
            z = np.broadcast_to(bias, (n, FILTERS)).copy()
            for k in range(width):
                z += x[k:k + n] @ kernel[k]
            yield z

    def pooled(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Greatest response of every filter in every text, at least 0."""
        pooled = np.zeros((len(first) - 1, len(WIDTHS) * FILTERS), np.float32)
        for seq, starts, stops, owner in _padded(ids, first):
            edges = np.stack([starts, stops], axis=1).ravel()
            for j, z in enumerate(self._maps(seq)):
                best = np.maximum.reduceat(z, edges[edges < len(z)], axis=0)[::2]
                np.maximum.at(pooled, (owner[:, None], np.arange(j * FILTERS, (j + 1) * FILTERS)), best)
        return pooled

    def logits(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(ids, first) @ self.out + self.bias

    def language(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Index of the likeliest language of every text by its words, -1 without words or languages."""
        best = np.full(len(first) - 1, -1)
        if self.langs:
            full = np.flatnonzero(np.diff(first))
            if len(full):
                sums = np.add.reduceat(self.lang_log_prob[ids[:, 0]], first[full], axis=0, dtype=np.float64)
                best[full] = sums.argmax(axis=1)
        return best

    def scores(self, ids: np.ndarray, first: np.ndarray, cut: float) -> np.ndarray:
        """Probability-like scores in which ``cut`` is the threshold of the text's own (predicted) language."""
        own = np.array([*[self.thresholds.get(lang, self.threshold) for lang in self.langs], self.threshold])
        z = (self.logits(ids, first) - own[self.language(ids, first)]) * self.slope + np.log(cut / (1 - cut))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class _Adam:
    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        for p, g, m, v in zip(self.params, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= scale * m / (np.sqrt(v) + 1e-8)


def start(seed: int = 5) -> ToxicityModel:
    """The model before its first epoch."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.05, (PAD + 1, DIM)).astype(np.float32)
    embed[PAD] = 0
    kernels = [rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    return ToxicityModel(embed, kernels, biases, rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32), 0.0)


def weights_of(model: ToxicityModel) -> np.ndarray:
    """All weights in a row."""
    return np.concatenate([p.ravel() for p in (model.embed, *model.kernels, *model.biases, model.out)] + [np.float32([model.bias])])


def with_weights(flat: np.ndarray) -> ToxicityModel:
    """The model of ``weights_of``."""
    shapes = [(PAD + 1, DIM), *[(w, DIM, FILTERS) for w in WIDTHS], *[(FILTERS,) for _ in WIDTHS], (len(WIDTHS) * FILTERS,), (1,)]
    parts = np.split(flat.astype(np.float32), np.cumsum([int(np.prod(s)) for s in shapes])[:-1])
    embed, *rest = [p.reshape(s) for p, s in zip(parts, shapes)]
    n = len(WIDTHS)
    return ToxicityModel(embed, rest[:n], rest[n:2 * n], rest[2 * n], float(rest[2 * n + 1][0]))


class Epoch:
    """One epoch of a task over its rows, minibatch by minibatch, from the shared weights."""

    def __init__(self, model: ToxicityModel, seed: list[int], batch: int = 32, rate: float = 0.01, decay: float = 1e-3, drop: float = 0.15):
        self.rng, self.batch, self.decay, self.drop, self.rows = np.random.default_rng(seed), batch, decay, drop, 0
        self.bias = np.array([model.bias], np.float32)
        self.params = [model.embed.copy(), *[k.copy() for k in model.kernels], *[b.copy() for b in model.biases], model.out.copy(), self.bias]
        self.adam = _Adam(self.params, rate)

    def add(self, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> None:
        """Train on texts given as word-id arrays, in a drawn order."""
        order = self.rng.permutation(len(texts))
        for lo in range(0, len(order), self.batch):
            chosen = order[lo:lo + self.batch]
            self._step([texts[i] for i in chosen], labels[chosen], weights[chosen])
        self.rows += len(texts)

    def weights(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params])

    def _step(self, texts, labels, weights) -> None:
        n = len(WIDTHS)
        embed, kernels, biases, out, bias = self.params[0], self.params[1:1 + n], self.params[1 + n:1 + 2 * n], self.params[-2], self.params[-1]
        reach = max(WIDTHS) - 1
        tail = np.full((reach, 3), PAD, np.int32)
        grads = [np.zeros_like(p) for p in self.params]
        # All texts of the batch in one padded sequence, of which PIECE_WORDS at a time are worked on.
        parts = [t if len(t) else np.full((1, 3), PAD, np.int32) for t in texts]
        seq = np.concatenate([x for part in parts for x in (part, tail)])
        seq = np.where(self.rng.random(len(seq))[:, None] < self.drop, PAD, seq)
        sizes = np.array([len(part) for part in parts])
        starts = np.concatenate([[0], np.cumsum(sizes + reach)[:-1]])
        stops = starts + sizes
        at, best = np.zeros((n, len(parts), FILTERS), np.int64), np.full((n, len(parts), FILTERS), -np.inf, np.float32)
        for lo in range(0, len(seq) - reach, PIECE_WORDS):
            hi = min(lo + PIECE_WORDS, len(seq) - reach)
            x = embed[seq[lo:hi + reach]].sum(axis=1)
            for j, (width, kernel, b) in enumerate(zip(WIDTHS, kernels, biases)):
                z = np.broadcast_to(b, (hi - lo, FILTERS)).copy()
                for k in range(width):
                    z += x[k:k + hi - lo] @ kernel[k]
                for i in range(int(np.searchsorted(stops, lo, side="right")), int(np.searchsorted(starts, hi))):
                    first = max(starts[i], lo)
                    own = z[first - lo:min(stops[i], hi) - lo]
                    top = own.argmax(axis=0)
                    value = own[top, np.arange(FILTERS)]
                    more = value > best[j, i]
                    best[j, i][more], at[j, i][more] = value[more], first + top[more]
        pooled = np.maximum(np.concatenate(list(best), axis=1), 0)
        p = 1 / (1 + np.exp(-np.clip(pooled @ out + bias[0], -60, 60)))
        g = ((p - labels) * weights / len(texts)).astype(np.float32)
        grads[-2] += g @ pooled
        grads[-1] += g.sum()
        back = g[:, None] * out * (pooled > 0)
        for j, (width, kernel) in enumerate(zip(WIDTHS, kernels)):
            own = back[:, j * FILTERS:(j + 1) * FILTERS]
            grads[1 + n + j] += own.sum(axis=0)
            for k in range(width):
                words = seq[at[j] + k]
                grads[1 + j][k] += np.einsum("bfd,bf->df", embed[words].sum(axis=2), own)
                dx = (own[:, :, None] * kernel[k].T[None]).reshape(-1, DIM)
                for c in range(3):
                    np.add.at(grads[0], words[..., c].ravel(), dx)
        grads[0][PAD] = 0
        for g, p in zip(grads[:1 + n], self.params):
            g += self.decay * p
        self.adam.step(grads)


def train(texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int = 12, seed: int = 5) -> ToxicityModel:
    """Fit on texts given as word-id arrays, as one task does."""
    model = start(seed)
    for number in range(epochs):
        epoch = Epoch(model, [seed, number])
        epoch.add(texts, np.asarray(labels, np.float32), np.asarray(weights, np.float32))
        model = with_weights(epoch.weights())
    return model


def fit_languages(model: ToxicityModel, counts: dict[str, np.ndarray]) -> None:
    """Word-level naive Bayes by which scoring picks the threshold; ``counts``: of the word rows, per language."""
    model.langs = sorted(counts)
    cells = np.full((ROWS[0], max(len(model.langs), 1)), 0.5)
    for i, lang in enumerate(model.langs):
        cells[:, i] += counts[lang]
    model.lang_log_prob = np.log(cells / cells.sum(axis=0)).astype(np.float32)


def _best_cut(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Middle of the widest gap among the cuts of the highest weighted F1."""
    order = np.argsort(-z)
    z, y, w = z[order], y[order], w[order]
    hit = np.cumsum(w * y)
    f1 = 2 * hit / (np.cumsum(w) + (w * y).sum())
    lower = np.append(z[1:], z[-1] - 1)
    best = np.flatnonzero((f1 >= f1.max() - 1e-9) & (lower < z))
    k = best[np.argmax((z - lower)[best])] if len(best) else int(f1.argmax())
    return float((z[k] + lower[k]) / 2)


def calibrate(model: ToxicityModel, lang: np.ndarray, z: np.ndarray, labels: np.ndarray, rows: np.ndarray, least: int = 20) -> None:
    """One threshold per predicted language; languages with under ``least`` texts of a class take the overall one.

    Texts are given as counts: ``rows`` of them have this language (its index), logit and label."""
    if not len(z) or labels.min() == labels.max():
        return
    model.threshold = _best_cut(z, labels, rows)
    for i, name in enumerate(model.langs):
        own = lang == i
        if min(rows[own & (labels == 1)].sum(), rows[own & (labels == 0)].sum()) >= least:
            model.thresholds[name] = _best_cut(z[own], labels[own], rows[own])
