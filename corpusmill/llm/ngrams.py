"""Hashed word and character n-grams of texts, and logistic regression on them in NumPy.

A text's features are, for each of four families (words, pairs of words, three and four bytes), the shares of its
n-grams that fall into each bucket. A word that follows itself makes the pair feature "same", whatever the word.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import mapped, mix, slices, text_bytes, word_hashes, words

BUCKET_BITS = 17
DIMS = 4 << BUCKET_BITS
SCALE = 8.0
_SAME = np.uint64(0x5A4D)


def grams(texts: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """Of each family: the bucket of every n-gram in order, and each text's first one and end among them; the number of texts."""
    buf, starts = text_bytes(texts)
    n = len(starts) - 1
    begin, end, doc = words(buf, starts)
    h = word_hashes(buf, begin, end)
    low = np.searchsorted(doc, np.arange(n + 1))
    shift = np.uint64(64 - BUCKET_BITS)
    out = [((h >> shift).astype(np.int32), low[:-1], low[1:])]
    pair = mix(h[:-1] * np.uint64(3) + h[1:])
    pair[h[:-1] == h[1:]] = _SAME
    pairs = np.concatenate([(pair >> shift).astype(np.int32) if len(h) else np.zeros(0, np.int32), np.zeros(1, np.int32)])
    pairs[:-1][pair == _SAME] = 1
    out.append((pairs + (1 << BUCKET_BITS), low[:-1], np.maximum(low[1:] - 1, low[:-1])))
    wide = buf.astype(np.uint32)
    for family, size in ((2, 3), (3, 4)):
        v = np.zeros(len(buf), np.uint32)
        for i in range(size):
            v[: len(buf) - i] |= wide[i:] << np.uint32(8 * i)
        v = (v ^ v >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
        v = (v ^ v >> np.uint32(13)) * np.uint32(0x9E3779B1)
        last = np.maximum(starts[1:] - size, starts[:-1])  # less the line feed behind each text
        out.append(((v >> np.uint32(32 - BUCKET_BITS)).astype(np.int32) + (family << BUCKET_BITS), starts[:-1], last))
    return out, n


@dataclass
class Sparse:
    """Rows of (column, value), one after the other; row i's lie between ends[i] and ends[i + 1]. Eight bytes an entry."""

    ends: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.ends) - 1

    def take(self, rows: np.ndarray) -> Sparse:
        count = self.ends[rows + 1] - self.ends[rows]
        ends = np.concatenate(([0], np.cumsum(count)))
        at = np.repeat(self.ends[rows] - ends[:-1], count) + np.arange(ends[-1])
        return Sparse(ends, self.columns[at], self.values[at])

    def chunks(self, entries: int = 1 << 19) -> Iterator[tuple[int, int]]:
        """Stretches of rows with about so many entries."""
        at = 0
        while at < len(self):
            to = max(at + 1, int(np.searchsorted(self.ends, self.ends[at] + entries, "right")) - 1)
            yield at, to
            at = to

    def scores(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self))
        for a, b in self.chunks():
            low, high = self.ends[a], self.ends[b]
            some = np.flatnonzero(np.diff(self.ends[a : b + 1]))
            if len(some):
                out[a + some] = np.add.reduceat(self.values[low:high] * w[self.columns[low:high]], self.ends[a + some] - low)
        return out

    def gradient(self, d: np.ndarray, dims: int) -> np.ndarray:
        """The sum of the rows, each times its d."""
        out = np.zeros(dims)
        for a, b in self.chunks():
            low, high = self.ends[a], self.ends[b]
            out += np.bincount(self.columns[low:high], self.values[low:high] * np.repeat(d[a:b], np.diff(self.ends[a : b + 1])), dims)
        return out

    @staticmethod
    def stacked(parts: list[Sparse]) -> Sparse:
        """The parts' rows one after the other, in mapped files; the single one as it is."""
        if len(parts) == 1:
            return parts[0]
        sizes = np.concatenate([np.zeros(1, np.int64), *(np.diff(p.ends) for p in parts)])
        ends = np.cumsum(sizes)
        out = Sparse(ends, mapped(int(ends[-1]), np.int32), mapped(int(ends[-1]), np.float32))
        at = 0
        for p in parts:
            out.columns[at : at + len(p.columns)], out.values[at : at + len(p.columns)] = p.columns, p.values
            at += len(p.columns)
        return out


def pieces(texts: pa.Array, limit: int = 1 << 19) -> Iterator[pa.Array]:
    """The array in parts of at most so many bytes of text, each of one text at least."""
    for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", limit):
        yield part.column(0)


def matrix(texts: pa.Array) -> Sparse:
    """The features of each text; texts are taken a few at a time."""
    out = []
    for part in pieces(texts):
        families, n = grams(part)
        keys, counts = [], []
        for bucket, first, end in families:
            count = end - first
            of = np.repeat(np.arange(n), count)
            take = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
            keys.append(np.unique(of.astype(np.int64) * DIMS + bucket[take], return_counts=True))
            counts.append(count)
        key, times = (np.concatenate(x) for x in zip(*keys, strict=True))
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        row, column = key // DIMS, key % DIMS
        share = SCALE * times / np.stack(counts)[column >> BUCKET_BITS, row]
        out.append(Sparse(np.searchsorted(row, np.arange(n + 1)), column.astype(np.int32), share.astype(np.float32)))
    return Sparse.stacked(out)


def features(parts: Iterable[pa.Array]) -> Sparse:
    """matrix() of all parts' texts, one after the other, in mapped files: no more than a few texts are in memory."""
    ends = [np.zeros(1, np.int64)]
    with tempfile.TemporaryFile(prefix="corpusmill-") as columns, tempfile.TemporaryFile(prefix="corpusmill-") as values:
        for texts in parts:
            for x in map(matrix, pieces(texts)):
                columns.write(x.columns.data)
                values.write(x.values.data)
                ends.append(ends[-1][-1] + x.ends[1:])
        n = int(ends[-1][-1])
        columns.flush()
        values.flush()
        read = [np.asarray(np.memmap(f, kind, "r", shape=(n,))) if n else np.zeros(0, kind) for f, kind in ((columns, np.int32), (values, np.float32))]
    return Sparse(np.concatenate(ends), *read)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit_sparse(blocks: list[Sparse], y: np.ndarray, dims: int = DIMS, steps: int = 150, rate: float = 0.5, decay: float = 1e-6, start: tuple[np.ndarray, float] | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on the blocks' rows, by Adam on all of them; the classes count alike.

    Only the columns that the rows have are worked on. start: weights and bias to go on from.
    """
    share = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum()))
    x = Sparse.stacked(blocks)
    used = np.zeros(dims, bool)
    for a, b in x.chunks():
        used[x.columns[x.ends[a] : x.ends[b]]] = True
    used = np.flatnonzero(used)
    place = np.zeros(dims, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    columns = mapped(len(x.columns), np.int32)
    for a, b in x.chunks():
        columns[x.ends[a] : x.ends[b]] = place[x.columns[x.ends[a] : x.ends[b]]]
    x = Sparse(x.ends, columns, x.values)
    whole, bias = (np.zeros(dims), np.zeros(3)) if start is None else (start[0].astype(np.float64), np.array([start[1], 0.0, 0.0]))
    w, m, v = whole[used], np.zeros(len(used)), np.zeros(len(used))
    for t in range(1, steps + 1):
        z = x.scores(w) + bias[0]
        d = share * (sigmoid(z) - y)
        g = decay * w + x.gradient(d, len(used))
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        bias[1] += 0.1 * (d.sum() - bias[1])
        bias[2] += 0.01 * (d.sum() ** 2 - bias[2])
        first, second = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (m / first) / (np.sqrt(v / second) + 1e-7)
        bias[0] -= rate * (bias[1] / first) / (np.sqrt(bias[2] / second) + 1e-7)
    whole[used] = w
    return whole, float(bias[0])


def fit_dense(x: np.ndarray, y: np.ndarray, decay: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights (the last is the bias) of a small logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    damp = decay * np.eye(len(w))
    damp[-1, -1] = 1e-9
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + damp
        step = np.linalg.solve(h, x.T @ (y - p) - damp @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) so that sigmoid(a z + b) are probabilities: Platt's scaling with his smoothed targets."""
    good, bad = (y > 0.5).sum(), (y <= 0.5).sum()
    scale = max(1e-9, float(np.abs(z).max(initial=0)))
    w = fit_dense((z / scale)[:, None], np.where(y > 0.5, (good + 1) / (good + 2), 1 / (bad + 2)), decay=1e-3)
    return float(w[0] / scale), float(w[1])


@dataclass
class TextModel:
    """A linear score of a text's features, and its calibration."""

    weights: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0

    def score(self, texts: pa.Array) -> np.ndarray:
        return np.concatenate([np.zeros(0), *map(self._score, pieces(texts))])

    def _score(self, texts: pa.Array) -> np.ndarray:
        families, n = grams(texts)
        z = np.full(n, self.bias)
        for bucket, first, end in families:
            # sums of each text by itself: they don't depend on what lies beside it
            at = np.stack([first, end], axis=1).ravel()
            sums = np.add.reduceat(np.append(self.weights[bucket], np.float32(0)), at, dtype=np.float64)[::2] if n else np.zeros(0)
            z += SCALE * np.where(end > first, sums, 0) / np.maximum(end - first, 1)
        return z

    def probability(self, texts: pa.Array) -> np.ndarray:
        return sigmoid(self.a * self.score(texts) + self.b)
