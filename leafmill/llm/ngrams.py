"""Hashed character n-grams and the linear fits over them (numpy, inside tasks)."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np


def hashed(text: str, orders: Sequence[int], bits: int) -> np.ndarray:
    """Bucket numbers of all character n-grams of the lower-cased text, in any order, repeats included."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    h, out = c * np.uint32(2654435761), []
    for n in range(1, max(orders) + 1):
        if n > 1:
            if len(c) < n:
                break
            h = h[:-1]
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) + c[n - 1 :] * np.uint32(0x85EBCA77)
        if n in orders:
            out.append((h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def present(buckets: np.ndarray, bits: int) -> np.ndarray:
    """The distinct buckets, ascending."""
    seen = np.zeros(1 << bits, bool)
    seen[buckets] = True
    return np.flatnonzero(seen).astype(np.int32)


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 60, kept: int = 8) -> np.ndarray:
    """Limited-memory BFGS with backtracking; ``loss`` gives value and gradient."""
    pairs: deque = deque(maxlen=kept)
    f, g = loss(x)
    for _ in range(steps):
        q, used = g.copy(), []
        for s, y, rho in reversed(pairs):
            used.append(a := rho * (s @ q))
            q -= a * y
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(np.linalg.norm(g), 1e-12)
        for (s, y, rho), a in zip(pairs, reversed(used)):
            q += s * (a - rho * (y @ q))
        slope, size = -(g @ q), 1.0
        for _ in range(30):
            fn, gn = loss(x - size * q)
            if fn <= f + 1e-4 * size * slope:
                break
            size /= 2
        s, y = -size * q, gn - g
        if s @ y > 1e-10:
            pairs.append((s, y, 1 / (s @ y)))
        small = abs(f - fn) <= 1e-6 * abs(f)
        x, f, g = x + s, fn, gn
        if small:
            break
    return x


class Rows:
    """Sparse rows: bucket numbers and values, one stretch a row.

    Products go through ``CHUNK`` entries at a time, so that nothing beside the entries themselves (8 bytes each) grows with their number.
    """

    CHUNK = 1 << 20

    def __init__(self, buckets: list[np.ndarray], values: list[np.ndarray], width: int) -> None:
        self.width, self.n = width, len(buckets)
        self.lengths = np.array([len(b) for b in buckets], np.int64)
        self.at = np.empty(int(self.lengths.sum()), np.int32)
        self.values = np.empty(len(self.at), np.float32)
        end = 0
        for b, v in zip(buckets, values):
            self.at[end : end + len(b)], self.values[end : end + len(b)] = b, v
            end += len(b)
        self.ends = np.cumsum(self.lengths)

    def chunks(self) -> Iterator[tuple[slice, int, np.ndarray]]:
        """Stretches of entries, the row of the first and how far beyond it the row of each lies."""
        for start in range(0, len(self.at), self.CHUNK):
            stop = min(start + self.CHUNK, len(self.at))
            first, last = np.searchsorted(self.ends, [start, stop - 1], side="right")
            edges = np.clip(np.append(self.ends[first:last], stop), start, stop)
            yield slice(start, stop), int(first), np.repeat(np.arange(last - first + 1, dtype=np.int32), np.diff(edges, prepend=start))

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for part, first, beyond in self.chunks():
            found = np.bincount(beyond, weights=self.values[part] * w[self.at[part]])
            out[first : first + len(found)] += found
        return out

    def transposed_times(self, d: np.ndarray) -> np.ndarray:
        out, d = np.zeros(self.width), d.astype(np.float32)
        for part, first, beyond in self.chunks():
            out += np.bincount(self.at[part], weights=self.values[part] * d[first:][beyond], minlength=self.width)
        return out


def logistic(rows: Rows, y: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression: (weights, intercept)."""

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.clip(rows.times(x[:-1]) + x[-1], -30, 30)
        p = 1 / (1 + np.exp(-z))
        d = p - y
        return float(np.sum(np.log1p(np.exp(z)) - y * z) + 0.5 * penalty * (x[:-1] @ x[:-1])), np.append(rows.transposed_times(d) + penalty * x[:-1], d.sum())

    x = minimise(loss, np.zeros(rows.width + 1))
    return x[:-1], float(x[-1])


def svm(rows: Rows, y: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, classes balanced; y is -1 or 1."""
    weight = np.where(y > 0, 0.5 / max(1, np.sum(y > 0)), 0.5 / max(1, np.sum(y < 0))) * len(y)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        short = np.maximum(0, 1 - y * (rows.times(x[:-1]) + x[-1]))
        d = -2 * weight * y * short
        return float(np.sum(weight * short * short) + 0.5 * penalty * (x[:-1] @ x[:-1])), np.append(rows.transposed_times(d) + penalty * x[:-1], d.sum())

    x = minimise(loss, np.zeros(rows.width + 1))
    return x[:-1], float(x[-1])
