"""Logistic regression on sparse rows and probability calibration, in numpy, for bounded training samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


#: Pairs of a sparse sample that are worked on at once.
RUN = 1 << 19


def joined(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of four bytes in a column's binary values, all in one array, and where each value's begin, and the end."""
    one = pa.concat_arrays(column.chunks or [pa.array([], column.type)]).cast(pa.large_binary())
    bounds = np.frombuffer(one.buffers()[1], np.int64)[one.offset : one.offset + len(one) + 1] // 4 if len(one) else np.zeros(1, np.int64)
    return (np.frombuffer(one.buffers()[2], kind)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, kind)), bounds - bounds[0]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


class Sparse:
    """Rows of (index, value) pairs; at: where each row begins, and the end."""

    def __init__(self, index: np.ndarray, value: np.ndarray, at: np.ndarray):
        self.index, self.value, self.at = index.astype(np.int32, copy=False), value.astype(np.float32, copy=False), at
        self.row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))

    def __len__(self) -> int:
        return len(self.at) - 1

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self))
        for p, q in self.runs():
            at = slice(self.at[p], self.at[q])
            out[p:q] = np.bincount(self.row[at] - p, self.value[at] * w[self.index[at]], q - p)
        return out

    def runs(self) -> Iterator[tuple[int, int]]:
        """Rows that have some RUN pairs together: the first, and the one after the last."""
        cuts = np.unique(np.concatenate((np.searchsorted(self.at, np.arange(0, self.at[-1], RUN)), [len(self)])))
        return zip(cuts, cuts[1:], strict=False)

    @staticmethod
    def join(parts: list[Sparse]) -> Sparse:
        many = np.concatenate([np.diff(p.at) for p in parts]) if parts else np.zeros(0, np.int64)
        index = np.concatenate([p.index for p in parts]) if parts else np.zeros(0, np.int32)
        value = np.concatenate([p.value for p in parts]) if parts else np.zeros(0, np.float32)
        return Sparse(index, value, np.concatenate(([0], np.cumsum(many))).astype(np.int64))

    def packed(self) -> list[tuple[bytes, bytes]]:
        """Of each row its indices and values as bytes."""
        return [(self.index[a:b].tobytes(), self.value[a:b].tobytes()) for a, b in zip(self.at, self.at[1:], strict=False)]

    @staticmethod
    def unpacked(index: pa.ChunkedArray, value: pa.ChunkedArray) -> Sparse:
        """Of the two columns of packed rows."""
        (index, at), (value, _) = joined(index, np.int32), joined(value, np.float32)
        return Sparse(index, value, at)

    def take(self, rows: np.ndarray) -> Sparse:
        many = np.diff(self.at)[rows]
        at = np.concatenate(([0], np.cumsum(many)))
        place = np.arange(at[-1]) - np.repeat(at[:-1], many) + np.repeat(self.at[:-1][rows], many)
        return Sparse(self.index[place], self.value[place], at)


def fit(x: Sparse, y: np.ndarray, size: int, l2: float = 1e-4, steps: int = 80, rate: float = 0.3, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias, by Adam over the whole sample, read in runs of rows; rows of weight 0 are left out.

    Without rows of both classes: no weights and the smoothed log odds.
    """
    weight = np.ones(len(y)) if weight is None else weight
    on = weight > 0
    odds = np.log(((y * weight)[on].sum() + 1) / (((1 - y) * weight)[on].sum() + 1))
    w, b = np.zeros(size, np.float64), float(odds)
    if not on.any() or y[on].min() == y[on].max():
        return w, b
    share = np.where(on, weight, 0) / weight[on].sum()
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        g, gb = l2 * w, 0.0
        for p, q in x.runs():
            at = slice(x.at[p], x.at[q])
            row = x.row[at] - p
            error = (sigmoid(np.bincount(row, x.value[at] * w[x.index[at]], q - p) + b) - np.where(on[p:q], y[p:q], 0)) * share[p:q]
            g += np.bincount(x.index[at], x.value[at] * error[row], size)
            gb += error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, b


def calibrate(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Platt scaling: a, b so that sigmoid(a * z + b) is a probability; Newton steps on smoothed targets."""
    if len(y) == 0 or y.min() == y.max():
        return 1.0, 0.0
    n1, n0 = y.sum(), (1 - y).sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([z, np.ones_like(z)], 1)
    return tuple(newton(x, goal, np.array([1.0, 0.0]), steps))


def newton(x: np.ndarray, goal: np.ndarray, start: np.ndarray, steps: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Dense logistic regression, a few columns, towards start."""
    w = start.astype(float).copy()
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - goal) + ridge * (w - start))
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w
