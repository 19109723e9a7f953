"""Sparse multinomial logistic regression by follow-the-regularised-leader
with elastic-net penalties (McMahan et al., 2013), and calibration.

Used on bounded samples; examples are rows of a compressed sparse matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """Examples ``i`` = features ``idx[ptr[i]:ptr[i+1]]`` with values ``val``."""

    ptr: np.ndarray
    idx: np.ndarray
    val: np.ndarray

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.ptr[i], self.ptr[i + 1]
        return self.idx[a:b], self.val[a:b]

    def take(self, which) -> Rows:
        parts = [self.row(int(i)) for i in which]
        return rows_of([p[0] for p in parts], [p[1] for p in parts])


def rows_of(idx: list[np.ndarray], val: list[np.ndarray]) -> Rows:
    ptr = np.concatenate(([0], np.cumsum([len(x) for x in idx]))).astype(np.int64)
    return Rows(ptr, np.concatenate([np.zeros(0, np.int64), *idx]), np.concatenate([np.zeros(0), *val]))


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """One weight per feature and class; per-coordinate learning rates."""

    def __init__(self, features: int, classes: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 1.0,
                 l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((features, classes))
        self.n = np.zeros((features, classes))

    def weights(self, idx=slice(None)) -> np.ndarray:
        z, n = self.z[idx], self.n[idx]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, rows: Rows, labels: np.ndarray, epochs: int, seed: int = 7, which=None) -> Ftrl:
        """Learn the rows (or those of the indices ``which``); ``labels`` has
        one entry for every row."""
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows) if which is None else which).tolist():
                idx, val = rows.row(i)
                w = self.weights(idx)
                p = softmax(val @ w)
                p[labels[i]] -= 1.0
                g = val[:, None] * p[None, :]
                n = self.n[idx]
                self.z[idx] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
                self.n[idx] = n + g * g
        return self


def scores(rows: Rows, weights: np.ndarray, which=None) -> np.ndarray:
    which = range(len(rows)) if which is None else which
    out = np.zeros((len(which), weights.shape[1]))
    for n, i in enumerate(which):
        idx, val = rows.row(int(i))
        out[n] = val @ weights[idx]
    return out


def temperature(s: np.ndarray, labels: np.ndarray) -> float:
    """The scale that minimises the negative log likelihood of ``s / T``
    (golden section on log T)."""
    if not len(s):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(s / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(s)), labels], 1e-12)).mean()

    lo, hi, g = np.log(0.05), np.log(20.0), (5 ** 0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights and, last, the intercept of a small dense logistic regression
    (Newton steps)."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
