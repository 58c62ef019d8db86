"""Logistic regression, folds, calibration and thresholds on bounded samples, with numpy only."""

from __future__ import annotations

import numpy as np


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class Rows:
    """A sparse 0/1 matrix: `columns` of row 0, row 1, ..., with the rows' ends."""

    def __init__(self, sets: list[np.ndarray], width: int):
        self.width, self.n = width, len(sets)
        self.column = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.n)

    def back(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, e[self.row], self.width)

    def only(self, rows: np.ndarray) -> "Rows":
        mask = np.zeros(self.n, bool)
        mask[rows] = True
        place = np.cumsum(mask) - 1
        out = Rows([], self.width)
        keep = mask[self.row]
        out.n, out.column, out.row = int(mask.sum()), self.column[keep], place[self.row[keep]]
        return out


def fit(dense: np.ndarray, y: np.ndarray, sparse: Rows | None = None, l2: float = 1e-3, rounds: int = 200, step: float = 0.1, start: np.ndarray | None = None):
    """(bias, dense weights, sparse weights) of a logistic regression, by Adam on the whole sample, from `start` (all of them) if given."""
    n, d = dense.shape
    k = sparse.width if sparse is not None else 0
    prior = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    w = np.zeros(1 + d + k)
    w[0] = np.log(prior / (1 - prior))
    if not n or y.min() == y.max():
        return w[0], w[1 : 1 + d], w[1 + d :]
    if start is not None:
        w[:] = start
    m, v = np.zeros_like(w), np.zeros_like(w)
    kind = dense.dtype  # products stay in the matrix's own type: no copy of it
    across = np.ascontiguousarray(dense.T)
    for t in range(1, rounds + 1):
        z = w[0] + dense @ w[1 : 1 + d].astype(kind) + (sparse.times(w[1 + d :]) if k else 0)
        e = (sigmoid(z) - y) / n
        g = np.concatenate([[e.sum()], across @ e.astype(kind), sparse.back(e) if k else np.zeros(0)])
        g[1:] += l2 * w[1:]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[0], w[1 : 1 + d], w[1 + d :]


def platt(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) that turn held-out scores into calibrated log-odds; the slope is never negative."""
    if len(y) < 2 or y.min() == y.max():
        return 1.0, 0.0
    scale = float(np.std(scores)) or 1.0
    b, w, _ = fit((scores / scale)[:, None], y, l2=1e-4, rounds=400)
    return max(0.0, float(w[0]) / scale), float(b)


def best_threshold(p: np.ndarray, y: np.ndarray, recall: float = 1.0) -> float:
    """The probability from which on rows count as positive, in the middle of its gap: the best F score, recall counting so many times as much as precision."""
    if not len(y) or y.min() == y.max():
        return 2.0 if not len(y) or not y.max() else 0.0
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    score = (1 + recall**2) * hit / (np.arange(1, len(y) + 1) + recall**2 * y.sum())
    last = np.append(np.diff(p[order]) < 0, True)  # a threshold can't part equal scores
    at = int(np.argmax(np.where(last, score, -1)))
    above = p[order][at]
    below = p[order][at + 1] if at + 1 < len(p) else 0.0
    return float(sigmoid((logit(above) + logit(below)) / 2))
