"""Linear and factorization-machine scorers over hashed features.

Training runs on a bounded sample of rows in one process (both scorers state
their bound); scoring runs wherever the rows are.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np


def bucket(term: str, bits: int) -> int:
    return zlib.crc32(term.encode()) & ((1 << bits) - 1)


@dataclass
class Machine:
    """bias + sum of weights + half of (squared sum less sum of squares) of the factors."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray  # [features, k]; k may be 0

    def margins(self, starts: np.ndarray, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Margins of rows whose features are `ids[starts[i]:starts[i + 1]]`."""
        rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        n = len(starts) - 1
        out = self.bias + np.bincount(rows, self.weights[ids] * values, n)
        for f in range(self.factors.shape[1]):
            xv = self.factors[ids, f] * values
            out += 0.5 * (np.bincount(rows, xv, n) ** 2 - np.bincount(rows, xv * xv, n))
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(starts: np.ndarray, ids: np.ndarray, values: np.ndarray, target: np.ndarray, size: int, k: int, *, epochs: int = 8, rate: float = 0.1, l1: float = 0.0, l2: float = 1e-5, least_rows: int = 3, batch: int = 128, seed: int = 11, start: Machine | None = None) -> Machine:
    """Logistic loss against targets in [0, 1], by AdaGrad over shuffled batches.

    `l1` shrinks weights step by step (truncated gradient), so terms of no use
    end at zero. Features of fewer than `least_rows` training rows stay at zero.
    With `start`, training goes on from its bias and weights, and factors are
    learned for the features whose weight is not zero there: only terms of some
    use alone can be of use in pairs, which keeps rare terms from being learned
    by heart.
    """
    rng = np.random.default_rng(seed)
    common = np.bincount(ids, minlength=size) >= least_rows
    weights = np.zeros(size) if start is None else start.weights.copy()
    if start is not None:
        common &= start.weights != 0
    factors = np.where(common[:, None], rng.normal(0, 0.01, (size, k)), 0.0)
    rate_at = np.clip(target.mean(), 1e-3, 1 - 1e-3) if len(target) else 0.5
    bias, bias_sum = float(np.log(rate_at / (1 - rate_at))) if start is None else start.bias, 1.0
    weight_sum, factor_sum = np.full(size, 1e-2), np.full((size, k), 1e-2)
    rows = len(starts) - 1
    for _ in range(epochs):
        order = rng.permutation(rows)
        for lo in range(0, rows, batch):
            part = order[lo : lo + batch]
            lengths = starts[part + 1] - starts[part]
            at = np.repeat(starts[part] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            row, idx, val = np.repeat(np.arange(len(part)), lengths), ids[at], values[at]
            seen = common[idx]
            row, idx, val = row[seen], idx[seen], val[seen]
            used, local = np.unique(idx, return_inverse=True)
            margin = bias + np.bincount(row, weights[idx] * val, len(part))
            xv = factors[idx] * val[:, None]
            sums = np.stack([np.bincount(row, xv[:, f], len(part)) for f in range(k)], axis=1) if k else np.zeros((len(part), 0))
            if k:
                squares = np.stack([np.bincount(row, xv[:, f] ** 2, len(part)) for f in range(k)], axis=1)
                margin += 0.5 * (sums**2 - squares).sum(axis=1)
            error = sigmoid(margin) - target[part]
            g = error.mean()
            bias_sum += g * g
            bias -= rate * g / bias_sum**0.5
            push = error[row] * val / len(part)
            grad = np.bincount(local, push, len(used)) + l2 * weights[used]
            weight_sum[used] += grad * grad
            step = rate / np.sqrt(weight_sum[used])
            moved = weights[used] - step * grad
            weights[used] = np.sign(moved) * np.maximum(0, np.abs(moved) - step * l1)
            for f in range(k):
                slope = push * (sums[row, f] - xv[:, f])
                grad = np.bincount(local, slope, len(used)) + 10 * l2 * factors[used, f]
                factor_sum[used, f] += grad * grad
                factors[used, f] -= rate / np.sqrt(factor_sum[used, f]) * grad
    return Machine(bias, weights, factors)
