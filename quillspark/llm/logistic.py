"""A small logistic regression on sparse hashed features, with Platt calibration. Fitted on the driver on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Sparse:
    """Rows of (feature, value): row i has the entries offsets[i]:offsets[i+1]."""

    features: np.ndarray
    values: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def dot(self, w: np.ndarray) -> np.ndarray:
        own = np.repeat(np.arange(len(self)), np.diff(self.offsets))
        return np.bincount(own, w[self.features] * self.values, len(self))

    def take(self, rows: np.ndarray) -> Sparse:
        sizes = np.diff(self.offsets)[rows]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.offsets[:-1][rows] - offsets[:-1], sizes) + np.arange(offsets[-1])
        return Sparse(self.features[at], self.values[at], offsets)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: Sparse) -> np.ndarray:
        return x.dot(self.weights) + self.bias

    def probability(self, x: Sparse) -> np.ndarray:
        return sigmoid(self.slope * self.margin(x) + self.shift)


def fit(x: Sparse, y: np.ndarray, dimensions: int, l2: float = 1e-4, steps: int = 400, rate: float = 0.3) -> Model:
    """Adam on the whole sample; the same sample gives the same model."""
    w, b = np.zeros(dimensions), 0.0
    own = np.repeat(np.arange(len(x)), np.diff(x.offsets))
    m, v, mb, vb = np.zeros(dimensions), np.zeros(dimensions), 0.0, 0.0
    for t in range(1, steps + 1):
        e = (sigmoid(np.bincount(own, w[x.features] * x.values, len(x)) + b) - y) / max(1, len(x))
        g = np.bincount(x.features, e[own] * x.values, dimensions) + l2 * w
        gb = e.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, c = 1 - 0.9**t, 1 - 0.99**t
        r = rate / (1 + 4 * t / steps)
        w -= r * (m / a) / (np.sqrt(v / c) + 1e-8)
        b -= r * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    return Model(w, b)


def calibrated(model: Model, x: Sparse, y: np.ndarray) -> Model:
    """Platt scaling on rows that the model was not fitted on, with the usual smoothed targets."""
    up, down = y.sum(), len(y) - y.sum()
    if not up or not down:
        return model
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    z = model.margin(x)
    scale = max(1e-6, np.abs(z).mean())
    one = Sparse(np.zeros(len(z), np.int64), z / scale, np.arange(len(z) + 1))
    platt = fit(one, target, 1, l2=1e-6, steps=600, rate=0.1)
    return Model(model.weights, model.bias, float(platt.weights[0] / scale), float(platt.bias))


def halves(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.random.default_rng(seed).permutation(n)
    return order[: n * 2 // 3], order[n * 2 // 3 :]
