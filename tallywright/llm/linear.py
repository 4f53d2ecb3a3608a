"""Logistic regression on hashed features, fitted on a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Rows whose products are held at once.
BLOCK_ROWS = 64


@dataclass
class Rows:
    """Sparse rows: the features and values of row i lie between bounds i and i + 1."""

    features: np.ndarray
    values: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        sizes = [len(features) for features, _ in rows]
        join = lambda at, kind: np.concatenate([np.asarray(r[at], kind) for r in rows]) if rows else np.empty(0, kind)
        return cls(join(0, np.int64), join(1, np.float64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))

    def blocks(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Some rows at a time: which, and the features, values and rows (from 0) of what they hold."""
        for start in range(0, len(self.bounds) - 1, BLOCK_ROWS):
            bounds = self.bounds[start : start + BLOCK_ROWS + 1]
            own = slice(bounds[0], bounds[-1])
            owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            yield slice(start, start + len(bounds) - 1), self.features[own], self.values[own], owner


@dataclass
class Linear:
    """Weights of hashed features, and a scale and shift that make scores probabilities."""

    weights: np.ndarray
    shift: float = 0.0
    scale: float = 1.0

    def margins(self, rows: Rows) -> np.ndarray:
        margins = np.zeros(len(rows.bounds) - 1)
        for at, features, values, owner in rows.blocks():
            margins[at] = np.bincount(owner, self.weights[features] * values, at.stop - at.start)
        return margins

    def probability(self, margin):
        return 1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -30, 30)))


def fit(rows: Rows, targets: np.ndarray, size: int, rounds: int = 80, penalty: float = 1e-5) -> Linear:
    """Weights that fit targets between 0 and 1, by accelerated gradient steps per feature scale."""
    count = max(len(targets), 1)
    energy = np.zeros(size)
    for _, features, values, _ in rows.blocks():
        np.add.at(energy, features, np.square(values, dtype=np.float64))
    energy /= count
    step = 1 / np.sqrt(energy + 1e-8)
    step[energy == 0] = 0
    weights, bias = np.zeros(size), 0.0
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for turn in range(1, rounds + 1):
        margin = Linear(weights).margins(rows) + bias
        wrong = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - targets) / count
        slope = np.zeros(size)
        for at, features, values, owner in rows.blocks():
            np.add.at(slope, features, wrong[at][owner] * values)
        slope += penalty * weights / np.maximum(step, 1e-9) ** 2 * (step > 0)
        whole = np.append(slope, wrong.sum())
        first = 0.9 * first + 0.1 * whole
        second = 0.98 * second + 0.02 * whole**2
        move = first / (1 - 0.9**turn) / (np.sqrt(second / (1 - 0.98**turn)) + 1e-9)
        rate = 0.3 * (1 - turn / (rounds + 1))
        weights -= rate * move[:-1] * np.minimum(step, 50) * 0.2
        bias -= rate * move[-1]
    return Linear(weights, bias)


def calibrated(margins: np.ndarray, targets: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve through margins, by Newton steps with a small prior."""
    scale, shift = 1.0, 0.0
    spread = max(float(margins.std()), 1e-9)
    x = margins / spread
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(scale * x + shift, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        slope = np.array([((p - targets) * x).sum() + 1e-2 * scale, (p - targets).sum() + 1e-2 * shift])
        curve = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        move = np.linalg.solve(curve, slope)
        largest = np.abs(move).max()
        move *= min(1, 4 / max(largest, 1e-12))
        scale, shift = scale - move[0], shift - move[1]
        if largest < 1e-6:
            break
    return scale / spread, shift


def fit_few(columns: np.ndarray, targets: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic weights of a few dense columns and a shift, by Newton steps."""
    count, width = columns.shape
    x = np.concatenate([columns, np.ones((count, 1))], axis=1)
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x = x / scale
    weights = np.zeros(width + 1)
    ridge = np.diag([penalty] * width + [1e-3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - targets) + ridge @ weights
        curve = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + ridge
        move = np.linalg.solve(curve, slope)
        move *= min(1, 5 / max(np.abs(move).max(), 1e-12))
        weights -= move
        if np.abs(move).max() < 1e-8:
            break
    weights = weights / scale
    return weights[:-1], float(weights[-1])
