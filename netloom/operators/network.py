"""A small classifier n -> 64 -> 32 -> 1 in numpy, for training and scoring inside tasks."""

from __future__ import annotations

import numpy as np

LAYERS = (64, 32, 1)
RATE, BATCH = 5e-4, 64


def start(inputs: int, seed: int = 0) -> list[np.ndarray]:
    """Seeded weights and biases in the order W1, b1, W2, b2, W3, b3 (W: outputs by inputs)."""
    rng, out, n = np.random.default_rng(seed), [], inputs
    for m in LAYERS:
        edge = 1 / np.sqrt(n)
        out += [rng.uniform(-edge, edge, (m, n)), rng.uniform(-edge, edge, m)]
        n = m
    return out


def loss_of(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Binary cross-entropy of logits."""
    return np.logaddexp(0, z) - y * z


def logits(p: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    kept = [x]
    for w, b in zip(p[:-2:2], p[1:-2:2], strict=True):
        x = np.maximum(x @ w.T + b, 0)
        kept.append(x)
    return (x @ p[-2].T + p[-1])[:, 0], kept


def probability(p: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits(p, x)[0], -500, 500)))


class Training:
    """One pass of Adam over mini-batches with binary cross-entropy on logits."""

    def __init__(self, p: list[np.ndarray], rate: float = RATE):
        self.p, self.rate, self.step = [w.copy() for w in p], rate, 0
        self.m, self.v = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p]
        self.loss, self.rows = 0.0, 0

    def update(self, x: np.ndarray, y: np.ndarray) -> None:
        z, kept = logits(self.p, x)
        self.loss += float(loss_of(z, y).sum())
        self.rows += len(y)
        slope = ((1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / len(y))[:, None]
        gradients: list[np.ndarray] = []
        for k in range(len(kept) - 1, -1, -1):
            gradients = [slope.T @ kept[k], slope.sum(0), *gradients]
            if k:
                slope = (slope @ self.p[2 * k]) * (kept[k] > 0)
        self.step += 1
        for i, g in enumerate(gradients):
            self.m[i] += 0.1 * (g - self.m[i])
            self.v[i] += 0.001 * (g * g - self.v[i])
            self.p[i] -= self.rate * (self.m[i] / (1 - 0.9**self.step)) / (np.sqrt(self.v[i] / (1 - 0.999**self.step)) + 1e-8)


def flat(p: list[np.ndarray]) -> list[tuple[int, int, float]]:
    """(layer, pos, w) of every weight."""
    return [(i, j, float(w)) for i, a in enumerate(p) for j, w in enumerate(a.ravel())]


def unflat(rows: list[tuple[int, int, float]], inputs: int) -> list[np.ndarray]:
    out = start(inputs)
    for i, j, w in rows:
        out[i].ravel()[j] = w
    return out
