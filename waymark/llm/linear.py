"""Logistic regression over hashed sparse features, fitted on the driver in numpy.

Both learners take a bounded sample of labelled rows (a parameter of the callers) as
flat arrays: feature numbers, values, and the bounds of each row.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]],
    size: int,
    alpha: float = 0.3,
    beta: float = 1.0,
    l1: float = 0.05,
    l2: float = 0.5,
    epochs: int = 3,
    updates: int = 20_000,
    seed: int = 7,
) -> tuple[np.ndarray, float]:
    """Follow-the-regularised-leader (proximal) with a learning rate per coordinate.

    `rows`: (unique feature numbers, values, label). Small samples are passed more often,
    up to `updates` updates. The bias is a feature without penalty. Returns weights and
    bias.
    """
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        w[np.abs(zi) <= l1] = 0.0
        return w

    def bias() -> float:
        return -z[size] / ((beta + np.sqrt(n[size])) / alpha)

    rng = np.random.default_rng(seed)
    for _ in range(max(epochs, updates // max(1, len(rows)))):
        for r in rng.permutation(len(rows)):
            idx, x, y = rows[r]
            w, b = weights(idx), bias()
            g = sigmoid(float(w @ x) + b) - y
            gx = g * x
            s = (np.sqrt(n[idx] + gx * gx) - np.sqrt(n[idx])) / alpha
            z[idx] += gx - s * w
            n[idx] += gx * gx
            z[size] += g - (np.sqrt(n[size] + g * g) - np.sqrt(n[size])) / alpha * b
            n[size] += g * g
    return weights(np.arange(size)).astype(np.float32), float(bias())


def counterfactual(
    bounds: np.ndarray,
    feats: np.ndarray,
    labels: np.ndarray,
    swaps: list[tuple[np.ndarray, np.ndarray]],
    size: int,
    penalty: float = 4.0,
    l1: float = 5e-4,
    l2: float = 1e-5,
    rate: float = 0.5,
    steps: int = 200,
) -> tuple[np.ndarray, float]:
    """Minimises log loss + l1 |w| + l2 |w|^2 + penalty x mean (w . (swapped - original))^2.

    Features are present or absent: row i has feats[bounds[i]:bounds[i + 1]]. `swaps`
    has, per counterfactual, the features that come and those that go. Proximal AdaGrad
    on the full batch. Returns weights and bias.
    """
    w, b = np.zeros(size), 0.0
    hist, hist_b = np.full(size, 1e-8), 1e-8
    owner = np.repeat(np.arange(len(labels)), np.diff(bounds))
    at = np.concatenate([np.concatenate([a, r]) for a, r in swaps]) if swaps else np.zeros(0, np.int64)
    sign = np.concatenate([np.concatenate([np.ones(len(a)), -np.ones(len(r))]) for a, r in swaps]) if swaps else np.zeros(0)
    swap = np.repeat(np.arange(len(swaps)), [len(a) + len(r) for a, r in swaps]) if swaps else np.zeros(0, np.int64)
    share = labels.mean() if len(labels) else 0.5
    weight = np.where(labels > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)) / max(1, len(labels))
    for _ in range(steps if len(labels) else 0):
        p = sigmoid(np.bincount(owner, w[feats], len(labels)) + b)
        err = (p - labels) * weight
        grad = np.bincount(feats, err[owner], size) + 2 * l2 * w
        if len(swaps):
            change = np.bincount(swap, w[at] * sign, len(swaps))
            grad += 2 * penalty / len(swaps) * np.bincount(at, change[swap] * sign, size)
        hist += grad * grad
        step = rate / np.sqrt(hist)
        w -= step * grad
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0.0)
        gb = err.sum()
        hist_b += gb * gb
        b -= rate * gb / np.sqrt(hist_b)
    return w, b
