"""Boosted trees and logistic weights for small samples on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Node:
    """A leaf (feature < 0) or a test ``x[feature] <= threshold``."""

    value: float
    feature: int = -1
    threshold: float = 0.0
    left: "Node | None" = None
    right: "Node | None" = None


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def cut_points(x: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds between the quantiles of one feature."""
    q = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)
    return q[q < x.max()] if len(x) else q


def _grow(codes, cuts, grad, hess, rows, depth, min_rows, ridge):
    g, h = grad[rows].sum(), hess[rows].sum()
    value = float(-g / (h + ridge))
    if depth == 0 or len(rows) < 2 * min_rows:
        return Node(value)
    best = (1e-6, -1, 0)
    for f, cut in enumerate(cuts):
        if not len(cut):
            continue
        code = codes[rows, f]
        size = len(cut) + 1
        gs = np.cumsum(np.bincount(code, grad[rows], size))[:-1]
        hs = np.cumsum(np.bincount(code, hess[rows], size))[:-1]
        n = np.cumsum(np.bincount(code, minlength=size))[:-1]
        gain = gs**2 / (hs + ridge) + (g - gs)**2 / (h - hs + ridge) - g**2 / (h + ridge)
        gain[(n < min_rows) | (len(rows) - n < min_rows)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), f, k)
    _, f, k = best
    if f < 0:
        return Node(value)
    low = codes[rows, f] <= k
    grown = [_grow(codes, cuts, grad, hess, part, depth - 1, min_rows, ridge)
             for part in (rows[low], rows[~low])]
    return Node(value, f, float(cuts[f][k]), *grown)


def boost(x: np.ndarray, y: np.ndarray, *, rounds: int = 30, depth: int = 3, rate: float = 0.3,
          bins: int = 32, min_rows: int = 10, ridge: float = 1.0, part: float = 0.7,
          seed: int = 7, weight: np.ndarray | None = None) -> tuple[float, list[Node]]:
    """Base log odds and trees whose sum times ``rate`` is in their values already; rows count by
    ``weight``, scaled to a mean of one."""
    w = np.ones(len(y)) if weight is None else weight * (len(y) / weight.sum())
    positive = float((w * y).sum())
    base = float(np.log((positive + 1) / (len(y) - positive + 1)))
    cuts = [cut_points(x[:, f], bins) for f in range(x.shape[1])]
    codes = np.empty(x.shape, np.uint8, order="F")
    for f, c in enumerate(cuts):
        codes[:, f] = np.searchsorted(c, x[:, f], side="left")
    rng, z, trees = np.random.default_rng(seed), np.full(len(y), base), []
    for _ in range(rounds):
        p = sigmoid(z)
        rows = np.flatnonzero(rng.random(len(y)) < part)
        tree = _scale(_grow(codes, cuts, w * (p - y), w * p * (1 - p), rows, depth, min_rows, ridge), rate)
        trees.append(tree)
        z += evaluate(tree, x)
    return base, trees


def _scale(node: Node, rate: float) -> Node:
    if node.feature < 0:
        return Node(node.value * rate)
    return Node(node.value * rate, node.feature, node.threshold,
                _scale(node.left, rate), _scale(node.right, rate))


def evaluate(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    low = x[:, node.feature] <= node.threshold
    out = np.empty(len(x))
    out[low], out[~low] = evaluate(node.left, x[low]), evaluate(node.right, x[~low])
    return out


def predict(model: tuple[float, list[Node]], x: np.ndarray) -> np.ndarray:
    base, trees = model
    z = np.full(len(x), base)
    for tree in trees:
        z += evaluate(tree, x)
    return sigmoid(z)


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3,
                   steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of least mean logistic loss plus ``penalty`` times their sum of sizes."""
    n, d = x.shape
    w, b = np.zeros(d), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    # A bound on the curvature: a quarter of the largest eigenvalue of the Gram matrix.
    gram = np.concatenate((x, np.ones((n, 1))), axis=1)
    step = 4.0 / max(np.linalg.eigvalsh(gram.T @ gram / n)[-1], 1e-9)
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = sigmoid(x @ vw + vb) - y
        nw = vw - step * (x.T @ r) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = vb - step * r.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return b, w


def ridge_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0,
                   steps: int = 60) -> np.ndarray:
    """Weights near ``prior`` (the last one an intercept) by damped Newton steps."""
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    w = prior.astype(float).copy()
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (p - y) + strength * (w - prior)
        h = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(x.shape[1])
        move = np.linalg.solve(h, g)
        w -= move / max(1.0, np.abs(move).max())
        if np.abs(move).max() < 1e-6:
            break
    return w
