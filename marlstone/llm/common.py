"""What the corpus operators share: scratch tables, row prefixes, small fits.

Operators read the columns they name and ignore all others, so further columns
of the input can't clash with their own. A null text counts as empty.
"""

from __future__ import annotations

import numpy as np

from marlstone.sources.scratch import materialise, scratch_dir

__all__ = ["logistic_fit", "materialise", "scratch_dir", "sigmoid"]


def logistic_fit(x: np.ndarray, y: np.ndarray, l2: float = 1.0, weight: np.ndarray | None = None, prior: np.ndarray | None = None, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the intercept) of an L2-penalised logistic regression by Newton's method.

    x is a bounded sample with few columns. ``prior`` are weights to shrink to, 0 if none.
    """
    xs = np.hstack([x, np.ones((len(x), 1))])
    centre = np.zeros(xs.shape[1]) if prior is None else prior
    beta = centre.copy()
    s = np.ones(len(y)) if weight is None else weight
    ridge = np.full(xs.shape[1], l2)
    if prior is None:
        ridge[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(xs @ beta)
        grad = xs.T @ (s * (p - y)) + ridge * (beta - centre)
        hess = (xs * (s * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ xs + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        size = np.abs(step).max()
        beta = beta - step * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return beta


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
