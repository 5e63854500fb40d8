"""Decisions: zero-sum games over arms and mechanisms, likelihood-ratio weights, tails."""

from __future__ import annotations

import math

import numpy as np


def solve_game(payoff: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Value and optimal mixes of a zero-sum game (rows maximise), by the simplex method with Bland's rule."""
    a = np.asarray(payoff, float)
    shift = 1 - a.min()
    a = a + shift
    m, n = a.shape
    t = np.zeros((m + 1, n + m + 1))  # max sum y, a y <= 1
    t[:m, :n], t[:m, n : n + m], t[:m, -1] = a, np.eye(m), 1
    t[m, :n] = -1
    basis = list(range(n, n + m))
    for _ in range(10_000):
        enter = next((j for j in range(n + m) if t[m, j] < -1e-12), None)
        if enter is None:
            break
        ratios = [(t[i, -1] / t[i, enter], basis[i], i) for i in range(m) if t[i, enter] > 1e-12]
        _, _, leave = min(ratios)
        t[leave] /= t[leave, enter]
        for i in range(m + 1):
            if i != leave:
                t[i] -= t[i, enter] * t[leave]
        basis[leave] = enter
    y = np.zeros(n + m)
    for i, j in enumerate(basis):
        y[j] = t[i, -1]
    total = t[m, -1]
    return 1 / total - shift, t[m, n : n + m] / total, y[:n] / total


def competitive_ratio(payoff: np.ndarray) -> tuple[float, np.ndarray]:
    """The largest share of each column's best that one mix of rows keeps in every column; columns without payoff are left out."""
    best = payoff.max(axis=0)
    value, mix, _ = solve_game(payoff[:, best > 0] / best[best > 0])
    return value, mix
