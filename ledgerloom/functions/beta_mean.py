"""Means over a Beta distribution for many rows at once, by a fixed rule."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

# With p = 1 / (1 + exp(-y)) both factors of the density fall off exponentially in y, and sums over
# evenly spaced y err by about exp(-pi^2 / STEP). Below the range p is under 2e-24, above it 1 - p
# is under 2e-11.
STEP = 0.42
FIRST, LAST = -130, 60


def beta_mean(
    a: np.ndarray, b: np.ndarray, value: Callable[[float], np.ndarray], at_zero: np.ndarray, at_one: np.ndarray
) -> np.ndarray:
    """Mean of ``value(p)`` for p from Beta(a, b), from 191 terms whatever the parameters.

    ``value`` must be level at both ends, with the given limits; beyond the range the sums are
    geometric and added in closed form, so very small ``a`` or ``b`` do no harm.
    """
    mass, total = np.zeros(np.broadcast(a, b).shape), np.zeros(np.broadcast(a, b).shape)
    for node in range(FIRST, LAST + 1):
        y = node * STEP
        weight = np.exp(-a * np.log1p(np.exp(-y)) - b * np.log1p(np.exp(y)))
        mass += weight
        total += weight * value(1.0 / (1.0 + np.exp(-y)))
    below = np.exp(a * FIRST * STEP) / np.expm1(a * STEP)
    above = np.exp(-b * LAST * STEP) / np.expm1(b * STEP)
    return (total + below * at_zero + above * at_one) / (mass + below + above)
