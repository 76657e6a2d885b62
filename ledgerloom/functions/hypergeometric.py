"""Gauss's hypergeometric series for many rows at once."""

from __future__ import annotations

import math

import numpy as np

LEAST_TERMS = 8


def hyp2f1_series(
    a: np.ndarray, b: np.ndarray, c: np.ndarray, z: np.ndarray, tolerance: float = 1e-11
) -> np.ndarray:
    """2F1(a, b; c; z) for 0 <= z < 1.

    Made for parameters whose terms shrink at least as fast as the powers of z. All rows take as
    many terms as the largest z needs to fall below ``tolerance``.
    """
    largest = float(np.max(z, initial=0.0))
    terms = LEAST_TERMS + (math.ceil(math.log(tolerance) / math.log(largest)) if largest > 0 else 0)
    term = np.ones(np.broadcast(a, b, c, z).shape)
    total = term.copy()
    for n in range(terms):
        term *= (a + n) * (b + n) / ((c + n) * (n + 1.0)) * z
        total += term
    return total
