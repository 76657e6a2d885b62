"""Minimising a smooth function of a few positive parameters, by its exact derivatives.

``evaluate`` gets a list of parameter vectors and returns value, slope and curvature at each.
Callers answer the whole list with one Spark aggregate, so a step costs one small job: the point
of a full step, or, where that is no better, a list of shorter steps at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

LOG_BOUND = 20.0
LONGEST_STEP = 2.0
SHORTER_STEPS = 0.5 ** np.arange(1, 9)


@dataclass(frozen=True)
class Shape:
    """A function at one point: value, gradient (n) and matrix of second derivatives (n x n)."""

    value: float
    slope: np.ndarray
    curve: np.ndarray

    def by_logs(self, at: np.ndarray) -> Shape:
        """The same as a function of the logarithms of the parameters."""
        slope = at * self.slope
        return Shape(self.value, slope, np.outer(at, at) * self.curve + np.diag(slope))


Evaluate = Callable[[Sequence[Sequence[float]]], Sequence[Shape]]


@dataclass(frozen=True)
class Minimum:
    parameters: tuple[float, ...]
    value: float
    gradient_norm: float
    steps: int
    #: The slope is within the tolerance and no parameter lies at the edge of the search.
    converged: bool
    #: The function curves up in every direction around.
    lowest: bool


def minimise_positive(
    evaluate: Evaluate,
    start: Sequence[float],
    max_steps: int = 80,
    tolerance: float = 1e-6,
) -> Minimum:
    """Newton's method on the logarithms of the parameters, made safe where not convex."""

    def shapes(points: Sequence[np.ndarray]) -> list[Shape]:
        at = [np.exp(np.clip(p, -LOG_BOUND, LOG_BOUND)) for p in points]
        return [s.by_logs(p) for s, p in zip(evaluate([tuple(map(float, p)) for p in at]), at, strict=True)]

    x = np.clip(np.log(np.asarray(start, dtype=float)), -LOG_BOUND, LOG_BOUND)
    here = shapes([x])[0]
    steps = 0
    while steps < max_steps and np.abs(here.slope).max() > tolerance:
        steps += 1
        strengths, axes = np.linalg.eigh(here.curve)
        step = -axes @ ((axes.T @ here.slope) / np.maximum(np.abs(strengths), 1e-10))
        step *= min(1.0, LONGEST_STEP / np.abs(step).max())
        ahead = shapes([x + step])[0]
        if ahead.value < here.value:
            x, here = x + step, ahead
            continue
        shorter = shapes([x + f * step for f in SHORTER_STEPS])
        found = [s.value if np.isfinite(s.value) else np.inf for s in shorter]
        best = int(np.argmin(found))
        if found[best] >= here.value:
            # As low as rounding lets it see; the flatter of the two ends.
            if ahead.value == here.value and np.abs(ahead.slope).max() < np.abs(here.slope).max():
                x, here = x + step, ahead
            break
        x, here = x + SHORTER_STEPS[best] * step, shorter[best]
    steepest = float(np.abs(here.slope).max())
    # Past the edge the function is flat for the search, which proves nothing.
    inside = bool(np.abs(x).max() < LOG_BOUND)
    lowest = bool(np.linalg.eigvalsh(here.curve).min() > -1e-9)
    found = tuple(float(v) for v in np.exp(np.clip(x, -LOG_BOUND, LOG_BOUND)))
    return Minimum(found, here.value, steepest, steps, inside and steepest <= tolerance, lowest)
