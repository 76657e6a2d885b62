"""First and second derivative of the logarithm of the gamma function, for positive numbers."""

from __future__ import annotations

import math

# Below this the recurrence is used; above it the asymptotic series is exact to double precision.
_FAR = 12.0


def digamma(x: float) -> float:
    shift = 0.0
    while x < _FAR:
        shift -= 1.0 / x
        x += 1.0
    u = 1.0 / (x * x)
    series = u * (1 / 12 - u * (1 / 120 - u * (1 / 252 - u * (1 / 240 - u * (1 / 132 - u * 691 / 32760)))))
    return shift + math.log(x) - 0.5 / x - series


def trigamma(x: float) -> float:
    shift = 0.0
    while x < _FAR:
        shift += 1.0 / (x * x)
        x += 1.0
    u = 1.0 / (x * x)
    series = u * (1 / 6 - u * (1 / 30 - u * (1 / 42 - u * (1 / 30 - u * (5 / 66 - u * 691 / 2730)))))
    return shift + 1.0 / x + 0.5 * u + series / x
