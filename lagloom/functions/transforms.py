"""Driver-side constants and simple numeric transforms."""

from __future__ import annotations

import math


def log_spaced_lags(max_lag: int, n: int) -> list[float]:
    """`n` lag knots, equally spaced on a log scale over 0..max_lag."""
    step = (1.0 + math.log(max_lag)) / (n + 1)
    return [math.exp(step * i - 1.0) for i in range(1, n + 1)]
