"""Two-sample Kolmogorov-Smirnov p-values.

``asymptotic_pvalue`` evaluates the Pelz-Good (1976) expansion of the one-sample law at the effective
sample size ``round(nm / (n + m))``; it is a closed column expression. ``exact_pvalue`` counts lattice
paths for small samples (Hodges 1958) in a vectorised helper that sees one row per compared column.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: number of series terms.
SERIES_TERMS = 20

_PI2 = math.pi**2
_ROOT_2PI = math.sqrt(2.0 * math.pi)


def _series(term) -> Column:
    """Sum of ``term(k)`` for k = 1..SERIES_TERMS."""
    steps = F.sequence(F.lit(1), F.lit(SERIES_TERMS))
    return F.aggregate(steps, F.lit(0.0), lambda acc, k: acc + term(k.cast("double")))


def asymptotic_pvalue(statistic: Column, n: Column, m: Column) -> Column:
    size_a, size_b = n.cast("double"), m.cast("double")
    size = F.greatest(F.round(size_a * size_b / (size_a + size_b)), F.lit(1.0))
    root = F.sqrt(size)
    z = root * statistic
    z2, z4, z6, z8 = (F.pow(z, F.lit(float(p))) for p in (2, 4, 6, 8))

    def odd(power: int):
        return lambda k: F.pow(2 * k - 1, F.lit(float(power))) * F.exp(-F.pow(2 * k - 1, F.lit(2.0)) * _PI2 / (8 * z2))

    def even(power: int):
        return lambda k: F.pow(k, F.lit(float(power))) * F.exp(-F.pow(k, F.lit(2.0)) * _PI2 / (2 * z2))

    o0, o2, o4, o6 = (_series(odd(p)) for p in (0, 2, 4, 6))
    e2, e4 = (_series(even(p)) for p in (2, 4))
    k0 = _ROOT_2PI / z * o0
    k1 = _ROOT_2PI / (6 * z4) * (-z2 * o0 + _PI2 / 4 * o2)
    k2 = (
        _ROOT_2PI
        / (72 * F.pow(z, F.lit(7.0)))
        * (
            (6 * z6 + 2 * z4) * o0
            + (2 * z4 - 5 * z2) * (_PI2 / 4) * o2
            + (1 - 2 * z2) * (_PI2**2 / 16) * o4
        )
        - _ROOT_2PI * _PI2 / (36 * F.pow(z, F.lit(3.0))) * e2
    )
    k3 = (
        _ROOT_2PI
        / (6480 * F.pow(z, F.lit(10.0)))
        * (
            (-30 * z6 - 90 * z8) * o0
            + (135 * z4 - 96 * z6) * (_PI2 / 4) * o2
            + (212 * z4 - 60 * z2) * (_PI2**2 / 16) * o4
            + (5 - 30 * z2) * (_PI2**3 / 64) * o6
        )
        + _ROOT_2PI / (216 * z6) * (3 * _PI2 * z2 * e2 - _PI2**2 * e4)
    )
    cdf = k0 + k1 / root + k2 / size + k3 / (size * root)
    tail = 2 * F.exp(-2 * z2)
    # The expansion loses all digits where the law is 0 or 1 to double precision.
    p = F.when(z < 0.2, F.lit(1.0)).when(z > 4.0, tail).otherwise(1 - cdf)
    return F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0))


def exact_tail_function():
    """The scalar ``P(D >= statistic)``, as a closure that ships to executors without this package."""
    import math

    import numpy as np

    def tail(statistic: float, n: int, m: int) -> float:
        divisor = math.gcd(n, m)
        step_x, step_y = m // divisor, n // divisor
        bound = round(statistic * n * step_x)
        if bound <= 0:
            return 1.0
        # inside[i] is the share of lattice paths to (i, s - i) that stayed strictly within the boundary
        inside = np.zeros(n + 1)
        inside[0] = 1.0
        index = np.arange(n + 1, dtype=np.int64)
        for total in range(1, n + m + 1):
            low, high = max(0, total - m), min(n, total)
            i = index[low : high + 1]
            from_left = np.zeros(high - low + 1)
            start = max(low, 1)
            from_left[start - low :] = inside[start - 1 : high] * index[start : high + 1]
            from_below = inside[low : high + 1] * (total - i)
            level = (from_left + from_below) / total
            level[np.abs(i * step_x - (total - i) * step_y) >= bound] = 0.0
            inside[low : high + 1] = level
            if low > 0:
                inside[low - 1] = 0.0
        return float(min(1.0, max(0.0, 1.0 - inside[n])))

    return tail


def exact_pvalue(statistic: Column, n: Column, m: Column) -> Column:
    """Exact p-value column; meant for a table with one row per compared column."""
    tail = exact_tail_function()

    def tails(d: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        values = [tail(float(x), int(y), int(z)) if x == x else None for x, y, z in zip(d, a, b)]
        return type(d)(values, dtype="float64")

    return F.pandas_udf(tails, T.DoubleType())(statistic, n, m)
