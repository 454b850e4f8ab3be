"""Divergences between distributions, as plain column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The probability floors the monitored metrics are defined with.
PSI_FLOOR = 1e-6
JS_FLOOR = 1e-12


def add_all(terms: Sequence[Column]) -> Column:
    return reduce(lambda left, right: left + right, terms)


def psi_term(current: Column, baseline: Column) -> Column:
    """One category's share of the population stability index; probabilities are floored first."""
    p = F.greatest(current, F.lit(PSI_FLOOR))
    q = F.greatest(baseline, F.lit(PSI_FLOOR))
    return (p - q) * F.ln(p / q)


def entropy_gap(p: Column, q: Column) -> Column:
    """``p * ln(p / q)`` with ``0 ln 0 = 0``; null where q is zero but p is not."""
    return F.when(p == 0, F.lit(0.0)).when(q > 0, p * F.ln(p / q))


def normalised_probabilities(columns: Sequence[Column], binary: bool) -> list[Column]:
    """Row-wise class probabilities: one binary column is widened to both classes, rows sum to 1.

    A row that sums to zero is divided by 1 instead.
    """
    values = [c.cast("double") for c in columns]
    if binary and len(values) == 1:
        positive = F.least(F.greatest(values[0], F.lit(0.0)), F.lit(1.0))
        # greatest/least skip nulls, which would turn a missing probability into 0
        positive = F.when(values[0].isNotNull(), F.when(F.isnan(values[0]), values[0]).otherwise(positive))
        values = [F.lit(1.0) - positive, positive]
    total = add_all(values)
    divisor = F.when(total == 0, F.lit(1.0)).otherwise(total)
    return [v / divisor for v in values]


def _kl_bits(p: Sequence[Column], q: Sequence[Column]) -> Column:
    def bounded(c: Column) -> Column:
        return F.least(F.greatest(c, F.lit(JS_FLOOR)), F.lit(1.0))

    return add_all([bounded(a) * (F.log2(bounded(a)) - F.log2(bounded(b))) for a, b in zip(p, q)])


def js_bits(p: Sequence[Column], q: Sequence[Column]) -> Column:
    """Row-wise Jensen-Shannon divergence in bits; rows with a missing probability score 0."""
    mean = [(a + b) * 0.5 for a, b in zip(p, q)]
    value = (_kl_bits(p, mean) + _kl_bits(q, mean)) * 0.5
    complete = reduce(
        lambda left, right: left & right, [c.isNotNull() & ~F.isnan(c) for c in (*p, *q)]
    )
    return F.when(complete, value).otherwise(F.lit(0.0))
