"""Outcome and severity vocabulary, as data and as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Outcome names with their default severity, and the numeric score of a severity.
DEFAULT_SEVERITY = {
    "succeeded": "info",
    "succeeded_with_violations": "warn",
    "skipped_no_input": "info",
    "skipped_insufficient_data": "warn",
    "failed_handled": "warn",
    "failed_unhandled": "alert",
}
SEVERITY_SCORE = {"info": 0, "warn": 1, "alert": 2}


def _lookup(key: Column, table: dict[str, object]) -> Column:
    chain = None
    for name, value in table.items():
        chain = F.when(key == name, F.lit(value)) if chain is None else chain.when(key == name, F.lit(value))
    return chain


def default_severity(outcome: Column) -> Column:
    return _lookup(outcome, DEFAULT_SEVERITY)


def resolved_severity(outcome: Column, explicit: Column) -> Column:
    """An explicit severity wins over the outcome's default."""
    return F.coalesce(explicit, default_severity(outcome))


def severity_score(severity: Column) -> Column:
    return _lookup(severity, SEVERITY_SCORE)


def severity_for_count(violations: Column, alert_at: int) -> Column:
    return F.when(violations == 0, "info").when(violations >= F.lit(alert_at), "alert").otherwise("warn")


def outcome_for_count(violations: Column) -> Column:
    return F.when(violations > 0, "succeeded_with_violations").otherwise("succeeded")
