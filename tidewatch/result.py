"""Result contract of an analysis: tidy metrics, tidy violations, one outcome row."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.severity import outcome_for_count, severity_for_count

METRIC_COLUMNS = ("analyser", "subject", "statistic", "name", "value")
VIOLATION_COLUMNS = ("analyser", "type", "subject", "value", "reference", "threshold")
METRIC_SCHEMA = "analyser string, subject string, statistic string, name string, value double"
VIOLATION_SCHEMA = (
    "analyser string, type string, subject string, value double, reference double, threshold double"
)


def metric_rows(df: DataFrame, analyser: str, subject: Column, statistic: Column, name: Column, value: Column) -> DataFrame:
    return df.select(
        F.lit(analyser).alias("analyser"),
        subject.cast("string").alias("subject"),
        statistic.alias("statistic"),
        name.alias("name"),
        value.cast("double").alias("value"),
    )


def violation_rows(
    df: DataFrame,
    analyser: str,
    kind: Column,
    subject: Column,
    value: Column | None = None,
    reference: Column | None = None,
    threshold: Column | None = None,
) -> DataFrame:
    def number(column: Column | None) -> Column:
        return (F.lit(None) if column is None else column).cast("double")

    return df.select(
        F.lit(analyser).alias("analyser"),
        kind.alias("type"),
        subject.cast("string").alias("subject"),
        number(value).alias("value"),
        number(reference).alias("reference"),
        number(threshold).alias("threshold"),
    )


def count_outcome(violations: DataFrame, analyser: str, alert_at: int) -> DataFrame:
    """One outcome row from a violation table; a clean run still yields its ``info`` row."""
    counted = violations.agg(F.count(F.lit(1)).alias("violation_count"))
    return counted.select(
        F.lit(analyser).alias("analyser"),
        outcome_for_count(F.col("violation_count")).alias("outcome"),
        severity_for_count(F.col("violation_count"), alert_at).alias("severity"),
        "violation_count",
    )


@dataclass(frozen=True)
class Analysis:
    """What one analyser reports. All frames are small: their size follows the spec, not the data.

    ``shared`` lists the frames the others are derived from; a job that reads several of them keeps
    these for the duration of the run, so the data is scanned once.
    """

    analyser: str
    metrics: DataFrame
    violations: DataFrame
    outcome: DataFrame
    details: dict[str, DataFrame] = field(default_factory=dict)
    header: dict[str, Any] = field(default_factory=dict)
    shared: tuple[DataFrame, ...] = ()

    def payload(self, spark: SparkSession) -> DataFrame:
        """The result document as one JSON row: header, outcome, metrics, violations, details."""
        def rows(df: DataFrame) -> Column:
            return df.agg(F.collect_list(F.struct(*df.columns))).scalar()

        outcome = self.outcome.select(F.struct(*self.outcome.columns)).scalar()
        parts = [F.lit(value).alias(key) for key, value in self.header.items()]
        parts += [outcome.alias("outcome"), rows(self.metrics).alias("metrics"), rows(self.violations).alias("violations")]
        parts += [rows(df).alias(name) for name, df in self.details.items()]
        return spark.range(1).select(
            F.lit(self.analyser).alias("analyser"),
            F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("document"),
        )
