"""Outcome rows of many runs: validation, roll-ups, digests, report matrices."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.severity import DEFAULT_SEVERITY, resolved_severity, severity_score
from tidewatch.functions.values import tally

RUN = ["run_id", "analyser_type"]
FAILURES = ("failed_handled", "failed_unhandled")


def with_severity(outcomes: DataFrame) -> DataFrame:
    """Fill a missing severity from the outcome and add its score."""
    severity = resolved_severity(F.col("outcome"), F.col("severity"))
    return outcomes.withColumn("severity", severity).withColumn("severity_score", severity_score(F.col("severity")))


def invalid_outcomes(reported: DataFrame) -> DataFrame:
    """Analyser reports that break the contract: only the job itself may record ``failed_unhandled``."""
    reserved = F.col("outcome") == "failed_unhandled"
    unknown = F.col("outcome").isNull() | ~F.col("outcome").isin(*DEFAULT_SEVERITY)
    negative = F.coalesce(F.col("violation_count") < 0, F.lit(False))
    problem = (
        F.when(unknown, "unknown outcome")
        .when(reserved, "outcome reserved for the job")
        .when(negative, "negative violation count")
    )
    return reported.withColumn("problem", problem).where("problem IS NOT NULL")


def with_duration(outcomes: DataFrame) -> DataFrame:
    """Run time in seconds; 0 while a run has no end."""
    micros = F.unix_micros("ended_at") - F.unix_micros("started_at")
    return outcomes.withColumn("duration_seconds", F.coalesce(micros / 1e6, F.lit(0.0)))


def standard_metrics(outcomes: DataFrame) -> DataFrame:
    """Four standard metric rows per run, all stamped with the run's start."""
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("metric_name"), value.cast("double").alias("value"), F.lit(unit).alias("unit"))
            for name, value, unit in (
                ("RunCount", F.lit(1), "Count"),
                ("RunDurationSeconds", F.col("duration_seconds"), "Seconds"),
                ("ViolationCount", F.col("violation_count"), "Count"),
                ("Severity", severity_score(resolved_severity(F.col("outcome"), F.col("severity"))), "None"),
            )
        ]
    )
    dims = ["project", "environment", "analyser_type", "variant"]
    return outcomes.select("run_id", *dims, F.col("started_at").alias("ts"), F.inline(rows))


def run_rollup(outcomes: DataFrame, metrics: DataFrame, highlights: Sequence[str]) -> DataFrame:
    """One line per run with selected metrics beside it; metrics are pivoted by a known name list."""
    picked = metrics.where(F.col("name").isin(*highlights)).groupBy(*RUN).agg(
        *[F.max(F.when(F.col("name") == h, F.col("value"))).alias(h) for h in highlights]
    )
    columns = [*RUN, "outcome", "severity", "violation_count"]
    return with_severity(outcomes).select(*columns).join(picked, RUN, "left")


def dashboard(outcomes: DataFrame, width: str = "1 hour") -> DataFrame:
    """Per project, analyser and time window: runs, mean duration, violations, severity histogram."""
    rows = with_severity(outcomes)
    return rows.groupBy("project", "analyser_type", F.window("started_at", width)).agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("duration_seconds").alias("mean_duration"),
        F.sum("violation_count").alias("violations"),
        *[tally(F.col("severity") == s).alias(s) for s in ("info", "warn", "alert")],
    ).withColumn("window_start", F.col("window.start")).drop("window")


def totals(outcomes: DataFrame) -> DataFrame:
    """Run and violation totals per analyser, per project and over all; ``level`` tells which."""
    return outcomes.rollup("project", "analyser_type").agg(
        F.grouping_id().cast("int").alias("level"),
        F.count(F.lit(1)).alias("runs"),
        F.sum("violation_count").alias("violations"),
    )


def recent_alerts(outcomes: DataFrame, k: int = 20) -> DataFrame:
    rows = with_severity(outcomes).where(F.col("severity") == "alert")
    return rows.orderBy(F.col("started_at").desc(), "run_id", "analyser_type").limit(k)


def failures_since(outcomes: DataFrame, now: datetime, hours: int = 24) -> DataFrame:
    """Failed runs per analyser over all projects in the last hours before ``now``."""
    since = F.lit(now) - F.make_interval(hours=F.lit(hours))
    recent = outcomes.where((F.col("started_at") > since) & (F.col("started_at") <= F.lit(now)))
    return recent.where(F.col("outcome").isin(*FAILURES)).groupBy("analyser_type").agg(F.count(F.lit(1)).alias("failures"))


def weekly_digest(outcomes: DataFrame) -> DataFrame:
    """Warnings per ISO week, project and analyser."""
    warned = with_severity(outcomes).where(F.col("severity") == "warn")
    return warned.groupBy(
        F.date_trunc("week", "started_at").alias("week"), "project", "analyser_type"
    ).agg(F.count(F.lit(1)).alias("warnings"), F.sum("violation_count").alias("violations"))


def drift_matrix(metrics: DataFrame, statistics: Sequence[str] = ("ks_stat", "ks_p", "psi")) -> DataFrame:
    """Columns by drift statistics; a statistic that was not computed is null."""
    picked = metrics.where(F.col("statistic").isin(*statistics))
    return picked.groupBy(F.col("subject").alias("column")).pivot("statistic", list(statistics)).agg(F.first("value"))


def facet_matrix(rows: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Facets by bias metrics of the pre-training stage; a missing metric is 0."""
    picked = rows.where(F.col("stage") == "pre")
    return picked.groupBy("facet").pivot("metric", list(methods)).agg(F.first("value")).na.fill(0.0)


def overall_disagreement(metrics: DataFrame) -> DataFrame:
    agreement = metrics.where(F.col("name") == "shadow/agreement")
    return agreement.select((F.lit(1.0) - F.col("value")).alias("disagreement"))
