"""Shared pieces of the registered queries: table access, rounding, derived monitoring inputs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import shared_folder

DIGITS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rounded(column: Column | str, digits: int = DIGITS) -> Column:
    """Round for comparison; adding 0.0 turns a negative zero into zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits) + F.lit(0.0)


def tidy(df: DataFrame, *columns: str) -> DataFrame:
    """Keep the columns and round every double among them."""
    kinds = dict(df.dtypes)
    return df.select(*[rounded(c).alias(c) if kinds[c] == "double" else F.col(c) for c in columns])


def text_time(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def r(expression: str, digits: int = DIGITS) -> str:
    """SQL twin of :func:`rounded`."""
    return f"round({expression}, {digits}) + 0.0"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for tables a query writes and reads back."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as outcome rows of monitoring runs."""
    return as_outcomes(table(spark, sf_dir, "events"))


def as_outcomes(events: DataFrame) -> DataFrame:
    kind, user, started = F.col("event_type"), F.col("user_id"), F.col("ts").cast("timestamp")
    outcome = (
        F.when(kind == "error", "failed_unhandled")
        .when(kind == "purchase", "succeeded_with_violations")
        .when(kind == "signup", "skipped_insufficient_data")
        .otherwise("succeeded")
    )
    analysers = F.array(*[F.lit(a) for a in ANALYSERS])
    violated = kind == "purchase"
    return events.select(
        F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("run_id"),
        F.get(analysers, (user % 5).cast("int")).alias("analyser_type"),
        F.concat(F.lit("proj-"), (user % 20).cast("string")).alias("project"),
        F.lit("prod").alias("environment"),
        F.lit("AllTraffic").alias("variant"),
        outcome.alias("outcome"),
        F.when(violated & (F.col("value") > 30), "alert").alias("severity"),
        F.when(violated, user % 4 + 1).otherwise(F.lit(0).cast("bigint")).alias("violation_count"),
        started.alias("started_at"),
        F.when(kind != "click", started + F.make_dt_interval(secs=F.round("value", 2).cast("decimal(18,6)"))).alias("ended_at"),
    )


ANALYSERS = ("dq", "mq", "bias", "explain", "shadow")

OUTCOMES_SQL = """
WITH runs AS (
  SELECT 'run-' || event_id AS run_id, (['dq', 'mq', 'bias', 'explain', 'shadow'])[user_id % 5 + 1] AS analyser_type,
    'proj-' || (user_id % 20) AS project,
    CASE event_type WHEN 'error' THEN 'failed_unhandled' WHEN 'purchase' THEN 'succeeded_with_violations'
      WHEN 'signup' THEN 'skipped_insufficient_data' ELSE 'succeeded' END AS outcome,
    CASE WHEN event_type = 'purchase' AND value > 30 THEN 'alert' END AS explicit,
    CASE WHEN event_type = 'purchase' THEN user_id % 4 + 1 ELSE 0 END AS violation_count,
    ts AS started_at, value, event_type, props FROM events),
outcomes AS (
  SELECT *, coalesce(explicit, CASE outcome WHEN 'failed_unhandled' THEN 'alert' WHEN 'succeeded_with_violations' THEN 'warn'
      WHEN 'skipped_insufficient_data' THEN 'warn' ELSE 'info' END) AS severity,
    CASE WHEN event_type = 'click' THEN 0.0 ELSE round(value, 2) END AS duration_seconds FROM runs)
"""
