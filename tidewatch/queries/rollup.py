"""Roll-up queries: events as outcome rows of a fleet of monitored projects."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import rollup
from tidewatch.queries.common import OUTCOMES_SQL, outcomes, r, table, text_time, tidy

NOW = datetime(2024, 1, 20, 12)


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.with_duration(outcomes(spark, sf_dir))


def severity_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.with_severity(outcomes(spark, sf_dir)).select("run_id", "outcome", "severity", "severity_score")


def invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    reported = outcomes(spark, sf_dir).withColumn(
        "violation_count", F.col("violation_count") - F.when(F.col("project") == "proj-7", 3).otherwise(0)
    )
    return rollup.invalid_outcomes(reported).select("run_id", "outcome", "problem")


def standard_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rollup.standard_metrics(timed(spark, sf_dir)).withColumn("ts", text_time("ts"))
    return tidy(rows, "run_id", "analyser_type", "metric_name", "value", "unit", "ts")


def outcome_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rollup.with_severity(timed(spark, sf_dir)).withColumn("started_at", text_time("started_at"))
    return tidy(rows, "run_id", "analyser_type", "outcome", "severity", "violation_count", "started_at", "duration_seconds")


def run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two highlight metrics per run; clicks report none, views only one."""
    runs = outcomes(spark, sf_dir)
    events = table(spark, sf_dir, "events")
    identity = runs.select("run_id", "analyser_type")
    score = F.get_json_object("props", "$.k").cast("double") / 100
    named = F.array(
        F.struct(F.lit("accuracy").alias("name"), score.alias("value")),
        F.struct(F.when(F.col("event_type") != "view", "agreement").alias("name"), F.col("value").alias("value")),
    )
    measured = events.where(F.col("event_type") != "click").select(
        F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("run_id"), F.inline(named)
    )
    metrics = measured.join(identity, "run_id")
    rows = rollup.run_rollup(runs, metrics, ["accuracy", "agreement"])
    return tidy(rows, "run_id", "analyser_type", "outcome", "severity", "violation_count", "accuracy", "agreement")


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rollup.dashboard(timed(spark, sf_dir)).withColumn("window_start", text_time("window_start"))
    columns = ("project", "analyser_type", "window_start", "runs", "mean_duration", "violations", "info", "warn", "alert")
    return tidy(rows, *columns)


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.totals(outcomes(spark, sf_dir))


def recent_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.recent_alerts(outcomes(spark, sf_dir), 20).select("run_id", text_time("started_at").alias("started_at"))


def failures_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.failures_since(outcomes(spark, sf_dir), NOW)


def weekly_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.weekly_digest(outcomes(spark, sf_dir)).withColumn("week", text_time("week"))


QUERIES = {
    "severity_default": severity_default,
    "invalid_outcomes": invalid,
    "standard_metrics": standard_metrics,
    "outcome_rows": outcome_rows,
    "run_rollup": run_rollup,
    "dashboard_rollup": dashboard,
    "outcome_totals": totals,
    "recent_alerts": recent_alerts,
    "failures_24h": failures_24h,
    "weekly_digest": weekly_digest,
}

_TS = "strftime(started_at, '%Y-%m-%d %H:%M:%S')"
_SCORE = "CASE severity WHEN 'info' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END"
ORACLES = {
    "severity_default": f"{OUTCOMES_SQL} SELECT run_id, outcome, severity, ({_SCORE})::INTEGER AS severity_score FROM outcomes",
    "invalid_outcomes": f"""{OUTCOMES_SQL} SELECT run_id, outcome,
        CASE WHEN outcome = 'failed_unhandled' THEN 'outcome reserved for the job' ELSE 'negative violation count' END AS problem
        FROM outcomes WHERE outcome = 'failed_unhandled' OR violation_count - (CASE WHEN project = 'proj-7' THEN 3 ELSE 0 END) < 0""",
    "standard_metrics": f"""{OUTCOMES_SQL} SELECT run_id, analyser_type, metric_name, {r('value')} AS value, unit, {_TS} AS ts FROM (
        SELECT *, 'RunCount' AS metric_name, 1.0::DOUBLE AS value, 'Count' AS unit FROM outcomes
        UNION ALL BY NAME SELECT * EXCLUDE (value), 'RunDurationSeconds' AS metric_name, duration_seconds AS value, 'Seconds' AS unit FROM outcomes
        UNION ALL BY NAME SELECT * EXCLUDE (value), 'ViolationCount' AS metric_name, violation_count::DOUBLE AS value, 'Count' AS unit FROM outcomes
        UNION ALL BY NAME SELECT * EXCLUDE (value), 'Severity' AS metric_name, ({_SCORE})::DOUBLE AS value, 'None' AS unit FROM outcomes)""".replace(
        "SELECT *, 'RunCount'", "SELECT * EXCLUDE (value), 'RunCount'"
    ),
    "outcome_rows": f"""{OUTCOMES_SQL} SELECT run_id, analyser_type, outcome, severity, violation_count::BIGINT AS violation_count,
        {_TS} AS started_at, {r('duration_seconds')} AS duration_seconds FROM outcomes""",
    "run_rollup": f"""{OUTCOMES_SQL} SELECT run_id, analyser_type, outcome, severity, violation_count::BIGINT AS violation_count,
        {r("CASE WHEN event_type <> 'click' THEN regexp_extract(props, '[0-9]+')::DOUBLE / 100 END")} AS accuracy,
        {r("CASE WHEN event_type NOT IN ('click', 'view') THEN value END")} AS agreement FROM outcomes""",
    "dashboard_rollup": f"""{OUTCOMES_SQL} SELECT project, analyser_type, strftime(date_trunc('hour', started_at), '%Y-%m-%d %H:%M:%S') AS window_start,
        count(*)::BIGINT AS runs, {r('avg(duration_seconds)')} AS mean_duration, sum(violation_count)::BIGINT AS violations,
        count(*) FILTER (severity = 'info')::BIGINT AS info, count(*) FILTER (severity = 'warn')::BIGINT AS warn,
        count(*) FILTER (severity = 'alert')::BIGINT AS alert FROM outcomes GROUP BY 1, 2, 3""",
    "outcome_totals": f"""{OUTCOMES_SQL} SELECT project, analyser_type, grouping(project, analyser_type)::INTEGER AS level,
        count(*)::BIGINT AS runs, sum(violation_count)::BIGINT AS violations FROM outcomes GROUP BY ROLLUP (project, analyser_type)""",
    "recent_alerts": f"""{OUTCOMES_SQL} SELECT run_id, {_TS} AS started_at FROM (
        SELECT * FROM outcomes WHERE severity = 'alert' ORDER BY outcomes.started_at DESC, run_id, analyser_type LIMIT 20)""",
    "failures_24h": f"""{OUTCOMES_SQL} SELECT analyser_type, count(*)::BIGINT AS failures FROM outcomes
        WHERE outcome IN ('failed_handled', 'failed_unhandled') AND started_at > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND started_at <= TIMESTAMP '{NOW}'
        GROUP BY analyser_type""",
    "weekly_digest": f"""{OUTCOMES_SQL} SELECT strftime(date_trunc('week', started_at), '%Y-%m-%d %H:%M:%S') AS week, project, analyser_type,
        count(*)::BIGINT AS warnings, sum(violation_count)::BIGINT AS violations FROM outcomes WHERE severity = 'warn' GROUP BY 1, 2, 3""",
}
