"""Tables a monitoring run writes. Appends only; readers resolve repeated runs."""

from __future__ import annotations

import uuid
from collections import defaultdict
from datetime import UTC, datetime
from threading import Lock
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.registry import VERSION, new_registry_rows
from tidewatch.operators.rollup import standard_metrics
from tidewatch.sources.readers import read_or_empty

if TYPE_CHECKING:
    from tidewatch.plans.job import RunContext, RunResult

OUTCOME_SCHEMA = (
    "run_id string, analyser_type string, project string, environment string, variant string, outcome string, "
    "severity string, violation_count bigint, started_at timestamp, ended_at timestamp, duration_seconds double, "
    "image_digest string, git_sha string, result_uri string, failure_uri string"
)
METRIC_TABLE_SCHEMA = (
    "run_id string, project string, environment string, analyser_type string, variant string, ts timestamp, "
    "metric_name string, name string, value double, unit string"
)
REGISTRY_SCHEMA = (
    "project string, model_version string, status string, baseline_prefix string, analysers map<string,string>, "
    "manifest_uri string, evaluated_at timestamp, execution_id string"
)
FAILURE_SCHEMA = (
    "schema_version string, run_id string, analyser_type string, outcome string, exception_class string, "
    "message string, traceback string, image_digest string, git_sha string, env_snapshot map<string,string>, "
    "started_at timestamp, failed_at timestamp"
)

#: One commit into a folder removes the working folder of any other, so monitors that run side by side take turns.
_TURNS: dict[str, Lock] = defaultdict(Lock)


class MonitorStore:
    """A folder of tables, partitioned by day (and analyser) so that readers prune by time."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def result_uri(self, context: RunContext) -> str:
        return (
            f"{self.path('results')}/project={context.project}/model_version={context.model_version}"
            f"/analyser={context.analyser_type}"
        )

    def write_result(self, documents: DataFrame, context: RunContext, started: datetime) -> None:
        """The result document and its provenance, one JSON line each."""
        place = {
            "project": context.project,
            "model_version": context.model_version,
            "analyser": context.analyser_type,
        }
        keys = [F.lit(v).alias(k) for k, v in place.items()]
        result = documents.select(F.col("document").alias("value"), *keys)
        with _TURNS[self.path("results")]:
            result.write.mode("append").partitionBy(*place).text(self.path("results"))
        provenance = documents.select(
            *keys,
            F.lit(context.run_id).alias("run_id"),
            F.lit(context.image_digest).alias("image_digest"),
            F.lit(context.git_sha).alias("git_sha"),
            F.lit(started).alias("started_at"),
            env_snapshot(context).alias("env_snapshot"),
        )
        with _TURNS[self.path("provenance")]:
            provenance.write.mode("append").partitionBy(*place).json(self.path("provenance"))

    def append_metrics(self, metrics: DataFrame, context: RunContext, started: datetime) -> None:
        rows = metrics.select(
            *_dimensions(context),
            F.lit(started).alias("ts"),
            F.lit("MetricValue").alias("metric_name"),
            "name",
            "value",
            F.lit("None").alias("unit"),
        )
        self._append(rows, "metrics", "ts")

    def append_violations(self, violations: DataFrame, context: RunContext, started: datetime) -> None:
        rows = violations.select(
            *_dimensions(context), F.lit(started).alias("ts"), "type", "subject", "value", "reference", "threshold"
        )
        self._append(rows, "violations", "ts")

    def append_outcome(
        self,
        spark: SparkSession,
        result: RunResult,
        context: RunContext,
        started: datetime,
        ended: datetime,
        failed: bool = False,
    ) -> None:
        """The run's outcome row and its four standard metrics."""
        uri = self.result_uri(context)
        row = (
            context.run_id,
            context.analyser_type,
            context.project,
            context.environment,
            context.variant,
            result.outcome,
            result.severity,
            result.violation_count,
            started,
            ended,
            (ended - started).total_seconds(),
            context.image_digest,
            context.git_sha,
            uri,
            self.path("failures") if failed else None,
        )
        outcome = spark.createDataFrame([row], OUTCOME_SCHEMA)
        self._append(standard_metrics(outcome).withColumn("name", F.col("metric_name")), "metrics", "ts")
        # the outcome row goes last: whoever reads it finds the run complete
        self._append(outcome, "outcomes", "started_at")

    def write_failure(
        self, spark: SparkSession, error: BaseException, text: str, context: RunContext, started: datetime
    ) -> None:
        row = (
            "1.0",
            context.run_id,
            context.analyser_type,
            "failed_unhandled",
            type(error).__name__,
            str(error),
            text,
            context.image_digest,
            context.git_sha,
            _snapshot(context),
            started,
            datetime.now(UTC),
        )
        self._append(spark.createDataFrame([row], FAILURE_SCHEMA), "failures", "started_at")

    def append_registry(self, spark: SparkSession, candidates: DataFrame) -> DataFrame:
        """Insert the versions the registry does not hold yet; present rows are never changed.

        Two writers that race may both insert a version; reading resolves them alike for everyone.
        """
        self.insert(new_registry_rows(candidates, self.registry(spark)), "registry", REGISTRY_SCHEMA)
        return self.registry(spark)

    def registry(self, spark: SparkSession) -> DataFrame:
        """One row per version: the earliest evaluation wins, of equal ones that of least execution id."""
        return first_rows(self.inserted(spark, "registry", REGISTRY_SCHEMA), VERSION, ["evaluated_at", "execution_id", "status"])

    def insert(self, rows: DataFrame, table: str, schema: str) -> None:
        """Append rows in a folder of their own: appends of several jobs never share a committer's working folder."""
        names = rows.sparkSession.createDataFrame([], schema).columns
        rows.select(*names).write.parquet(f"{self.path(table)}/{uuid.uuid4().hex}")

    def inserted(self, spark: SparkSession, table: str, schema: str) -> DataFrame:
        """All inserted rows of a table."""
        return read_or_empty(spark, self.path(table), schema, nested=True)

    def read(self, spark: SparkSession, table: str, schema: str) -> DataFrame:
        """A table of the store, empty while nothing has been written."""
        return read_or_empty(spark, self.path(table), schema)

    def outcomes(self, spark: SparkSession) -> DataFrame:
        """One row per (run_id, analyser_type): the latest write of a repeated run wins."""
        return latest_rows(self.read(spark, "outcomes", OUTCOME_SCHEMA), ["run_id", "analyser_type"], "ended_at")

    def _append(self, rows: DataFrame, table: str, timestamp: str) -> None:
        dated = rows.withColumn("dt", F.date_format(timestamp, "yyyy-MM-dd"))
        with _TURNS[self.path(table)]:
            dated.write.mode("append").partitionBy("dt").parquet(self.path(table))


def latest_rows(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The newest row per key by a combining aggregate; no ranking window, no sort of a key's history."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), by).alias("row")
    return df.groupBy(*keys).agg(newest).select(*keys, "row.*").select(*df.columns)


def first_rows(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The first row per key in the order of ``by``."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*by)).alias("row")
    return df.groupBy(*keys).agg(first).select(*keys, "row.*").select(*df.columns)


def _snapshot(context: RunContext) -> dict[str, str]:
    return {
        "PROJECT_NAME": context.project,
        "ANALYSER_TYPE": context.analyser_type,
        "RUN_ID": context.run_id,
        "ENVIRONMENT": context.environment,
        "VARIANT": context.variant,
    }


def env_snapshot(context: RunContext):
    return F.create_map(*[F.lit(x) for pair in _snapshot(context).items() for x in pair])


def _dimensions(context: RunContext) -> list:
    names = ("run_id", "project", "environment", "analyser_type", "variant")
    return [F.lit(getattr(context, n)).alias(n) for n in names]
