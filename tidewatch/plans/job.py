"""Running a monitor as a batch job: analysis, sinks, failure isolation."""

from __future__ import annotations

import logging
import traceback
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import SparkSession

from tidewatch.plans.runs import Analyser, Inputs
from tidewatch.result import Analysis
from tidewatch.sources.sinks import MonitorStore

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class RunContext:
    """Identity and provenance of one run."""

    run_id: str
    analyser_type: str
    project: str
    environment: str
    model_version: str = "0"
    variant: str = "AllTraffic"
    image_digest: str = "unknown"
    git_sha: str = "unknown"


@dataclass(frozen=True)
class RunResult:
    run_id: str
    analyser_type: str
    outcome: str
    severity: str
    violation_count: int


@dataclass(frozen=True)
class Monitor:
    analyser: Analyser
    context: RunContext
    inputs: Inputs
    config: Mapping[str, Any] = field(default_factory=dict)


class ContractError(RuntimeError):
    """An analyser returned something only the job may record."""


def _record(spark: SparkSession, store: MonitorStore, context: RunContext, analysis: Analysis, started: datetime) -> RunResult:
    for frame in analysis.shared:
        frame.persist()
    try:
        row = analysis.outcome.first()
        if row["outcome"] == "failed_unhandled":
            raise ContractError("failed_unhandled is reserved for the job")
        store.write_result(analysis.payload(spark), context, started)
        store.append_metrics(analysis.metrics, context, started)
        store.append_violations(analysis.violations, context, started)
    finally:
        for frame in analysis.shared:
            frame.unpersist()
    result = RunResult(context.run_id, context.analyser_type, row["outcome"], row["severity"], row["violation_count"])
    store.append_outcome(spark, result, context, started, datetime.now(UTC))
    return result


def run_monitor(spark: SparkSession, store: MonitorStore, monitor: Monitor) -> RunResult:
    """Run one monitor and write its rows. Any error becomes a failure row and an alert, never a raise."""
    started = datetime.now(UTC)
    context = monitor.context
    try:
        return _record(spark, store, context, monitor.analyser.compute(monitor.inputs, monitor.config), started)
    except Exception as error:  # noqa: BLE001 - the job boundary: siblings must go on
        text = "".join(traceback.format_exception(error))
        result = RunResult(context.run_id, context.analyser_type, "failed_unhandled", "alert", 0)
        writes = (
            lambda: store.write_failure(spark, error, text, context, started),
            lambda: store.append_outcome(spark, result, context, started, datetime.now(UTC), failed=True),
        )
        for write in writes:
            try:
                write()
            except Exception:  # noqa: BLE001 - a store that cannot be written must not end the siblings either
                log.exception("run %s of %s: its failure could not be recorded", context.run_id, context.analyser_type)
        return result


def run_all(spark: SparkSession, store: MonitorStore, monitors: Sequence[Monitor], parallel: int = 5) -> list[RunResult]:
    """Run independent monitors side by side; Spark schedules their jobs on the shared executors."""
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        return list(pool.map(lambda m: run_monitor(spark, store, m), monitors))


