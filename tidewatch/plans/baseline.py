"""The baseline workflow over a fleet: gate, planned monitors, required results, registry, as one restartable job.

Each step is a set operation over all versions that are due for it and writes a table; after its rows it writes a
marker per version and step. A step takes the versions that lack its marker and have those it depends on, so a
job that died anywhere goes on where it stopped: nothing marked runs again, and rows that were written without a
marker are written anew and resolved on reading.

    gate                  every manifest against its project's settings
    monitor:<name>        versions whose gate planned that monitor
    decision              versions whose planned monitors are all marked
    registry              decided versions, inserted once

A monitor is anything with ``evaluate(versions) -> DataFrame`` of ``project, model_version, outcome`` (and, if it likes,
``violation_count``, ``message`` and ``metrics``). Where evaluating a set of versions raises, the set is halved by hash until the
version that raises is alone; it alone ends ``failed_unhandled``. After ``failures`` errors of one monitor in a run, what
has not been told apart yet stays unmarked and undecided, for the next run.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.severity import outcome_for_count
from tidewatch.operators.registry import ACCEPTED_RESULTS, RESULTS_FAILED, RESULTS_PASSED, VERSION, gate
from tidewatch.plans.job import Monitor, run_monitor
from tidewatch.session import written
from tidewatch.sources.sinks import MonitorStore, latest_rows

log = logging.getLogger(__name__)

#: Fixed value: message of a version whose gate could not be worked out.
GATE_ERROR = "Gate logic error: %s"
KEYS = "project string, model_version string"
MARKER_SCHEMA = f"{KEYS}, step string, execution_id string, at timestamp"
GATE_SCHEMA = (
    f"{KEYS}, status string, message string, warnings array<string>, monitors_to_run array<string>, required array<string>, "
    "baseline_prefix string, manifest_uri string, at timestamp"
)
RESULT_SCHEMA = f"{KEYS}, analyser string, outcome string, violation_count bigint, message string, metrics map<string,double>, at timestamp"
DECISION_SCHEMA = (
    f"{KEYS}, status string, message string, analysers map<string,string>, missing array<string>, skipped array<string>, "
    "unplanned array<string>, baseline_prefix string, manifest_uri string, at timestamp"
)


class FleetMonitor(Protocol):
    def evaluate(self, versions: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class GroupedMonitor:
    """Aggregates per version: ``metrics`` by name, and for some of them a test of the value that is a violation.

    ``rows`` holds the versions' data with their keys. A version without rows, or with fewer than ``least_rows``, is
    skipped; a metric that is null violates nothing.
    """

    rows: DataFrame
    metrics: Mapping[str, Column]
    violated: Mapping[str, Callable[[Column], Column]]
    least_rows: int = 1

    def evaluate(self, versions: DataFrame) -> DataFrame:
        own = self.rows.join(versions.select(*VERSION), VERSION, "left_semi")
        measured = own.groupBy(*VERSION).agg(F.count("*").alias("rows"), F.struct(*[c.cast("double").alias(n) for n, c in self.metrics.items()]).alias("m"))
        flags = [F.coalesce(test(F.col(f"m.{name}")), F.lit(False)) for name, test in self.violated.items()]
        count = sum((f.cast("bigint") for f in flags), F.lit(0).cast("bigint"))
        names = F.concat_ws(", ", *[F.when(f, name) for f, name in zip(flags, self.violated, strict=True)])
        enough = F.coalesce("rows", F.lit(0).cast("bigint"))
        outcome = F.when(enough == 0, "skipped_no_input").when(enough < self.least_rows, "skipped_insufficient_data")
        values = F.create_map(*[x for n in self.metrics for x in (F.lit(n), F.col(f"m.{n}"))])
        judged = measured.select(*VERSION, "rows", count.alias("violation_count"), names.alias("message"), values.alias("metrics"))
        return versions.select(*VERSION).join(judged, VERSION, "left").select(
            *VERSION,
            outcome.otherwise(outcome_for_count(F.col("violation_count"))).alias("outcome"),
            F.when(enough >= self.least_rows, F.col("violation_count")).otherwise(F.lit(0).cast("bigint")).alias("violation_count"),
            F.nullif("message", F.lit("")).alias("message"),
            "metrics",
        )


@dataclass(frozen=True)
class EachVersion:
    """A full analysis per version, several side by side, for fleets whose versions need jobs of their own.

    ``make`` names the run of a version; each run leaves its documents, metrics and outcome row in the store.
    """

    spark: SparkSession
    store: MonitorStore
    make: Callable[[str, str], Monitor]
    parallel: int = 5

    def evaluate(self, versions: DataFrame) -> DataFrame:
        def one(row) -> tuple:
            result = run_monitor(self.spark, self.store, self.make(row["project"], row["model_version"]))
            return (row["project"], row["model_version"], result.outcome, result.violation_count)

        with ThreadPoolExecutor(self.parallel) as pool:
            rows = list(pool.map(one, versions.select(*VERSION).toLocalIterator()))
        return self.spark.createDataFrame(rows, f"{KEYS}, outcome string, violation_count bigint")


class BaselineWorkflow:
    """``monitors`` by the name the settings use. A planned monitor that is not among them never reports.

    ``required`` names monitors that every version needs besides those its project's settings require.
    """

    def __init__(
        self, store: MonitorStore, monitors: Mapping[str, FleetMonitor], execution_id: str, required: Sequence[str] = (), failures: int = 64
    ):
        self.store, self.monitors, self.execution_id, self.failures = store, monitors, execution_id, failures
        self.required = F.array(*[F.lit(name) for name in required]).cast("array<string>")

    def run(self, manifests: DataFrame, config: DataFrame) -> DataFrame:
        """Bring every version as far as it gets; returns the registry, one row per version.

        ``manifests`` has ``project, model_version, artifacts`` and, optionally, ``problem`` (why a manifest is unusable),
        ``baseline_prefix`` and ``manifest_uri``; ``config`` is that of the gate.
        """
        spark = manifests.sparkSession
        self._gate(spark, manifests, config)
        ready = self._ready(spark)
        with ThreadPoolExecutor(max(1, len(self.monitors))) as pool:
            waiting = list(pool.map(lambda item: self._monitor(ready, *item), self.monitors.items()))
        self._decide(spark, ready, waiting)
        return self._register(spark)

    def gates(self, spark: SparkSession) -> DataFrame:
        return latest_rows(self.store.inserted(spark, "baseline_gate", GATE_SCHEMA), VERSION, "at")

    def results(self, spark: SparkSession) -> DataFrame:
        return latest_rows(self.store.inserted(spark, "baseline_results", RESULT_SCHEMA), [*VERSION, "analyser"], "at")

    def decisions(self, spark: SparkSession) -> DataFrame:
        return latest_rows(self.store.inserted(spark, "baseline_decisions", DECISION_SCHEMA), VERSION, "at")

    def marked(self, spark: SparkSession, step: str) -> DataFrame:
        """Versions that are through with a step."""
        return self._through(spark, step).distinct()

    def _through(self, spark: SparkSession, step: str) -> DataFrame:
        """The versions of :meth:`marked`, one with several markers several times: for semi and anti joins."""
        markers = self.store.inserted(spark, "baseline_markers", MARKER_SCHEMA)
        return markers.where(F.col("step") == step).select(*VERSION)

    def _write(self, rows: DataFrame, table: str, schema: str) -> None:
        self.store.insert(rows.withColumn("at", F.current_timestamp()), table, schema)

    def _mark(self, versions: DataFrame, step: str) -> None:
        rows = versions.withColumn("step", F.lit(step)).withColumn("execution_id", F.lit(self.execution_id))
        self._write(rows, "baseline_markers", MARKER_SCHEMA)

    def _gate(self, spark: SparkSession, manifests: DataFrame, config: DataFrame) -> None:
        due = manifests.join(self._through(spark, "gate"), VERSION, "left_anti")
        for name, value in (("problem", F.lit(None)), ("baseline_prefix", F.lit(None)), ("manifest_uri", F.lit(None))):
            due = due if name in due.columns else due.withColumn(name, value.cast("string"))
        problem = F.coalesce("problem", F.when(F.col("artifacts").isNull(), "manifest has no artifacts"))
        due = _due(due.withColumn("problem", problem), "baseline-due")
        usable = due.where(F.col("problem").isNull() & F.col(VERSION[0]).isNotNull() & F.col(VERSION[1]).isNotNull())
        required = config.where("enabled AND required").groupBy("project").agg(F.sort_array(F.collect_set("monitor")).alias("required"))
        none = F.array().cast("array<string>")
        place = ("baseline_prefix", "manifest_uri")
        gated = gate(usable.select(*VERSION, "artifacts", *place), config, place)
        broken = due.where("problem IS NOT NULL").select(
            *VERSION,
            F.lit("rejected").alias("status"),
            F.format_string(GATE_ERROR, "problem").alias("message"),
            none.alias("warnings"),
            none.alias("monitors_to_run"),
            "baseline_prefix",
            "manifest_uri",
        )
        rows = gated.unionByName(broken).join(required, "project", "left").withColumn("required", F.array_union(F.coalesce("required", none), self.required))
        self._write(rows, "baseline_gate", GATE_SCHEMA)
        self._mark(due, "gate")

    def _progress(self, spark: SparkSession, steps: Mapping[str, str]) -> DataFrame:
        """Per marked version a flag for each of these steps, named by the mapping's keys."""
        markers = self.store.inserted(spark, "baseline_markers", MARKER_SCHEMA).where(F.col("step").isin(*steps.values()))
        return markers.groupBy(*VERSION).agg(*[F.bool_or(F.col("step") == step).alias(name) for name, step in steps.items()])

    def _ready(self, spark: SparkSession) -> DataFrame:
        """Gated versions that are undecided or wait for a monitor, with ``decided`` and the monitors that have ``ran``:
        worked out once a run, for its monitors and its decision."""
        steps = {f"__{i}": f"monitor:{name}" for i, name in enumerate(self.monitors)}
        done = self._progress(spark, {"gated": "gate", "decided": "decision", **steps}).where("gated")
        ran = F.array_compact(F.array(*[F.when(F.col(f"__{i}"), name) for i, name in enumerate(self.monitors)]).cast("array<string>"))
        done = done.select(*VERSION, "decided", ran.alias("ran"))
        # Joined before they are resolved: one exchange and one sort do for both.
        rows = latest_rows(self.store.inserted(spark, "baseline_gate", GATE_SCHEMA).join(done, VERSION), VERSION, "at")
        still = [self._waits(name) for name in self.monitors]
        return _due(rows.where(reduce(or_, still, ~F.col("decided"))), "baseline-ready")

    def _waits(self, name: str) -> Column:
        """Whether a version's gate planned a monitor that has not run."""
        return F.coalesce(F.array_contains("monitors_to_run", name) & ~F.array_contains("ran", name), F.lit(False))

    def _monitor(self, ready: DataFrame, name: str, monitor: FleetMonitor) -> Column:
        """Run a monitor for all versions that wait for it; returns which of them wait on."""
        step = f"monitor:{name}"
        due = ready.where(self._waits(name)).select(*VERSION)
        parts, failures = [(0, 1)], 0
        while parts and failures < self.failures:
            residue, modulus = parts.pop()
            part = due.where(_falls(residue, modulus))
            try:
                self._write(_complete(part, monitor.evaluate(part), name), "baseline_results", RESULT_SCHEMA)
            except Exception as error:  # noqa: BLE001 - one version's error must not end another's run
                failures += 1
                if part.limit(2).count() > 1:
                    parts += [(residue, 2 * modulus), (residue + modulus, 2 * modulus)]
                    continue
                log.warning("monitor %s failed", name, exc_info=error)
                text = F.lit(f"{type(error).__name__}: {error}"[:2000])
                failed = part.select(*VERSION, F.lit("failed_unhandled").alias("outcome"), F.lit(0).cast("bigint").alias("violation_count"), text.alias("message"))
                self._write(_complete(part, failed, name), "baseline_results", RESULT_SCHEMA)
            self._mark(part, step)
        if parts:
            log.warning("monitor %s: stopped after %d errors, %d parts are left for another run", name, failures, len(parts))

        return self._waits(name) & reduce(or_, [_falls(*p) for p in parts], F.lit(False))

    def _decide(self, spark: SparkSession, ready: DataFrame, waiting: Sequence[Column]) -> None:
        # versions that wait for a planned monitor are decided by a later run
        due = ready.where(~F.col("decided") & ~reduce(or_, waiting, F.lit(False)))
        self._write(decide(due, self._outcomes(spark)), "baseline_decisions", DECISION_SCHEMA)
        self._mark(due.select(*VERSION), "decision")

    def _outcomes(self, spark: SparkSession) -> DataFrame:
        """How each version's monitors ended, as ``analysers``; of repeated results of one monitor the newest counts."""
        rows = self.store.inserted(spark, "baseline_results", RESULT_SCHEMA)
        entries = rows.groupBy(*VERSION).agg(F.sort_array(F.collect_list(F.struct("analyser", "at", "outcome"))).alias("e"))
        following = lambda i: F.get("e", i + 1)["analyser"]
        newest = F.filter("e", lambda x, i: F.coalesce(following(i) != x["analyser"], F.lit(True)))
        ended = F.map_from_entries(F.transform(newest, lambda x: F.struct(x["analyser"], x["outcome"])))
        return entries.select(*VERSION, ended.alias("analysers"))

    def _register(self, spark: SparkSession) -> DataFrame:
        progress = self._progress(spark, {"decided": "decision", "registered": "registry"})
        todo = progress.where("decided AND NOT registered").select(*VERSION)
        decided = self.store.inserted(spark, "baseline_decisions", DECISION_SCHEMA).join(todo, VERSION, "left_semi")
        due = _due(latest_rows(decided, VERSION, "at"), "baseline-decided")
        rows = due.select(
            *VERSION, "status", "baseline_prefix", "analysers", "manifest_uri", F.col("at").alias("evaluated_at"), F.lit(self.execution_id).alias("execution_id")
        )
        table = self.store.append_registry(spark, rows)
        self._mark(due, "registry")
        return table


def decide(gates: DataFrame, reported: DataFrame) -> DataFrame:
    """Approve each version that its gate passed and whose required monitors all ended ``ok`` or ``succeeded``.

    ``reported`` has a version's outcomes by monitor, as ``analysers``.
    Besides the status the row tells apart required monitors that were planned and never reported (``missing``), that
    reported to have skipped (``skipped``), and that the gate did not plan (``unplanned``).
    """
    none = F.create_map().cast("map<string,string>")
    joined = gates.join(reported, VERSION, "left").withColumn("analysers", F.coalesce("analysers", none))
    outcome = lambda name: F.try_element_at("analysers", name)
    planned = lambda name: F.array_contains("monitors_to_run", name)
    # A rejected gate plans nothing; what it did not plan has no results to ask for.
    asked = F.when(F.col("status") == "rejected", F.array().cast("array<string>")).otherwise(F.col("required"))
    bad = F.filter(asked, lambda n: ~F.coalesce(outcome(n).isin(*ACCEPTED_RESULTS), F.lit(False)))
    problems = F.array_join(F.transform(bad, lambda n: F.concat(n, F.lit(" ("), F.coalesce(outcome(n), F.lit("missing")), F.lit(")"))), ", ")
    passed = F.size(bad) == 0
    return joined.select(
        *VERSION,
        F.when((F.col("status") == "rejected") | ~passed, "rejected").otherwise("approved").alias("status"),
        F.when(F.col("status") == "rejected", F.col("message")).when(passed, RESULTS_PASSED).otherwise(F.format_string(RESULTS_FAILED, problems)).alias("message"),
        "analysers",
        F.filter(bad, lambda n: outcome(n).isNull() & planned(n)).alias("missing"),
        F.filter(bad, lambda n: F.coalesce(outcome(n).startswith("skipped"), F.lit(False))).alias("skipped"),
        F.filter(bad, lambda n: outcome(n).isNull() & ~planned(n)).alias("unplanned"),
        "baseline_prefix",
        "manifest_uri",
    )


def _complete(part: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """One result row for every version of the part that the monitor reports on."""
    for column, kind in (("violation_count", "bigint"), ("message", "string"), ("metrics", "map<string,double>")):
        found = found if column in found.columns else found.withColumn(column, F.lit(None).cast(kind))
    rows = found.join(part.select(*VERSION), VERSION, "left_semi")
    return rows.withColumn("analyser", F.lit(name))


def _falls(residue: int, modulus: int) -> Column:
    """Whether a version is in this part of all."""
    return F.pmod(F.xxhash64(*VERSION), F.lit(modulus)) == residue


def _due(rows: DataFrame, name: str) -> DataFrame:
    """Rows that a step is due for, as a table; if there are none, a frame that plans fold away with all joined to it."""
    table = written(rows, name)
    return table.limit(0) if table.isEmpty() else table
