"""The baseline workflow: gates, isolation of failures, restarts, decisions and racing registry writers."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import registry
from tidewatch.plans.baseline import DECISION_SCHEMA, BaselineWorkflow, EachVersion, GroupedMonitor
from tidewatch.plans.job import Monitor, RunContext
from tidewatch.plans.runs import DataQuality
from tidewatch.sources.sinks import REGISTRY_SCHEMA, MonitorStore

MANIFEST = "project string, model_version string, artifacts map<string,string>, problem string"
CONFIG = "project string, monitor string, enabled boolean, required boolean"
FULL = dict.fromkeys(["training_snapshot", "predictions", "model", "evaluation_results"], "k")
ROWS = "project string, model_version string, x double"


@pytest.fixture(scope="module")
def fleet(spark):
    """Eight versions of one project and one of another; rows for all but version 6."""
    manifests = [("p", str(v), FULL, None) for v in range(1, 8)] + [("p", "8", {"model": "k"}, None), ("q", "1", FULL, "unknown field")]
    config = [("p", "data_quality", True, True), ("p", "shadow", True, False), ("p", "bias", False, True), ("q", "data_quality", True, True)]
    rows = [("p", str(v), float(k)) for v in (1, 2, 3, 4, 5, 7, 8) for k in range(v)]
    return spark.createDataFrame(manifests, MANIFEST), spark.createDataFrame(config, CONFIG), spark.createDataFrame(rows, ROWS)


class Watched:
    """A monitor that notes which versions it was asked for, and may raise."""

    def __init__(self, inner, error=None):
        self.inner, self.error, self.asked = inner, error, []

    def evaluate(self, versions):
        self.asked.append(sorted(r["model_version"] for r in versions.collect()))
        if self.error is not None:
            raise self.error
        return self.inner.evaluate(versions)


def high(rows):
    return GroupedMonitor(rows, {"largest": F.max("x")}, {"largest": lambda m: m > 5.5})


def broken_for(rows, version):
    return GroupedMonitor(rows, {"x": F.max(F.when(F.col("model_version") == version, F.raise_error(F.lit("bad rows"))).otherwise(F.col("x")))}, {})


def by_version(frame):
    return {(r["project"], r["model_version"]): r for r in frame.collect()}


def test_from_manifests_to_registry(spark, fleet, tmp_path):
    manifests, config, rows = fleet
    flow = BaselineWorkflow(MonitorStore(str(tmp_path)), {"data_quality": high(rows), "shadow": high(rows.limit(0))}, "e1")
    table = by_version(flow.run(manifests, config))
    assert {k: r["status"] for k, r in table.items()} == {
        **{("p", str(v)): "approved" for v in range(1, 6)}, ("p", "6"): "rejected", ("p", "7"): "rejected", ("p", "8"): "rejected", ("q", "1"): "rejected",
    }
    decided = by_version(flow.decisions(spark))
    assert decided["p", "1"]["message"] == registry.RESULTS_PASSED
    assert decided["p", "6"]["message"] == "Required analysers failed: data_quality (skipped_no_input)"
    assert decided["p", "6"]["skipped"] == ["data_quality"] and decided["p", "6"]["missing"] == []
    assert decided["p", "7"]["message"] == "Required analysers failed: data_quality (succeeded_with_violations)"
    assert decided["p", "8"]["message"].startswith("Baseline gating failed: 1") and decided["p", "8"]["analysers"] == {}
    assert decided["q", "1"]["message"] == "Gate logic error: unknown field"
    largest = {r["model_version"]: (r["metrics"] or {}).get("largest") for r in flow.results(spark).where("analyser = 'data_quality'").collect()}
    assert largest == {"1": 0, "2": 1, "3": 2, "4": 3, "5": 4, "6": None, "7": 6}
    assert table["p", "1"]["analysers"] == {"data_quality": "succeeded", "shadow": "skipped_no_input"}


def test_one_failing_version_is_told_apart(spark, fleet, tmp_path):
    manifests, config, rows = fleet
    flow = BaselineWorkflow(MonitorStore(str(tmp_path)), {"data_quality": broken_for(rows, "3"), "shadow": broken_for(rows, "2")}, "e1")
    table = by_version(flow.run(manifests, config))
    results = {(r["model_version"], r["analyser"]): r for r in flow.results(spark).collect()}
    assert results["3", "data_quality"]["outcome"] == "failed_unhandled" and "bad rows" in results["3", "data_quality"]["message"]
    assert {v for (v, a), r in results.items() if r["outcome"] == "failed_unhandled"} == {"2", "3"}
    assert table["p", "3"]["status"] == "rejected" and table["p", "2"]["status"] == "approved"  # shadow is not required
    assert [table["p", v]["status"] for v in "1457"] == ["approved"] * 4


def test_planned_without_report_is_missing_and_unplanned_is_told(spark, fleet, tmp_path):
    manifests, config, rows = fleet
    flow = BaselineWorkflow(MonitorStore(str(tmp_path)), {"shadow": high(rows)}, "e1", required=["bias"])
    flow.run(manifests.where("model_version = '1' and project = 'p'"), config)
    row = flow.decisions(spark).first()
    assert (row["missing"], row["unplanned"], row["skipped"]) == (["data_quality"], ["bias"], [])
    assert row["message"] == "Required analysers failed: data_quality (missing), bias (missing)"


class Died(BaseException):
    """The driver going away."""


def test_a_rerun_goes_on_where_the_job_died(spark, fleet, tmp_path):
    manifests, config, rows = fleet
    store = MonitorStore(str(tmp_path))
    good, dying = Watched(high(rows)), Watched(high(rows), Died())
    with pytest.raises(Died):
        BaselineWorkflow(store, {"data_quality": good, "shadow": dying}, "e1").run(manifests, config)
    assert store.registry(spark).count() == 0 and good.asked == [["1", "2", "3", "4", "5", "6", "7"]]
    again, late = Watched(high(rows)), Watched(high(rows))
    flow = BaselineWorkflow(store, {"data_quality": again, "shadow": late}, "e2")
    more = manifests.union(spark.createDataFrame([("p", "9", FULL, None)], MANIFEST))
    assert flow.run(more, config).count() == 10
    assert again.asked == [["9"]] and late.asked == [["1", "2", "3", "4", "5", "6", "7", "9"]]
    before = sorted(map(str, store.registry(spark).collect()))
    third = Watched(high(rows))
    BaselineWorkflow(store, {"data_quality": third, "shadow": third}, "e3").run(more, config)
    assert third.asked == [[], []] and sorted(map(str, store.registry(spark).collect())) == before


def test_a_run_with_nothing_due_reads_no_rows(spark, fleet, tmp_path):
    manifests, config, rows = fleet
    store = MonitorStore(str(tmp_path))
    BaselineWorkflow(store, {"data_quality": high(rows), "shadow": high(rows)}, "e1").run(manifests, config)

    class Planned:
        def __init__(self):
            self.plans = []

        def evaluate(self, versions):
            found = high(rows).evaluate(versions)
            self.plans.append(found._jdf.queryExecution().optimizedPlan().toString())
            return found

    idle = Planned()
    BaselineWorkflow(store, {"data_quality": idle, "shadow": idle}, "e2").run(manifests, config)
    assert len(idle.plans) == 2 and all(p.startswith("LocalRelation <empty>") for p in idle.plans)


def test_the_newest_of_repeated_results_decides(spark, fleet, tmp_path, monkeypatch):
    manifests, config, rows = fleet
    store = MonitorStore(str(tmp_path))
    low = GroupedMonitor(rows, {"largest": F.max("x")}, {"largest": lambda m: m > -1})
    mark = BaselineWorkflow._mark

    def dies(self, versions, step):
        if step.startswith("monitor:"):
            raise Died
        mark(self, versions, step)

    monkeypatch.setattr(BaselineWorkflow, "_mark", dies)
    with pytest.raises(Died):
        BaselineWorkflow(store, {"data_quality": low}, "e1").run(manifests, config)
    monkeypatch.undo()
    table = by_version(BaselineWorkflow(store, {"data_quality": high(rows)}, "e2").run(manifests, config))
    assert table["p", "1"]["status"] == "approved" and table["p", "1"]["analysers"] == {"data_quality": "succeeded"}


def test_rows_without_a_marker_are_written_anew(spark, fleet, tmp_path, monkeypatch):
    manifests, config, rows = fleet
    store = MonitorStore(str(tmp_path))
    flow = BaselineWorkflow(store, {"data_quality": high(rows), "shadow": high(rows)}, "e1")
    mark = BaselineWorkflow._mark

    def dies(self, versions, step):
        if step == "decision":
            raise Died
        mark(self, versions, step)

    monkeypatch.setattr(BaselineWorkflow, "_mark", dies)
    with pytest.raises(Died):
        flow.run(manifests, config)
    monkeypatch.undo()
    assert flow.run(manifests, config).count() == 9 and flow.decisions(spark).count() == 9
    assert store.inserted(spark, "baseline_decisions", DECISION_SCHEMA).count() == 18


def test_what_was_not_told_apart_stays_open(spark, fleet, tmp_path):
    manifests, config, rows = fleet
    store = MonitorStore(str(tmp_path))
    bad = Watched(high(rows), RuntimeError("no connection"))
    flow = BaselineWorkflow(store, {"data_quality": bad, "shadow": high(rows)}, "e1", failures=2)
    table = by_version(flow.run(manifests, config))
    assert len(bad.asked) == 2 and set(table) == {("p", "8"), ("q", "1")}  # the gate had rejected these
    assert BaselineWorkflow(store, {"data_quality": high(rows), "shadow": high(rows)}, "e2").run(manifests, config).count() == 9


def test_a_full_analysis_per_version(spark, fleet, tmp_path):
    manifests, config, rows = fleet
    store = MonitorStore(str(tmp_path))

    def make(project, version):
        own = rows.where((F.col("project") == project) & (F.col("model_version") == version)).select("x")
        context = RunContext(f"run-{version}", "dq", project, "prod", model_version=version)
        return Monitor(DataQuality(), context, {"current": own, "baseline": own}, {"numeric_columns": ["x"]})

    flow = BaselineWorkflow(store, {"data_quality": EachVersion(spark, store, make), "shadow": high(rows)}, "e1")
    table = by_version(flow.run(manifests.where("model_version in ('4', '5') and project = 'p'"), config))
    assert [table["p", v]["analysers"]["data_quality"] for v in "45"] == ["succeeded"] * 2
    assert store.outcomes(spark).count() == 2


def test_no_manifests(spark, fleet, tmp_path):
    manifests, config, rows = fleet
    assert BaselineWorkflow(MonitorStore(str(tmp_path)), {"data_quality": high(rows)}, "e1").run(manifests.limit(0), config).count() == 0


def test_racing_writers_leave_one_row_a_version(spark, tmp_path):
    store = MonitorStore(str(tmp_path))
    row = lambda status, day, run: ("p", "1", status, "base", {"dq": "ok"}, "m", datetime(2024, 1, day), run)
    for late in (row("rejected", 3, "a"), row("approved", 2, "b"), row("rejected", 2, "c")):  # none saw another's row
        spark.createDataFrame([late], REGISTRY_SCHEMA).write.mode("append").parquet(store.path("registry"))
    rows = store.registry(spark).collect()
    assert [(r["status"], r["execution_id"]) for r in rows] == [("approved", "b")]
    after = store.append_registry(spark, spark.createDataFrame([row("rejected", 1, "d")], REGISTRY_SCHEMA)).collect()
    assert [(r["status"], r["execution_id"]) for r in after] == [("approved", "b")]
