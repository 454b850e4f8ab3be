import json

import pytest
from pyspark.sql import functions as F

from tidewatch.plans.job import Monitor, RunContext, run_all, run_monitor
from tidewatch.plans.runs import DataQuality, Shadow
from tidewatch.result import Analysis
from tidewatch.sources.readers import read_raw_csv, read_snapshot
from tidewatch.sources.sinks import FAILURE_SCHEMA, METRIC_TABLE_SCHEMA, MonitorStore


def context(analyser, run_id="r1"):
    return RunContext(run_id, analyser, "p", "prod", model_version="3", image_digest="sha256:1", git_sha="abc")


@pytest.fixture(scope="module")
def window(spark):
    return spark.createDataFrame([(float(i % 10), "xy"[i % 2]) for i in range(100)], "v double, g string")


def monitor(window, run_id="r1"):
    inputs = {"current": window, "baseline": window}
    return Monitor(DataQuality(), context("dq", run_id), inputs, {"numeric_columns": ["v"], "categorical_columns": ["g"]})


def test_a_run_leaves_documents_metrics_and_one_outcome(spark, window, tmp_path):
    store = MonitorStore(str(tmp_path))
    result = run_monitor(spark, store, monitor(window))
    assert (result.outcome, result.severity, result.violation_count) == ("succeeded", "info", 0)
    row = store.outcomes(spark).first()
    assert (row["run_id"], row["git_sha"], row["failure_uri"]) == ("r1", "abc", None)
    assert row["duration_seconds"] > 0 and row["result_uri"].endswith("project=p/model_version=3/analyser=dq")
    document = json.loads(spark.read.text(row["result_uri"]).first()["value"])
    assert document["monitor_type"] == "DATA_QUALITY" and document["outcome"]["severity"] == "info"
    assert {m["name"] for m in document["metrics"]} == {f"dq/v/{s}" for s in ("completeness", "ks_stat", "ks_p")} | {"dq/g/completeness", "dq/g/psi"}
    metrics = store.read(spark, "metrics", METRIC_TABLE_SCHEMA)
    assert metrics.where("metric_name <> 'MetricValue'").count() == 4
    assert metrics.select("ts").distinct().collect() == [(row["started_at"],)]
    provenance = spark.read.json(store.path("provenance")).first()
    assert provenance["env_snapshot"]["RUN_ID"] == "r1"


def test_a_repeated_run_is_read_once(spark, window, tmp_path):
    store = MonitorStore(str(tmp_path))
    for _ in range(2):
        run_monitor(spark, store, monitor(window))
    assert store.outcomes(spark).count() == 1


class Cheating:
    def compute(self, inputs, config):
        df = inputs["current"]
        outcome = df.limit(1).select(
            F.lit("x").alias("analyser"), F.lit("failed_unhandled").alias("outcome"), F.lit("info").alias("severity"),
            F.lit(0).cast("bigint").alias("violation_count"),
        )
        empty = df.sparkSession.createDataFrame([], "name string, value double")
        return Analysis("x", empty, empty, outcome)


def test_failures_stay_with_their_monitor(spark, window, tmp_path):
    store = MonitorStore(str(tmp_path))
    broken = Monitor(DataQuality(), context("mq"), {"current": window}, {})
    misspelt = Monitor(Shadow(), context("shadow"), {}, {"problem": "binary"})
    cheating = Monitor(Cheating(), context("bias"), {"current": window}, {})
    results = run_all(spark, store, [broken, monitor(window), misspelt, cheating], parallel=3)
    assert [r.outcome for r in results] == ["failed_unhandled", "succeeded", "failed_unhandled", "failed_unhandled"]
    failures = {r["analyser_type"]: r for r in store.read(spark, "failures", FAILURE_SCHEMA).collect()}
    assert failures["mq"]["exception_class"] == "SpecError" and "baseline" in failures["mq"]["message"]
    assert failures["bias"]["exception_class"] == "ContractError"
    assert "Traceback" in failures["shadow"]["traceback"] and failures["shadow"]["env_snapshot"]["PROJECT_NAME"] == "p"
    alerts = store.outcomes(spark).where("severity = 'alert'").collect()
    assert {r["analyser_type"] for r in alerts} == {"mq", "shadow", "bias"} and all(r["failure_uri"] for r in alerts)


def test_raw_csv(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("39, State-gov, <=50K.\n50, ?, >50K\n38, Private, >50K\n")
    df = read_raw_csv(spark, str(tmp_path / "raw.csv"), "age int, workclass string, income string", ["age", "income"], "income")
    assert [tuple(r) for r in df.collect()] == [(39, "<=50K"), (38, ">50K")]


def test_snapshot_lines(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"a": 1, "b": "x"}\n{"a": null, "b": "y", "c": 9}\n')
    rows = read_snapshot(spark, str(tmp_path / "s.jsonl"), "a bigint, b string").collect()
    assert [tuple(r) for r in rows] == [(1, "x"), (None, "y")]
