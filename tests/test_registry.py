from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import registry
from tidewatch.sources.sinks import REGISTRY_SCHEMA, MonitorStore

MANIFEST = "project string, model_version string, artifacts map<string,string>"
CONFIG = "project string, monitor string, enabled boolean, required boolean"


def gated(spark, artifacts, settings):
    manifests = spark.createDataFrame([("p", "1", dict.fromkeys(artifacts, "k"))], MANIFEST)
    config = spark.createDataFrame([("p", *s) for s in settings], CONFIG)
    return registry.gate(manifests, config).first()


FULL = ["training_snapshot", "predictions", "model", "evaluation_results"]


@pytest.mark.parametrize(
    ("artifacts", "settings", "status", "plan"),
    [
        (FULL, [("bias", True, True), ("model_quality", True, False)], "approved", ["bias", "model_quality"]),
        (["training_snapshot"], [("bias", True, True), ("shadow", True, True)], "rejected", []),
        (["training_snapshot", "model"], [("bias", True, False), ("explainability", True, True)], "approved_with_warnings", ["explainability"]),
        (["x"], [("bias", False, True)], "approved", []),
        (["x"], [("shadow", True, True), ("custom", True, True)], "approved", ["custom", "shadow"]),
        (["x"], [("mq", True, False)], "approved_with_warnings", []),
    ],
)
def test_gate(spark, artifacts, settings, status, plan):
    row = gated(spark, artifacts, settings)
    assert (row["status"], row["monitors_to_run"]) == (status, plan)
    assert (row["message"] == registry.GATE_PASSED) == (status != "rejected")


def test_gate_counts_all_misses_in_its_message(spark):
    row = gated(spark, ["x"], [("bias", True, True), ("data_quality", True, False)])
    assert row["message"] == "Baseline gating failed: 2 required artifact(s) missing"
    assert len(row["warnings"]) == 2 and row["warnings"][0].startswith("Required monitor bias missing artifacts")


def test_gate_without_settings_approves(spark):
    manifests = spark.createDataFrame([("p", "1", {"a": "b"})], MANIFEST)
    assert registry.gate(manifests, spark.createDataFrame([], CONFIG)).first()["status"] == "approved"


@pytest.mark.parametrize(
    ("results", "status", "text"),
    [
        ({"dq": "succeeded", "mq": "ok"}, "approved", "All required analysers passed"),
        ({"dq": "succeeded"}, "rejected", "Required analysers failed: mq (missing)"),
        ({"dq": "failed_unhandled", "mq": "ok"}, "rejected", "Required analysers failed: dq (failed_unhandled)"),
        ({"dq": "succeeded_with_violations", "mq": "skipped_no_input"}, "rejected",
         "Required analysers failed: dq (succeeded_with_violations), mq (skipped_no_input)"),
    ],
)
def test_required_results(spark, results, status, text):
    versions = spark.createDataFrame([("p", "1")], "project string, model_version string")
    rows = spark.createDataFrame([("p", "1", a, o) for a, o in results.items()], "project string, model_version string, analyser string, outcome string")
    row = registry.check_results(versions, rows, ["dq", "mq"]).first()
    assert (row["status"], row["message"], row["all_required_ok"]) == (status, text, status == "approved")


def registry_row(version, status, when):
    return ("p", version, status, "base", {"dq": "ok"}, "m", when, "e")


def test_registry_is_insert_only(spark, tmp_path):
    store = MonitorStore(str(tmp_path))
    first = spark.createDataFrame([registry_row("1", "approved", datetime(2024, 1, 1))], REGISTRY_SCHEMA)
    store.append_registry(spark, first)
    again = spark.createDataFrame(
        [
            registry_row("1", "rejected", datetime(2024, 1, 2)),
            registry_row("2", "rejected", datetime(2024, 1, 4)),
            registry_row("2", "approved", datetime(2024, 1, 3)),
        ],
        REGISTRY_SCHEMA,
    )
    rows = {r["model_version"]: r["status"] for r in store.append_registry(spark, again).collect()}
    assert rows == {"1": "approved", "2": "approved"}
    endpoints = spark.createDataFrame([("e1", "p", "1"), ("e2", "p", "9")], "endpoint string, project string, model_version string")
    table = store.registry(spark)
    active = {r["endpoint"]: r for r in registry.activation(endpoints, table).collect()}
    assert active["e1"]["activate"] and active["e1"]["analysers"] == {"dq": "ok"} and active["e1"]["reason"] is None
    assert active["e2"]["reason"] == "Model version 9 not found in baseline registry for project p"
    assert [r["endpoint"] for r in registry.active_endpoints(endpoints, table).collect()] == ["e1"]


def test_rejected_versions_stay_inactive(spark):
    table = spark.createDataFrame([registry_row("1", "rejected", datetime(2024, 1, 1))], REGISTRY_SCHEMA)
    endpoints = spark.createDataFrame([("p", "1")], "project string, model_version string")
    row = registry.activation(endpoints, table).first()
    assert (row["activate"], row["reason"], row["baseline_prefix"]) == (False, "Baseline rejected", None)


def test_versions_compare_as_numbers(spark):
    keys = [("a/v2/config.json",), ("a/v10/config.json",), ("b/c/v1/config.json",), ("broken",)]
    rows = registry.latest_versions(spark.createDataFrame(keys, "key string")).collect()
    assert {(r["project"], r["version"]) for r in rows} == {("a", 10), ("b/c", 1)}


GOOD = (
    '{"project": "p", "model_version": "7", "produced_at": "2024-01-02T03:04:05Z",'
    ' "provenance": {"git_sha": "a", "pipeline_run_id": "r"}, "artifacts": {"model": "m"}}'
)


@pytest.mark.parametrize(
    ("old", "new", "problem"),
    [
        ("", "", None),
        ('"project": "p"', '"project": ""', "project is missing or empty"),
        ('"project": "p"', '"project": 7', "project is missing or empty"),
        ('"model_version": "7", ', "", "model_version is missing or empty"),
        ('{"project"', '{"schema_version": "2", "project"', "unsupported schema_version"),
        ('{"project"', '{"schema_version": 1, "project"', "unsupported schema_version"),
        ('{"project"', '{"owner": "x", "project"', "unknown field"),
        ("2024-01-02T03:04:05Z", "soon", "produced_at is no timestamp"),
        ('"git_sha": "a", ', "", "provenance.git_sha is missing or empty"),
        ('"git_sha"', '"who": "x", "git_sha"', "unknown provenance field"),
        ('{"model": "m"}', "{}", "artifacts are missing or empty"),
        ('{"model": "m"}', '{"model": null}', "artifacts hold a value that is no text"),
        ('{"model": "m"}', '["m"]', "artifacts are missing or empty"),
        ("}}", "}", "not a JSON object"),
    ],
)
def test_manifests(spark, old, new, problem):
    documents = spark.createDataFrame([(GOOD.replace(old, new, 1) if old else GOOD,)], "document string")
    valid, rejects = registry.read_manifests(documents)
    if problem is None:
        row = valid.first()
        assert (row["schema_version"], row["project"], row["artifacts"]) == ("1", "p", {"model": "m"})
        assert rejects.count() == 0
    else:
        assert valid.count() == 0 and rejects.first()["problem"] == problem
