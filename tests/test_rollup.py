from datetime import datetime

from pyspark.sql import functions as F

from tidewatch.functions.severity import severity_for_count
from tidewatch.operators import prep, rollup

SCHEMA = (
    "run_id string, analyser_type string, project string, environment string, variant string, outcome string, "
    "severity string, violation_count bigint, started_at timestamp, ended_at timestamp"
)


def runs(spark, *rows):
    table = [
        (f"r{i}", "dq", "p", "prod", "v", outcome, severity, count, start, end)
        for i, (outcome, severity, count, start, end) in enumerate(rows)
    ]
    return spark.createDataFrame(table, SCHEMA)


T = datetime(2024, 1, 3, 10)


def test_default_severity_and_override(spark):
    outcomes = ["succeeded", "succeeded_with_violations", "skipped_no_input", "skipped_insufficient_data", "failed_handled", "failed_unhandled"]
    df = runs(spark, *[(o, None, 0, T, T) for o in outcomes], ("succeeded", "alert", 0, T, T))
    got = [(r["severity"], r["severity_score"]) for r in rollup.with_severity(df).orderBy("run_id").collect()]
    assert got == [("info", 0), ("warn", 1), ("info", 0), ("warn", 1), ("warn", 1), ("alert", 2), ("alert", 2)]


def test_count_severity(spark):
    df = spark.range(4).select(severity_for_count(F.col("id"), 3).alias("s"))
    assert [r["s"] for r in df.collect()] == ["info", "warn", "warn", "alert"]


def test_invalid_reports(spark):
    df = runs(spark, ("succeeded", None, 0, T, T), ("failed_unhandled", None, 0, T, T), ("fine", None, 0, T, T), ("succeeded", None, -1, T, T))
    got = {r["run_id"]: r["problem"] for r in rollup.invalid_outcomes(df).collect()}
    assert got == {"r1": "outcome reserved for the job", "r2": "unknown outcome", "r3": "negative violation count"}


def test_duration_and_standard_metrics(spark):
    df = rollup.with_duration(runs(spark, ("succeeded_with_violations", None, 2, T, datetime(2024, 1, 3, 10, 0, 1, 500000)), ("succeeded", None, 0, T, None)))
    rows = {(r["run_id"], r["metric_name"]): (r["value"], r["unit"], r["ts"]) for r in rollup.standard_metrics(df).collect()}
    assert len(rows) == 8
    assert rows[("r0", "RunDurationSeconds")] == (1.5, "Seconds", T) and rows[("r1", "RunDurationSeconds")][0] == 0
    assert rows[("r0", "ViolationCount")][:2] == (2, "Count") and rows[("r0", "Severity")][:2] == (1, "None")


def test_recent_failures_are_strictly_within_the_window(spark):
    now = datetime(2024, 1, 4, 10)
    df = runs(spark, ("failed_unhandled", None, 0, T, T), ("failed_handled", None, 0, datetime(2024, 1, 3, 11), T), ("succeeded", None, 0, now, now))
    assert [r["failures"] for r in rollup.failures_since(df, now).collect()] == [1]


def test_drift_matrix_leaves_gaps(spark):
    rows = [("age", "ks_stat", 0.1), ("age", "ks_p", 0.5), ("sex", "psi", 0.3), ("sex", "completeness", 1.0)]
    df = spark.createDataFrame(rows, "subject string, statistic string, value double")
    got = {r["column"]: (r["ks_stat"], r["ks_p"], r["psi"]) for r in rollup.drift_matrix(df).collect()}
    assert got == {"age": (0.1, 0.5, None), "sex": (None, None, 0.3)}


def test_split_and_drift_are_repeatable(spark):
    df = spark.range(2000).withColumn("v", (F.col("id") % 10).cast("double"))
    first, second = prep.split(df, "id", seed=1)
    assert first.join(second, "id").count() == 0 and first.count() + second.count() == 2000
    assert first.collect() == prep.split(df.repartition(9), "id", seed=1)[0].orderBy("id").collect()
    shifted = prep.inject_drift(df, "id", "v", 3, 12, 0, 15, seed=4)
    moved = shifted.join(df.withColumnRenamed("v", "old"), "id").select((F.col("v") - F.col("old")).alias("d"), "v")
    low, high, top = moved.agg(F.min("d"), F.max("d"), F.max("v")).first()
    assert 3 <= low and high <= 11 and top == 15
