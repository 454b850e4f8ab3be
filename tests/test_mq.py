import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import mq, truth
from tidewatch.plans.runs import ModelQuality
from tidewatch.spec import ModelQualitySpec, SpecError


def predictions(spark, rows, schema="label string, prediction string, p double"):
    return spark.createDataFrame(rows, schema)


def values(analysis):
    return {r["name"]: r["value"] for r in analysis.metrics.collect()}


def test_confusion_is_dense_and_sums_up(spark):
    rows = [(0, 0), (0, 1), (1, 1), (2, 1), (2, 2), (2, 2)]
    df = spark.createDataFrame(rows, "label bigint, prediction bigint")
    matrix = mq.confusion_matrix(mq.confusion_counts(df, "label", "prediction")).collect()
    assert len(matrix) == 9 and sum(r["n"] for r in matrix) == 6
    assert sum(r["n"] for r in matrix if r["label"] == "2") == 3
    assert {(r["label"], r["prediction"]): r["n"] for r in matrix}[("0", "2")] == 0


def test_multiclass_scores_by_hand(spark):
    df = predictions(spark, [("a", "a", None), ("a", "b", None), ("b", "b", None), ("c", "b", None)])
    config = {"problem_type": "multiclass", "label_column": "label", "prediction_column": "prediction"}
    got = values(ModelQuality().compute({"predictions": df}, config))
    assert got["mq/accuracy"] == 0.5
    assert got["mq/precision_macro"] == pytest.approx((1 + 1 / 3 + 0) / 3)
    assert got["mq/recall_macro"] == pytest.approx((0.5 + 1 + 0) / 3)
    assert got["mq/f1_macro"] == pytest.approx((2 / 3 + 0.5 + 0) / 3)
    assert got["mq/precision_per_class/c"] == 0 and got["mq/recall_per_class/b"] == 1
    assert "mq/auc" not in got


def test_rows_with_nulls_are_counted_not_scored(spark):
    df = predictions(spark, [("a", "a", None), (None, "a", None), ("b", None, None)])
    config = {"problem_type": "binary", "label_column": "label", "prediction_column": "prediction"}
    got = values(ModelQuality().compute({"predictions": df}, config))
    assert got["mq/rows_dropped"] == 2 and got["mq/accuracy"] == 1


def test_integer_and_float_classes_are_the_same(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 1.0), (0, 0.0)], "label bigint, prediction double")
    assert mq.confusion_matrix(mq.confusion_counts(df, "label", "prediction")).count() == 4


def brute_auc(rows):
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("partitions", ["1", "8", "61"])
def test_auc_equals_pair_counting(spark, partitions):
    rng = random.Random(2)
    rows = [(round(rng.random(), 2), rng.random() < 0.3) for _ in range(600)] + [(0.5, rng.random() < 0.5) for _ in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, "score double, positive boolean").repartition(5)
        auc = mq.auc_of(df).first()["auc"]
        flipped = mq.auc_of(df.withColumn("score", 1 - F.col("score"))).first()["auc"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert auc == pytest.approx(brute_auc(rows), abs=1e-12)
    assert flipped == pytest.approx(1 - auc, abs=1e-12)


def test_auc_defaults_to_the_largest_label_and_skips_single_class(spark):
    config = {"problem_type": "binary", "label_column": "label", "prediction_column": "prediction", "probability_columns": ["p"]}
    df = predictions(spark, [("no", "no", 0.1), ("yes", "yes", 0.9)])
    assert values(ModelQuality().compute({"predictions": df}, config))["mq/auc"] == 1
    assert values(ModelQuality().compute({"predictions": df}, {**config, "positive_label": "no"}))["mq/auc"] == 0
    single = predictions(spark, [("yes", "no", 0.1), ("yes", "yes", 0.9)])
    assert "mq/auc" not in values(ModelQuality().compute({"predictions": single}, config))
    assert "mq/auc" not in values(ModelQuality().compute({"predictions": df}, {**config, "probability_columns": ["absent"]}))


def test_degradation_is_strict_and_prefix_free(spark):
    df = predictions(spark, [("a", "a", None)] * 3 + [("b", "a", None)])
    config = {
        "problem_type": "binary",
        "label_column": "label",
        "prediction_column": "prediction",
        "baseline_metrics": {"accuracy": 0.80, "mq/recall_macro": 0.9, "f1_macro": 0.99, "nothing": 1.0},
        "degradation_thresholds": {"accuracy": 0.05, "mq/recall_macro": 0.1, "nothing": 0.0},
    }
    analysis = ModelQuality().compute({"predictions": df}, config)
    deltas = {r["metric"]: r["delta"] for r in analysis.details["baseline_delta"].collect()}
    assert set(deltas) == {"accuracy", "mq/recall_macro", "f1_macro"}
    assert deltas["accuracy"] == pytest.approx(-0.05)
    # 0.75 < 0.80 - 0.05 holds only by floating point; recall 0.5 < 0.8 does
    assert "mq/recall_macro" in {v["subject"] for v in analysis.violations.collect()}


@pytest.mark.parametrize(("drops", "severity"), [(0, "info"), (1, "warn"), (2, "alert")])
def test_severity_follows_the_count(spark, drops, severity):
    df = predictions(spark, [("a", "a", None), ("b", "a", None)])
    names = ["accuracy", "f1_macro"][:drops]
    config = {
        "problem_type": "binary",
        "label_column": "label",
        "prediction_column": "prediction",
        "baseline_metrics": dict.fromkeys(names, 1.0),
        "degradation_thresholds": dict.fromkeys(names, 0.1),
    }
    row = ModelQuality().compute({"predictions": df}, config).outcome.first()
    assert (row["severity"], row["violation_count"]) == (severity, drops)


def test_constraints_feed_the_next_run(spark):
    good = predictions(spark, [("a", "a", None), ("b", "b", None)])
    bad = predictions(spark, [("a", "a", None), ("b", "a", None)])
    config = {"problem_type": "binary", "label_column": "label", "prediction_column": "prediction"}
    stored = mq.constraints(mq.measure(good, ModelQualitySpec.from_dict(config)), 0.1)
    assert ModelQuality(stored).compute({"predictions": good}, config).outcome.first()["violation_count"] == 0
    assert ModelQuality(stored).compute({"predictions": bad}, config).outcome.first()["violation_count"] == 4


def test_a_label_from_before_its_capture_does_not_count(spark):
    from datetime import datetime

    captures = spark.createDataFrame([("a", datetime(2024, 1, 5)), ("b", datetime(2024, 1, 5))], "inference_id string, ts timestamp")
    labels = [("a", datetime(2024, 1, 4), "old"), ("b", datetime(2024, 1, 4), "old"), ("b", datetime(2024, 1, 6), "new"), ("b", datetime(2023, 1, 6), "far")]
    joined = truth.join_truth(captures, spark.createDataFrame(labels, "inference_id string, label_ts timestamp, label string"), datetime(2024, 1, 10), "7d")
    assert {(r["inference_id"], r["label"]) for r in joined.collect()} == {("a", None), ("b", "new")}


def test_truth_takes_the_newest_known_label(spark):
    from datetime import datetime

    captures = spark.createDataFrame(
        [("1", datetime(2024, 1, 9)), ("2", datetime(2024, 1, 8)), ("3", datetime(2023, 12, 1))], "inference_id string, ts timestamp"
    )
    labels = spark.createDataFrame(
        [("1", "old", datetime(2024, 1, 9, 1)), ("1", "new", datetime(2024, 1, 9, 2)), ("1", "future", datetime(2024, 2, 1))],
        "inference_id string, label string, label_ts timestamp",
    )
    joined = truth.join_truth(captures, labels, datetime(2024, 1, 10), "7d")
    assert {r["inference_id"]: r["label"] for r in joined.collect()} == {"1": "new", "2": None}
    gate = truth.coverage(joined).first()
    assert (gate["captured"], gate["matched"], gate["coverage"], gate["outcome"]) == (2, 1, 0.5, "succeeded")
    low = truth.coverage(joined, 0.51).first()
    assert (low["outcome"], low["severity"]) == ("skipped_insufficient_data", "warn")
    assert truth.coverage(joined.limit(0)).first()["outcome"] == "skipped_no_input"
    with pytest.raises(ValueError):
        truth.interval("week")


def test_problem_type_is_checked():
    with pytest.raises(SpecError):
        ModelQualitySpec.from_dict({"problem_type": "ranking", "label_column": "a", "prediction_column": "b"})
    with pytest.raises(SpecError):
        ModelQualitySpec.from_dict({"problem_type": "binary"})


def labelled_run(spark, labels, **config):
    captures = spark.createDataFrame([(f"c{k}", datetime(2024, 1, k + 1), "yn"[k % 2]) for k in range(10)], "inference_id string, ts timestamp, prediction string")
    rows = spark.createDataFrame(labels, "inference_id string, label string, label_ts timestamp")
    spec = {"problem_type": "binary", "label_column": "truth", "prediction_column": "prediction", "labels_input": "labels", "lookback": "30d", "as_of": "2024-01-20", **config}
    return ModelQuality().compute({"predictions": captures, "labels": rows}, spec)


def test_a_run_that_joins_late_labels(spark):
    labels = [(f"c{k}", "y", datetime(2024, 1, 15)) for k in range(4)] + [("c0", "n", datetime(2024, 1, 16)), ("c9", "y", datetime(2024, 2, 1)), ("zz", "y", datetime(2024, 1, 3))]
    run = labelled_run(spark, labels, baseline_metrics={"accuracy": 0.9}, degradation_thresholds={"accuracy": 0.1})
    values = {r["name"]: r["value"] for r in run.metrics.collect()}
    assert (values["mq/captured"], values["mq/matched"], values["mq/coverage"], values["mq/accuracy"]) == (10, 4, 0.4, 0.25)
    row = run.outcome.first()
    assert (row["outcome"], row["severity"], row["violation_count"]) == ("succeeded_with_violations", "warn", 1)
    few = labelled_run(spark, labels, min_coverage=0.5, baseline_metrics={"accuracy": 0.9}, degradation_thresholds={"accuracy": 0.1})
    row = few.outcome.first()
    assert (row["outcome"], row["severity"], row["violation_count"]) == ("skipped_insufficient_data", "warn", 0)
    assert few.violations.count() == 0 and few.details["ground_truth"].first()["matched"] == 4


def test_no_captures_in_the_lookback(spark):
    row = labelled_run(spark, [], as_of="2023-01-01").outcome.first()
    assert (row["outcome"], row["severity"]) == ("skipped_no_input", "info")


@pytest.mark.parametrize("bad", [{"min_coverage": 2.0}, {"lookback": "7"}, {"as_of": "soon"}])
def test_label_settings_are_checked(bad):
    with pytest.raises(SpecError):
        ModelQualitySpec.from_dict({"problem_type": "binary", "label_column": "a", "prediction_column": "b", **bad})
