import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.kolmogorov import asymptotic_pvalue, exact_tail_function
from tidewatch.operators import dq, statistics
from tidewatch.plans.runs import DataQuality
from tidewatch.spec import DataQualitySpec, SpecError

NUMERIC = ["age", "hours"]
CATEGORICAL = ["workclass", "sex", "education"]
SCHEMA = "age bigint, hours bigint, workclass string, sex string, education string"


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(1)
    rows = [
        (
            rng.randint(17, 90),
            rng.randint(1, 99),
            rng.choice(["Private", "State", "Self"]),
            "Male" if rng.random() < 0.67 else "Female",
            rng.choice(["HS", "BSc", "MSc"]),
        )
        for _ in range(3000)
    ]
    return spark.createDataFrame(rows, SCHEMA).cache()


def run(current, baseline, **changes):
    config = {"numeric_columns": NUMERIC, "categorical_columns": CATEGORICAL, **changes}
    return DataQuality().compute({"current": current, "baseline": baseline}, config)


def metric(analysis, name):
    return analysis.metrics.where(F.col("name") == name).first()["value"]


def test_identical_windows_are_clean(people):
    analysis = run(people, people)
    row = analysis.outcome.first()
    assert (row["outcome"], row["severity"], row["violation_count"]) == ("succeeded", "info", 0)
    values = {r["name"]: r["value"] for r in analysis.metrics.collect()}
    assert {f"dq/{c}/{s}" for c in NUMERIC for s in ("completeness", "ks_stat", "ks_p")} <= set(values)
    assert {f"dq/{c}/psi" for c in CATEGORICAL} <= set(values)
    assert values["dq/age/ks_stat"] == 0 and values["dq/age/ks_p"] == 1
    assert values["dq/sex/psi"] == pytest.approx(0, abs=1e-12)


def test_shifted_numbers_drift(people):
    analysis = run(people.withColumn("age", F.col("age") + 30), people)
    assert "numeric_drift" in {v["type"] for v in analysis.violations.collect()}
    assert metric(analysis, "dq/age/ks_p") < 0.05


def test_collapsed_category_drifts(people):
    analysis = run(people.withColumn("sex", F.lit("Male")), people)
    assert "categorical_drift" in {v["type"] for v in analysis.violations.collect()}
    assert metric(analysis, "dq/sex/psi") > 0.2


def test_nulls_break_completeness(people):
    current = people.withColumn("workclass", F.when(F.pmod(F.hash("age", "hours"), F.lit(5)) != 0, F.col("workclass")))
    found = run(current, people).violations.where("type = 'completeness'").collect()
    assert [v["subject"] for v in found] == ["workclass"] and found[0]["value"] < 0.99


def test_missing_column_is_reported_and_skipped(people):
    analysis = run(people.drop("education"), people)
    found = analysis.violations.collect()
    assert [(v["type"], v["subject"]) for v in found] == [("schema_missing", "education")]
    assert analysis.metrics.where(F.col("subject") == "education").count() == 0


def test_three_drifts_alert(people):
    current = people.withColumn("age", F.col("age") + 50).withColumn("hours", F.col("hours") + 30).withColumn("sex", F.lit("Male"))
    assert run(current, people, severity_threshold=2).outcome.first()["severity"] == "alert"


def test_empty_window_is_incomplete(people):
    analysis = run(people.limit(0), people)
    assert metric(analysis, "dq/age/completeness") == 0.0
    assert analysis.metrics.where("statistic = 'ks_stat'").count() == 0


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (2.0,)], "x double")
    assert dq.completeness(df, ["x"]).first()["completeness"] == 0.5


def test_unparsable_text_is_dropped_for_ks(spark):
    current = spark.createDataFrame([("1",), ("2",), ("n/a",), ("3",)], "x string")
    baseline = spark.createDataFrame([("1",), ("2",), ("3",)], "x string")
    row = dq.ks_statistic(current, baseline, ["x"]).first()
    assert (row["ks_stat"], row["n"], row["m"]) == (0.0, 3, 3)


def test_psi_by_hand_with_null_and_new_category(spark):
    current = spark.createDataFrame([("a",)] * 5 + [(None,)] * 3 + [("new",)] * 2, "g string")
    baseline = spark.createDataFrame([("a",)] * 8 + [(None,)] * 2, "g string")
    expected = sum((p - q) * math.log(p / q) for p, q in ((0.5, 0.8), (0.3, 0.2), (0.2, 1e-6)))
    assert dq.population_stability(current, baseline, ["g"]).first()["psi"] == pytest.approx(expected)


def brute_ks(a, b):
    return max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in {*a, *b})


@pytest.mark.parametrize("partitions", ["1", "8", "61"])
def test_ks_equals_brute_force_for_any_partitioning(spark, partitions):
    rng = random.Random(5)
    a = [round(rng.gauss(0, 1), 2) for _ in range(700)] + [0.5] * 400  # one value holds a third of the rows
    b = [round(rng.gauss(0.2, 1.3), 2) for _ in range(500)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        frames = [spark.createDataFrame([(x,) for x in side], "x double").repartition(7) for side in (a, b)]
        there = dq.ks_statistic(*frames, ["x"]).first()["ks_stat"]
        back = dq.ks_statistic(*frames[::-1], ["x"]).first()["ks_stat"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert there == pytest.approx(brute_ks(a, b), abs=1e-12)
    assert back == pytest.approx(there, abs=1e-12)


def test_exact_pvalue_against_all_arrangements():
    from itertools import combinations

    tail = exact_tail_function()
    for n, m in ((3, 4), (5, 5), (4, 6)):
        for steps in range(1, n * m + 1):
            d = steps / (n * m)
            hits = total = 0
            for picked in combinations(range(n + m), n):
                x, y, worst = 0, 0, 0.0
                chosen = set(picked)
                for i in range(n + m):
                    x, y = (x + 1, y) if i in chosen else (x, y + 1)
                    worst = max(worst, abs(x * m - y * n))
                hits += worst >= round(d * n * m)
                total += 1
            # the statistic takes multiples of 1 / lcm only; compare on those
            if (d * math.lcm(n, m)) % 1 < 1e-9:
                assert tail(d, n, m) == pytest.approx(hits / total, abs=1e-12)


def one_sample_law(n, d):
    """P(D_n < d) by Durbin's matrix, as published by Marsaglia, Tsang and Wang (2003)."""
    import numpy as np

    k = int(n * d) + 1
    m, h = 2 * k - 1, k - n * d
    matrix = np.fromfunction(lambda i, j: (i - j + 1 >= 0).astype(float), (m, m))
    for i in range(m):
        matrix[i, 0] -= h ** (i + 1)
        matrix[m - 1, i] -= h ** (m - i)
    matrix[m - 1, 0] += (2 * h - 1) ** m if 2 * h > 1 else 0
    for i in range(m):
        for j in range(m):
            if i - j + 1 > 0:
                matrix[i, j] /= math.factorial(i - j + 1)
    power = np.linalg.matrix_power(matrix, n)
    return power[k - 1, k - 1] * math.exp(math.lgamma(n + 1) - n * math.log(n))


def test_asymptotic_matches_the_one_sample_law_of_the_effective_size(spark):
    cases = [(d, 200, 200) for d in (0.05, 0.08, 0.1, 0.13, 0.16, 0.2)]
    rows = spark.createDataFrame(cases, "d double, n bigint, m bigint")
    for row in rows.select("*", asymptotic_pvalue(F.col("d"), F.col("n"), F.col("m")).alias("p")).collect():
        assert row["p"] == pytest.approx(1 - one_sample_law(100, row["d"]), abs=1e-5)


def test_asymptotic_is_close_to_exact_for_large_samples(spark):
    tail = exact_tail_function()
    cases = [(d / 1000, 3000, 3001) for d in (15, 22, 30, 35, 45)]
    rows = spark.createDataFrame(cases, "d double, n bigint, m bigint")
    for row in rows.select("*", asymptotic_pvalue(F.col("d"), F.col("n"), F.col("m")).alias("p")).collect():
        assert row["p"] == pytest.approx(tail(row["d"], row["n"], row["m"]), abs=6e-3)


def test_exact_distinct_profile(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.0, None), (3.0, "b"), (float("nan"), "b")], "x double, g string")
    rows = {r["column"]: r for r in dq.profile(df, ["x", "g"], exact_distinct=True).collect()}
    assert (rows["x"]["null_count"], rows["x"]["distinct_count"], rows["x"]["mean"]) == (1, 2, pytest.approx(5 / 3))
    assert (rows["g"]["null_count"], rows["g"]["distinct_count"], rows["g"]["mean"]) == (1, 2, None)
    approximate = {r["column"]: r["distinct_count"] for r in dq.profile(df, ["x", "g"]).collect()}
    assert approximate == {"x": 2, "g": 2}


def test_spec_is_strict():
    with pytest.raises(SpecError):
        DataQualitySpec.from_dict({"colums": []})
    with pytest.raises(SpecError):
        DataQualitySpec.from_dict({"completeness_threshold": 1.5})
    with pytest.raises(SpecError):
        DataQuality().compute({}, {})


def test_column_names_need_no_care(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "`a.b` double, `odd name` string")
    analysis = run(df, df, numeric_columns=["a.b"], categorical_columns=["odd name"])
    assert analysis.outcome.first()["violation_count"] == 0
    assert metric(analysis, "dq/a.b/ks_stat") == 0


def test_a_full_run_reads_each_side_once(spark, tmp_path):
    """All measures read the counts that one job has written from one scan a side."""
    for name in ("live", "base"):
        spark.range(300).select((F.col("id") % 50).cast("double").alias("v"), F.col("id").cast("string").alias("t"), (F.col("id") % 3).cast("string").alias("g")).write.parquet(str(tmp_path / name))
    live, base = (spark.read.parquet(str(tmp_path / name)) for name in ("live", "base"))
    spec = DataQualitySpec.from_dict({"numeric_columns": ["v", "t"], "categorical_columns": ["g", "t"]})
    cells = dq._cells(live, base, ["v", "t"], ["g", "t"])
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and plan.count("Exchange hashpartitioning") == 1
    metrics = dq.measure(live, base, spec)
    inputs = " ".join(metrics.inputFiles())
    assert str(tmp_path / "live") not in inputs and str(tmp_path / "base") not in inputs
    values = {r["name"]: r["value"] for r in metrics.collect()}
    assert values == {f"dq/{c}/completeness": 1.0 for c in "vtg"} | {f"dq/{c}/ks_stat": 0.0 for c in "vt"} | {f"dq/{c}/ks_p": 1.0 for c in "vt"} | {f"dq/{c}/psi": 0.0 for c in "gt"}


def test_a_full_run_on_no_live_rows(spark):
    base = spark.createDataFrame([(1.0, "a")], "v double, g string")
    spec = DataQualitySpec.from_dict({"numeric_columns": ["v", "gone"], "categorical_columns": ["g"]})
    values = {r["name"]: r["value"] for r in dq.measure(base.limit(0), base.drop("v"), spec).collect()}
    assert values["dq/v/completeness"] == 0.0 and values["dq/g/completeness"] == 0.0 and "dq/gone/completeness" not in values


DAYS = "day date, x double, t string, g string"


def days_of(spark, count=30, each=400):
    rng = random.Random(4)
    rows = [(date(2024, 1, 1) + timedelta(days=d), None if rng.random() < 0.1 else 1e6 + rng.gauss(d, 3), rng.choice(["1", "2.5", "n/a"]), rng.choice("abc")) for d in range(count) for _ in range(each)]
    return spark.createDataFrame(rows, DAYS)


def test_merged_days_equal_one_pass(spark):
    rows = days_of(spark)
    daily = statistics.daily_summaries(rows, F.col("day"), ["x", "t", "g"], ["x", "t"])
    assert daily.count() == 90 and daily.schema.simpleString() == spark.createDataFrame([], statistics.SUMMARY_SCHEMA).schema.simpleString()
    found = {r["column"]: r for r in statistics.profile(statistics.merged_summaries(daily)).collect()}
    want = {r["column"]: r for r in dq.profile(rows, ["x", "t", "g"], exact_distinct=True).collect()}
    for c in "xtg":
        assert (found[c]["row_count"], found[c]["null_count"]) == (want[c]["row_count"], want[c]["null_count"])
        assert found[c]["distinct_count"] == pytest.approx(want[c]["distinct_count"], rel=0.03)
    for name in ("min", "max", "mean", "stddev"):
        assert found["x"][name] == pytest.approx(want["x"][name], rel=1e-9)
    assert found["x"]["median"] == pytest.approx(want["x"]["median"], abs=0.5)
    assert found["t"]["max"] == 2.5 and found["g"]["mean"] is None
    halves = [statistics.daily_categories(rows.where(f"day {op} '2024-01-10'"), F.col("day"), ["g"]) for op in ("<", ">=")]
    merged = {r["category"]: r["count"] for r in statistics.merged_categories(halves[0].union(halves[1])).collect()}
    assert merged == {r["g"]: r["count"] for r in rows.groupBy("g").count().collect()}


@pytest.mark.parametrize("k", [64, 4096])
def test_ks_bounds_hold_the_statistic(spark, k):
    rows = days_of(spark)
    merged = statistics.merged_summaries(statistics.daily_summaries(rows, F.col("day"), ["x", "t"], ["x", "t"], k))
    for shift in (0.0, 2.0, 40.0):
        live = rows.where("day >= '2024-01-20'").select((F.col("x") + shift).alias("x"), "t")
        exact = {r["column"]: r["ks_stat"] for r in dq.ks_statistic(live, rows, ["x", "t"]).collect()}
        for r in statistics.ks_from_summaries(live, merged, ["x", "t", "none"]).collect():
            assert r["ks_low"] <= exact[r["column"]] <= r["ks_high"] and r["ks_high"] - r["ks_low"] <= 2 * (2.446 / k**0.9433 + 1 / statistics.STEPS)


def test_a_run_without_baseline_rows(spark):
    rows = days_of(spark, 10, 200)
    live = rows.where("day >= '2024-01-08'").select((F.col("x") + 50).alias("x"), F.lit("z").alias("g"))
    inputs = {
        "current": live,
        "s": statistics.daily_summaries(rows, F.col("day"), ["x", "t", "g"], ["x"]),
        "c": statistics.daily_categories(rows, F.col("day"), ["g"]),
    }
    config = {"numeric_columns": ["x"], "categorical_columns": ["g"], "completeness_threshold": 0.5, "summaries_input": "s", "categories_input": "c"}
    run = DataQuality().compute(inputs, config)
    names = {r["name"] for r in run.metrics.collect()}
    assert names == {f"dq/x/{m}" for m in ("completeness", "ks_stat", "ks_low", "ks_high", "ks_p")} | {"dq/g/completeness", "dq/g/psi"}
    assert {(r["type"], r["subject"]) for r in run.violations.collect()} == {("schema_missing", "t"), ("numeric_drift", "x"), ("categorical_drift", "g")}
    with pytest.raises(SpecError):
        DataQualitySpec.from_dict({"summaries_input": "s"})
