import pytest
from pyspark.sql import functions as F

from tidewatch.operators import bias
from tidewatch.plans.runs import Bias
from tidewatch.spec import POST_TRAINING, PRE_TRAINING, BiasSpec, SpecError

SCHEMA = "sex string, income string, guess string, job string"
# Published pre-training metrics of a census table (facet Female, label >50K), to 1e-4.
GOLDEN = {
    "CI": 0.3513692725946555,
    "DPL": 0.20015891077100018,
    "KL": 0.14306865156306434,
    "JS": 0.03075614465977302,
    "LP": 0.2830674462421746,
    "TVD": 0.20015891077100015,
    "KS": 0.20015891077100018,
}


def config(**changes):
    return {
        "label_column": "income",
        "positive_label_values": [">50K"],
        "facets": [{"name": "sex", "values": ["Female"]}],
        **changes,
    }


def values(df, **changes):
    rows = bias.report(df, BiasSpec.from_dict(config(**changes))).collect()
    return {r["metric"]: r["value"] for r in rows}


def counted(spark, cells):
    """Rows from ``(sex, income, guess, job, n)``."""
    df = spark.createDataFrame(cells, SCHEMA + ", n bigint")
    return df.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), "n"))).select("sex", "income", "guess", "job")


def test_golden_values(spark):
    # counts with the published rates: 20380 men of whom 6396 earn more, 9782 women of whom 1112 do
    df = counted(
        spark,
        [
            ("Male", ">50K", None, None, 6396),
            ("Male", "<=50K", None, None, 20380 - 6396),
            ("Female", ">50K", None, None, 1112),
            ("Female", "<=50K", None, None, 9782 - 1112),
        ],
    )
    got = values(df, methods=list(GOLDEN))
    for name, expected in GOLDEN.items():
        assert got[name] == pytest.approx(expected, abs=1e-4), name


CELLS = [
    ("Male", ">50K", ">50K", "x", 30),
    ("Male", ">50K", "<=50K", "x", 10),
    ("Male", "<=50K", ">50K", "y", 20),
    ("Male", "<=50K", "<=50K", "y", 40),
    ("Female", ">50K", ">50K", "x", 6),
    ("Female", ">50K", "<=50K", "y", 4),
    ("Female", "<=50K", ">50K", "x", 5),
    ("Female", "<=50K", "<=50K", "y", 25),
]


def test_post_training_by_hand(spark):
    got = values(counted(spark, CELLS), methods=list(POST_TRAINING), predicted_label_column="guess", group_columns=["job"])
    expected = {
        "DPPL": 50 / 100 - 11 / 40,
        "DI": (11 / 40) / (50 / 100),
        "DCA": 40 / 50 - 10 / 11,
        "DCR": 30 / 29 - 60 / 50,
        "RD": 30 / 40 - 6 / 10,
        "DAR": 30 / 50 - 6 / 11,
        "DRR": 25 / 29 - 40 / 50,
        "AD": 70 / 100 - 31 / 40,
        "TE": 4 / 5 - 10 / 20,
        # job x: 51 rows (10 rejected, none female; 41 accepted, 11 female); job y: 89 rows (69 and 29; 20 and 0)
        "CDDPL": (51 * (0 / 10 - 11 / 41) + 89 * (29 / 69 - 0 / 20)) / 140,
    }
    for name, value in expected.items():
        assert got[name] == pytest.approx(value), name


def test_swapping_sides_keeps_distances_and_negates_differences(spark):
    df = counted(spark, CELLS)
    there = values(df, methods=["CI", "DPL", "JS", "LP", "TVD", "KS"])
    back = values(df, methods=["CI", "DPL", "JS", "LP", "TVD", "KS"], facets=[{"name": "sex", "values": ["Male"]}])
    for name in ("JS", "LP", "TVD", "KS"):
        assert there[name] == pytest.approx(back[name])
    for name in ("CI", "DPL"):
        assert there[name] == pytest.approx(-back[name])


def test_undefined_metrics_become_errors(spark):
    df = counted(spark, CELLS)
    analysis = Bias().compute({"dataset": df}, config(facets=[{"name": "sex", "values": ["Nobody"]}], methods=list(PRE_TRAINING)))
    assert analysis.metrics.count() == 0
    assert {r["metric"] for r in analysis.details["errors"].collect()} == set(PRE_TRAINING)
    assert analysis.outcome.first()["outcome"] == "succeeded"


def test_kl_is_undefined_when_the_facet_misses_a_label(spark):
    df = counted(spark, [("Male", ">50K", None, None, 2), ("Male", "<=50K", None, None, 2), ("Female", "<=50K", None, None, 2)])
    got = values(df, methods=["KL", "JS"])
    assert got["KL"] is None and got["JS"] > 0


@pytest.mark.parametrize(
    ("thresholds", "alerts", "expected"),
    [
        ({}, None, ("succeeded", "info", 0)),
        ({"DPL": 0.1}, None, ("succeeded_with_violations", "warn", 1)),
        ({"DPL": 0.1, "CI": 0.1}, {"DPL": 0.1}, ("succeeded_with_violations", "alert", 2)),
        ({}, {"DPL": 0.1}, ("succeeded", "alert", 0)),
        ({"DPL": 0.9}, {"DPL": 0.9}, ("succeeded", "info", 0)),
    ],
)
def test_outcomes(spark, thresholds, alerts, expected):
    analysis = Bias().compute(
        {"dataset": counted(spark, CELLS)}, config(thresholds=thresholds, severity_alert_thresholds=alerts)
    )
    row = analysis.outcome.first()
    assert (row["outcome"], row["severity"], row["violation_count"]) == expected
    assert analysis.metrics.where("name = 'sex/pre/DPL'").count() == 1


def test_null_facet_joins_the_rest_and_can_be_dropped(spark):
    df = counted(spark, [(None, ">50K", None, None, 3), ("Female", "<=50K", None, None, 1), ("Male", "<=50K", None, None, 1)])
    assert values(df, methods=["CI"])["CI"] == pytest.approx((4 - 1) / 5)
    assert values(df, methods=["CI"], drop_nulls=True)["CI"] == 0


def test_binary_one_vs_rest_matches_the_plain_report(spark):
    df = counted(spark, CELLS)
    spec = BiasSpec.from_dict(config(methods=["CI", "DPL", "KL", "JS", "LP", "TVD", "KS", "RD"], predicted_label_column="guess"))
    plain = {r["metric"]: r["value"] for r in bias.report(df, spec).collect()}
    rows = bias.one_vs_rest(df, spec).where(F.col("class") == ">50K").collect()
    assert {r["metric"]: r["value"] for r in rows} == {k: pytest.approx(v) for k, v in plain.items()}


def test_typed_facet_values(spark):
    df = spark.createDataFrame([(1, True, "y"), (0, False, "n"), (None, None, "y")], "code int, flag boolean, income string")
    for facet in ({"name": "code", "values": [1]}, {"name": "code", "values": ["1"]}, {"name": "flag", "values": [True]},
                  {"name": "code", "threshold": 0.5}):
        rows = bias.report(df, BiasSpec.from_dict({"label_column": "income", "positive_label_values": ["y"], "facets": [facet], "methods": ["CI"]}))
        assert rows.first()["value"] == pytest.approx(1 / 3)


def test_spec():
    with pytest.raises(SpecError):
        BiasSpec.from_dict(config(facets=[{"name": "sex"}, {"name": "sex"}]))
    with pytest.raises(SpecError):
        BiasSpec.from_dict(config(methods=["FAIR"]))
