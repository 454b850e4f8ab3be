"""Fairness queries on line items: open lines and deep discounts as facets, returns as the label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import bias, rollup
from tidewatch.plans.runs import Bias
from tidewatch.queries.common import r, rounded, table, tidy
from tidewatch.spec import PRE_TRAINING, BiasSpec

DISTRIBUTION = ["CI", "DPL", "KL", "JS", "LP", "TVD", "KS"]
POST = ["DPPL", "DI", "DCA", "DCR", "RD", "DAR", "DRR", "AD", "TE"]
FACETS = [{"name": "status", "values": ["O"]}, {"name": "discount", "threshold": 0.05}, {"name": "mode", "values": [0, 1]}]
BASE = {
    "label_column": "label",
    "positive_label_values": ["R"],
    "facets": FACETS,
    "predicted_label_column": "guess",
    "group_columns": ["year"],
}


def dataset(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    quantity = F.col("l_quantity") + F.lit(shift)
    return items.select(
        F.col("l_linestatus").alias("status"),
        F.col("l_discount").alias("discount"),
        (F.col("l_suppkey") % 5).cast("int").alias("mode"),
        F.when((F.col("l_suppkey") % 5 == 0) & (quantity > 30), "R").otherwise(F.col("l_returnflag")).alias("label"),
        F.when(quantity > 25, "R").when(quantity > 12, "N").otherwise("A").alias("guess"),
        F.year("l_shipdate").alias("year"),
    )


def report(spark: SparkSession, sf_dir: str, methods: list[str], shift: int = 0, **changes) -> DataFrame:
    spec = BiasSpec.from_dict({**BASE, "methods": methods, **changes})
    return bias.report(dataset(spark, sf_dir, shift), spec)


def _table(rows: DataFrame) -> DataFrame:
    return tidy(rows, "facet", "stage", "metric", "value")


def pretraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(report(spark, sf_dir, DISTRIBUTION))


def cddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(report(spark, sf_dir, ["CDDL"]))


def cddpl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(report(spark, sf_dir, ["CDDPL"]))


def posttraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(report(spark, sf_dir, POST))


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A facet value that never occurs and a missing group column leave several metrics undefined."""
    facets = [{"name": "status", "values": ["nowhere"]}, {"name": "mode", "values": [0]}]
    rows = report(spark, sf_dir, [*DISTRIBUTION, "CDDL", "DI", "RD"], facets=facets, group_columns=[])
    return bias.errors(rows).select("facet", "stage", "metric")


def empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On no rows every metric asked for is an error, once per facet."""
    spec = BiasSpec.from_dict({**BASE, "methods": ["CI", "DPL", "KL", "AD"]})
    rows = bias.report(dataset(spark, sf_dir).where("discount < 0"), spec)
    return bias.errors(rows).select("facet", "stage", "metric")


def _analysis(spark: SparkSession, sf_dir: str):
    config = {
        **BASE,
        "methods": [*DISTRIBUTION, "DPPL", "DI"],
        "thresholds": {"CI": 0.1, "DPL": 0.05, "KL": 0.02, "DI": 2.0},
        "severity_alert_thresholds": {"DPL": 0.15},
    }
    return Bias().compute({"dataset": dataset(spark, sf_dir)}, config)


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_analysis(spark, sf_dir).violations, "type", "subject", "value", "threshold")


def outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).outcome


def one_vs_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = BiasSpec.from_dict({**BASE, "methods": [*DISTRIBUTION, "DPPL", "DI", "RD", "AD"]})
    rows = bias.one_vs_rest(dataset(spark, sf_dir), spec)
    return tidy(rows, "facet", "class", "stage", "metric", "value")


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = report(spark, sf_dir, ["DPL", "KL"], shift=10)
    stored = report(spark, sf_dir, ["DPL", "KL"])
    return tidy(bias.drift(live, stored), "facet", "stage", "metric", "current", "baseline", "delta")


def facet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = rollup.facet_matrix(report(spark, sf_dir, list(PRE_TRAINING), group_columns=[]), list(PRE_TRAINING))
    return matrix.select("facet", *[rounded(m).alias(m) for m in PRE_TRAINING])


QUERIES = {
    "bias_pretraining": pretraining,
    "bias_cddl": cddl,
    "bias_posttraining": posttraining,
    "bias_cddpl": cddpl,
    "bias_errors": errors,
    "bias_empty": empty,
    "bias_violations": violations,
    "bias_outcome": outcome,
    "bias_one_vs_rest": one_vs_rest,
    "bias_drift": drift,
    "facet_matrix": facet_matrix,
}


def _dataset_sql(shift: int) -> str:
    return f"""ds AS (
  SELECT l_linestatus AS status, l_discount AS discount, l_suppkey % 5 AS mode,
    CASE WHEN l_suppkey % 5 = 0 AND l_quantity + {shift} > 30 THEN 'R' ELSE l_returnflag END AS label,
    CASE WHEN l_quantity + {shift} > 25 THEN 'R' WHEN l_quantity + {shift} > 12 THEN 'N' ELSE 'A' END AS guess,
    year(l_shipdate) AS yr FROM lineitem)"""


_FACETED = {
    "status": "status = 'O'",
    "discount": "discount > 0.05::DOUBLE",
    "mode": "mode IN (0, 1)",
}


def _cells_sql(shift: int, facets: dict[str, str] | None = None) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{name}' AS facet, ({test}) AS d, label, guess, yr FROM ds" for name, test in (facets or _FACETED).items()
    )
    return f"{_dataset_sql(shift)}, tagged AS ({parts})"


_COUNTS = """
cnt AS (SELECT facet,
  count(*) FILTER (NOT d)::DOUBLE AS n_a, count(*) FILTER (d)::DOUBLE AS n_d,
  count(*) FILTER (NOT d AND label = 'R')::DOUBLE AS l_a, count(*) FILTER (d AND label = 'R')::DOUBLE AS l_d,
  count(*) FILTER (NOT d AND guess = 'R')::DOUBLE AS p_a, count(*) FILTER (d AND guess = 'R')::DOUBLE AS p_d,
  count(*) FILTER (NOT d AND label = 'R' AND guess = 'R')::DOUBLE AS h_a, count(*) FILTER (d AND label = 'R' AND guess = 'R')::DOUBLE AS h_d
  FROM tagged GROUP BY facet),
dist AS (SELECT facet, label, count(*) FILTER (NOT d)::DOUBLE AS v_a, count(*) FILTER (d)::DOUBLE AS v_d FROM tagged GROUP BY facet, label),
pr AS (SELECT facet, v_a / nullif(sum(v_a) OVER (PARTITION BY facet), 0) AS pa, v_d / nullif(sum(v_d) OVER (PARTITION BY facet), 0) AS pd FROM dist),
dv AS (SELECT facet,
  CASE WHEN count(*) = count(CASE WHEN pa = 0 THEN 0 WHEN pd > 0 THEN 1 END) THEN sum(CASE WHEN pa = 0 THEN 0 WHEN pd > 0 THEN pa * ln(pa / pd) END) END AS kl,
  sum((CASE WHEN pa = 0 THEN 0 ELSE pa * ln(pa / ((pa + pd) / 2)) END) + (CASE WHEN pd = 0 THEN 0 ELSE pd * ln(pd / ((pa + pd) / 2)) END)) / 2 AS js,
  sqrt(sum((pa - pd) * (pa - pd))) AS lp, sum(abs(pa - pd)) / 2 AS tvd, max(abs(pa - pd)) AS ks FROM pr GROUP BY facet)"""

# numerator / denominator forms of the definitions; a zero denominator gives null
_FORMULAS = {
    "CI": ("pre", "(n_a - n_d) / nullif(n_a + n_d, 0) + 0 * (1 / nullif(n_a, 0)) + 0 * (1 / nullif(n_d, 0))"),
    "DPL": ("pre", "l_a / nullif(n_a, 0) - l_d / nullif(n_d, 0)"),
    "KL": ("pre", "kl"),
    "JS": ("pre", "js"),
    "LP": ("pre", "lp"),
    "TVD": ("pre", "tvd"),
    "KS": ("pre", "ks"),
    "DPPL": ("post", "p_a / nullif(n_a, 0) - p_d / nullif(n_d, 0)"),
    "DI": ("post", "(p_d / nullif(n_d, 0)) / nullif(p_a / nullif(n_a, 0), 0)"),
    "DCA": ("post", "l_a / nullif(p_a, 0) - l_d / nullif(p_d, 0)"),
    "DCR": ("post", "(n_d - l_d) / nullif(n_d - p_d, 0) - (n_a - l_a) / nullif(n_a - p_a, 0)"),
    "RD": ("post", "h_a / nullif(l_a, 0) - h_d / nullif(l_d, 0)"),
    "DAR": ("post", "h_a / nullif(p_a, 0) - h_d / nullif(p_d, 0)"),
    "DRR": ("post", "(n_d - l_d - p_d + h_d) / nullif(n_d - p_d, 0) - (n_a - l_a - p_a + h_a) / nullif(n_a - p_a, 0)"),
    "AD": ("post", "(h_a + n_a - l_a - p_a + h_a) / nullif(n_a, 0) - (h_d + n_d - l_d - p_d + h_d) / nullif(n_d, 0)"),
    "TE": ("post", "(l_d - h_d) / nullif(p_d - h_d, 0) - (l_a - h_a) / nullif(p_a - h_a, 0)"),
}


def _metrics_sql(methods: list[str], keys: str = "facet") -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, '{_FORMULAS[m][0]}' AS stage, '{m}' AS metric, {_FORMULAS[m][1]} AS value FROM cnt JOIN dv USING ({keys})"
        for m in methods
    )


def _report_sql(methods: list[str], shift: int = 0) -> str:
    return f"{_cells_sql(shift)}, {_COUNTS}, rep AS ({_metrics_sql(methods)})"


def _cdd_sql(column: str, name: str, stage: str) -> str:
    return f"""WITH {_cells_sql(0)},
g AS (SELECT facet, yr, count(*)::DOUBLE AS n,
   coalesce(count(*) FILTER (d AND {column} <> 'R') / nullif(count(*) FILTER ({column} <> 'R'), 0)::DOUBLE, 0)
   - coalesce(count(*) FILTER (d AND {column} = 'R') / nullif(count(*) FILTER ({column} = 'R'), 0)::DOUBLE, 0) AS dd
   FROM tagged GROUP BY facet, yr)
SELECT facet, '{stage}' AS stage, '{name}' AS metric, {r('sum(n * dd) / sum(n)')} AS value FROM g GROUP BY facet"""


_SELECT = f"SELECT facet, stage, metric, {r('value')} AS value FROM rep"
_SCORED = f"""WITH {_report_sql([*DISTRIBUTION, 'DPPL', 'DI'])},
limits AS (SELECT * FROM (VALUES ('CI', 0.1::DOUBLE), ('DPL', 0.05), ('KL', 0.02), ('DI', 2.0)) t(metric, threshold)),
bad AS (SELECT facet || '/' || stage || '/' || rep.metric AS subject, value, threshold FROM rep JOIN limits USING (metric) WHERE abs(value) > threshold)"""

_OVR = f"""WITH {_cells_sql(0)},
classes AS (SELECT label AS class FROM tagged UNION SELECT guess FROM tagged),
cnt AS (SELECT facet, class,
  count(*) FILTER (NOT d)::DOUBLE AS n_a, count(*) FILTER (d)::DOUBLE AS n_d,
  count(*) FILTER (NOT d AND label = class)::DOUBLE AS l_a, count(*) FILTER (d AND label = class)::DOUBLE AS l_d,
  count(*) FILTER (NOT d AND guess = class)::DOUBLE AS p_a, count(*) FILTER (d AND guess = class)::DOUBLE AS p_d,
  count(*) FILTER (NOT d AND label = class AND guess = class)::DOUBLE AS h_a, count(*) FILTER (d AND label = class AND guess = class)::DOUBLE AS h_d
  FROM tagged CROSS JOIN classes GROUP BY facet, class),
pr AS (SELECT facet, class, l_a / n_a AS pa, l_d / n_d AS pd FROM cnt UNION ALL SELECT facet, class, 1 - l_a / n_a, 1 - l_d / n_d FROM cnt),
dv AS (SELECT facet, class,
  sum(CASE WHEN pa = 0 THEN 0 ELSE pa * ln(pa / pd) END) AS kl,
  sum((CASE WHEN pa = 0 THEN 0 ELSE pa * ln(pa / ((pa + pd) / 2)) END) + (CASE WHEN pd = 0 THEN 0 ELSE pd * ln(pd / ((pa + pd) / 2)) END)) / 2 AS js,
  sqrt(sum((pa - pd) * (pa - pd))) AS lp, sum(abs(pa - pd)) / 2 AS tvd, max(abs(pa - pd)) AS ks FROM pr GROUP BY facet, class),
rep AS ({_metrics_sql([*DISTRIBUTION, 'DPPL', 'DI', 'RD', 'AD'], 'facet, class')})
SELECT facet, class, stage, metric, {r('value')} AS value FROM rep"""

_ERROR_FACETS = {"status": "status = 'nowhere'", "mode": "mode IN (0)"}

ORACLES = {
    "bias_pretraining": f"WITH {_report_sql(DISTRIBUTION)} {_SELECT}",
    "bias_cddl": _cdd_sql("label", "CDDL", "pre"),
    "bias_posttraining": f"WITH {_report_sql(POST)} {_SELECT}",
    "bias_cddpl": _cdd_sql("guess", "CDDPL", "post"),
    "bias_errors": f"""WITH {_cells_sql(0, _ERROR_FACETS)}, {_COUNTS}, rep AS ({_metrics_sql([*DISTRIBUTION, 'DI', 'RD'])}
        UNION ALL SELECT facet, 'pre', 'CDDL', NULL FROM cnt)
        SELECT facet, stage, metric FROM rep WHERE value IS NULL""",
    "bias_empty": f"""SELECT facet, stage, metric FROM (SELECT unnest([{", ".join(repr(f["name"]) for f in BASE["facets"])}]) AS facet),
        (SELECT unnest(['pre', 'pre', 'pre', 'post']) AS stage, unnest(['CI', 'DPL', 'KL', 'AD']) AS metric),
        (SELECT count(*) AS n FROM lineitem WHERE l_discount < 0) WHERE n = 0""",
    "bias_violations": f"""{_SCORED} SELECT 'bias' AS type, subject, {r('value')} AS value, {r('threshold')} AS threshold FROM bad""",
    "bias_outcome": f"""{_SCORED}, hot AS (SELECT count(*) AS n FROM rep WHERE metric = 'DPL' AND abs(value) > 0.15)
        SELECT 'bias' AS analyser,
          CASE WHEN count(*) > 0 THEN 'succeeded_with_violations' ELSE 'succeeded' END AS outcome,
          CASE WHEN (SELECT n FROM hot) > 0 THEN 'alert' WHEN count(*) > 0 THEN 'warn' ELSE 'info' END AS severity,
          count(*)::BIGINT AS violation_count FROM bad""",
    "bias_one_vs_rest": _OVR,
    "bias_drift": f"""WITH live AS (WITH {_report_sql(['DPL', 'KL'], 10)} SELECT * FROM rep),
        stored AS (WITH {_report_sql(['DPL', 'KL'])} SELECT * FROM rep)
        SELECT facet, stage, metric, {r('l.value')} AS current, {r('s.value')} AS baseline, {r('l.value - s.value')} AS delta
        FROM live l FULL JOIN stored s USING (facet, stage, metric)""",
    "facet_matrix": f"""WITH {_report_sql(DISTRIBUTION)} SELECT facet, """
    + ", ".join(f"""{r(f"max(CASE WHEN metric = '{m}' THEN value END)")} AS "{m}" """ for m in DISTRIBUTION)
    + ", 0.0::DOUBLE AS \"CDDL\" FROM rep GROUP BY facet",
}
