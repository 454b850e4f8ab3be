"""Data-quality queries: line items shipped from mid-1998 on against those before.

The source has no missing values or schema changes, so the current window gets a 2 % price shift, null
prices and flags, unparsable discounts, a new flag value, and a column swap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import dq, rollup, statistics
from tidewatch.plans.runs import DataQuality
from tidewatch.queries.common import r, rounded, table, tidy
from tidewatch.session import written

NUMERIC = ["price", "quantity", "discount_text"]
CATEGORICAL = ["flag", "status"]
CONFIG = {
    "numeric_columns": NUMERIC,
    "categorical_columns": CATEGORICAL,
    "psi_threshold": 0.1,
    "ks_method": "asymptotic",
}


def windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf_dir, "lineitem")
    discount = F.round(F.col("l_discount") * 100).cast("bigint").cast("string")
    recent = F.col("l_shipdate") >= F.lit("1998-06-01").cast("timestamp_ntz")
    key = F.col("l_orderkey")
    current = items.where(recent).select(
        F.when(key % 7 != 0, F.col("l_extendedprice") * 1.02).alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.when(key % 11 == 0, "n/a").otherwise(discount).alias("discount_text"),
        F.when(key % 13 == 0, None).when(key % 17 == 0, "X").otherwise(F.col("l_returnflag")).alias("flag"),
        F.col("l_linestatus").alias("status"),
        F.col("l_tax").alias("tax"),
    )
    baseline = items.where(~recent).select(
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("quantity"),
        discount.alias("discount_text"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        F.col("l_suppkey").alias("supplier"),
    )
    return current, baseline


def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dq.schema_difference(spark, *windows(spark, sf_dir))


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, _ = windows(spark, sf_dir)
    return tidy(dq.completeness(current, NUMERIC + CATEGORICAL), "column", "completeness")


def ks_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(dq.ks_statistic(*windows(spark, sf_dir), NUMERIC), "column", "ks_stat", "n", "m")


def ks_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    statistics = dq.ks_statistic(*windows(spark, sf_dir), NUMERIC)
    return tidy(dq.ks_pvalue(statistics, "asymptotic"), "column", "ks_p")


def ks_pvalue_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances of suppliers with even and odd keys, by the exact law."""
    suppliers = table(spark, sf_dir, "supplier")
    even = F.col("s_suppkey") % 2 == 0
    statistics = dq.ks_statistic(suppliers.where(even), suppliers.where(~even), ["s_acctbal"])
    return tidy(dq.ks_pvalue(statistics, "exact"), "column", "ks_stat", "ks_p")


def psi_missing_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that the stored histogram lacks, and one that the live table lacks, are skipped."""
    current, baseline = windows(spark, sf_dir)
    stored = dq.baseline_histogram(baseline, CATEGORICAL[:1])
    gone = stored.withColumn("column", F.lit("gone"))
    return tidy(dq.psi_from_histogram(current, stored.unionByName(gone), [*CATEGORICAL, "gone"]), "column", "psi")


def psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(dq.population_stability(*windows(spark, sf_dir), CATEGORICAL), "column", "psi")


def psi_from_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, baseline = windows(spark, sf_dir)
    stored = dq.baseline_histogram(baseline, CATEGORICAL)
    return tidy(dq.psi_from_histogram(current, stored, CATEGORICAL), "column", "psi")


def analysis(spark: SparkSession, sf_dir: str):
    current, baseline = windows(spark, sf_dir)
    return DataQuality().compute({"current": current, "baseline": baseline}, CONFIG)


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(analysis(spark, sf_dir).metrics, "name", "value")


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(analysis(spark, sf_dir).violations, "type", "subject", "value", "threshold")


def outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).outcome


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, _ = windows(spark, sf_dir)
    table_ = dq.profile(current, ["price", "quantity", *CATEGORICAL], exact_distinct=True)
    columns = ("column", "row_count", "null_count", "min", "max", "mean", "stddev", "distinct_count")
    return tidy(table_.withColumn("stddev", rounded("stddev", 4)), *columns)


def stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The baseline's statistics by ship day: summaries and categories, written as a store would hold them."""
    before = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") < F.lit("1998-06-01").cast("timestamp_ntz"))
    rows = before.select(
        F.col("l_shipdate").alias("day"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.round(F.col("l_discount") * 100).cast("bigint").cast("string").alias("discount_text"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
    )
    summaries = statistics.daily_summaries(rows, F.col("day"), NUMERIC + CATEGORICAL, NUMERIC)
    return written(summaries, "summaries"), written(statistics.daily_categories(rows, F.col("day"), CATEGORICAL), "categories")


def from_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run against stored statistics: exact where they are exact, KS bounds that hold the statistic of the rows."""
    current, baseline = windows(spark, sf_dir)
    summaries, categories = stored(spark, sf_dir)
    config = {**CONFIG, "summaries_input": "summaries", "categories_input": "categories"}
    run = DataQuality().compute({"current": current, "summaries": summaries, "categories": categories}, config).metrics
    exact = dq.ks_statistic(current, baseline, NUMERIC).select(F.col("column").alias("subject"), F.col("ks_stat").alias("exact"))
    of = lambda name: F.max(F.when(F.col("statistic") == name, F.col("value"))).alias(name)
    bounds = run.groupBy("subject").agg(of("ks_low"), of("ks_high")).join(exact, "subject")
    held = ((F.col("exact") >= F.col("ks_low")) & (F.col("exact") <= F.col("ks_high"))).cast("double")
    rows = run.where("statistic IN ('completeness', 'psi')").select("name", "value")
    rows = rows.union(bounds.select(F.concat_ws("/", F.lit("dq"), "subject", F.lit("ks_held")), held))
    return tidy(rows.union(bounds.select(F.concat_ws("/", F.lit("dq"), "subject", F.lit("ks_exact")), "exact")), "name", "value")


def merged_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of all days merged: exact parts as they are, estimates by whether they are near the exact ones."""
    _, baseline = windows(spark, sf_dir)
    summaries, _ = stored(spark, sf_dir)
    found = statistics.profile(statistics.merged_summaries(summaries))
    exact = dq.profile(baseline, NUMERIC + CATEGORICAL, exact_distinct=True).select("column", F.col("distinct_count").alias("exact_distinct"))
    near = F.abs(F.col("distinct_count") - F.col("exact_distinct")) <= F.col("exact_distinct") * 0.05
    middle = baseline.agg(F.avg((F.col("price") <= found.where("column = 'price'").select("median").scalar()).cast("int"))).scalar()
    held = F.when(F.col("column") == "price", F.abs(middle - 0.5) <= 0.01)
    rows = found.join(exact, "column").withColumn("distinct_near", near).withColumn("median_near", held)
    return tidy(rows.withColumn("stddev", rounded("stddev", 4)), "column", "row_count", "null_count", "min", "max", "mean", "stddev", "exact_distinct", "distinct_near", "median_near")


def drift_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(rollup.drift_matrix(analysis(spark, sf_dir).metrics), "column", "ks_stat", "ks_p", "psi")


QUERIES = {
    "dq_schema_diff": schema_diff,
    "dq_completeness": completeness,
    "dq_ks_stat": ks_stat,
    "dq_ks_pvalue": ks_pvalue,
    "dq_ks_pvalue_exact": ks_pvalue_exact,
    "dq_psi": psi,
    "dq_psi_from_histogram": psi_from_histogram,
    "dq_psi_missing_column": psi_missing_column,
    "dq_metrics": metrics,
    "dq_violations": violations,
    "dq_outcome": outcome,
    "dq_profile": profile,
    "dq_from_statistics": from_statistics,
    "dq_profile_merged": merged_profile,
    "drift_matrix": drift_matrix,
}

_WINDOWS = """
WITH cur AS (
  SELECT CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice * 1.02::DOUBLE END AS price,
         l_quantity AS quantity,
         CASE WHEN l_orderkey % 11 = 0 THEN 'n/a' ELSE CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) END AS discount_text,
         CASE WHEN l_orderkey % 13 = 0 THEN NULL WHEN l_orderkey % 17 = 0 THEN 'X' ELSE l_returnflag END AS flag,
         l_linestatus AS status, l_tax AS tax
  FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01'),
base AS (
  SELECT l_extendedprice AS price, l_quantity AS quantity,
         CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) AS discount_text,
         l_returnflag AS flag, l_linestatus AS status, l_suppkey AS supplier
  FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-06-01')
"""

_COMPLETENESS = "compl AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CASE WHEN count(*) = 0 THEN 0.0 ELSE count({c}) / count(*)::DOUBLE END AS completeness FROM cur"
    for c in NUMERIC + CATEGORICAL
) + ")"

_KS = "vals AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, TRY_CAST({c} AS DOUBLE) AS v, {int(s == 'cur')} AS c, {int(s == 'base')} AS b FROM {s}"
    for c in NUMERIC
    for s in ("cur", "base")
) + """),
freq AS (SELECT col, v, sum(c) AS c, sum(b) AS b FROM vals WHERE v IS NOT NULL GROUP BY col, v),
size AS (SELECT col, sum(c) AS n, sum(b) AS m FROM freq GROUP BY col),
cumul AS (SELECT f.col, n, m,
          sum(c) OVER (PARTITION BY f.col ORDER BY v) / n::DOUBLE - sum(b) OVER (PARTITION BY f.col ORDER BY v) / m::DOUBLE AS gap
          FROM freq f JOIN size s ON f.col = s.col),
ks AS (SELECT col, max(abs(gap)) AS d, any_value(n) AS n, any_value(m) AS m FROM cumul GROUP BY col)"""

# Pelz-Good expansion, the series summed over k = 1..20
_PVALUE = """
eff AS (SELECT col, d, round(n::DOUBLE * m / (n + m)) AS e, sqrt(round(n::DOUBLE * m / (n + m))) * d AS z FROM ks),
series AS (
  SELECT col, any_value(d) AS d, any_value(e) AS e, any_value(z) AS z,
    sum(exp(-pow(2*k-1, 2) * pow(pi(), 2) / (8*z*z))) AS o0,
    sum(pow(2*k-1, 2) * exp(-pow(2*k-1, 2) * pow(pi(), 2) / (8*z*z))) AS o2,
    sum(pow(2*k-1, 4) * exp(-pow(2*k-1, 2) * pow(pi(), 2) / (8*z*z))) AS o4,
    sum(pow(2*k-1, 6) * exp(-pow(2*k-1, 2) * pow(pi(), 2) / (8*z*z))) AS o6,
    sum(pow(k, 2) * exp(-pow(k, 2) * pow(pi(), 2) / (2*z*z))) AS e2,
    sum(pow(k, 4) * exp(-pow(k, 2) * pow(pi(), 2) / (2*z*z))) AS e4
  FROM eff, (SELECT unnest(range(1, 21))::DOUBLE AS k) GROUP BY col),
terms AS (
  SELECT *, sqrt(2*pi()) AS w, pow(pi(), 2) AS q FROM series),
pval AS (
  SELECT col, d, CASE WHEN z < 0.2 THEN 1.0 WHEN z > 4.0 THEN least(1.0, 2 * exp(-2*z*z))
    ELSE greatest(0.0, least(1.0, 1 - (
      w / z * o0
      + w / (6*pow(z,4)) * (-z*z*o0 + q/4*o2) / sqrt(e)
      + (w / (72*pow(z,7)) * ((6*pow(z,6) + 2*pow(z,4))*o0 + (2*pow(z,4) - 5*z*z)*q/4*o2 + (1 - 2*z*z)*q*q/16*o4)
         - w*q/(36*pow(z,3))*e2) / e
      + (w / (6480*pow(z,10)) * ((-30*pow(z,6) - 90*pow(z,8))*o0 + (135*pow(z,4) - 96*pow(z,6))*q/4*o2
           + (212*pow(z,4) - 60*z*z)*q*q/16*o4 + (5 - 30*z*z)*q*q*q/64*o6)
         + w/(216*pow(z,6))*(3*q*z*z*e2 - q*q*e4)) / (e*sqrt(e))))) END AS p
  FROM terms)"""

_PSI = "cats AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, {c} AS g, {int(s == 'cur')} AS c, {int(s == 'base')} AS b FROM {s}"
    for c in CATEGORICAL
    for s in ("cur", "base")
) + """),
hist AS (SELECT col, g, sum(c) AS c, sum(b) AS b FROM cats GROUP BY col, g),
probs AS (SELECT col, greatest(c / greatest(sum(c) OVER (PARTITION BY col), 1)::DOUBLE, 1e-6) AS p,
                 greatest(b / greatest(sum(b) OVER (PARTITION BY col), 1)::DOUBLE, 1e-6) AS q FROM hist),
psi AS (SELECT col, sum((p - q) * ln(p / q)) AS psi FROM probs GROUP BY col)"""

_METRICS = f"""{_WINDOWS}, {_COMPLETENESS}, {_KS}, {_PVALUE}, {_PSI},
metrics AS (
  SELECT "column" AS subject, 'completeness' AS statistic, completeness AS value FROM compl
  UNION ALL SELECT col, 'ks_stat', d FROM pval UNION ALL SELECT col, 'ks_p', p FROM pval
  UNION ALL SELECT col, 'psi', psi FROM psi),
diff AS (
  SELECT 'missing' AS kind, 'supplier' AS col UNION ALL SELECT 'extra', 'tax'),
violations AS (
  SELECT 'schema_' || kind AS type, col AS subject, NULL::DOUBLE AS value, NULL::DOUBLE AS threshold FROM diff
  UNION ALL SELECT 'completeness', subject, value, 0.99 FROM metrics WHERE statistic = 'completeness' AND value < 0.99
  UNION ALL SELECT 'numeric_drift', subject, value, 0.05 FROM metrics WHERE statistic = 'ks_p' AND value < 0.05
  UNION ALL SELECT 'categorical_drift', subject, value, 0.1 FROM metrics WHERE statistic = 'psi' AND value > 0.1)
"""

# the schema difference is metadata; the oracle reads it from the column lists of the two windows
_SCHEMA = f"""{_WINDOWS},
names AS (
  SELECT unnest(['price', 'quantity', 'discount_text', 'flag', 'status', 'tax']) AS c, 'cur' AS side, (SELECT count(*) FROM cur) AS n
  UNION ALL
  SELECT unnest(['price', 'quantity', 'discount_text', 'flag', 'status', 'supplier']), 'base', (SELECT count(*) FROM base))
SELECT CASE WHEN max(side) = 'base' THEN 'missing' ELSE 'extra' END AS kind, c AS "column"
FROM names WHERE n > 0 GROUP BY c HAVING count(*) = 1"""

_PROFILE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*)::BIGINT AS row_count, (count(*) - count({c}))::BIGINT AS null_count,
    {r(f'min({c})')} AS min, {r(f'max({c})')} AS max, {r(f'avg({c})')} AS mean,
    count(DISTINCT {c})::BIGINT AS distinct_count, {r(f'stddev_samp({c})', 4)} AS stddev FROM cur"""
    for c in ("price", "quantity")
) + "".join(
    f""" UNION ALL SELECT '{c}', count(*)::BIGINT, (count(*) - count({c}))::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE,
    count(DISTINCT {c})::BIGINT, NULL::DOUBLE FROM cur"""
    for c in CATEGORICAL
)

_MERGED = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*)::BIGINT AS row_count, (count(*) - count({c}))::BIGINT AS null_count,
    {r(f'min({c}::DOUBLE)')} AS min, {r(f'max({c}::DOUBLE)')} AS max, {r(f'avg({c}::DOUBLE)')} AS mean, {r(f'stddev_samp({c}::DOUBLE)', 4)} AS stddev,
    count(DISTINCT {c})::BIGINT AS exact_distinct, true AS distinct_near, {'true' if c == 'price' else 'NULL::BOOLEAN'} AS median_near FROM base"""
    for c in NUMERIC
) + "".join(
    f""" UNION ALL SELECT '{c}', count(*)::BIGINT, (count(*) - count({c}))::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE,
    count(DISTINCT {c})::BIGINT, true, NULL::BOOLEAN FROM base"""
    for c in CATEGORICAL
)

ORACLES = {
    "dq_from_statistics": f"""{_METRICS} SELECT 'dq/' || subject || '/' || statistic AS name, {r('value')} AS value FROM metrics WHERE statistic IN ('completeness', 'psi')
        UNION ALL SELECT 'dq/' || col || '/ks_held', 1.0::DOUBLE FROM ks UNION ALL SELECT 'dq/' || col || '/ks_exact', {r('d')} FROM ks""",
    "dq_profile_merged": f"{_WINDOWS} {_MERGED}",
    "dq_schema_diff": _SCHEMA,
    "dq_completeness": f'{_WINDOWS}, {_COMPLETENESS} SELECT "column", {r("completeness")} AS completeness FROM compl',
    "dq_ks_stat": f'{_WINDOWS}, {_KS} SELECT col AS "column", {r("d")} AS ks_stat, n::BIGINT AS n, m::BIGINT AS m FROM ks',
    "dq_ks_pvalue": f'{_WINDOWS}, {_KS}, {_PVALUE} SELECT col AS "column", {r("p")} AS ks_p FROM pval',
    "dq_psi": f'{_WINDOWS}, {_PSI} SELECT col AS "column", {r("psi")} AS psi FROM psi',
    "dq_psi_from_histogram": f'{_WINDOWS}, {_PSI} SELECT col AS "column", {r("psi")} AS psi FROM psi',
    "dq_psi_missing_column": f"""{_WINDOWS}, {_PSI} SELECT col AS "column", {r("psi")} AS psi FROM psi WHERE col = 'flag'""",
    "dq_ks_pvalue_exact": f"""WITH RECURSIVE v AS (SELECT s_acctbal AS x, s_suppkey % 2 = 0 AS even FROM supplier),
        s AS (SELECT count(*) FILTER (even) AS n, count(*) FILTER (NOT even) AS m FROM v),
        steps AS (SELECT DISTINCT sum(CASE WHEN even THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN even THEN 0 ELSE 1 END) OVER w AS j
          FROM v WINDOW w AS (ORDER BY x RANGE UNBOUNDED PRECEDING)),
        d AS (SELECT max(abs(i * m - j * n))::BIGINT AS bound, any_value(n)::BIGINT AS n, any_value(m)::BIGINT AS m FROM steps, s),
        -- paths[i + 1]: share of the lattice paths to (i, t - i) that stayed strictly inside the bound
        grid AS (SELECT 0::BIGINT AS t, list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS paths, bound, n, m FROM d
          UNION ALL
          SELECT t + 1, list_transform(range(0, n + 1), lambda i: CASE WHEN i > t + 1 OR t + 1 - i > m OR abs(i * m - (t + 1 - i) * n) >= bound THEN 0.0::DOUBLE
            ELSE (CASE WHEN i > 0 THEN paths[i] * i ELSE 0 END + CASE WHEN t + 1 - i > 0 THEN paths[i + 1] * (t + 1 - i) ELSE 0 END) / (t + 1) END), bound, n, m
          FROM grid WHERE t < n + m)
        SELECT 's_acctbal' AS "column", {r('bound / (n * m)::DOUBLE')} AS ks_stat, {r('1 - paths[n + 1]')} AS ks_p FROM grid WHERE t = n + m""",
    "dq_metrics": f"{_METRICS} SELECT 'dq/' || subject || '/' || statistic AS name, {r('value')} AS value FROM metrics",
    "dq_violations": f"{_METRICS} SELECT type, subject, {r('value')} AS value, {r('threshold')} AS threshold FROM violations",
    "dq_outcome": f"""{_METRICS} SELECT 'dq' AS analyser,
        CASE WHEN count(*) > 0 THEN 'succeeded_with_violations' ELSE 'succeeded' END AS outcome,
        CASE WHEN count(*) >= 3 THEN 'alert' WHEN count(*) > 0 THEN 'warn' ELSE 'info' END AS severity,
        count(*)::BIGINT AS violation_count FROM violations""",
    "dq_profile": f"{_WINDOWS} {_PROFILE}",
    "drift_matrix": f"""{_METRICS} SELECT subject AS "column",
        {r("max(CASE WHEN statistic = 'ks_stat' THEN value END)")} AS ks_stat,
        {r("max(CASE WHEN statistic = 'ks_p' THEN value END)")} AS ks_p,
        {r("max(CASE WHEN statistic = 'psi' THEN value END)")} AS psi
        FROM metrics WHERE statistic <> 'completeness' GROUP BY subject""",
}
