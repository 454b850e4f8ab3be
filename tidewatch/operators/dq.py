"""Data quality: schema difference, completeness, KS drift, PSI drift, column profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.divergence import psi_term
from tidewatch.functions.kolmogorov import asymptotic_pvalue, exact_pvalue
from tidewatch.functions.values import as_category, as_number, data_type, is_numeric, quoted, ratio, tally, without_nan
from tidewatch.operators.slices import SLICE, sliced
from tidewatch.result import METRIC_SCHEMA, metric_rows, violation_rows
from tidewatch.session import written
from tidewatch.spec import DataQualitySpec

ANALYSER = "dq"


def shared_columns(current: DataFrame, baseline: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in current.columns and c in baseline.columns]


def schema_difference(spark: SparkSession, current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Column names on one side only, as ``(kind, column)``; types play no part."""
    missing = sorted(set(baseline.columns) - set(current.columns))
    extra = sorted(set(current.columns) - set(baseline.columns))
    rows = [("missing", c) for c in missing] + [("extra", c) for c in extra]
    return spark.createDataFrame(rows, "kind string, column string")


def completeness(current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of present values per column, in one pass without a shuffle of rows; 0 over no rows."""
    present = [c for c in columns if c in current.columns]
    if not present:
        return current.sparkSession.createDataFrame([], "column string, completeness double")
    counts = current.agg(
        F.count(F.lit(1)).alias("__rows"), *[F.count(without_nan(current, c)).alias(c) for c in present]
    )
    shares = counts.select(*[ratio(F.col(quoted(c)), F.col("__rows"), empty=0.0).alias(c) for c in present])
    return shares.unpivot([], [quoted(c) for c in present], "column", "completeness")


def _stacked(current: DataFrame, baseline: DataFrame, columns: Sequence[str], value_of, label: str) -> DataFrame:
    """Both sides melted to ``(column, <label>, is_current)``; only the listed columns are read."""
    sides = []
    for df, flag in ((current, True), (baseline, False)):
        picked = df.select(*[value_of(df, c).alias(c) for c in columns])
        melted = picked.unpivot([], [quoted(c) for c in columns], "column", label)
        sides.append(melted.withColumn("is_current", F.lit(flag)))
    return reduce(DataFrame.unionByName, sides)


def value_histogram(current: DataFrame, baseline: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts per distinct number and side. Aggregating first makes a hot value a single row."""
    melted = _stacked(current, baseline, columns, as_number, "number").where("number IS NOT NULL")
    return melted.groupBy("column", "number").agg(
        tally(F.col("is_current")).alias("n_current"), tally(~F.col("is_current")).alias("n_baseline")
    )


def baseline_numbers(baseline: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Value counts ``(column, number, m)`` to keep with a baseline, for KS against later windows."""
    picked = baseline.select(*[as_number(baseline, c).alias(c) for c in columns])
    melted = picked.unpivot([], [quoted(c) for c in columns], "column", "number").where("number IS NOT NULL")
    return melted.groupBy("column", "number").agg(F.count(F.lit(1)).alias("m"))


def ks_statistic(current: DataFrame, baseline: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Largest gap between the two empirical distributions, per column: ``(column, ks_stat, n, m)``.

    Text that is no number is dropped; a column with an empty side yields no row.
    """
    columns = shared_columns(current, baseline, columns)
    if not columns:
        return current.sparkSession.createDataFrame([], "column string, ks_stat double, n bigint, m bigint")
    return ks_of(value_histogram(current, baseline, columns), ["column"])


def ks_of(histogram: DataFrame, keys: Sequence[str]) -> DataFrame:
    """KS statistic per ``keys`` of a histogram ``(*keys, number, n_current, n_baseline)``.

    Each range of values yields its total change and its extreme gaps; shifting the extremes by the
    changes of all earlier ranges gives the exact maximum, so no task ever holds a whole column.
    """
    totals = (
        histogram.groupBy(*keys)
        .agg(F.sum("n_current").alias("n"), F.sum("n_baseline").alias("m"))
        .where("n > 0 AND m > 0")
    )
    upto = Window.partitionBy(SLICE, *keys).orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.sum("n_current").over(upto) / F.col("n") - F.sum("n_baseline").over(upto) / F.col("m")
    per_slice = (
        sliced(histogram, *keys, "number")
        .join(F.broadcast(totals), list(keys))  # one row per configured column (and closed window)
        .withColumn("gap", gap)
        .groupBy(SLICE, *keys, "n", "m")
        .agg(
            F.min("number").alias("start"),
            F.max("gap").alias("high"),
            F.min("gap").alias("low"),
            (F.sum("n_current") / F.col("n") - F.sum("n_baseline") / F.col("m")).alias("change"),
        )
    )
    before = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    shifted = per_slice.withColumn("offset", F.coalesce(F.sum("change").over(before), F.lit(0.0)))
    extreme = F.greatest(F.abs(F.col("offset") + F.col("high")), F.abs(F.col("offset") + F.col("low")))
    return shifted.groupBy(*keys).agg(
        F.max(extreme).alias("ks_stat"), F.first("n").alias("n"), F.first("m").alias("m")
    )


def ks_pvalue(statistics: DataFrame, method: str = "asymptotic") -> DataFrame:
    """Adds ``ks_p`` by one law for every size; ``exact`` counts paths in time and memory that grow with both samples."""
    law = exact_pvalue if method == "exact" else asymptotic_pvalue
    return statistics.withColumn("ks_p", law(F.col("ks_stat"), F.col("n"), F.col("m")))


def category_histogram(current: DataFrame, baseline: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts per category and side; null is a category."""
    melted = _stacked(current, baseline, columns, as_category, "category")
    return melted.groupBy("column", "category").agg(
        tally(F.col("is_current")).alias("n_current"), tally(~F.col("is_current")).alias("n_baseline")
    )


def psi_of(histogram: DataFrame) -> DataFrame:
    """PSI per column of a category histogram ``(column, category, n_current, n_baseline)``."""
    totals = histogram.groupBy("column").agg(
        F.greatest(F.sum("n_current"), F.lit(1)).alias("total_current"),
        F.greatest(F.sum("n_baseline"), F.lit(1)).alias("total_baseline"),
    )
    # one row per configured column; an ordered or grouped window would hold a whole column in one task
    shares = histogram.join(F.broadcast(totals), "column")
    term = psi_term(F.col("n_current") / F.col("total_current"), F.col("n_baseline") / F.col("total_baseline"))
    return shares.groupBy("column").agg(F.sum(term).alias("psi"))


def population_stability(current: DataFrame, baseline: DataFrame, columns: Sequence[str]) -> DataFrame:
    columns = shared_columns(current, baseline, columns)
    if not columns:
        return current.sparkSession.createDataFrame([], "column string, psi double")
    return psi_of(category_histogram(current, baseline, columns))


def baseline_histogram(baseline: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The category counts to keep with a baseline, so that later checks need no baseline rows."""
    picked = baseline.select(*[as_category(baseline, c).alias(c) for c in columns])
    return picked.unpivot([], [quoted(c) for c in columns], "column", "category").groupBy("column", "category").count()


def psi_from_histogram(current: DataFrame, histogram: DataFrame, columns: Sequence[str]) -> DataFrame:
    """PSI of a live window against a stored baseline histogram."""
    columns = [c for c in columns if c in current.columns]
    if not columns:
        return current.sparkSession.createDataFrame([], "column string, psi double")
    live = baseline_histogram(current, columns).select(
        "column", "category", F.col("count").alias("n_current"), F.lit(0).cast("bigint").alias("n_baseline")
    )
    stored = histogram.where(F.col("column").isin(list(columns))).select(
        "column", "category", F.lit(0).cast("bigint").alias("n_current"), F.col("count").alias("n_baseline")
    )
    merged = live.unionByName(stored).groupBy("column", "category").agg(
        F.sum("n_current").alias("n_current"), F.sum("n_baseline").alias("n_baseline")
    )
    # A column that only one side knows has no drift to state.
    sides = merged.groupBy("column").agg((F.max("n_current") > 0).alias("live"), (F.max("n_baseline") > 0).alias("stored"))
    known = sides.where("live AND stored").select("column")
    return psi_of(merged.join(F.broadcast(known), "column", "left_semi"))  # one row per configured column


def profile(df: DataFrame, columns: Sequence[str], exact_distinct: bool = False) -> DataFrame:
    """Baseline statistics per column: counts, range, moments, median, cardinality."""
    if not columns:
        raise ValueError("profile needs at least one column")
    numeric = [c for c in columns if is_numeric(data_type(df, c))]
    aggregates = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(columns):
        value = without_nan(df, c)
        aggregates.append(F.count(value).alias(f"present_{i}"))
        if not exact_distinct:
            aggregates.append(F.approx_count_distinct(value).alias(f"distinct_{i}"))
        if c in numeric:
            number = as_number(df, c)
            aggregates += [
                F.min(number).alias(f"min_{i}"),
                F.max(number).alias(f"max_{i}"),
                F.avg(number).alias(f"mean_{i}"),
                F.stddev_samp(number).alias(f"stddev_{i}"),
                F.percentile_approx(number, F.lit(0.5), 10_000).alias(f"median_{i}"),
            ]
    wide = df.agg(*aggregates)

    def stat(name: str, i: int, c: str):
        return F.col(f"{name}_{i}") if c in numeric else F.lit(None).cast("double")

    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col("__rows").alias("row_count"),
                (F.col("__rows") - F.col(f"present_{i}")).alias("null_count"),
                *[stat(s, i, c).alias(s) for s in ("min", "max", "mean", "stddev", "median")],
                *([] if exact_distinct else [F.col(f"distinct_{i}").alias("distinct_count")]),
            )
            for i, c in enumerate(columns)
        ]
    )
    table = wide.select(F.inline(entries))
    if not exact_distinct:
        return table
    # Exact cardinality in two aggregations: distinct values first, then a count per column. Unlike
    # several countDistinct in one agg this spreads one column's values over all tasks.
    distinct = (
        baseline_histogram(df, columns)
        .groupBy("column")
        .agg(F.count("category").alias("distinct_count"))
    )
    return table.join(F.broadcast(distinct), "column")


def measure(current: DataFrame, baseline: DataFrame, spec: DataQualitySpec) -> DataFrame:
    """All data-quality metrics as tidy rows ``dq/<column>/<statistic>``.

    Either side is read once: every row gives a cell for each configured column, cells are counted by column and value,
    and completeness, KS and PSI all read these counts, which are written once. They hold each value of a column once.
    """
    numeric, categorical = (
        list(dict.fromkeys(c for c in columns if c in current.columns)) for columns in (spec.numeric_columns, spec.categorical_columns)
    )
    if not numeric and not categorical:
        return current.sparkSession.createDataFrame([], METRIC_SCHEMA)
    cells = written(_cells(current, baseline, numeric, categorical), "dq-cells")
    names = current.sparkSession.createDataFrame([(c,) for c in dict.fromkeys([*numeric, *categorical])], "column string")
    parts = [_completeness_of(cells, names)]
    if shared_columns(current, baseline, numeric):
        numbers = cells.where("numeric AND number IS NOT NULL").select("column", "number", "n_current", "n_baseline")
        parts.append(ks_pvalue(ks_of(numbers, ["column"]), spec.ks_method).select("column", "ks_stat", "ks_p"))
    shared = shared_columns(current, baseline, categorical)
    if shared:
        parts.append(psi_of(cells.where(~F.col("numeric") & F.col("column").isin(shared))))
    return metrics_of(parts)


def _cells(current: DataFrame, baseline: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Counts per column and value of both sides: ``column, numeric, number, category, n_current, n_baseline, n_present``.

    ``n_present`` counts the present values of the current side; a column in both lists has cells of either kind.
    """
    # A cell goes by the number of its column, short to compare and to send; names come back on the counts.
    slots = [(c, kind) for kind, columns in ((True, numeric), (False, categorical)) for c in columns]
    sides = []
    for df, live in ((current, True), (baseline, False)):
        cells = [
            F.struct(
                F.lit(i).alias("slot"),
                (as_number(df, c) if kind else F.lit(None)).cast("double").alias("number"),
                (F.lit(None) if kind else as_category(df, c)).cast("string").alias("category"),
                (without_nan(df, c).isNotNull() if live else F.lit(False)).cast("bigint").alias("present"),
            )
            for i, (c, kind) in enumerate(slots)
            if c in df.columns
        ]
        if cells:
            side = F.lit(int(live)).cast("bigint").alias("live")
            sides.append(df.select(F.inline(F.array(*cells)), side))
    melted = reduce(DataFrame.unionByName, sides)
    counts = melted.groupBy("slot", "number", "category").agg(
        F.sum("live").alias("n_current"), F.sum(1 - F.col("live")).alias("n_baseline"), F.sum("present").alias("n_present")
    )
    name = F.get(F.array(*[F.lit(c) for c, _ in slots]), F.col("slot"))
    kind = F.get(F.array(*[F.lit(k) for _, k in slots]), F.col("slot"))
    return counts.select(name.alias("column"), kind.alias("numeric"), "number", "category", "n_current", "n_baseline", "n_present")


def _completeness_of(cells: DataFrame, names: DataFrame) -> DataFrame:
    """Share of present values per column, 0 over no rows; a column in both lists is counted in both, which leaves the share."""
    share = ratio(F.sum("n_present"), F.sum("n_current"), empty=0.0).alias("completeness")
    found = cells.groupBy("column").agg(share)
    return names.join(found, "column", "left").select("column", F.coalesce("completeness", F.lit(0.0)).alias("completeness"))


def measure_against_statistics(current: DataFrame, summaries: DataFrame, categories: DataFrame, spec: DataQualitySpec) -> DataFrame:
    """The metrics of :func:`measure` against stored statistics, KS with its bounds as ``ks_low`` and ``ks_high``."""
    from tidewatch.operators import statistics

    scored = [c for c in dict.fromkeys([*spec.numeric_columns, *spec.categorical_columns]) if c in current.columns]
    if not scored:
        return current.sparkSession.createDataFrame([], METRIC_SCHEMA)
    bounded = statistics.ks_from_summaries(current, statistics.merged_summaries(summaries), spec.numeric_columns)
    psi = psi_from_histogram(current, statistics.merged_categories(categories), spec.categorical_columns)
    return metrics_of([completeness(current, scored), bounded.drop("n", "m"), psi])


def metrics_of(parts: Sequence[DataFrame]) -> DataFrame:
    """Tables of statistics by column, as tidy rows."""
    rows = []
    for part in parts:
        tidy = part.unpivot(["column"], [c for c in part.columns if c != "column"], "statistic", "value")
        name = F.concat_ws("/", F.lit("dq"), "column", "statistic")
        rows.append(metric_rows(tidy, ANALYSER, F.col("column"), F.col("statistic"), name, F.col("value")))
    return reduce(DataFrame.unionByName, rows)


def judge(metrics: DataFrame, difference: DataFrame, spec: DataQualitySpec) -> DataFrame:
    """Violations: schema changes first, then completeness, numeric drift and categorical drift.

    The metric table is folded to one row per column first, so all rules read it in one pass.
    """

    def of(statistic: str) -> Column:
        return F.max(F.when(F.col("statistic") == statistic, F.col("value"))).alias(statistic)

    wide = metrics.groupBy("subject").agg(*[of(s) for s in ("completeness", "ks_stat", "ks_p", "psi")])
    rules = [
        ("completeness", "completeness", None, spec.completeness_threshold, F.col("completeness") < spec.completeness_threshold),
        ("numeric_drift", "ks_p", "ks_stat", spec.ks_p_value_threshold, F.col("ks_p") < spec.ks_p_value_threshold),
        ("categorical_drift", "psi", None, spec.psi_threshold, F.col("psi") > spec.psi_threshold),
    ]
    found = F.array(
        *[
            F.struct(
                F.lit(kind).alias("type"),
                F.col(value).alias("value"),
                (F.col(reference) if reference else F.lit(None).cast("double")).alias("reference"),
                F.lit(threshold).alias("threshold"),
                F.coalesce(hit, F.lit(False)).alias("hit"),
            )
            for kind, value, reference, threshold, hit in rules
        ]
    )
    flagged = wide.select("subject", F.inline(found)).where("hit")
    schema_rows = violation_rows(difference, ANALYSER, F.concat(F.lit("schema_"), "kind"), F.col("column"))
    return schema_rows.unionByName(
        violation_rows(
            flagged, ANALYSER, F.col("type"), F.col("subject"), F.col("value"), F.col("reference"), F.col("threshold")
        )
    )
