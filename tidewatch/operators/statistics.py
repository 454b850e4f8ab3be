"""Baseline statistics kept per day, so that later runs need no baseline rows.

Two tables are kept. ``summaries`` has a row per day and column: counts, range, moments, a quantile sketch and a distinct
sketch. ``categories`` has a row per day, column and category: exact counts. Both merge over any days: counts add up,
moments combine exactly, sketches are united; merging days equals one pass over their rows in all exact parts.

KS against a sketch is known within bounds. A quantile sketch of size k gives every rank within ``2.446 / k ** 0.9433``
(with 99 % confidence, for all ranks together), and is exact while it holds no more than k values; it is read at ``steps``
evenly spaced ranks, which adds ``1 / steps``. The statistic is reported with its bounds, and its p-value is that of
the lower bound: drift is stated only where it is certain despite the sketch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.values import as_category, as_number, data_type, is_numeric, quoted, without_nan
from tidewatch.operators import dq

SUMMARY_SCHEMA = (
    "day date, column string, rows bigint, present bigint, numbers bigint, low double, high double, mean double, m2 double, "
    "k int, quantiles binary, distinct binary"
)
CATEGORY_SCHEMA = "day date, column string, category string, count bigint"
STEPS = 2000


def daily_summaries(df: DataFrame, day: Column, columns: Sequence[str], numeric: Sequence[str], k: int = 2048) -> DataFrame:
    """``summaries`` of the rows of ``df``, a row per day and column, in one aggregation by day.

    Numeric columns get moments and a quantile sketch of their values as numbers, all columns counts and a distinct sketch.
    """
    aggregates = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(columns):
        value = without_nan(df, c)
        aggregates += [F.count(value).alias(f"present_{i}"), F.hll_sketch_agg(value.cast("string"), F.lit(14)).alias(f"distinct_{i}")]
        if c in numeric:
            x = as_number(df, c)
            aggregates += [
                F.count(x).alias(f"numbers_{i}"),
                F.min(x).alias(f"low_{i}"),
                F.max(x).alias(f"high_{i}"),
                F.avg(x).alias(f"mean_{i}"),
                (F.var_pop(x) * F.count(x)).alias(f"m2_{i}"),
                F.kll_sketch_agg_double(x, k).alias(f"quantiles_{i}"),
            ]
    wide = df.groupBy(day.cast("date").alias("day")).agg(*aggregates)

    def of(name: str, i: int, c: str, kind: str) -> Column:
        return (F.col(f"{name}_{i}") if c in numeric else F.lit(None)).cast(kind).alias(name)

    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.col("__rows").alias("rows"),
            F.col(f"present_{i}").alias("present"),
            of("numbers", i, c, "bigint"),
            *[of(n, i, c, "double") for n in ("low", "high", "mean", "m2")],
            F.lit(k if c in numeric else None).cast("int").alias("k"),
            of("quantiles", i, c, "binary"),
            F.col(f"distinct_{i}").alias("distinct"),
        )
        for i, c in enumerate(columns)
    ]
    return wide.select("day", F.inline(F.array(*entries)))


def daily_categories(df: DataFrame, day: Column, columns: Sequence[str]) -> DataFrame:
    """``categories`` of the rows of ``df``; null is a category."""
    picked = df.select(day.cast("date").alias("__day"), *[as_category(df, c).alias(c) for c in columns])
    melted = picked.unpivot(["__day"], [quoted(c) for c in columns], "column", "category")
    return melted.groupBy(F.col("__day").alias("day"), "column", "category").count()


def merged_summaries(summaries: DataFrame) -> DataFrame:
    """One row per column over all days given. Deviations are taken from the common mean, so no large squares cancel."""
    n = F.col("numbers")
    means = summaries.groupBy("column").agg((F.sum(F.col("mean") * n) / F.sum(n)).alias("mean"))
    # one row per stored column
    centered = summaries.withColumnRenamed("mean", "__own").join(F.broadcast(means), "column")
    spread = F.col("m2") + n * (F.col("__own") - F.col("mean")) * (F.col("__own") - F.col("mean"))
    return centered.groupBy("column").agg(
        F.sum("rows").alias("rows"),
        F.sum("present").alias("present"),
        F.sum("numbers").alias("numbers"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.first("mean").alias("mean"),
        F.sum(spread).alias("m2"),
        F.min("k").alias("k"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.hll_union_agg("distinct").alias("distinct"),
    )


def merged_categories(categories: DataFrame) -> DataFrame:
    """``(column, category, count)`` over all days given, as :func:`tidewatch.operators.dq.psi_from_histogram` reads it."""
    return categories.groupBy("column", "category").agg(F.sum("count").alias("count"))


def profile(merged: DataFrame) -> DataFrame:
    """The column profile of :func:`tidewatch.operators.dq.profile` from merged summaries; median and cardinality are estimates."""
    has = F.col("numbers") > 0
    return merged.select(
        "column",
        F.col("rows").alias("row_count"),
        (F.col("rows") - F.col("present")).alias("null_count"),
        F.col("low").alias("min"),
        F.col("high").alias("max"),
        "mean",
        F.when(F.col("numbers") > 1, F.sqrt(F.col("m2") / (F.col("numbers") - 1))).alias("stddev"),
        F.when(has, F.kll_sketch_get_quantile_double("quantiles", F.lit(0.5))).alias("median"),
        F.hll_sketch_estimate("distinct").alias("distinct_count"),
    )


def rank_error(numbers: Column, k: Column, steps: int = STEPS) -> Column:
    """How far a rank read from a sketch may be off."""
    sketch = F.when(numbers <= k, F.lit(0.0)).otherwise(F.lit(2.446) / F.pow(k.cast("double"), F.lit(0.9433)))
    return sketch + F.lit(1.0 / steps)


def ks_from_summaries(current: DataFrame, merged: DataFrame, columns: Sequence[str], steps: int = STEPS) -> DataFrame:
    """``column, ks_stat, ks_low, ks_high, ks_p, n, m`` of live rows against merged summaries.

    The live side is exact. The baseline enters as ``steps`` values at evenly spaced ranks of its sketch.
    """
    columns = [c for c in columns if c in current.columns]
    if not columns:
        return current.sparkSession.createDataFrame(
            [], "column string, ks_stat double, ks_low double, ks_high double, ks_p double, n bigint, m bigint"
        )
    zero = F.lit(0).cast("bigint")
    live = dq.baseline_numbers(current, columns).select("column", "number", F.col("m").alias("n_current"), zero.alias("n_baseline"))
    known = merged.where(F.col("column").isin(list(columns)) & (F.col("numbers") > 0))
    ranks = F.split(F.lit(",".join(str((i + 0.5) / steps) for i in range(steps))), ",").cast("array<double>")  # one constant
    grid = known.select("column", F.explode(F.kll_sketch_get_quantile_double("quantiles", ranks)).alias("number"))
    stored = grid.groupBy("column", "number").agg(zero.alias("n_current"), F.count(F.lit(1)).alias("n_baseline"))
    merged_cells = live.unionByName(stored).groupBy("column", "number").agg(F.sum("n_current").alias("n_current"), F.sum("n_baseline").alias("n_baseline"))
    found = dq.ks_of(merged_cells, ["column"]).drop("m")
    off = rank_error(F.col("numbers"), F.col("k"), steps)
    sizes = known.select("column", F.col("numbers").alias("m"), off.alias("off"))  # one row per configured column
    bounded = found.join(F.broadcast(sizes), "column").select(
        "column",
        "ks_stat",
        F.greatest(F.col("ks_stat") - F.col("off"), F.lit(0.0)).alias("ks_low"),
        F.least(F.col("ks_stat") + F.col("off"), F.lit(1.0)).alias("ks_high"),
        "n",
        "m",
    )
    tested = dq.ks_pvalue(bounded.select("column", F.col("ks_low").alias("ks_stat"), "n", "m")).select("column", "ks_p")
    return bounded.join(F.broadcast(tested), "column")
