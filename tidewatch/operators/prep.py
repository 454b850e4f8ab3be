"""Preparing monitoring inputs: splits, drift injection, derived features, model fitting."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.values import quoted

#: Training rows of one task of a fit.
ROWS_PER_TASK = 100_000


def _bucket(key: str, seed: int, buckets: int) -> Column:
    """A bucket from the first 32 bits of the md5 of key and seed, which any engine can repeat."""
    digest = F.md5(F.concat_ws(":", F.col(quoted(key)).cast("string"), F.lit(str(seed))))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def split(df: DataFrame, key: str, seed: int = 0, share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Disjoint baseline and current parts by key hash; repeatable, and a scan-side filter for each."""
    cut = round(share * 10_000)
    bucket = _bucket(key, seed, 10_000)
    return df.where(bucket < cut), df.where(bucket >= cut)


def inject_drift(
    df: DataFrame, key: str, column: str, low: int, high: int, floor: float, ceiling: float, seed: int = 0
) -> DataFrame:
    """Shift a column by a repeatable integer in ``[low, high)`` per row and clip the result."""
    shift = F.lit(low) + _bucket(key, seed, high - low)
    dtype = df.schema[column].dataType
    shifted = F.least(F.greatest(F.col(quoted(column)) + shift, F.lit(floor)), F.lit(ceiling))
    # greatest/least skip nulls; a missing value stays missing
    return df.withColumn(column, F.when(F.col(quoted(column)).isNotNull(), shifted).cast(dtype))


def interaction(df: DataFrame, left: str, right: str, name: str) -> DataFrame:
    product = F.col(quoted(left)).cast("double") * F.col(quoted(right)).cast("double")
    return df.withColumn(name, product)


def dealt(df: DataFrame, rows: int = ROWS_PER_TASK) -> DataFrame:
    """The rows of a fit, which keeps them in memory, over one task for every ``rows``; fewer stay as they lie.

    A Parquet file of one row group is one task's work however long it is, and would stay one task's in every iteration.
    """
    tasks = math.ceil(df.count() / rows)
    return df.repartition(tasks) if tasks > 1 else df


def fit_logistic(df: DataFrame, features: Sequence[str], label: str, positive: object, max_iter: int = 100):
    """A logistic regression pipeline on the given features; standardised, unregularised."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    labelled = df.select(
        *[F.col(quoted(f)).cast("double").alias(f) for f in features],
        (F.col(quoted(label)) == F.lit(positive)).cast("double").alias("__label"),
    ).where(F.col("__label").isNotNull())
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="__features", handleInvalid="skip"),
        LogisticRegression(featuresCol="__features", labelCol="__label", maxIter=max_iter),
    ]
    return Pipeline(stages=stages).fit(dealt(labelled))


def predict(model, df: DataFrame, positive: object, negative: object) -> DataFrame:
    """Adds ``predicted_label`` and ``prob_positive``; every other column is kept."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(df)
    return scored.select(
        *df.columns,
        F.when(F.col("prediction") == 1.0, F.lit(positive)).otherwise(F.lit(negative)).alias("predicted_label"),
        vector_to_array(F.col("probability"))[1].alias("prob_positive"),
    )
