"""Serving-versus-candidate comparison on the same requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.divergence import js_bits, normalised_probabilities
from tidewatch.functions.values import quoted, without_nan
from tidewatch.operators.slices import ranked
from tidewatch.result import metric_rows, violation_rows
from tidewatch.spec import ShadowSpec

ANALYSER = "shadow"


def _side(df: DataFrame, spec: ShadowSpec, key: str, tag: str) -> DataFrame:
    """Key plus one packed struct ``tag`` of prediction and normalised probabilities."""
    prediction = without_nan(df, spec.prediction_column).cast("string").alias("prediction")
    probabilities = F.lit(None).cast("array<double>")
    if spec.probability_columns and all(c in df.columns for c in spec.probability_columns):
        raw = [F.col(quoted(c)) for c in spec.probability_columns]
        probabilities = F.array(*normalised_probabilities(raw, spec.problem_type == "binary"))
    return df.select(
        F.col(quoted(key)).alias("key"), F.struct(prediction, probabilities.alias("probabilities")).alias(tag)
    )


def _unique(side: DataFrame, tag: str) -> DataFrame:
    """Rows with a key, each key once; a repeated key fails the job when it is read.

    The window partitions and sorts by key exactly as the join does, so the check adds no shuffle.
    """
    numbered = side.where("key IS NOT NULL").withColumn(
        "n", F.row_number().over(Window.partitionBy("key").orderBy("key"))
    )
    message = F.concat(F.lit(f"{tag} predictions repeat join key "), F.col("key").cast("string"))
    checked = F.when(F.col("n") == 1, F.col(tag)).otherwise(F.raise_error(message).cast(side.schema[tag].dataType))
    return numbered.select("key", checked.alias(tag))


def _flat(paired: DataFrame) -> DataFrame:
    return paired.select(
        "key",
        F.col("serving.prediction").alias("serving_prediction"),
        F.col("shadow.prediction").alias("shadow_prediction"),
        F.col("serving.probabilities").alias("serving_probabilities"),
        F.col("shadow.probabilities").alias("shadow_probabilities"),
    )


def align_by_key(serving: DataFrame, shadow: DataFrame, spec: ShadowSpec) -> DataFrame:
    """Inner join on the request key."""
    left = _unique(_side(serving, spec, spec.join_key, "serving"), "serving")
    right = _unique(_side(shadow, spec, spec.join_key, "shadow"), "shadow")
    return _flat(left.join(right, "key"))


def align_by_rank(serving: DataFrame, shadow: DataFrame, spec: ShadowSpec) -> DataFrame:
    """Pairs the i-th rows by ``order_by``; unequal row counts fail the job.

    Tables have no row order, so position is the rank of an explicit, unique ordering column.
    """
    used = [c for c in dict.fromkeys([spec.order_by, spec.prediction_column, *spec.probability_columns])]

    def side(df: DataFrame, tag: str) -> DataFrame:
        narrow = df.select(*[F.col(quoted(c)) for c in used if c in df.columns])
        return _side(ranked(narrow, quoted(spec.order_by)), spec, "position", tag)

    left, right = side(serving, "serving"), side(shadow, "shadow")
    message = F.lit("serving and shadow row counts differ; supply join_key")

    def present(tag: str, df: DataFrame) -> Column:
        return F.coalesce(F.col(tag), F.raise_error(message).cast(df.schema[tag].dataType)).alias(tag)

    joined = left.join(right, "key", "full_outer")
    return _flat(joined.select("key", present("serving", left), present("shadow", right)))


def align(serving: DataFrame, shadow: DataFrame, spec: ShadowSpec) -> DataFrame:
    return align_by_key(serving, shadow, spec) if spec.join_key else align_by_rank(serving, shadow, spec)


def agrees() -> Column:
    """A missing prediction on either side is a disagreement."""
    return F.coalesce(F.col("serving_prediction") == F.col("shadow_prediction"), F.lit(False))


def row_divergence(spec: ShadowSpec) -> Column:
    """Jensen-Shannon divergence of one request; 0 when either side has no probabilities."""
    width = len(spec.probability_columns)
    if not width:
        return F.lit(0.0)
    if spec.problem_type == "binary" and width == 1:
        width = 2
    p = [F.col("serving_probabilities")[i] for i in range(width)]
    q = [F.col("shadow_probabilities")[i] for i in range(width)]
    return js_bits(p, q)


def comparison_cells(pairs: DataFrame, spec: ShadowSpec) -> DataFrame:
    """``(serving_prediction, shadow_prediction, n, js_sum)``: all scores follow from these few rows."""
    return pairs.groupBy("serving_prediction", "shadow_prediction").agg(
        F.count(F.lit(1)).alias("n"), F.sum(row_divergence(spec)).alias("js_sum")
    )


def summary(cells: DataFrame) -> DataFrame:
    """One row ``(row_count, agreement, js_divergence)``; fails when no rows were paired."""
    totals = cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.sum(F.when(agrees(), F.col("n")).otherwise(0)).alias("agreed"),
        F.sum("js_sum").alias("js_sum"),
    )
    rows = F.when(F.col("row_count") > 0, F.col("row_count")).otherwise(
        F.raise_error(F.lit("serving and shadow predictions share no rows")).cast("bigint")
    )
    return totals.select(
        rows.alias("row_count"), (F.col("agreed") / rows).alias("agreement"), (F.col("js_sum") / rows).alias("js_divergence")
    )


def class_disagreement(cells: DataFrame) -> DataFrame:
    """Share of rows where the candidate differs, per class the serving variant predicts."""
    return (
        cells.where("serving_prediction IS NOT NULL")
        .groupBy(F.col("serving_prediction").alias("class"))
        .agg((F.sum(F.when(agrees(), 0).otherwise(F.col("n"))) / F.sum("n")).alias("disagreement"))
    )


def label_distribution(cells: DataFrame) -> DataFrame:
    """``(side, class, fraction)`` of the hard predictions of both variants; nulls are left out."""
    sides = F.array(
        *[
            F.struct(F.lit(s).alias("side"), F.col(f"{s}_prediction").alias("class"), F.col("n").alias("n"))
            for s in ("serving", "shadow")
        ]
    )
    counts = cells.select(F.inline(sides)).where("class IS NOT NULL").groupBy("side", "class").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("side").agg(F.sum("n").alias("total"))  # two rows
    return counts.join(F.broadcast(totals), "side").select(
        "side", "class", (F.col("n") / F.col("total")).alias("fraction")
    )


def measure(cells: DataFrame) -> DataFrame:
    """``shadow/agreement``, ``shadow/js_divergence`` and ``shadow/disagreement_per_class/<class>``.

    One rollup over the cells gives the class rows and the total together, so the pairs are joined once.
    An empty extra cell keeps the total row in place when nothing was paired, which then fails the job.
    """
    nothing = cells.sparkSession.range(1).select(
        *[F.lit(None).cast("string").alias(f"{side}_prediction") for side in ("serving", "shadow")],
        F.lit(0).cast("bigint").alias("n"),
        F.lit(0.0).alias("js_sum"),
    )
    levels = cells.unionByName(nothing).rollup("serving_prediction").agg(
        F.grouping_id().alias("level"),
        F.sum("n").alias("n"),
        F.sum(F.when(agrees(), F.col("n")).otherwise(F.lit(0))).alias("agreed"),
        F.sum("js_sum").alias("js_sum"),
    )
    rows = F.when(F.col("n") > 0, F.col("n")).otherwise(
        F.raise_error(F.lit("serving and shadow predictions share no rows")).cast("bigint")
    )

    def entry(subject: Column, statistic: str, name: Column, value: Column) -> Column:
        parts = (subject.alias("subject"), F.lit(statistic).alias("statistic"), name.alias("name"), value.alias("value"))
        return F.struct(*parts)

    label, everything = F.col("serving_prediction"), F.lit("all")
    total = F.array(
        entry(everything, "agreement", F.lit("shadow/agreement"), F.col("agreed") / rows),
        entry(everything, "js_divergence", F.lit("shadow/js_divergence"), F.col("js_sum") / rows),
    )
    per_class = F.array(
        entry(
            label,
            "disagreement",
            F.concat(F.lit("shadow/disagreement_per_class/"), label),
            F.try_divide(F.col("n") - F.col("agreed"), F.col("n")),
        )
    )
    entries = levels.select(F.inline(F.when(F.col("level") == 1, total).when(label.isNotNull(), per_class)))
    return metric_rows(entries, ANALYSER, *[F.col(c) for c in ("subject", "statistic", "name", "value")])


def judge(metrics: DataFrame, spec: ShadowSpec) -> DataFrame:
    value, name = F.col("value"), F.col("name")
    low = metrics.where((name == "shadow/agreement") & (value < spec.agreement_threshold))
    high = metrics.where((name == "shadow/js_divergence") & (value > spec.js_divergence_threshold))
    return violation_rows(
        low, ANALYSER, F.lit("agreement"), F.col("subject"), value, threshold=F.lit(spec.agreement_threshold)
    ).unionByName(
        violation_rows(
            high, ANALYSER, F.lit("js_divergence"), F.col("subject"), value, threshold=F.lit(spec.js_divergence_threshold)
        )
    )
