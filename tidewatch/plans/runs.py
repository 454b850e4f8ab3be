"""The five analyses: each turns named inputs and a configuration into an :class:`Analysis`."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import UTC, datetime
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.severity import default_severity
from tidewatch.functions.values import quoted
from tidewatch.operators import bias, dq, explain, mq, shadow, truth
from tidewatch.result import VIOLATION_SCHEMA, Analysis, count_outcome
from tidewatch.session import written
from tidewatch.spec import BiasSpec, DataQualitySpec, ExplainSpec, ModelQualitySpec, ShadowSpec, SpecError

Inputs = Mapping[str, DataFrame]


class Analyser(Protocol):
    """The plug-in surface: any object with this method can be run as a monitor."""

    def compute(self, inputs: Inputs, config: Mapping[str, Any]) -> Analysis: ...


def _input(inputs: Inputs, name: str) -> DataFrame:
    if name not in inputs:
        raise SpecError(f"no input named {name!r}; got {sorted(inputs)}")
    return inputs[name]


class DataQuality:
    def compute(self, inputs: Inputs, config: Mapping[str, Any]) -> Analysis:
        spec = DataQualitySpec.from_dict(config)
        current = _input(inputs, spec.current_input)
        if spec.summaries_input is not None:
            summaries, categories = _input(inputs, spec.summaries_input), _input(inputs, spec.categories_input)
            # what the statistics know of the baseline's columns: one name per stored column
            stored = [r["column"] for r in summaries.select("column").distinct().collect()]
            lost = [("missing", c) for c in sorted(set(stored) - set(current.columns))]
            difference = current.sparkSession.createDataFrame(lost, "kind string, column string")
            metrics = dq.measure_against_statistics(current, summaries, categories, spec)
        else:
            baseline = _input(inputs, spec.baseline_input)
            difference = dq.schema_difference(current.sparkSession, current, baseline)
            metrics = dq.measure(current, baseline, spec)
        violations = dq.judge(metrics, difference, spec)
        return Analysis(
            dq.ANALYSER,
            metrics,
            violations,
            count_outcome(violations, dq.ANALYSER, spec.severity_threshold),
            {"schema_diff": difference},
            {
                "version": "1.0",
                "monitor_type": "DATA_QUALITY",
                "completeness_threshold": spec.completeness_threshold,
                "ks_p_value_threshold": spec.ks_p_value_threshold,
                "psi_threshold": spec.psi_threshold,
                "severity_threshold": spec.severity_threshold,
            },
            (metrics,),
        )


class ModelQuality:
    """``baseline`` may replace the spec's baseline scores by a table ``(metric, baseline, threshold)``.

    A run on no rows ends ``skipped_no_input``. One that joins late labels itself and finds too few of them ends
    ``skipped_insufficient_data``: its scores are reported, but violate nothing.
    """

    def __init__(self, baseline: DataFrame | None = None):
        self._baseline = baseline

    def compute(self, inputs: Inputs, config: Mapping[str, Any]) -> Analysis:
        spec = ModelQualitySpec.from_dict(config)
        df = _input(inputs, spec.predictions_input)
        covered = None
        if spec.labels_input is not None:
            df = self._labelled(df, _input(inputs, spec.labels_input), spec)
            covered = truth.coverage(df.select("label_ts"), spec.min_coverage)
        metrics = mq.measure(df, spec)
        baseline = self._baseline
        if baseline is None:
            baseline = mq.baseline_table(df, spec.baseline_metrics, spec.degradation_thresholds)
        deltas = mq.baseline_delta(metrics, baseline)
        violations = mq.degradation(deltas)
        cells = mq.confusion_counts(df, spec.label_column, spec.prediction_column)
        nothing = cells.agg((F.count(F.lit(1)) == 0).alias("nothing")).scalar()
        skipped = F.when(nothing, "skipped_no_input")
        details = {}
        if covered is not None:
            gate = covered.select(F.when(F.col("outcome") != "succeeded", F.col("outcome"))).scalar()
            skipped = F.coalesce(skipped, gate)
            violations = violations.where(gate.isNull())
            metrics = metrics.unionByName(mq.coverage_metrics(covered))
            details["ground_truth"] = covered
        outcome = count_outcome(violations, mq.ANALYSER, spec.severity_threshold).withColumn("skipped", skipped)
        return Analysis(
            mq.ANALYSER,
            metrics,
            violations,
            outcome.select(
                "analyser",
                F.coalesce("skipped", "outcome").alias("outcome"),
                F.coalesce(default_severity(F.col("skipped")), "severity").alias("severity"),
                "violation_count",
            ),
            {
                "metric_view": mq.payload_view(metrics),
                "confusion_matrix": mq.confusion_matrix(cells),
                "baseline_delta": deltas,
                **details,
            },
            {
                "version": "1.0",
                "monitor_type": "MQ",
                "problem_type": spec.problem_type,
                "label": spec.label_column,
                "prediction": spec.prediction_column,
            },
            (cells, metrics),
        )

    @staticmethod
    def _labelled(captures: DataFrame, labels: DataFrame, spec: ModelQualitySpec) -> DataFrame:
        """The captures of the lookback with their labels, written once: several measures read them."""
        as_of = datetime.fromisoformat(spec.as_of) if spec.as_of else datetime.now(UTC)
        joined = truth.join_truth(captures.drop("label", "label_ts", spec.label_column), labels, as_of, spec.lookback)
        used = [F.col("label").alias(spec.label_column), "label_ts", quoted(spec.prediction_column)]
        return written(joined.select(*used, *map(quoted, spec.probability_columns or [])), "labelled")


class Bias:
    def compute(self, inputs: Inputs, config: Mapping[str, Any]) -> Analysis:
        spec = BiasSpec.from_dict(config)
        rows = bias.report(_input(inputs, spec.dataset_input), spec)
        flags = bias.scored(rows, spec)
        return Analysis(
            bias.ANALYSER,
            bias.metrics_of(rows),
            bias.violations_of(flags, spec),
            bias.outcome_of(flags),
            {"report": rows.where("value IS NOT NULL"), "errors": bias.errors(rows)},
            {
                "version": "1.0",
                "monitor_type": "BIAS",
                "label": spec.label_column,
                "label_value_or_threshold": ",".join(str(v) for v in spec.positive_label_values),
            },
            (rows,),
        )


class Shadow:
    def compute(self, inputs: Inputs, config: Mapping[str, Any]) -> Analysis:
        spec = ShadowSpec.from_dict(config)
        pairs = shadow.align(_input(inputs, spec.serving_input), _input(inputs, spec.shadow_input), spec)
        cells = shadow.comparison_cells(pairs, spec)
        metrics = shadow.measure(cells)
        violations = shadow.judge(metrics, spec)
        return Analysis(
            shadow.ANALYSER,
            metrics,
            violations,
            count_outcome(violations, shadow.ANALYSER, spec.severity_threshold),
            {"summary": shadow.summary(cells), "distribution": shadow.label_distribution(cells)},
            {
                "version": "1.0",
                "monitor_type": "SHADOW",
                "serving_variant": spec.serving_variant,
                "shadow_variant": spec.shadow_variant,
                "problem_type": spec.problem_type,
            },
            (cells, metrics),
        )


class Explain:
    """Attributions describe and never gate: the outcome is always a clean one."""

    def __init__(self, scorer: explain.Scorer, binary: bool = True):
        self._scorer = scorer
        self._binary = binary

    def compute(self, inputs: Inputs, config: Mapping[str, Any]) -> Analysis:
        spec = ExplainSpec.from_dict(config)
        df = _input(inputs, spec.features_input)
        local, importance = explain.explain(df, spec, self._scorer, self._binary)
        violations = df.sparkSession.createDataFrame([], VIOLATION_SCHEMA)
        details = {"kernel_shap": importance}
        if spec.save_local_shap_values:
            details["local_shap_values"] = local
        return Analysis(
            explain.ANALYSER,
            explain.metrics_of(importance, spec.top_k),
            violations,
            df.sparkSession.range(1).select(
                F.lit(explain.ANALYSER).alias("analyser"),
                F.lit("succeeded").alias("outcome"),
                F.lit("info").alias("severity"),
                F.lit(0).cast("bigint").alias("violation_count"),
            ),
            details,
            {
                "version": "1.0",
                "monitor_type": "EXPLAINABILITY",
                "package_group_name": spec.package_group_name,
                "baseline_version": spec.baseline_version,
            },
            (local,) if spec.save_local_shap_values else (importance,),
        )
