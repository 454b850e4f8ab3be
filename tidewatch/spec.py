"""Analysis specifications: frozen, validated, and strict about unknown keys."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from datetime import datetime
from typing import Any, Self

Scalar = str | int | float | bool

# Bias metric codes by stage.
PRE_TRAINING = ("CI", "DPL", "KL", "JS", "LP", "TVD", "KS", "CDDL")
POST_TRAINING = ("DPPL", "DI", "DCA", "DCR", "RD", "DAR", "DRR", "AD", "TE", "CDDPL")

PROBLEM_TYPES = ("binary", "multiclass")
AGGREGATIONS = ("mean_abs", "mean", "max_abs", "median")
KS_METHODS = ("asymptotic", "exact")
EXPLAIN_METHODS = ("exact", "permutation", "kernel", "tree")


class SpecError(ValueError):
    """A specification that cannot be run."""


def _require(condition: bool, message: str) -> None:
    if not condition:
        raise SpecError(message)


def _fraction(name: str, value: float) -> None:
    _require(0.0 <= value <= 1.0, f"{name} must lie in [0, 1], got {value}")


class _Spec:
    @classmethod
    def from_dict(cls, config: Mapping[str, Any]) -> Self:
        known = {f.name for f in fields(cls)}  # type: ignore[arg-type]
        unknown = sorted(set(config) - known)
        _require(not unknown, f"{cls.__name__}: unknown keys {unknown}")
        try:
            return cls(**config)
        except TypeError as error:
            raise SpecError(f"{cls.__name__}: {error}") from error


@dataclass(frozen=True)
class DataQualitySpec(_Spec):
    """Completeness, KS and PSI checks of a current window against a baseline.

    With ``summaries_input`` and ``categories_input`` the baseline is its stored statistics, and no baseline rows are read.
    """

    schema_version: str = "1.0"
    current_input: str = "current"
    baseline_input: str = "baseline"
    numeric_columns: list[str] = field(default_factory=list)
    categorical_columns: list[str] = field(default_factory=list)
    completeness_threshold: float = 0.99
    ks_p_value_threshold: float = 0.05
    psi_threshold: float = 0.2
    severity_threshold: int = 3
    ks_method: str = "asymptotic"
    summaries_input: str | None = None
    categories_input: str | None = None

    def __post_init__(self) -> None:
        _fraction("completeness_threshold", self.completeness_threshold)
        _fraction("ks_p_value_threshold", self.ks_p_value_threshold)
        _require(self.psi_threshold >= 0, "psi_threshold must not be negative")
        _require(self.severity_threshold >= 1, "severity_threshold must be at least 1")
        _require(self.ks_method in KS_METHODS, f"ks_method must be one of {KS_METHODS}")
        both = (self.summaries_input is None) == (self.categories_input is None)
        _require(both, "summaries_input and categories_input belong together")
        _require(self.summaries_input is None or self.ks_method == "asymptotic", "stored statistics have asymptotic p-values only")


@dataclass(frozen=True)
class ModelQualitySpec(_Spec):
    """Classification scores of one prediction table, compared with baseline scores.

    With ``labels_input`` the predictions are captures without labels, ``inference_id`` and ``ts`` among their columns;
    the labels, ``inference_id, label, label_ts``, that came by ``as_of`` (default: now) are joined to those of the
    lookback, and a coverage below ``min_coverage`` ends the run without a verdict.
    """

    problem_type: str
    label_column: str
    prediction_column: str
    schema_version: str = "1.0"
    predictions_input: str = "predictions"
    probability_columns: list[str] | None = None
    positive_label: Scalar | None = None
    baseline_metrics: dict[str, float] = field(default_factory=dict)
    degradation_thresholds: dict[str, float] = field(default_factory=dict)
    severity_threshold: int = 2
    labels_input: str | None = None
    lookback: str = "7d"
    min_coverage: float = 0.30
    as_of: str | None = None

    def __post_init__(self) -> None:
        _require(self.problem_type in PROBLEM_TYPES, f"problem_type must be one of {PROBLEM_TYPES}")
        _fraction("min_coverage", self.min_coverage)
        _require(re.fullmatch(r"\d+[dhmw]", self.lookback) is not None, "lookback must look like '7d' or '12h'")
        try:
            datetime.fromisoformat(self.as_of or "2000-01-01")
        except ValueError:
            raise SpecError(f"as_of must be an ISO date and time, got {self.as_of!r}") from None


@dataclass(frozen=True)
class Facet(_Spec):
    """A protected attribute: rows holding one of ``values`` form the facet, all others the rest.

    ``threshold`` selects by ``column > threshold`` instead, for continuous attributes.
    """

    name: str
    values: list[Scalar] = field(default_factory=list)
    threshold: float | None = None


@dataclass(frozen=True)
class BiasSpec(_Spec):
    """Fairness metrics per facet, before and after training."""

    label_column: str
    positive_label_values: list[Scalar]
    facets: list[Facet]
    schema_version: str = "1.0"
    dataset_input: str = "dataset"
    predicted_label_column: str | None = None
    methods: list[str] = field(default_factory=lambda: ["CI", "DPL", "KL", "JS"])
    thresholds: dict[str, float] = field(default_factory=dict)
    severity_alert_thresholds: dict[str, float] | None = None
    group_columns: list[str] = field(default_factory=list)
    drop_nulls: bool = False

    def __post_init__(self) -> None:
        facets = [f if isinstance(f, Facet) else Facet.from_dict(f) for f in self.facets]
        object.__setattr__(self, "facets", facets)
        names = [f.name for f in facets]
        _require(len(names) == len(set(names)), "facet names must be unique")
        unknown = [m for m in self.methods if m not in PRE_TRAINING + POST_TRAINING]
        _require(not unknown, f"unknown bias methods {unknown}")

    @property
    def pre_methods(self) -> list[str]:
        return [m for m in self.methods if m in PRE_TRAINING]

    @property
    def post_methods(self) -> list[str]:
        return [m for m in self.methods if m in POST_TRAINING]


@dataclass(frozen=True)
class ShadowSpec(_Spec):
    """Comparison of a serving variant with a candidate on the same requests.

    Rows are paired by ``join_key``, or by rank of ``order_by`` when there is no key.
    """

    problem_type: str
    serving_variant: str
    shadow_variant: str
    schema_version: str = "1.0"
    serving_input: str = "serving_predictions"
    shadow_input: str = "shadow_predictions"
    prediction_column: str = "prediction"
    probability_columns: list[str] = field(default_factory=list)
    join_key: str | None = None
    order_by: str | None = None
    agreement_threshold: float = 0.95
    js_divergence_threshold: float = 0.1
    severity_threshold: int = 2

    def __post_init__(self) -> None:
        _require(self.problem_type in PROBLEM_TYPES, f"problem_type must be one of {PROBLEM_TYPES}")
        _fraction("agreement_threshold", self.agreement_threshold)
        _require(self.js_divergence_threshold >= 0, "js_divergence_threshold must not be negative")
        _require(self.severity_threshold >= 0, "severity_threshold must not be negative")
        _require(bool(self.join_key) or bool(self.order_by), "need join_key, or order_by for pairing by rank")


@dataclass(frozen=True)
class ExplainSpec(_Spec):
    """Shapley attributions of a sample against a background sample."""

    row_key: str
    schema_version: str = "1.0"
    features_input: str = "features"
    feature_columns: list[str] | None = None
    label_column: str | None = None
    num_samples: int = 100
    background_size: int = 50
    agg_method: str = "mean_abs"
    top_k: int = 20
    seed: int = 0
    method: str = "exact"
    permutations: int = 32
    coalitions: int = 256
    save_local_shap_values: bool = False
    package_group_name: str = "unknown"
    baseline_version: int = 0

    def __post_init__(self) -> None:
        _require(0 < self.num_samples <= 10_000, "num_samples must lie in 1..10000")
        _require(0 < self.background_size <= 500, "background_size must lie in 1..500")
        _require(0 < self.top_k <= 500, "top_k must lie in 1..500")
        _require(self.method in EXPLAIN_METHODS, f"method must be one of {EXPLAIN_METHODS}")
        _require(2 <= self.coalitions <= 1 << 16, "coalitions must lie in 2..65536")
        _require(self.permutations > 0, "permutations must be positive")
        _require(self.agg_method in AGGREGATIONS, f"agg_method must be one of {AGGREGATIONS}")
