"""Fairness metrics per facet, all facets from one aggregation over the dataset.

Notation: ``d`` is the facet (rows whose attribute holds one of the facet's values), ``a`` everyone
else. ``n`` counts rows, ``l`` positive labels, ``p`` positive predictions, ``h`` rows where both are
positive. Every two-class metric is arithmetic over those eight counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.divergence import entropy_gap
from tidewatch.functions.values import as_number, member_of, ratio, tally, without_nan
from tidewatch.result import metric_rows, violation_rows
from tidewatch.spec import BiasSpec, Facet

ANALYSER = "bias"
SIDES = ("a", "d")
DISTRIBUTION_METRICS = ("KL", "JS", "LP", "TVD", "KS")


def _in_facet(df: DataFrame, facet: Facet) -> Column:
    """True for side d. A null attribute belongs to side a."""
    if facet.threshold is not None:
        return F.coalesce(as_number(df, facet.name) > F.lit(facet.threshold), F.lit(False))
    return member_of(df, facet.name, facet.values)


def facet_cells(df: DataFrame, spec: BiasSpec) -> DataFrame:
    """``(facet, in_facet, label, label_positive, prediction, predicted_positive[, groups], n)``.

    Each row is tagged once per facet and counted map-side, so the shuffle carries combinations of
    label, prediction and side, never rows; a dominant facet value is one partial count per task.
    """
    if spec.drop_nulls:
        needed = [spec.label_column, *[f.name for f in spec.facets], *spec.group_columns]
        needed += [spec.predicted_label_column] if spec.predicted_label_column else []
        df = df.dropna(subset=list(dict.fromkeys(needed)))
    predicted = spec.predicted_label_column
    tagged = df.select(
        without_nan(df, spec.label_column).cast("string").alias("label"),
        member_of(df, spec.label_column, spec.positive_label_values).alias("label_positive"),
        (without_nan(df, predicted).cast("string") if predicted else F.lit(None).cast("string")).alias("prediction"),
        (member_of(df, predicted, spec.positive_label_values) if predicted else F.lit(False)).alias("predicted_positive"),
        *[without_nan(df, g).cast("string").alias(f"group_{i}") for i, g in enumerate(spec.group_columns)],
        F.explode(
            F.array(*[F.struct(F.lit(f.name).alias("facet"), _in_facet(df, f).alias("in_facet")) for f in spec.facets])
        ).alias("tag"),
    )
    keys = [c for c in tagged.columns if c != "tag"]
    return tagged.groupBy("tag.facet", "tag.in_facet", *keys).agg(F.count(F.lit(1)).alias("n"))


def side_counts(cells: DataFrame, *keys: str) -> DataFrame:
    """The eight counts ``n_a .. h_d`` per facet (and further keys)."""
    sums = []
    for side in SIDES:
        here = F.col("in_facet") if side == "d" else ~F.col("in_facet")
        sums += [
            tally(here, F.col("n")).alias(f"n_{side}"),
            tally(here & F.col("label_positive"), F.col("n")).alias(f"l_{side}"),
            tally(here & F.col("predicted_positive"), F.col("n")).alias(f"p_{side}"),
            tally(here & F.col("label_positive") & F.col("predicted_positive"), F.col("n")).alias(f"h_{side}"),
        ]
    return cells.groupBy("facet", *keys).agg(*sums)


def class_counts(cells: DataFrame) -> DataFrame:
    """The eight counts with each class in turn as the positive one, keyed by ``(facet, class)``.

    Row totals per side come from one row per facet, joined back by facet.
    """
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(zero)
    roles = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("l"), zero.alias("p"), hit.alias("h")),
        F.struct(F.col("prediction").alias("class"), zero.alias("l"), F.col("n").alias("p"), zero.alias("h")),
    )
    spread = cells.select("facet", "in_facet", F.inline(roles)).where("class IS NOT NULL")
    per_class = spread.groupBy("facet", "class").agg(
        *[
            tally(F.col("in_facet") if side == "d" else ~F.col("in_facet"), F.col(part)).alias(f"{part}_{side}")
            for side in SIDES
            for part in ("l", "p", "h")
        ]
    )
    totals = side_counts(cells).select("facet", "n_a", "n_d")
    return per_class.join(F.broadcast(totals), "facet")  # one row per configured facet


def _side(name: str, side: str) -> Column:
    return F.col(f"{name}_{side}").cast("double")


def pair_metrics() -> dict[str, Column]:
    """Metrics that need only the eight counts; null where a denominator is zero."""
    n = {s: _side("n", s) for s in SIDES}
    label = {s: _side("l", s) for s in SIDES}
    pred = {s: _side("p", s) for s in SIDES}
    hits = {s: _side("h", s) for s in SIDES}
    q = {s: ratio(label[s], n[s]) for s in SIDES}
    q_pred = {s: ratio(pred[s], n[s]) for s in SIDES}
    accept = {s: ratio(label[s], pred[s]) for s in SIDES}
    reject = {s: ratio(n[s] - label[s], n[s] - pred[s]) for s in SIDES}
    recall = {s: ratio(hits[s], label[s]) for s in SIDES}
    precision = {s: ratio(hits[s], pred[s]) for s in SIDES}
    true_negative = {s: n[s] - label[s] - pred[s] + hits[s] for s in SIDES}
    rejection_rate = {s: ratio(true_negative[s], n[s] - pred[s]) for s in SIDES}
    accuracy = {s: ratio(hits[s] + true_negative[s], n[s]) for s in SIDES}
    error_balance = {s: ratio(label[s] - hits[s], pred[s] - hits[s]) for s in SIDES}
    return {
        "CI": F.when((n["a"] > 0) & (n["d"] > 0), (n["a"] - n["d"]) / (n["a"] + n["d"])),
        "DPL": q["a"] - q["d"],
        "DPPL": q_pred["a"] - q_pred["d"],
        "DI": F.try_divide(q_pred["d"], q_pred["a"]),
        "DCA": accept["a"] - accept["d"],
        "DCR": reject["d"] - reject["a"],
        "RD": recall["a"] - recall["d"],
        "DAR": precision["a"] - precision["d"],
        "DRR": rejection_rate["d"] - rejection_rate["a"],
        "AD": accuracy["a"] - accuracy["d"],
        "TE": error_balance["d"] - error_balance["a"],
    }


def _divergence(p_a: Column, p_d: Column) -> dict[str, Column]:
    """Aggregates over label values, given both sides' probabilities of each value.

    KL is undefined as soon as one value never occurs in the facet.
    """
    mean = (p_a + p_d) / 2
    gap = p_a - p_d
    kl = entropy_gap(p_a, p_d)
    return {
        "KL": F.when(F.count(F.lit(1)) == F.count(kl), F.sum(kl)),
        "JS": F.sum(entropy_gap(p_a, mean) + entropy_gap(p_d, mean)) / 2,
        "LP": F.sqrt(F.sum(gap * gap)),
        "TVD": F.sum(F.abs(gap)) / 2,
        "KS": F.max(F.abs(gap)),
    }


def label_divergence(cells: DataFrame) -> DataFrame:
    """KL, JS, LP, TVD and KS between the label distributions of both sides, per facet."""
    # a filter on the label itself would be pushed below the shared aggregation and split it in two
    known = F.col("label").isNotNull()
    values = (
        cells.groupBy("facet", "label")
        .agg(
            tally(~F.col("in_facet") & known, F.col("n")).alias("v_a"),
            tally(F.col("in_facet") & known, F.col("n")).alias("v_d"),
        )
        .where("v_a + v_d > 0")
    )
    totals = values.groupBy("facet").agg(F.sum("v_a").alias("t_a"), F.sum("v_d").alias("t_d"))
    shares = values.join(F.broadcast(totals), "facet")  # one row per configured facet
    p_a, p_d = ratio(F.col("v_a"), F.col("t_a")), ratio(F.col("v_d"), F.col("t_d"))
    return shares.groupBy("facet").agg(*[c.alias(k) for k, c in _divergence(p_a, p_d).items()])


def _folded_divergence(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The same divergences on the two-valued distribution (positive class, rest)."""
    positive = F.struct(ratio(F.col("l_a"), F.col("n_a")).alias("p_a"), ratio(F.col("l_d"), F.col("n_d")).alias("p_d"))
    rest = F.struct(
        ratio(F.col("n_a") - F.col("l_a"), F.col("n_a")).alias("p_a"),
        ratio(F.col("n_d") - F.col("l_d"), F.col("n_d")).alias("p_d"),
    )
    both = counts.select(*keys, F.inline(F.array(positive, rest)))
    return both.groupBy(*keys).agg(*[c.alias(k) for k, c in _divergence(F.col("p_a"), F.col("p_d")).items()])


def conditional_disparity(cells: DataFrame, groups: list[str], positive: str, name: str) -> DataFrame:
    """Demographic disparity per subgroup, averaged with subgroup sizes, per facet.

    Disparity is the facet's share of the rejected minus its share of the accepted; a share over no
    rows is 0.
    """
    accepted, inside = F.col(positive), F.col("in_facet")
    per_group = cells.groupBy("facet", *groups).agg(
        F.sum("n").alias("size"),
        tally(~accepted, F.col("n")).alias("rejected"),
        tally(accepted, F.col("n")).alias("accepted"),
        tally(~accepted & inside, F.col("n")).alias("rejected_d"),
        tally(accepted & inside, F.col("n")).alias("accepted_d"),
    )
    disparity = ratio(F.col("rejected_d"), F.col("rejected"), 0.0) - ratio(F.col("accepted_d"), F.col("accepted"), 0.0)
    return per_group.groupBy("facet").agg(ratio(F.sum(F.col("size") * disparity), F.sum("size")).alias(name))


# Why a metric can be undefined.
REASONS = {
    "CDDL": "no group columns configured or no rows",
    "CDDPL": "no group columns configured or no rows",
    "KL": "a label value never occurs in the facet, or one side is empty",
}
_DEFAULT_REASON = "division by zero: one side has no rows of the kind the metric compares"


def report(df: DataFrame, spec: BiasSpec) -> DataFrame:
    """Requested metrics as ``(facet, stage, metric, value)``; an undefined metric has a null value.

    Post-training metrics are reported only when the spec names a prediction column.
    """
    post = spec.post_methods if spec.predicted_label_column else []
    wanted = [("pre", m) for m in spec.pre_methods] + [("post", m) for m in post]
    wide = _wide(facet_cells(df, spec), spec, [m for _, m in wanted])
    # Every facet of the spec is reported, also on a table that has no rows to count.
    names = F.array(*[F.lit(name) for name in dict.fromkeys(f.name for f in spec.facets)])
    asked = df.sparkSession.range(1).select(F.explode(names).alias("facet"))
    return _tidy(asked.join(wide, "facet", "left"), ["facet"], wanted)


def _wide(cells: DataFrame, spec: BiasSpec, methods: list[str]) -> DataFrame:
    """One row per facet with a column per metric; only the aggregations the methods need are planned."""
    groups = [f"group_{i}" for i in range(len(spec.group_columns))]
    frames = []
    pairs = {m: c for m, c in pair_metrics().items() if m in methods}
    if pairs:
        frames.append(side_counts(cells).select("facet", *[c.alias(m) for m, c in pairs.items()]))
    distances = [m for m in DISTRIBUTION_METRICS if m in methods]
    if distances:
        frames.append(label_divergence(cells).select("facet", *distances))
    conditional = {"CDDL": "label_positive", "CDDPL": "predicted_positive"}
    if groups:
        frames += [conditional_disparity(cells, groups, flag, m) for m, flag in conditional.items() if m in methods]
    if not frames:
        frames.append(cells.select("facet").distinct())
    wide = reduce(lambda left, right: left.join(right, "facet", "full_outer"), frames)  # one row per facet each
    undefined = [m for m in conditional if m in methods and not groups]
    return wide.select("*", *[F.lit(None).cast("double").alias(m) for m in undefined])


def _tidy(wide: DataFrame, keys: list[str], wanted: list[tuple[str, str]]) -> DataFrame:
    entries = F.array(
        *[
            F.struct(F.lit(stage).alias("stage"), F.lit(m).alias("metric"), F.col(m).alias("value"))
            for stage, m in wanted
        ]
    )
    return wide.select(*keys, F.inline(entries))


def one_vs_rest(df: DataFrame, spec: BiasSpec) -> DataFrame:
    """The report repeated with each class as the positive one: ``(facet, class, stage, metric, value)``."""
    post = [m for m in spec.post_methods if m != "CDDPL"] if spec.predicted_label_column else []
    wanted = [("pre", m) for m in spec.pre_methods if m != "CDDL"] + [("post", m) for m in post]
    counts = class_counts(facet_cells(df, spec))
    keys = ["facet", "class"]
    pairs = pair_metrics()
    methods = [m for _, m in wanted]
    wide = counts.select(*keys, *[c.alias(m) for m, c in pairs.items() if m in methods])
    if any(m in DISTRIBUTION_METRICS for m in methods):
        wide = wide.join(_folded_divergence(counts, keys), keys)
    return _tidy(wide, keys, wanted)


def drift(live: DataFrame, stored: DataFrame) -> DataFrame:
    """Change of every bias metric between a stored report and a live one."""
    keys = ["facet", "stage", "metric"]
    now = live.select(*keys, F.col("value").alias("current"))
    then = stored.select(*keys, F.col("value").alias("baseline"))
    return now.join(then, keys, "full_outer").withColumn("delta", F.col("current") - F.col("baseline"))


def errors(rows: DataFrame) -> DataFrame:
    """Requested metrics that could not be computed, with the reason."""
    reason = F.coalesce(
        reduce(
            lambda found, item: F.coalesce(found, F.when(F.col("metric") == item[0], F.lit(item[1]))),
            REASONS.items(),
            F.lit(None).cast("string"),
        ),
        F.lit(_DEFAULT_REASON),
    )
    return rows.where("value IS NULL").select("facet", "stage", "metric", reason.alias("error"))


def metrics_of(rows: DataFrame) -> DataFrame:
    defined = rows.where("value IS NOT NULL")
    name = F.concat_ws("/", "facet", "stage", "metric")
    return metric_rows(defined, ANALYSER, F.col("facet"), F.col("metric"), name, F.col("value"))


def scored(rows: DataFrame, spec: BiasSpec) -> DataFrame:
    """Adds ``violation`` and ``alert``: the absolute value beyond its threshold of either kind."""

    def beyond(limits: dict[str, float] | None) -> Column:
        hits = [(F.col("metric") == m) & (F.abs("value") > F.lit(float(t))) for m, t in (limits or {}).items()]
        return reduce(lambda a, b: a | b, hits, F.lit(False))

    defined = rows.where("value IS NOT NULL")
    return defined.select(
        "*", beyond(spec.thresholds).alias("violation"), beyond(spec.severity_alert_thresholds).alias("alert")
    )


def violations_of(flags: DataFrame, spec: BiasSpec) -> DataFrame:
    limit = reduce(
        lambda found, item: F.coalesce(found, F.when(F.col("metric") == item[0], F.lit(float(item[1])))),
        spec.thresholds.items(),
        F.lit(None).cast("double"),
    )
    hit = flags.where("violation")
    subject = F.concat_ws("/", "facet", "stage", "metric")
    return violation_rows(hit, ANALYSER, F.lit("bias"), subject, F.col("value"), threshold=limit)


def outcome_of(flags: DataFrame) -> DataFrame:
    """An alert cutoff raises the severity on its own; only violations change the outcome."""
    counted = flags.agg(
        tally(F.col("violation")).alias("violation_count"), F.coalesce(F.bool_or("alert"), F.lit(False)).alias("alert")
    )
    count = F.col("violation_count")
    return counted.select(
        F.lit(ANALYSER).alias("analyser"),
        F.when(count > 0, "succeeded_with_violations").otherwise("succeeded").alias("outcome"),
        F.when(F.col("alert"), "alert").when(count > 0, "warn").otherwise("info").alias("severity"),
        count,
    )
