"""Shapley attributions as a relational job.

A sampled row is combined with every coalition of features and every background row; the mixed rows are
scored by the model, and one aggregation per explained row turns scores into attributions. Coalitions
carry their weight for each feature, so no score has to be matched with another one: with ``M``
features

    phi_f = sum over (coalition c, background b) of weight(c, f) * score(mix(c, row, b)) / |B|

By the method asked for, every coalition is enumerated, or the coalitions are the prefixes of random permutations and
their reverses, or they are a sample whose weights solve the kernel regression. Trees have a way of their own
(:mod:`tidewatch.operators.trees`).
"""

from __future__ import annotations

import itertools
import json
import math
import random
from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.values import quoted
from tidewatch.operators import trees
from tidewatch.result import metric_rows
from tidewatch.session import written
from tidewatch.spec import ExplainSpec

ANALYSER = "explain"
ROW = "row_id"
#: Mixed rows that one task makes; more are spread over more tasks.
CELLS_PER_TASK = 2_000_000


class Scorer(Protocol):
    """A model: adds an array column ``probabilities`` (one entry per class) to a feature table."""

    def score(self, df: DataFrame) -> DataFrame: ...


class ExpressionScorer:
    """A model that is a column expression over the features; stays inside generated code.

    One expression is the positive-class probability ``p`` and becomes ``[1 - p, p]``; several are taken
    as the class probabilities.
    """

    def __init__(self, *expressions: Column):
        self._expressions = expressions

    def score(self, df: DataFrame) -> DataFrame:
        if len(self._expressions) == 1:
            p = self._expressions[0]
            return df.withColumn("probabilities", F.array(F.lit(1.0) - p, p))
        return df.withColumn("probabilities", F.array(*self._expressions))


class PipelineScorer:
    """A fitted ``pyspark.ml`` classification model or pipeline."""

    def __init__(self, model, probability_column: str = "probability"):
        self._model = model
        self._column = probability_column

    def score(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        scored = self._model.transform(df)
        return scored.select(*df.columns, vector_to_array(F.col(self._column)).alias("probabilities"))


class TreeScorer:
    """A tree ensemble given by its nodes (:data:`tidewatch.operators.trees.NODE_SCHEMA`), for ``method="tree"``.

    Attributions are on the scale of the leaf values: the margin of boosted trees, the probability of forests.
    """

    def __init__(self, nodes: Sequence[tuple]):
        self._nodes = list(nodes)

    @classmethod
    def of_model(cls, model, target: int = 1) -> TreeScorer:
        """A fitted ``pyspark.ml`` tree model, or a pipeline that ends with one."""
        return cls(trees.nodes_of(model.stages[-1] if hasattr(model, "stages") else model, target))

    def nodes(self) -> list[tuple]:
        return self._nodes


class VectorisedScorer:
    """Any Python model, called on Arrow batches of feature columns through a pandas UDF.

    ``predict`` gets one pandas Series per feature and returns either positive-class probabilities or
    one list of class probabilities per row.
    """

    def __init__(self, features: Sequence[str], predict: Callable, binary: bool = True):
        self._features = list(features)
        self._binary = binary
        self._udf = F.pandas_udf(predict, "double" if binary else "array<double>")

    def score(self, df: DataFrame) -> DataFrame:
        value = self._udf(*[F.col(quoted(c)) for c in self._features])
        if not self._binary:
            return df.withColumn("probabilities", value)
        return df.withColumn("probabilities", F.array(F.lit(1.0) - value, value))


def feature_columns(df: DataFrame, spec: ExplainSpec) -> list[str]:
    """The model's feature order, or all columns but the row key and the label."""
    if spec.feature_columns:
        return list(spec.feature_columns)
    return [c for c in df.columns if c not in (spec.row_key, spec.label_column)]


def sample_rows(df: DataFrame, key: str, size: int, seed: int, columns: Sequence[str]) -> DataFrame:
    """``size`` rows in hash order of their key: the same rows for any partitioning or file layout."""
    digest = F.md5(F.concat_ws(":", F.col(quoted(key)).cast("string"), F.lit(str(seed))))
    picked = df.select(F.col(quoted(key)).alias(ROW), *[F.col(quoted(c)) for c in columns], digest.alias("__order"))
    return picked.orderBy("__order", ROW).limit(size).drop("__order")


def sample_pair(df: DataFrame, spec: ExplainSpec, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows to explain and the background: the first of one sample, which is drawn once and written."""
    larger = max(spec.num_samples, spec.background_size)
    sample = sample_rows(df, spec.row_key, larger, spec.seed, columns)
    # at most 10,000 rows by the spec
    place = F.row_number().over(Window.orderBy(F.md5(F.concat_ws(":", F.col(ROW).cast("string"), F.lit(str(spec.seed)))), ROW))
    drawn = written(sample.withColumn("__place", place), "sample")
    picked = lambda size: drawn.where(F.col("__place") <= size).drop("__place")
    return picked(spec.num_samples), picked(spec.background_size)


def _exact_coalitions(features: Sequence[str]) -> tuple[list[tuple[str, Column]], dict[str, Column], dict[str, Column]]:
    m = len(features)
    weights = [math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)]
    table = F.array(*[F.lit(w) for w in weights])
    generators = [("coalition", F.explode(F.sequence(F.lit(0), F.lit(2**m - 1))))]
    mask = F.col("coalition")
    member = {f: F.shiftright(mask, i).bitwiseAND(F.lit(1)) == 1 for i, f in enumerate(features)}
    size = F.bit_count(mask)
    weight = {
        f: F.when(member[f], F.get(table, size - 1)).otherwise(-F.get(table, size)) for f in features
    }
    return generators, member, weight


def permutation_orders(m: int, permutations: int, seed: int) -> list[list[int]]:
    """Random orders of the features, each followed by its reverse."""
    source = random.Random(seed)
    orders = []
    for _ in range((permutations + 1) // 2):
        order = list(range(m))
        source.shuffle(order)
        orders += [order, order[::-1]]  # antithetic pair
    return orders


def _sampled_coalitions(
    features: Sequence[str], permutations: int, seed: int
) -> tuple[list[tuple[str, Column]], dict[str, Column], dict[str, Column]]:
    m = len(features)
    orders = permutation_orders(m, permutations, seed)
    ranks = F.array(*[F.array(*[F.lit(order.index(i)) for i in range(m)]) for order in orders])
    generators = [("ranks", F.explode(ranks)), ("prefix", F.explode(F.sequence(F.lit(0), F.lit(m))))]
    rank = {f: F.col("ranks")[i] for i, f in enumerate(features)}
    member = {f: rank[f] < F.col("prefix") for f in features}
    share = 1.0 / len(orders)
    # the feature gains its marginal value when the prefix grows from its rank to rank + 1
    weight = {
        f: F.when(rank[f] == F.col("prefix") - 1, F.lit(share)).when(rank[f] == F.col("prefix"), F.lit(-share)).otherwise(0.0)
        for f in features
    }
    return generators, member, weight


def kernel_coalitions(m: int, budget: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Coalitions (rows of members) and their kernel weights, the empty and the full one left out.

    Sizes are taken from both ends, where the kernel weighs most, as long as all coalitions of a size fit the budget;
    the rest of the budget is drawn from the other sizes, each draw with its complement. With a budget of two to the
    number of features every coalition is in.
    """
    mass = {s: (m - 1) / (s * (m - s)) for s in range(1, m)}
    found: dict[tuple[int, ...], float] = {}
    sizes = [s for s in range(1, m // 2 + 1)]
    left = budget
    while sizes:
        s = sizes[0]
        both = {s, m - s}
        if sum(math.comb(m, k) for k in both) > left:
            break
        for k in both:
            for members in itertools.combinations(range(m), k):
                found[members] = mass[k] / math.comb(m, k)
        left -= sum(math.comb(m, k) for k in both)
        sizes.pop(0)
    if sizes and left >= 2:
        source, draws = random.Random(seed), left // 2
        shares = [mass[s] if 2 * s == m else 2 * mass[s] for s in sizes]
        each = sum(shares) / (2 * draws)
        for s in source.choices(sizes, shares, k=draws):
            members = tuple(sorted(source.sample(range(m), s)))
            for part in (members, tuple(i for i in range(m) if i not in members)):
                found[part] = found.get(part, 0.0) + each
    member = np.zeros((len(found), m))
    for row, members in zip(member, found, strict=True):
        row[list(members)] = 1.0
    return member, np.array(list(found.values()))


def kernel_weights(member: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each coalition's score counts for each feature, with the empty and the full coalition as first and last row.

    The regression fits ``score = base + sum of phi over the members`` by weighted least squares, with the phi adding
    up to the full score less the base. Putting the last phi in terms of the others leaves a plain regression of
    ``score - base - z_m (full - base)`` on ``z - z_m``. Its normal equations have the same matrix for every row, and
    their solution is linear in the scores: so solving them is summing scores with the weights returned here.
    """
    m = member.shape[1]
    last = member[:, -1:]
    z = member[:, :-1] - last
    # Coalitions too few for all features leave the equations open; of the solutions the shortest is taken.
    solved = np.linalg.pinv(z.T @ (z * weight[:, None])) @ (z * weight[:, None]).T if m > 1 else np.zeros((0, len(member)))
    full, base = -solved @ last, -solved @ (1.0 - last)
    rows = np.concatenate([base, solved, full], axis=1)
    closing = -rows.sum(axis=0, keepdims=True)
    closing[0, 0] -= 1.0
    closing[0, -1] += 1.0
    members = np.concatenate([np.zeros((1, m)), member, np.ones((1, m))])
    return members, np.concatenate([rows, closing]).T


def _kernel_coalitions(features: Sequence[str], budget: int, seed: int) -> tuple[list[tuple[str, Column]], dict[str, Column], dict[str, Column], int]:
    members, weights = kernel_weights(*kernel_coalitions(len(features), budget, seed))
    # One literal, folded once, whatever the number of coalitions.
    table = json.dumps([{"z": z, "w": w} for z, w in zip(members.astype(bool).tolist(), weights.tolist(), strict=True)])
    parsed = F.from_json(F.lit(table), "array<struct<z:array<boolean>,w:array<double>>>")
    member = {f: F.col("coalition")["z"][i] for i, f in enumerate(features)}
    weight = {f: F.col("coalition")["w"][i] for i, f in enumerate(features)}
    return [("coalition", F.explode(parsed))], member, weight, len(members)


def attributions(
    rows: DataFrame,
    background: DataFrame,
    features: Sequence[str],
    scorer: Scorer,
    permutations: int = 32,
    seed: int = 0,
    max_rows: int = 10_000,
    max_background: int = 500,
    method: str = "exact",
    coalitions: int = 256,
) -> DataFrame:
    """``(row_id, class, feature, phi)`` for each row of ``rows`` (``row_id`` plus the features).

    ``background`` becomes one array that rides along with every row: callers bound it by the spec
    (at most 500 rows). The explained rows are spread by ``row_id`` over a fixed number of tasks, one for every
    ``CELLS_PER_TASK`` mixed rows and at least one for each core; a row's cells never leave their task until they
    are summed, so the final aggregation reuses that partitioning. ``method`` is ``exact`` (two to the number of
    features coalitions), ``permutation``, or ``kernel`` (a regression on up to ``coalitions`` of them).
    """
    if method == "exact":
        generators, member, weight = _exact_coalitions(features)
        coalitions = 2 ** len(features)
    elif method == "kernel":
        generators, member, weight, coalitions = _kernel_coalitions(features, coalitions, seed)
    else:
        generators, member, weight = _sampled_coalitions(features, permutations, seed)
        coalitions = 2 * ((permutations + 1) // 2) * (len(features) + 1)
    cells = max_rows * coalitions * max_background
    # A number of its own: adaptive execution would merge the few small rows into one task before they multiply.
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(cells / CELLS_PER_TASK))

    # flat columns rather than nested fields: generators and Python models then see plain attributes
    numbered = list(enumerate(features))
    packed = background.select(F.struct(*[F.col(quoted(f)).alias(f"__b{i}") for i, f in numbered]).alias("b"))
    pool = packed.agg(F.collect_list("b")).scalar()
    own = rows.select(ROW, *[F.col(quoted(f)).alias(f"__x{i}") for i, f in numbered])
    mixed = own.repartition(min(tasks, max_rows), ROW).withColumn("pool", pool).withColumn("pool_size", F.size("pool"))
    for name, generator in generators:
        mixed = mixed.withColumn(name, generator)
    mixed = mixed.select("*", F.inline("pool")).select(
        ROW,
        *[F.when(member[f], F.col(f"__x{i}")).otherwise(F.col(f"__b{i}")).alias(f) for i, f in numbered],
        F.array(*[weight[f] / F.col("pool_size") for f in features]).alias("__weights"),
    )
    scored = scorer.score(mixed).select(ROW, "__weights", F.posexplode("probabilities").alias("class", "p"))
    sums = [F.sum(F.col("__weights")[i] * F.col("p")).alias(f"phi_{i}") for i in range(len(features))]
    wide = scored.groupBy(ROW, "class").agg(*sums)
    entries = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f"phi_{i}").alias("phi")) for i, f in enumerate(features)]
    )
    return wide.select(ROW, "class", F.inline(entries))


def local_attributions(phi: DataFrame, binary: bool) -> DataFrame:
    """One value per ``(row_id, feature)``: the positive class for two classes, else mean absolute value.

    Averaging absolute values over classes loses the sign, so for several classes ``mean`` and
    ``mean_abs`` are the same.
    """
    if binary:
        return phi.where(F.col("class") == 1).select(ROW, "feature", "phi")
    return phi.groupBy(ROW, "feature").agg(F.avg(F.abs("phi")).alias("phi"))


def global_importance(local: DataFrame, method: str) -> DataFrame:
    """``(feature, importance)`` over all explained rows."""
    reducers = {
        "mean_abs": F.avg(F.abs("phi")),
        "mean": F.avg("phi"),
        "max_abs": F.max(F.abs("phi")),
        "median": F.median("phi"),
    }
    return local.groupBy("feature").agg(reducers[method].alias("importance"))


def top_features(importance: DataFrame, k: int) -> DataFrame:
    """The ``k`` features of largest absolute importance; ties go by name."""
    return importance.orderBy(F.abs("importance").desc(), "feature").limit(k)


def importance_drift(live: DataFrame, stored: DataFrame) -> DataFrame:
    """Change of importance and rank per feature between a stored report and a live one."""

    def placed(df: DataFrame, value: str, rank: str) -> DataFrame:
        # one row per model feature: the window ranks a report, not data
        order = Window.partitionBy(F.lit(1)).orderBy(F.abs("importance").desc(), "feature")
        return df.select("feature", F.col("importance").alias(value), F.row_number().over(order).alias(rank))

    joined = placed(live, "current", "current_rank").join(
        placed(stored, "baseline", "baseline_rank"), "feature", "full_outer"
    )
    return joined.withColumn("delta", F.col("current") - F.col("baseline")).withColumn(
        "rank_change", F.col("current_rank") - F.col("baseline_rank")
    )


def explain(df: DataFrame, spec: ExplainSpec, scorer: Scorer, binary: bool) -> tuple[DataFrame, DataFrame]:
    """``(local attributions, global importance)`` of the sampled rows."""
    features = feature_columns(df, spec)
    rows, background = sample_pair(df, spec, features)
    if spec.method == "tree":
        local = trees.tree_attributions(rows, background, features, scorer.nodes(), spec.background_size)
        return local, global_importance(local, spec.agg_method)
    phi = attributions(
        rows,
        background,
        features,
        scorer,
        spec.permutations,
        spec.seed,
        spec.num_samples,
        spec.background_size,
        spec.method,
        spec.coalitions,
    )
    local = local_attributions(phi, binary)
    return local, global_importance(local, spec.agg_method)


def metrics_of(importance: DataFrame, k: int) -> DataFrame:
    name = F.concat(F.lit("shap/"), "feature")
    return metric_rows(
        top_features(importance, k), ANALYSER, F.col("feature"), F.lit("importance"), name, F.col("importance")
    )
