"""Attribution queries: a constant-coefficient model over parts, explained on its sample."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import explain, prep
from tidewatch.plans.runs import Explain
from tidewatch.queries.common import r, scratch, table, tidy
from tidewatch.spec import ExplainSpec

FEATURES = ["size", "price", "brand"]
PERMUTATIONS = 4
COALITIONS, KERNEL_SEED = 4, 1
#: An ensemble of three trees, by node: tree, node, feature, threshold, left, right, value.
NODES = [
    (0, 0, 0, 25.0, 1, 2, None), (0, 1, 1, 930.0, 3, 4, None), (0, 2, 0, 40.0, 5, 6, None), (0, 3, None, None, None, None, -1.5),
    (0, 4, None, None, None, None, 0.25), (0, 5, 2, 30.0, 7, 8, None), (0, 6, None, None, None, None, 2.0),
    (0, 7, None, None, None, None, 0.5), (0, 8, None, None, None, None, -0.75),
    (1, 0, 2, 22.0, 1, 2, None), (1, 1, None, None, None, None, 0.3), (1, 2, 1, 960.0, 3, 4, None),
    (1, 3, None, None, None, None, -0.2), (1, 4, 0, 10.0, 5, 6, None), (1, 5, None, None, None, None, 1.1), (1, 6, None, None, None, None, -0.6),
    (2, 0, None, None, None, None, 0.125),
]
BASE = {"row_key": "part_id", "feature_columns": FEATURES, "num_samples": 100, "background_size": 50}


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    return rows.select(
        F.col("p_partkey").alias("part_id"),
        F.col("p_size").cast("double").alias("size"),
        F.col("p_retailprice").alias("price"),
        F.regexp_extract("p_brand", r"(\d+)$", 1).cast("double").alias("brand"),
        F.col("p_type").alias("kind"),
    )


def logit(brand_weight: float = 0.1) -> Column:
    size, price, brand = (F.col(c) for c in FEATURES)
    return size * 0.08 - 2.0 + (price - 950.0) * 0.02 - brand * brand_weight + size * brand * 0.002


def scorer(brand_weight: float = 0.1) -> explain.ExpressionScorer:
    return explain.ExpressionScorer(1.0 / (1.0 + F.exp(-logit(brand_weight))))


def _explained(spark: SparkSession, sf_dir: str, brand_weight: float = 0.1, **changes) -> tuple[DataFrame, DataFrame]:
    spec = ExplainSpec.from_dict({**BASE, **changes})
    return explain.explain(parts(spark, sf_dir), spec, scorer(brand_weight), binary=True)


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(explain.sample_rows(parts(spark, sf_dir), "part_id", 100, 0, FEATURES), "row_id", *FEATURES)


def shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    local, _ = _explained(spark, sf_dir)
    return tidy(local, "row_id", "feature", "phi")


def permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sample by four random orders of the features and their reverses."""
    local, _ = _explained(spark, sf_dir, method="permutation", permutations=PERMUTATIONS)
    return tidy(local, "row_id", "feature", "phi")


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    local, _ = _explained(spark, sf_dir)
    methods = {m: explain.global_importance(local, m) for m in ("mean_abs", "mean", "max_abs", "median")}
    joined = None
    for name, df in methods.items():
        df = df.withColumnRenamed("importance", name)
        joined = df if joined is None else joined.join(df, "feature")
    return tidy(joined, "feature", *methods)


def top(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, scores = _explained(spark, sf_dir)
    return tidy(explain.top_features(scores, 2), "feature", "importance")


def top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, scores = _explained(spark, sf_dir)
    return tidy(explain.metrics_of(scores, 10), "name", "value")


def multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three class scores without a link function between them, so that the oracle stays short."""
    p = 1.0 / (1.0 + F.exp(-logit()))
    model = explain.ExpressionScorer(p * p, p * (1.0 - p) * 2.0, (1.0 - p) * (1.0 - p))
    spec = ExplainSpec.from_dict(BASE)
    _, scores = explain.explain(parts(spark, sf_dir), spec, model, binary=False)
    return tidy(scores, "feature", "importance")


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, live = _explained(spark, sf_dir, brand_weight=0.3)
    _, stored = _explained(spark, sf_dir)
    moved = explain.importance_drift(live, stored)
    columns = ("feature", "current", "baseline", "delta", "current_rank", "baseline_rank", "rank_change")
    return tidy(moved, *columns)


def local_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-row attributions written as a table and read back."""
    local, _ = _explained(spark, sf_dir)
    path = scratch(spark, "local_attributions")
    local.write.parquet(path)
    return tidy(spark.read.parquet(path), "row_id", "feature", "phi")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the run beside its outcome, which is clean whatever they are."""
    analysis = Explain(scorer()).compute({"features": parts(spark, sf_dir)}, BASE)
    outcome = analysis.outcome.select(F.struct("outcome", "severity", "violation_count")).scalar()
    rows = tidy(analysis.metrics, "name", "value").withColumn("o", outcome)
    return rows.select("name", "value", "o.outcome", "o.severity", "o.violation_count")


def payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result document with saved local attributions, opened again: its importances as rows."""
    config = {**BASE, "save_local_shap_values": True}
    document = Explain(scorer()).compute({"features": parts(spark, sf_dir)}, config).payload(spark)
    local = F.json_array_length(F.get_json_object("document", "$.local_shap_values")).cast("bigint")
    scores = F.from_json(F.get_json_object("document", "$.kernel_shap"), "array<struct<feature:string,importance:double>>")
    return tidy(document.select(local.alias("local_values"), F.inline(scores)), "local_values", "feature", "importance")


def efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per explained row, attributions add up to its score minus the mean background score."""
    spec = ExplainSpec.from_dict(BASE)
    df = parts(spark, sf_dir)
    rows = explain.sample_rows(df, "part_id", spec.num_samples, 0, FEATURES)
    background = explain.sample_rows(df, "part_id", spec.background_size, 0, FEATURES)
    model = scorer()
    phi = explain.local_attributions(explain.attributions(rows, background, FEATURES, model), binary=True)
    scores = model.score(rows).select("row_id", F.col("probabilities")[1].alias("score"))
    expected = model.score(background).agg(F.avg(F.col("probabilities")[1])).scalar()
    sums = phi.groupBy("row_id").agg(F.sum("phi").alias("total"))
    return tidy(
        sums.join(scores, "row_id").select("row_id", "total", (F.col("score") - expected).alias("expected")),
        "row_id", "total", "expected",
    )


def _fitted(spark: SparkSession, sf_dir: str):
    df = parts(spark, sf_dir).withColumn("target", F.when(logit() > 0, "high").otherwise("low"))
    return df, prep.fit_logistic(df, FEATURES, "target", "high", max_iter=20)


def scorers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same explanation through the three kinds of model: expression, fitted pipeline, Python function."""
    df, model = _fitted(spark, sf_dir)
    spec = ExplainSpec.from_dict({**BASE, "num_samples": 50, "background_size": 20})

    def python_model(size: pd.Series, price: pd.Series, brand: pd.Series) -> pd.Series:
        z = size * 0.08 - 2.0 + (price - 950.0) * 0.02 - brand * 0.1 + size * brand * 0.002
        return 1.0 / (1.0 + (-z).map(__import__("math").exp))

    models = {
        "expression": scorer(),
        "pipeline": explain.PipelineScorer(model),
        "python": explain.VectorisedScorer(FEATURES, python_model),
    }
    parts_ = [
        explain.explain(df, spec, m, binary=True)[1].select(F.lit(name).alias("scorer"), "feature", "importance")
        for name, m in models.items()
    ]
    return tidy(parts_[0].unionByName(parts_[1]).unionByName(parts_[2]), "scorer", "feature", "importance")


def python_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample explained through a Python function on Arrow batches."""

    def model(size: pd.Series, price: pd.Series, brand: pd.Series) -> pd.Series:
        z = size * 0.08 - 2.0 + (price - 950.0) * 0.02 - brand * 0.1 + size * brand * 0.002
        return 1.0 / (1.0 + (-z).map(__import__("math").exp))

    local, _ = explain.explain(parts(spark, sf_dir), ExplainSpec.from_dict(BASE), explain.VectorisedScorer(FEATURES, model), binary=True)
    return tidy(local, "row_id", "feature", "phi")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributions of a fitted boosted-tree pipeline: interventional, on the probability scale."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    df = parts(spark, sf_dir).withColumn("target", (logit() > 0).cast("double"))
    model = Pipeline(
        stages=[
            VectorAssembler(inputCols=FEATURES, outputCol="assembled"),
            GBTClassifier(featuresCol="assembled", labelCol="target", maxIter=5, maxDepth=3, seed=0),
        ]
    ).fit(prep.dealt(df.select(*FEATURES, "target")))
    spec = ExplainSpec.from_dict({**BASE, "num_samples": 50, "background_size": 20})
    _, scores = explain.explain(df, spec, explain.PipelineScorer(model), binary=True)
    return tidy(scores, "feature", "importance")


def kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sample by the regression on two drawn pairs of coalitions, of three."""
    local, _ = _explained(spark, sf_dir, method="kernel", coalitions=COALITIONS, seed=KERNEL_SEED)
    return tidy(local, "row_id", "feature", "phi")


def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small ensemble, given by its nodes, explained by its paths."""
    spec = ExplainSpec.from_dict({**BASE, "method": "tree"})
    local, _ = explain.explain(parts(spark, sf_dir), spec, explain.TreeScorer(NODES), binary=True)
    return tidy(local, "row_id", "feature", "phi")


QUERIES = {
    "explain_kernel": kernel,
    "explain_tree_paths": tree_paths,
    "explain_sample": sample,
    "explain_shapley": shapley,
    "explain_permutation": permutation,
    "explain_local": local_saved,
    "explain_efficiency": efficiency,
    "explain_global": importance,
    "explain_topk": top,
    "explain_multiclass": multiclass,
    "explain_drift": drift,
    "explain_run": run,
    "explain_payload": payload,
    "explain_scorers": scorers,
    "explain_python_scorer": python_scorer,
    "explain_tree": tree,
    "top10_importance": top10,
}

_PICK = """
src AS (SELECT p_partkey AS id, p_size::DOUBLE AS size, p_retailprice AS price, regexp_extract(p_brand, '(\\d+)$', 1)::DOUBLE AS brand FROM part),
ordered AS (SELECT *, row_number() OVER (ORDER BY md5(id::VARCHAR || ':0'), id) AS rn FROM src),
x AS (SELECT * FROM ordered WHERE rn <= 100), b AS (SELECT * FROM ordered WHERE rn <= 50)
"""


def _score_sql(size: str, price: str, brand: str, weight: float = 0.1) -> str:
    return (
        f"1 / (1 + exp(-({size} * 0.08::DOUBLE - 2.0 + ({price} - 950.0) * 0.02::DOUBLE"
        f" - {brand} * {weight}::DOUBLE + {size} * {brand} * 0.002::DOUBLE)))"
    )


def _value_sql(weight: float, link: str) -> str:
    """v(mask) per row: mean score over the background with the features in mask taken from the row."""
    mixed = [f"CASE WHEN mask & {1 << i} > 0 THEN x.{f} ELSE b.{f} END" for i, f in enumerate(FEATURES)]
    return f"""val AS (SELECT id, mask, avg({link}) AS v FROM (
      SELECT x.id, mask, {_score_sql(*mixed, weight)} AS p FROM x, b, (SELECT unnest(range(0, 8)) AS mask)) GROUP BY id, mask)"""


def _phi_sql(weight: float = 0.1, link: str = "p") -> str:
    """Textbook form: marginal gains over all coalitions without the feature."""
    parts_ = " UNION ALL ".join(
        f"""SELECT hi.id, '{f}' AS feature, sum((hi.v - lo.v) * CASE bit_count(lo.mask) WHEN 1 THEN 1.0::DOUBLE / 6 ELSE 1.0::DOUBLE / 3 END) AS phi
        FROM val hi JOIN val lo ON hi.id = lo.id AND lo.mask & {1 << i} = 0 AND hi.mask = lo.mask + {1 << i} GROUP BY hi.id"""
        for i, f in enumerate(FEATURES)
    )
    return f"{_PICK}, {_value_sql(weight, link)}, phi AS ({parts_})"


def _permuted_sql() -> str:
    """Mean gain of each feature when it joins those before it, over the orders the sampler draws."""
    gains = []
    for order in explain.permutation_orders(len(FEATURES), PERMUTATIONS, 0):
        masks = [sum(1 << i for i in order[:k]) for k in range(len(order) + 1)]
        gains += [
            f"SELECT hi.id, '{FEATURES[i]}' AS feature, hi.v - lo.v AS gain FROM val hi JOIN val lo ON hi.id = lo.id AND hi.mask = {masks[k + 1]} AND lo.mask = {masks[k]}"
            for k, i in enumerate(order)
        ]
    return f"""WITH {_PICK}, {_value_sql(0.1, 'p')}, gains AS ({' UNION ALL '.join(gains)})
      SELECT id AS row_id, feature, {r('avg(gain)')} AS phi FROM gains GROUP BY id, feature"""


def _kernel_sql() -> str:
    """One row's normal equations of the regression, two unknowns after the sum is taken in, solved by Cramer's rule."""
    member, weight = explain.kernel_coalitions(len(FEATURES), COALITIONS, KERNEL_SEED)
    drawn = ", ".join(
        f"({sum(1 << i for i in range(3) if z[i])}, {z[0] - z[2]:.0f}, {z[1] - z[2]:.0f}, {z[2]:.0f}, {float(w)!r}::DOUBLE)"
        for z, w in zip(member, weight, strict=True)
    )
    return f"""WITH {_PICK.replace("':0'", f"':{KERNEL_SEED}'")}, {_value_sql(0.1, 'p')}, drawn(mask, z1, z2, last, w) AS (VALUES {drawn}),
      ends AS (SELECT id, max(v) FILTER (mask = 0) AS base, max(v) FILTER (mask = 7) AS full FROM val GROUP BY id),
      eq AS (SELECT id, any_value(ends."full") AS f, any_value(base) AS e, sum(w * z1 * z1) AS a, sum(w * z1 * z2) AS b, sum(w * z2 * z2) AS c,
          sum(w * z1 * (v - base - last * (ends."full" - base))) AS y1, sum(w * z2 * (v - base - last * (ends."full" - base))) AS y2
        FROM val JOIN drawn USING (mask) JOIN ends USING (id) GROUP BY id),
      sol AS (SELECT id, f - e AS total, (c * y1 - b * y2) / (a * c - b * b) AS p1, (a * y2 - b * y1) / (a * c - b * b) AS p2 FROM eq)
      SELECT id AS row_id, unnest(['size', 'price', 'brand']) AS feature,
        unnest([{r('p1')}, {r('p2')}, {r('total - p1 - p2')}]) AS phi FROM sol"""


def _tree_sql() -> str:
    """The ensemble's output for every mix of a row and a background row, and Shapley values by their definition."""
    mixed = [f"CASE WHEN mask & {1 << i} > 0 THEN x.{f} ELSE b.{f} END" for i, f in enumerate(FEATURES)]

    def output(tree: int, node: int) -> str:
        feature, threshold, left, right, value = next(n[2:] for n in NODES if n[:2] == (tree, node))
        if feature is None:
            return f"{value}::DOUBLE"
        return f"CASE WHEN {mixed[feature]} <= {threshold} THEN {output(tree, left)} ELSE {output(tree, right)} END"

    total = " + ".join(output(t, 0) for t in sorted({n[0] for n in NODES}))
    values = f"""val AS (SELECT x.id, mask, avg({total}) AS v FROM x, b, (SELECT unnest(range(0, 8)) AS mask) GROUP BY x.id, mask)"""
    return f"WITH {_phi_sql().replace(_value_sql(0.1, 'p'), values)} SELECT id AS row_id, feature, {r('phi')} AS phi FROM phi"


_CLASS_LINKS = ("p * p", "2 * p * (1 - p)", "(1 - p) * (1 - p)")
_MULTI = ", ".join(
    f"c{i} AS (WITH {_phi_sql(0.1, link)} SELECT * FROM phi)" for i, link in enumerate(_CLASS_LINKS)
)
_IMPORTANCE = "SELECT feature, avg(abs(phi)) AS importance FROM phi GROUP BY feature"
_LOCAL = f"WITH {_phi_sql()} SELECT id AS row_id, feature, {r('phi')} AS phi FROM phi"

ORACLES = {
    "explain_kernel": _kernel_sql(),
    "explain_tree_paths": _tree_sql(),
    "explain_sample": f"WITH {_PICK} SELECT id AS row_id, {r('size')} AS size, {r('price')} AS price, {r('brand')} AS brand FROM x",
    "explain_shapley": _LOCAL,
    "explain_permutation": _permuted_sql(),
    "explain_local": _LOCAL,
    "explain_python_scorer": _LOCAL,
    "explain_efficiency": f"""WITH {_PICK}, m AS (SELECT avg({_score_sql('size', 'price', 'brand')}) AS e FROM b)
        SELECT id AS row_id, {r(_score_sql('size', 'price', 'brand') + ' - e')} AS total,
        {r(_score_sql('size', 'price', 'brand') + ' - e')} AS expected FROM x, m""",
    "explain_global": f"""WITH {_phi_sql()} SELECT feature, {r('avg(abs(phi))')} AS mean_abs, {r('avg(phi)')} AS mean,
        {r('max(abs(phi))')} AS max_abs, {r('quantile_cont(phi, 0.5)')} AS median FROM phi GROUP BY feature""",
    "explain_topk": f"""WITH {_phi_sql()}, g AS ({_IMPORTANCE})
        SELECT feature, {r('importance')} AS importance FROM g ORDER BY abs(g.importance) DESC, feature LIMIT 2""",
    "top10_importance": f"WITH {_phi_sql()}, g AS ({_IMPORTANCE}) SELECT 'shap/' || feature AS name, {r('importance')} AS value FROM g",
    "explain_payload": f"""WITH {_phi_sql()} SELECT (SELECT count(*) FROM phi)::BIGINT AS local_values, feature,
        {r('avg(abs(phi))')} AS importance FROM phi GROUP BY feature""",
    "explain_multiclass": f"""WITH {_MULTI}, local AS (
          SELECT id, feature, avg(abs(phi)) AS phi FROM (SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2) GROUP BY id, feature)
        SELECT feature, {r('avg(abs(phi))')} AS importance FROM local GROUP BY feature""",
    "explain_drift": f"""WITH live AS (WITH {_phi_sql(0.3)} {_IMPORTANCE}), stored AS (WITH {_phi_sql()} {_IMPORTANCE}),
        l AS (SELECT *, row_number() OVER (ORDER BY abs(importance) DESC, feature)::INTEGER AS rk FROM live),
        s AS (SELECT *, row_number() OVER (ORDER BY abs(importance) DESC, feature)::INTEGER AS rk FROM stored)
        SELECT feature, {r('l.importance')} AS current, {r('s.importance')} AS baseline, {r('l.importance - s.importance')} AS delta,
          l.rk AS current_rank, s.rk AS baseline_rank, l.rk - s.rk AS rank_change FROM l FULL JOIN s USING (feature)""",
    "explain_run": f"""WITH {_phi_sql()}, g AS ({_IMPORTANCE}) SELECT 'shap/' || feature AS name, {r('importance')} AS value,
        'succeeded' AS outcome, 'info' AS severity, 0::BIGINT AS violation_count FROM g""",
}
