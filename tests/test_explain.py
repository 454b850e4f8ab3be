import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import explain, prep, trees
from tidewatch.plans.runs import Explain
from tidewatch.spec import ExplainSpec

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, float(i % 7), float(i % 5) / 2, float(i % 3)) for i in range(120)]
    return spark.createDataFrame(rows, "id bigint, a double, b double, c double").repartition(6).cache()


def model(a, b, c):
    return 1 / (1 + math.exp(-(0.3 * a - 0.5 * b + 0.2 * a * c)))


def scorer():
    a, b, c = (F.col(f) for f in FEATURES)
    return explain.ExpressionScorer(1.0 / (1.0 + F.exp(-(a * 0.3 - b * 0.5 + a * c * 0.2))))


def brute(row, background):
    """Shapley values by the permutation definition."""
    def value(members):
        return sum(model(*[row[f] if f in members else bg[f] for f in FEATURES]) for bg in background) / len(background)

    phi = dict.fromkeys(FEATURES, 0.0)
    orders = list(itertools.permutations(FEATURES))
    for order in orders:
        for i, f in enumerate(order):
            phi[f] += (value(set(order[: i + 1])) - value(set(order[:i]))) / len(orders)
    return phi


def test_exact_attributions(spark, table):
    rows = explain.sample_rows(table, "id", 5, 1, FEATURES)
    background = explain.sample_rows(table, "id", 9, 2, FEATURES)
    phi = explain.local_attributions(explain.attributions(rows, background, FEATURES, scorer()), binary=True).collect()
    got = {(r["row_id"], r["feature"]): r["phi"] for r in phi}
    bg = [r.asDict() for r in background.collect()]
    for r in rows.collect():
        for f, expected in brute(r.asDict(), bg).items():
            assert got[(r["row_id"], f)] == pytest.approx(expected, abs=1e-12)


def test_permutations_converge_and_keep_the_sum(spark, table):
    rows = explain.sample_rows(table, "id", 4, 1, FEATURES)
    background = explain.sample_rows(table, "id", 6, 2, FEATURES)
    exact = {(r["row_id"], r["feature"]): r["phi"] for r in explain.local_attributions(
        explain.attributions(rows, background, FEATURES, scorer()), True).collect()}
    sampled = {(r["row_id"], r["feature"]): r["phi"] for r in explain.local_attributions(
        explain.attributions(rows, background, FEATURES, scorer(), permutations=200, method="permutation"), True).collect()}
    for row_id in {k[0] for k in exact}:
        assert sum(sampled[(row_id, f)] for f in FEATURES) == pytest.approx(sum(exact[(row_id, f)] for f in FEATURES))
    assert all(sampled[k] == pytest.approx(exact[k], abs=0.02) for k in exact)


def test_sample_is_stable(spark, table):
    one = explain.sample_rows(table, "id", 20, 0, FEATURES).collect()
    two = explain.sample_rows(table.repartition(31), "id", 20, 0, FEATURES).collect()
    other = explain.sample_rows(table, "id", 20, 1, FEATURES).collect()
    assert one == two and {r["row_id"] for r in one} != {r["row_id"] for r in other}


def test_run_reports_top_features_and_never_gates(spark, table):
    config = {"row_key": "id", "num_samples": 10, "background_size": 5, "top_k": 2, "label_column": "c"}
    a, b = F.col("a"), F.col("b")
    analysis = Explain(explain.ExpressionScorer(1.0 / (1.0 + F.exp(-(a - b * 0.01))))).compute({"features": table}, config)
    names = [r["name"] for r in analysis.metrics.collect()]
    assert names == ["shap/a", "shap/b"]
    row = analysis.outcome.first()
    assert (row["outcome"], row["severity"], row["violation_count"]) == ("succeeded", "info", 0)


def test_multiclass_is_non_negative(spark, table):
    p = 1.0 / (1.0 + F.exp(-F.col("a")))
    classes = explain.ExpressionScorer(p * 0.5, p * 0.5, 1.0 - p)
    spec = ExplainSpec.from_dict({"row_key": "id", "num_samples": 6, "background_size": 4, "agg_method": "mean"})
    _, scores = explain.explain(table, spec, classes, binary=False)
    got = {r["feature"]: r["importance"] for r in scores.collect()}
    assert got["a"] > 0 and got["b"] == pytest.approx(0, abs=1e-12)


def test_python_model(spark, table):
    import pandas as pd

    def predict(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return (a * 0.1 + b * 0.05) / 2

    spec = ExplainSpec.from_dict({"row_key": "id", "num_samples": 6, "background_size": 4})
    _, python = explain.explain(table, spec, explain.VectorisedScorer(FEATURES, predict), binary=True)
    expression = explain.ExpressionScorer((F.col("a") * 0.1 + F.col("b") * 0.05) / 2)
    _, native = explain.explain(table, spec, expression, binary=True)
    left = {r["feature"]: r["importance"] for r in python.collect()}
    right = {r["feature"]: r["importance"] for r in native.collect()}
    assert left == {k: pytest.approx(v) for k, v in right.items()}


def test_many_rows_use_many_tasks(spark):
    rows = spark.range(1500).select(F.col("id").alias("row_id"), *[(F.col("id") % (7 + k)).cast("double").alias(f) for k, f in enumerate(FEATURES)])
    phi = explain.attributions(rows, rows.limit(3), FEATURES, scorer(), max_rows=1500, max_background=3)
    tasks = phi.select(explain.ROW, F.spark_partition_id().alias("p")).distinct().groupBy("p").count()
    assert tasks.count() >= 8 and tasks.agg(F.max("count")).first()[0] < 1500 / 3


def test_drift_lists_new_and_lost_features(spark):
    live = spark.createDataFrame([("a", 0.5), ("b", 0.1)], "feature string, importance double")
    stored = spark.createDataFrame([("a", 0.2), ("c", 0.4)], "feature string, importance double")
    rows = {r["feature"]: r for r in explain.importance_drift(live, stored).collect()}
    assert rows["a"]["delta"] == pytest.approx(0.3) and rows["a"]["rank_change"] == -1
    assert rows["b"]["delta"] is None and rows["c"]["delta"] is None


def shapley(value, m):
    """Shapley values of a set function, by its definition."""
    phi = np.zeros(m)
    for i in range(m):
        rest = [k for k in range(m) if k != i]
        for size in range(m):
            for s in itertools.combinations(rest, size):
                weight = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
                phi[i] += weight * (value({*s, i}) - value(set(s)))
    return phi


def solved(member, weight, value, m):
    members, weights = explain.kernel_weights(member, weight)
    return sum(w * value({i for i in range(m) if z[i]}) for z, w in zip(members, weights, strict=True))


@pytest.mark.parametrize("m", [1, 2, 3, 4, 7])
def test_kernel_regression_on_all_coalitions_is_exact(m):
    rng = np.random.default_rng(m)
    table = dict(enumerate(rng.normal(size=2**m)))
    value = lambda s: table[sum(1 << i for i in s)]
    member, weight = explain.kernel_coalitions(m, 2**m, 0)
    assert len(member) == max(2**m - 2, 0)
    assert solved(member, weight, value, m) == pytest.approx(shapley(value, m), abs=1e-12)


def test_kernel_error_falls_and_the_sum_is_exact():
    m = 10
    rng = np.random.default_rng(1)
    w, pairs = rng.normal(size=m), rng.normal(size=(m, m))
    value = lambda s: math.tanh(sum(w[i] for i in s) / 2 + sum(pairs[i, j] for i in s for j in s if i < j) / 9)
    want = shapley(value, m)
    errors = []
    for budget in (24, 120, 400, 1022):
        got = np.mean([np.abs(solved(*explain.kernel_coalitions(m, budget, seed), value, m) - want).max() for seed in range(3)])
        assert solved(*explain.kernel_coalitions(m, budget, 0), value, m).sum() == pytest.approx(value(set(range(m))) - value(set()))
        errors.append(got)
    assert errors[0] > errors[1] > errors[2] > errors[3] and errors[3] < 1e-10


def test_kernel_coalitions_keep_to_their_budget():
    for m, budget in ((12, 100), (30, 256), (50, 64), (6, 2)):
        member, weight = explain.kernel_coalitions(m, budget, 0)
        assert 0 < len(member) <= budget and (weight > 0).all() and set(member.sum(axis=1)) <= set(range(1, m))
        assert sorted(map(tuple, member)) == sorted(map(tuple, 1 - member))


def test_kernel_job_equals_enumeration(spark, table):
    rows = explain.sample_rows(table, "id", 4, 1, FEATURES)
    background = explain.sample_rows(table, "id", 6, 2, FEATURES)
    found = {}
    for method in ("exact", "kernel"):
        phi = explain.attributions(rows, background, FEATURES, scorer(), method=method)
        found[method] = {(r["row_id"], r["feature"]): r["phi"] for r in explain.local_attributions(phi, True).collect()}
    assert found["kernel"] == {k: pytest.approx(v, abs=1e-12) for k, v in found["exact"].items()}


def random_nodes(rng, trees_, depth, features):
    rows = []
    for t in range(trees_):
        todo, used = [(0, depth)], 1
        while todo:
            node, left = todo.pop()
            if not left or (left < depth and rng.random() < 0.2):
                rows.append((t, node, None, None, None, None, float(rng.normal())))
            else:
                rows.append((t, node, int(rng.integers(features)), float(rng.integers(4)), used, used + 1, None))
                todo += [(used, left - 1), (used + 1, left - 1)]
                used += 2
    return rows


def output(nodes, x):
    known, total = {(n[0], n[1]): n for n in nodes}, 0.0
    for t in {n[0] for n in nodes}:
        node = known[t, 0]
        while node[2] is not None:
            node = known[t, node[4] if x[node[2]] <= node[3] else node[5]]
        total += node[6]
    return total


@pytest.mark.parametrize(("m", "depth"), [(3, 2), (3, 5), (6, 4)])
def test_tree_paths_equal_enumeration(spark, m, depth):
    rng = np.random.default_rng(m * depth)
    nodes = random_nodes(rng, 7, depth, m)
    names = [f"f{i}" for i in range(m)]
    draw = lambda: [None if rng.random() < 0.1 else float(rng.integers(5)) for _ in names]
    schema = ", ".join(f"{n} double" for n in names)
    rows = [(k, *draw()) for k in range(6)]
    background = [tuple(draw()) for _ in range(9)]
    phi = trees.tree_attributions(spark.createDataFrame(rows, f"row_id bigint, {schema}"), spark.createDataFrame(background, schema), names, nodes)
    got = {(r["row_id"], r["feature"]): r["phi"] for r in phi.collect()}
    number = lambda v: math.nan if v is None else v
    for k, *x in rows:
        value = lambda s, x=x: np.mean([output(nodes, [number(x[i] if i in s else b[i]) for i in range(m)]) for b in background])
        want = shapley(value, m)
        assert [got[k, n] for n in names] == pytest.approx(list(want), abs=1e-9)


def test_trees_of_fifty_features(spark):
    rng = np.random.default_rng(0)
    nodes, names = random_nodes(rng, 60, 6, 50), [f"f{i}" for i in range(50)]
    schema = ", ".join(f"{n} double" for n in names)
    data = rng.integers(0, 5, (300, 50)).astype(float).tolist()
    rows = spark.createDataFrame([(k, *x) for k, x in enumerate(data)], f"row_id bigint, {schema}")
    phi = trees.tree_attributions(rows, rows.drop("row_id").limit(200), names, nodes).groupBy("row_id").agg(F.sum("phi").alias("total"))
    leaves = trees.Leaves.of(nodes)
    base = leaves.output(np.array([r[:] for r in rows.drop("row_id").limit(200).collect()])).mean()
    want = leaves.output(np.array(data)) - base
    assert leaves.output(np.array(data[:20])) == pytest.approx([output(nodes, x) for x in data[:20]])
    assert {r["row_id"]: r["total"] for r in phi.collect()} == {k: pytest.approx(v, abs=1e-9) for k, v in enumerate(want)}


@pytest.mark.parametrize("kind", ["boosted", "forest", "tree"])
def test_nodes_of_fitted_models(spark, table, kind):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    make = {
        "boosted": lambda **k: GBTClassifier(maxIter=4, maxDepth=3, **k),
        "forest": lambda **k: RandomForestClassifier(numTrees=5, maxDepth=4, **k),
        "tree": lambda **k: DecisionTreeClassifier(maxDepth=4, **k),
    }
    data = table.withColumn("y", (F.col("a") * F.col("c") > F.col("b") * 3).cast("double"))
    fitted = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="v"), make[kind](featuresCol="v", labelCol="y", seed=1)]).fit(data)
    raw = vector_to_array(F.col("rawPrediction" if kind == "boosted" else "probability"))[1]
    scored = fitted.transform(data).select(*FEATURES, raw.alias("out")).collect()
    nodes = explain.TreeScorer.of_model(fitted).nodes()
    leaves = trees.Leaves.of(nodes)
    assert leaves.output(np.array([r[:3] for r in scored])) == pytest.approx([r["out"] for r in scored], abs=1e-9)
    spec = ExplainSpec.from_dict({"row_key": "id", "feature_columns": FEATURES, "num_samples": 5, "background_size": 8, "method": "tree"})
    local, importance = explain.explain(table, spec, explain.TreeScorer(nodes), binary=True)
    assert local.count() == 15 and importance.count() == 3


def test_rows_of_a_fit_are_dealt_evenly_whatever_their_file(spark):
    alike = spark.range(0, 2500, 1, 1).select(F.lit(1.0).alias("x"))
    sizes = [len(p) for p in prep.dealt(alike, 1000).rdd.glom().collect()]
    assert sorted(sizes) == [833, 833, 834]
    assert prep.dealt(alike, 2500).rdd.getNumPartitions() == 1
