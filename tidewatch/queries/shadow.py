"""Shadow queries: two logistic scores of every order, paired by order key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import rollup, shadow
from tidewatch.plans.runs import Shadow
from tidewatch.queries.common import r, table, tidy
from tidewatch.spec import ShadowSpec

BY_KEY = {
    "problem_type": "binary",
    "serving_variant": "AllTraffic",
    "shadow_variant": "candidate",
    "probability_columns": ["p"],
    "join_key": "row_id",
    "agreement_threshold": 0.9,
    "js_divergence_threshold": 0.01,
}
BY_RANK = {**{k: v for k, v in BY_KEY.items() if k != "join_key"}, "order_by": "row_id"}
THREE = {**BY_KEY, "problem_type": "multiclass", "probability_columns": ["p_low", "p_mid", "p_high"]}


def _logistic(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def variants(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Serving scores all orders by price; the candidate weighs urgency and misses some orders."""
    orders = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice") / 100000.0 - 2.5
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0)
    serving_p, shadow_p = _logistic(price), _logistic(price * 0.8 + urgent - 0.2)

    def predicted(p: Column) -> list[Column]:
        return [F.col("o_orderkey").alias("row_id"), p.alias("p"), F.when(p > 0.5, "yes").otherwise("no").alias("prediction")]

    serving = orders.select(*predicted(serving_p))
    candidate = orders.where(F.col("o_orderstatus") != "P").select(*predicted(shadow_p))
    return serving, candidate


def three_classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Unnormalised class scores; a zero row and a missing score are part of the input."""
    orders = table(spark, sf_dir, "orders")
    x = F.col("o_totalprice") / 500000.0
    key = F.col("o_orderkey")

    def side(shift: float) -> DataFrame:
        low, mid, high = F.lit(1.0) - x, F.lit(0.5) + F.lit(shift), x
        zero = key % 23 == 0
        label = F.when(low >= F.greatest(mid, high), "low").when(mid >= high, "mid").otherwise("high")
        return orders.select(
            key.alias("row_id"),
            F.when(key % 29 != 0, label).alias("prediction"),
            F.when(zero, 0.0).otherwise(low).alias("p_low"),
            F.when(zero, 0.0).when(key % 31 == 0, None).otherwise(mid).alias("p_mid"),
            F.when(zero, 0.0).otherwise(high).alias("p_high"),
        )

    return side(0.0), side(0.1)


def _cells(spark: SparkSession, sf_dir: str, config: dict = BY_KEY, source=variants) -> DataFrame:
    spec = ShadowSpec.from_dict(config)
    return shadow.comparison_cells(shadow.align(*source(spark, sf_dir), spec), spec)


def align(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = shadow.align(*variants(spark, sf_dir), ShadowSpec.from_dict(BY_KEY))
    return pairs.select("key", "serving_prediction", "shadow_prediction")


def align_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    serving, _ = variants(spark, sf_dir)
    # the candidate saw the same orders under other keys, in the same order
    candidate = serving.select((F.col("row_id") * 3 + 7).alias("row_id"), "p", "prediction")
    pairs = shadow.align(serving, candidate, ShadowSpec.from_dict(BY_RANK))
    return pairs.select("key", "serving_prediction", "shadow_prediction")


def align_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired by the rank of a text: order numbers as words, which sort in another order than as numbers."""
    serving, _ = variants(spark, sf_dir)
    named = serving.withColumn("row_id", F.concat(F.lit("order-"), F.col("row_id").cast("string")))
    candidate = named.withColumn("row_id", F.concat(F.lit("retry-"), "row_id"))
    pairs = shadow.align(named, candidate, ShadowSpec.from_dict(BY_RANK))
    return pairs.select("key", "serving_prediction", "shadow_prediction")


def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(shadow.summary(_cells(spark, sf_dir)), "row_count", "agreement")


def js(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(shadow.summary(_cells(spark, sf_dir)), "js_divergence")


def js_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir, THREE, three_classes)
    return tidy(shadow.summary(cells), "row_count", "agreement", "js_divergence")


def per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(shadow.class_disagreement(_cells(spark, sf_dir, THREE, three_classes)), "class", "disagreement")


def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir, THREE, three_classes)
    return tidy(shadow.label_distribution(cells), "side", "class", "fraction")


def _analysis(spark: SparkSession, sf_dir: str):
    serving, candidate = variants(spark, sf_dir)
    return Shadow().compute({"serving_predictions": serving, "shadow_predictions": candidate}, BY_KEY)


def outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).outcome


def disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(rollup.overall_disagreement(_analysis(spark, sf_dir).metrics), "disagreement")


QUERIES = {
    "shadow_align": align,
    "shadow_align_ordered": align_ordered,
    "shadow_align_text": align_text,
    "shadow_agreement": agreement,
    "shadow_js": js,
    "shadow_js_multiclass": js_three,
    "shadow_per_class": per_class,
    "shadow_distribution": distribution,
    "shadow_outcome": outcome,
    "overall_disagreement": disagreement,
}

_PAIRS = """
WITH sc AS (
  SELECT o_orderkey AS k, o_orderstatus AS st, 1 / (1 + exp(-(o_totalprice / 100000.0::DOUBLE - 2.5::DOUBLE))) AS ps,
    1 / (1 + exp(-((o_totalprice / 100000.0::DOUBLE - 2.5::DOUBLE) * 0.8::DOUBLE
      + CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END - 0.2::DOUBLE))) AS pc FROM orders),
pairs AS (SELECT k, CASE WHEN ps > 0.5 THEN 'yes' ELSE 'no' END AS a, CASE WHEN pc > 0.5 THEN 'yes' ELSE 'no' END AS b,
    [1 - ps, ps] AS p, [1 - pc, pc] AS q FROM sc WHERE st <> 'P')
"""


def _three_sql(name: str, shift: float) -> str:
    return f"""{name} AS (
  SELECT k, CASE WHEN k % 29 = 0 THEN NULL WHEN 1.0::DOUBLE - x >= greatest(0.5 + {shift}::DOUBLE, x) THEN 'low'
      WHEN 0.5 + {shift}::DOUBLE >= x THEN 'mid' ELSE 'high' END AS pred,
    CASE WHEN k % 23 = 0 THEN [0.0::DOUBLE, 0, 0] WHEN k % 31 = 0 THEN NULL
      ELSE [(1 - x) / (1 - x + (0.5 + {shift}::DOUBLE) + x), (0.5 + {shift}::DOUBLE) / (1 - x + (0.5 + {shift}::DOUBLE) + x), x / (1 - x + (0.5 + {shift}::DOUBLE) + x)] END AS v
  FROM (SELECT o_orderkey AS k, o_totalprice / 500000.0::DOUBLE AS x FROM orders))"""


_THREE = f"WITH {_three_sql('sa', 0.0)}, {_three_sql('sb', 0.1)}, pairs AS (SELECT k, sa.pred AS a, sb.pred AS b, sa.v AS p, sb.v AS q FROM sa JOIN sb USING (k))"


def _kl_sql(p: str, q: str, width: int) -> str:
    def low(v: str) -> str:
        return f"least(greatest({v}, 1e-12), 1.0)"

    return " + ".join(
        f"{low(f'{p}[{i}]')} * (log2({low(f'{p}[{i}]')}) - log2({low(f'({p}[{i}] + {q}[{i}]) / 2')}))"
        for i in range(1, width + 1)
    )


def _js_sql(width: int) -> str:
    return f"coalesce(({_kl_sql('p', 'q', width)} + {_kl_sql('q', 'p', width)}) / 2, 0)"


_AGREE = "avg(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
ORACLES = {
    "shadow_align": f"{_PAIRS} SELECT k AS key, a AS serving_prediction, b AS shadow_prediction FROM pairs",
    "shadow_align_ordered": """WITH s AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS key,
        CASE WHEN 1 / (1 + exp(-(o_totalprice / 100000.0::DOUBLE - 2.5::DOUBLE))) > 0.5 THEN 'yes' ELSE 'no' END AS p FROM orders)
        SELECT key, p AS serving_prediction, p AS shadow_prediction FROM s""",
    "shadow_align_text": """WITH s AS (SELECT row_number() OVER (ORDER BY o_orderkey::VARCHAR) AS key,
        CASE WHEN 1 / (1 + exp(-(o_totalprice / 100000.0::DOUBLE - 2.5::DOUBLE))) > 0.5 THEN 'yes' ELSE 'no' END AS p FROM orders)
        SELECT key, p AS serving_prediction, p AS shadow_prediction FROM s""",
    "shadow_agreement": f"{_PAIRS} SELECT count(*)::BIGINT AS row_count, {r(_AGREE)} AS agreement FROM pairs",
    "shadow_js": f"{_PAIRS} SELECT {r(f'avg({_js_sql(2)})')} AS js_divergence FROM pairs",
    "shadow_js_multiclass": f"""{_THREE} SELECT count(*)::BIGINT AS row_count, {r(_AGREE)} AS agreement,
        {r(f'avg({_js_sql(3)})')} AS js_divergence FROM pairs""",
    "shadow_per_class": f"""{_THREE} SELECT a AS class, {r('avg(CASE WHEN a = b THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END)')} AS disagreement
        FROM pairs WHERE a IS NOT NULL GROUP BY a""",
    "shadow_distribution": f"""{_THREE}, both_sides AS (SELECT 'serving' AS side, a AS class FROM pairs UNION ALL SELECT 'shadow', b FROM pairs),
        c AS (SELECT side, class, count(*) AS n FROM both_sides WHERE class IS NOT NULL GROUP BY 1, 2)
        SELECT side, class, {r('n / (sum(n) OVER (PARTITION BY side))::DOUBLE')} AS fraction FROM c""",
    "shadow_outcome": f"""{_PAIRS}, s AS (SELECT {_AGREE} AS agr, avg({_js_sql(2)}) AS js FROM pairs),
        v AS (SELECT (CASE WHEN agr < 0.9 THEN 1 ELSE 0 END + CASE WHEN js > 0.01 THEN 1 ELSE 0 END) AS n FROM s)
        SELECT 'shadow' AS analyser, CASE WHEN n > 0 THEN 'succeeded_with_violations' ELSE 'succeeded' END AS outcome,
          CASE WHEN n = 0 THEN 'info' WHEN n >= 2 THEN 'alert' ELSE 'warn' END AS severity, n::BIGINT AS violation_count FROM v""",
    "overall_disagreement": f"{_PAIRS} SELECT {r(f'1 - {_AGREE}')} AS disagreement FROM pairs",
}
