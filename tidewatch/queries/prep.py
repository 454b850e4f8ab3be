"""Preparation queries: splits, drift injection, derived features, fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import prep, shadow
from tidewatch.queries.common import r, table, tidy
from tidewatch.spec import ShadowSpec


def split_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The half every order lands in."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    first, second = prep.split(orders, "o_orderkey", seed=7)
    return first.withColumn("side", F.lit(1)).unionByName(second.withColumn("side", F.lit(2)))


def inject_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's price in thousands, shifted by 3 to 11 and kept within 20 to 400."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / 1000).alias("thousands"))
    return tidy(prep.inject_drift(orders, "o_orderkey", "thousands", 3, 12, 20.0, 400.0, seed=1), "o_orderkey", "thousands")


def interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return tidy(prep.interaction(orders, "o_custkey", "o_totalprice", "product"), "o_orderkey", "product")


def ml_fit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit a model and a one-feature shadow model on one half of the parts, compare them on the other."""
    parts = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("double")
    price = F.col("p_retailprice")
    noise = F.pmod(F.xxhash64("p_partkey"), F.lit(40)).cast("double")
    labelled = parts.select(
        F.col("p_partkey").alias("row_id"),
        size.alias("size"),
        price.alias("price"),
        F.when(size + (price - 900) * 0.3 + noise > 60, "high").otherwise("low").alias("target"),
    )
    train, live = prep.split(labelled, "row_id", seed=3)
    spec = ShadowSpec("binary", "full", "size_only", probability_columns=["prob_positive"], join_key="row_id",
                      prediction_column="predicted_label")
    scored = [
        prep.predict(prep.fit_logistic(train, features, "target", "high", max_iter=25), live, "high", "low")
        for features in (["size", "price"], ["size"])
    ]
    return tidy(shadow.summary(shadow.comparison_cells(shadow.align(*scored, spec), spec)), "row_count", "agreement", "js_divergence")


QUERIES = {
    "split_baseline": split_baseline,
    "inject_drift": inject_drift,
    "interaction": interaction,
    "ml_fit_score": ml_fit_score,
}



def _bucket_sql(key: str, seed: int, buckets: int) -> str:
    return f"(('0x' || substr(md5({key}::VARCHAR || ':{seed}'), 1, 8))::BIGINT % {buckets})"


ORACLES = {
    "split_baseline": f"SELECT o_orderkey, CASE WHEN {_bucket_sql('o_orderkey', 7, 10_000)} < 5000 THEN 1 ELSE 2 END::INT AS side FROM orders",
    "inject_drift": f"""SELECT o_orderkey, {r(f"least(greatest(round(o_totalprice / 1000) + 3 + {_bucket_sql('o_orderkey', 1, 9)}, 20.0), 400.0)::DOUBLE")} AS thousands FROM orders""",
    "interaction": f"SELECT o_orderkey, {r('o_custkey::DOUBLE * o_totalprice')} AS product FROM orders",
}
