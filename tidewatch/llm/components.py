"""Connected components by alternating large-star and small-star steps, each a combining aggregation and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, drop


def stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link each neighbour (large: each greater one, small: each smaller one and the node) to the least in reach."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("m"))
    joined = both.join(least, F.col("u") == F.col("node"))
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("node").alias("u"), F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` (its component's least node) for every node that an edge ``u, v`` has."""
    state, mark = cut(edges.select("u", "v").where(F.col("u") != F.col("v")), "edges"), None
    while True:
        before, state = state, cut(stars(stars(state, large=True), large=False), "edges")
        drop(before)
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
    return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
