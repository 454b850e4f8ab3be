"""Ground truth: joining captured predictions with labels that arrive later."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.severity import default_severity

# Units of a lookback such as "7d".
_UNITS = {"d": "days", "h": "hours", "m": "minutes", "w": "weeks"}


def interval(lookback: str) -> str:
    match = re.fullmatch(r"(\d+)([dhmw])", lookback)
    if not match:
        raise ValueError(f"lookback must look like '7d' or '12h', got {lookback!r}")
    return f"INTERVAL {match[1]} {_UNITS[match[2]]}"


def latest_labels(labels: DataFrame, as_of: datetime, since: Column | None = None) -> DataFrame:
    """``(inference_id, label, label_ts)``: the newest label per id known at ``as_of``, of those from ``since`` on.

    ``max`` over a struct combines map-side, so an id with very many labels stays cheap, where a
    ranking window would sort all of them in one task. Equal timestamps go to the larger label.
    """
    known = labels.where(F.col("label_ts") <= F.lit(as_of))
    known = known if since is None else known.where(F.col("label_ts") >= since)
    newest = F.max(F.struct("label_ts", "label"))
    return known.groupBy("inference_id").agg(newest.alias("newest")).select("inference_id", "newest.label", "newest.label_ts")


def join_truth(captures: DataFrame, labels: DataFrame, as_of: datetime, lookback: str = "7d") -> DataFrame:
    """Captures of the lookback window before ``as_of``, with their newest label or null.

    A label counts from its capture on, as in the stream: one dated before is of another event. If the newest one is
    too early, all are. The time filters reach both scans (partition pruning when tables are laid out by date).
    """
    since = F.lit(as_of) - F.expr(interval(lookback))
    window = captures.where((F.col("ts") >= since) & (F.col("ts") <= F.lit(as_of)))
    joined = window.join(latest_labels(labels, as_of, since), "inference_id", "left")
    counts = F.col("label_ts") >= F.col("ts")
    return joined.withColumn("label", F.when(counts, F.col("label"))).withColumn("label_ts", F.when(counts, F.col("label_ts")))


def settled_truth(captures: DataFrame, labels: DataFrame, as_of: datetime, lookback: str = "7d") -> DataFrame:
    """Captures whose lookback has passed at ``as_of``, with the newest label that came within it, or null.

    What the label stream gives, from stored tables: it does not depend on when it is asked. Labels are reduced per
    capture by a combining aggregate behind the join, as the bound differs from capture to capture.
    """
    span = F.expr(interval(lookback))
    closed = captures.where(F.col("ts") + span < F.lit(as_of)).dropDuplicates()
    named = labels.select(F.col("inference_id").alias("__label_id"), "label", "label_ts")
    within = (F.col("label_ts") >= F.col("ts")) & (F.col("label_ts") <= F.col("ts") + span)
    joined = closed.join(named, (F.col("inference_id") == F.col("__label_id")) & within, "left")
    newest = F.max(F.struct("label_ts", "label")).alias("newest")
    return joined.groupBy(*captures.columns).agg(newest).select(*captures.columns, "newest.label", "newest.label_ts")


def coverage(joined: DataFrame, min_coverage: float = 0.30) -> DataFrame:
    """One row: captured, matched, coverage, and the outcome the gate imposes.

    Below ``min_coverage`` the run is neither pass nor fail but lacks data; no captures at all means no
    input.
    """
    counts = joined.agg(F.count(F.lit(1)).alias("captured"), F.count("label_ts").alias("matched"))
    share = F.coalesce(F.try_divide(F.col("matched").cast("double"), F.col("captured")), F.lit(0.0))
    outcome = (
        F.when(F.col("captured") == 0, "skipped_no_input")
        .when(share < F.lit(min_coverage), "skipped_insufficient_data")
        .otherwise("succeeded")
    )
    return counts.select("captured", "matched", share.alias("coverage"), outcome.alias("outcome")).withColumn(
        "severity", default_severity(F.col("outcome"))
    )
