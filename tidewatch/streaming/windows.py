"""Event-time windows over captures and outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.functions.divergence import psi_term
from tidewatch.functions.severity import resolved_severity
from tidewatch.functions.values import as_category, as_number, quoted, ratio, tally
from tidewatch.operators.slices import SLICE, cumulated, sliced
from tidewatch.streaming.sinks import start


def hourly_tick(outcomes: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Runs, violations and alerts per analyser and tumbling window; a window closes after ``delay``."""
    severity = resolved_severity(F.col("outcome"), F.col("severity"))
    windowed = outcomes.withWatermark("started_at", delay).groupBy(F.window("started_at", width), "analyser_type")
    counts = windowed.agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("violation_count").alias("violations"),
        tally(severity == "alert").alias("alerts"),
    )
    return counts.select(F.col("window.start").alias("window_start"), "analyser_type", "runs", "violations", "alerts")


def live_histogram(
    captures: DataFrame, columns: Sequence[str], width: str = "1 hour", delay: str = "10 minutes"
) -> DataFrame:
    """Category counts per closed window: the state holds categories, not rows."""
    picked = captures.select("ts", *[as_category(captures, c).alias(c) for c in columns]).withWatermark("ts", delay)
    melted = picked.unpivot(["ts"], [quoted(c) for c in columns], "column", "category")
    counts = melted.groupBy(F.window("ts", width), "column", "category").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), "column", "category", "n")


def window_stability(live: DataFrame, baseline: DataFrame) -> DataFrame:
    """PSI per window and column against a stored histogram ``(column, category, count)``.

    A batch operator for the callback below and for replays. A window in which nothing occurs has, from the baseline's
    categories, a sum of its own per column; every category a window does see replaces its term in that sum. So the baseline
    is read once, whatever the number of windows, and rows are as many as the windows' own categories.
    """
    size = baseline.groupBy("column").agg(F.greatest(F.sum("count"), F.lit(1)).alias("total"))
    nothing = F.lit(0.0)
    shares = baseline.join(size, "column").select("column", "category", (F.col("count") / F.col("total")).alias("q"))
    unseen = shares.groupBy("column").agg(F.sum(psi_term(nothing, F.col("q"))).alias("unseen"))
    totals = live.groupBy("window_start", "column").agg(F.greatest(F.sum("n"), F.lit(1)).alias("total"))
    observed = live.join(totals, ["window_start", "column"]).select("window_start", "column", "category", (F.col("n") / F.col("total")).alias("p"))
    known = shares.select(F.col("column").alias("__column"), F.col("category").alias("__category"), "q")
    same = (F.col("column") == F.col("__column")) & F.col("category").eqNullSafe(F.col("__category"))
    q = F.coalesce("q", nothing)
    replaced = F.when(F.col("q").isNotNull(), psi_term(nothing, q)).otherwise(nothing)
    gained = observed.join(known, same, "left").groupBy("window_start", "column").agg(F.sum(psi_term(F.col("p"), q) - replaced).alias("gained"))
    return gained.join(unseen, "column").select("window_start", "column", (F.col("unseen") + F.col("gained")).alias("psi"))


def monitor_windows(
    captures: DataFrame,
    baseline: DataFrame,
    columns: Sequence[str],
    path: str,
    checkpoint: str,
    width: str = "1 hour",
    delay: str = "10 minutes",
    once: bool = True,
) -> StreamingQuery:
    """PSI of every closed window against a static baseline histogram, appended to a table.

    Append mode hands a window's counts to the callback in one batch, so each window is scored once; the
    batch writes its own folder, which a retry overwrites.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        window_stability(batch, baseline).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    stream = live_histogram(captures, columns, width, delay)
    return start(stream.writeStream.outputMode("append").foreachBatch(process), checkpoint, once)


def window_completeness(
    captures: DataFrame, columns: Sequence[str], width: str = "1 hour", delay: str = "10 minutes"
) -> DataFrame:
    """Share of present values per closed window and column."""
    picked = captures.select("ts", *[as_category(captures, c).alias(c) for c in columns]).withWatermark("ts", delay)
    windowed = picked.groupBy(F.window("ts", width))
    counts = windowed.agg(F.count(F.lit(1)).alias("rows"), *[F.count(quoted(c)).alias(f"present_{i}") for i, c in enumerate(columns)])
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column"), ratio(F.col(f"present_{i}"), F.col("rows"), 0.0).alias("completeness"))
            for i, c in enumerate(columns)
        ]
    )
    return counts.select(F.col("window.start").alias("window_start"), F.inline(entries))


def live_numbers(
    captures: DataFrame, columns: Sequence[str], width: str = "1 hour", delay: str = "10 minutes"
) -> DataFrame:
    """Value counts per closed window and numeric column, the input of a per-window KS."""
    picked = captures.select("ts", *[as_number(captures, c).alias(c) for c in columns]).withWatermark("ts", delay)
    melted = picked.unpivot(["ts"], [quoted(c) for c in columns], "column", "number").where("number IS NOT NULL")
    counts = melted.groupBy(F.window("ts", width), "column", "number").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), "column", "number", "n")


def window_ks(live: DataFrame, baseline: DataFrame) -> DataFrame:
    """KS statistic per closed window and column: ``(window_start, column, ks_stat, n, m)``.

    ``live`` holds ``(window_start, column, number, n)``, ``baseline`` ``(column, number, m)``. Between two values of a
    window its distribution stands still, so the gap is widest at a value or just before one: what is needed of the
    baseline is its count up to and below every live value. Live values and baseline are merged once and added up in
    order; each window then looks its values up. No baseline row is repeated for a window.
    """
    zero = F.lit(0).cast("bigint")
    both = baseline.select("column", "number", "m").unionByName(live.select("column", "number", zero.alias("m")))
    merged = both.groupBy("column", "number").agg(F.sum("m").alias("m"))
    ranks = cumulated(merged, ["column"], "number", "m").select("column", "number", "upto", (F.col("upto") - F.col("m")).alias("below"))
    size = baseline.groupBy("column").agg(F.sum("m").alias("m")).where("m > 0")
    totals = live.groupBy("window_start", "column").agg(F.sum("n").alias("total")).where("total > 0")
    keys = ["window_start", "column"]
    placed = live.join(ranks, ["column", "number"]).select(*keys, "number", "n", "upto", "below").join(totals, keys).join(size, "column")
    inside = Window.partitionBy(SLICE, *keys).orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum("n").over(inside)
    here, short = own / F.col("total") - F.col("upto") / F.col("m"), (own - F.col("n")) / F.col("total") - F.col("below") / F.col("m")
    per_slice = (
        sliced(placed, *keys, "number")
        .withColumn("here", here)
        .withColumn("short", short)
        .groupBy(SLICE, *keys, "total", "m")
        .agg(
            F.min("number").alias("start"),
            F.greatest(F.max("here"), F.max("short")).alias("high"),
            F.least(F.min("here"), F.min("short")).alias("low"),
            (F.sum("n") / F.col("total")).alias("change"),
        )
    )
    before = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("change").over(before), F.lit(0.0))
    shifted = per_slice.withColumn("high", F.col("high") + offset).withColumn("low", F.col("low") + offset)
    return shifted.groupBy(*keys).agg(
        F.max(F.greatest(F.abs("high"), F.abs("low"))).alias("ks_stat"), F.first("total").alias("n"), F.first("m").alias("m")
    )


def agreement(
    serving: DataFrame, shadow: DataFrame, key: str, width: str = "1 hour", delay: str = "10 minutes", skew: str = "5 minutes"
) -> DataFrame:
    """Agreement rate per closed window of serving time.

    Both streams hold ``(key, ts, prediction)``. The time bound of ``skew`` around the serving row lets
    the join drop its state, and the window aggregate closes behind the same watermark.
    """
    left = serving.select(F.col(key).alias("left_key"), F.col("ts").alias("serving_ts"), F.col("prediction").alias("serving"))
    right = shadow.select(F.col(key).alias("right_key"), F.col("ts").alias("shadow_ts"), F.col("prediction").alias("shadow"))
    left, right = left.withWatermark("serving_ts", delay), right.withWatermark("shadow_ts", delay)
    bound = F.expr(f"INTERVAL {skew}")
    near = (F.col("shadow_ts") >= F.col("serving_ts") - bound) & (F.col("shadow_ts") <= F.col("serving_ts") + bound)
    joined = left.join(right, (F.col("left_key") == F.col("right_key")) & near)
    agreed = F.coalesce(F.col("serving") == F.col("shadow"), F.lit(False))
    counts = joined.groupBy(F.window("serving_ts", width)).agg(
        F.count(F.lit(1)).alias("pairs"), tally(agreed).alias("agreed")
    )
    return counts.select(
        F.col("window.start").alias("window_start"), "pairs", ratio(F.col("agreed"), F.col("pairs")).alias("agreement")
    )


def late_truth(captures: DataFrame, labels: DataFrame, lookback: str, delay: str = "1 hour") -> DataFrame:
    """One row per capture: its newest label within ``lookback``, or null, emitted once when its lookback has passed.

    Captures hold ``inference_id, ts`` and more, labels ``inference_id, label, label_ts``. An outer interval join keeps a
    capture until the watermark passes its lookback; behind it the rows of a capture, which are grouped by all of its
    columns, are reduced to the newest label (of equal times the larger one) and closed by the join's own output
    watermark. So both states lose a capture when it is through, and neither needs Python. Captures equal in all
    columns are one.
    """
    columns = captures.columns
    left = captures.withWatermark("ts", delay)
    right = labels.select(F.col("inference_id").alias("__label_id"), "label", "label_ts").withWatermark("label_ts", delay)
    within = (F.col("label_ts") >= F.col("ts")) & (F.col("label_ts") <= F.col("ts") + F.expr(lookback))
    joined = left.join(right, (F.col("inference_id") == F.col("__label_id")) & within, "left_outer")
    newest = F.max(F.struct("label_ts", "label")).alias("newest")
    return joined.groupBy(*columns).agg(newest).select(*columns, "newest.label", "newest.label_ts")
