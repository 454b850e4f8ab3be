"""Streaming queries: tables read as streams, drained with what is available, results read back.

Windows close when the watermark (newest event minus delay) passes their end, so the oracles keep the
closed windows only.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import dq
from tidewatch.operators.rollup import with_duration
from tidewatch.queries.common import OUTCOMES_SQL, as_outcomes, r, scratch, table, text_time, tidy
from tidewatch.streaming import alerts, windows
from tidewatch.streaming.sinks import to_table
from tidewatch.streaming.ticks import HourlyTicks

COLUMNS = ["event_type"]
_ARRIVALS = 6 * 3600


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _drained(spark: SparkSession, result: DataFrame, name: str) -> DataFrame:
    path = scratch(spark, name)
    to_table(result, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{path}/out")


def alert_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every alerting run is announced once, although the same outcomes arrive in two streams."""
    path = scratch(spark, "alerts")

    def notify(fresh: DataFrame, batch_id: int) -> None:
        fresh.select("run_id", "analyser_type", "outcome").write.mode("append").parquet(f"{path}/sent")

    source = as_outcomes(stream(spark, sf_dir, "events"))
    failed = F.when(F.col("outcome") == "failed_unhandled", "alert").otherwise(F.col("severity"))
    rows = source.withColumn("severity", failed)
    for attempt in range(2):
        alerts.notify_once(rows, f"{path}/ledger", f"{path}/checkpoint{attempt}", notify).awaitTermination()
    return spark.read.parquet(f"{path}/sent")


def archive_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events archived; the layout has one day and hour per processing time."""
    path = scratch(spark, "archive")
    alerts.archive(stream(spark, sf_dir, "events"), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    back = spark.read.json(f"{path}/out")
    placed = F.to_timestamp(F.format_string("%s %02d", F.col("dt").cast("string"), F.col("hour").cast("int")), "yyyy-MM-dd HH")
    recent = placed >= F.current_timestamp() - F.expr("INTERVAL 1 DAY")
    return back.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("event_id").alias("ids"), F.min(recent).alias("recent")
    )


def hourly_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    tick = windows.hourly_tick(as_outcomes(stream(spark, sf_dir, "events")))
    rows = _drained(spark, tick, "hourly")
    return rows.withColumn("window_start", text_time("window_start"))


def hourly_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes that arrive four times a day, up to six hours late, counted by three ticks; a day is amended and recomputed."""
    path = scratch(spark, "ticks")
    events = table(spark, sf_dir, "events")
    rows = with_duration(as_outcomes(events))
    arrival = F.timestamp_seconds(F.ceil(F.unix_timestamp(F.col("ts").cast("timestamp")) / _ARRIVALS) * _ARRIVALS)
    arrived = events.select(F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("run_id"), arrival.alias("at"))
    placed = rows.join(arrived, "run_id").withColumn("dt", F.date_format("at", "yyyy-MM-dd")).withColumn("hour", F.hour("at"))
    placed.repartition("dt").write.partitionBy("dt", "hour").parquet(f"{path}/archive")
    archive = spark.read.parquet(f"{path}/archive")
    first, last = (m.replace(minute=0, second=0, microsecond=0) for m in archive.agg(F.min("at"), F.max("at")).first())
    counted = HourlyTicks(f"{path}/state")
    step = (last - first) // 3
    for end in (first + step, first + 2 * step, last + timedelta(hours=1)):
        counted.tick(archive, end.replace(minute=0, second=0))
    counted.recompute(archive, [first + timedelta(hours=h) for h in range(24)])
    days = counted.rollup(spark, "day").withColumn("period", F.date_format("period", "yyyy-MM-dd"))
    week = counted.lookback(spark, last, "7d").withColumn("period", F.lit("last 7 days"))
    return tidy(days.unionByName(week), "period", "analyser_type", "runs", "violations", "alerts", "seconds")


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of high-value events, with a category the live stream does not know."""
    events = table(spark, sf_dir, "events").where("value > 20")
    kind = F.when((F.col("event_type") == "view") & (F.col("value") > 60), "preview").otherwise(F.col("event_type"))
    return dq.baseline_histogram(events.withColumn("event_type", kind), COLUMNS)


def window_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "window_psi")
    query = windows.monitor_windows(
        _captures(spark, sf_dir), _baseline(spark, sf_dir), COLUMNS, f"{path}/out", f"{path}/checkpoint", width="6 hours"
    )
    query.awaitTermination()
    rows = spark.read.schema("window_start timestamp, column string, psi double").parquet(f"{path}/out")
    return tidy(rows.withColumn("window_start", text_time("window_start")), "window_start", "column", "psi")


def window_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = _captures(spark, sf_dir).withColumn("value", F.when(F.col("user_id") % 9 != 0, F.col("value")))
    rows = _drained(spark, windows.window_completeness(captures, ["value", "event_type"], "6 hours"), "completeness")
    return tidy(rows.withColumn("window_start", text_time("window_start")), "window_start", "column", "completeness")


def window_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KS of the value of each day's events against all views."""
    live = _drained(spark, windows.live_numbers(_captures(spark, sf_dir), ["value"], "1 day"), "window_ks")
    views = table(spark, sf_dir, "events").where("event_type = 'view'")
    rows = windows.window_ks(live, dq.baseline_numbers(views, ["value"]))
    rows = rows.withColumn("window_start", text_time("window_start"))
    return tidy(rows, "window_start", "column", "ks_stat", "n", "m")


def late_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders wait up to 60 days for the shipments that label them."""
    captures = stream(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("inference_id"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_orderstatus").alias("prediction"),
    )
    labels = stream(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("inference_id"),
        F.col("l_shipdate").cast("timestamp").alias("label_ts"),
        F.col("l_returnflag").alias("label"),
    )
    rows = _drained(spark, windows.late_truth(captures, labels, "INTERVAL 60 DAYS", "1 day"), "late_truth")
    return rows.select("inference_id", "prediction", text_time("ts").alias("ts"), "label", text_time("label_ts").alias("label_ts"))


def window_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scorings of every event as two streams, joined within five minutes."""
    events = _captures(spark, sf_dir)
    serving = events.select("event_id", "ts", F.when(F.col("value") > 20, 1).otherwise(0).alias("prediction"))
    candidate = _captures(spark, sf_dir).select(
        "event_id",
        (F.col("ts") + F.expr("INTERVAL 2 MINUTES")).alias("ts"),
        F.when(F.col("value") + F.col("user_id") % 5 > 22, 1).otherwise(0).alias("prediction"),
    )
    rows = _drained(spark, windows.agreement(serving, candidate, "event_id", "6 hours"), "agreement")
    return tidy(rows.withColumn("window_start", text_time("window_start")), "window_start", "pairs", "agreement")


QUERIES = {
    "alert_once": alert_once,
    "archive_partitions": archive_partitions,
    "hourly_metrics": hourly_metrics,
    "hourly_incremental": hourly_incremental,
    "window_psi": window_psi,
    "window_completeness": window_completeness,
    "window_ks": window_ks,
    "late_truth": late_truth,
    "window_agreement": window_agreement,
}


def _closed(width: str, source: str, time: str, delay: str = "INTERVAL 10 MINUTE") -> str:
    return f"w + {width} <= (SELECT max({time}) FROM {source}) - {delay}"


_SIX = "time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')"
_W = "strftime(w, '%Y-%m-%d %H:%M:%S')"
ORACLES = {
    "alert_once": f"{OUTCOMES_SQL} SELECT run_id, analyser_type, outcome FROM outcomes WHERE severity = 'alert'",
    "archive_partitions": """SELECT event_type, count(*)::BIGINT AS events, count(DISTINCT event_id)::BIGINT AS ids, true AS recent
        FROM events GROUP BY event_type""",
    "hourly_metrics": f"""{OUTCOMES_SQL}, h AS (SELECT date_trunc('hour', started_at) AS w, * FROM outcomes)
        SELECT {_W} AS window_start, analyser_type, count(*)::BIGINT AS runs, sum(violation_count)::BIGINT AS violations,
          count(*) FILTER (severity = 'alert')::BIGINT AS alerts FROM h
        WHERE {_closed('INTERVAL 1 HOUR', 'outcomes', 'started_at')} GROUP BY w, analyser_type""",
    "hourly_incremental": f"""{OUTCOMES_SQL}, h AS (SELECT date_trunc('hour', started_at) AS w, * FROM outcomes),
        top AS (SELECT make_timestamp((ceil(epoch(max(ts))::BIGINT / {_ARRIVALS}) * {_ARRIVALS} * 1000000)::BIGINT) AS t FROM events),
        p AS (SELECT strftime(w, '%Y-%m-%d') AS period, * FROM h
          UNION ALL SELECT 'last 7 days', h.* FROM h, top WHERE w >= t - INTERVAL 7 DAY AND w < t)
        SELECT period, analyser_type, count(*)::BIGINT AS runs, sum(violation_count)::BIGINT AS violations,
          count(*) FILTER (severity = 'alert')::BIGINT AS alerts, {r('sum(duration_seconds)')} AS seconds FROM p GROUP BY period, analyser_type""",
    "window_psi": f"""WITH e AS (SELECT {_SIX} AS w, event_type AS g FROM events WHERE true),
        live AS (SELECT w, g, count(*) AS n FROM e WHERE {_closed('INTERVAL 6 HOUR', 'events', 'ts')} GROUP BY w, g),
        base AS (SELECT CASE WHEN event_type = 'view' AND value > 60 THEN 'preview' ELSE event_type END AS g, count(*) AS m FROM events WHERE value > 20 GROUP BY 1),
        ws AS (SELECT w, sum(n) AS total FROM live GROUP BY w),
        grid AS (SELECT w, total, g FROM ws, (SELECT g FROM base UNION SELECT g FROM live)),
        pr AS (SELECT grid.w, greatest(coalesce(n, 0) / total::DOUBLE, 1e-6) AS p, greatest(coalesce(m, 0) / (SELECT sum(m) FROM base)::DOUBLE, 1e-6) AS q
          FROM grid LEFT JOIN live ON grid.w = live.w AND grid.g = live.g LEFT JOIN base ON grid.g = base.g
          WHERE n IS NOT NULL OR m IS NOT NULL)
        SELECT {_W} AS window_start, 'event_type' AS "column", {r('sum((p - q) * ln(p / q))')} AS psi FROM pr GROUP BY w""",
    "window_completeness": f"""WITH e AS (SELECT {_SIX} AS w, CASE WHEN user_id % 9 <> 0 THEN value END AS v, event_type AS t FROM events),
        c AS (SELECT w, count(*)::DOUBLE AS n, count(v) AS v, count(t) AS t FROM e WHERE {_closed('INTERVAL 6 HOUR', 'events', 'ts')} GROUP BY w)
        SELECT {_W} AS window_start, 'value' AS "column", {r('v / n')} AS completeness FROM c
        UNION ALL SELECT {_W}, 'event_type', {r('t / n')} FROM c""",
    "window_ks": f"""WITH e AS (SELECT date_trunc('day', ts) AS w, value AS v FROM events),
        live AS (SELECT w, v FROM e WHERE {_closed('INTERVAL 1 DAY', 'events', 'ts')}),
        base AS (SELECT value AS v FROM events WHERE event_type = 'view'),
        ws AS (SELECT w, count(*) AS n FROM live GROUP BY w),
        both_sides AS (SELECT w, v, 1 AS c, 0 AS b FROM live UNION ALL SELECT w, v, 0, 1 FROM ws, base),
        f AS (SELECT w, v, sum(c) AS c, sum(b) AS b FROM both_sides GROUP BY w, v),
        g AS (SELECT f.w, n, (SELECT count(*) FROM base) AS m, sum(c) OVER (PARTITION BY f.w ORDER BY v) / n::DOUBLE
            - sum(b) OVER (PARTITION BY f.w ORDER BY v) / (SELECT count(*) FROM base)::DOUBLE AS gap FROM f JOIN ws ON f.w = ws.w)
        SELECT {_W} AS window_start, 'value' AS "column", {r('max(abs(gap))')} AS ks_stat, any_value(n)::BIGINT AS n, any_value(m)::BIGINT AS m FROM g GROUP BY w""",
    "late_truth": """WITH wm AS (SELECT least((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) - INTERVAL 1 DAY AS w),
        j AS (SELECT o_orderkey, o_orderstatus, o_orderdate, l_shipdate, l_returnflag,
            row_number() OVER (PARTITION BY o_orderkey, o_orderstatus, o_orderdate ORDER BY l_shipdate DESC NULLS LAST, l_returnflag DESC) AS place
          FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 60 DAY)
        SELECT o_orderkey AS inference_id, o_orderstatus AS prediction, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ts,
          l_returnflag AS label, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS label_ts
        FROM j WHERE place = 1 AND o_orderdate + INTERVAL 60 DAY < (SELECT w FROM wm)""",
    "window_agreement": f"""WITH e AS (SELECT {_SIX} AS w, value > 20 AS a, value + user_id % 5 > 22 AS b FROM events)
        SELECT {_W} AS window_start, count(*)::BIGINT AS pairs, {r('avg(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS agreement
        FROM e WHERE {_closed('INTERVAL 6 HOUR', 'events', 'ts')} GROUP BY w""",
}
