"""The hourly tick on stored outcomes: each hour of arrivals is aggregated once and added up on reading.

The source is an archive by arrival, ``dt`` and ``hour`` its partitions. A tick aggregates the hours that have arrived since
the high-water mark, by event hour and analyser, and writes them under their own arrival hour, overwriting it; then it
moves the mark. So it reads new hours only, a tick that died is repeated without counting twice, events that arrive late
add to the event hour they belong to, and an arrival hour that was amended is recomputed alone. Days and lookbacks are
sums over these few rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.severity import resolved_severity
from tidewatch.functions.values import tally
from tidewatch.operators.truth import interval
from tidewatch.sources.readers import read_or_empty

PARTIAL_SCHEMA = (
    "event_hour timestamp, analyser_type string, runs bigint, violations bigint, alerts bigint, seconds double, dt string, hour int"
)
MARK_SCHEMA = "until timestamp"
ADDED = ("runs", "violations", "alerts", "seconds")


def _from(moment: datetime) -> Column:
    """Partitions from an hour on, in terms of the partition columns alone, so that scans are pruned."""
    day, dt, hour = moment.strftime("%Y-%m-%d"), F.col("dt").cast("string"), F.col("hour").cast("int")
    return (dt > day) | ((dt == day) & (hour >= moment.hour))


class HourlyTicks:
    """Partial aggregates and the high-water mark of one source, in a folder."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def mark(self, spark: SparkSession) -> datetime | None:
        """The hour up to which all arrivals are counted."""
        return read_or_empty(spark, f"{self.path}/marks", MARK_SCHEMA).agg(F.max("until")).first()[0]

    def due(self, source: DataFrame, until: datetime) -> DataFrame:
        """Rows of the arrival hours from the mark up to, not with, ``until``."""
        mark = self.mark(source.sparkSession)
        rows = source.where(~_from(until))
        return rows if mark is None else rows.where(_from(mark))

    def tick(self, source: DataFrame, until: datetime) -> None:
        """Count all arrival hours that are complete at ``until``, a full hour, and move the mark there."""
        if until != until.replace(minute=0, second=0, microsecond=0):
            raise ValueError("a tick ends at a full hour")
        spark, mark = source.sparkSession, self.mark(source.sparkSession)
        if mark is not None and until <= mark:
            return
        self._write(self.due(source, until))
        spark.createDataFrame([(until,)], MARK_SCHEMA).write.mode("append").parquet(f"{self.path}/marks")

    def recompute(self, source: DataFrame, hours: Iterable[datetime]) -> None:
        """Count amended arrival hours anew; no other hour is read or written."""
        chosen = F.lit(False)
        for h in hours:
            chosen = chosen | (_from(h) & ~_from(h + timedelta(hours=1)))
        self._write(source.where(chosen))

    def _write(self, rows: DataFrame) -> None:
        severity = resolved_severity(F.col("outcome"), F.col("severity"))
        keys = [F.date_trunc("hour", "started_at").alias("event_hour"), "analyser_type", F.col("dt").cast("string").alias("dt"), F.col("hour").cast("int").alias("hour")]
        partials = rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("runs"),
            F.sum("violation_count").alias("violations"),
            tally(severity == "alert").alias("alerts"),
            F.sum("duration_seconds").alias("seconds"),
        )
        writer = partials.repartition("dt", "hour").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("dt", "hour").parquet(f"{self.path}/partials")

    def _added(self, partials: DataFrame, *keys) -> DataFrame:
        return partials.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ADDED])

    def partials(self, spark: SparkSession) -> DataFrame:
        return read_or_empty(spark, f"{self.path}/partials", PARTIAL_SCHEMA)

    def rollup(self, spark: SparkSession, unit: str = "hour") -> DataFrame:
        """Sums per event hour, day or any other unit of ``date_trunc``, and analyser: ``period`` and the counts."""
        return self._added(self.partials(spark), F.date_trunc(unit, "event_hour").alias("period"), "analyser_type")

    def lookback(self, spark: SparkSession, until: datetime, span: str = "7d") -> DataFrame:
        """Sums per analyser over the event hours of the span before ``until``."""
        end = F.lit(until)
        inside = (F.col("event_hour") >= end - F.expr(interval(span))) & (F.col("event_hour") < end)
        return self._added(self.partials(spark).where(inside), "analyser_type")
