"""Outcome-stream consumers: notify once per alerting run, archive every event."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.sources.readers import read_or_empty
from tidewatch.streaming.sinks import start

KEY = ["run_id", "analyser_type"]


def alerts_of(outcomes: DataFrame) -> DataFrame:
    """Alert rows that can be identified; the severity filter reaches the source scan."""
    keyed = [F.col(k).isNotNull() & (F.col(k).cast("string") != "") for k in KEY]
    return outcomes.where((F.col("severity") == "alert") & keyed[0] & keyed[1])


def unseen(alerts: DataFrame, ledger: DataFrame) -> DataFrame:
    """First alert per run and analyser that the ledger does not hold, whenever the run started."""
    return alerts.dropDuplicates(KEY).join(ledger.select("bucket", *KEY), ["bucket", *KEY], "left_anti")


def notify_once(
    outcomes: DataFrame,
    ledger: str,
    checkpoint: str,
    notify: Callable[[DataFrame, int], None],
    once: bool = True,
    buckets: int = 64,
) -> StreamingQuery:
    """Call ``notify(new_alerts, batch_id)`` with alerts never announced before.

    New alerts are written to the ledger first and handed to ``notify`` from there. A crash between both
    loses a notification rather than repeating it, a retried batch finds its own rows, and a lost executor
    cannot change what is announced. The ledger is laid out in ``buckets`` folders by a hash of run and analyser,
    and a batch reads only the buckets of its own alerts; its start time plays no part, so a rerun on another
    day, or one without a start, is the same run. ``buckets`` must not change while a ledger is in use.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = uuid.uuid4().hex
        bucket = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in KEY]), F.lit(buckets)).cast("int")
        found = alerts_of(batch).withColumn("bucket", bucket)
        touched = [row["bucket"] for row in found.select("bucket").distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        schema = found.withColumn("mark", F.lit(mark)).schema
        near = F.col("bucket").isin(touched)
        seen = read_or_empty(spark, ledger, schema).where(near).select("bucket", *KEY)
        fresh = unseen(found, seen).withColumn("mark", F.lit(mark))
        # One file per bucket and batch, however many tasks the batch had.
        fresh.repartition(len(touched), "bucket").write.mode("append").partitionBy("bucket").parquet(ledger)
        written = spark.read.schema(schema).parquet(ledger).where(near & (F.col("mark") == mark))
        notify(written.drop("bucket", "mark"), batch_id)

    return start(outcomes.writeStream.foreachBatch(process), checkpoint, once)


def archive(events: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write every event as JSON under ``dt=YYYY-MM-DD/hour=HH`` of the processing time in UTC.

    The file sink's commit log keeps a retried batch from writing twice; an event without an id gets one.
    """
    now = F.current_timestamp()
    identity = F.col("event_id").cast("string") if "event_id" in events.columns else F.lit(None).cast("string")
    stamped = (
        events.withColumn("event_id", F.coalesce(identity, F.uuid()))
        .withColumn("dt", F.date_format(now, "yyyy-MM-dd"))
        .withColumn("hour", F.date_format(now, "HH"))
    )
    writer = stamped.writeStream.format("json").option("path", path).partitionBy("dt", "hour").outputMode("append")
    return start(writer, checkpoint, once)
