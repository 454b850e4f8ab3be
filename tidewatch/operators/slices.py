"""Running totals and ranks over one ordered column without putting the column on one task.

A rank statistic (KS, AUC) needs cumulative counts in value order. ``Window.partitionBy(column)`` would
move a whole column to one task, so the value histogram is range-partitioned first, each range is
accumulated on its own, and only one summary row per range goes through the final ordered window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import written

SLICE = "__slice"


def sliced(histogram: DataFrame, *ordering: str, slices: int | None = None) -> DataFrame:
    """Range-partition a pre-aggregated histogram, tag each row with its range, one range per task.

    The histogram holds each value once, so a hot value is one row. The range bounds are drawn once,
    when the exchange runs, and adaptive execution merges small ranges. The tag is also the partition
    the row is sent to next, which windows and aggregates by tag then find in place; hashing the tags
    instead would leave some tasks with several ranges and others with none.
    """
    partitions = slices or int(histogram.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = histogram.repartitionByRange(slices, *ordering) if slices else histogram.repartitionByRange(*ordering)
    return ranges.withColumn(SLICE, F.spark_partition_id()).repartitionById(partitions, F.col(SLICE))


def ranked(df: DataFrame, *ordering: str, slices: int | None = None) -> DataFrame:
    """Adds ``position``, the 1-based rank of each row by ``ordering``, columns of any sortable types.

    Rows are numbered within their range and shifted by the sizes of the earlier ranges. The numbered rows are written
    once and both read from there: a second range exchange could draw other bounds.
    """
    local = F.row_number().over(Window.partitionBy(SLICE).orderBy(*ordering))
    rows = written(sliced(df, *ordering, slices=slices).withColumn("__local", local), "ranked")
    # one row per range
    before = Window.partitionBy(F.lit(1)).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(SLICE).agg(F.count(F.lit(1)).alias("size"))
    offsets = sizes.select(SLICE, F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    shifted = rows.join(F.broadcast(offsets), SLICE).withColumn("position", F.col("__local") + F.col("offset"))
    return shifted.drop(SLICE, "__local", "offset")


def cumulated(histogram: DataFrame, keys: list[str], value: str, count: str) -> DataFrame:
    """``(*keys, value, count, upto)``: counts of a histogram added up in value order within ``keys``."""
    upto = Window.partitionBy(SLICE, *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = written(sliced(histogram, *keys, value).withColumn("__upto", F.sum(count).over(upto)), "cumulated")
    # one row per range and key in it
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(SLICE, *keys).agg(F.sum(count).alias("__sum"))
    offsets = sums.select(SLICE, *keys, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    joined = rows.join(offsets, [SLICE, *keys])
    return joined.select(*keys, value, count, (F.col("__upto") + F.col("__offset")).alias("upto"))
