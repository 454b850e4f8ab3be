"""Starting queries and writing their results as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery


def start(writer: DataStreamWriter, checkpoint: str, once: bool) -> StreamingQuery:
    """``once`` drains what is available now and stops; otherwise the query keeps running."""
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def to_table(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append closed results to a Parquet folder, exactly once by the sink's commit log."""
    return start(stream.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint, once)
