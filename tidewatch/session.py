"""Session settings the jobs are written for."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution picks partition counts, join strategies and skew splits from measured sizes.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Streams keep days of captures and a row per distinct value: their state must not live on the heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A batch then uploads its changes, not whole stores, and no write needs a read to keep a row count.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g", folder: str | None = None) -> SparkSession:
    """A session for tests and benches; on a cluster the submitter supplies master, sizes and the shared folder."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidewatch")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in {**DEFAULTS, **({"spark.checkpoint.dir": folder} if folder else {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    importable(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the checkpoint folder of the session, else one beside its tables."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return configured.rstrip("/") if configured else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tidewatch-scratch"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, whoever reads them."""
    folder = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package in sessions that were started without it on their path."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
