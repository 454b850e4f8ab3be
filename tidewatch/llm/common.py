"""Pieces shared by the text operators: tables, cut lineage, Arrow helpers."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import shared_folder

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the one all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage ends there and lost executors cost nothing."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def drop(df: DataFrame | None) -> None:
    """Delete a table that :func:`cut` has written, once its last reader has been written itself."""
    files = df.inputFiles() if df is not None else []
    folders = {f.rsplit("/", 1)[0] for f in files}
    for folder in folders:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column."""
    return docs.agg(F.sum(F.octet_length(F.col(column).cast("string")))).first()[0] or 0


def slices(total: int, each: int, spark: SparkSession) -> int:
    """Partitions of about ``each`` bytes, at least as many as the session deals a shuffle to when there is enough."""
    wanted = math.ceil(total / each)
    return max(1, wanted, min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / (1 << 20))))


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of an id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def portions(data: bytes, step: int = 1 << 22) -> Iterator[bytes]:
    """The bytes in portions of about ``step``, each ending at a space, so a very long text needs no more memory."""
    begin = 0
    while begin < len(data):
        end = data.find(b" ", begin + step)
        end = len(data) if end < 0 else end
        yield data[begin:end]
        begin = end


def hits_of(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value whether the sorted array has it, and where."""
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return (known[at] == values if len(known) else np.zeros(len(values), bool)), at


def mixed(h: np.ndarray) -> np.ndarray:
    """A final mix of 64-bit hashes: every input bit changes about half of the output."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..count-1 for each count, one after the other."""
    total = int(counts.sum())
    starts = np.repeat(np.cumsum(counts) - counts, counts)
    return np.arange(total) - starts
