"""Reading monitoring inputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_inputs(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """Named Parquet inputs. Lazy: each analysis reads only the columns its spec names."""
    return {name: spark.read.parquet(path) for name, path in paths.items()}


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str, nested: bool = False) -> DataFrame:
    """A Parquet table, empty while nothing has been written to its folder. Nested: its files lie in folders of any names."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", nested).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema).limit(0)  # known to be empty when a plan is made


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON-lines snapshot. The schema is given, so no inference pass reads the data twice."""
    return spark.read.schema(schema).json(path)


def read_raw_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, keep: Sequence[str], label: str
) -> DataFrame:
    """Headerless CSV: blanks before a value trimmed, ``?`` is null, incomplete rows dropped.

    Rows are dropped for a null in any column, kept or not; trailing dots of the label go.
    """
    raw = spark.read.schema(schema).csv(
        path, header=False, nullValue="?", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=False
    )
    # a null-safe filter instead of the reader's column pruning: every column decides about the row
    complete = raw.dropna("any")
    return complete.select(*keep).withColumn(label, F.rtrim(F.col(label), F.lit(".")))
