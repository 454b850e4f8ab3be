"""Column helpers shared by every operator: missing values, coercion, safe division."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FRACTIONAL = (T.FloatType, T.DoubleType)
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def quoted(name: str) -> str:
    """Column reference for a raw column name (names with dots or spaces stay one identifier)."""
    return "`" + name.replace("`", "``") + "`"


def data_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, _NUMERIC)


def without_nan(df: DataFrame, name: str) -> Column:
    """The column with NaN read as null, so that both kinds of "missing" are one kind."""
    column = F.col(quoted(name))
    if isinstance(data_type(df, name), _FRACTIONAL):
        return F.when(~F.isnan(column), column)
    return column


def as_number(df: DataFrame, name: str) -> Column:
    """Double value of a column; text that is no number becomes null instead of failing the job."""
    column = F.col(quoted(name))
    dtype = data_type(df, name)
    if isinstance(dtype, T.DoubleType):
        number = column
    elif is_numeric(dtype) or isinstance(dtype, T.BooleanType):
        number = column.cast("double")
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        number = F.unix_micros(column.cast("timestamp")).cast("double") / 1e6
    else:
        number = column.try_cast("double")
    return F.when(~F.isnan(number), number)


def as_category(df: DataFrame, name: str) -> Column:
    """Text key of a category; null (and NaN) stays null and is a category of its own."""
    return without_nan(df, name).cast("string")


def member_of(df: DataFrame, name: str, values: Sequence[object]) -> Column:
    """True when the column holds one of ``values``; null counts as not a member.

    Literals of the column's own kind are compared natively, anything else by text, so that a list
    such as ``["1"]`` against an integer column cannot raise a cast error.
    """
    column = without_nan(df, name)
    dtype = data_type(df, name)
    flags = [isinstance(v, bool) for v in values]
    if isinstance(dtype, T.BooleanType) and all(flags):
        hit = column.isin(list(values))
    elif is_numeric(dtype) and all(isinstance(v, (int, float)) and not b for v, b in zip(values, flags)):
        hit = column.isin(list(values))
    else:
        hit = column.cast("string").isin([str(v).lower() if isinstance(v, bool) else str(v) for v in values])
    return F.coalesce(hit, F.lit(False))


def ratio(numerator: Column, denominator: Column, empty: float | None = None) -> Column:
    """Quotient that is null (or ``empty``) over a zero denominator."""
    quotient = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return quotient if empty is None else F.coalesce(quotient, F.lit(float(empty)))


def tally(condition: Column, weight: Column | None = None) -> Column:
    """Weighted count of the rows that meet ``condition``; 0 over no rows."""
    amount = F.lit(1).cast("bigint") if weight is None else weight
    return F.coalesce(F.sum(F.when(condition, amount).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"))


def same_kind(df: DataFrame, left: str, right: str) -> tuple[Column, Column]:
    """Two columns brought to one comparable type: numbers stay numbers, the rest becomes text."""
    a, b = without_nan(df, left), without_nan(df, right)
    left_type, right_type = data_type(df, left), data_type(df, right)
    if left_type == right_type:
        return a, b
    if is_numeric(left_type) and is_numeric(right_type):
        return a.cast("double"), b.cast("double")
    return a.cast("string"), b.cast("string")
