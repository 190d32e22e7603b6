"""Classify columns by Spark type (numeric, floating, categorical)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, DoubleType, FloatType, NumericType


def is_numeric(data_type: DataType) -> bool:
    return isinstance(data_type, NumericType)


def is_floating(data_type: DataType) -> bool:
    """The two types that can hold NaN and infinities."""
    return isinstance(data_type, (FloatType, DoubleType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [field.name for field in df.schema if is_numeric(field.dataType)]


def floating_columns(df: DataFrame) -> list[str]:
    return [field.name for field in df.schema if is_floating(field.dataType)]


def numeric_and_categorical(
    df: DataFrame, columns: Iterable[str]
) -> tuple[list[str], list[str]]:
    """Split ``columns`` by type; booleans, strings and everything else are categorical."""
    columns, known = list(columns), set(numeric_columns(df))
    return [name for name in columns if name in known], [name for name in columns if name not in known]
