"""Clean stage: missing labels, non-finite numbers, incomplete rows.

Each step is also available as a plain expression, so that several variants can be measured in one
scan (see ``plans.variants.variant_shapes``).
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..config import LABEL
from ..functions.names import col
from .schema import floating_columns, is_floating, is_numeric


def is_present(name: str, data_type: DataType) -> Column:
    """Not NULL, and for floats neither NaN nor infinite.

    Spark orders NaN above infinity, so one comparison rejects both, and a comparison with NULL is not
    true. The column's expression appears once however long it is.
    """
    column = col(name)
    return F.abs(column) < float("inf") if is_floating(data_type) else column.isNotNull()


def finite(name: str, data_type: DataType) -> Column:
    """The value, or NULL where a float is NaN or infinite."""
    column = col(name)
    return F.when(is_present(name, data_type), column) if is_floating(data_type) else column


def drop_null_labels(df: DataFrame) -> DataFrame:
    return df.filter(F.col(LABEL).isNotNull()) if LABEL in df.columns else df


def nonfinite_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """NaN and infinities of the float columns become NULL, in one projection; rows stay."""
    chosen = set(df.columns if columns is None else columns)
    repaired = {
        name: finite(name, df.schema[name].dataType)
        for name in floating_columns(df)
        if name in chosen
    }
    return df.withColumns(repaired) if repaired else df


def sanitize_numeric(df: DataFrame, feature_columns: Iterable[str]) -> DataFrame:
    """Make non-finite feature values NULL so that imputation can fill them; rows stay."""
    return nonfinite_to_null(df, feature_columns)


def drop_incomplete_rows(df: DataFrame) -> DataFrame:
    """Drop rows with a NULL or NaN in any numeric column (an integer label counts)."""
    complete = [
        col(f.name).isNotNull() & ~F.isnan(col(f.name)) if is_floating(f.dataType)
        else col(f.name).isNotNull()
        for f in df.schema
        if is_numeric(f.dataType)
    ]
    return df.filter(reduce(Column.__and__, complete)) if complete else df


def survives_clean(df: DataFrame) -> Column:
    """True for exactly the rows that ``clean`` keeps."""
    conditions = [is_present(f.name, f.dataType) for f in df.schema if is_numeric(f.dataType)]
    if LABEL in df.columns:
        conditions.append(F.col(LABEL).isNotNull())
    return reduce(Column.__and__, conditions, F.lit(True))


def clean(df: DataFrame) -> DataFrame:
    """The clean stage: NULL labels out, non-finite to NULL, incomplete rows out.

    Equal to the three steps above in turn, as one filter: a row with a value that would become NULL
    leaves anyway, and the values of the rows that stay do not change.
    """
    return df.filter(survives_clean(df))
