"""Normalize stage: trim and upper-case a textual label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import LABEL


def normalize_string(column: Column, uppercase: bool = False) -> Column:
    trimmed = F.trim(column)
    return F.upper(trimmed) if uppercase else trimmed


def normalize(df: DataFrame) -> DataFrame:
    """Upper-case and trim ``label`` if it is text; any other frame passes unchanged."""
    if LABEL in df.columns and isinstance(df.schema[LABEL].dataType, StringType):
        return df.withColumn(LABEL, normalize_string(F.col(LABEL), uppercase=True))
    return df
