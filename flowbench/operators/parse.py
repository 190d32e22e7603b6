"""Parse stage: canonical column names, as one metadata-only projection."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import LABEL, RAW_LABEL
from ..functions.names import canonical_name, canonical_names, resolve_collisions


def rename_columns(df: DataFrame, on_collision: str = "error") -> DataFrame:
    """Give every column its canonical name; no projection if nothing changes."""
    names = resolve_collisions(canonical_names(df.columns), df.columns, on_collision)
    return df if names == df.columns else df.toDF(*names)


def rename_raw_label(df: DataFrame, raw_label: str = RAW_LABEL) -> DataFrame:
    """The column that normalises to the same name as ``raw_label`` becomes ``label``."""
    wanted = canonical_name(raw_label)
    names = [LABEL if canonical_name(name) == wanted else name for name in df.columns]
    return df if names == df.columns else df.toDF(*resolve_collisions(names, df.columns, "error"))


def parse(df: DataFrame, on_collision: str = "error") -> DataFrame:
    """The parse stage."""
    return rename_columns(df, on_collision)
