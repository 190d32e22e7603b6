"""Binary target from the class label; it always stays in the row it belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ATTACK_TARGET, BENIGN, BENIGN_TARGET, LABEL


# Every whitespace character, the four separators that Unicode does not call so included.
SPACE = r"[\s\x1C-\x1F]"


def require_column(df: DataFrame, name: str) -> None:
    if name not in df.columns:
        raise ValueError(f"The frame has no column {name!r}")


def binary_target_expr(label: Column) -> Column:
    """0 for the benign class, 1 for all else, a missing label included.

    Any whitespace around the class name is ignored, not just the spaces that ``trim`` removes.
    """
    text = label.cast("string")
    # The plain comparison spares most rows the pattern.
    benign = (text == BENIGN) | text.rlike(rf"(?U)^{SPACE}*{BENIGN}{SPACE}*$")
    return F.when(benign, BENIGN_TARGET).otherwise(ATTACK_TARGET)


def with_binary_target(df: DataFrame, column: str = "target") -> DataFrame:
    """Add the binary target as ``column`` (which may be ``label`` itself)."""
    require_column(df, LABEL)
    return df.withColumn(column, binary_target_expr(F.col(LABEL)))


def target_from_label(df: DataFrame, column: str = "target") -> DataFrame:
    """Read an already numeric label as the target; text that is no number is an error (ANSI)."""
    require_column(df, LABEL)
    return df.withColumn(column, F.col(LABEL).cast("int"))


def drop_label(df: DataFrame) -> DataFrame:
    require_column(df, LABEL)
    return df.drop(LABEL)
