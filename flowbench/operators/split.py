"""Train / validation / test by the capture day named in the source file."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BENIGN_TARGET, SOURCE_FILE, SPLIT_DAYS, WEEKDAYS
from ..sources.tables import write_table
from .labels import require_column, with_binary_target


def _by_day(source_file: Column, outcome: dict[str, str]) -> Column:
    """Outcome of the first of Monday..Friday contained in the file name, in any case; else NULL."""
    lowered = F.lower(source_file.cast("string"))
    return F.coalesce(
        *[F.when(lowered.contains(day.lower()), F.lit(outcome[day])) for day in WEEKDAYS]
    )


def weekday_expr(source_file: Column) -> Column:
    return _by_day(source_file, {day: day for day in WEEKDAYS})


def split_expr(source_file: Column) -> Column:
    """The part a file belongs to, straight from its name: a filter on it stays one short test."""
    return _by_day(source_file, {day: part for part, days in SPLIT_DAYS.items() for day in days})


def with_weekday(df: DataFrame) -> DataFrame:
    require_column(df, SOURCE_FILE)
    return df.withColumn("weekday", weekday_expr(F.col(SOURCE_FILE)))


def weekday_files(df: DataFrame) -> DataFrame:
    """One row per (weekday, source_file) with its row count; files without a weekday are left out."""
    return (
        with_weekday(df)
        .filter(F.col("weekday").isNotNull())
        .groupBy("weekday", SOURCE_FILE)
        .agg(F.count("*").alias("rows"))
    )


def check_weekdays(df: DataFrame) -> None:
    """Raise unless every one of the five days has a source file (one small aggregate)."""
    require_column(df, SOURCE_FILE)
    day = weekday_expr(F.col(SOURCE_FILE))
    found = df.agg(*[F.bool_or(day == name).alias(name) for name in WEEKDAYS]).first()
    missing = [name for name in WEEKDAYS if not found[name]]
    if missing:
        raise ValueError(
            f"No source file for: {', '.join(missing)}"
        )


def source_files_of(df: DataFrame, weekdays: Iterable[str]) -> DataFrame:
    """The distinct source files of the given days, as a frame."""
    return weekday_files(df).filter(F.col("weekday").isin(list(weekdays))).select(SOURCE_FILE)


def subset_by_source_files(df: DataFrame, source_files: Iterable[str]) -> DataFrame:
    """Rows of the listed files; the list becomes a hashed set in the filter, never a shuffle."""
    require_column(df, SOURCE_FILE)
    return df.filter(F.col(SOURCE_FILE).cast("string").isin(list(source_files)))


def subset_of_files(df: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of the files that a frame lists; any number of files, none of which reaches the driver."""
    return df.join(files.select(SOURCE_FILE).distinct(), SOURCE_FILE, "left_semi").select(*df.columns)


def with_split(df: DataFrame) -> DataFrame:
    """Add ``weekday`` and ``split``; rows of files without a weekday keep a NULL split.

    A frame that carries both already, such as one of ``store_split``, passes unchanged.
    """
    if {"weekday", "split"} <= set(df.columns):
        return df
    return with_weekday(df).withColumn("split", split_expr(F.col(SOURCE_FILE)))


def store_split(df: DataFrame) -> DataFrame:
    """Write the rows that are in a split, partitioned by it, and read them back.

    Each later pass over one part then reads that part's files only.
    """
    return write_table(with_split(df).filter(F.col("split").isNotNull()), "flows", ("split",))


def split_rows(df: DataFrame, check: bool = True) -> DataFrame:
    """The split entry point: binary target, weekday, split; rows in no split are left out."""
    if check:
        check_weekdays(df)
    return with_split(with_binary_target(df)).filter(F.col("split").isNotNull())


def part(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("split") == name)


def benign_part(df: DataFrame, name: str) -> DataFrame:
    """Benign rows of one part; evaluated on the frame as it is, so after any preprocessing."""
    return part(df, name).filter(F.col("target") == BENIGN_TARGET)
