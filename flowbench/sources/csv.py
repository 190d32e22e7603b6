"""Directories of flow CSVs: inventory, encodings, headers, types, union by name.

Three passes over the text: one inventory of all files (encoding and header line), one that finds the
type of every column, and the scan itself. Store the result as a table before using it repeatedly.
"""

from __future__ import annotations

import csv as csv_text
from collections import Counter
from functools import reduce
from urllib.parse import unquote

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..config import LABEL, RAW_LABEL, SOURCE_FILE
from ..functions.names import canonical_name, canonical_names, col, resolve_collisions
from . import quoted
from .tables import literal_path

# Cell texts that mean "missing" in a flow CSV, as the usual CSV readers take them.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Cell texts of booleans.
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")

INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITY_PATTERN = r"(?i)^\s*[+-]?inf(inity)?\s*$"

# What a column's cells were found to be, as bits that combine by OR.
INTEGER, NUMBER, BOOLEAN, TEXT = 1, 2, 4, 8

UNEXPECTED = "__beyond_header"


def _glob(directory: str, pattern: str) -> str:
    return f"{literal_path(directory.rstrip('/'))}/{pattern}"


def csv_inventory(spark: SparkSession, directory: str, pattern: str = "*.csv") -> DataFrame:
    """One row per matching file directly in ``directory``: path, source_file, is_utf8, header, broken.

    One pass over all text, in JVM code, with one small state per file; large files are read in
    parallel pieces. ``header`` is the first line that is not blank, decoded like the file. ``broken``:
    some line holds an odd number of quotes, so a quoted cell may go on in the next line.
    """
    try:
        text = spark.read.text(_glob(directory, pattern))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"{directory} holds no CSV files") from error
        raise
    lines = text.select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
    )
    filled = F.length(F.trim("value")) > 0
    position = F.when(filled, F.struct("start", "line"))
    files = lines.groupBy("path").agg(
        F.collect_set(F.is_valid_utf8("value")).alias("validity"),  # at most two elements
        F.min_by(F.when(filled, F.col("value").cast("binary")), position).alias("first_line"),
        F.bool_or(F.regexp_count("value", F.lit('"')) % 2 == 1).alias("broken"),
    )
    is_utf8 = ~F.array_contains("validity", False)
    return files.select(
        "path",
        source_file_expr(F.col("path")).alias(SOURCE_FILE),
        is_utf8.alias("is_utf8"),
        F.when(is_utf8, F.col("first_line").cast("string"))
        .otherwise(F.decode("first_line", "ISO-8859-1"))
        .alias("header"),
        "broken",
    )


def source_file_expr(path: Column) -> Column:
    """Base name of a file path as Spark reports it (percent-encoded)."""
    return F.url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B")))


def header_names(header: str) -> list[str]:
    """Column names of a header line; repeats become ``X.1``, ``X.2``, blanks ``Unnamed: i``."""
    cells = next(csv_text.reader([header.lstrip("﻿").rstrip("\r\n")]))
    cells = [cell if cell else f"Unnamed: {i}" for i, cell in enumerate(cells)]
    taken, repeats, names = set(cells), Counter(), []
    for cell in cells:
        name = cell
        while repeats[cell] and name in taken:
            name = f"{cell}.{repeats[cell]}"
            if name in taken:
                repeats[cell] += 1
        repeats[cell] += 1
        taken.add(name)
        names.append(name)
    return names


def scan_csv(
    spark: SparkSession,
    paths: list[str],
    names: list[str],
    encoding: str = "UTF-8",
    multi_line: bool = False,
) -> DataFrame:
    """Raw text cells of files that share one header, with ``source_file``.

    ``multi_line`` allows line breaks inside quotes (``quoted.py``); large files are split in either case.
    """
    # Names are given afterwards: the reader takes names that differ only by case as equal.
    places = [f"_{i}" for i in range(len(names))]
    schema = StructType([StructField(p, StringType()) for p in [*places, UNEXPECTED]])
    if multi_line:
        found = quoted.records(spark, paths)
        options = {"escape": '"', "multiLine": "true"}
        cells = F.from_csv(F.decode("text", encoding), schema.toDDL(), options).alias("cells")
        frame = found.select(cells, source_file_expr(F.col("path")).alias(SOURCE_FILE))
        frame = frame.select(*[f"cells.{p}" for p in places], SOURCE_FILE, f"cells.{UNEXPECTED}")
        return frame.toDF(*names, SOURCE_FILE, UNEXPECTED)
    frame = (
        spark.read.schema(schema)
        .option("header", True)
        .option("encoding", encoding)
        .option("escape", '"')
        .csv(paths)
        .select(
            *places,
            source_file_expr(F.col("_metadata.file_path")).alias(SOURCE_FILE),
            UNEXPECTED,
        )
    )
    return frame.toDF(*names, SOURCE_FILE, UNEXPECTED)


def _present(cell: Column) -> Column:
    """The cell, or NULL where its text means "missing"."""
    return F.when(~cell.isin(*MISSING_TOKENS), cell)


def _cell_kind(cell: Column) -> Column:
    value = _present(cell)
    return (
        F.when(value.isNull(), 0)
        .when(value.isin(*TRUE_TOKENS, *FALSE_TOKENS), BOOLEAN)
        .when(value.rlike(INTEGER_PATTERN) & F.trim(value).try_cast("bigint").isNotNull(), INTEGER)
        .when(value.rlike(NUMBER_PATTERN) | value.rlike(INFINITY_PATTERN), NUMBER)
        .otherwise(TEXT)
    )


def _column_type(kinds: int) -> str:
    if kinds in (0, NUMBER, NUMBER | INTEGER):
        return "double"
    return {INTEGER: "bigint", BOOLEAN: "boolean"}.get(kinds, "string")


def infer_types(df: DataFrame) -> dict[str, str]:
    """Type of every text column: one aggregate, one small integer per column.

    All cells integers: bigint; all numbers: double (also a column without any value); all booleans:
    boolean; else string. Raises if a data line has more cells than its header.
    """
    columns = [c for c in df.columns if c not in (SOURCE_FILE, UNEXPECTED)]
    kinds = [F.bit_or(_cell_kind(col(name))).alias(f"k{i}") for i, name in enumerate(columns)]
    if UNEXPECTED in df.columns:
        kinds.append(F.min(F.when(col(UNEXPECTED).isNotNull(), F.col(SOURCE_FILE))).alias("longer"))
    row = df.agg(*kinds).first()
    if UNEXPECTED in df.columns and row["longer"] is not None:
        raise ValueError(f"{row['longer']}: a line has more cells than the header")
    return {name: _column_type(row[f"k{i}"] or 0) for i, name in enumerate(columns)}


def _typed(name: str, data_type: str) -> Column:
    value = _present(col(name))
    if data_type == "string":
        return value
    if data_type == "boolean":
        return value.isin(*TRUE_TOKENS)
    return F.trim(value).cast(data_type)


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Typed columns, missing tokens as NULL; columns not in ``types`` pass unchanged.

    Reading a line with more cells than its header raises: no cell is dropped silently.
    """
    if UNEXPECTED in df.columns:
        message = F.concat(F.col(SOURCE_FILE), F.lit(": a line has more cells than the header"))
        fits = F.when(col(UNEXPECTED).isNull(), True).otherwise(F.raise_error(message).cast("boolean"))
        df = df.filter(fits)
    return df.select(
        *[
            (_typed(name, types[name]) if name in types else col(name)).alias(name)
            for name in df.columns
            if name != UNEXPECTED
        ]
    )


def _flow_names(names: list[str], on_collision: str) -> list[str]:
    """Canonical names; the raw label column becomes ``label``."""
    wanted = canonical_name(RAW_LABEL)
    canonical = [LABEL if name == wanted else name for name in canonical_names(names)]
    return resolve_collisions(canonical, names, on_collision)


def load_text(
    spark: SparkSession,
    directory: str,
    multi_line: bool | None = None,
    on_collision: str = "error",
    pattern: str = "*.csv",
) -> DataFrame:
    """All files of a directory as one frame of text cells with canonical names.

    Files that share header and encoding are one scan; the scans are united by column name. Files with
    an unclosed quote on some line are read with line breaks inside quotes; both kinds are read in parallel
    ranges. ``multi_line`` decides for all files instead.
    """
    files = csv_inventory(spark, directory, pattern).filter("header is not null")
    files = files.persist(StorageLevel.MEMORY_AND_DISK)
    if multi_line is not None:
        files = files.withColumn("broken", F.lit(multi_line))
    kinds = ["header", "is_utf8", "broken"]
    groups = files.groupBy(*kinds).agg(F.min(SOURCE_FILE).alias("first_file"))
    groups = groups.orderBy("first_file").collect()
    frames = []
    for group in groups:
        # One kind of file only: the glob says it all. Else the reader needs the group's file names.
        paths = [_glob(directory, pattern)]
        if len(groups) > 1:
            members = files
            for kind in kinds:
                members = members.filter(F.col(kind) == group[kind])
            paths = sorted(literal_path(unquote(row["path"])) for row in members.select("path").collect())
        names = _flow_names(header_names(group["header"]), on_collision)
        encoding = "UTF-8" if group["is_utf8"] else "ISO-8859-1"
        frames.append(scan_csv(spark, paths, names, encoding, group["broken"]))
    files.unpersist()
    if not frames:
        raise FileNotFoundError(f"{directory} holds no CSV files")
    return union_by_name(frames)


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; a column that a frame lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def load_raw_data(
    spark: SparkSession,
    directory: str,
    types: dict[str, str] | None = None,
    multi_line: bool | None = None,
    on_collision: str = "error",
    pattern: str = "*.csv",
) -> DataFrame:
    """The typed flow table of a directory. Known ``types`` save the inference pass."""
    text = load_text(spark, directory, multi_line, on_collision, pattern)
    return apply_types(text, infer_types(text) if types is None else types)


def load_csv_file(spark: SparkSession, path: str, **options) -> DataFrame:
    """The typed flow table of one file."""
    directory, _, name = path.rpartition("/")
    return load_raw_data(spark, directory or ".", pattern=literal_path(name), **options)
