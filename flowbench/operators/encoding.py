"""One-hot encoding of any width: categories coded by a distributed dictionary.

A column with millions of categories has no list of them on the driver. Its distinct values are sorted by
range instead: every partition holds a range of values, sorted; the sizes of the ranges are added up
(one row per feature and partition), and a value's code is its place in its range after all ranges before.
The codes are those of ``row_number`` over the sorted values, dense from 0, and nothing is collected.

Rows get their codes by a join. Values that are frequent in the very frame being encoded, whether fitting
met them or not, are found first by a mergeable heavy-hitter sketch and looked up in a broadcast part of the
dictionary, so the join has no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.arrays import matrix_of
from ..sources.tables import new_path, write_table

#: A value is hot in a frame if it holds more than one in so many rows; at most as many values do.
HOT_SHARE = 1000
#: Values a sketch tracks. Counts are off by less than a share of about 1 / 12,000 of the rows, so no hot value is missed.
TRACKED = 16_384

DICTIONARY = "feature string, value string, code long"
# Reserved names, so that no kept column is overwritten.
KEY, SPREAD, CODE = "__flow_key", "__flow_spread", "__flow_code"

VECTOR_ARROW = pa.struct(
    [("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))]
)


def write_dictionary(values: DataFrame) -> str:
    """Path of (feature, value, code) for distinct (feature, value); codes follow the values' order."""
    pairs = values.select("feature", "value")
    ordered = pairs.repartitionByRange("feature", "value").sortWithinPartitions("feature", "value")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    stored = write_table(ordered.select("feature", "value", F.spark_partition_id().alias("part"), place.alias("place")), "categories")
    before = Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = stored.groupBy("feature", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    starts = ranges.select("feature", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("start"))
    path = new_path(values.sparkSession, "dictionary")
    # one row per range and one more per feature at most
    coded = stored.join(F.broadcast(starts), ["feature", "part"])
    coded.select("feature", "value", (F.col("start") + F.col("place")).alias("code")).write.parquet(path)
    return path


def heavy_values(frame: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Per string column, the values that hold more than one in HOT_SHARE rows: one pass, bounded state."""
    if not columns:
        return {}
    found = frame.agg(
        F.count("*").alias("rows"),
        *[F.expr(f"approx_top_k(`{c}`, {HOT_SHARE}, {TRACKED})").alias(f"top{i}") for i, c in enumerate(columns)],
    ).first()
    return {
        c: sorted(t["item"] for t in found[f"top{i}"] or [] if t["item"] is not None and t["count"] * HOT_SHARE > found["rows"])
        for i, c in enumerate(columns)
    }


def spread_key(column: str, hot: list[str]) -> list[Column]:
    """Join key of a value, and whether it is none: hot values get their partition's number, which matches nothing.

    A retried task gives every row the same key again, whatever order its rows come in.
    """
    is_hot = F.col(column).isin(hot) if hot else F.lit(False)
    key = F.when(is_hot, F.spark_partition_id().cast("string")).otherwise(F.col(column))
    return [key.alias(KEY), F.coalesce(is_hot, F.lit(False)).alias(SPREAD)]


def look_up(frame: DataFrame, column: str, table: DataFrame, result: str, hot: list[str], skip: list[str] = ()) -> DataFrame:
    """Add ``result`` of ``table`` (value, result) for the value in ``column``; NULL where it has none.

    ``hot`` values are looked up in their own rows of the table, which are broadcast (there are at most
    HOT_SHARE). Values of ``skip`` are not looked up and stay NULL.
    """
    apart = [*hot, *skip]
    key, spread = spread_key(column, apart)
    rest = table.select(F.col("value").alias(KEY), F.lit(False).alias(SPREAD), F.col(result))
    out = frame.select("*", key, spread).join(rest, [KEY, SPREAD], "left").drop(KEY, SPREAD)
    wanted = [v for v in hot if v not in set(skip)]
    if not wanted:
        return out
    few = table.filter(F.col("value").isin(wanted)).select(F.col("value").alias(KEY), F.col(result).alias(SPREAD))
    both = out.join(F.broadcast(few), F.col(column) == F.col(KEY), "left")
    return both.withColumn(result, F.coalesce(result, SPREAD)).drop(KEY, SPREAD)


def code(position: int) -> str:
    return f"{CODE}{position}"


def with_codes(frame: DataFrame, names: dict[int, str], columns: dict[int, str], path: str) -> DataFrame:
    """Add ``code(i)`` for the wide features: ``names`` of features and ``columns`` of the frame by position."""
    known = frame.sparkSession.read.schema(DICTIONARY).parquet(path)
    hot = heavy_values(frame, list(columns.values()))
    for i, name in names.items():
        table = known.filter(F.col("feature") == name).select("value", F.col("code").alias(code(i)))
        frame = look_up(frame, columns[i], table, code(i), hot[columns[i]])
    return frame


def sparse_vectors(frame: DataFrame, keep: int, numbers: int, starts: list[int], size: int, output: str) -> DataFrame:
    """The first ``keep`` columns and a sparse vector of ``size``.

    Then come ``numbers`` numeric columns, which are its first places, and one code per further block, which
    begins at its place of ``starts``; a NULL code sets nothing.
    """
    offsets = np.array([*range(numbers), *starts], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, width = batch.num_rows, numbers + len(starts)
            places, values = np.tile(offsets, (n, 1)), np.ones((n, width))
            present = np.ones((n, width), bool)
            values[:, :numbers] = matrix_of(batch, keep, keep + numbers)
            for k in range(numbers, width):
                codes = batch.column(keep + k)
                present[:, k] = codes.is_valid().to_numpy(zero_copy_only=False)
                places[:, k] += codes.fill_null(0).to_numpy(zero_copy_only=False)
            ends = pa.array(np.concatenate([[0], np.cumsum(present.sum(axis=1))]).astype(np.int32))
            vectors = pa.StructArray.from_arrays(
                [
                    pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)),
                    pa.ListArray.from_arrays(ends, pa.array(places[present].astype(np.int32))),
                    pa.ListArray.from_arrays(ends, pa.array(values[present])),
                ],
                fields=list(VECTOR_ARROW),
            )
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], vectors], [*batch.schema.names[:keep], output])

    return frame.mapInArrow(run, StructType([*frame.schema[:keep], StructField(output, VectorUDT())]))
