"""What several corpus operators share: table access and the word pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = (0x20, *range(0x09, 0x0E))

#: Helper columns carry this prefix, so that they never meet a column of the caller.
RESERVED = "__llm_"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def drawn(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` rows with the smallest hash of ``key``, a column without repeats.

    In a large table a bound on the hash, from the number of rows, first leaves little more than these, so
    that no task has to send as many.
    """
    order, total = F.xxhash64(key), rows.count()
    enough = 2 * most + 200
    if total > enough:
        rows = rows.filter(order < int(enough / total * 2**64) - 2**63)
    return rows.orderBy(order, key).limit(most)


def reserved(name: str) -> str:
    return RESERVED + name
