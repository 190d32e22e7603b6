"""Intermediate tables in the folder all executors share.

Lineage is cut by writing a table, so that a lost executor costs one re-read, never a recomputation
with other partitions. The folder is the one the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; in local mode, where none is named, a new temporary one."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    return folder.rstrip("/") if folder else _local_folder(spark.sparkContext.master)


@lru_cache(maxsize=1)
def _local_folder(master: str) -> str:
    if not master.startswith("local"):
        raise ValueError(f"Set {CHECKPOINT_DIR} to a folder that all executors can reach")
    return tempfile.mkdtemp(prefix="flowbench-")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/flowbench/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a frame that reads it back."""
    path = new_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return read_back(df.sparkSession, path, df.schema)


def read_back(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read a table just written; its schema is known, so no file footer is opened for it."""
    return spark.read.schema(schema).parquet(path)


def committed(spark: SparkSession, pattern: str) -> list[str]:
    """The folders that match ``pattern`` and were written to the end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(status.getPath().getParent().toString() for status in found or [])


def literal_path(path: str) -> str:
    """A path as Spark reads it literally: glob characters escaped."""
    return "".join(f"\\{c}" if c in "\\{}[]*?" else c for c in path)


def laid_out(table: DataFrame, rows_per_part: int) -> DataFrame:
    """The rows of a stored table in a layout that depends on the data only.

    Rows go to partitions by a hash of their content, into a number of partitions that follows from the
    row count, and are sorted within. Neither cores, files nor retries change what a task sees.
    """
    parts = table.count() // rows_per_part + 1
    return table.repartition(parts, F.xxhash64(*table.columns)).sortWithinPartitions(*table.columns)
