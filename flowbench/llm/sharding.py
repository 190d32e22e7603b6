"""Resharding by minimum-cost flow.

A sharded table is a folder of Parquet files and a manifest that says which shard each file belongs to. To
give the shards new capacities, only sums per old shard go to the driver: a minimum-cost flow from old
sizes to new capacities says how many bytes each shard keeps and gives to which other. Moving a byte costs
what the cost table says (by default nothing within a shard, one between two), so the flow moves the fewest
bytes. Along that flow the files of a shard, in the order of their names, are dealt to its targets as blocks:
a file that goes to one target only changes its entry in the manifest; the few files that lie across a border (fewer
than old and new shards together) are rewritten, their rows dealt by size, the largest first, to the target
with the most room left. So sizes meet the capacities but for the smallest rows.

New files are written first, then the manifest of the next version, which makes them visible: a run that
breaks off changes nothing, and older versions stay readable. Sizes are stored beside the rows, so measuring
reads one narrow column. No step shuffles texts; one file's row sizes are the largest group.

A row's size is the UTF-8 bytes of its text and one; a null or empty text has size 1. Ids do not matter: null and
repeated ids and rows are placed like others. A very long text is one row and is never cut: a shard can
exceed its capacity by it if it is larger. A null old shard is shard 0. An empty table stays empty. All
columns are kept; those whose names begin with ``__llm_`` are refused.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowbench.llm.common import RESERVED, reserved

SIZE, SHARD, FILE, PLACE, TARGET = (reserved(n) for n in ("size", "shard", "file", "place", "target"))
#: Up to so many files the manifest (about 24 bytes a file) is broadcast to the rows; beyond it is joined.
BROADCAST_FILES = 1_000_000
MANIFEST = "file string, shard int, bytes long, rows long, base long"


def minimum_cost_flow(sizes: Sequence[int], capacities: Sequence[int], cost: np.ndarray) -> np.ndarray:
    """Whole numbers sent from each source to each target, at the least cost; all sizes are sent.

    Successive shortest paths in the residual network: each path is the cheapest way to send more, also by
    taking back what was sent before.
    """
    left, room = np.array(sizes, object), np.array(capacities, object)
    if left.sum() > room.sum():
        raise ValueError(f"capacities of {room.sum()} bytes for {left.sum()} bytes")
    flow = np.zeros(cost.shape, object)
    while (left > 0).any():
        source, target = np.where(left > 0, 0.0, np.inf), np.full(len(room), np.inf)
        came_from, via = np.full(len(left), -1), np.full(len(room), -1)
        improved = True
        while improved:  # Bellman-Ford over both sides; only what is strictly better replaces a way
            ways = source[:, None] + cost
            nearer = ways.min(axis=0) < target - 1e-9
            via[nearer], target[nearer] = ways.argmin(axis=0)[nearer], ways.min(axis=0)[nearer]
            back = np.where(flow > 0, target[None, :] - cost, np.inf)
            better = back.min(axis=1) < source - 1e-9
            came_from[better], source[better] = back.argmin(axis=1)[better], back.min(axis=1)[better]
            improved = nearer.any() or better.any()
        end = int(np.where(room > 0, target, np.inf).argmin())
        path, t = [], end
        while True:
            s = int(via[t])
            path.append((s, t))
            if came_from[s] < 0:
                break
            t = int(came_from[s])
            path.append((s, t))
        amount = min([left[path[-1][0]], room[end], *(flow[edge] for edge in path[1::2])])
        for k, edge in enumerate(path):
            flow[edge] += -amount if k % 2 else amount
        left[path[-1][0]] -= amount
        room[end] -= amount
    return flow


def moving_cost(old: int, new: int) -> np.ndarray:
    """Nothing for bytes that stay in their shard, one for each that moves."""
    return 1.0 - np.eye(old, new)


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


@dataclass(frozen=True)
class ShardedTable:
    """One version of a sharded table; ``schema`` is that of its rows."""

    spark: SparkSession
    folder: str
    schema: StructType
    version: int

    def manifest(self) -> DataFrame:
        """file, shard, bytes and rows of each file, and ``base``: rows of its shard in files before it."""
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/version={self.version}")

    def _stored(self) -> DataFrame:
        """All rows of all files with their file and place in it."""
        stored = StructType([*self.schema.fields]).add(SIZE, "long")
        return files_of(self.spark.read.schema(stored).option("recursiveFileLookup", True).parquet(f"{self.folder}/data"))

    def rows(self) -> DataFrame:
        """All rows with ``shard``, ``slot`` (gapless in the shard) and ``size``, under reserved names."""
        manifest = self.manifest().select(F.xxhash64("file").alias(FILE), F.col("shard").alias(SHARD), "base")
        if manifest.count() <= BROADCAST_FILES:
            manifest = F.broadcast(manifest)
        placed = self._stored().withColumn(FILE, F.xxhash64(FILE)).join(manifest, FILE)
        slot = (F.col("base") + F.col(PLACE)).alias(reserved("slot"))
        return placed.select(*self.schema.names, SHARD, slot, SIZE)


def files_of(rows: DataFrame) -> DataFrame:
    file = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+/[^/]+)$", 1)
    return rows.select("*", file.alias(FILE), F.col("_metadata.row_index").alias(PLACE))


def latest_version(spark: SparkSession, folder: str) -> int:
    """The newest version whose manifest is whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest/version=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    versions = [int(status.getPath().getParent().getName().split("=")[1]) for status in found]
    if not versions:
        raise FileNotFoundError(f"{folder} holds no whole manifest")
    return max(versions)


def _write(rows: DataFrame, folder: str, target: str) -> str:
    """New files, apart by ``target``; returns the name of their part of the folder."""
    job = uuid.uuid4().hex
    rows.write.partitionBy(target).parquet(f"{folder}/data/{job}")
    return job


def _written(spark: SparkSession, folder: str, job: str, target: str) -> DataFrame:
    """(file, shard, bytes, rows) of the files of one write, by their stored sizes."""
    narrow = spark.read.schema(f"`{SIZE}` long").option("recursiveFileLookup", True).parquet(f"{folder}/data/{job}")
    sums = files_of(narrow).groupBy(FILE).agg(F.sum(SIZE).alias("bytes"), F.count(F.lit(1)).alias("rows"))
    shard = F.regexp_extract(FILE, f"{target}=(\\d+)/", 1).cast("int")
    return sums.select(F.col(FILE).alias("file"), shard.alias("shard"), "bytes", "rows")


def _publish(files: DataFrame, table: ShardedTable) -> ShardedTable:
    before = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    numbered = files.withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    numbered.select("file", "shard", "bytes", "rows", "base").write.parquet(f"{table.folder}/manifest/version={table.version}")
    return table


def write_shards(docs: DataFrame, folder: str, shard: Column, text_column: str = "text") -> ShardedTable:
    """Store ``docs`` as the first version of a sharded table."""
    if taken := [c for c in docs.columns if c.startswith(RESERVED)]:
        raise ValueError(f"reserved names: {', '.join(taken)}")
    size = F.octet_length(F.coalesce(docs[text_column].cast("string"), F.lit(""))).cast("long") + 1
    rows = docs.select("*", size.alias(SIZE), F.coalesce(shard.cast("int"), F.lit(0)).alias(SHARD))
    job = _write(rows, folder, SHARD)
    table = ShardedTable(docs.sparkSession, folder, docs.schema, 0)
    return _publish(_written(table.spark, folder, job, SHARD), table)


def stretches(flow: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(old shard, target, from byte, to byte): what a shard keeps comes first in it."""
    out = []
    for old, row in enumerate(flow):
        at = 0
        for target in sorted(range(len(row)), key=lambda t: (t != old, t)):
            if row[target]:
                out.append((old, target, at, at + int(row[target])))
                at += int(row[target])
    return out


def dealt_files(table: ShardedTable, borders: list[tuple[int, int, int, int]]) -> DataFrame:
    """(file, bytes, rows, parts): the targets of each file, with the bytes that each shall get of it."""
    spark = table.spark
    before = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = table.manifest().withColumn("begin", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    files = files.withColumn("end", F.col("begin") + F.col("bytes"))
    # fewer rows than old and new shards together
    known = F.broadcast(spark.createDataFrame(borders, "shard int, target int, low long, high long"))
    meet = files.join(known, "shard").filter("low < end and high > begin")
    part = F.struct("target", (F.least("high", "end") - F.greatest("low", "begin")).alias("want"))
    return meet.groupBy("file", "bytes", "rows").agg(F.collect_list(part).alias("parts"))


def deal_rows(group: pd.DataFrame) -> pd.DataFrame:
    """The target of each row of a file that several shards get a part of."""
    room = [(-int(p["want"]), int(p["target"])) for p in group["parts"].iloc[0]]
    heapq.heapify(room)
    group = group.sort_values([SIZE, PLACE], ascending=[False, True], ignore_index=True)
    targets = []
    for size in group[SIZE].tolist():
        most, target = room[0]
        heapq.heapreplace(room, (most + size, target))
        targets.append(target)
    return group[[FILE, PLACE]].assign(**{TARGET: targets})


def reshard(table: ShardedTable, capacities: int | Sequence[int], cost: np.ndarray | None = None) -> ShardedTable:
    """The next version of ``table``, with shards of the given capacities in bytes.

    A number means so many shards of equal size. ``cost`` has a row per old and a column per new shard.
    """
    spark = table.spark
    sums = {r["shard"]: r["bytes"] for r in table.manifest().groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
    sizes = [sums.get(k, 0) for k in range(max(sums, default=0) + 1)]
    if isinstance(capacities, int):
        capacities = equal_capacities(sum(sizes), capacities)
    flow = minimum_cost_flow(sizes, capacities, moving_cost(len(sizes), len(capacities)) if cost is None else cost)
    after = ShardedTable(spark, table.folder, table.schema, table.version + 1)
    borders = stretches(flow)
    if not borders:
        return _publish(table.manifest(), after)
    files = dealt_files(table, borders).persist()
    whole = files.filter("size(parts) = 1").select("file", F.col("parts")[0]["target"].alias("shard"), "bytes", "rows")
    cut = files.filter("size(parts) > 1").select(F.col("file").alias(FILE), "parts")
    paths = [f"{table.folder}/data/{r[FILE]}" for r in cut.select(FILE).collect()]  # fewer than old and new shards
    if paths:
        stored = StructType([*table.schema.fields]).add(SIZE, "long")
        across = files_of(spark.read.schema(stored).parquet(*paths))
        sized = across.select(FILE, PLACE, SIZE).join(F.broadcast(cut), FILE)
        dealt = sized.groupBy(FILE).applyInPandas(deal_rows, f"`{FILE}` string, `{PLACE}` long, `{TARGET}` int")
        job = _write(across.join(dealt, [FILE, PLACE]).select(*table.schema.names, SIZE, TARGET), table.folder, TARGET)
        whole = whole.unionByName(_written(spark, table.folder, job, TARGET))
    _publish(whole, after)
    files.unpersist()
    return after


def rewritten_bytes(before: ShardedTable, after: ShardedTable) -> tuple[int, int]:
    """Bytes of files that the newer version no longer has, and of those that both have."""
    old, new = before.manifest().select("file", "bytes"), after.manifest().select("file")
    kept = old.join(new, "file", "left_semi").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    return old.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] - kept, kept
