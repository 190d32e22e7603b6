"""A random forest grown level by level over stored, binned rows.

The trees are those of Spark ML's forest: every tree sees each row a Poisson(1) number of times, every node tries
a drawn subset of the features, splits lie between bins of a sample's quantiles and are chosen by Gini gain, and
sibling leaves of one prediction are merged. What differs is where the time goes. Values are binned once and stored
as small integers, feature by feature. A pass counts the open nodes of all trees: a task follows a tree down from its
root with the rows that still matter only, so the counts of one node are made while they lie in the processor's
cache; nodes with few rows send these instead of counts. Counts are whole numbers and the draws depend on seed, tree
and chunk of rows, so neither tasks, cores nor retries change the forest. The result is Spark ML's own model.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from math import ceil, exp, factorial, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import lists_of, matrix_of_lists
from ..sources.tables import new_path, read_back

#: Rows of a chunk (one stored value, and one draw per tree), and bytes it may have: much larger values are slow to
#: read, since the JVM gives each a region of memory of its own.
CHUNK_ROWS, CHUNK_BYTES = 5000, 1 << 20
#: Tasks of a pass per core; trees are shared out where the stored rows make fewer, unless the tasks would have fewer
#: than so many rows of all their trees.
TASKS, TASK_ROWS = 3, 1_000_000
#: Bytes of the codes that are counted together, for each open node of a tree: where few nodes are open a block
#: that fits the processor's cache is faster, where many are, a large one.
BLOCK_BYTES = 4 << 20
#: Nodes whose splits are searched together.
NODES = 256

#: A row is drawn more than k times if 16 random bits reach the k-th limit.
POISSON = np.rint(np.cumsum([exp(-1) / factorial(k) for k in range(9)]) * 65536).astype(np.int64)
POISSON = tuple(int(limit) for limit in POISSON if limit < 65536)

CODES = "chunk long, rows int, codes binary"
COUNTS = "slot int, rows int, counts binary"
SPLITS = "slot int, position int, bin int, gain double, counts array<long>, left array<long>"
NODE_DATA = """struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: long,
    gain: double, leftChild: int, rightChild: int,
    split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"""


@dataclass(frozen=True)
class Settings:
    trees: int
    max_depth: int
    min_rows: int
    max_bins: int
    memory_mb: int
    seed: int


@dataclass(frozen=True)
class Codes:
    """How values become codes: ``bin * classes + label``, a bin being the number of thresholds below the value."""

    thresholds: tuple[np.ndarray, ...]
    classes: int

    @property
    def width(self) -> int:
        return len(self.thresholds)

    @property
    def bins(self) -> int:
        return max(len(found) for found in self.thresholds) + 1

    @property
    def cells(self) -> int:
        return self.bins * self.classes

    @property
    def dtype(self) -> np.dtype:
        return np.min_scalar_type(self.cells - 1)

    def of(self, labels: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Codes (features x rows) of a matrix (rows x features)."""
        codes = np.empty(values.T.shape, self.dtype)
        for line, column, found in zip(codes, np.ascontiguousarray(values.T), self.thresholds):
            line[:] = np.searchsorted(found, column) * self.classes + labels
        return codes


@dataclass
class Trees:
    """All nodes of all trees, level by level; the first are the roots. Children lie side by side."""

    tree: np.ndarray
    depth: np.ndarray
    parent: np.ndarray
    counts: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    gain: np.ndarray
    child: np.ndarray

    @classmethod
    def of(cls, tree: np.ndarray, depth: int, parent: np.ndarray, counts: np.ndarray) -> Trees:
        none = np.full(len(tree), -1, np.int32)
        return cls(tree.astype(np.int32), np.full(len(tree), depth, np.int32), parent.astype(np.int32), counts,
                   none, none.copy(), np.full(len(tree), -1.0), none.copy())

    def extended(self, more: Trees) -> Trees:
        return Trees(*(np.concatenate([getattr(self, name), getattr(more, name)]) for name in vars(self)))

    def useful(self, open_nodes: np.ndarray) -> np.ndarray:
        """The open nodes and all above them."""
        useful = np.zeros(len(self.tree), bool)
        while len(open_nodes):
            useful[open_nodes] = True
            open_nodes = np.unique(self.parent[open_nodes])
            open_nodes = open_nodes[open_nodes >= 0]
        return useful

    def pruned(self) -> Trees:
        """Leaves of one parent that predict the same become that parent, as in Spark ML."""
        says, child = self.counts.argmax(axis=1), self.child.copy()
        for depth in range(int(self.depth.max()), -1, -1):
            inner = np.flatnonzero((self.depth == depth) & (child >= 0))
            left, right = child[inner], child[inner] + 1
            alike = (child[left] < 0) & (child[right] < 0) & (says[left] == says[right])
            child[inner[alike]] = -1
        kept = np.arange(len(child)) < (self.depth == 0).sum()
        for depth in range(int(self.depth.max())):
            inner = np.flatnonzero((self.depth == depth) & (child >= 0) & kept)
            kept[child[inner]] = kept[child[inner] + 1] = True
        place = np.cumsum(kept) - 1
        child = np.where(child < 0, -1, place[child])
        parent = np.where(self.parent < 0, -1, place[self.parent])
        moved = replace(self, child=child, parent=parent)
        return Trees(*(getattr(moved, name)[kept] for name in vars(moved)))


def thresholds_of(values: np.ndarray, max_bins: int) -> np.ndarray:
    """Midpoints between distinct values: all of them, or those next to the quantiles that bound the bins."""
    distinct, counts = np.unique(values, return_counts=True)
    middles = (distinct[:-1].astype(float) + distinct[1:]) / 2
    if len(middles) >= max_bins:
        below, wanted = np.cumsum(counts)[:-1], len(values) / max_bins * np.arange(1, max_bins)
        after = np.searchsorted(below, wanted).clip(1, len(below) - 1)
        middles = middles[np.unique(after - (wanted - below[after - 1] <= below[after] - wanted))]
    return middles


def stored_codes(rows: DataFrame, codes: Codes) -> DataFrame:
    """Codes of the ``rows`` (label and ``array<float>``) in chunks, written as a table."""
    size = max(1, min(CHUNK_ROWS, CHUNK_BYTES // (codes.width * codes.dtype.itemsize)))
    shared = rows.sparkSession.sparkContext.broadcast(codes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, number = shared.value, TaskContext.get().partitionId() << 32
        waiting = np.empty((codes.width, size), codes.dtype)
        filled = 0

        def chunk() -> pa.RecordBatch:
            data = [pa.array([number]), pa.array([filled], pa.int32()), pa.array([waiting[:, :filled].tobytes()])]
            return pa.RecordBatch.from_arrays(data, ["chunk", "rows", "codes"])

        for batch in batches:
            if not batch.num_rows:
                continue
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            found, taken = codes.of(labels, matrix_of_lists(batch.column(1))), 0
            while taken < batch.num_rows:
                some = min(size - filled, batch.num_rows - taken)
                waiting[:, filled:filled + some] = found[:, taken:taken + some]
                filled, taken = filled + some, taken + some
                if filled == size:
                    yield chunk()
                    filled, number = 0, number + 1
        if filled:
            yield chunk()

    made, path = rows.mapInArrow(encode, CODES), new_path(rows.sparkSession, "forest-codes")
    made.write.option("compression", "none").parquet(path)  # they hardly shrink, and every pass reads them
    return read_back(rows.sparkSession, path, made.schema)


def drawn_rows(seed: int, tree: int, chunk: int, rows: int) -> np.ndarray:
    """Numbers of the rows of a chunk that grow a tree, each as often as it is drawn."""
    bits = np.random.SFC64([seed & (1 << 64) - 1, tree, chunk]).random_raw(rows // 4 + 1).view(np.uint16)[:rows]
    more = np.flatnonzero(bits >= POISSON[0])
    drawn = [more]
    for limit in POISSON[1:]:
        more = more[bits.take(more) >= limit]
        drawn.append(more)
    return np.concatenate(drawn)


@dataclass(frozen=True)
class Pass:
    """What the tasks of a pass over the rows need: the way down to the open nodes, and what to count there."""

    trees: tuple[tuple[int, ...], ...]
    feature: np.ndarray
    limit: np.ndarray
    child: np.ndarray
    useful: np.ndarray
    slot: np.ndarray
    features: np.ndarray
    seed: int
    codes: Codes
    block_bytes: int


def _blocks(batches: Iterator[pa.RecordBatch], step: Pass) -> Iterator[tuple[int, np.ndarray, list[tuple[int, int]]]]:
    """The chunks of a task side by side, as many at a time as its memory allows: group, codes, their numbers and rows."""
    parts, chunks, filled, last = [], [], 0, None
    for batch in batches:
        groups, numbers, rows = (batch.column(i).to_pylist() for i in range(3))
        for i, (group, number, count) in enumerate(zip(groups, numbers, rows)):
            part = np.frombuffer(batch.column(3)[i].as_buffer(), step.codes.dtype).reshape(-1, count)
            if parts and (group != last or filled + part.nbytes > step.block_bytes):
                yield last, np.concatenate(parts, axis=1), chunks
                parts, chunks, filled = [], [], 0
            last = group
            parts.append(part)
            chunks.append((number, count))
            filled += part.nbytes
    if parts:
        yield last, np.concatenate(parts, axis=1), chunks


def _count_block(codes: np.ndarray, chunks: list[tuple[int, int]], tree: int, step: Pass) -> Iterator[tuple[int, int, bytes]]:
    """Slot, rows and codes of the rows in each open node of a tree; counts and no rows where these are shorter."""
    drawn, before = [], 0
    for number, rows in chunks:
        drawn.append(drawn_rows(step.seed, tree, number, rows) + before)
        before += rows
    rows = np.concatenate(drawn)
    waiting = [(tree, rows)] if len(rows) else []
    few, cells = step.codes.cells // codes.itemsize, step.codes.cells
    while waiting:
        node, rows = waiting.pop()
        slot = int(step.slot[node])
        if slot >= 0:
            features = step.features[slot]
            if len(rows) <= few:
                yield slot, len(rows), codes[features[:, None], rows].tobytes()
            else:
                counts = np.empty((len(features), cells), np.int32)
                for line, feature in zip(counts, features):
                    line[:] = np.bincount(codes[feature].take(rows), minlength=cells)
                yield slot, 0, counts.tobytes()
            continue
        left = codes[step.feature[node]].take(rows) < step.limit[node]
        for child, side in ((step.child[node], left), (step.child[node] + 1, ~left)):
            if step.useful[child]:
                there = rows.compress(side)
                if len(there):
                    waiting.append((child, there))


def _counted(rows: DataFrame, step: Pass) -> DataFrame:
    """Per open node and block of rows, what its rows count."""
    groups = len(step.trees)
    shared = rows.sparkSession.sparkContext.broadcast(step)
    frames = [rows.select(F.lit(group).alias("group"), "chunk", "rows", "codes") for group in range(groups)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = shared.value
        for group, codes, chunks in _blocks(batches, step):
            found, size = [], 0
            for tree in step.trees[group]:
                for line in _count_block(codes, chunks, tree, step):
                    found.append(line)
                    size += len(line[2])
                    if size > 8 << 20:
                        yield _lines(found)
                        found, size = [], 0
            if found:
                yield _lines(found)

    return reduce(DataFrame.unionAll, frames).mapInArrow(count, COUNTS)


def _lines(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    slots, rows, counts = zip(*found)
    data = [pa.array(slots, pa.int32()), pa.array(rows, pa.int32()), pa.array(counts, pa.binary())]
    return pa.RecordBatch.from_arrays(data, ["slot", "rows", "counts"])


def best_splits(counts: np.ndarray, min_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature's position, bin, gain and left counts of each node's best split of ``counts`` (node, feature, bin,
    class); position -1 where none gains."""
    left = counts.cumsum(axis=2)
    total, left = left[:, :1, -1:], left[:, :, :-1]
    right = total - left
    n, n_left, n_right = total.sum(-1), left.sum(-1), right.sum(-1)
    squares = lambda c: np.einsum("...k,...k->...", c.astype(float), c.astype(float))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (squares(left) / n_left + squares(right) / n_right - squares(total) / n) / n
    gain = np.where((n_left >= min_rows) & (n_right >= min_rows), gain, -1.0).reshape(len(counts), -1)
    if not gain.shape[1]:  # no feature has two values
        none = np.full(len(counts), -1)
        return none, none, none.astype(float), np.zeros((len(counts), counts.shape[3]), np.int64)
    at, nodes = gain.argmax(axis=1), np.arange(len(counts))
    position, cut = np.divmod(at, counts.shape[2] - 1)
    best = gain[nodes, at]
    return np.where(best > 1e-15, position, -1), cut, best, left[nodes, position, cut]


def _splits(counted: DataFrame, tried: int, codes: Codes, min_rows: int, parts: int) -> DataFrame:
    """The best split of every open node, its counts added up over the blocks of rows."""
    bins, classes, cells, dtype = codes.bins, codes.classes, codes.cells, codes.dtype

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, sums = np.arange(0, tried * cells, cells)[:, None], {}
        for batch in batches:
            for i, (slot, rows) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                data = batch.column(2)[i].as_buffer()
                if rows:
                    found = np.frombuffer(data, dtype).reshape(tried, rows) + starts
                    counts = np.bincount(found.ravel(), minlength=tried * cells)
                else:
                    counts = np.frombuffer(data, np.int32)
                if slot in sums:
                    sums[slot] += counts
                else:
                    sums[slot] = counts.astype(np.int64)
        slots = list(sums)
        for start in range(0, len(slots), NODES):
            some = slots[start:start + NODES]
            counts = np.stack([sums.pop(slot) for slot in some]).reshape(len(some), tried, bins, classes)
            position, cut, gain, left = best_splits(counts, min_rows)
            data = [pa.array(some, pa.int32()), pa.array(position, pa.int32()), pa.array(cut, pa.int32()),
                    pa.array(gain), lists_of(counts[:, 0].sum(axis=1)), lists_of(left)]
            yield pa.RecordBatch.from_arrays(data, ["slot", "position", "bin", "gain", "counts", "left"])

    return counted.repartition(parts, "slot").mapInArrow(search, SPLITS)


def grow(rows: DataFrame, count: int, codes: Codes, settings: Settings) -> Trees:
    """Trees over the ``count`` stored ``rows`` of ``stored_codes``; one pass over them per level."""
    context = rows.sparkSession.sparkContext
    cores, tasks = context.defaultParallelism, max(1, min(len(rows.inputFiles()), rows.rdd.getNumPartitions()))
    tried = ceil(sqrt(codes.width))
    memory = settings.memory_mb << 20
    roots = np.arange(settings.trees)
    trees = Trees.of(roots, 0, np.full(settings.trees, -1), np.zeros((settings.trees, codes.classes), np.int64))
    open_nodes, depth = roots, 0
    while len(open_nodes):
        generator = np.random.default_rng([settings.seed & (1 << 64) - 1, depth])
        features = np.concatenate([
            np.sort(generator.random((len(some), codes.width)).argpartition(tried - 1)[:, :tried])
            for some in np.array_split(open_nodes, len(open_nodes) // 65536 + 1)
        ])
        slot = np.full(len(trees.tree), -1, np.int32)
        slot[open_nodes] = np.arange(len(open_nodes))
        alive = np.unique(trees.tree[open_nodes]).tolist()
        groups = min(len(alive), ceil(TASKS * cores / tasks), ceil(count * len(alive) / TASK_ROWS))
        step = Pass(
            tuple(tuple(alive[group::groups]) for group in range(groups)), trees.feature,
            (trees.bin + 1) * codes.classes, trees.child, trees.useful(open_nodes), slot, features,
            settings.seed, codes, min(memory // 4, BLOCK_BYTES * ceil(len(open_nodes) / len(alive))),
        )
        size = len(open_nodes) * tried * codes.cells * 8
        parts = max(min(cores, len(open_nodes)), ceil(size / (memory / 8)))
        found = _splits(_counted(rows, step), tried, codes, settings.min_rows, parts).toArrow()
        if not found.num_rows:  # so few rows that none was drawn
            break
        slots, position, cut, gain = (found.column(i).to_numpy() for i in range(4))
        counts, left = (
            matrix_of_lists(found.column(i).combine_chunks()).reshape(len(slots), codes.classes) for i in (4, 5)
        )
        nodes = open_nodes[slots]
        trees.counts[nodes] = counts
        order = np.argsort(nodes)
        order = order[position[order] >= 0]
        nodes, slots, left = nodes[order], slots[order], left[order]
        trees.feature[nodes], trees.bin[nodes] = features[slots, position[order]], cut[order]
        trees.gain[nodes], trees.child[nodes] = gain[order], len(trees.tree) + 2 * np.arange(len(nodes))
        sides = np.stack([left, counts[order] - left], axis=1).reshape(-1, codes.classes)
        depth += 1
        level = Trees.of(np.repeat(trees.tree[nodes], 2), depth, np.repeat(nodes, 2), sides)
        n = sides.sum(axis=1)
        more = (sides.max(axis=1, initial=0) < n) & (n >= 2 * settings.min_rows) & (depth < settings.max_depth)
        open_nodes = len(trees.tree) + np.flatnonzero(more)
        trees = trees.extended(level)
    return trees


def as_model(
    spark: SparkSession, trees: Trees, codes: Codes, settings: Settings, columns: dict[str, str]
):
    """The trees as Spark ML's model, by way of the files in which it is saved."""
    trees = trees.pruned()
    order = np.lexsort((np.arange(len(trees.tree)), trees.tree))
    first = np.searchsorted(trees.tree[order], np.arange(settings.trees))
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order)) - first[trees.tree[order]]
    inner, n = trees.child >= 0, trees.counts.sum(axis=1)
    impurity = 1 - ((trees.counts / np.maximum(n, 1)[:, None]) ** 2).sum(axis=1)
    cuts = np.zeros(len(order))
    cuts[inner] = [codes.thresholds[f][b] for f, b in zip(trees.feature[inner], trees.bin[inner])]
    ints = lambda values: pa.array(values, pa.int32())
    below = lambda more: ints(np.where(inner, number[trees.child + more * inner], -1))
    offsets = pa.array(np.concatenate([[0], np.cumsum(inner)]), pa.int32())
    table = pa.table({
        "treeID": ints(trees.tree), "id": ints(number), "prediction": trees.counts.argmax(axis=1).astype(float),
        "impurity": np.where(n > 0, impurity, 0.0), "impurityStats": lists_of(trees.counts.astype(float)), "rawCount": n,
        "gain": np.where(inner, trees.gain, -1.0), "leftChild": below(0), "rightChild": below(1),
        "featureIndex": ints(np.where(inner, trees.feature, -1)),
        "leftCategoriesOrThreshold": pa.ListArray.from_arrays(offsets, pa.array(cuts[inner])),
        "numCategories": ints(np.full(len(order), -1)),
    })
    node = F.struct(*table.column_names[1:9], F.struct(*table.column_names[9:]).alias("split")).cast(NODE_DATA)
    path = new_path(spark, "forest")
    nodes = spark.createDataFrame(table).select("treeID", node.alias("nodeData"))
    nodes.repartition(len(order) // 1_000_000 + 1, "treeID").write.parquet(f"{path}/data")
    common = {"featuresCol": columns["features"], "labelCol": columns["label"], "predictionCol": "", "rawPredictionCol": "",
              "probabilityCol": columns["probability"], "impurity": "gini", "maxDepth": settings.max_depth, "maxBins": settings.max_bins,
              "minInstancesPerNode": settings.min_rows, "maxMemoryInMB": settings.memory_mb, "seed": settings.seed}

    def described(name: str, own: dict, **facts) -> str:
        return json.dumps({
            "class": f"org.apache.spark.ml.classification.{name}", "timestamp": int(time.time() * 1000),
            "sparkVersion": spark.version, "uid": f"{name}_{uuid.uuid4().hex[:12]}", "paramMap": common | own,
            "defaultParamMap": {}, "numFeatures": codes.width, "numClasses": codes.classes, **facts,
        })

    each = [described("DecisionTreeClassificationModel", {}) for _ in range(settings.trees)]
    each = pa.table({"_1": ints(range(settings.trees)), "_2": each, "_3": np.ones(settings.trees)})
    spark.createDataFrame(each).coalesce(1).write.parquet(f"{path}/treesMetadata")
    own = {"numTrees": settings.trees, "featureSubsetStrategy": "sqrt"}
    whole = pa.table({"value": [described("RandomForestClassificationModel", own, numTrees=settings.trees)]})
    spark.createDataFrame(whole).coalesce(1).write.text(f"{path}/metadata")
    from pyspark.ml.classification import RandomForestClassificationModel  # not for the tasks: it is slow to import

    return RandomForestClassificationModel.load(path)
