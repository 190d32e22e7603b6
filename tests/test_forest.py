"""The forest of stored, binned rows: counts, splits, draws and the model made of them."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from flowbench.operators import forest
from flowbench.operators.forest import Codes, Settings, thresholds_of

SETTINGS = Settings(trees=5, max_depth=4, min_rows=2, max_bins=8, memory_mb=64, seed=3)


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 3, 900).astype(np.int32)
    values = rng.normal(size=(900, 9)).astype(np.float32)
    values[:, 2] += labels
    values[:, 5] = np.round(values[:, 5] - labels)
    values[:, 7] = 1.0
    return labels, values


@pytest.fixture(scope="module")
def codes(sample):
    return Codes(tuple(thresholds_of(column, SETTINGS.max_bins) for column in sample[1].T), 3)


@pytest.fixture(scope="module")
def rows(spark, sample):
    frame = pa.table({"rotation": sample[0], "features": sample[1].tolist()})
    return spark.createDataFrame(frame).select("rotation", F.col("features").cast("array<float>").alias("features")).coalesce(1)


@pytest.fixture(scope="module")
def stored(rows, codes):
    return forest.stored_codes(rows, codes)


def test_bins_lie_between_values():
    assert thresholds_of(np.array([3.0, 1.0, 1.0, 2.0]), 8).tolist() == [1.5, 2.5]
    assert thresholds_of(np.full(5, 7.0), 8).size == 0
    many = thresholds_of(np.arange(1000.0), 8)
    assert len(many) == 7 and np.abs(many - np.arange(125, 1000, 125)).max() < 1
    # one value that is most of the rows is no reason for two equal thresholds
    skewed = thresholds_of(np.concatenate([np.zeros(900), np.arange(1, 101)]), 8)
    assert (np.diff(skewed) > 0).all() and len(skewed) >= 1


def test_best_split_equals_trying_all():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 5, (20, 3, 6, 4))
    counts[:, 1:] = rng.permuted(counts[:, :1].repeat(2, axis=1), axis=2)  # every feature counts the same rows
    counts[7] = 0
    counts[7, :, 0, 0] = 9
    position, cut, gain, left = forest.best_splits(counts, 2)

    def gini(c):
        return 1 - ((c / max(c.sum(), 1)) ** 2).sum()

    for node, c in enumerate(counts):
        total, found = c[0].sum(axis=0), []
        for f in range(3):
            for b in range(5):
                a = c[f, : b + 1].sum(axis=0)
                z = total - a
                if a.sum() >= 2 and z.sum() >= 2:
                    found.append(gini(total) - (a.sum() * gini(a) + z.sum() * gini(z)) / total.sum())
        if max(found, default=0) > 1e-15:
            assert gain[node] == pytest.approx(max(found), abs=1e-12)
            assert (left[node] == c[position[node], : cut[node] + 1].sum(axis=0)).all()
        else:
            assert position[node] == -1


def test_draws_are_poisson():
    drawn = np.bincount(forest.drawn_rows(-5, 2, 1 << 40, 200_000), minlength=200_000)
    assert drawn.mean() == pytest.approx(1, abs=0.01) and drawn.var() == pytest.approx(1, abs=0.02)
    assert (drawn == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)
    again = forest.drawn_rows(-5, 2, 1 << 40, 200_000)
    assert (np.bincount(again, minlength=200_000) == drawn).all()
    assert len(forest.drawn_rows(1, 0, 0, 1)) in range(9)


def test_every_node_counts_the_rows_that_reach_it(rows, sample, codes, stored, spark):
    trees = forest.grow(stored, 900, codes, SETTINGS)
    labels, coded = sample[0], codes.of(*sample) // codes.classes
    chunk, n = stored.select("chunk", "rows").first()
    assert stored.count() == 1 and n == 900
    for tree in range(SETTINGS.trees):
        waiting = [(tree, forest.drawn_rows(SETTINGS.seed, tree, chunk, n))]
        while waiting:
            node, there = waiting.pop()
            counts = np.bincount(labels[there], minlength=3)
            assert (trees.counts[node] == counts).all() and trees.tree[node] == tree
            if trees.child[node] < 0:
                assert trees.depth[node] <= SETTINGS.max_depth
                continue
            left = coded[trees.feature[node], there] <= trees.bin[node]
            assert min(left.sum(), (~left).sum()) >= SETTINGS.min_rows
            waiting += [(trees.child[node], there[left]), (trees.child[node] + 1, there[~left])]
    assert trees.depth.max() == SETTINGS.max_depth and 7 not in trees.feature

    # The model gives the mean of the leaves' shares, and no two sibling leaves predict the same.
    model = forest.as_model(spark, trees, codes, SETTINGS, {"features": "v", "label": "rotation", "probability": "p"})
    pruned = trees.pruned()
    assert model.totalNumNodes == len(pruned.tree) <= len(trees.tree) and model.getNumTrees == SETTINGS.trees
    wanted = np.zeros((900, 3))
    for tree in range(SETTINGS.trees):
        for row in range(900):
            node = tree
            while pruned.child[node] >= 0:
                node = pruned.child[node] + int(coded[pruned.feature[node], row] > pruned.bin[node])
            wanted[row] += pruned.counts[node] / pruned.counts[node].sum() / SETTINGS.trees
    scored = model.transform(rows.select(array_to_vector("features").alias("v")))
    got = np.array([r[0] for r in scored.select(vector_to_array("p")).collect()])
    assert np.allclose(got, wanted, atol=1e-12)
    leaves = pruned.child < 0
    both = [(c, c + 1) for c in pruned.child[~leaves] if leaves[c] and leaves[c + 1]]
    assert both and all(pruned.counts[a].argmax() != pruned.counts[b].argmax() for a, b in both)


def test_tasks_and_blocks_do_not_change_the_forest(rows, codes, monkeypatch):
    monkeypatch.setattr(forest, "CHUNK_ROWS", 100)
    stored = forest.stored_codes(rows, codes)
    assert stored.count() == 9
    whole = forest.grow(stored, 900, codes, SETTINGS)
    monkeypatch.setattr(forest, "BLOCK_BYTES", 1)
    monkeypatch.setattr(forest, "TASK_ROWS", 1000)
    cut = forest.grow(stored.repartition(3), 900, codes, SETTINGS)
    for name in ("tree", "feature", "bin", "child", "counts"):
        assert (getattr(whole, name) == getattr(cut, name)).all()


def test_without_a_split_the_roots_are_leaves(spark):
    rows = spark.range(6).select((F.col("id") % 2).cast("int").alias("rotation"), F.array(F.lit(1.0).cast("float")).alias("features"))
    codes = Codes((thresholds_of(np.ones(3), 8),), 2)
    trees = forest.grow(forest.stored_codes(rows, codes), 6, codes, SETTINGS)
    assert len(trees.tree) == SETTINGS.trees and (trees.child < 0).all() and trees.counts.sum() > 0
