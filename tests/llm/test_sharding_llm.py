"""Flows against enumeration, and sharded tables: contents, sizes, slots, files left alone."""

import random
from functools import lru_cache

import numpy as np
import pytest
from llm_samples import SCHEMA, awkward_docs, awkward_texts
from pyspark.sql import functions as F

from flowbench.llm import catalog, sharding
from flowbench.llm.common import reserved


def least_cost(sizes, capacities, cost):
    units = [s for s, size in enumerate(sizes) for _ in range(size)]

    @lru_cache(None)
    def go(k, room):
        if k == len(units):
            return 0
        ways = [t for t in range(len(room)) if room[t]]
        return min(cost[units[k]][t] + go(k + 1, room[:t] + (room[t] - 1,) + room[t + 1 :]) for t in ways)

    return go(0, tuple(capacities))


def test_flow_costs_least():
    rng = random.Random(2)
    for _ in range(150):
        old, new = rng.randint(1, 4), rng.randint(1, 4)
        sizes = [rng.randint(0, 4) for _ in range(old)]
        capacities = [rng.randint(0, 5) for _ in range(new)]
        capacities[0] += max(0, sum(sizes) - sum(capacities))
        cost = np.array([[rng.randint(0, 6) for _ in range(new)] for _ in range(old)], float)
        flow = sharding.minimum_cost_flow(sizes, capacities, cost)
        assert (flow >= 0).all() and list(flow.sum(axis=1)) == sizes
        assert all(flow.sum(axis=0) <= np.array(capacities, object))
        assert (flow * cost).sum() == least_cost(sizes, capacities, cost.tolist())


def test_fewest_bytes_move():
    sizes, capacities = [700, 100, 200], [250, 250, 250, 250]
    flow = sharding.minimum_cost_flow(sizes, capacities, sharding.moving_cost(3, 4))
    assert [flow[k, k] for k in range(3)] == [250, 100, 200]
    with pytest.raises(ValueError):
        sharding.minimum_cost_flow([5], [4], sharding.moving_cost(1, 1))


def contents(df, columns):
    return sorted(repr(tuple(r)) for r in df.select(*columns).collect())


def check_slots(rows, shard=sharding.SHARD, slot=reserved("slot")):
    for r in rows.groupBy(shard).agg(F.count("*").alias("n"), F.min(slot).alias("a"), F.max(slot).alias("z"), F.countDistinct(slot).alias("d")).collect():
        assert (r["a"], r["z"], r["d"]) == (0, r["n"] - 1, r["n"])


def test_awkward_rows_keep_all_columns(spark, tmp_path):
    docs = awkward_docs(spark)
    old = sharding.write_shards(docs, f"{tmp_path}/shards", F.crc32("source") % 3)
    assert contents(old.rows(), docs.columns) == contents(docs, docs.columns)
    new = sharding.reshard(old, 5)
    assert contents(new.rows(), docs.columns) == contents(docs, docs.columns)
    check_slots(new.rows())
    sizes = [r[0] for r in new.rows().groupBy(sharding.SHARD).agg(F.sum(sharding.SIZE)).select("sum(__llm_size)").collect()]
    longest = max(len((t or "").encode()) for _, t in awkward_texts())
    total = sum(len((t or "").encode()) + 1 for _, t in awkward_texts())
    assert sum(sizes) == total and max(sizes) <= max(longest + 1, total / 5 + 600)
    assert sharding.latest_version(spark, f"{tmp_path}/shards") == 1
    # the older version is as it was
    assert contents(old.rows(), docs.columns) == contents(docs, docs.columns)


def test_files_that_need_not_move_stay(spark, tmp_path):
    docs = spark.range(4000, numPartitions=20).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    old = sharding.write_shards(docs, f"{tmp_path}/shards", F.col("doc_id") % 3)
    new = sharding.reshard(old, 4)
    gone, kept = sharding.rewritten_bytes(old, new)
    assert kept > 0.8 * (gone + kept)
    sizes = sorted(r["bytes"] for r in new.manifest().groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect())
    assert len(sizes) == 4 and sizes[-1] - sizes[0] <= 20
    same = sharding.reshard(new, [s + 60 for s in (25_500,) * 4])
    assert sharding.rewritten_bytes(new, same)[0] == 0
    check_slots(same.rows())
    uneven = sharding.reshard(same, [0, 200_000])
    assert contents(uneven.rows().select(sharding.SHARD).distinct(), [sharding.SHARD]) == ["(1,)"]
    assert contents(uneven.rows(), docs.columns) == contents(docs, docs.columns)


def test_half_the_rows_are_one_row(spark, tmp_path):
    rows = [(None, "copy " * 20)] * 3000 + [(i, f"text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    new = sharding.reshard(sharding.write_shards(docs, f"{tmp_path}/shards", F.lit(None)), 7)
    check_slots(new.rows())
    sizes = [r["bytes"] for r in new.manifest().groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 101
    assert new.rows().count() == 6000


def test_empty_table_and_reserved_names(spark, tmp_path):
    empty = sharding.write_shards(spark.createDataFrame([], SCHEMA), f"{tmp_path}/empty", F.lit(0))
    assert sharding.reshard(empty, 8).rows().count() == 0
    with pytest.raises(ValueError):
        sharding.write_shards(awkward_docs(spark).withColumn("__llm_size", F.lit(1)), f"{tmp_path}/x", F.lit(0))
    with pytest.raises(FileNotFoundError):
        sharding.latest_version(spark, f"{tmp_path}/nothing")


def test_unfinished_versions_do_not_count(spark, tmp_path):
    folder = f"{tmp_path}/shards"
    old = sharding.write_shards(awkward_docs(spark), folder, F.lit(0))
    (tmp_path / "shards/manifest/version=7").mkdir()
    assert sharding.latest_version(spark, folder) == 0
    assert sharding.reshard(old, 2).version == 1


def test_query(spark, tmp_path):
    awkward_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.op12_sharding(spark, str(tmp_path))
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    import zlib

    want = sorted(repr((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for i, t in awkward_texts())
    assert contents(found, ["doc_id", "size", "text_crc32"]) == want
    check_slots(found, "shard", "slot")
