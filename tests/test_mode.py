from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowbench.operators import mode


def plain(values):
    counts = Counter(str(v) for v in values if v is not None)
    return min(counts.items(), key=lambda item: (-item[1], item[0])) if counts else None


@pytest.fixture
def counted_in_full(monkeypatch):
    """The columns whose values were all counted."""
    seen, value_counts = [], mode.value_counts
    monkeypatch.setattr(mode, "value_counts", lambda df, columns: seen.extend(columns) or value_counts(df, columns))
    return seen


def test_candidates_settle_what_stands_out(spark, counted_in_full):
    rng = np.random.default_rng(0)
    unique = [f"u{i}" for i in range(20000)]
    for i in rng.choice(20000, 300, replace=False):
        unique[i] = "often"
    few = [None if i % 7 == 0 else "abc"[i % 3] for i in range(20000)]
    tied = ["y" if i % 2 else "x" for i in range(20000)]
    rows = spark.createDataFrame(list(zip(unique, few, tied, range(20000))), "u string, few string, `t.x` string, number int")
    found = mode.fit_modes(rows.repartition(5), ["u", "few", "t.x"])
    assert found == {"u": ("often", 300), "few": plain(few), "t.x": ("x", 10000)}
    assert counted_in_full == []


def test_columns_without_a_clear_winner_are_counted(spark, counted_in_full):
    rows = spark.range(30000).select(
        F.col("id").cast("string").alias("all_unique"),
        F.when(F.col("id") < 2, F.lit("twice")).otherwise(F.col("id").cast("string")).alias("one_twice"),
    )
    assert mode.fit_modes(rows.repartition(4), ["all_unique", "one_twice"]) == {"all_unique": ("0", 1), "one_twice": ("twice", 2)}
    assert counted_in_full == ["all_unique", "one_twice"]


def test_missing_values_and_empty_tables(spark, counted_in_full):
    rows = spark.createDataFrame([(None, 2.5, True), (None, None, False), (None, 2.5, None)], "a string, b double, c boolean")
    assert mode.fit_modes(rows, ["a", "b", "c"]) == {"b": ("2.5", 2), "c": ("false", 1)}
    assert mode.fit_modes(rows.limit(0), ["a", "b"]) == {} and mode.fit_modes(rows, []) == {}
    assert counted_in_full == []


def test_many_shapes_against_plain_counts(spark):
    rng = np.random.default_rng(1)
    columns = {
        "steep": [str(int(v)) for v in rng.zipf(1.3, 25000) % 9000],
        "flat": [str(int(v)) for v in rng.integers(0, 6000, 25000)],
        "narrow": [str(int(v)) for v in rng.integers(0, 3, 25000)],
    }
    rows = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} string" for c in columns))
    assert mode.fit_modes(rows, list(columns)) == {c: plain(v) for c, v in columns.items()}
