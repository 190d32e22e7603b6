import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from flowbench import catalog
from flowbench.operators import encoding, features, projection, wide


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(4)
    rows = 3000
    return pd.DataFrame(
        {
            "id": np.arange(rows),
            "Flow ID": [f"f{i}" for i in range(rows)],
            "size": np.where(np.arange(rows) % 11 == 0, math.inf, rng.exponential(10, rows)),
            "rate": np.where(np.arange(rows) % 13 == 0, math.nan, rng.normal(5, 3, rows)),
            "constant": 0.1,
            "empty": math.nan,
            "flag": rng.random(rows) < 0.4,
            "proto": rng.choice(["tcp", "udp", None], rows, p=[0.5, 0.4, 0.1]),
            "host": np.where(rng.random(rows) < 1 / 3, "hot", rng.integers(0, 900, rows).astype(str)),
            "target": 0, "label": "BENIGN", "split": "train", "weekday": "Monday", "score": 0.5,
        }
    )


@pytest.fixture(scope="module")
def flows(spark, table):
    return spark.createDataFrame(table).drop("id").repartition(4)


@pytest.fixture(scope="module")
def fitted(flows):
    return features.fit_features(flows)


def reference_matrix(table):
    """The prepared matrix by pandas."""
    columns = []
    for name in ("size", "rate", "constant"):
        values = table[name].replace([math.inf, -math.inf], math.nan)
        values = values.fillna(values.median())
        spread = values.std(ddof=0)
        columns.append((values - values.mean()) / (spread if spread > 1e-9 else 1.0))
    for name in ("flag", "proto", "host"):
        text = table[name].map(lambda v: str(v).lower() if isinstance(v, (bool, np.bool_)) else v)
        text = text.fillna(text.mode()[0])
        columns += [(text == value).astype(float) for value in sorted(text.unique())]
    return np.column_stack(columns)


def test_selection_leaves_out_identifiers_and_everything_made_from_the_label(flows):
    assert features.select_feature_columns(flows) == [
        "size", "rate", "constant", "empty", "flag", "proto", "host",
    ]
    with pytest.raises(ValueError, match="none is left as a feature"):
        features.select_feature_columns(flows.select("label", "Flow ID"))


def test_fitted_statistics(fitted, table):
    assert [f.name for f in fitted.numeric] == ["size", "rate", "constant"]
    assert fitted.dropped == ("empty",)
    assert fitted.numeric[2].scale == 1.0
    finite = table["size"].replace(math.inf, math.nan)
    assert fitted.numeric[0].median == pytest.approx(finite.median(), rel=1e-15)
    assert fitted.categorical[0].categories == ("false", "true")
    assert fitted.categorical[1].mode == "tcp"
    assert fitted.categorical[2].mode == "hot"


def test_mode_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "x string")
    assert features.fit_features(df).categorical[0].mode == "a"


def test_scaling_can_be_left_out(flows):
    plain = features.fit_features(flows.select("size"), scale_numeric=False).numeric[0]
    assert (plain.mean, plain.scale) == (0.0, 1.0)


def test_assembled_matrix(flows, fitted, table):
    rows = features.assemble(flows, fitted, ["Flow ID"]).collect()
    order = {f"f{i}": i for i in range(len(table))}
    wanted = reference_matrix(table)
    found = np.zeros_like(wanted)
    for row in rows:
        found[order[row["Flow ID"]]] = row["features"].toArray()
    assert fitted.width == wanted.shape[1]
    assert np.abs(found - wanted).max() < 1e-9


def test_unseen_category_is_all_zero(spark):
    fitted = features.fit_features(spark.createDataFrame([("a",), ("b",), ("b",)], "x string"))
    df = spark.createDataFrame([("z",), (None,), ("a",)], "x string")
    rows = [tuple(r.features.toArray()) for r in features.assemble(df, fitted).collect()]
    assert rows == [(0.0, 0.0), (0.0, 1.0), (1.0, 0.0)]


def test_singular_vectors_agree_with_a_dense_svd(flows, fitted, table):
    vectors = projection.truncated_svd(flows, fitted, 6).matrix
    _, _, wanted = np.linalg.svd(reference_matrix(table), full_matrices=False)
    assert np.abs(vectors - wide.fix_signs(wanted[:6].T)).max() < 1e-6


@pytest.mark.parametrize("width, wanted, count", [(10, 64, 9), (2, 64, 2), (1, 64, 1), (100, 64, 64)])
def test_component_count(width, wanted, count):
    assert wide.component_count(width, wanted) == count


def test_fourier_features_and_rotations(spark, flows, fitted, table):
    vectors = projection.truncated_svd(flows, fitted, 6)
    weights, offsets = projection.fourier_parameters(6, 32, 0.1, 42)
    frame = projection.fourier_features(flows, fitted, vectors, weights, offsets, ["Flow ID"])
    found = frame.toPandas().set_index("Flow ID").features
    found = np.stack([found[f"f{i}"] for i in range(len(table))])
    angles = reference_matrix(table) @ vectors.matrix @ weights + offsets
    assert np.abs(found - np.sqrt(2 / 32) * np.cos(angles)).max() < 1e-5
    again, _ = projection.fourier_parameters(6, 32, 0.1, 42)
    assert (again == weights).all()

    turns = projection.rotation_matrices(32, 4, 42).astype(float)
    assert (turns[0] == np.eye(32)).all()
    assert np.abs(turns @ turns.transpose(0, 2, 1) - np.eye(32)).max() < 1e-5
    assert np.linalg.det(turns) == pytest.approx(1.0, abs=1e-5)
    rotated = projection.rotate(frame, turns.astype(np.float32), ["Flow ID"])
    counts = {r.rotation: r["count"] for r in rotated.groupBy("rotation").count().collect()}
    assert counts == dict.fromkeys(range(4), len(table))
    row = rotated.filter("`Flow ID` = 'f7' and rotation = 2").first()
    assert np.abs(np.array(row.features) - found[7] @ turns[2]).max() < 1e-5


def test_svd_coordinates(flows, fitted, table):
    vectors = projection.truncated_svd(flows, fitted, 6)
    frame = projection.svd_features(flows, fitted, vectors, ["Flow ID"]).toPandas()
    found = frame.set_index("Flow ID").features
    wanted = reference_matrix(table) @ vectors.matrix
    assert np.abs(found["f12"] - wanted[12]).max() < 1e-5


def test_wide_categories_give_the_same_features(spark, flows, fitted, table):
    """Categories kept in a table: hot values listed, the others joined, unseen ones all zero."""
    in_table = features.fit_features(flows, inline_width=8)
    host = in_table.categorical[2]
    assert host.categories is None and in_table.wide == [2]
    assert "hot" in host.hot and len(host.hot) < table.host.nunique() / 2
    narrow = projection.truncated_svd(flows, fitted, 3)
    broad = projection.truncated_svd(flows, in_table, 3)
    assert np.abs(narrow.numeric(fitted) - broad.numeric(in_table)).max() < 1e-5
    unseen = flows.limit(1).selectExpr(
        "'new' as `Flow ID`", "size", "rate", "constant", "empty", "flag", "proto", "'?' as host"
    )
    rows = flows.select(unseen.columns).unionByName(unseen)
    weights, offsets = projection.fourier_parameters(3, 16, 0.1, 1)
    left, right = (
        projection.fourier_features(rows, f, v, weights, offsets, ["Flow ID"])
        .toPandas().set_index("Flow ID").features.sort_index()
        for f, v in ((fitted, narrow), (in_table, broad))
    )
    assert list(left.index) == list(right.index) and len(left) == len(table) + 1
    assert np.abs(np.stack(left) - np.stack(right)).max() < 1e-4


def test_scale_does_not_depend_on_the_number_of_rows():
    assert features.scale_for(1.7e9, 9e8) == 3e4
    assert features.scale_for(1.7e9, 1e-6) == 1.0 and features.scale_for(0.0, 0.0) == 1.0


def test_vectors_do_not_depend_on_where_categories_are(flows, fitted):
    """Coded by a dictionary or listed: the same vectors, also for values that fitting has not seen."""
    in_table = features.fit_features(flows, inline_width=8)
    assert in_table.wide == [2] and in_table.categorical[2].count == len(fitted.categorical[2].categories)
    rows = flows.withColumn("host", F.when(F.col("Flow ID") == "f7", "?").otherwise(F.col("host")))
    left, right = (
        features.assemble(rows, f, ["Flow ID"]).toPandas().set_index("Flow ID").features.sort_index()
        for f in (fitted, in_table)
    )
    assert len(left) == 3000 and left["f7"].numNonzeros() < left["f8"].numNonzeros()
    for a, b in zip(left, right):
        assert a.size == b.size and np.array_equal(a.toArray(), b.toArray())
    without = replace(in_table, dictionary=None)
    with pytest.raises(ValueError, match="host"):
        features.assemble(flows, without)


def test_dictionary_codes_are_places_in_sorted_order(spark):
    values = [("a", f"v{i * 7919 % 5000}é") for i in range(5000)] + [("b", "x"), ("b", ""), ("c", "\U0001f600"), ("c", "\uffee")]
    frame = spark.createDataFrame(values, "feature string, value string").repartition(13)
    codes = spark.read.parquet(encoding.write_dictionary(frame)).collect()
    by_feature = {}
    for feature, value in values:
        by_feature.setdefault(feature, []).append(value)
    wanted = {(f, v, k) for f, vs in by_feature.items() for k, v in enumerate(sorted(vs, key=str.encode))}
    assert {(r.feature, r.value, r.code) for r in codes} == wanted and len(codes) == len(values)
    empty = spark.read.schema(encoding.DICTIONARY).parquet(encoding.write_dictionary(frame.limit(0)))
    assert empty.count() == 0


def test_lookups_spread_what_is_hot_in_the_frame(spark):
    """One value fills most of the frame, another a fiftieth; the table knows one of them and some rare ones."""
    value = F.when(F.col("id") % 10 < 7, "flood").when(F.col("id") % 50 == 8, "known").otherwise(F.concat(F.lit("v"), F.col("id")))
    frame = spark.range(20_000, numPartitions=8).select("id", value.alias("c"))
    hot = encoding.heavy_values(frame, ["c"])["c"]
    assert hot == ["flood", "known"]
    codes = [("known", 1)] + [(f"v{i}", i) for i in range(0, 20_000, 3)]
    table = spark.createDataFrame(codes, "value string, code long")
    found = encoding.look_up(frame, "c", table, "code", hot)
    assert found.columns == ["id", "c", "code"]
    known = dict(codes)
    assert all(r.code == known.get(r.c) for r in found.collect())
    keys = frame.select(*encoding.spread_key("c", hot))
    counts = [r["count"] for r in keys.groupBy("__flow_key", "__flow_spread").count().collect()]
    assert max(counts) <= 20_000 / 8  # a partition's own rows at most, where one key had 14,000
    tasks = keys.repartition(8, "__flow_key").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    skipped = encoding.look_up(frame, "c", table, "code", hot, ["known"])
    assert skipped.filter("c = 'known' and code is not null").count() == 0
    assert len(tasks) > 1


def test_vectors_of_several_wide_features(spark, flows):
    """Two wide features, most of whose values are rare: the matrix form and the table form agree."""
    rows = flows.withColumn("path", F.concat(F.lit("p"), (F.xxhash64("Flow ID") % 150).cast("string")))
    inline, broad = features.fit_features(rows), features.fit_features(rows, inline_width=8)
    assert inline.inline and len(broad.wide) == 2
    left, right = projection.truncated_svd(rows, inline, 3), projection.truncated_svd(rows, broad, 3)
    assert np.abs(left.numeric(inline) - right.numeric(broad)).max() < 1e-6
    wanted = {
        (i, value): vector
        for i, (block, values) in enumerate(left.blocks(inline)) for value, vector in zip(values, block)
    }
    found = {
        (i, value): vector
        for i, (block, values) in enumerate(right.blocks(broad)) for value, vector in zip(values, block)
    }
    assert found
    found |= {(r.feature, r.value): np.array(r.vector) for r in spark.read.parquet(right.table).collect()}
    assert found.keys() == wanted.keys()
    assert max(np.abs(found[key] - wanted[key]).max() for key in wanted) < 1e-6


def test_no_wide_value_need_be_rare(spark):
    """Every value of the wide feature is listed: the table of other categories is empty."""
    df = spark.createDataFrame([(float(k % 7), f"v{k % 5}") for k in range(200)], "x double, c string")
    inline, broad = features.fit_features(df), features.fit_features(df, inline_width=3)
    assert broad.wide == [0] and len(broad.categorical[0].listed) == 5
    left, right = projection.truncated_svd(df, inline, 2), projection.truncated_svd(df, broad, 2)
    assert spark.read.parquet(right.table).count() == 0
    assert np.abs(left.numeric(inline) - right.numeric(broad)).max() < 1e-6


def test_one_hot_vectors_of_few_lines(spark, tmp_path):
    """The query reads a vector's own fields, so it may also be a dense one, as with few categories."""
    lines = "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_quantity double"
    rows = [(7, 1, 5, "N", 2.5), (7, 2, 5, "N", 4.0), (7, 3, 5, "N", 8.0)]
    spark.createDataFrame(rows, lines).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = catalog.one_hot_wide(spark, str(tmp_path)).orderBy("l_linenumber").collect()
    # quantity, lines 7-1 and 7-2, flag N, part p5; line 7-3 is not fitted on
    assert [tuple(r)[1:] for r in found] == [
        (1, 5, 4, 1, 3, 4, 2.5), (2, 5, 4, 2, 3, 4, 4.0), (3, 5, 3, None, 3, 4, 8.0),
    ]
