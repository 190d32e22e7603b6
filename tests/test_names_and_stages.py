import math

import pytest
from pyspark.sql import functions as F

from flowbench.functions.names import canonical_name, resolve_collisions
from flowbench.operators import clean, labels, normalize, parse, schema
from flowbench.plans.variants import (
    VARIANTS,
    prepare_variant,
    run_stages,
    validate_variant,
    variant_shapes,
    variant_stages,
)

INF, NAN = math.inf, math.nan
SCHEMA = "flow_id long, source_file string, rate double, small float, flag boolean, label string"


@pytest.fixture(scope="module")
def flows(spark):
    rows = [
        (1, "Monday-a.csv", 1.0, 1.0, True, "BENIGN"),
        (2, "tuesday-b.csv", INF, 1.0, None, "BENIGN"),
        (3, "x-WEDNESDAY.csv", 2.0, -INF, False, " BENIGN\t\n"),
        (4, "Thursday.csv", 3.0, NAN, True, "DDoS"),
        (5, "Friday-monday.csv", 4.0, 1.0, True, None),
        (6, "Friday.csv", None, 1.0, True, " benign"),
        (7, "notes.csv", 5.0, 1.0, True, "BENIGN"),
        (8, "Friday.csv", 6.0, 2.0, None, "benign "),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(
    "raw, wanted",
    [
        (" Label", "label"), ("Flow Bytes/s", "flow_bytes_s"), ("Fwd Header Length.1",
        "fwd_header_length_1"), ("(A)--b  C.", "a_b_c"), ("__x__", "x"), (7, "7"), ("\tT ", "t"),
    ],
)
def test_canonical_name_is_idempotent(raw, wanted):
    assert canonical_name(raw) == wanted
    assert canonical_name(wanted) == wanted


def test_collisions_are_named_or_suffixed():
    with pytest.raises(ValueError, match="A b.*a-b"):
        resolve_collisions(["a_b", "a_b"], ["A b", "a-b"], "error")
    assert resolve_collisions(["a", "a", "a_1", "a"], list("wxyz"), "suffix") == [
        "a", "a_2", "a_1", "a_3",
    ]
    with pytest.raises(ValueError, match="on_collision"):
        resolve_collisions(["a"], ["a"], "drop")


def test_rename_handles_dots_and_is_free_when_nothing_changes(spark):
    df = spark.range(1).toDF("A.b (x)")
    assert parse.rename_columns(df).columns == ["a_b_x"]
    done = parse.rename_columns(df)
    assert parse.parse(done) is done
    assert parse.rename_raw_label(spark.range(1).toDF("LABEL ")).columns == ["label"]


def test_type_classes(flows):
    assert schema.numeric_columns(flows) == ["flow_id", "rate", "small"]
    assert schema.floating_columns(flows) == ["rate", "small"]
    numeric, categorical = schema.numeric_and_categorical(flows, ["flag", "rate", "label"])
    assert (numeric, categorical) == (["rate"], ["flag", "label"])


def test_normalize_touches_text_labels_only(flows):
    texts = {r.flow_id: r.label for r in normalize.normalize(flows).collect()}
    assert texts[6] == "BENIGN" and texts[5] is None
    assert texts[3] == "BENIGN\t\n"  # spaces only, like the built-in trim
    numbers = flows.withColumn("label", F.lit(1))
    assert normalize.normalize(numbers) is numbers
    unlabelled = flows.drop("label")
    assert normalize.normalize(unlabelled) is unlabelled


def test_clean_equals_its_three_steps_and_is_idempotent(flows):
    steps = (
        flows.transform(clean.drop_null_labels).transform(clean.nonfinite_to_null)
        .transform(clean.drop_incomplete_rows)
    )
    whole = clean.clean(flows)
    ids = sorted(r.flow_id for r in whole.collect())
    assert ids == sorted(r.flow_id for r in steps.collect()) == [1, 7, 8]
    assert clean.clean(whole).count() == 3
    assert whole.schema.simpleString() == flows.schema.simpleString()
    assert flows.filter(clean.survives_clean(flows)).count() == 3


def test_clean_plan_is_one_filter_without_a_shuffle(flows):
    plan = clean.clean(flows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter") == 1 and "Exchange" not in plan


def test_dropping_incomplete_rows_keeps_infinities(flows):
    assert 2 in {r.flow_id for r in clean.drop_incomplete_rows(flows).collect()}


def test_sanitize_keeps_rows_and_other_columns(flows):
    rows = {r.flow_id: r for r in clean.sanitize_numeric(flows, ["rate"]).collect()}
    assert len(rows) == 8 and rows[2].rate is None and rows[3].small == -INF


def test_columns_with_dots_can_be_cleaned(spark):
    df = spark.createDataFrame([(1.0,), (INF,), (None,)], "`a.b` double")
    assert clean.clean(df).count() == 1
    assert clean.nonfinite_to_null(df).filter("`a.b` is null").count() == 2


def test_binary_target(flows):
    target = {r.flow_id: r.target for r in labels.with_binary_target(flows).collect()}
    assert target == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: 0, 8: 1}
    for function in (labels.with_binary_target, labels.target_from_label, labels.drop_label):
        with pytest.raises(ValueError, match="no column 'label'"):
            function(flows.drop("label"))


def test_target_from_text_that_is_no_number_is_an_error(flows):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        labels.target_from_label(flows).collect()


def test_variants():
    assert list(VARIANTS) == ["baseline", "parse", "parse_norm", "parse_norm_clean"]
    flags = variant_stages("parse_norm")
    assert flags == {"parse": True, "normalize": True, "clean": False}
    flags["clean"] = True
    assert not variant_stages("parse_norm")["clean"]
    with pytest.raises(ValueError, match="choose one of baseline, parse, parse_norm"):
        validate_variant("all")


def test_absent_flags_are_off(flows):
    assert run_stages(flows, {}) is flows
    assert run_stages(flows, {"clean": True}).count() == 3


def test_target_first_and_stages_first(flows):
    first = {r.flow_id: r.target for r in prepare_variant(flows, "parse_norm_clean").collect()}
    assert first == {1: 0, 5: 1, 8: 1}
    second = prepare_variant(flows, "parse_norm_clean", "stages_first")
    assert {r.flow_id: r.target for r in second.collect()} == {1: 0, 8: 0}
    with pytest.raises(ValueError, match="order"):
        prepare_variant(flows, "baseline", "sideways")


@pytest.mark.parametrize("order", ["target_first", "stages_first"])
def test_shapes_agree_with_running_each_variant(flows, order):
    shapes = {(r.variant, r.split): r for r in variant_shapes(flows, order=order).collect()}
    assert len(shapes) == 12
    for (variant, part), row in shapes.items():
        prepared = prepare_variant(flows, variant, order)
        assert row.rows_after == prepared.filter(F.col("split") == part).count()
        assert row.columns_before == row.columns_after == 5
