"""Every operator as a query over the given tables, and the same result as SQL where SQL can say it.

Queries take ``(spark, folder)``; the SQL runs on DuckDB over the same Parquet files. Forest queries
use a smaller forest than the defaults (fewer, shallower trees), never fewer rows; ``rf_default_run``
fits the default one.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .config import BENIGN_TARGET, LABEL, DetectorConfig
from .fixtures import flows_sql, table
from .functions.names import col
from .operators import clean, features, labels, metrics, mode, normalize, parse, projection, scoring, split
from .operators.schema import numeric_and_categorical
from .plans import report
from .plans.detector import (
    fit_detector,
    fit_statistics,
    load_detector,
    save_detector,
    transform_for,
)
from .plans.variants import VARIANTS, prepare_variant, run_stages, variant_shapes, variant_stages
from .sources import csv
from .sources.tables import new_path, write_table

Query = Callable[[SparkSession, str], DataFrame]

SMALL_FOREST = DetectorConfig(rff_components=48, rotations=4, trees=20, max_depth=8)

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            ORACLES[key] = sql
        return function

    return register


# SQL fragments --------------------------------------------------------------------------------

F_SQL = flows_sql()
DAY_SQL = """case when contains(lower(source_file), 'monday') then 'Monday'
     when contains(lower(source_file), 'tuesday') then 'Tuesday'
     when contains(lower(source_file), 'wednesday') then 'Wednesday'
     when contains(lower(source_file), 'thursday') then 'Thursday'
     when contains(lower(source_file), 'friday') then 'Friday' end"""
SPLIT_SQL = """case when weekday in ('Monday', 'Tuesday') then 'train' when weekday = 'Wednesday'
     then 'val' when weekday in ('Thursday', 'Friday') then 'test' end"""
TARGET_SQL = r"""case when regexp_replace(label, '^\s+|\s+$', '', 'g') = 'BENIGN'
     then 0 else 1 end"""
WITH_SPLIT = f"""with f as ({F_SQL}), d as (select *, {DAY_SQL} as weekday,
     cast({TARGET_SQL} as integer) as target from f), s as (select *, {SPLIT_SQL} as split from d)"""


def finite_sql(name: str) -> str:
    return f"case when isnan({name}) or isinf({name}) then null else {name} end"


def state_sql(name: str) -> str:
    return (
        f"case when {name} is null then 'null' when isnan({name}) then 'nan' "
        f"when isinf({name}) then 'inf' else 'finite' end"
    )


def state(name: str) -> Column:
    """What kind of value a float holds, in a form that every engine compares alike."""
    column = F.col(name)
    return (
        F.when(column.isNull(), "null").when(F.isnan(column), "nan")
        .when(F.abs(column) == float("inf"), "inf").otherwise("finite")
    )


def described(df: DataFrame, *kept: str) -> DataFrame:
    """Kept columns and, for both float columns of the flows, kind and finite value."""
    floats = ("flow_bytes_s", "flow_iat_mean")
    return df.select(
        *kept,
        *[state(name).alias(f"{name}_state") for name in floats],
        *[clean.finite(name, df.schema[name].dataType).alias(f"{name}_value") for name in floats],
    )


DESCRIBED_SQL = ", ".join(
    [f"{state_sql(n)} as {n}_state" for n in ("flow_bytes_s", "flow_iat_mean")]
    + [f"{finite_sql(n)} as {n}_value" for n in ("flow_bytes_s", "flow_iat_mean")]
)
COMPLETE_SQL = "not (flow_bytes_s is null or isnan(flow_bytes_s) or isinf(flow_bytes_s) or isinf(flow_iat_mean))"


def training_flows(spark: SparkSession, folder: str) -> DataFrame:
    return split.benign_part(split.split_rows(fixtures.flows(spark, folder)), "train")


# Parse, names, features -----------------------------------------------------------------------


@query(f"""select flow_id, source_file, destination_port, protocol, {state_sql('flow_bytes_s')}
    as flow_bytes_s_state, flow_iat_mean > 50 as long_gap, label from ({F_SQL})""")
def parse_columns(spark, folder):
    df = parse.rename_columns(fixtures.flows_raw(spark, folder))
    return df.select(
        "flow_id", "source_file", "destination_port", "protocol",
        state("flow_bytes_s").alias("flow_bytes_s_state"),
        (F.col("flow_iat_mean") > 50).alias("long_gap"), "label",
    )


@query("""select l_orderkey as order_key, l_linenumber as line_number, l_quantity as quantity_pcs,
    l_tax as tax, l_returnflag as label from lineitem""")
def parse_stage(spark, folder):
    df = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("Order-Key "), F.col("l_linenumber").alias("Line..Number"),
        F.col("l_quantity").alias("Quantity (pcs)"), F.col("l_tax").alias("/Tax/"),
        F.col("l_returnflag").alias(" Label"),
    )
    return df.transform(parse.rename_raw_label).transform(parse.parse)


@query(f"""{WITH_SPLIT} select destination_port, protocol, {state_sql('flow_bytes_s')} as
    flow_bytes_s, {state_sql('flow_iat_mean')} as flow_iat_mean from s where split is not null""")
def select_features(spark, folder):
    df = split.split_rows(fixtures.flows(spark, folder))
    chosen = features.select_feature_columns(df)
    return df.select(
        *[state(n).alias(n) if n.startswith("flow_") else n for n in chosen]
    )


@query(f"""with f as ({F_SQL}) select * from (
    select 'flow_id' as name, 'numeric' as kind, count(flow_id) as present from f union all
    select 'source_file', 'categorical', count(source_file) from f union all
    select 'destination_port', 'numeric', count(destination_port) from f union all
    select 'protocol', 'categorical', count(protocol) from f union all
    select 'flow_bytes_s', 'numeric', count({finite_sql('flow_bytes_s')}) from f union all
    select 'flow_iat_mean', 'numeric', count({finite_sql('flow_iat_mean')}) from f union all
    select 'label', 'categorical', count(label) from f)""")
def feature_types(spark, folder):
    df = fixtures.flows(spark, folder)
    numeric, _ = numeric_and_categorical(df, df.columns)
    counted = df.agg(
        *[F.count(clean.finite(f.name, f.dataType)).alias(f.name) for f in df.schema]
    )
    rows = [
        F.struct(
            F.lit(n).alias("name"),
            F.lit("numeric" if n in numeric else "categorical").alias("kind"),
            F.col(n).alias("present"),
        )
        for n in df.columns
    ]
    return counted.select(F.inline(F.array(*rows)))


# Normalize and clean --------------------------------------------------------------------------


@query(f"select flow_id, upper(trim(label, ' ')) as label from ({F_SQL})")
def normalize_label(spark, folder):
    return normalize.normalize(fixtures.flows(spark, folder)).select("flow_id", "label")


@query(f"select flow_id, label from ({F_SQL}) where label is not null")
def clean_null_label(spark, folder):
    return clean.drop_null_labels(fixtures.flows(spark, folder)).select("flow_id", "label")


@query(f"""select flow_id, {finite_sql('flow_bytes_s')} as flow_bytes_s,
    {finite_sql('flow_iat_mean')} as flow_iat_mean from ({F_SQL})""")
def clean_nonfinite(spark, folder):
    df = clean.nonfinite_to_null(fixtures.flows(spark, folder))
    return df.select("flow_id", "flow_bytes_s", "flow_iat_mean")


@query(f"""select flow_id, {DESCRIBED_SQL} from ({F_SQL})
    where flow_bytes_s is not null and not isnan(flow_bytes_s)""")
def clean_dropna(spark, folder):
    return described(clean.drop_incomplete_rows(fixtures.flows(spark, folder)), "flow_id")


@query(f"""select flow_id, source_file, destination_port, protocol, flow_bytes_s, flow_iat_mean,
    label from ({F_SQL}) where label is not null and {COMPLETE_SQL}""")
def clean_stage(spark, folder):
    return clean.clean(fixtures.flows(spark, folder))


@query(f"""select flow_id, destination_port, {finite_sql('flow_bytes_s')} as flow_bytes_s,
    {finite_sql('flow_iat_mean')} as flow_iat_mean from ({F_SQL})""")
def sanitize_numeric(spark, folder):
    df = fixtures.flows(spark, folder)
    chosen = features.select_feature_columns(df)
    return clean.sanitize_numeric(df, chosen).select(
        "flow_id", "destination_port", "flow_bytes_s", "flow_iat_mean"
    )


# Labels and splits ----------------------------------------------------------------------------


@query(f"select flow_id, label, cast({TARGET_SQL} as integer) as target from ({F_SQL})")
def binary_target(spark, folder):
    return labels.with_binary_target(fixtures.flows(spark, folder)).select(
        "flow_id", "label", "target"
    )


@query(f"""select flow_id, protocol, cast({TARGET_SQL} as integer) as target from ({F_SQL})""")
def target_from_label(spark, folder):
    df = labels.with_binary_target(fixtures.flows(spark, folder), LABEL)
    df = labels.drop_label(labels.target_from_label(df))
    return df.select("flow_id", "protocol", "target")


@query(f"""{WITH_SPLIT} select weekday, source_file, count(*) as rows from s
    where weekday is not null group by all""")
def weekday_groups(spark, folder):
    df = fixtures.flows(spark, folder)
    split.check_weekdays(df)
    return split.weekday_files(df)


@query(f"""{WITH_SPLIT} select flow_id, source_file from s
    where weekday in ('Monday', 'Tuesday')""")
def subset_by_source(spark, folder):
    df = fixtures.flows(spark, folder)
    chosen = split.subset_of_files(df, split.source_files_of(df, ("Monday", "Tuesday")))
    return chosen.select("flow_id", "source_file")


@query(f"""{WITH_SPLIT} select coalesce(split, 'none') as split, count(*) as rows,
    count(*) filter (where target = 0) as benign, count(*) filter (where target = 1) as attacks from s group by all""")
def split_counts(spark, folder):
    df = split.with_split(labels.with_binary_target(fixtures.flows(spark, folder)))
    return df.groupBy(F.coalesce("split", F.lit("none")).alias("split")).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("target") == 0).alias("benign"),
        F.count_if(F.col("target") == 1).alias("attacks"),
    )


@query(f"""{WITH_SPLIT} select flow_id, weekday, split from s
    where split in ('train', 'val') and target = 0""")
def benign_subset(spark, folder):
    df = split.split_rows(fixtures.flows(spark, folder))
    both = split.benign_part(df, "train").unionByName(split.benign_part(df, "val"))
    return both.select("flow_id", "weekday", "split")


# Variants -------------------------------------------------------------------------------------


def _shapes_sql(cleaned: str) -> str:
    return f"""{WITH_SPLIT}, c as (select split, count(*) as n, count(*) filter (where {cleaned}) as k from s
    where split is not null group by split) select v.variant, split, n as rows_before,
    case when v.variant = 'parse_norm_clean' then k else n end as rows_after,
    cast(6 as bigint) as columns_before, cast(6 as bigint) as columns_after
    from c, (values ('baseline'), ('parse'), ('parse_norm'), ('parse_norm_clean')) v(variant)"""


@query(_shapes_sql(COMPLETE_SQL), "variant_shapes")
def _variant_shapes(spark, folder):
    return variant_shapes(fixtures.flows(spark, folder))


@query(_shapes_sql(f"label is not null and {COMPLETE_SQL}"), "variant_shapes_stages_first")
def _variant_shapes_stages_first(spark, folder):
    return variant_shapes(fixtures.flows(spark, folder), order="stages_first")


def _variant_query(name: str, order: str) -> Query:
    def run(spark, folder):
        df = prepare_variant(fixtures.flows(spark, folder), name, order)
        return described(df, "flow_id", "split", "target", df[LABEL].cast("string").alias(LABEL))

    return run


for _name, _stages in VARIANTS.items():
    _where = COMPLETE_SQL if "clean" in _stages else "true"
    query(
        f"""{WITH_SPLIT} select flow_id, split, target, cast(target as varchar) as label,
        {DESCRIBED_SQL} from s where split is not null and {_where}""",
        f"variant_pipeline_{_name}",
    )(_variant_query(_name, "target_first"))

query(
    f"""{WITH_SPLIT}, n as (select * replace (upper(trim(label, ' ')) as label) from s),
    t as (select * replace (cast({TARGET_SQL} as integer) as target) from n)
    select flow_id, split, target, label, {DESCRIBED_SQL} from t where split is not null
    and label is not null and {COMPLETE_SQL}""",
    "variant_pipeline_stages_first",
)(_variant_query("parse_norm_clean", "stages_first"))


@query(f"""select flow_id, upper(trim(label, ' ')) as label, flow_bytes_s from ({F_SQL})
    where label is not null and {COMPLETE_SQL}""")
def run_stages_raw(spark, folder):
    df = run_stages(fixtures.flows_raw(spark, folder), variant_stages("parse_norm_clean"))
    return df.select("flow_id", "label", "flow_bytes_s")


# Fitted features ------------------------------------------------------------------------------

TRAIN_SQL = f"{WITH_SPLIT}, t as (select * from s where split = 'train' and target = 0)"
NUMERIC = ("destination_port", "flow_bytes_s", "flow_iat_mean")


def _median_sql(name: str) -> str:
    value = name if name == "destination_port" else finite_sql(name)
    return f"median(cast({value} as double)) as {name}"


IMPUTED_SQL = f"""{TRAIN_SQL}, m as (select {', '.join(_median_sql(n) for n in NUMERIC)} from t),
    i as (select s.flow_id, s.protocol, s.split, s.target,
    cast(s.destination_port as double) as destination_port,
    coalesce({finite_sql('s.flow_bytes_s')}, m.flow_bytes_s) as flow_bytes_s,
    coalesce({finite_sql('s.flow_iat_mean')}, m.flow_iat_mean) as flow_iat_mean from s, m)"""
SCALED_SQL = f"""{IMPUTED_SQL}, p as (select
    {', '.join(f'avg({n}) as a_{n}, stddev_pop({n}) as d_{n}' for n in NUMERIC)}
    from i where split = 'train' and target = 0)"""


def _scaled_sql(name: str, output: str | None = None) -> str:
    return f"round(({name} - a_{name}) / d_{name}, 6) as {output or name}"


@query(f"""{IMPUTED_SQL} select flow_id, destination_port, round(flow_bytes_s, 6) as flow_bytes_s,
    round(flow_iat_mean, 6) as flow_iat_mean from i""")
def impute_median(spark, folder):
    fitted = features.fit_features(training_flows(spark, folder))
    medians = {f.name: f.median for f in fitted.numeric}
    df = features.impute_numeric(fixtures.flows(spark, folder), medians)
    return df.select(
        "flow_id", "destination_port", F.round("flow_bytes_s", 6).alias("flow_bytes_s"),
        F.round("flow_iat_mean", 6).alias("flow_iat_mean"),
    )


@query("""select median(l_quantity) as l_quantity, median(l_extendedprice) as l_extendedprice,
    median(l_discount) as l_discount, median(l_tax) as l_tax, median(l_linenumber) as l_linenumber
    from lineitem""")
def lineitem_medians(spark, folder):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    df = table(spark, folder, "lineitem").select(*names)
    fitted = features.fit_features(df)
    return df.limit(0).agg(*[F.lit(f.median).alias(f.name) for f in fitted.numeric])


@query(f"""{SCALED_SQL} select flow_id, {', '.join(_scaled_sql(n) for n in NUMERIC)} from i, p""")
def standard_scale(spark, folder):
    fitted = features.fit_features(training_flows(spark, folder))
    df = fixtures.flows(spark, folder)
    return df.select(
        "flow_id", *[F.round(features.scaled(df, f), 6).alias(f.name) for f in fitted.numeric]
    )


@query(f"""with f as ({F_SQL}), m as (select label as fill from f where label is not null
    group by label order by count(*) desc, label limit 1)
    select flow_id, coalesce(label, fill) as traffic_class from f, m""")
def impute_mode(spark, folder):
    df = fixtures.flows(spark, folder).withColumnRenamed("label", "traffic_class")
    fitted = features.fit_features(df.select("traffic_class"))
    modes = {f.name: f.mode for f in fitted.categorical}
    return features.impute_category(df, modes).select("flow_id", "traffic_class")


MODE_COLUMNS = ("l_returnflag", "l_partkey", "l_orderkey", "l_linenumber")
MODE_COUNTS = " union all ".join(
    f"select '{c}' as feature, cast({c} as varchar) as mode, count(*) as rows from lineitem where {c} is not null group by 2"
    for c in MODE_COLUMNS
)


@query(f"""select feature, mode, rows from ({MODE_COUNTS})
    qualify row_number() over (partition by feature order by rows desc, mode) = 1""")
def lineitem_modes(spark, folder):
    """Modes of a column with few values, of keys that stand out a little, and of keys that hardly repeat."""
    lines = table(spark, folder, "lineitem")
    found = mode.fit_modes(lines, list(MODE_COLUMNS))
    rows = [F.struct(F.lit(c).alias("feature"), F.lit(v).alias("mode"), F.lit(n).cast("bigint").alias("rows"))
            for c, (v, n) in found.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


ONE_HOT_SQL = """cast(case when protocol = 'click' then 1 else 0 end as double) as protocol_click,
    cast(case when protocol = 'purchase' then 1 else 0 end as double) as protocol_purchase,
    cast(case when protocol = 'view' then 1 else 0 end as double) as protocol_view"""


def _vector_columns(df: DataFrame, fitted: features.FittedFeatures) -> list[Column]:
    """One rounded column per position of the assembled vector."""
    names = [f.name for f in fitted.numeric] + [
        f"{f.name}_{value}" for f in fitted.categorical for value in f.categories
    ]
    return [F.round(F.col("v")[i], 6).alias(name) for i, name in enumerate(names)]


@query(f"select flow_id, {ONE_HOT_SQL} from ({F_SQL})")
def one_hot(spark, folder):
    """Fitted on benign training flows: protocols that only attacks use become all zeros."""
    fitted = features.fit_features(training_flows(spark, folder).select("protocol"))
    df = features.assemble(fixtures.flows(spark, folder), fitted, ["flow_id"])
    df = df.select("flow_id", vector_to_array("features").alias("v"))
    return df.select("flow_id", *_vector_columns(df, fitted))


@query(f"""{SCALED_SQL} select flow_id, {', '.join(_scaled_sql(n) for n in NUMERIC)},
    {ONE_HOT_SQL} from i, p""")
def column_transformer(spark, folder):
    fitted = features.fit_features(training_flows(spark, folder))
    df = features.assemble(fixtures.flows(spark, folder), fitted, ["flow_id"])
    df = df.select("flow_id", vector_to_array("features").alias("v"))
    return df.select("flow_id", *_vector_columns(df, fitted))


WIDE_SQL = """w as (select l_orderkey, l_linenumber, l_orderkey || '-' || l_linenumber as line, l_returnflag as mode,
    'p' || l_partkey as part, l_quantity as quantity from lineitem),
    d as (select 'line' as feature, line as value from w where l_linenumber <> 3 group by all
          union all select 'part', part from w where l_linenumber <> 3 group by all
          union all select 'mode', mode from w where l_linenumber <> 3 group by all),
    c as (select *, row_number() over (partition by feature order by value) - 1 as code,
          count(*) over (partition by feature) as n from d)"""


@query(f"""with {WIDE_SQL}, s as (select max(n) filter (where feature = 'line') as lines,
    max(n) filter (where feature = 'mode') as modes, max(n) filter (where feature = 'part') as parts from c)
    select l_orderkey, l_linenumber, cast(1 + lines + modes + parts as int) as width,
    1 + (x.code is not null)::bigint + (y.code is not null)::bigint + (z.code is not null)::bigint as cells,
    1 + x.code as line_place, 1 + lines + y.code as mode_place, 1 + lines + modes + z.code as part_place,
    round(quantity, 4) as first_value
    from w cross join s left join c x on x.feature = 'line' and x.value = w.line
    left join c y on y.feature = 'mode' and y.value = w.mode left join c z on z.feature = 'part' and z.value = w.part""")
def one_hot_wide(spark, folder):
    """One-hot vectors over as many categories as there are lines; lines numbered 3 are not fitted on."""
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"),
        F.col("l_returnflag").alias("mode"), F.concat(F.lit("p"), F.col("l_partkey")).alias("part"),
        F.col("l_quantity").alias("quantity"),
    )
    train = rows.filter("l_linenumber <> 3").select("quantity", "line", "mode", "part")
    fitted = features.fit_features(train, scale_numeric=False, inline_width=100)
    vectors = features.assemble(rows, fitted, ["l_orderkey", "l_linenumber"])
    lines, modes, parts = (f.count or len(f.categories) for f in fitted.categorical)
    # The vector's own fields; one of few places may be dense, which has neither size nor indices.
    vector = F.unwrap_udt("features")
    values = vector["values"]
    size = F.coalesce(vector["size"], F.size(values))
    filled = F.filter(F.sequence(F.lit(0), F.size(values) - 1), lambda i: F.get(values, i) != 0)
    places = F.coalesce(vector["indices"], filled)
    slots = [F.get(places, F.lit(i)) for i in range(len(fitted.names))]

    def within(low: int, high: int) -> Column:
        return F.coalesce(*[F.when((slot >= low) & (slot < high), slot) for slot in slots]).cast("long")

    return vectors.select(
        "l_orderkey", "l_linenumber", size.alias("width"), F.size(places).cast("long").alias("cells"),
        within(1, 1 + lines).alias("line_place"), within(1 + lines, 1 + lines + modes).alias("mode_place"),
        within(1 + lines + modes, 1 + lines + modes + parts).alias("part_place"),
        F.round(F.get(values, F.lit(0)), 4).alias("first_value"),
    )


# Scores, thresholds, metrics ------------------------------------------------------------------

SCORES_SQL = """select event_id, case when event_type = 'error' then 1 else 0 end as target,
    round(value, 1) as score from events"""
PROBABILITY = "case when value > 100 then 0 else 1 - value / cast(100 as double) end"


@query(f"""select event_id, round(-ln(greatest(least({PROBABILITY}, 1), 1e-12)), 6) + 0.0 as score
    from events""")
def anomaly_score(spark, folder):
    df = table(spark, folder, "events").selectExpr("event_id", f"{PROBABILITY} as p")
    return df.select("event_id", F.round(scoring.anomaly_score(F.col("p")), 6).alias("score"))


@query("""select round(quantile_cont(l_extendedprice, 0.97), 6) as threshold from lineitem""")
def quantile_threshold(spark, folder):
    df = table(spark, folder, "lineitem").select(F.col("l_extendedprice").alias("score"))
    threshold = scoring.derived_threshold(df, 0.97)
    return df.limit(0).agg(F.round(F.lit(threshold), 6).alias("threshold"))


@query("""select round(quantile_cont(value, 0.97), 6) as derived_threshold,
    cast(0.8042 as double) as threshold, count(*) filter (where value > 0.8042) as flagged from events""")
def calibrated_threshold(spark, folder):
    df = table(spark, folder, "events").select(F.col("value").alias("score"))
    derived = scoring.derived_threshold(df, 0.97)
    threshold = scoring.choose_threshold(derived, DetectorConfig().calibrated_threshold, True)
    return scoring.flag_anomalies(df, threshold).agg(
        F.round(F.lit(derived), 6).alias("derived_threshold"), F.lit(threshold).alias("threshold"),
        F.sum("prediction").alias("flagged"),
    )


@query(f"""with x as ({SCORES_SQL}), t as (select quantile_cont(score, 0.97) as t from x
    where target = 0) select event_id, target, cast(score > t as integer) as prediction from x, t""")
def flag_anomalies(spark, folder):
    df = fixtures.scores(spark, folder)
    threshold = scoring.derived_threshold(df.filter(F.col("target") == BENIGN_TARGET), 0.97)
    return scoring.flag_anomalies(df, threshold).select("event_id", "target", "prediction")


COUNTS_SQL = f"""with x as ({SCORES_SQL}), c as (select
    count(*) filter (where target = 0 and score <= 20) as tn, count(*) filter (where target = 0 and score > 20) as fp,
    count(*) filter (where target = 1 and score <= 20) as fn, count(*) filter (where target = 1 and score > 20) as tp from x)"""
RATES_SQL = """round((tn + tp) / (tn + fp + fn + tp), 6) as accuracy,
    round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision,
    round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall,
    round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1, tn, fp, fn, tp"""
RANKING_SQL = """g as (select score, sum(target) as p, sum(1 - target) as n from x group by score),
    t as (select sum(p) as all_p, sum(n) as all_n from g),
    w as (select *, sum(p) over (order by score desc) as tp_at, sum(p + n) over
    (order by score desc) as at_or_above, sum(n) over (order by score) - n as n_below from g),
    r as (select round(sum(p * (n_below + n / cast(2 as double))) / any_value(all_p * all_n), 6)
    as roc_auc, round(sum(p * tp_at / at_or_above) / any_value(all_p), 6) as pr_auc from w, t)"""


def _flagged_scores(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.flag_anomalies(fixtures.scores(spark, folder), 20.0)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


@query(f"{COUNTS_SQL} select * from c")
def confusion(spark, folder):
    return metrics.confusion(_flagged_scores(spark, folder))


@query(f"{COUNTS_SQL} select {RATES_SQL} from c")
def classification_metrics(spark, folder):
    record = metrics.rates(metrics.confusion(_flagged_scores(spark, folder)))
    return _rounded(record, "accuracy", "precision", "recall", "f1")


@query(f"with x as ({SCORES_SQL}), {RANKING_SQL} select roc_auc from r")
def roc_auc(spark, folder):
    df = metrics.ranking_metrics(fixtures.scores(spark, folder))
    return _rounded(df, "roc_auc").select("roc_auc")


@query(f"with x as ({SCORES_SQL}), {RANKING_SQL} select pr_auc from r")
def average_precision(spark, folder):
    df = metrics.ranking_metrics(fixtures.scores(spark, folder))
    return _rounded(df, "pr_auc").select("pr_auc")


@query(f"{COUNTS_SQL}, {RANKING_SQL} select {RATES_SQL}, roc_auc, pr_auc from c, r")
def metrics_record(spark, folder):
    record = metrics.metrics_record(_flagged_scores(spark, folder), score="score")
    return _rounded(record, "accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")


@query("""with x as (select l_extendedprice as score, case when l_returnflag = 'R' then 1 else 0 end
    as target from lineitem), """ + RANKING_SQL + " select roc_auc, pr_auc from r")
def ranking_metrics_lineitem(spark, folder):
    df = table(spark, folder, "lineitem").selectExpr(
        "l_extendedprice as score", "case when l_returnflag = 'R' then 1 else 0 end as target"
    )
    return _rounded(metrics.ranking_metrics(df), "roc_auc", "pr_auc")


# Sources --------------------------------------------------------------------------------------


@query("""select c_custkey as id, c_name as name, c_acctbal as balance, c_mktsegment as segment,
    cast(null as varchar) as nation from customer union all
    select s_suppkey, s_name, s_acctbal, null, cast(s_nationkey as varchar) from supplier""")
def union_by_name(spark, folder):
    customers = table(spark, folder, "customer").selectExpr(
        "c_custkey as id", "c_name as name", "c_acctbal as balance", "c_mktsegment as segment"
    )
    suppliers = table(spark, folder, "supplier").selectExpr(
        "cast(s_nationkey as string) as nation", "s_suppkey as id", "s_name as name", "s_acctbal as balance"
    )
    return csv.union_by_name([customers, suppliers])


@query("""select cast(l_orderkey as varchar) as l_orderkey, cast(l_linenumber as varchar) as
    l_linenumber, l_returnflag, l_linestatus, true as has_source_file from lineitem""")
def csv_scan(spark, folder):
    """Lineitems written as CSV files and read back as text cells, tagged with their file."""
    path = new_path(spark, "csv")
    columns = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"]
    table(spark, folder, "lineitem").select(*columns).write.option("header", True).csv(path)
    return csv.load_text(spark, path).select(
        *columns, F.col("source_file").rlike(r"^part-.*\.csv$").alias("has_source_file")
    )


@query("""select doc_id, lang, md5(nullif(text, '')) as text_md5,
    length(nullif(text, '')) as characters from documents""")
def csv_encoding(spark, folder):
    """Documents written half as UTF-8 files and, where the text allows, half as latin1 files.

    Their texts have line breaks, and come back with default arguments. CSV writes an empty text as it
    writes none.
    """
    path = new_path(spark, "csv")
    documents = table(spark, folder, "documents").select("doc_id", "lang", "text")
    latin = F.col("text").rlike(r"(?s)^[\x00-\xFF]*$") & (F.col("doc_id") % 2 == 0)
    for rows, encoding in ((latin, "ISO-8859-1"), (~latin, "UTF-8")):
        (
            documents.filter(rows).write.mode("append")
            .options(header=True, encoding=encoding, escape='"', ignoreLeadingWhiteSpace=False,
                     ignoreTrailingWhiteSpace=False)
            .csv(path)
        )
    df = csv.load_text(spark, path)
    text = F.nullif("text", F.lit(""))
    return df.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "lang", F.md5(text).alias("text_md5"),
        F.length(text).cast("bigint").alias("characters"),
    )


@query("""select count(*) as files_rows, true as refused, count(distinct source) as sources
    from documents""")
def empty_folder(spark, folder):
    """A folder without CSV files is refused; the same rows written as CSV are found."""
    path = new_path(spark, "csv")
    table(spark, folder, "documents").select("doc_id", "source").write.option("header", True).csv(path)
    try:
        csv.load_text(spark, path, pattern="*.tsv")
        refused = False
    except FileNotFoundError:
        refused = True
    return csv.load_text(spark, path).agg(
        F.count("*").alias("files_rows"), F.lit(refused).alias("refused"),
        F.countDistinct("source").alias("sources"),
    )


@query(f"""select flow_id, destination_port, protocol, {DESCRIBED_SQL.replace("'nan'", "'null'")},
    label, flow_id % 2 = 0 as even, cast(flow_id as varchar) || 'd' as code from ({F_SQL})""")
def csv_types(spark, folder):
    """Flows written with the number spellings of capture tools; types found again from text."""
    path = new_path(spark, "csv")
    number = F.col("flow_bytes_s")
    spelled = (
        F.when(number.isNull(), "NA").when(F.isnan(number), "NaN")
        .when(number == float("inf"), F.when(F.col("flow_id") % 2 == 0, "inf").otherwise("Infinity"))
        .otherwise(number.cast("string"))
    )
    df = fixtures.flows(spark, folder).select(
        F.col("flow_id").alias("Flow ID"), F.col("destination_port").alias(" Destination Port"),
        F.col("protocol").alias("Protocol"), spelled.alias("Flow Bytes/s"),
        F.col("flow_iat_mean").alias("Flow IAT Mean"), F.col("label").alias(" Label"),
        F.when(F.col("flow_id") % 2 == 0, "True").otherwise("False").alias("Even"),
        F.concat(F.col("flow_id").cast("string"), F.lit("d")).alias("Code"),
    )
    df.write.options(
        header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return described(
        csv.load_raw_data(spark, path),
        "flow_id", "destination_port", "protocol", "label", "even", "code",
    )


# Projections and the detector -----------------------------------------------------------------


ENERGY_SQL = " + ".join(f"power(({n} - a_{n}) / d_{n}, 2)" for n in NUMERIC)


@query("""select page_id, url, length(html) as characters, md5(html) as digest, coalesce(page_id % 3 = 0, false) as third
    from (select page_id, nullif(url, '') as url, nullif(html, '') as html from pages)""")
def csv_quoted(spark, folder):
    """Whole web pages as cells: quotes, commas and line breaks inside quotes, read in parallel ranges."""
    path = new_path(spark, "csv")
    pages = table(spark, folder, "pages").select(
        F.col("page_id").alias("Page ID"), F.col("url").alias(" URL"), F.col("html").alias("HTML"),
        (F.col("page_id") % 3 == 0).cast("string").alias("Third"),
    )
    pages.write.options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    read = csv.load_raw_data(spark, path)
    return read.select(
        "page_id", "url", F.length("html").cast("long").alias("characters"), F.md5(F.encode("html", "UTF-8")).alias("digest"), "third",
    )


@query(f"""{SCALED_SQL} select count(*) as rows, true as orthogonal, true as falling,
    true as captured, round(sum({ENERGY_SQL} + 1), 3) as energy from i, p where split = 'train' and target = 0""")
def svd_features(spark, folder):
    """Benign training flows projected on their singular vectors.

    Coordinates are orthogonal and their energy falls from one to the next. The vectors leave out the
    weakest of all directions, so their energy is at most that of the scaled numbers and of one category
    a row, and short of it by at most an equal share of one direction.
    """
    train = training_flows(spark, folder)
    fitted = features.fit_features(train)
    vectors = projection.truncated_svd(train, fitted, 64)
    return _coordinate_facts(projection.svd_features(train, fitted, vectors), vectors.count, _energy(train, fitted))


def _energy(train: DataFrame, fitted: features.FittedFeatures) -> float:
    numbers = features.FittedFeatures(fitted.numeric, (), ())
    squares = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda total, v: total + v * v)
    return features.assemble(train, numbers).agg(F.sum(squares + F.lit(len(fitted.categorical)))).first()[0]


def _coordinate_facts(projected: DataFrame, count: int, total: float) -> DataFrame:
    x = lambda i: F.col("features")[i].cast("double")
    sums = projected.agg(
        F.count("*").alias("rows"),
        *[F.sum(x(i) * x(j)).alias(f"g{i}_{j}") for i in range(count) for j in range(i, count)],
    )
    energy = [F.col(f"g{i}_{i}") for i in range(count)]
    apart = [
        F.abs(F.col(f"g{i}_{j}")) <= 1e-4 * F.sqrt(energy[i] * energy[j]) + 1e-6 * energy[0]
        for i in range(count) for j in range(i + 1, count)
    ]
    falls = [energy[i] >= energy[i + 1] * (1 - 1e-6) for i in range(count - 1)]
    both = lambda conditions: reduce(Column.__and__, conditions, F.lit(True))
    return sums.select(
        "rows", both(apart).alias("orthogonal"), both(falls).alias("falling"),
        reduce(Column.__add__, energy).between(total * count / (count + 1), total * (1 + 1e-6)).alias("captured"),
        F.round(F.lit(total), 3).alias("energy"),
    )


@query(f"""{SCALED_SQL} select count(*) as rows, true as orthogonal, true as falling,
    true as captured, round(sum({ENERGY_SQL} + 1), 3) as energy from i, p where split = 'train' and target = 0""")
def svd_features_wide(spark, folder):
    """The same when categories do not fit on the driver: they stay in tables."""
    train = training_flows(spark, folder)
    fitted = features.fit_features(train, inline_width=len(NUMERIC))
    vectors = projection.truncated_svd(train, fitted, 64)
    return _coordinate_facts(projection.svd_features(train, fitted, vectors), vectors.count, _energy(train, fitted))


#: Given weights (numeric features x outputs) and offsets of the Fourier map.
GIVEN_WEIGHTS = ((0.25, -0.5, 0.125), (-0.75, 0.3, 0.2), (0.4, 0.1, -0.6))
GIVEN_OFFSETS = (0.5, 1.5, 2.5)


def _fourier_sql(j: int) -> str:
    angle = " + ".join(
        f"({n} - a_{n}) / d_{n} * cast({GIVEN_WEIGHTS[i][j]} as double)" for i, n in enumerate(NUMERIC)
    )
    # features are 32-bit floats: round those, as a value beside a rounding edge may fall on it
    value = f"cast(sqrt(2 / cast(3 as double)) * cos({angle} + {GIVEN_OFFSETS[j]}) as real)"
    return f"round(cast({value} as double), 4) + 0.0 as f{j}"


@query(f"{SCALED_SQL} select flow_id, {', '.join(map(_fourier_sql, range(3)))} from i, p")
def rff_features(spark, folder):
    """Fourier features of the scaled numeric features, with given weights instead of drawn ones."""
    train = training_flows(spark, folder).select(*NUMERIC)
    fitted = features.fit_features(train)
    itself = projection.SingularVectors(np.eye(len(NUMERIC)))
    mapped = projection.fourier_features(
        fixtures.flows(spark, folder), fitted, itself, np.array(GIVEN_WEIGHTS),
        np.array(GIVEN_OFFSETS), ["flow_id"],
    )
    return mapped.select(
        "flow_id", *[(F.round(F.col("features")[j].cast("double"), 4) + 0.0).alias(f"f{j}") for j in range(3)]
    )


def _chain(train: DataFrame):
    return transform_for(fit_statistics(train, SMALL_FOREST), SMALL_FOREST, 42)


@query(f"""{TRAIN_SQL} select cast(r as integer) as rotation, count(*) as rows
    from t, range(4) r(r) group by r""")
def rotation_expand(spark, folder):
    train = training_flows(spark, folder)
    chain = _chain(train)
    rotations = projection.rotation_matrices(48, 4, 42)
    rotated = projection.rotate(chain.apply(train), rotations)
    return rotated.groupBy("rotation").agg(F.count("*").alias("rows"))


@query(f"""{TRAIN_SQL} select cast(r as integer) as rotation, count(*) as rows, count(*) as same_length,
    count(*) filter (where r > 0) as turned from t, range(4) r(r) group by r""")
def rotation_values(spark, folder):
    """A rotation keeps every row's length; the first changes nothing, the others every row."""
    train = training_flows(spark, folder)
    plain = write_table(_chain(train).apply(train, ["flow_id"]), "plain").withColumnRenamed("features", "before")
    rotations = projection.rotation_matrices(48, 4, 42)
    after = projection.rotate(plain.withColumn("features", F.col("before")), rotations, ["flow_id", "before"])
    squares = lambda c: F.aggregate(c, F.lit(0.0), lambda total, x: total + x * x)
    moved = F.exists(F.zip_with("before", "features", lambda a, b: F.abs(a - b) > 1e-6), lambda far: far)
    return after.groupBy("rotation").agg(
        F.count("*").alias("rows"),
        F.count_if(F.abs(squares("before") - squares("features")) < 1e-4).alias("same_length"),
        F.count_if(moved).alias("turned"),
    )


def _prepared(spark: SparkSession, folder: str) -> DataFrame:
    flows = split.store_split(fixtures.flows(spark, folder))
    return prepare_variant(flows, "parse_norm_clean")


def _fitted(prepared: DataFrame):
    return fit_detector(split.benign_part(prepared, "train"), config=SMALL_FOREST)


@query(f"""{WITH_SPLIT} select target, count(*) as rows, count(*) as usable, count(*) as consistent,
    true as threshold_is_quantile from s where split = 'test' and {COMPLETE_SQL} group by target""")
def rf_anomaly_scores(spark, folder):
    """Scores of all clean test flows, flags that follow from them, and a threshold that is the quantile
    of the benign training flows' own scores."""
    prepared = _prepared(spark, folder)
    train = split.benign_part(prepared, "train")
    fitted = _fitted(prepared)
    below = fitted.score(train).agg(
        (F.count_if(F.col("score") <= fitted.threshold) / F.count("*")).alias("share"), F.count("*").alias("n")
    ).first()
    held = abs(below["share"] - fitted.config.threshold_quantile) <= 0.01 + 1 / below["n"]
    flagged = fitted.predict(split.part(prepared, "test"), ["flow_id", "target"])
    return flagged.groupBy("target").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("score").between(0.0, 28.0)).alias("usable"),
        F.count_if((F.col("prediction") == 1) == (F.col("score") > fitted.threshold)).alias("consistent"),
        F.lit(bool(held)).alias("threshold_is_quantile"),
    )


@query(f"""{WITH_SPLIT} select target, count(*) as rows, count(*) as scored from s
    where split = 'test' and {COMPLETE_SQL} group by target""")
def rf_scored_counts(spark, folder):
    """Every clean test flow gets exactly one usable score."""
    prepared = _prepared(spark, folder)
    scored = _fitted(prepared).score(split.part(prepared, "test"), ["target"])
    usable = F.col("score").between(0.0, 28.0)  # -ln of the probability floor is 27.6
    return scored.groupBy("target").agg(
        F.count("*").alias("rows"), F.count_if(usable).alias("scored")
    )


@query(f"""{WITH_SPLIT} select count(*) as rows, cast(0 as bigint) as different from s
    where split = 'test' and {COMPLETE_SQL}""")
def model_roundtrip(spark, folder):
    """A saved and reloaded detector gives every test flow the same score."""
    prepared = _prepared(spark, folder)
    detector = _fitted(prepared)
    reloaded = load_detector(spark, save_detector(detector, new_path(spark, "model")))
    test = split.part(prepared, "test")
    first = write_table(detector.score(test, ["flow_id"]), "first")
    second = reloaded.score(test, ["flow_id"]).withColumnRenamed("score", "again")
    return first.join(second, "flow_id").agg(
        F.count("*").alias("rows"),
        F.count_if(F.abs(F.col("score") - F.col("again")) > 1e-9).alias("different"),
    )


def _record_facts(records: DataFrame) -> DataFrame:
    """Of each run's record, what follows from the rows alone."""
    shapes = [f"{part}_rows_{when}" for part in ("train", "val", "test") for when in ("before", "after")]
    return records.select(
        "variant", F.col("seed").cast("int").alias("seed"), *[F.col(s).cast("bigint").alias(s) for s in shapes],
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).cast("bigint").alias("counted"),
        F.col("roc_auc").between(0, 1).alias("has_auc"),
        F.col("model_path").endswith(F.concat("variant", F.lit("_seed"), F.col("seed").cast("string"))).alias("has_model"),
    )


def _records_sql(variants: str, seeds: str) -> str:
    def kept(part: str) -> str:
        return f"count(*) filter (where split = '{part}' and (v.variant <> 'parse_norm_clean' or {COMPLETE_SQL}))"

    shapes = ", ".join(
        f"count(*) filter (where split = '{part}') as {part}_rows_before, {kept(part)} as {part}_rows_after"
        for part in ("train", "val", "test")
    )
    return f"""{WITH_SPLIT} select v.variant, cast(z.seed as integer) as seed, {shapes},
        {kept("test")} as counted, true as has_auc, true as has_model
        from s, (values {variants}) v(variant), (values {seeds}) z(seed) group by all"""


@query(_records_sql("('baseline')", "(42)"))
def rf_anomaly_run(spark, folder):
    return _record_facts(report.run_variant(fixtures.flows(spark, folder), "baseline", config=SMALL_FOREST))


@query(_records_sql("('parse_norm_clean')", "(42)"))
def rf_default_run(spark, folder):
    """One run with the default configuration: 200 trees of depth 20 on 192 features and 8 rotations."""
    return _record_facts(report.run_variant(fixtures.flows(spark, folder), "parse_norm_clean"))


@query(_records_sql("('baseline'), ('parse'), ('parse_norm'), ('parse_norm_clean')", "(42), (7)"))
def run_summary(spark, folder):
    """The full sweep: every variant with two seeds, one record each."""
    return _record_facts(report.run_sweep(
        fixtures.flows(spark, folder), tuple(VARIANTS), (42, 7), SMALL_FOREST,
        output=new_path(spark, "runs"), model_folder=new_path(spark, "models"), concurrent=4,
    ))


@query("""select 'baseline' as variant, 42 as seed, true as trained, true as validated, true as tested,
    true as within""")
def run_timings(spark, folder):
    """The three times of a run's record are there and add up to no more than the run took."""
    start = time.perf_counter()
    record = report.run_variant(fixtures.flows(spark, folder), "baseline", config=SMALL_FOREST)
    took = time.perf_counter() - start
    times = ("training_time", "validation_scoring_time", "test_scoring_time")
    positive = [(F.col(name) > 0).alias(fact) for name, fact in zip(times, ("trained", "validated", "tested"))]
    total = reduce(lambda a, b: a + b, map(F.col, times))
    return record.select("variant", F.col("seed").cast("int").alias("seed"), *positive, (total <= took).alias("within"))


# Flagship -------------------------------------------------------------------------------------


@query(f"""{WITH_SPLIT} select split, count(*) as rows, count(*) filter (where target = 0) as benign,
    count(*) filter (where target = 1) as attacks, round(avg(flow_bytes_s), 6) as mean_flow_bytes_s from s
    where split is not null and {COMPLETE_SQL} group by split""")
def cleaned_split_summary(spark, folder):
    """What does cleaning leave in each part of the split?"""
    df = prepare_variant(fixtures.flows(spark, folder), "parse_norm_clean")
    return df.groupBy("split").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("target") == 0).alias("benign"),
        F.count_if(F.col("target") == 1).alias("attacks"),
        F.round(F.avg("flow_bytes_s"), 6).alias("mean_flow_bytes_s"),
    )
