"""Binary-classification metrics as one-row frames, exact at any scale.

Ranking metrics need running counts over the ordered distinct scores. A window over all of them would
run in one task, so scores are cut into ranges by a sketch (boundaries are few and only balance the
work), counted per range first, and then each range runs its own window on top of the counts of the
ranges above it. Rows that share a score are combined before any shuffle, so a score that a third of
all rows share is one row of one range.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantile import MERGE_GROUPS

ROWS_PER_RANGE = 250_000
MAX_RANGES = 4096
RANGE_SKETCH_SIZE = 16_384


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def _confusion_counts(target: str, prediction: str) -> dict[str, Column]:
    truth, flag = F.col(target), F.col(prediction)
    return {
        "tn": _count((truth == 0) & (flag == 0)),
        "fp": _count((truth == 0) & (flag == 1)),
        "fn": _count((truth == 1) & (flag == 0)),
        "tp": _count((truth == 1) & (flag == 1)),
    }


def _rates() -> list[Column]:
    """Rates from columns tn, fp, fn, tp; 0 where a division has no rows."""

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))

    tn, fp, fn, tp = (F.col(name) for name in ("tn", "fp", "fn", "tp"))
    return [
        ratio(tn + tp, tn + fp + fn + tp).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        tn, fp, fn, tp,
    ]


def confusion(df: DataFrame, target: str = "target", prediction: str = "prediction") -> DataFrame:
    """tn, fp, fn, tp over classes 0 and 1."""
    counts = _confusion_counts(target, prediction)
    return df.agg(*[count.alias(name) for name, count in counts.items()])


def rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 beside the confusion counts."""
    return counts.select(*_rates())


def score_boundaries(
    df: DataFrame, score: str = "score", rows_per_range: int = ROWS_PER_RANGE
) -> list[float]:
    """Ascending boundaries, from -inf to inf, of ranges with about equally many rows."""
    sketch = F.kll_sketch_agg_double(F.col(score).cast("double"), F.lit(RANGE_SKETCH_SIZE))
    row = (
        df.filter(_usable(score))
        .groupBy((F.spark_partition_id() % MERGE_GROUPS).alias("merge_group"))
        .agg(sketch.alias("sketch"))
        .agg(F.kll_merge_agg_double("sketch").alias("sketch"))
        .select("sketch", F.kll_sketch_get_n_double("sketch").alias("n"))
        .first()
    )
    ranges = min(MAX_RANGES, math.ceil((row["n"] or 0) / rows_per_range))
    if ranges < 2:
        return [-math.inf, math.inf]
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    sketch = F.lit(bytearray(row["sketch"]))
    inner = (
        df.sparkSession.sql("SELECT 1")
        .select(F.kll_sketch_get_quantile_double(sketch, shares).alias("inner"))
        .first()["inner"]
    )
    return [-math.inf, *sorted(set(inner)), math.inf]


def _usable(score: str) -> Column:
    """Present and finite; Spark orders NaN above infinity."""
    return F.abs(F.col(score).cast("double")) < math.inf


def _with_running_counts(
    df: DataFrame, target: str, score: str, rows_per_range: int, extra: dict[str, Column]
) -> DataFrame:
    """One row per distinct score: its positives and negatives, and those at or above it.

    ``extra`` are further aggregates per score. Rows whose score is missing or not finite share one
    row of range -1.
    """
    boundaries = score_boundaries(df, score, rows_per_range)
    if len(boundaries) == 2:
        boundaries.insert(1, 0.0)
    ranged = (
        Bucketizer(
            splits=boundaries, inputCol="clean_score", outputCol="bucket", handleInvalid="keep"
        )
        .transform(df.withColumn("clean_score", F.when(_usable(score), F.col(score).cast("double"))))
        .withColumn("range", F.coalesce(F.col("bucket").cast("int"), F.lit(-1)))
    )
    per_score = ranged.groupBy("range", "clean_score").agg(
        _count(F.col(target) == 1).alias("pos"),
        _count(F.col(target) == 0).alias("neg"),
        *[aggregate.alias(name) for name, aggregate in extra.items()],
    )
    # Counted on the rows themselves: a handful of groups, combined before the shuffle. At most
    # MAX_RANGES + 1 rows: one task orders them, and every task may hold them.
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("range")
        .agg(
            _count(F.col(target) == 1).alias("range_pos"),
            _count(F.col(target) == 0).alias("range_neg"),
        )
        .select(
            "range",
            F.coalesce(F.sum("range_pos").over(above), F.lit(0)).alias("pos_above"),
            F.coalesce(F.sum("range_neg").over(above), F.lit(0)).alias("neg_above"),
        )
    )
    down = (
        Window.partitionBy("range")
        .orderBy(F.desc("clean_score"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = per_score.withColumns(
        {"run_pos": F.sum("pos").over(down), "run_neg": F.sum("neg").over(down)}
    )
    return running.join(F.broadcast(offsets), "range").withColumns(
        {
            "pos_reached": F.col("run_pos") + F.col("pos_above"),
            "neg_reached": F.col("run_neg") + F.col("neg_above"),
        }
    )


def _ranking_sums() -> list[Column]:
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    pos_reached = F.col("pos_reached").cast("double")
    neg_reached = F.col("neg_reached").cast("double")
    usable = F.col("range") >= 0
    return [
        F.coalesce(F.sum("pos"), F.lit(0)).alias("all_pos"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("all_neg"),
        _count(~usable).alias("unusable"),
        # A positive loses against each negative above it and half against each at its own score.
        F.sum(F.when(usable, pos * (neg_reached - neg / 2))).alias("losses"),
        F.sum(
            F.when(usable & (pos > 0), pos * (pos_reached / (pos_reached + neg_reached)))
        ).alias("steps"),
    ]


def _ranking_columns() -> list[Column]:
    has_pos, has_neg = F.col("all_pos") > 0, F.col("all_neg") > 0
    pairs = F.col("all_pos").cast("double") * F.col("all_neg").cast("double")
    valid = (F.col("unusable") == 0) & (has_pos | has_neg)
    return [
        F.when(valid & has_pos & has_neg, 1 - F.col("losses") / pairs).alias("roc_auc"),
        F.when(
            valid, F.when(has_pos, F.col("steps") / F.col("all_pos")).otherwise(F.lit(0.0))
        ).alias("pr_auc"),
    ]


def ranking_metrics(
    df: DataFrame,
    target: str = "target",
    score: str = "score",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """One row: ROC AUC (ties count half) and average precision (step sum), both exact.

    ROC AUC is NULL with one class only; average precision is then 0 without positives. Both are NULL
    if a score is missing or not finite, or if there are no rows.
    """
    running = _with_running_counts(df, target, score, rows_per_range, {})
    return running.agg(*_ranking_sums()).select(*_ranking_columns())


def metrics_record(
    df: DataFrame,
    target: str = "target",
    prediction: str = "prediction",
    score: str | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """One row with all metrics from one pass; ranking metrics are NULL without scores."""
    if score is None:
        missing = F.lit(None).cast("double")
        record = rates(confusion(df, target, prediction))
        return record.withColumns({"roc_auc": missing, "pr_auc": missing})
    counts = _confusion_counts(target, prediction)
    running = _with_running_counts(df, target, score, rows_per_range, counts)
    totals = [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in counts]
    return running.agg(*totals, *_ranking_sums()).select(*_rates(), *_ranking_columns())
