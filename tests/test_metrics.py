import math

import numpy as np
import pandas as pd
import pytest

from flowbench.operators import metrics, scoring


def brute_force(target, score):
    """Pair count for ROC AUC, walk down the scores for average precision."""
    pos, neg = score[target == 1], score[target == 0]
    wins = sum((pos[:, None] > neg).sum(1)) + 0.5 * sum((pos[:, None] == neg).sum(1))
    steps = 0.0
    for value in np.unique(pos):
        reached = score >= value
        steps += (pos == value).sum() * target[reached].mean()
    return wins / (len(pos) * len(neg)), steps / len(pos)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    score = np.concatenate([np.full(700, 2.5), rng.normal(size=700).round(2), rng.normal(size=700)])
    target = (rng.random(2100) < 1 / (1 + np.exp(-score))).astype(int)
    return pd.DataFrame({"target": target, "score": score}).sample(frac=1, random_state=0)


@pytest.mark.parametrize("rows_per_range", [250_000, 500, 20])
def test_ranking_metrics_are_exact_for_any_number_of_ranges(spark, data, rows_per_range):
    row = metrics.ranking_metrics(
        spark.createDataFrame(data).repartition(5), rows_per_range=rows_per_range
    ).first()
    auc, ap = brute_force(data.target.to_numpy(), data.score.to_numpy())
    assert row.roc_auc == pytest.approx(auc, rel=1e-12)
    assert row.pr_auc == pytest.approx(ap, rel=1e-12)


def test_auc_depends_on_the_order_of_scores_only(spark, data):
    df = spark.createDataFrame(data)
    moved = df.selectExpr("target", "exp(score) * 3 - 7 as score")
    wanted = pytest.approx(tuple(metrics.ranking_metrics(df).first()), rel=1e-12)
    assert tuple(metrics.ranking_metrics(moved).first()) == wanted


def test_a_shared_score_is_combined_before_the_shuffle(spark, data):
    plan = metrics.ranking_metrics(spark.createDataFrame(data))._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "partial_count" in text and "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize(
    "rows, auc, ap",
    [
        ([(1, 0.5), (1, 0.7)], None, 1.0), ([(0, 0.5), (0, 0.7)], None, 0.0),
        ([(1, 0.5), (0, None)], None, None), ([(1, math.nan), (0, 0.1)], None, None),
        ([(1, math.inf), (0, 0.1)], None, None), ([], None, None), ([(1, 0.1), (0, 0.1)], 0.5, 0.5),
    ],
)
def test_edge_cases(spark, rows, auc, ap):
    df = spark.createDataFrame(rows, "target int, score double")
    assert tuple(metrics.ranking_metrics(df).first()) == (auc, ap)


def test_record(spark):
    rows = [(1, 1, 0.9), (1, 0, 0.2), (0, 1, 0.8), (0, 0, 0.1), (0, 0, 0.3)]
    df = spark.createDataFrame(rows, "target int, prediction int, score double")
    record = metrics.metrics_record(df, score="score").first()
    assert (record.tn, record.fp, record.fn, record.tp) == (2, 1, 1, 1)
    assert (record.accuracy, record.precision, record.recall, record.f1) == (0.6, 0.5, 0.5, 0.5)
    assert record.roc_auc == pytest.approx(4 / 6)
    plain = metrics.metrics_record(df).first()
    assert plain.asDict() == {**record.asDict(), "roc_auc": None, "pr_auc": None}


def test_zero_division_is_zero(spark):
    df = spark.createDataFrame([(0, 0)], "target int, prediction int")
    record = metrics.metrics_record(df).first()
    assert (record.accuracy, record.precision, record.recall, record.f1) == (1.0, 0.0, 0.0, 0.0)


def test_scores_and_flags(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.5,)], "p double")
    scores = [r[0] for r in df.select(scoring.anomaly_score(df.p)).collect()]
    assert scores == [pytest.approx(-math.log(1e-12)), 0.0, pytest.approx(math.log(2))]
    assert math.copysign(1, scores[1]) == 1
    flagged = scoring.flag_anomalies(df.withColumnRenamed("p", "score"), 0.5).collect()
    assert [r.prediction for r in flagged] == [0, 1, 0]
    with pytest.raises(ValueError, match="fit the detector first"):
        scoring.flag_anomalies(df, None)
    assert scoring.choose_threshold(0.1, 0.8042, True) == 0.8042
    assert scoring.choose_threshold(0.1, None, True) == scoring.choose_threshold(0.1, 0.8) == 0.1
