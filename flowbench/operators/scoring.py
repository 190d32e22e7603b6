"""Anomaly scores from class probabilities, thresholds and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PROBABILITY_FLOOR
from .quantile import exact_quantile


def anomaly_score(identity_probability: Column) -> Column:
    """-ln of the probability of the identity rotation, clipped to [1e-12, 1]; never negative zero."""
    clipped = F.least(F.greatest(identity_probability, F.lit(PROBABILITY_FLOOR)), F.lit(1.0))
    return F.lit(0.0) - F.log(clipped)


def derived_threshold(scores: DataFrame, quantile: float, score: str = "score") -> float:
    """Exact quantile (linear interpolation) of benign training scores."""
    return exact_quantile(scores, F.col(score), quantile)


def choose_threshold(
    derived: float, calibrated: float | None = None, use_calibrated: bool = False
) -> float:
    return float(calibrated) if use_calibrated and calibrated is not None else derived


def flag_anomalies(df: DataFrame, threshold: float | None, score: str = "score") -> DataFrame:
    """1 where the score lies strictly above the threshold."""
    if threshold is None:
        raise ValueError("There is no threshold yet: fit the detector first")
    return df.withColumn("prediction", (F.col(score) > F.lit(threshold)).cast("int"))
