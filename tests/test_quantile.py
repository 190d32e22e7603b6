import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowbench.operators import quantile

FRACTIONS = (0.0, 0.03, 0.2, 0.5, 0.77, 0.97, 1.0)


def skewed(rows):
    """A third of the rows is one value; huge and tiny values; many distinct ones."""
    rng = np.random.default_rng(1)
    parts = [np.zeros(rows // 3), rng.normal(size=rows // 3), np.repeat([1e300, -1e300, 5e-324], 50),
             rng.choice([1.0, 2.0], rows // 5), rng.exponential(1e9, size=rows // 10)]
    return rng.permutation(np.concatenate(parts))


@pytest.fixture(scope="module")
def frame(spark):
    values = skewed(30_000)
    return values, spark.createDataFrame(pd.DataFrame({"x": values})).repartition(5)


@pytest.mark.parametrize("size, margin", [(4096, 0.003), (64, 0.01), (16, 0.0), (8, 0.2)])
def test_any_sketch_gives_the_exact_quantile(frame, monkeypatch, size, margin):
    """Small sketches and no margin make the proposals miss; results stay exact."""
    values, df = frame
    monkeypatch.setattr(quantile, "SKETCH_SIZE", size)
    monkeypatch.setattr(quantile, "MARGIN", margin)
    for fraction in FRACTIONS if size > 16 else (0.2, 0.97):
        found = quantile.exact_quantile(df, F.col("x"), fraction)
        assert found == pytest.approx(np.quantile(values, fraction), rel=1e-14, abs=0)


def test_profile_of_several_columns(spark):
    rng = np.random.default_rng(2)
    data = pd.DataFrame({"a": rng.integers(0, 50, 9000), "b": rng.normal(3, 2, 9000)})
    data.loc[::7, "b"] = np.nan
    df = spark.createDataFrame(data).repartition(6)
    b = F.when(~F.isnan("b"), F.col("b"))
    facts = quantile.profile(df, {"a": F.col("a"), "b": b, "none": F.lit(None)}, 0.5)
    assert facts["a"].quantile == np.median(data.a)
    assert facts["b"].quantile == pytest.approx(np.nanmedian(data.b), rel=1e-15)
    assert facts["b"].rows == 9000 and facts["b"].count == data.b.count()
    assert facts["b"].mean == pytest.approx(data.b.mean(), rel=1e-12)
    assert facts["b"].variance == pytest.approx(data.b.var(ddof=0), rel=1e-12)
    assert facts["none"] == quantile.Profile(9000, 0, None, None, None)


def test_no_rows_and_one_row(spark):
    df = spark.createDataFrame([(4.0,)], "x double")
    assert quantile.exact_quantile(df, F.col("x"), 0.3) == 4.0
    assert quantile.exact_quantile(df.limit(0), F.col("x"), 0.3) is None
    assert quantile.profile(df, {}, 0.5) == {}
