"""Feature columns, imputation, scaling and one-hot encoding: fitted aggregates, applied as projections."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ENGINE_COLUMNS, IDENTIFIER_COLUMNS, NON_FEATURE_COLUMNS
from ..functions.names import canonical_name, canonical_names, col
from .clean import finite
from .encoding import code, sparse_vectors, with_codes, write_dictionary
from .quantile import Profile, profile
from .schema import numeric_and_categorical

# Width of the vector up to which categories are kept as lists on the driver. The features that do not
# fit keep their categories in a table instead (wide.py).
INLINE_WIDTH = 4096
HOT_SHARE = 1000
# Rounding steps that a mean may carry; a deviation below this share of the mean is a constant's.
ROUNDING_STEPS = 1 << 20


@dataclass(frozen=True)
class NumericFeature:
    name: str
    median: float
    mean: float
    scale: float


@dataclass(frozen=True)
class CategoricalFeature:
    """``categories`` is None when there are too many to hold on the driver.

    ``hot`` then lists the values that hold more than one in HOT_SHARE rows, at most HOT_SHARE of them, and
    ``count`` says how many values there are.
    """

    name: str
    mode: str
    categories: tuple[str, ...] | None
    hot: tuple[str, ...] = ()
    count: int = 0

    @property
    def listed(self) -> tuple[str, ...]:
        """The values the driver knows: all of them, or the hot ones."""
        return self.hot if self.categories is None else self.categories


@dataclass(frozen=True)
class FittedFeatures:
    numeric: tuple[NumericFeature, ...]
    categorical: tuple[CategoricalFeature, ...]
    dropped: tuple[str, ...]
    #: Path of the table with the codes of all categories that are not listed here.
    dictionary: str | None = None

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.numeric] + [f.name for f in self.categorical]

    @property
    def inline(self) -> bool:
        return all(f.categories is not None for f in self.categorical)

    @property
    def wide(self) -> list[int]:
        """Positions of the categorical features whose categories are in a table."""
        return [i for i, f in enumerate(self.categorical) if f.categories is None]

    @property
    def width(self) -> int:
        """Columns of the assembled vector that the driver knows."""
        return len(self.numeric) + sum(len(f.categories or ()) for f in self.categorical)


def select_feature_columns(
    df: DataFrame, exclude: Iterable[str] = IDENTIFIER_COLUMNS
) -> list[str]:
    """Columns that may be features, in order. The label and all columns derived from it are not."""
    excluded = {
        *canonical_names(NON_FEATURE_COLUMNS), *canonical_names(exclude), *ENGINE_COLUMNS
    }
    chosen = [name for name in df.columns if canonical_name(name) not in excluded]
    if not chosen:
        raise ValueError("Every column is excluded; none is left as a feature")
    return chosen


def category(name: str) -> Column:
    return col(name).cast("string")


def impute_numeric(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Missing and non-finite values become the fitted median."""
    return df.withColumns(
        {
            name: F.coalesce(finite(name, df.schema[name].dataType).cast("double"), F.lit(median))
            for name, median in medians.items()
        }
    )


def impute_category(df: DataFrame, modes: dict[str, str]) -> DataFrame:
    return df.withColumns(
        {name: F.coalesce(category(name), F.lit(mode)) for name, mode in modes.items()}
    )


def moments_after_imputation(facts: Profile) -> tuple[float, float]:
    """Mean and variance once the missing rows hold the median, without another pass."""
    missing = facts.rows - facts.count
    share = facts.count / facts.rows
    mean = facts.mean * share + facts.quantile * (missing / facts.rows)
    variance = (facts.variance + (facts.mean - mean) ** 2) * share
    return mean, variance + (facts.quantile - mean) ** 2 * (missing / facts.rows)


def scale_for(mean: float, variance: float) -> float:
    """Population standard deviation; 1 where the variance is only rounding error of a constant.

    The bound on that error does not depend on the number of rows: means are merged pairwise.
    """
    noise = ROUNDING_STEPS * sys.float_info.epsilon
    return 1.0 if variance <= noise * variance + (noise * mean) ** 2 else math.sqrt(variance)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value, count) of all given columns in one scan; hot values combine before the shuffle."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("feature"), category(c).alias("value")) for c in columns])
    ).alias("pair")
    return (
        df.select(pairs)
        .select("pair.*")
        .filter(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count("*").alias("count"))
    )


def modes_of(counts: DataFrame) -> DataFrame:
    """Most frequent value per feature, ties to the smallest, the number of distinct values, and the mode's count."""
    first = F.min(F.struct((-F.col("count")).alias("order"), "value"))
    return counts.groupBy("feature").agg(
        first["value"].alias("mode"), F.count("*").alias("distinct"), F.max("count").alias("most")
    )


def _inline_features(found: dict, room: int) -> list[str]:
    """Features whose categories fit on the driver together, those with the fewest first."""
    inline = []
    for name in sorted(found, key=lambda n: found[n]["distinct"]):
        room -= found[name]["distinct"]
        if room < 0:
            break
        inline.append(name)
    return inline


def _values(counts: DataFrame) -> dict[str, list[str]]:
    lists: dict[str, list[str]] = {}
    for row in counts.select("feature", "value").collect():
        lists.setdefault(row["feature"], []).append(row["value"])
    return lists


def fit_features(
    df: DataFrame,
    exclude: Iterable[str] = IDENTIFIER_COLUMNS,
    scale_numeric: bool = True,
    inline_width: int = INLINE_WIDTH,
) -> FittedFeatures:
    """Fit medians, moments, modes and categories on ``df``; columns with no value at all are dropped."""
    columns = select_feature_columns(df, exclude)
    numeric, categorical = numeric_and_categorical(df, columns)
    facts = profile(df, {n: finite(n, df.schema[n].dataType) for n in numeric}, 0.5)
    fitted, dropped = [], []
    for name in numeric:
        if not facts[name].count:
            dropped.append(name)
            continue
        mean, scale = 0.0, 1.0
        if scale_numeric:
            mean, variance = moments_after_imputation(facts[name])
            scale = scale_for(mean, variance)
        fitted.append(NumericFeature(name, facts[name].quantile, mean, scale))

    encoded, dictionary = [], None
    if categorical:
        counts = value_counts(df, categorical).persist(StorageLevel.MEMORY_AND_DISK)
        found = {row["feature"]: row for row in modes_of(counts).collect()}
        dropped += [name for name in categorical if name not in found]
        inline = _inline_features(found, inline_width - len(fitted))
        lists = _values(counts.filter(F.col("feature").isin(inline)))
        # More than one in HOT_SHARE rows each, so fewer than HOT_SHARE values per feature.
        hot = _values(
            counts.filter(~F.col("feature").isin(inline))
            .join(F.broadcast(counts.groupBy("feature").agg(F.sum("count").alias("rows"))), "feature")
            .filter(F.col("count") * HOT_SHARE > F.col("rows"))
        ) if len(inline) < len(found) else {}
        if len(inline) < len(found):
            dictionary = write_dictionary(counts.filter(~F.col("feature").isin(inline)))
        counts.unpersist()
        encoded = [
            CategoricalFeature(
                name, found[name]["mode"],
                tuple(sorted(lists[name])) if name in inline else None,
                tuple(sorted({*hot.get(name, ()), found[name]["mode"]} if name not in inline else ())),
                0 if name in inline else found[name]["distinct"],
            )
            for name in categorical
            if name in found
        ]
    return FittedFeatures(tuple(fitted), tuple(encoded), tuple(dropped), dictionary)


def scaled(df: DataFrame, feature: NumericFeature) -> Column:
    """Imputed and scaled value of one numeric feature."""
    value = finite(feature.name, df.schema[feature.name].dataType).cast("double")
    value = F.coalesce(value, F.lit(feature.median))
    return (value - F.lit(feature.mean)) / F.lit(feature.scale)


def filled(feature: CategoricalFeature) -> Column:
    return F.coalesce(category(feature.name), F.lit(feature.mode))


def number(position: int) -> str:
    """Reserved column name of a scaled numeric feature; never that of a kept column."""
    return f"__flow_n{position}"


def text(position: int) -> str:
    """Reserved column name of an imputed categorical feature."""
    return f"__flow_c{position}"


def prepared(df: DataFrame, fitted: FittedFeatures, keep: Iterable[str] = ()) -> DataFrame:
    """``keep`` plus one column per fitted feature: scaled ``number(i)``, imputed ``text(i)``."""
    return df.select(
        *[col(name) for name in keep],
        *[scaled(df, f).alias(number(i)) for i, f in enumerate(fitted.numeric)],
        *[filled(f).alias(text(i)) for i, f in enumerate(fitted.categorical)],
    )


def assemble(
    df: DataFrame, fitted: FittedFeatures, keep: Iterable[str] = (), output: str = "features"
) -> DataFrame:
    """``keep`` plus one sparse or dense vector: numeric block, then one-hot blocks.

    A category not seen in fitting gives an all-zero block. Blocks are in the order of their features, and
    categories in a block are sorted, whether the driver lists them or a dictionary codes them.
    """
    keep = list(keep)
    if not fitted.inline:
        return _assemble_wide(df, fitted, keep, output)
    numbers = [number(i) for i in range(len(fitted.numeric))]
    texts = [text(i) for i in range(len(fitted.categorical))]
    frame = prepared(df, fitted, keep)
    if texts:
        indexed = frame
        for name, feature in zip(texts, fitted.categorical):
            indexed = StringIndexerModel.from_labels(
                list(feature.categories), name, f"{name}_index", handleInvalid="keep"
            ).transform(indexed)
        encoder = OneHotEncoder(
            inputCols=[f"{t}_index" for t in texts], outputCols=[f"{t}_hot" for t in texts], dropLast=True
        )
        frame = encoder.fit(indexed).transform(indexed)
    assembler = VectorAssembler(
        inputCols=numbers + [f"{t}_hot" for t in texts], outputCol=output, handleInvalid="error"
    )
    return assembler.transform(frame).select(*[col(name) for name in keep], output)


def _assemble_wide(df: DataFrame, fitted: FittedFeatures, keep: list[str], output: str) -> DataFrame:
    """The same vector, always sparse, when a dictionary holds the codes of some features."""
    if fitted.dictionary is None:
        names = [fitted.categorical[i].name for i in fitted.wide]
        raise ValueError(f"No dictionary of the categories of {', '.join(names)}: fit the features first")
    sizes = [len(f.categories) if f.categories is not None else f.count for f in fitted.categorical]
    starts = [len(fitted.numeric) + sum(sizes[:i]) for i in range(len(sizes))]
    if (width := len(fitted.numeric) + sum(sizes)) >= 1 << 31:
        raise ValueError(f"A vector cannot have {width} places")
    wide = {i: fitted.categorical[i].name for i in fitted.wide}
    frame = with_codes(prepared(df, fitted, keep), wide, {i: text(i) for i in wide}, fitted.dictionary)
    codes = []
    for i, feature in enumerate(fitted.categorical):
        if feature.categories is None:
            codes.append(col(code(i)))
        else:  # a list that the inline width bounds
            place = F.array_position(F.lit(list(feature.categories)), col(text(i))) - 1
            codes.append(F.when(place >= 0, place).alias(code(i)))
    frame = frame.select(*[col(name) for name in keep], *[number(i) for i in range(len(fitted.numeric))], *codes)
    return sparse_vectors(frame, len(keep), len(fitted.numeric), starts, width, output)
