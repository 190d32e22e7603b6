"""Exact quantiles of any number of columns, at any scale.

``percentile`` keeps a table of all distinct values in one task; ``approx_percentile`` is not exact.
Here each pass over the data is one aggregate with bounded state: a KLL sketch proposes a bracket
around the wanted order statistic, the next pass counts exactly how many values lie below, on and
inside the bracket, and the sketch of the inside proposes the next bracket. A sketch that holds at
most ``SKETCH_SIZE`` values has dropped none, so it yields the order statistic itself. The bracket
shrinks about 150-fold per pass: one pass up to 4 thousand rows, two to about 600 thousand, four to
about 10^10. A wrong proposal costs another pass, never a wrong result.

Sketches are merged in two levels (per group of input partitions, then all), so that no single task
merges one sketch per input partition.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SKETCH_SIZE = 4096
MARGIN = 0.003
MERGE_GROUPS = 256


@dataclass(frozen=True)
class Profile:
    """Exact facts about the non-missing values of one column; ``rows`` counts missing ones too."""

    rows: int
    count: int
    mean: float | None
    variance: float | None
    quantile: float | None


@dataclass(frozen=True)
class _Search:
    """Find the values at ``ranks``, known to lie in the open interval (low, high).

    ``offset`` values are at or below ``low``; (left, right) is the proposed bracket.
    """

    column: str
    ranks: tuple[int, ...]
    offset: int
    low: float
    high: float
    left: float
    right: float


def _search_pass(df: DataFrame, values: dict[str, Column], searches: list[_Search], found: dict):
    """One aggregate over the data for all open searches; returns the searches still open."""
    first, merged, results = [], [], []
    for i, search in enumerate(searches):
        value = values[search.column]
        inside = (value > search.left) & (value < search.right)
        first += [
            F.sum(((value > search.low) & (value < search.left)).cast("long")).alias(f"l{i}"),
            # Each value is counted in one part only, also where ends of the two intervals meet.
            F.sum(((value > search.low) & (value == search.left)).cast("long")).alias(f"a{i}"),
            F.sum(
                ((value > search.left) & (value == search.right) & (value < search.high))
                .cast("long")
            ).alias(f"b{i}"),
            F.kll_sketch_agg_double(F.when(inside, value), F.lit(SKETCH_SIZE)).alias(f"s{i}"),
        ]
        merged += [F.sum(f"{c}{i}").alias(f"{c}{i}") for c in "lab"]
        merged.append(F.kll_merge_agg_double(f"s{i}").alias(f"s{i}"))
        results += [F.coalesce(f"{c}{i}", F.lit(0)).alias(f"{c}{i}") for c in "lab"]
        results += [f"s{i}", F.kll_sketch_get_n_double(f"s{i}").alias(f"n{i}")]
    row = _two_level(df, first, merged).select(*results).first()

    still_open, requests = [], []
    for i, search in enumerate(searches):
        # The bracket cuts the interval into five parts; sort the ranks into them.
        starts = [search.offset]
        for size in (row[f"l{i}"], row[f"a{i}"], row[f"n{i}"], row[f"b{i}"]):
            starts.append(starts[-1] + size)
        below, inside, above = [], [], []
        for rank in search.ranks:
            if rank < starts[1]:
                below.append(rank)
            elif rank < starts[2]:
                found[search.column, rank] = search.left
            elif rank < starts[3]:
                inside.append(rank)
            elif rank < starts[4]:
                found[search.column, rank] = search.right
            else:
                above.append(rank)
        # A part the proposal missed is looked at whole in the next pass.
        if below:
            still_open.append(
                _Search(search.column, tuple(below), starts[0],
                        search.low, search.left, search.low, search.left)
            )
        if above:
            still_open.append(
                _Search(search.column, tuple(above), starts[4],
                        search.right, search.high, search.right, search.high)
            )
        if inside:
            requests.append(
                _Sketch(search.column, tuple(inside), starts[2], search.left, search.right,
                        bytes(row[f"s{i}"]), row[f"n{i}"])
            )
    return still_open + _read_sketches(df.sparkSession, requests, found)


@dataclass(frozen=True)
class _Sketch:
    """A merged sketch of the values in (low, high), and the ranks to look up in it."""

    column: str
    ranks: tuple[int, ...]
    offset: int
    low: float
    high: float
    data: bytes
    size: int

    def shares(self) -> list[float]:
        """Rank fractions to ask for: each rank itself, then just below and just above all."""
        middle = [(rank - self.offset + 0.5) / self.size for rank in self.ranks]
        return middle + [max(min(middle) - MARGIN, 0.0), min(max(middle) + MARGIN, 1.0)]


def _read_sketches(spark: SparkSession, sketches: list[_Sketch], found: dict) -> list[_Search]:
    """Look the ranks up: final in a complete sketch, else the bracket of the next pass."""
    if not sketches:
        return []
    lookups = [
        F.kll_sketch_get_quantile_double(
            F.lit(bytearray(s.data)), F.array(*[F.lit(share) for share in s.shares()])
        ).alias(f"q{i}")
        for i, s in enumerate(sketches)
    ]
    row = spark.sql("SELECT 1").select(*lookups).first()
    searches = []
    for i, s in enumerate(sketches):
        guesses = row[f"q{i}"]
        if s.size <= SKETCH_SIZE:
            found.update({(s.column, rank): guess for rank, guess in zip(s.ranks, guesses)})
        else:
            searches.append(_Search(s.column, s.ranks, s.offset, s.low, s.high, *guesses[-2:]))
    return searches


def _two_level(df: DataFrame, first: list[Column], merged: list[Column]) -> DataFrame:
    group = (F.spark_partition_id() % MERGE_GROUPS).alias("merge_group")
    return df.groupBy(group).agg(*first).agg(*merged)


def _pool(parts) -> tuple[int, int, float | None, float | None]:
    """Combine (rows, count, mean, population variance) of disjoint parts."""
    rows = sum(p["rows"] for p in parts)
    parts = [p for p in parts if p["count"]]
    count = sum(p["count"] for p in parts)
    if not count:
        return rows, 0, None, None
    mean = sum(p["mean"] * (p["count"] / count) for p in parts)
    gaps = [p["mean"] - mean for p in parts]
    variance = sum((p["variance"] + d * d) * (p["count"] / count) for p, d in zip(parts, gaps))
    return rows, count, mean, variance


def profile(df: DataFrame, values: dict[str, Column], fraction: float) -> dict[str, Profile]:
    """Counts, moments and the exact ``fraction`` quantile (linear interpolation) of each value.

    ``values`` maps a name to a numeric expression whose missing values are NULL; NaN and infinities
    must be NULL already (``clean.finite``). The first pass also yields counts and moments.
    """
    if not values:
        return {}
    # Project first: an aggregate would evaluate each expression anew for every function of it.
    df = df.select(*[value.cast("double").alias(f"v{i}") for i, value in enumerate(values.values())])
    values = {name: F.col(f"v{i}") for i, name in enumerate(values)}
    first, merged, results = [], [], []
    for i, value in enumerate(values.values()):
        first += [
            F.struct(
                F.count("*").alias("rows"), F.count(value).alias("count"),
                F.avg(value).alias("mean"), F.var_pop(value).alias("variance"),
            ).alias(f"m{i}"),
            F.kll_sketch_agg_double(value, F.lit(SKETCH_SIZE)).alias(f"s{i}"),
        ]
        merged += [F.collect_list(f"m{i}").alias(f"m{i}"),
                   F.kll_merge_agg_double(f"s{i}").alias(f"s{i}")]
        results += [f"m{i}", f"s{i}"]
    row = _two_level(df, first, merged).select(*results).first()

    facts, wanted, found, sketches = {}, {}, {}, []
    for i, name in enumerate(values):
        rows, count, mean, variance = _pool(row[f"m{i}"])
        facts[name] = Profile(rows, count, mean, variance, None)
        if count:
            wanted[name] = fraction * (count - 1)
            ranks = tuple(sorted({math.floor(wanted[name]), math.ceil(wanted[name])}))
            sketches.append(
                _Sketch(name, ranks, 0, -math.inf, math.inf, bytes(row[f"s{i}"]), count)
            )
    searches = _read_sketches(df.sparkSession, sketches, found)
    while searches:
        searches = _search_pass(df, values, searches, found)
    return {
        name: replace(fact, quantile=_interpolate(name, wanted[name], found))
        if name in wanted else fact
        for name, fact in facts.items()
    }


def _interpolate(name: str, target: float, found: dict[tuple[str, int], float]) -> float:
    low, high = found[name, math.floor(target)], found[name, math.ceil(target)]
    return low + (high - low) * (target - math.floor(target))


def exact_quantile(df: DataFrame, value: Column, fraction: float) -> float | None:
    """One exact quantile; NULLs are ignored, and no value at all gives None."""
    return profile(df, {"value": value}, fraction)["value"].quantile
