"""The most frequent value of columns, also of those whose values are mostly unique.

One pass keeps a counter summary per column, merged over tasks, whose size does not follow the number of
values. A second pass counts the few candidates exactly. A column whose winner the summary does not settle
(no value stands out of many) has its values counted in full; only that shuffle grows with the values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import TRACKED
from .features import category, modes_of, value_counts

#: Most candidates a summary names per column.
CANDIDATES = 1000
#: Share of the rows that bounds how much a count of the summary is too high, and what an unnamed value can
#: have: twice the summary's error, 3.5 / 32,768 for the values tracked, rounded up.
ERROR_SHARE = 1 / 4000


def fit_modes(df: DataFrame, columns: list[str]) -> dict[str, tuple[str, int]]:
    """Most frequent value as string, and its count, per column; equal counts go to the smallest value.

    Missing values do not count; a column without any value, or of a table without rows, is left out.
    """
    columns = list(columns)
    if not columns:
        return {}
    strings = df.select(*[category(name).alias(f"value{i}") for i, name in enumerate(columns)])
    summary = strings.agg(
        F.count("*").alias("rows"),
        *[F.count(f"value{i}").alias(f"present{i}") for i in range(len(columns))],
        *[F.expr(f"approx_top_k(value{i}, {CANDIDATES}, {TRACKED})").alias(f"top{i}") for i in range(len(columns))],
    ).first()
    error = summary["rows"] * ERROR_SHARE
    candidates, rest = {}, {}
    for i, name in enumerate(columns):
        named = summary[f"top{i}"] or []
        counts = {top["item"]: top["count"] for top in named if top["item"] is not None}
        # more than this no value has that the summary does not name
        rest[name] = max(error, min(counts.values(), default=0)) if len(named) >= CANDIDATES else error
        candidates[name] = [v for v, n in counts.items() if n >= max(counts.values()) - error]
    exact = {}
    if any(candidates.values()):
        chosen = {n: F.when(category(n).isin(candidates[n]), category(n)) for n in columns if candidates[n]}
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), v.alias("value")) for n, v in chosen.items()]))
        counts = df.select(pairs.alias("pair")).select("pair.*").filter("value is not null").groupBy("feature", "value").count()
        exact = _winners(counts)
    certain = {n: found for n, found in exact.items() if found[1] > rest[n]}
    open_columns = [n for i, n in enumerate(columns) if n not in certain and summary[f"present{i}"]]
    counted = _winners(value_counts(df, open_columns)) if open_columns else {}
    return {n: found for n in columns if (found := certain.get(n) or counted.get(n))}


def _winners(counts: DataFrame) -> dict[str, tuple[str, int]]:
    return {row["feature"]: (row["mode"], row["most"]) for row in modes_of(counts).collect()}
