"""Preprocessing variants: which stages run, in order, as one plan."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ENGINE_COLUMNS, LABEL
from ..operators.clean import clean, survives_clean
from ..operators.labels import with_binary_target
from ..operators.normalize import normalize
from ..operators.parse import parse
from ..operators.split import check_weekdays, split_rows, with_split

STAGES = {"parse": parse, "normalize": normalize, "clean": clean}

# The stages of each variant.
VARIANTS = {
    "baseline": (),
    "parse": ("parse",),
    "parse_norm": ("parse", "normalize"),
    "parse_norm_clean": ("parse", "normalize", "clean"),
}


def validate_variant(name: str) -> str:
    if name not in VARIANTS:
        raise ValueError(f"Unknown variant {name!r}; choose one of {', '.join(VARIANTS)}")
    return name


def variant_stages(name: str) -> dict[str, bool]:
    """A fresh dict of stage flags."""
    chosen = VARIANTS[validate_variant(name)]
    return {stage: stage in chosen for stage in STAGES}


def run_stages(df: DataFrame, flags: Mapping[str, bool]) -> DataFrame:
    """Run the switched-on stages in their fixed order; a flag that is absent is off."""
    for name, stage in STAGES.items():
        if flags.get(name, False):
            df = df.transform(stage)
    return df


def prepare_variant(
    df: DataFrame, name: str, order: str = "target_first", check: bool = True
) -> DataFrame:
    """Flow rows of the three parts with ``target``, ``weekday`` and ``split``, after the stages.

    ``order="target_first"`` makes the label binary before the stages see it (then only ``clean`` can
    change rows); ``"stages_first"`` normalises and cleans the class names themselves.
    """
    flags = variant_stages(name)
    if order == "target_first":
        return run_stages(_target_first(df, check), flags)
    if order == "stages_first":
        if check:  # of the files there are, whatever rows the stages leave
            check_weekdays(run_stages(df, {"parse": flags["parse"]}))
        return split_rows(run_stages(df, flags), check=False)
    raise ValueError(f"order must be 'target_first' or 'stages_first', not {order!r}")


def _target_first(df: DataFrame, check: bool) -> DataFrame:
    return split_rows(df, check).withColumn(LABEL, F.col("target"))


def variant_shapes(
    df: DataFrame,
    variants: Iterable[str] = tuple(VARIANTS),
    order: str = "target_first",
    check: bool = True,
) -> DataFrame:
    """Rows and columns per variant and part, before and after the stages.

    Only ``clean`` removes rows, so one scan counts all variants: rows that survive are counted
    under a condition instead of running each variant's plan.
    """
    if check:
        check_weekdays(df)
    names = [validate_variant(name) for name in variants]
    frame = with_split(df).filter(F.col("split").isNotNull())
    if order == "target_first":
        frame = with_binary_target(frame, LABEL)
    survives = survives_clean(run_stages(frame, {"parse": False, "normalize": True}))
    counted = frame.groupBy("split").agg(
        F.count("*").alias("before"), F.count_if(survives).alias("cleaned")
    )
    after = [
        F.struct(
            F.lit(name).alias("variant"),
            F.col("cleaned" if "clean" in VARIANTS[name] else "before").alias("rows_after"),
            F.lit(_width(prepare_variant(df, name, order, check=False))).alias("columns_after"),
        )
        for name in names
    ]
    return counted.select(
        "split", F.col("before").alias("rows_before"), F.explode(F.array(*after)).alias("v")
    ).select(
        "v.variant", "split", "rows_before", "v.rows_after",
        F.lit(_width(df)).cast("long").alias("columns_before"),
        F.col("v.columns_after").cast("long").alias("columns_after"),
    )


def _width(df: DataFrame) -> int:
    """Columns without the label and what this engine adds; read from the schema, without a job."""
    return len([c for c in df.columns if c not in ENGINE_COLUMNS])
