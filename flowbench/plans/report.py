"""One comparable record per variant and seed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict
from functools import reduce
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_SEED, DetectorConfig
from ..operators.metrics import metrics_record
from ..operators.split import benign_part, check_weekdays, part, store_split
from ..sources.tables import committed, literal_path, shared_folder
from .detector import Statistics, fit_statistics, run_detector, save_detector
from .variants import VARIANTS, prepare_variant, variant_shapes

MODEL_NAME = "rf_anomaly"
SHAPES = ("rows_before", "columns_before", "rows_after", "columns_after")


def model_path(folder: str, variant: str, seed: int) -> str:
    return f"{folder}/{variant}_seed{seed}"


def run_variant(
    flows: DataFrame,
    variant: str,
    seed: int = DEFAULT_SEED,
    config: DetectorConfig = DetectorConfig(),
    order: str = "target_first",
    model_folder: str | None = None,
    shapes: DataFrame | None = None,
    statistics: Statistics | None = None,
) -> DataFrame:
    """Preprocess, fit, save, score and measure one variant; returns its one-row record."""
    folder = model_folder or f"{shared_folder(flows.sparkSession)}/flowbench/models"
    if shapes is None:
        shapes = variant_shapes(flows, [variant], order)
    if "split" not in flows.columns:
        flows = store_split(flows)
    # The stages are row-wise projections and filters: cheaper to repeat per pass than to store.
    prepared = prepare_variant(flows, variant, order, check=False)
    run = run_detector(
        benign_part(prepared, "train"), benign_part(prepared, "val"), part(prepared, "test"),
        config, seed, statistics=statistics,
    )
    saved = save_detector(run.detector, model_path(folder, variant, seed))
    sizes = {row["split"]: row for row in shapes.filter(F.col("variant") == variant).collect()}
    facts = {
        "variant": variant, "model": MODEL_NAME, "seed": seed,
        **{f"{name}_{shape}": sizes[name][shape] if name in sizes else 0
           for name in ("train", "val", "test") for shape in SHAPES},
    }
    outcome = {
        "threshold": run.detector.threshold,
        "derived_threshold": run.detector.derived_threshold,
        "training_time": run.detector.training_seconds,
        "validation_scoring_time": run.detector.validation_seconds,
        "test_scoring_time": run.test_seconds,
        **run.detector.info, "model_path": saved,
    }
    record = metrics_record(run.scored, score="score")
    return record.select(
        *[F.lit(value).alias(name) for name, value in facts.items()],
        *record.columns,
        *[F.lit(value).alias(name) for name, value in outcome.items()],
    )


def run_key(variant: str, seed: int, config: DetectorConfig, order: str) -> str:
    """Names a run by all that it depends on but the rows."""
    settings = json.dumps([asdict(config), order], sort_keys=True)
    return f"{variant}-{seed}-{hashlib.sha256(settings.encode()).hexdigest()[:16]}"


def run_sweep(
    flows: DataFrame,
    variants: Iterable[str] = tuple(VARIANTS),
    seeds: Iterable[int] = (DEFAULT_SEED,),
    config: DetectorConfig = DetectorConfig(),
    order: str = "target_first",
    output: str | None = None,
    model_folder: str | None = None,
    resume: bool = False,
    concurrent: int = 1,
) -> DataFrame:
    """Every variant with every seed; each record goes to ``output`` as its run ends.

    A record lies in its run's own folder, ``run=<variant>-<seed>-<hash of the settings>``, which a rerun
    replaces: a sweep that was broken off and is run again leaves one record per run. With ``resume`` the
    runs whose record is there are not run again; that is meant for the same flows only.

    ``concurrent`` runs go side by side: they do not depend on each other, and the jobs of one fill cores
    that another leaves idle. Their recorded times then include waiting for each other; leave it at 1 where
    times are to be compared. Each has a scheduler pool of its own, for clusters that share in FAIR mode.

    ``flows`` is read twice: once to check the days and once to store it by part of the split.
    """
    variants, seeds, spark = list(variants), list(seeds), flows.sparkSession
    output = output or f"{shared_folder(spark)}/flowbench/runs"
    check_weekdays(flows)
    flows = store_split(flows)
    shapes = variant_shapes(flows, variants, order, check=False).collect()
    shapes = spark.createDataFrame(shapes)  # three rows per variant
    done = {path.rpartition("/run=")[2] for path in committed(spark, f"{literal_path(output)}/run=*")} if resume else ()
    runs = {(v, s): run_key(v, s, config, order) for v in variants for s in seeds}
    open_runs = [run for run, key in runs.items() if key not in done]

    def learn(variant: str) -> Statistics:
        train = benign_part(prepare_variant(flows, variant, order, check=False), "train")
        return fit_statistics(train, config)

    def measure(run: tuple[str, int]) -> None:
        record = run_variant(flows, *run, config, order, model_folder, shapes, statistics[run[0]])
        record = spark.createDataFrame(record.collect(), record.schema)  # one row
        record.coalesce(1).write.mode("overwrite").parquet(f"{output}/run={runs[run]}")

    learned = list(dict.fromkeys(variant for variant, _ in open_runs))
    statistics = dict(zip(learned, side_by_side(spark, learn, learned, concurrent)))
    side_by_side(spark, measure, open_runs, concurrent)
    records = [spark.read.parquet(f"{output}/run={key}") for key in runs.values()]
    return reduce(DataFrame.unionByName, records)


def side_by_side(spark: SparkSession, task: Callable[[Any], Any], items: list, most: int) -> list:
    """``task`` of every item, at most ``most`` at a time, results in the items' order; an error ends it."""

    def in_pool(numbered: tuple[int, Any]) -> Any:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"flowbench-{numbered[0] % most}")
        return task(numbered[1])

    if most == 1:
        return [task(item) for item in items]
    with ThreadPoolExecutor(most) as pool:
        return list(pool.map(inheritable_thread_target(spark)(in_pool), enumerate(items)))
