"""The benign-only self-supervised detector: fit, score, predict, save, load."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_SEED, DetectorConfig
from ..functions.arrays import matrix_of_lists
from ..functions.names import col
from ..operators import forest, projection
from ..operators.projection import SingularVectors
from ..operators.features import (
    CategoricalFeature,
    FittedFeatures,
    NumericFeature,
    fit_features,
)
from ..operators.scoring import anomaly_score, choose_threshold, derived_threshold, flag_anomalies
from ..sources.tables import committed, laid_out, literal_path, write_table

# A feature row becomes one forest row per rotation: tasks that rotate and bin therefore take this many rows.
FOREST_ROWS = 20_000
#: About so many feature rows, with all their rotations, set the bins (Spark ML takes 10,000 rotated rows).
SPLIT_ROWS = 4000
#: Copies of one row that are numbered together, and hashes of drawn rows that are broadcast (about 100 bytes
#: each on the driver, for every fit that goes on at the time).
COPIES, BROADCAST_ROWS = 4096, 50_000

# Reserved names, so that no kept column is overwritten.
VECTOR, CLASS_PROBABILITY, PROBABILITY = "__flow_vector", "__flow_class_probability", "__flow_probability"

ARROW_TYPES = {
    "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(),
    "array<double>": pa.list_(pa.float64()),
}


@dataclass(frozen=True)
class Transform:
    """Everything between a flow row and its Fourier features; small except for wide categories."""

    features: FittedFeatures
    singular_vectors: SingularVectors
    weights: np.ndarray
    offsets: np.ndarray

    def apply(self, df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
        return projection.fourier_features(
            df, self.features, self.singular_vectors, self.weights, self.offsets, keep
        )


@dataclass(frozen=True)
class Detector:
    config: DetectorConfig
    seed: int
    transform: Transform
    rotations: np.ndarray
    forest: RandomForestClassificationModel
    threshold: float | None = None
    derived_threshold: float | None = None
    training_seconds: float | None = None
    validation_seconds: float | None = None
    fit_rows: int | None = None

    @property
    def info(self) -> dict[str, int | None]:
        return {
            "n_fit_rows": self.fit_rows,
            "n_estimators": self.config.trees,
            "n_features": len(self.transform.features.names) + len(self.transform.features.dropped),
            "n_rotations": self.config.rotations,
        }

    def score(self, df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
        """``keep`` plus ``score``, high for rows unlike the benign training rows."""
        return self._score_features(self.transform.apply(df, keep), keep)

    def _score_features(self, features: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
        return _identity_probability(self.forest, features, keep).select(
            *[col(name) for name in keep], anomaly_score(F.col(PROBABILITY)).alias("score")
        )

    def predict(self, df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
        """``keep`` plus ``score`` and the 0/1 ``prediction``."""
        if self.threshold is None:
            raise ValueError("There is no threshold yet: fit the detector first")
        return flag_anomalies(self.score(df, keep), self.threshold)


def _identity_probability(
    forest: RandomForestClassificationModel, features: DataFrame, keep: Iterable[str]
) -> DataFrame:
    vectors = features.select(
        *[col(name) for name in keep], array_to_vector("features").alias(forest.getFeaturesCol())
    )
    return forest.transform(vectors).select(
        *[col(name) for name in keep],
        vector_to_array(forest.getProbabilityCol())[0].alias(PROBABILITY),
    )


@dataclass(frozen=True)
class Statistics:
    """What fitting learns from the rows before any random number is drawn: shared by all seeds."""

    features: FittedFeatures
    singular_vectors: SingularVectors
    seconds: float


def fit_statistics(train_benign: DataFrame, config: DetectorConfig) -> Statistics:
    """Imputation, scaling and one-hot statistics, and the singular vectors."""
    start = time.perf_counter()
    features = fit_features(
        train_benign, config.exclude_columns, config.scale_numeric, config.inline_width
    )
    vectors = projection.truncated_svd(train_benign, features, config.svd_components)
    return Statistics(features, vectors, time.perf_counter() - start)


def transform_for(statistics: Statistics, config: DetectorConfig, seed: int) -> Transform:
    """Add the Fourier weights that belong to ``seed``."""
    weights, offsets = projection.fourier_parameters(
        statistics.singular_vectors.count, config.rff_components, config.rff_gamma, seed
    )
    return Transform(statistics.features, statistics.singular_vectors, weights, offsets)


def fit_forest(
    features: DataFrame, rotations: np.ndarray, config: DetectorConfig, seed: int
) -> RandomForestClassificationModel:
    """Learn to tell the rotations apart. All classes have equally many rows, so none needs a weight.

    ``features`` should be a stored table. The bootstrap draws per chunk and row order, so the rows are laid
    out by their content first: the same rows give the same forest on any cluster. The rotated rows are
    not stored, only the bins of their values.
    """
    rows = features.count()
    if not rows:
        raise ValueError("There are no rows to grow a forest on")
    some = features
    if rows > SPLIT_ROWS:
        draw = F.xxhash64(*features.columns, F.lit("splits")).bitwiseAND(F.lit((1 << 53) - 1))
        some = features.filter(draw < F.lit(int((1 << 53) * (SPLIT_ROWS / rows))))
    some = _rotated(some, rotations).select("features").toArrow().column(0).combine_chunks()
    codes = forest.Codes(
        tuple(forest.thresholds_of(column, config.max_bins) for column in matrix_of_lists(some).T), len(rotations)
    )
    settings = forest.Settings(
        config.trees, config.max_depth, config.min_rows_per_leaf, config.max_bins, config.forest_memory_mb, seed
    )
    stored = forest.stored_codes(_rotated(features, rotations), codes)
    trees = forest.grow(stored, rows * len(rotations), codes, settings)
    columns = {"features": VECTOR, "label": "rotation", "probability": CLASS_PROBABILITY}
    return forest.as_model(features.sparkSession, trees, codes, settings, columns)


def _rotated(features: DataFrame, rotations: np.ndarray) -> DataFrame:
    rotated = projection.rotate(laid_out(features, FOREST_ROWS), rotations)
    return rotated.select("rotation", "features")


def fit_sample(features: DataFrame, most: int | None) -> DataFrame:
    """The rows the forest is grown on: all, or about ``most``; ``copy`` numbers the equal ones among them.

    Equal rows are one row and a count until their copies are numbered, in chunks that different tasks take.
    The draw is a hash of content and copy, so a row that fills half the table fills about half the sample
    too, and neither files, order nor retries matter. Two contents of one 64-bit hash count as the smaller.
    Contents meet their copies in a shuffle; only few drawn hashes are broadcast, to sift rows before it.
    """
    content = features.select(F.xxhash64("features").alias("content"), "features")
    counts = content.groupBy("content").agg(F.count("*").alias("n"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))).alias("chunk")
    chunks = counts.select("content", "n", chunk)
    first = F.col("chunk") * COPIES
    copies = F.sequence(first, F.least(first + COPIES, F.col("n")) - 1)
    rows = features.count()
    draws = most is not None and rows > most
    if draws:
        bound = int((1 << 53) * (most / rows))
        draw = lambda c: F.xxhash64("content", c, F.lit("fit")).bitwiseAND(F.lit((1 << 53) - 1))
        copies = F.filter(copies, lambda c: draw(c) < F.lit(bound))
    drawn = chunks.select("content", "chunk", copies.alias("copies")).filter(F.size("copies") > 0)
    drawn = write_table(drawn, "fit-copies")
    if draws:  # else no row can be sifted out
        keys = drawn.select("content").distinct()
        if keys.count() <= BROADCAST_ROWS:
            content = content.join(F.broadcast(keys), "content", "left_semi")
    distinct = content.groupBy("content").agg(F.min("features").alias("features"))
    # A merge join: as files the numbers are small enough to be broadcast, on the driver they are twenty times that.
    spread = drawn.hint("merge").join(distinct, "content").repartition("content", "chunk")
    return write_table(spread.select("features", F.explode("copies").alias("copy")), "fit-rows")


def fit_detector(
    train_benign: DataFrame,
    val_benign: DataFrame | None = None,
    config: DetectorConfig = DetectorConfig(),
    seed: int = DEFAULT_SEED,
    statistics: Statistics | None = None,
) -> Detector:
    """Fit on benign training rows; the threshold is a quantile of their own scores.

    ``val_benign`` is scored for its timing only; it has no part in the threshold. ``statistics`` of
    an earlier fit on the same rows are reused, and their time counts as training time.
    """
    if statistics is None:
        statistics = fit_statistics(train_benign, config)
    start = time.perf_counter() - statistics.seconds
    transform = transform_for(statistics, config, seed)
    features = write_table(transform.apply(train_benign), "features")
    rotations = projection.rotation_matrices(config.rff_components, config.rotations, seed)
    sample = fit_sample(features, config.max_fit_rows)
    forest = fit_forest(sample, rotations, config, seed)
    detector = Detector(config, seed, transform, rotations, forest, fit_rows=sample.count())
    training_seconds = time.perf_counter() - start

    # The quantile takes several passes: score once, then pass over the stored scores.
    scores = write_table(detector._score_features(features), "scores")
    derived = derived_threshold(scores, config.threshold_quantile)
    threshold = choose_threshold(
        derived, config.calibrated_threshold, config.use_calibrated_threshold
    )
    validation_seconds = None
    if val_benign is not None:
        start = time.perf_counter()
        detector.score(val_benign).write.format("noop").mode("overwrite").save()
        validation_seconds = time.perf_counter() - start
    return replace(
        detector, threshold=threshold, derived_threshold=derived,
        training_seconds=training_seconds, validation_seconds=validation_seconds,
    )


@dataclass(frozen=True)
class DetectionRun:
    """A fitted detector and the stored test rows with ``score`` and ``prediction``."""

    detector: Detector
    scored: DataFrame
    test_seconds: float


def run_detector(
    train_benign: DataFrame,
    val_benign: DataFrame | None,
    test: DataFrame,
    config: DetectorConfig = DetectorConfig(),
    seed: int = DEFAULT_SEED,
    keep: Iterable[str] = ("target",),
    statistics: Statistics | None = None,
) -> DetectionRun:
    """Fit, then score and flag all test rows; the clock runs around the write of the scored table."""
    detector = fit_detector(train_benign, val_benign, config, seed, statistics)
    start = time.perf_counter()
    scored = write_table(detector.predict(test, keep), "scored")
    return DetectionRun(detector, scored, time.perf_counter() - start)


def save_detector(detector: Detector, path: str) -> str:
    """Write the forest and, as small tables, all fitted values as a new version under ``path``.

    The settings are written last and make the version whole: a save that breaks off leaves the
    version before it as the one that is loaded.
    """
    spark = SparkSession.active()
    folder, path = path, f"{path}/version={max(_versions(spark, path), default=-1) + 1:06d}"
    detector.forest.write().overwrite().save(f"{path}/forest")
    fitted = detector.transform.features
    settings = {
        "config": asdict(detector.config), "seed": detector.seed,
        "threshold": detector.threshold, "derived_threshold": detector.derived_threshold,
        "training_seconds": detector.training_seconds,
        "validation_seconds": detector.validation_seconds,
        "fit_rows": detector.fit_rows,
    }
    rows = [(f.name, f.median, f.mean, f.scale, None, False) for f in fitted.numeric]
    rows += [
        (f.name, None, None, None, f.mode, f.categories is None) for f in fitted.categorical
    ]
    rows += [(name, None, None, None, None, False) for name in fitted.dropped]
    schema = """position int, name string, median double, mean double, scale double, mode string,
        wide boolean"""
    _save(spark, [(i, *row) for i, row in enumerate(rows)], schema, f"{path}/features")
    if detector.transform.singular_vectors.table:
        vectors = spark.read.parquet(detector.transform.singular_vectors.table)
        vectors.write.mode("overwrite").parquet(f"{path}/category-vectors")
    categories = [
        (f.name, i, value) for f in fitted.categorical for i, value in enumerate(f.listed)
    ]
    _save(spark, categories, "name string, position int, value string", f"{path}/categories")
    matrices = {
        "singular_vectors": detector.transform.singular_vectors.matrix,
        "weights": detector.transform.weights,
        "offsets": detector.transform.offsets[None],
        **{f"rotation {i}": rotation for i, rotation in enumerate(detector.rotations)},
    }
    lines = [
        (name, i, line.astype(float).tolist())
        for name, matrix in matrices.items()
        for i, line in enumerate(matrix)
    ]
    _save(spark, lines, "name string, position int, line array<double>", f"{path}/matrices")
    _save(spark, [(json.dumps(settings),)], "settings string", f"{path}/settings")
    return folder


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """The whole versions of a saved model."""
    found = committed(spark, f"{literal_path(folder)}/version=*/settings")
    return [int(path.rpartition("/version=")[2].partition("/")[0]) for path in found]


def _save(spark: SparkSession, rows: list, schema: str, path: str) -> None:
    """Write a small local table as one file; Arrow hands it over without a Python worker."""
    fields = [part.split() for part in schema.split(",")]
    columns = [
        pa.array(list(column), ARROW_TYPES[data_type])
        for column, (_, data_type) in zip(zip(*rows) if rows else [()] * len(fields), fields)
    ]
    table = pa.table(columns, names=[name for name, _ in fields])
    spark.createDataFrame(table).coalesce(1).write.mode("overwrite").parquet(path)


def load_detector(spark: SparkSession, path: str) -> Detector:
    """The newest whole version of the model saved under ``path``."""
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"{path} holds no whole model")
    path = f"{path}/version={max(versions):06d}"
    settings = json.loads(spark.read.parquet(f"{path}/settings").first()["settings"])
    config = settings.pop("config")
    config["exclude_columns"] = tuple(config["exclude_columns"])
    categories: dict[str, list[str]] = {}
    for row in spark.read.parquet(f"{path}/categories").orderBy("position").collect():
        categories.setdefault(row["name"], []).append(row["value"])
    numeric, categorical, dropped = [], [], []
    for row in spark.read.parquet(f"{path}/features").orderBy("position").collect():
        if row["median"] is not None:
            numeric.append(NumericFeature(row["name"], row["median"], row["mean"], row["scale"]))
        elif row["mode"] is not None:
            values = tuple(categories[row["name"]])
            known, hot = (None, values) if row["wide"] else (values, ())
            categorical.append(CategoricalFeature(row["name"], row["mode"], known, hot))
        else:
            dropped.append(row["name"])
    lines: dict[str, list] = {}
    for row in spark.read.parquet(f"{path}/matrices").orderBy("position").collect():
        lines.setdefault(row["name"], []).append(row["line"])
    matrices = {name: np.array(rows) for name, rows in lines.items()}
    rotations = np.stack(
        [matrices[f"rotation {i}"] for i in range(config["rotations"])]
    ).astype(np.float32)
    fitted = FittedFeatures(tuple(numeric), tuple(categorical), tuple(dropped))
    table = f"{path}/category-vectors" if fitted.wide else None
    transform = Transform(
        fitted, SingularVectors(matrices["singular_vectors"], table),
        matrices["weights"], matrices["offsets"][0],
    )
    forest = RandomForestClassificationModel.load(f"{path}/forest")
    return Detector(DetectorConfig(**config), transform=transform, rotations=rotations,
                    forest=forest, **settings)
