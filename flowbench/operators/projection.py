"""Truncated SVD, random Fourier features and rotations.

The SVD needs one aggregate (the Gramian of the assembled vectors). SVD and Fourier weights are then
multiplied once on the driver, so that applying both costs one matrix product per Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructField, StructType

from ..functions.arrays import lists_of, matrix_of, matrix_of_lists, vectors_of
from . import wide
from .encoding import heavy_values
from .features import FittedFeatures, prepared, text
from .wide import component_count, fix_signs


@dataclass(frozen=True)
class SingularVectors:
    """Right singular vectors. ``matrix`` has the numeric rows, then those of all listed categories.

    Listed are the categories of inline features and the hot values of wide ones; the vectors of all
    other values of wide features are rows of the Parquet table at ``table``.
    """

    matrix: np.ndarray
    table: str | None = None

    @property
    def count(self) -> int:
        return self.matrix.shape[1]

    def numeric(self, fitted: FittedFeatures) -> np.ndarray:
        return self.matrix[: len(fitted.numeric)]

    def blocks(self, fitted: FittedFeatures) -> Iterator[tuple[np.ndarray, tuple[str, ...]]]:
        start = len(fitted.numeric)
        for feature in fitted.categorical:
            stop = start + len(feature.listed)
            yield self.matrix[start:stop], feature.listed
            start = stop


def truncated_svd(df: DataFrame, fitted: FittedFeatures, wanted: int) -> SingularVectors:
    """Right singular vectors (width x k) of the prepared, uncentred matrix.

    Exact from the Gramian when the driver can hold one; else by subspace iteration over tables.
    """
    if fitted.wide:
        return SingularVectors(*wide.singular_vectors(df, fitted, wanted))
    _, eigenvectors = np.linalg.eigh(wide.gramian(df, fitted))
    count = component_count(fitted.width, wanted)
    return SingularVectors(fix_signs(eigenvectors[:, ::-1][:, :count]))


def fourier_parameters(
    inputs: int, outputs: int, gamma: float, seed: int
) -> tuple[np.ndarray, np.ndarray]:
    """Weights N(0, 2 gamma) and offsets U(0, 2 pi) of the Gaussian-kernel feature map."""
    generator = np.random.RandomState(seed)
    weights = generator.normal(scale=np.sqrt(2.0 * gamma), size=(inputs, outputs))
    return weights, generator.uniform(high=2.0 * np.pi, size=outputs)


def rotation_matrices(size: int, count: int, seed: int) -> np.ndarray:
    """The identity and ``count - 1`` random orthonormal matrices of determinant +1."""
    drawn = np.random.default_rng(seed).normal(size=(count - 1, size, size))
    turned = np.linalg.qr(drawn).Q
    turned[:, :, 0] *= np.linalg.slogdet(turned).sign[:, None]
    return np.concatenate([np.eye(size)[None], turned]).astype(np.float32)


def _linear_features(
    df: DataFrame,
    fitted: FittedFeatures,
    singular_vectors: SingularVectors,
    weights: np.ndarray,
    finish: Callable[[np.ndarray], np.ndarray],
    keep: Iterable[str],
    output: str,
) -> DataFrame:
    """``finish`` of (prepared row x singular vectors x weights), one matrix product per batch."""
    keep = list(keep)
    frame = prepared(df, fitted, keep)
    heavy = heavy_values(frame, [text(i) for i in fitted.wide])
    for position in fitted.wide:
        frame = wide.attach_vectors(frame, fitted, position, singular_vectors.table, heavy[text(position)])
    numbers, texts = len(fitted.numeric), len(fitted.categorical)
    blocks = []
    for rows, values in singular_vectors.blocks(fitted):
        # Last row: what a category that is not listed adds here, namely nothing.
        table = np.vstack([rows @ weights, np.zeros(weights.shape[1])])
        blocks.append((table, pa.array(values, pa.string())))
    # Bounded by the inline width: (numeric and listed categories) x outputs.
    shared = df.sparkSession.sparkContext.broadcast(
        (singular_vectors.numeric(fitted) @ weights, blocks, weights)
    )
    kept, wide_count = len(keep), len(fitted.wide)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number_weights, category_blocks, vector_weights = shared.value
        for batch in batches:
            values = matrix_of(batch, kept, kept + numbers) @ number_weights
            for i, (table, known) in enumerate(category_blocks):
                codes = pc.index_in(batch.column(kept + numbers + i), value_set=known)
                values += table[pc.fill_null(codes, len(known)).to_numpy(zero_copy_only=False)]
            for i in range(wide_count):
                lists = batch.column(kept + numbers + texts + i)
                present = lists.is_valid().to_numpy(zero_copy_only=False)
                if present.any():
                    values[present] += matrix_of_lists(lists.drop_null()) @ vector_weights
            features = lists_of(finish(values).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:kept], features], [*batch.schema.names[:kept], output]
            )

    return frame.mapInArrow(project, _with_features(frame.schema[:kept], output))


def svd_features(
    df: DataFrame,
    fitted: FittedFeatures,
    singular_vectors: SingularVectors,
    keep: Iterable[str] = (),
    output: str = "features",
) -> DataFrame:
    """``keep`` plus the row's coordinates along the singular vectors as ``array<float>``."""
    unchanged = np.eye(singular_vectors.count)
    return _linear_features(
        df, fitted, singular_vectors, unchanged, lambda values: values, keep, output
    )


def fourier_features(
    df: DataFrame,
    fitted: FittedFeatures,
    singular_vectors: SingularVectors,
    weights: np.ndarray,
    offsets: np.ndarray,
    keep: Iterable[str] = (),
    output: str = "features",
) -> DataFrame:
    """``keep`` plus the Fourier features of these coordinates as ``array<float>``."""
    factor = np.sqrt(2.0 / len(offsets))
    return _linear_features(
        df, fitted, singular_vectors, weights,
        lambda angles: factor * np.cos(angles + offsets), keep, output,
    )


def rotate(
    df: DataFrame, rotations: np.ndarray, keep: Iterable[str] = (), features: str = "features",
    vectors: bool = False,
) -> DataFrame:
    """Every row once per rotation; ``rotation`` is the label the detector learns to tell.

    Features are ``array<float>``, or with ``vectors`` the same values as Spark ML's vectors.
    """
    keep = list(keep)
    made = vectors_of if vectors else lists_of
    frame = df.select(*keep, features)
    shared = df.sparkSession.sparkContext.broadcast(rotations)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, rows = batch.columns[:-1], matrix_of_lists(batch.columns[-1])
            for label, rotation in enumerate(shared.value):
                labels = pa.array(np.full(batch.num_rows, label, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*kept, labels, made(rows @ rotation)],
                    [*batch.schema.names[:-1], "rotation", features],
                )

    fields = [*frame.schema[: len(keep)], StructField("rotation", IntegerType(), False)]
    schema = StructType([*fields, StructField(features, VectorUDT(), False)]) if vectors else _with_features(fields, features)
    return frame.mapInArrow(expand, schema)


def _with_features(fields, output: str) -> StructType:
    return StructType([*fields, StructField(output, ArrayType(FloatType()), False)])
