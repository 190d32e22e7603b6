"""Singular vectors when some feature has too many categories for one machine.

A one-hot block of a column with millions of values cannot be a vector on the driver, nor can its
singular vectors be broadcast. The basis is therefore kept in two parts: a matrix with the rows of the
numeric features and listed categories, whose number the fit bounds, and a table with the rows of all
other categories. A pass of the randomised range finder multiplies every row of the data with the basis
and adds the product to each of the row's categories, so it handles one cell per row and wide feature;
pairs of categories are never formed. Products of a batch are added up per category before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import lists_of, matrix_of, matrix_of_lists
from ..sources.tables import new_path, read_back, write_table
from .encoding import look_up
from .features import FittedFeatures, assemble, number, prepared, text
from .quantile import MERGE_GROUPS

OVERSAMPLING = 10
#: Iterations stop when the captured energy changes by less than this share, or raise at the limit.
TOLERANCE = 1e-10
MAX_ITERATIONS = 200
KEY = ("feature", "value")
#: Stands for a feature where a sum belongs to the matrix of numeric features and listed categories.
DENSE = -1


def component_count(width: int, wanted: int) -> int:
    return min(wanted, max(2, width - 1), width)


def fix_signs(vectors: np.ndarray) -> np.ndarray:
    """Make the entry of largest size positive in every column."""
    largest = np.abs(vectors).argmax(axis=0)
    return vectors * np.where(vectors[largest, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def _rows_and_cells(df: DataFrame, fitted: FittedFeatures) -> tuple[DataFrame, DataFrame]:
    """Stored rows with an id, and their cells (id, feature, value) of categories that are not listed."""
    frame = prepared(df, fitted).select(F.monotonically_increasing_id().alias("id"), "*")
    rows = write_table(frame, "wide-rows")
    cells = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(text(i)).alias("value")) for i in fitted.wide])
    cells = rows.select("id", F.inline(cells)).filter(~_is_listed(fitted, F.col("feature"), F.col("value")))
    return rows, cells


def _is_listed(fitted: FittedFeatures, feature: Column, value: Column) -> Column:
    """Whether the driver knows this category of a wide feature, as it is hot."""
    known = [(feature == i) & value.isin(list(fitted.categorical[i].listed)) for i in fitted.wide]
    return F.coalesce(reduce(Column.__or__, known), F.lit(False))


def _start(cells: DataFrame, size: int) -> DataFrame:
    """A basis of +1 / -1 entries that depend on the category only, so that a retry repeats them."""
    signs = [
        F.when(F.xxhash64(*KEY, F.lit(j)) % 2 == 0, 1.0).otherwise(-1.0) for j in range(size)
    ]
    return cells.select(*KEY).distinct().withColumn("y", F.array(*signs))


def _gram(table: DataFrame, size: int) -> np.ndarray:
    """y' y (size x size) over all categories of the table."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            y = matrix_of_lists(batch.column(0)).reshape(-1, size)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([lists_of(total.reshape(1, -1))], ["part"])

    parts = table.select("y").mapInArrow(partial, "part array<double>")
    merged = (  # at most MERGE_GROUPS rows; none if the table is empty
        parts.groupBy((F.spark_partition_id() % MERGE_GROUPS).alias("merge_group"))
        .agg(Summarizer.sum(array_to_vector("part")).alias("part"))
        .select(vector_to_array("part").alias("part"))
        .collect()
    )
    return sum((np.array(row["part"]) for row in merged), np.zeros(size * size)).reshape(size, size)


def _orthonormal(gram: np.ndarray) -> np.ndarray:
    """Matrix that turns columns of this Gram matrix into orthonormal ones, strongest first."""
    values, vectors = np.linalg.eigh(gram)
    useful = values > values[-1] * 1e-14
    return (vectors[:, useful] / np.sqrt(values[useful]))[:, ::-1]


def _sums_by(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, and the sums of the rows of ``values`` that have each of them."""
    order = np.argsort(codes, kind="stable")
    known, first = np.unique(codes[order], return_index=True)
    return known, np.add.reduceat(values[order], first, axis=0) if len(known) else values[:0]


def _multiply(
    rows: DataFrame, cells: DataFrame, table: DataFrame, fitted: FittedFeatures,
    turn: np.ndarray, dense: np.ndarray,
) -> tuple[DataFrame, np.ndarray]:
    """X'X times the basis ``y @ turn``: its table, and its rows of numeric features and listed categories.

    A category that is not listed holds less than a fixed share of the rows, so the joins have no hot key.
    """
    size, kept = turn.shape
    met = (
        cells.join(table, list(KEY))
        .groupBy("id")
        .agg(*[F.sum(F.col("y")[j]).alias(f"p{j}") for j in range(size)])
        .select("id", F.array(*[f"p{j}" for j in range(size)]).alias("met"))
    )
    numbers, wide = len(fitted.numeric), set(fitted.wide)
    ends = np.cumsum([numbers, *(len(f.listed) for f in fitted.categorical)])
    # Bounded by the inline width: (numeric and listed categories) x basis.
    shared = rows.sparkSession.sparkContext.broadcast(
        (dense @ turn, [pa.array(f.listed, pa.string()) for f in fitted.categorical])
    )

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, known = shared.value
        sums = np.zeros((len(basis), kept))
        for batch in batches:
            n = batch.num_rows
            values = matrix_of(batch, 1, 1 + numbers)
            product = values @ basis[:numbers]
            codes = []
            for i, listed in enumerate(known):
                found = pc.index_in(batch.column(1 + numbers + i), value_set=listed)
                codes.append(pc.fill_null(found, -1).to_numpy(zero_copy_only=False))
                present = codes[i] >= 0
                product[present] += basis[ends[i] + codes[i][present]]
            partners = batch.column(1 + numbers + len(known))
            present = partners.is_valid().to_numpy(zero_copy_only=False)
            if present.any():
                product[present] += matrix_of_lists(partners.drop_null()) @ turn
            sums[:numbers] += values.T @ product
            for i, code in enumerate(codes):
                present = code >= 0
                places, added = _sums_by(code[present], product[present])
                sums[ends[i] + places] += added
                if i in wide and not present.all():
                    rest = pc.filter(batch.column(1 + numbers + i), pa.array(~present)).dictionary_encode()
                    places, added = _sums_by(rest.indices.to_numpy(), product[~present])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(places), i, np.int32)), rest.dictionary.take(pa.array(places)), lists_of(added)],
                        [*KEY, "y"],
                    )
        places = np.arange(len(sums))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(sums), DENSE, np.int32)), pa.array(places.astype(str).tolist(), pa.string()), lists_of(sums)],
            [*KEY, "y"],
        )

    numbered = [number(i) for i in range(numbers)] + [text(i) for i in range(len(fitted.categorical))]
    joined = rows.join(met, "id", "left").select("id", *numbered, "met")
    parts = joined.mapInArrow(step, "feature int, value string, y array<double>")
    total = parts.groupBy(*KEY).agg(*[F.sum(F.col("y")[j]).alias(f"y{j}") for j in range(kept)])
    stored = write_table(total.select(*KEY, F.array(*[f"y{j}" for j in range(kept)]).alias("y")), "basis")
    found = stored.filter(F.col("feature") == DENSE).collect()  # numeric features and listed categories
    out = np.zeros((len(dense), kept))
    for row in found:
        out[int(row["value"])] = row["y"]
    return stored.filter(F.col("feature") != DENSE), out


def singular_vectors(
    df: DataFrame, fitted: FittedFeatures, wanted: int
) -> tuple[np.ndarray, str]:
    """Vectors of the numeric features and listed categories; path of the table with the other categories."""
    rows, cells = _rows_and_cells(df, fitted)
    known = len(fitted.numeric) + sum(len(f.listed) for f in fitted.categorical)
    others = cells.select(*KEY).distinct().count()
    wanted = component_count(known + others, wanted)  # as for vectors on the driver
    size = min(wanted + OVERSAMPLING, known + others)
    table = _start(cells, size)
    dense = np.where(np.random.default_rng(0).random((known, size)) < 0.5, -1.0, 1.0)
    energy = 0.0
    for _ in range(MAX_ITERATIONS):
        gram = dense.T @ dense + _gram(table, size)
        # of the Gramian times an orthonormal basis: the singular values of the strongest directions
        before, energy = energy, float(np.sqrt(np.sort(np.linalg.eigvalsh(gram))[::-1][:wanted].clip(0)).sum())
        turn = _orthonormal(gram)
        table, dense = _multiply(rows, cells, table, fitted, turn, dense)
        size = turn.shape[1]
        if abs(energy - before) <= TOLERANCE * energy:
            break
    else:
        raise RuntimeError("The singular vectors did not settle")
    turn = _orthonormal(dense.T @ dense + _gram(table, size))[:, :wanted]
    dense = dense @ turn

    path = new_path(df.sparkSession, "category-vectors")
    vectors = table.select(*KEY, "y").mapInArrow(
        _turned(turn), "feature int, value string, vector array<double>"
    )
    vectors.write.parquet(path)
    vectors = read_back(df.sparkSession, path, vectors.schema)
    ends = vectors.agg(
        *[F.max(F.col("vector")[j]).alias(f"high{j}") for j in range(turn.shape[1])],
        *[F.min(F.col("vector")[j]).alias(f"low{j}") for j in range(turn.shape[1])],
    ).first()
    signs = np.ones(turn.shape[1])
    for j in range(turn.shape[1]):
        entries = [x for x in (ends[f"low{j}"], ends[f"high{j}"], *dense[:, j]) if x is not None]
        if -min(entries) > max(entries):
            signs[j] = -1.0
    signed = new_path(df.sparkSession, "category-vectors")
    flipped = F.transform("vector", lambda x, j: x * F.element_at(F.lit(signs.tolist()), j + 1))
    vectors.withColumn("vector", flipped).write.parquet(signed)
    return dense * signs, signed


def gramian(df: DataFrame, fitted: FittedFeatures) -> np.ndarray:
    """X'X of the assembled vectors, which the driver holds: width x width, width bounded by the fit."""
    vectors = MLUtils.convertVectorColumnsFromML(assemble(df, fitted), "features")
    return RowMatrix(vectors, 0, fitted.width).computeGramianMatrix().toArray()


def _turned(turn: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = lists_of(matrix_of_lists(batch.column(2)) @ turn)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], rows], ["feature", "value", "vector"]
            )

    return run


def attach_vectors(
    frame: DataFrame, fitted: FittedFeatures, position: int, table: str, heavy: list[str] = ()
) -> DataFrame:
    """Add ``__flow_v<position>``: the vector of the row's category, NULL if it is listed or unknown.

    Listed values need no lookup. Those that are ``heavy`` in this frame are looked up in a broadcast part
    of the table, so what the join shuffles are values below one in HOT_SHARE rows, here as in fitting.
    """
    result = f"__flow_v{position}"
    vectors = (
        frame.sparkSession.read.schema("feature int, value string, vector array<double>")
        .parquet(table)
        .filter(F.col("feature") == position)
        .select("value", F.col("vector").alias(result))
    )
    return look_up(frame, text(position), vectors, result, list(heavy), list(fitted.categorical[position].listed))
