"""Approximate nearest neighbours by largest inner product: collision-counting hashing.

Vectors get one more component that makes all norms equal, so that the largest inner product is the
smallest distance. Each of some random directions gives a sorted array of projections. A query opens a
window around its own projection in every array; a vector collides where it lies in the window. Windows
grow by virtual rehashing (the radius times ``GROWTH``) until enough vectors collide in at least
``THRESHOLD`` of the arrays; those are verified by exact inner products in double precision. Equal vectors
of a block are indexed and counted once, so that a group of copies does not stand for enough of them.

Directions come as whole orthogonal frames: over a frame the squared projections of a difference add up to
its length, so counts tell near from far with far fewer arrays than independent directions would need. The
first radius is that of the distance within which a sample of the block has the wanted share.

A window is a range of an array's ``CELLS`` cells, rounded outwards. Each array keeps, per cell border, the
set of vectors below it as bits, so a window's members are the difference of two such sets, and 64 vectors
are counted by one addition: all arrays' windows are summed in bit planes, without a step per vector.

Rows are spread over blocks by their norm and a hash of their id, each with its own arrays, and queries
over groups; a task has one block and one group, so its memory is bounded. Norms of a block differ by a
factor of ``BAND`` at most and are made equal to its own largest, so that the further component stays
small whatever norms the table holds. Bands with ``k`` rows or fewer share a block, which is verified
whole. Every row is indexed and every query meets every block: a stated query set against all rows.
Blocks give their best ``k`` of each query, and the best of these are the result, nearest first, equal
scores by smaller id.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, nor do rows without id. A query's own row is every row of its id. Of several vectors of a query's id
the smallest asks. An empty table gives no rows, fewer than ``k`` other rows give all. Extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least number of sorted arrays; they come in whole frames.
PROJECTIONS = 128
GROWTH = 1.02
#: Largest ratio of two norms in a block.
BAND = 1.1
THRESHOLD = 0.85
#: First radius for a distance of one: about what a vector at that distance needs to pass the threshold.
RADIUS = 1.38
#: Distinct vectors that have to pass the threshold before windows stop growing: a share of the block's, and per ``k``.
ENOUGH = 0.02
ENOUGH_PER_K = 4
#: Distinct vectors of a block whose distances give the first radius.
SAMPLE = 512
CELLS = 64
#: Queries counted at a time.
BATCH = 512
BLOCK_ROWS = 16384
GROUP_QUERIES = 32768
SEED = 3

RESULT = "query_id long, vec_id long, score double"


def usable(vector: Column, length: int) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = (F.size(vector) == length) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


def directions(length: int, least: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    """Orthogonal frames of one more dimension, at least ``least`` columns, each as long as a normal one on average."""
    rng, size = np.random.default_rng(seed), length + 1
    frames = [np.linalg.qr(rng.normal(size=(size, size)))[0] for _ in range(-(-least // size))]
    return np.concatenate(frames, axis=1) * np.sqrt(size)


class Planes:
    """Sums of bits at the same place of many arrays, as binary digits: plane ``i`` has the digit of ``2**i``.

    Three arrays of a plane become one of it and one of the next, so an array costs a few operations on
    whole words. Arrays handed over are used up.
    """

    def __init__(self, shape: tuple[int, int]):
        self.shape = shape
        self.free: list[np.ndarray] = []
        self.planes: list[list[np.ndarray]] = []

    def room(self) -> np.ndarray:
        return self.free.pop() if self.free else np.empty(self.shape, np.uint64)

    def add(self, bits: np.ndarray, plane: int = 0) -> None:
        if plane == len(self.planes):
            self.planes.append([])
        held = self.planes[plane]
        held.append(bits)
        if len(held) == 3:
            a, b, c = held
            either = np.bitwise_xor(a, b, out=self.room())
            carry = np.bitwise_and(a, b, out=a)
            carry |= np.bitwise_and(either, c, out=b)
            c ^= either
            self.free += [either, b]
            self.planes[plane] = [c]
            self.add(carry, plane + 1)

    def at_least(self, number: int) -> np.ndarray:
        """The places, as bits, whose sum is ``number`` or more."""
        plane = 0
        while plane < len(self.planes):  # an empty third array settles planes that hold two
            if len(self.planes[plane]) == 2:
                none = self.room()
                none[:] = 0
                self.add(none, plane)
            plane += 1
        digits = max(len(self.planes), number.bit_length())
        out = np.full(self.shape, ~np.uint64(0))
        for plane in range(digits):  # from the lowest: a higher digit that differs decides
            bits = self.planes[plane][0] if plane < len(self.planes) else np.uint64(0)
            out = out & bits if number >> plane & 1 else out | bits
        return out


class Index:
    """The sorted projections of one block's distinct vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS, cells: int = CELLS):
        vectors = np.ascontiguousarray(vectors + 0.0)  # one zero only: copies are found by their bytes
        raw = vectors.view(np.dtype((np.void, vectors.strides[0]))).ravel()
        _, first, kind_of, self.copies = np.unique(raw, return_index=True, return_inverse=True, return_counts=True)
        self.owners = np.unique(np.stack([ids, kind_of], axis=1), axis=0)[:, 0]  # an id per distinct vector of it
        self.members = ids[np.argsort(kind_of, kind="stable")]  # ids of each distinct vector in turn
        self.ends = np.cumsum(self.copies)
        self.vectors = vectors = vectors[first]
        self.lines = directions(vectors.shape[1], projections)
        scaled = vectors / np.abs(vectors).max()  # squares neither overflow nor vanish
        squares = (scaled**2).sum(axis=1)
        self.norm = float(np.sqrt(squares.max()))
        rest = np.sqrt(squares.max() - squares)
        self.sample = scaled[:: -(-len(vectors) // SAMPLE)]
        lines = np.ascontiguousarray((np.concatenate([scaled, rest[:, None]], axis=1) @ self.lines).T)
        rows = len(vectors)
        borders = np.arange(cells + 1) * rows // cells  # places in a sorted array; the last cell ends after all
        self.edges = np.empty((len(lines), cells - 1))
        below = np.zeros((len(lines), cells + 1, -(-rows // 64) * 8), np.uint8)
        place = np.empty(rows, np.int64)
        for line, edges, sets in zip(lines, self.edges, below):
            order = np.argsort(line, kind="stable")
            edges[:] = line[order[borders[1:-1]]]
            place[order] = np.arange(rows)
            sets[:, : -(-rows // 8)] = np.packbits(place < borders[:, None], axis=1, bitorder="little")
        self.below = below.view(np.uint64)

    def first_radius(self, asked: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Radius of the first windows: from the distance within which the sample has the ``share``."""
        products = asked @ self.sample.T
        products.sort(axis=1)
        last = np.clip(products.shape[1] - np.ceil(share * products.shape[1]), 0, products.shape[1] - 1).astype(np.int64)
        near = products[np.arange(len(asked)), last]  # of vectors of one norm: the distance follows from the product
        return RADIUS * np.sqrt(np.maximum(2 * (self.norm**2 - near), 1e-6 * self.norm**2))

    def colliding(self, centres: np.ndarray, radius: np.ndarray, need: int) -> np.ndarray:
        """The vectors, as bits, that are in at least ``need`` of each query's windows; ``centres`` has a line per array."""
        planes = Planes((centres.shape[1], self.below.shape[2]))
        for centre, edges, sets in zip(centres, self.edges, self.below):
            low = edges.searchsorted(centre - radius, "left")
            high = edges.searchsorted(centre + radius, "right") + 1
            inside = sets.take(high, axis=0, out=planes.room(), mode="clip")
            outside = sets.take(low, axis=0, out=planes.room(), mode="clip")
            inside ^= outside
            planes.free.append(outside)
            planes.add(inside)
        return planes.at_least(need)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the best ``k`` verified vectors of each query, its own rows left out."""
        own = self.owners.searchsorted(query_ids, "right") - self.owners.searchsorted(query_ids, "left")
        enough = own + ENOUGH_PER_K * k + int(ENOUGH * len(self.vectors))
        everyone = np.arange(len(self.vectors))
        out = []

        def keep(at: int, found: np.ndarray) -> None:
            ids, scores = self.verify(found, int(query_ids[at]), queries[at], k, int(own[at]))
            out.append((np.full(len(ids), query_ids[at]), ids, scores))

        for at in np.flatnonzero(enough >= len(everyone)):
            keep(at, everyone)
        searched = np.flatnonzero(enough < len(everyone))
        need = int(np.ceil(THRESHOLD * len(self.edges)))
        for start in range(0, len(searched), BATCH):
            waiting = searched[start : start + BATCH]
            asked = queries[waiting] / np.abs(queries[waiting]).max(axis=1)[:, None]
            asked *= (self.norm / np.linalg.norm(asked, axis=1))[:, None]
            centres = np.ascontiguousarray((asked @ self.lines[:-1]).T)
            radius = self.first_radius(asked, enough[waiting] / len(everyone))
            while len(waiting):
                met = self.colliding(centres, radius, need)
                ready = np.bitwise_count(met).sum(axis=1, dtype=np.int64) >= enough[waiting]
                for at, bits in zip(waiting[ready], met[ready]):
                    keep(at, np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little")))
                waiting, centres, radius = waiting[~ready], centres[:, ~ready], radius[~ready] * GROWTH
        return tuple(np.concatenate(column) for column in zip(*out))

    def verify(self, found: np.ndarray, query_id: int, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Best ``k`` rows of the distinct vectors found, of which ``own`` may hold rows of the query's id alone."""
        scores = (self.vectors[found] * query).sum(axis=1)  # row by row, so equal vectors of all blocks score equally
        if len(found) > k + own:
            near = scores >= -np.partition(-scores, k + own - 1)[k + own - 1]
            found, scores = found[near], scores[near]
        copies = self.copies[found]
        upto = np.cumsum(copies)
        ids = self.members[np.repeat(self.ends[found] - upto, copies) + np.arange(copies.sum())]
        others = ids != query_id
        ids, scores = ids[others], np.repeat(scores, copies)[others]
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best]


def band_of(vector: Column) -> Column:
    """Number of the range of norms a vector is in; a norm of one is in the middle of a range."""
    largest = F.array_max(F.transform(vector, F.abs))
    square = lambda m: F.aggregate(vector, F.lit(0.0), lambda total, x: total + (x / m) * (x / m))
    log = F.get(F.transform(F.array(largest), lambda m: F.log(m) + F.log(square(m)) / 2), F.lit(0))
    return F.floor(log / float(np.log(BAND)) + 0.5).cast("int")


def band_blocks(rows_in: dict[int, int], block_rows: int, k: int) -> tuple[list[tuple[int, int, int]], int]:
    """(band, its first block, its blocks), and the number of blocks; bands with ``k`` rows together share one."""
    out, total, shared = [], 0, k
    for band, rows in sorted(rows_in.items()):
        if shared + rows <= k:
            out.append((band, total - 1, 1))
            shared += rows
        else:
            blocks = rows // block_rows + 1
            out.append((band, total, blocks))
            total, shared = total + blocks, rows
    return out, total


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding",
            block_rows: int = BLOCK_ROWS, group_queries: int = GROUP_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found for the rows where ``is_query`` holds."""
    rows = vectors.select(
        vectors[id_column].cast("long").alias("id"), vectors[vector_column].cast("array<double>").alias("vector"), is_query.alias("asks")
    ).filter("id is not null")
    lengths = rows.filter("vector is not null").groupBy(F.size("vector").alias("n")).count()
    common = lengths.orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.filter(usable(F.col("vector"), common["n"] if common else 0))
    rows = rows.withColumn("band", band_of(F.col("vector")))
    counts = rows.groupBy("band").agg(F.count(F.lit(1)), F.count_if(F.coalesce("asks", F.lit(False)))).collect()
    bands, blocks = band_blocks({band: n for band, n, _ in counts}, block_rows, k)
    groups = sum(n for _, _, n in counts) // group_queries + 1
    spread = lambda n: F.sequence(F.lit(0), F.lit(max(n, 1) - 1))
    mine = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    places = vectors.sparkSession.createDataFrame(bands, "band int, first int, blocks int")  # as many as norms have ranges
    block = (F.col("first") + mine(F.col("blocks"))).alias("block")
    data = rows.join(F.broadcast(places), "band").select("id", "vector", block, F.explode(spread(groups)).alias("part"))
    own = [F.col(c).alias(c) for c in ("id", "vector")]  # columns apart from those of the data
    asks = rows.filter("asks").groupBy("id").agg(F.min("vector").alias("vector")).select(*own, mine(F.lit(groups)).alias("part"), F.explode(spread(blocks)).alias("block"))

    def search(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if block.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        index = Index(block["id"].to_numpy(), np.stack(block["vector"].to_numpy()))
        found = index.search(queries["id"].to_numpy(), np.stack(queries["vector"].to_numpy()), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    found = data.groupBy("block", "part").cogroup(asks.groupBy("block", "part")).applyInPandas(search, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
