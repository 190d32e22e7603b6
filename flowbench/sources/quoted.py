"""CSV files with line breaks inside quotes, read in parallel byte ranges.

Whether a line break ends a record depends on all quotes before it. Each byte range of a file therefore says
first whether it holds an odd number of quotes; a running parity over the ranges of a file then tells
whether a range begins inside quotes, and each range finds its records on its own. Only what lies across
a border is put together afterwards: the unfinished end of a range with the beginnings of those after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ranges whose parity is broadcast (some 100 bytes each): 128 TB at 128 MB a range.
MAX_RANGES = 1 << 20
#: What a piece of text is: a whole record, what ends a record of a range before, an unfinished record, an
#: unfinished header.
RECORD, REST, OPEN, OPEN_HEADER = range(4)

PIECES = "path string, start long, kind int, text binary"


def byte_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines as bytes, in the order of the file within each of its ranges; carriage returns stay."""
    text = spark.read.option("lineSep", "\n").text(paths)
    place = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")
    return text.select(F.col("value").cast("binary").alias("line"), *place)


def ranges_of(lines: DataFrame) -> DataFrame:
    """(path, start, inside): does a range begin inside quotes?"""
    odd = (F.regexp_count(F.col("line").cast("string"), F.lit('"')) % 2).cast("int")
    parity = lines.groupBy("path", "start").agg(F.bit_xor(odd).alias("odd"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return parity.select("path", "start", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))


class Range:
    """The records of one byte range, from its lines in order."""

    def __init__(self, path: str, start: int, inside: bool):
        self.path, self.start = path, start
        self.kind = REST if inside else RECORD
        self.inside, self.waiting = inside, []
        self.header = start == 0

    def _piece(self, kind: int, text: bytes) -> Iterator[tuple[int, bytes]]:
        text = text.removesuffix(b"\r")
        if kind == RECORD and not text.strip():
            return
        if kind == RECORD and self.header:
            self.header = False
            return
        yield kind, text

    def add(self, lines: pa.Array) -> Iterator[tuple[int, list[bytes] | pa.Array]]:
        """Pieces that end in these lines; runs of records of one line come as an array."""
        odd = pc.count_substring(lines, b'"').to_numpy(zero_copy_only=False) % 2
        ends = (np.cumsum(odd) + self.inside) % 2 == 0
        alone = ends.copy()
        alone[1:] &= ends[:-1]
        alone[0] &= not self.inside and not self.waiting
        at = 0
        while at < len(ends):
            if alone[at] and not self.header:
                rest = np.flatnonzero(~alone[at:])
                upto = at + int(rest[0]) if len(rest) else len(ends)
                yield RECORD, lines.slice(at, upto - at)
                at = upto
                continue
            self.waiting.append(lines[at].as_py())
            if ends[at]:
                for kind, text in self._piece(self.kind, b"\n".join(self.waiting)):
                    yield kind, [text]
                self.waiting, self.kind = [], RECORD
            at += 1
        self.inside = not ends[-1]

    def end(self) -> Iterator[tuple[int, bytes]]:
        if self.waiting:
            kind = REST if self.kind == REST else OPEN_HEADER if self.header else OPEN
            yield kind, b"\n".join(self.waiting)


def without_blank(lines: pa.Array) -> pa.Array:
    """Lines without a last carriage return, and without those that have nothing but white space."""
    bare = pc.binary_replace_slice(lines, -1, np.iinfo(np.int64).max, b"")
    lines = pc.if_else(pc.ends_with(lines, b"\r"), bare, lines)
    blank = [not line.strip() for line in lines.to_pylist()]
    return lines.filter(pc.invert(pa.array(blank, pa.bool_())))


def pieces_of(lines: DataFrame) -> DataFrame:
    """``PIECES`` of all lines; ``lines`` says of each whether its range begins inside quotes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: Range | None = None

        def rows(found, of: Range) -> Iterator[pa.RecordBatch]:
            for kind, texts in found:
                texts = without_blank(texts) if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([of.path] * n, pa.string()), pa.array([of.start] * n, pa.int64()), pa.array([kind] * n, pa.int32()), texts],
                    names=["path", "start", "kind", "text"],
                )

        for batch in batches:
            if not batch.num_rows:
                continue
            start = batch.column(2).to_numpy()
            path = batch.column(1).dictionary_encode()
            names = path.indices.to_numpy()
            cuts = np.flatnonzero((start[1:] != start[:-1]) | (names[1:] != names[:-1])) + 1
            edges = [0, *cuts.tolist(), batch.num_rows]
            for low, high in zip(edges[:-1], edges[1:]):
                place = path.dictionary[int(names[low])].as_py(), int(start[low])
                if current is None or (current.path, current.start) != place:
                    if current is not None:
                        yield from rows([(k, [t]) for k, t in current.end()], current)
                    current = Range(*place, batch.column(3)[low].as_py())
                yield from rows(current.add(batch.column(0).slice(low, high - low)), current)
        if current is not None:
            yield from rows([(k, [t]) for k, t in current.end()], current)

    return lines.select("line", "path", "start", "inside").mapInArrow(run, PIECES)


def records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, text): the records of the files as bytes, without their headers and without blank lines."""
    lines = byte_lines(spark, paths)
    ranges = ranges_of(lines).persist()
    if ranges.count() > MAX_RANGES:
        raise ValueError(f"more than {MAX_RANGES} byte ranges: raise spark.sql.files.maxPartitionBytes")
    # another layout of ranges than the parities were counted in must not go unseen
    known = F.when(F.col("inside").isNull(), F.raise_error(F.lit("the byte ranges changed between two passes")).cast("boolean"))
    placed = lines.join(F.broadcast(ranges), ["path", "start"], "left").withColumn("inside", known.otherwise(F.col("inside")))
    pieces = pieces_of(placed)
    whole = pieces.filter(F.col("kind") == RECORD).select("path", "text")
    order = Window.partitionBy("path").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.when(F.col("kind") >= OPEN, F.col("start"))
    across = pieces.filter(F.col("kind") != RECORD).withColumn("begin", F.last(begins, ignorenulls=True).over(order))
    parts = F.array_sort(F.collect_list(F.struct("start", "text")))
    joined = across.groupBy("path", "begin").agg(F.max("kind").alias("kind"), parts.alias("parts"))
    text = F.reduce(
        F.slice("parts", F.lit(2), F.size("parts")), F.get("parts", F.lit(0))["text"],
        lambda before, part: F.concat(before, F.lit(b"\n"), part["text"]),
    )
    return whole.unionByName(joined.filter(F.col("kind") < OPEN_HEADER).select("path", text.alias("text")))
