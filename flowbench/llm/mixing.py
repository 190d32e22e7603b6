"""Mixing sources to target weights by entropy balancing.

Every document has a rate, the number of times the mix takes it. Among all rates between 0 and ``cap``
that give each source its target of tokens, entropy balancing takes those closest to 1 in relative
entropy. Their dual is a convex function of one multiplier per source, and the rates are an exponential
tilt, ``least(cap, exp(multiplier * size / scale))``. Newton steps, kept inside a proven bracket, solve
it: each is one aggregation over counts per (source, size), never over the documents again. The rates
are then rounded: systematic rounding in order of size leaves an error of less than one document per
source, a few single-document corrections make it smaller, and documents of equal source and size are
told apart by a hash of their id.

Targets: sources in code-point order, null last, take the weights in turn and share all tokens; a target
stops at ``cap`` times its source, and the excess is shared again by weight.

Only DataFrame operations. What grows with the documents is counted before any shuffle; equal (source,
size) documents are spread over ``SPREAD`` cells, so no key is hot. Null or empty texts have size 0 and
are taken once, which adds nothing. Null sources are a source. Rows with null or repeated ids are
documents like others; an empty table gives no rows. Extra columns may be carried along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowbench.llm.common import WORD, reserved
from flowbench.sources.tables import write_table

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
SPREAD = 256
MAX_STEPS = 60
TOLERANCE = 1e-9
CORRECTIONS = 3

KEY, SIZE, CELL = reserved("key"), reserved("size"), reserved("cell")


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A string that sorts as sources do by code point, null after all."""
    text = source.cast("string")
    return F.when(text.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), text))


def with_cells(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    return docs.withColumns(
        {
            KEY: source_key(docs[source_column]),
            SIZE: token_count(docs[text_column]),
            CELL: F.pmod(F.xxhash64(docs[id_column]), F.lit(SPREAD)),
        }
    )


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Add ``target`` to a table of one row per source with its ``source_size``.

    The share per weight grows until no free source is above its cap; each round is one aggregation.
    """
    rank = F.row_number().over(Window.orderBy(KEY))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank - 1, F.lit(len(weights))).cast("int") + 1)
    table = write_table(sources.withColumn("weight", weight), "mix-sources")
    limit = F.col("source_size") * F.lit(float(cap))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    share, capped = 0.0, -1
    while True:
        above = limit <= share * F.col("weight")
        count, fixed, free = table.agg(
            F.count_if(above), F.sum(F.when(above, limit).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))
        ).first()
        if count == capped or not free:
            break
        capped, share = count, (total - fixed) / free
    return table.withColumn("target", F.least(limit, F.lit(share) * F.col("weight")))


def multipliers(counts: DataFrame, sources: DataFrame, cap: float = CAP) -> DataFrame:
    """Solve the dual: one multiplier per source such that tilted rates give its target.

    ``counts``: KEY, SIZE, n. ``sources``: KEY, source_size, target. At ``scale * log(cap)`` every
    document of a token or more is at the cap; at ``scale * log(target / source_size)`` none exceeds
    that share: the root lies between.
    """
    squares = F.sum(F.col("n") * F.pow(F.col(SIZE).cast("double"), F.lit(2.0)))
    scale = counts.groupBy(KEY).agg(F.try_divide(squares, F.sum(F.col("n") * F.col(SIZE))).alias("scale"))
    part = F.try_divide("target", "source_size")
    state = sources.filter("target > 0").join(scale, KEY).select(
        KEY, "target", "scale",
        F.least(F.lit(0.0), F.col("scale") * F.log(part)).alias("low"),
        (F.col("scale") * F.lit(cap).cast("double")).alias("high"),
        F.when(part >= cap * (1 - 1e-12), F.col("scale") * F.lit(cap).cast("double")).otherwise(F.lit(0.0)).alias("multiplier"),
    )
    state = write_table(state, "mix-state")
    tilt = F.exp(F.col("multiplier") * F.col(SIZE) / F.col("scale"))
    tokens = F.col("n") * F.col(SIZE)
    for _ in range(MAX_STEPS):
        step = counts.join(state.select(KEY, "scale", "multiplier"), KEY).groupBy(KEY).agg(
            F.sum(tokens * F.least(F.lit(float(cap)), tilt)).alias("value"),
            F.sum(F.when(tilt < cap, tokens * F.col(SIZE) / F.col("scale") * tilt).otherwise(0.0)).alias("slope"),
        )
        moved = state.join(step, KEY).select(
            KEY, "target", "scale", "multiplier", "value", "slope",
            F.when(F.col("value") < F.col("target"), F.col("multiplier")).otherwise(F.col("low")).alias("low"),
            F.when(F.col("value") > F.col("target"), F.col("multiplier")).otherwise(F.col("high")).alias("high"),
        )
        newton = F.col("multiplier") - F.try_divide(F.col("value") - F.col("target"), F.col("slope"))
        inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        near = F.abs(F.col("value") - F.col("target")) <= TOLERANCE * F.col("target")
        state = write_table(
            moved.select(
                KEY, "target", "scale", "low", "high", near.alias("near"),
                F.when(near, F.col("multiplier")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2).alias("multiplier"),
            ),
            "mix-state",
        )
        if state.filter("not near").isEmpty():
            break
    return state.select(KEY, "scale", "multiplier")


def rounded(counts: DataFrame, sources: DataFrame, solved: DataFrame, cap: float = CAP) -> DataFrame:
    """Whole copies per (source, size): ``base`` for each document and one more for ``extra`` of them."""
    rate = F.coalesce(F.least(F.lit(float(cap)), F.exp(F.col("multiplier") * F.col(SIZE) / F.col("scale"))), F.lit(0.0))
    by_size = Window.partitionBy(KEY).orderBy(F.desc(SIZE))
    running = F.sum(F.col("n") * (F.col("rate") - F.floor("rate"))).over(by_size.rowsBetween(Window.unboundedPreceding, 0))
    table = (
        counts.join(solved, KEY, "left").withColumn("rate", F.when(F.col(SIZE) == 0, F.lit(1.0)).otherwise(rate))
        .withColumn("base", F.floor("rate")).withColumn("upto", F.floor(running + 0.5))
        .withColumn("extra", F.col("upto") - F.coalesce(F.lag("upto").over(by_size), F.lit(0)))
        .select(KEY, SIZE, "n", "base", "extra")
    )
    table = write_table(table, "mix-rounded")
    for _ in range(CORRECTIONS):
        taken = table.groupBy(KEY).agg(F.sum(F.col(SIZE) * (F.col("n") * F.col("base") + F.col("extra"))).alias("taken"))
        missing = sources.join(taken, KEY).select(KEY, (F.col("target") - F.col("taken")).alias("missing"))
        change = F.when(F.col("missing") > 0, F.lit(1)).otherwise(F.lit(-1))
        possible = F.when(F.col("missing") > 0, (F.col("extra") < F.col("n")) & (F.col("base") < cap)).otherwise(F.col("extra") > 0)
        after = F.abs(F.col("missing") - change * F.col(SIZE))
        best = (
            table.join(missing, KEY).filter((F.col(SIZE) > 0) & possible & (after < F.abs("missing")))
            .groupBy(KEY).agg(F.min(F.struct(after.alias("after"), F.col(SIZE).alias("at"), change.alias("change"))).alias("best"))
        )
        table = write_table(
            table.join(best, KEY, "left")
            .withColumn("extra", F.col("extra") + F.when(F.col(SIZE) == F.col("best.at"), F.col("best.change")).otherwise(0))
            .drop("best"),
            "mix-rounded",
        )
    return table


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: Sequence[float] = WEIGHTS,
    cap: int = CAP,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Per document: its id, size, source_size, target of its source, copies, and taken = copies * size.

    ``carry`` names further columns of ``docs``; then the result has those instead of the id alone, with
    the figures under reserved names (``__llm_copies`` and so on).
    """
    celled = with_cells(docs, id_column, text_column, source_column)
    cells = write_table(celled.groupBy(KEY, SIZE, CELL).agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    sources = targets(cells.groupBy(KEY).agg(F.sum(F.col(SIZE) * F.col("n")).alias("source_size")), weights, cap)
    counts = write_table(cells.groupBy(KEY, SIZE).agg(F.sum("n").alias("n")), "mix-counts")
    copies = rounded(counts, sources, multipliers(counts, sources, cap), cap)
    in_order = Window.partitionBy(KEY, SIZE).orderBy(CELL)
    before = F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    lots = cells.withColumn("before", before).join(copies.drop("n"), [KEY, SIZE]).join(sources.select(KEY, "source_size", "target"), KEY).select(
        KEY, SIZE, CELL,
        F.col("source_size").alias(reserved("source_size")),
        F.col("target").alias(reserved("target")),
        F.col("base").alias(reserved("base")),
        F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.col("before"))).alias(reserved("extra")),
    )
    lots = write_table(lots, "mix-lots")
    kept = list(dict.fromkeys(carry)) or [id_column]
    rows = celled.select(*kept, KEY, SIZE, CELL, F.xxhash64(celled[id_column], F.lit(1)).alias(reserved("order")), celled[id_column].alias(reserved("id")))
    place = F.row_number().over(Window.partitionBy(KEY, SIZE, CELL).orderBy(reserved("order"), reserved("id")))
    chosen = rows.join(lots, [KEY, SIZE, CELL]).withColumn(
        reserved("copies"), (F.col(reserved("base")) + (place <= F.col(reserved("extra"))).cast("long")).cast("long")
    )
    if carry:
        return chosen.select(*kept, SIZE, *(reserved(c) for c in ("source_size", "target", "copies")))
    return chosen.select(
        F.col(id_column), F.col(SIZE).alias("size"), F.col(reserved("source_size")).alias("source_size"),
        F.col(reserved("target")).alias("target"), F.col(reserved("copies")).alias("copies"),
        (F.col(reserved("copies")) * F.col(SIZE)).alias("taken"),
    )
