"""Near-duplicate documents by min-max hashing.

A text's set holds its distinct runs of five words. Under each permutation both the minimum and the
maximum are kept, so that half as many hashes are computed for signatures of the same length and lower
variance. Values of ``ROWS`` different permutations make a band; texts that share a band are candidates.
At a similarity of 0.75 a pair shares none of the bands with a chance of about 1e-6.

Equal sets form a class, and classes take part once, by their smallest id. Small buckets give all their
pairs. A larger bucket ties every member to its smallest one, and if it is very large also to a few members
drawn by a hash; the links that full sets confirm make components. Then all pairs across the components of a
bucket that are still untried are compared, so no candidate is left out, and a large group of copies
costs a few comparisons per member.
Around a large group lie copies with more edits, which are candidates of all and linked with few. There
a pivot bounds what two sets can share: the smaller of what they share with the pivot, and what bitmaps
say of the rest. A pair whose bound is below ``LINK`` is no link for certain and is never formed.
Before sets are compared, one bit per value of both signatures is: at 0.75 more than ``BITS_APART`` of
them differ with a chance of about 1e-8. Hot classes and buckets are only counted and joined (partial
sums before the shuffle, joins that Spark can split), never gathered.

Null, empty and wordless texts have an empty set and are linked with nothing. Repeated rows are copies
of each other; rows with a null id have no component and are not kept. An empty table gives no rows.
An id that
stands for several texts is one node, linked by any of them. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbench.llm import words as W
from flowbench.llm.components import components
from flowbench.sources.tables import write_table

SHINGLE = 5
ROWS = 5
BANDS = 50
#: A link: 100 * intersection >= LINK * union.
LINK = 75
#: Buckets of at most this many classes give all pairs at once.
SMALL_BUCKET = 6
#: Members of larger buckets are compared with so many drawn ones too, and measured against a pivot before
#: pairs across their components are formed, in so many cells a side.
PIVOT_BUCKET = 64
DRAWS = 2
CELLS = 4
#: Words of the bitmap of a set's elements outside the pivot.
EXTRA_WORDS = 16
#: One bit of each signature value, packed in words of 64; a pair at ``LINK`` differs in an eighth of them.
BIT_WORDS = 4
BITS_APART = 64
#: Set elements hashed at a time.
BLOCK = 1 << 15
GROUP_BYTES = 1 << 19

SIGNATURE = "id long, n_shingles long, set_a long, set_b long, bands array<long>, bits array<long>"
BITS = [f"bits{w}" for w in range(BIT_WORDS)]


def permutations(count: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda: rng.integers(0, 1 << 63, count, dtype=np.uint64)
    return draw() << np.uint64(1) | np.uint64(1), draw()


def band_keys(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(set, band) keys and (set, word) bits; every set has an element.

    One permutation serves two places of the signature.
    """
    half = -(-bands * rows // 2)
    factor, mask = permutations(half)
    values = np.empty((len(sets), 2 * half), np.uint64)
    at = 0
    while at < len(sets):
        upto, filled = at, 0
        while upto < len(sets) and (upto == at or filled + len(sets[upto]) <= BLOCK):
            filled += len(sets[upto])
            upto += 1
        flat = np.concatenate(sets[at:upto])
        starts = np.cumsum([0, *(len(s) for s in sets[at : upto - 1])])
        for p in range(half):
            hashed = (flat ^ mask[p]) * factor[p]
            values[at:upto, p] = np.minimum.reduceat(hashed, starts)
            values[at:upto, half + p] = np.maximum.reduceat(hashed, starts)
        at = upto
    keys = np.zeros((len(sets), bands), np.uint64)
    for b in range(bands):
        for r in range(rows):
            keys[:, b] = W.mix64(keys[:, b] + values[:, b * rows + r] + np.uint64(b + 1))
    bits = np.zeros((len(sets), BIT_WORDS), np.uint64)
    for v in range(min(2 * half, 64 * BIT_WORDS)):
        bits[:, v // 64] |= (W.mix64(values[:, v]) & np.uint64(1)) << np.uint64(v % 64)
    return keys, bits


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(place of the first text, sets) for groups of the texts."""
    data, limits = W.text_bytes(column)
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(limits, limits[at] + GROUP_BYTES, "right")) - 1)
        part, edges = W.LOWER[data[limits[at] : limits[upto]]], limits[at : upto + 1] - limits[at]
        words = W.find_words(part, edges)
        yield at, W.shingles(W.word_hashes(part, words), words, SHINGLE)
        at = upto


def signatures(docs: DataFrame, id_column: str, text_column: str, bands: int = BANDS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in shingle_sets(batch.column(1)):
                full = [k for k, s in enumerate(sets) if len(s)]
                keys: list[np.ndarray | None] = [None] * len(sets)
                bits: list[np.ndarray | None] = [None] * len(sets)
                if full:
                    for k, key_row, bit_row in zip(full, *band_keys([sets[k] for k in full], bands)):
                        keys[k], bits[k] = key_row.view(np.int64), bit_row.view(np.int64)
                digest = np.array(
                    [(W.mix64(s + np.uint64(11)).sum(dtype=np.uint64), W.mix64(s + np.uint64(13)).sum(dtype=np.uint64)) for s in sets],
                    np.uint64,
                ).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digest[:, 0]), pa.array(digest[:, 1]),
                        pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())),
                    ],
                    names=["id", "n_shingles", "set_a", "set_b", "bands", "bits"],
                )

    return docs.select(docs[id_column].cast("long").alias("id"), docs[text_column].cast("string").alias("text")).mapInArrow(run, SIGNATURE)


def candidate_sets(docs: DataFrame, id_column: str, text_column: str, ids: DataFrame) -> DataFrame:
    """(id, elements) of the given ids: the sorted set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in shingle_sets(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["id", "elements"],
                )

    texts = docs.select(docs[id_column].cast("long").alias("id"), docs[text_column].cast("string").alias("text"))
    return texts.join(ids, "id", "left_semi").dropDuplicates(["id", "text"]).mapInArrow(run, "id long, elements binary")


def linked(pairs: DataFrame, sets: DataFrame, link: int = LINK) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = common(x, y)
                keep.append(100 * both >= link * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    left = sets.select(F.col("id").alias("a"), F.col("elements").alias("a_set"))
    right = sets.select(F.col("id").alias("b"), F.col("elements").alias("b_set"))
    # a link needs sizes this close, known before any set is compared
    near = (F.octet_length("a_set") * 100 >= F.octet_length("b_set") * link) & (F.octet_length("b_set") * 100 >= F.octet_length("a_set") * link)
    return pairs.join(left, "a").join(right, "b").filter(near).select("a", "b", "a_set", "b_set").mapInArrow(run, "a long, b long")


def common(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    if not len(x) or not len(y):
        return 0
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    return int((x[at] == y).sum())


def close(a: str, b: str) -> Column:
    """May the pair be a link, by the bits of both signatures?"""
    apart = sum((F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in BITS), F.lit(0))
    return apart <= BITS_APART


def link_classes(docs: DataFrame, id_column: str, text_column: str, reps: DataFrame) -> DataFrame:
    """(node, component) of the linked class representatives; ``reps`` has id, bands, bits."""
    reps = write_table(reps.select("id", "bands", "bits"), "minhash-reps")
    members = reps.select("id", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).filter("n > 1")
    own = F.struct("id", *(F.get("bits", F.lit(w)).alias(name) for w, name in enumerate(BITS)))
    bits = reps.select("id", own.alias("own"))
    shared = write_table(members.join(buckets, "key").join(bits, "id").select("key", "n", "least", "own"), "minhash-shared")
    sets = write_table(candidate_sets(docs, id_column, text_column, shared.select("own.id").distinct()), "minhash-sets")
    # buckets of one smallest member are one: a group of copies meets in most bands, but is compared once
    large = write_table(shared.filter(F.col("n") > SMALL_BUCKET).select(F.col("least").alias("key"), "own").distinct(), "minhash-large")

    small = shared.filter(F.col("n") <= SMALL_BUCKET).groupBy("key").agg(F.collect_list("own").alias("group"))
    pair = lambda a: F.transform(F.filter("group", lambda b: b["id"] > a["id"]), lambda b: F.struct(a.alias("a"), b.alias("b")))
    all_pairs = small.select(F.explode(F.flatten(F.transform("group", pair))).alias("p")).select("p.a", "p.b").filter(close("a", "b"))
    first = large.filter(F.col("own.id") == F.col("key")).select("key", F.col("own").alias("a"))
    stars = large.filter(F.col("own.id") != F.col("key")).select("key", F.col("own").alias("b")).join(first, "key").filter(close("a", "b"))
    tried = pairs_of(all_pairs).unionByName(pairs_of(stars)).unionByName(pairs_of(drawn_pairs(large)))
    tried = write_table(tried.distinct(), "minhash-pairs")
    joined = components(linked(tried, sets))
    placed = across_components(large, joined)
    found = pairs_across(placed, sets)
    more = write_table(pairs_of(found).distinct().join(tried, ["a", "b"], "left_anti"), "minhash-pairs")
    new = write_table(linked(more, sets), "minhash-links")
    if new.isEmpty():
        return joined
    return components(new.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def drawn_pairs(large: DataFrame) -> DataFrame:
    """Each member of a bucket above ``PIVOT_BUCKET`` with a few others, drawn by a hash of their ids."""
    members = large.join(buckets_above(large, PIVOT_BUCKET), "key", "left_semi")
    order = [F.struct(F.xxhash64("own.id", F.lit(turn)).alias("order"), "own") for turn in range(DRAWS)]
    drawn = members.groupBy("key").agg(*(F.min(o).alias(f"o{turn}") for turn, o in enumerate(order)))
    drawn = drawn.select("key", F.explode(F.array(*(F.col(f"o{turn}.own") for turn in range(DRAWS)))).alias("a"))
    return members.select("key", F.col("own").alias("b")).join(drawn, "key").filter(F.expr("a.id <> b.id") & close("a", "b"))


def buckets_above(members: DataFrame, size: int) -> DataFrame:
    return members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > size).select("key")


def pairs_across(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of a bucket's members in different components that may be links."""
    few = F.expr("a.id < b.id and a_in <> b_in") & close("a", "b")
    hot = buckets_above(placed, PIVOT_BUCKET)
    rest = placed.join(hot, "key", "left_anti")
    one = rest.select("key", F.col("own").alias("a"), F.col("component").alias("a_in"))
    two = rest.select("key", F.col("own").alias("b"), F.col("component").alias("b_in"))
    found = one.join(two, "key").filter(few).select("a", "b")
    bounded = write_table(with_bounds(placed.join(hot, "key", "left_semi"), sets), "minhash-bounds")
    # a bucket's pairs are made in cells of its members' halves, quarters ... so that no task has them all
    cell = F.pmod(F.xxhash64("own.id"), F.lit(CELLS))
    cells = F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1)))
    one = bounded.select("key", cell.alias("row"), cells.alias("column"), F.col("own").alias("a"), F.col("component").alias("a_in"), F.col("bound").alias("a_bound"))
    two = bounded.select("key", cells.alias("row"), cell.alias("column"), F.col("own").alias("b"), F.col("component").alias("b_in"), F.col("bound").alias("b_bound"))
    return found.unionByName(one.join(two, ["key", "row", "column"]).filter(few & may_link("a_bound", "b_bound")).select("a", "b"))


def with_bounds(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Add to the members of buckets what their set shares with the bucket's pivot, as ``bound``.

    The pivot is the smallest id of the bucket's largest component. ``bound`` holds the sizes of the set,
    of what it shares, of the rest and of that rest's bitmap, and the bitmap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, pivot = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                extra = np.setdiff1d(x, pivot, assume_unique=True)
                map_ = np.zeros(EXTRA_WORDS, np.uint64)
                place = W.mix64(extra)
                np.bitwise_or.at(map_, (place >> np.uint64(6)) % np.uint64(EXTRA_WORDS), np.uint64(1) << (place & np.uint64(63)))
                set_bits = int(np.bitwise_count(map_).sum())
                rows.append({
                    "size": len(x), "shared": len(x) - len(extra), "rest": len(extra), "set_bits": set_bits, "map": map_.view(np.int64).tolist(),
                })
            kind = pa.struct([(n, pa.int64()) for n in ("size", "shared", "rest", "set_bits")] + [("map", pa.list_(pa.int64()))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, kind)], names=["pivot", "id", "bound"])

    parts = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.min("own.id").alias("least"))
    pivots = parts.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("n"), "least")).alias("pivot")).select("key", F.col("pivot.least").alias("pivot"))
    placed = members.join(pivots, "key")
    asked = placed.select("pivot", F.col("own.id").alias("id")).distinct()
    left, right = sets.select("id", F.col("elements").alias("x")), sets.select(F.col("id").alias("pivot"), F.col("elements").alias("y"))
    measured = asked.join(left, "id").join(right, "pivot").select("pivot", "id", "x", "y").mapInArrow(
        run, "pivot long, id long, bound struct<size:long,shared:long,rest:long,set_bits:long,map:array<long>>"
    )
    return placed.withColumn("id", F.col("own.id")).join(measured, ["pivot", "id"]).select("key", "own", "component", "bound")


def may_link(a: str, b: str, link: int = LINK) -> Column:
    """Can two sets be linked, by what they share with the same pivot?

    They share at most what each shares with it, and of the rest no more than the common bits of the
    bitmaps and the elements that fell on a bit already set.
    """
    x, y = (lambda name, side=side: F.col(f"{side}.{name}") for side in (a, b))
    common_bits = sum((F.bit_count(F.get(x("map"), F.lit(w)).bitwiseAND(F.get(y("map"), F.lit(w)))) for w in range(EXTRA_WORDS)), F.lit(0))
    rest = F.least(x("rest"), y("rest"), common_bits + F.least(x("rest") - x("set_bits"), y("rest") - y("set_bits")))
    most = F.least(x("shared"), y("shared")) + rest
    return most * (100 + link) >= (x("size") + y("size")) * link


def pairs_of(found: DataFrame) -> DataFrame:
    return found.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))


def across_components(large: DataFrame, joined: DataFrame) -> DataFrame:
    """The members of larger buckets that lie in several components, with their component."""
    placed = write_table(
        large.join(joined, F.col("own.id") == joined["node"], "left").select("key", "own", F.coalesce("component", "own.id").alias("component")),
        "minhash-placed",
    )
    apart = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    return write_table(placed.join(apart.select("key"), "key", "left_semi").distinct(), "minhash-open")


def with_ids_of_several(full: DataFrame, classes: DataFrame, joined: DataFrame) -> DataFrame:
    """Components that ids of several texts also join: all classes in which one id occurs are linked."""
    several = full.groupBy("id").agg(
        F.min(F.struct("n_shingles", "set_a", "set_b")).alias("low"), F.max(F.struct("n_shingles", "set_a", "set_b")).alias("high")
    ).filter("low <> high").select("id")
    of = full.join(several, "id", "left_semi").select("id", "n_shingles", "set_a", "set_b").distinct()
    of = of.join(classes, ["n_shingles", "set_a", "set_b"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    edges = write_table(of.filter("a <> b"), "minhash-ids")
    if edges.isEmpty():
        return joined
    return components(edges.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest linked id), kept (the component's own row)."""
    signed = write_table(signatures(docs, id_column, text_column), "minhash-signatures")
    full = signed.filter("n_shingles > 0 and id is not null")
    classes = full.groupBy("n_shingles", "set_a", "set_b").agg(F.min("id").alias("rep"))
    classes = write_table(classes, "minhash-classes")
    reps = full.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id", "set_a", "set_b"])
    joined = with_ids_of_several(full, classes, link_classes(docs, id_column, text_column, reps))
    placed = classes.join(joined, classes["rep"] == joined["node"], "left").select(
        "n_shingles", "set_a", "set_b", F.coalesce("component", "rep").alias("component_id")
    )
    out = signed.join(placed, ["n_shingles", "set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(
        F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
