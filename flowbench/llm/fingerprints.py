"""Order MinHash fingerprints of documents.

A text is cut into tokens, words in pieces of at most four characters, and runs of ``K`` tokens are its
k-mers. Equal k-mers of a text are numbered by occurrence, so each (k-mer, occurrence) is one element.
A hash deals the elements to ``CELLS`` cells; in each cell the two with the smallest hashes are taken,
kept in the order in which they stand in the text, and hashed together. Two texts agree in a cell only
if the same k-mers are minimal there and stand in the same order, which makes agreement follow edit
distance rather than overlap. A cell with one element takes the smallest of the next cell that has any
(after the last, the first) as its second, so short texts keep their order too; only a text of a single
element pairs it with itself. Cells that are empty in both texts say nothing.

Only column expressions; arrays hold one number per token of the text at hand. Fingerprints are computed
where the row is read. Likeness is the share of agreeing cells, raised to 1/2, as two k-mers must agree:
1 for equal fingerprints, so for equal texts, and for two texts without tokens; 0 if only one has any.

Null texts are empty. Repeated rows have equal fingerprints. An empty table gives no rows. In a text of
2^25 or more k-mers positions are counted in steps of a power of two: of two k-mers in one step, the one
with the smaller hash comes first; order over longer distances is kept at any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowbench.llm.common import reserved

#: Words, cut into pieces; texts without spaces are cut as well.
TOKEN = r"[^\x20\x09-\x0D]{1,4}"
K = 3
CELLS = 64
#: Bits of a packed number, from the right: position in the text, then hash, then cell.
POSITION_BITS, HASH_BITS = 25, 32
POSITIONS = (1 << POSITION_BITS) - 1
HASHES = (1 << HASH_BITS) - 1
KMER_BITS = 63 - POSITION_BITS

ROWS_PER_BUCKET = 512
MAX_BUCKETS = 65_536


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before(values: Column) -> Column:
    """The array moved by one: each place has what stood before it, the first -1."""
    return F.concat(F.array(F.lit(-1).cast("long")), F.slice(values, 1, F.size(values) - 1))


def packed_kmers(tokens: Column) -> Column:
    """Sorted numbers of (k-mer hash, position); texts of fewer tokens are filled up to one k-mer."""
    filled = let(
        F.transform(tokens, lambda t: F.xxhash64(t)),
        lambda h: F.concat(h, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), F.lit(K) - F.size(h)))),
    )

    def runs(h):
        n = F.size(h) - (K - 1)
        # one array of structs, so that no element access repeats the whole array
        parts = F.arrays_zip(*(F.slice(h, j + 1, n).alias(f"t{j}") for j in range(K)))
        step = F.greatest(F.lit(0), F.length(F.bin(n)) - POSITION_BITS)

        def numbers(s):
            return F.transform(
                parts,
                lambda p, i: F.shiftleft(F.xxhash64(*(p[f"t{j}"] for j in range(K))).bitwiseAND(F.lit((1 << KMER_BITS) - 1)), POSITION_BITS)
                .bitwiseOR(F.call_function("shiftright", i, s).cast("long")),
            )

        return F.sort_array(let(step, numbers))

    return let(filled, runs)


def occurrences(kmers: Column) -> Column:
    """For each place of the sorted k-mers, how many equal ones stand before it."""

    def numbered(starts, n):
        ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(n))
        return F.flatten(F.zip_with(starts, ends, lambda a, b: F.sequence(F.lit(0), b - a - 1)))

    pairs = F.arrays_zip(kmers.alias("now"), before(kmers).alias("last"))
    starts = F.filter(
        F.transform(
            pairs,
            lambda p, i: F.when(F.shiftright(p["now"], POSITION_BITS) != F.shiftright(p["last"], POSITION_BITS), i).otherwise(F.lit(-1)),
        ),
        lambda i: i >= 0,
    )
    return let(starts, lambda s: numbered(s, F.size(kmers)))


def dealt(kmers: Column) -> Column:
    """Sorted numbers of (cell, hash, position) of all (k-mer, occurrence)."""

    def number(kmer, occurrence):
        return let(
            F.xxhash64(F.shiftright(kmer, POSITION_BITS), occurrence),
            lambda v: F.shiftleft(v.bitwiseAND(F.lit(CELLS - 1).cast("long")), HASH_BITS + POSITION_BITS)
            .bitwiseOR(F.shiftleft(F.shiftrightunsigned(v, 32), POSITION_BITS))
            .bitwiseOR(kmer.bitwiseAND(F.lit(POSITIONS).cast("long"))),
        )

    return F.sort_array(F.zip_with(kmers, occurrences(kmers), number))


def cells_of(numbers: Column) -> Column:
    """Per non-empty cell: the cell, and the hash of its two minimal elements in text order.

    What follows a cell's only element in the sorted numbers is the minimum of the next cell that has any.
    """
    high = HASH_BITS + POSITION_BITS
    triples = F.arrays_zip(
        before(numbers).alias("last"), numbers.alias("now"), F.concat(F.slice(numbers, 2, F.size(numbers)), F.slice(numbers, 1, 1)).alias("next")
    )
    firsts = F.filter(triples, lambda t: F.shiftright(t["last"], high) != F.shiftright(t["now"], high))
    place = lambda x: x.bitwiseAND(F.lit(POSITIONS).cast("long"))
    value = lambda x: F.shiftright(x, POSITION_BITS).bitwiseAND(F.lit(HASHES).cast("long"))

    def entry(t):
        ordered = F.when(
            (place(t["now"]) < place(t["next"])) | ((place(t["now"]) == place(t["next"])) & (value(t["now"]) <= value(t["next"]))),
            F.xxhash64(value(t["now"]), value(t["next"])),
        ).otherwise(F.xxhash64(value(t["next"]), value(t["now"])))
        return F.shiftleft(F.shiftright(t["now"], high), HASH_BITS).bitwiseOR(ordered.bitwiseAND(F.lit(HASHES).cast("long")))

    return F.transform(firsts, entry)


def sketch(text: Column) -> Column:
    """The fingerprint as an array of at most ``CELLS`` numbers (cell, tuple hash), by cell."""
    tokens = F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(TOKEN), F.lit(0))
    full = let(tokens, lambda t: F.when(F.size(t) > 0, let(packed_kmers(t), lambda k: let(dealt(k), cells_of))))
    return F.coalesce(full, F.array().cast("array<bigint>"))


def fingerprint(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda n: F.lower(F.hex(n))), "-")


def likeness(a: Column, b: Column) -> Column:
    cells = lambda x: F.transform(x, lambda n: F.shiftright(n, HASH_BITS))
    either = F.size(F.array_union(cells(a), cells(b)))
    equal = F.size(F.array_intersect(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.sqrt(equal / either))


def with_next(docs: DataFrame, id_column: str, columns: dict[str, str]) -> DataFrame:
    """Add, as ``columns`` names them, values of the row that follows by ascending id; the first after the last.

    Ids are cut into at most ``MAX_BUCKETS`` ranges of one width, one window partition each; the first rows of
    a range also go, as the last row, to the range before. Null ids come last; equal ids by the columns' values.
    """
    bucket, guard, first = reserved("bucket"), reserved("guard"), reserved("first")
    low, high, rows = docs.agg(F.min(id_column), F.max(id_column), F.count(F.lit(1))).first()
    buckets = min(MAX_BUCKETS, rows // ROWS_PER_BUCKET + 1)
    low, width = low or 0, ((high or 0) - (low or 0)) // buckets + 1
    exact = lambda x: x.cast("decimal(20)")
    number = F.floor((exact(F.col(id_column)) - exact(F.lit(low))) / exact(F.lit(width))).cast("int")
    number = F.coalesce(number, F.lit(buckets))
    firsts = docs.groupBy(number.alias(bucket)).agg(F.min(id_column).alias(first))
    in_turn = Window.orderBy(bucket)
    firsts = firsts.select(
        first, F.coalesce(F.lag(bucket).over(in_turn), F.max(bucket).over(in_turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias(reserved("to"))
    )
    both = docs.join(F.broadcast(firsts), docs[id_column].eqNullSafe(F.col(first)), "left")  # at most MAX_BUCKETS + 1 rows
    here = F.struct(number.alias(bucket), F.lit(0).alias(guard))
    there = F.struct(F.col(reserved("to")).alias(bucket), F.lit(1).alias(guard))
    both = both.withColumn(reserved("at"), F.explode(F.when(F.col(reserved("to")).isNull(), F.array(here)).otherwise(F.array(here, there))))
    order = Window.partitionBy(F.col(reserved("at"))[bucket]).orderBy(
        F.col(reserved("at"))[guard], F.col(id_column).asc_nulls_last(), *columns
    )
    return (
        both.withColumns({new: F.lead(old).over(order) for old, new in columns.items()})
        .filter(F.col(reserved("at"))[guard] == 0)
        .drop(reserved("at"), first, reserved("to"))
    )


def fingerprints(docs: DataFrame, text_column: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of each row's text as a string."""
    return docs.withColumn(out, fingerprint(sketch(docs[text_column])))


def edit_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document against its edited text and against the next document.

    Edited: the last quarter of the characters replaced by as many, or all, of the next document's first.
    """
    text, own, after, after_own = (reserved(c) for c in ("text", "own", "after", "after_own"))
    rows = docs.select(docs[id_column].alias("doc_id"), F.coalesce(docs[text_column].cast("string"), F.lit("")).alias(text))
    rows = with_next(rows.withColumn(own, sketch(F.col(text))), "doc_id", {text: after, own: after_own})
    n = F.length(text)
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), n - cut), F.substring(F.col(after), F.lit(1), cut))
    rows = rows.withColumn(reserved("edited"), edited)
    rows = rows.withColumn(reserved("edited_own"), sketch(F.col(reserved("edited"))))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.encode(reserved("edited"), "UTF-8"), 256).alias("edited_sha256"),
        fingerprint(F.col(own)).alias("fingerprint"),
        fingerprint(F.col(reserved("edited_own"))).alias("edited_fingerprint"),
        likeness(F.col(own), F.col(reserved("edited_own"))).alias("near_edited"),
        likeness(F.col(own), F.col(after_own)).alias("near_next"),
    )
