"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class.

Candidates of a class are its maximal runs of at least ``window`` characters. A window slides over a
candidate; the counts of the entering and of the leaving character change by one, and the entropy
follows from the change of ``sum(count * log2(count))``. Windows at or above the threshold are joined to
spans. Spans that an allow-list pattern matches are dropped; those of the fixed patterns stay.

Only column expressions, evaluated where the row is read; nothing is shuffled. Texts without a match pay
for one search per pattern. Positions are code points, ends exclusive. A null or empty text has no spans
(redaction keeps it as it is). Repeated rows are scanned each; an empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbench.llm.common import reserved

# The patterns of the three base kinds, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE_KINDS = ("assign", "access", "hex")

SPAN = "array<struct<start:int,place:int,end:int,kind:string>>"


@dataclass(frozen=True)
class EntropyClass:
    kind: str
    alphabet: str
    pattern: str
    window: int
    bits: float


HEX_CLASS = EntropyClass("entropy_hex", "0123456789abcdef", r"[0-9a-f]{20,}", 20, 3.0)
BASE64_CLASS = EntropyClass(
    "entropy_base64",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-",
    r"[A-Za-z0-9+/_=-]{20,}",
    20,
    3.8,
)
#: Smaller alphabets reach the bits of base64 rarely, so keys of these have classes of their own.
UPPER_HEX_CLASS = EntropyClass("entropy_upper_hex", "0123456789ABCDEF", r"[0-9A-F]{20,}", 20, 3.0)
BASE32_CLASS = EntropyClass("entropy_base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", r"[A-Z2-7]{20,}", 20, 3.3)
CLASSES = (HEX_CLASS, BASE64_CLASS, UPPER_HEX_CLASS, BASE32_CLASS)

#: Spans whose text one of these finds are no secrets: words without digits, placeholders, counting.
ALLOWED = (
    r"^[^0-9]*$",
    r"(?i)example|sample|placeholder|changeme|dummy|your",
    r"0123456789|(?i:abcdefghij)",
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
)


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """(start, match) of all leftmost, non-overlapping matches; the pattern has no empty match.

    What lies between the matches comes from splitting at them; lengths add up to positions.
    """
    start = F.lit(0).cast("int")
    pairs = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")
    )
    state = F.struct(start.alias("at"), F.array().cast("array<struct<start:int,found:string>>").alias("out"))

    def step(acc, pair):
        begin = acc["at"] + F.length(pair["gap"])
        return F.struct(
            (begin + F.coalesce(F.length(pair["found"]), F.lit(0))).alias("at"),
            F.when(pair["found"].isNull(), acc["out"]).otherwise(
                F.concat(acc["out"], F.array(F.struct(begin.alias("start"), pair["found"].alias("found"))))
            ).alias("out"),
        )

    return F.aggregate(pairs, state, step, lambda acc: acc["out"])


def span(start: Column, end: Column, place: int, kind: str) -> Column:
    return F.struct(
        start.cast("int").alias("start"), F.lit(place).alias("place"), end.cast("int").alias("end"), F.lit(kind).alias("kind")
    )


def none() -> Column:
    return F.array().cast(SPAN)


def whole_spans(found: Column, place: int, kind: str) -> Column:
    return F.transform(found, lambda m: span(m["start"], m["start"] + F.length(m["found"]), place, kind)).cast(SPAN)


def base_spans(text: Column) -> Column:
    value = lambda found: F.regexp_extract(found, ASSIGN, 2)
    parts = []
    for place, (kind, pattern) in enumerate(zip(BASE_KINDS, (ASSIGN, ACCESS, HEX))):
        found = matches(text, pattern)
        if kind == "assign":
            found = F.filter(found, lambda m: F.length(value(m["found"])) >= ASSIGN_VALUE)
        parts.append(F.when(text.rlike(pattern), whole_spans(found, place, kind)).otherwise(none()))
    return F.concat(*parts)


def high_windows(found: Column, of: EntropyClass) -> Column:
    """Joined windows of high entropy in one candidate, as (low, high) positions."""
    wide = len(of.alphabet) + 1  # place 0 stands for no character
    log = lambda n: F.when(n > 0, n * F.log2(n)).otherwise(F.lit(0.0))
    codes = F.transform(F.split(found, "(?!^)(?!$)"), lambda c: F.instr(F.lit(of.alphabet), c))
    window = F.lit(of.window)
    pairs = lambda code: F.arrays_zip(
        code.alias("enters"),
        F.concat(F.array_repeat(F.lit(0), of.window), code).alias("leaves"),
    )
    spans = "array<struct<low:int,high:int>>"
    state = F.struct(
        F.array_repeat(F.lit(0), wide).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(0).alias("at"),
        F.lit(-1).alias("low"),
        F.lit(-1).alias("high"),
        F.array().cast(spans).alias("out"),
    )

    def step(acc, pair):
        enters, leaves = pair["enters"], pair["leaves"]
        grown = F.get(acc["counts"], enters)
        shrunk = F.get(acc["counts"], leaves)
        same = enters == leaves
        total = F.when(same, acc["sum"]).otherwise(
            acc["sum"] + log(grown + 1) - log(grown)
            + F.when(leaves > 0, log(shrunk - 1) - log(shrunk)).otherwise(F.lit(0.0))
        )
        counts = F.when(same, acc["counts"]).otherwise(
            F.transform(
                acc["counts"],
                lambda n, k: n + (k == enters).cast("int") - ((k == leaves) & (k > 0)).cast("int"),
            )
        )
        first = acc["at"] + 1 - window
        high = (first >= 0) & (F.log2(window) - total / window >= of.bits)
        joins = high & (acc["low"] >= 0) & (first <= acc["high"])
        return F.struct(
            counts.alias("counts"),
            total.alias("sum"),
            (acc["at"] + 1).alias("at"),
            F.when(high & ~joins, first).otherwise(acc["low"]).alias("low"),
            F.when(high, acc["at"] + 1).otherwise(acc["high"]).alias("high"),
            F.when(
                high & ~joins & (acc["low"] >= 0),
                F.concat(acc["out"], F.array(F.struct(acc["low"].alias("low"), acc["high"].alias("high")))),
            ).otherwise(acc["out"]).alias("out"),
        )

    def end(acc):
        last = F.array(F.struct(acc["low"].alias("low"), acc["high"].alias("high")))
        return F.when(acc["low"] >= 0, F.concat(acc["out"], last)).otherwise(acc["out"])

    return let(codes, lambda code: F.aggregate(F.slice(pairs(code), 1, F.size(code)), state, step, end))


def entropy_spans(text: Column, place: int, of: EntropyClass, allowed: tuple[str, ...]) -> Column:
    def spans_of(match):
        return F.transform(
            F.filter(high_windows(match["found"], of), lambda w: ~permitted(F.substring(match["found"], w["low"] + 1, w["high"] - w["low"]))),
            lambda w: span(match["start"] + w["low"], match["start"] + w["high"], place, of.kind),
        )

    def permitted(part):
        out = F.lit(False)
        for pattern in allowed:
            out = out | part.rlike(pattern)
        return out

    return F.when(text.rlike(of.pattern), F.flatten(F.transform(matches(text, of.pattern), spans_of)).cast(SPAN)).otherwise(none())


def secret_spans(text: Column, classes: tuple[EntropyClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """All spans of a text by start, then by kind as listed."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    parts = [base_spans(text)]
    parts += [entropy_spans(text, len(BASE_KINDS) + k, c, allowed) for k, c in enumerate(classes)]
    return F.sort_array(F.concat(*parts))


def find_secrets(docs: DataFrame, text_column: str = "text", out: str = "secrets", **options) -> DataFrame:
    """Add the spans, an array of (start, place of the kind, end, kind), to each row."""
    return docs.withColumn(out, secret_spans(docs[text_column], **options))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_column: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """Put ``mark`` in the place of each secret; overlapping spans get one."""
    spans = reserved("spans")
    text = F.col(text_column)
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        apart = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(apart & ((s["start"] > acc["at"]) | (acc["at"] == 0)), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        )

    cut = F.aggregate(F.col(spans), state, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return (
        find_secrets(docs, text_column, spans, **options)
        .withColumn(text_column, F.when(F.size(spans) > 0, cut).otherwise(text))
        .drop(spans)
    )
