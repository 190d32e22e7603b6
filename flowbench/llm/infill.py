"""Fill-in-the-middle transformation by counted quantifiers.

A text is cut into units: a word with the separators before it, or separators with no word behind them.
``regexp_count`` gives the number of units, the document's id says after how many of them the prefix and
the middle end, and a pattern made for the row, ``(unit{a})(unit{b-a})(rest)``, captures the three parts
in one match, which the same replacement puts into the order of the form. Counted quantifiers are
possessive: each unit is matched once and never given back, so the matcher runs in a loop, without
recursion, and texts of any length take time in proportion to it.

Everything is a column expression, evaluated where the row is read: no shuffle, no Python.

Null and empty texts have no units and stay plain, as the empty text. A text that holds one of the
markers stays plain, so that what is transformed can always be restored. Cuts and form depend on the id
(a null id counts as the empty string) and the number of units only: repeated rows are treated alike. Very
long texts are matched whole. An empty table gives no rows. Other columns are ignored unless kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbench.llm.common import reserved

PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")
SEED = 42
#: Of a hundred documents, so many are transformed, and of a hundred of these, so many begin with the suffix.
TRANSFORMED, SUFFIX_FIRST = 50, 80

SPACE, LETTER = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: Both alternatives give back nothing: what follows separators is a letter or the end.
UNIT = f"(?:{SPACE}*+{LETTER}++|{SPACE}++)"
#: What stands where in the output of a form, by group of the row's pattern.
LAYOUT = {"psm": f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2", "spm": f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"}


def draws(id_column: Column, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))
    digest = F.sha2(F.encode(name, "UTF-8"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def row_pattern(low: Column, high: Column) -> Column:
    """The pattern that captures ``low`` units, the units up to ``high``, and the rest."""
    def counted(n: Column) -> Column:
        return F.concat(F.lit(f"({UNIT}{{"), n.cast("string"), F.lit("}+)"))

    return F.concat(F.lit(r"\A"), counted(low), counted(high - low), F.lit(r"((?s:.*+))\z"))


def with_markers(text: Column) -> Column:
    return F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))


def infill(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    seed: int = SEED,
    transformed: int = TRANSFORMED,
    suffix_first: int = SUFFIX_FIRST,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Per row: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output.

    ``prefix_chars`` and ``middle_chars`` count code points and are null for plain rows.
    """
    name = {n: reserved(n) for n in ("text", "n", "h1", "h2", "h3", "h4", "low", "high", "form")}
    n, low, high, form, text = (F.col(name[x]) for x in ("n", "low", "high", "form", "text"))
    h1, h2, h3, h4 = (F.col(name[f"h{k}"]) for k in range(1, 5))
    base = docs.select(
        docs[id_column].alias("doc_id"), *(docs[c].alias(reserved(f"keep_{c}")) for c in keep),
        F.coalesce(docs[text_column].cast("string"), F.lit("")).alias(name["text"]),
        *(h.alias(name[f"h{k}"]) for k, h in enumerate(draws(docs[id_column], seed), 1)),
    )
    counted = base.withColumn(name["n"], F.regexp_count(name["text"], F.lit(UNIT)).cast("long"))
    plain = (F.length(text) == 0) | with_markers(text) | (h3 % 100 >= transformed)
    cut = counted.withColumns({
        name["low"]: F.least(h1 % (n + 1), h2 % (n + 1)),
        name["high"]: F.greatest(h1 % (n + 1), h2 % (n + 1)),
        name["form"]: F.when(plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm"),
    })
    replaced = [
        F.regexp_replace(text, row_pattern(low, high), F.lit(layout)) for layout in LAYOUT.values()
    ]
    done = cut.withColumn("output", F.when(form == "plain", text).when(form == "psm", replaced[0]).otherwise(replaced[1]))
    ends = {m: F.locate(m, F.col("output")) for m in MARKERS}  # a text with markers is plain: each stands once
    after = {m: ends[m] + len(m) for m in MARKERS}
    prefix_end = F.when(form == "psm", ends[SUFFIX]).otherwise(ends[MIDDLE])
    changed = form != "plain"
    return done.select(
        "doc_id", *(F.col(reserved(f"keep_{c}")).alias(c) for c in keep),
        n.alias("n"), form.alias("form"),
        F.when(changed, (prefix_end - after[PREFIX]).cast("long")).alias("prefix_chars"),
        F.when(changed, (F.length("output") + 1 - after[MIDDLE]).cast("long")).alias("middle_chars"),
        "output",
    )


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "|".join(MARKERS))
    first, second, third = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, third, second)).when(form == "spm", F.concat(second, third, first)).otherwise(output)
