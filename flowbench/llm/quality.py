"""Quality classifier: a sparse rule ensemble over text statistics.

Shallow trees, each grown on a bootstrap sample with random subsets of statistics, propose rules: each path
from the root to a node is a conjunction of comparisons. A lasso logistic regression over the rules' truth values keeps a few of them; what is left,
an intercept and weighted conjunctions, is compiled to one Spark column expression, so scoring is a
projection over the statistics.

Statistics are ratios of what is counted in one pass over a text's bytes. A text that is null, empty or
has no word has all ratios 0 and is scored by the rules like others. Equal texts have equal statistics
and scores. Rules are fitted on at most ``max_rows`` labelled rows, those with the smallest hash of
their id; everything else sees every row. Labelled rows with a null id or label are not used, and of an id of
several texts one is. Rows of one class only are an error; without any (as for an empty table, which has no
scores) there are no rules and every score is one half. Extra columns are ignored unless kept.

A text is measured whole, in groups of texts of about ``GROUP_BYTES``; a longer text is a group of its own,
with arrays of a few dozen bytes per byte.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowbench.llm import words as W
from flowbench.llm.common import drawn, reserved

MAX_ROWS = 20_000
TREES = 30
DEPTH = 3
#: Thresholds tried per statistic, and statistics tried per node.
THRESHOLDS = 48
TRIED = 6
LASSO = 1e-3
#: Texts are taken in groups of about this many bytes.
GROUP_BYTES = 1 << 19

#: Of running counts over bytes; an Arrow string is shorter than 2 ** 31 bytes.
COUNTS = np.int32

#: Statistics, all between 0 and 1 but the last three, which are logarithms of counts or means.
STATISTICS = (
    "upper", "digit", "mark", "symbol", "beyond_ascii", "exclaim", "pipe", "repeated_next", "distinct",
    "one_letter", "shouted", "marked_end", "stop", "line_repeat", "word_length", "words", "line_words",
)
MARKS = b".,;:'\"-()?!"
SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"


def table_of(codes: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(codes)] = 1
    return out


UPPER, DIGIT = table_of(bytes(range(65, 91))), table_of(bytes(range(48, 58)))
MARK, SYMBOL, BEYOND = table_of(MARKS), table_of(SYMBOLS), table_of(bytes(range(128, 256)))


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def statistics(data: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` per text."""
    size = np.diff(limits).astype(np.float64)
    word = W.find_words(data, limits)
    hashes = W.word_hashes(W.LOWER[data], word)

    def share(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, COUNTS)
        np.cumsum(flags, out=total[1:], dtype=COUNTS)
        return (total[edges[1:]] - total[edges[:-1]]).astype(np.float64)

    by_word = np.append(word.first, len(word.begin))
    many = word.count.astype(np.float64)
    letters = share(~W.IS_SEPARATOR[data], limits)
    length = word.end - word.begin
    same_text = np.zeros(len(hashes), bool)
    same_text[1:] = word.text[1:] == word.text[:-1]
    again = same_text.copy()
    again[1:] &= hashes[1:] == hashes[:-1]
    order = np.lexsort((hashes, word.text))
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (word.text[order][1:] != word.text[order][:-1])
    uppers = np.zeros(len(data) + 1, COUNTS)
    np.cumsum(UPPER[data], out=uppers[1:], dtype=COUNTS)
    shouted = (uppers[word.end] - uppers[word.begin]) * 2 > length
    last = data[word.end - 1] if len(word.end) else np.empty(0, np.uint8)
    doubled = (length > 1) & (last == data[word.end - 2]) if len(word.end) else np.empty(0, bool)
    breaks = np.flatnonzero(data == 10)
    lines = 1 + np.searchsorted(breaks, limits[1:]) - np.searchsorted(breaks, limits[:-1])
    # a line is told by the sum of its words' hashes
    line = np.searchsorted(breaks, word.begin) + word.text
    starts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.empty(0, np.int64)
    sums = np.add.reduceat(W.mix64(hashes + np.uint64(3)), starts) if len(starts) else np.empty(0, np.uint64)
    owner = word.text[starts] if len(starts) else starts
    by_line = np.lexsort((sums, owner))
    repeat = np.zeros(len(sums))
    repeat[1:] = (sums[by_line][1:] == sums[by_line][:-1]) & (owner[by_line][1:] == owner[by_line][:-1])
    count = len(limits) - 1
    full_lines = np.bincount(owner, minlength=count).astype(np.float64)
    columns = (
        ratio(share(UPPER[data], limits), letters),
        ratio(share(DIGIT[data], limits), letters),
        ratio(share(MARK[data], limits), letters),
        ratio(share(SYMBOL[data], limits), letters),
        ratio(share(BEYOND[data], limits), letters),
        ratio(share(data == ord("!"), limits), many),
        ratio(share(data == ord("|"), limits), many),
        ratio(share(again, by_word), many),
        ratio(np.bincount(word.text[order][new], minlength=count).astype(np.float64), many),
        ratio(share(length == 1, by_word), many),
        ratio(share(shouted, by_word), many),
        ratio(share(doubled & ((MARK + SYMBOL)[last] > 0), by_word), many),
        ratio(share(last == ord("."), by_word), many),
        ratio(np.bincount(owner[by_line], repeat, minlength=count), full_lines),
        np.log1p(ratio(letters, many)),
        np.log1p(many),
        np.log1p(ratio(many, lines.astype(np.float64))),
    )
    return np.stack(columns, axis=1) if count else np.empty((0, len(STATISTICS)))


def with_statistics(docs: DataFrame, keep: Sequence[Column], text_column: str = "text") -> DataFrame:
    """The columns of ``keep`` and the statistics, by reserved names, for each row."""
    base = docs.select(*keep, docs[text_column].cast("string").alias(reserved("text")))
    names = [reserved(s) for s in STATISTICS]
    schema = T.StructType(base.schema.fields[:-1] + [T.StructField(n, T.DoubleType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, limits = W.text_bytes(batch.column(batch.num_columns - 1))
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(limits, limits[at] + GROUP_BYTES, "right")) - 1)
                part = statistics(data[limits[at] : limits[upto]], limits[at : upto + 1] - limits[at])
                kept = [c.slice(at, upto - at) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, part.T.copy())], names=schema.names)
                at = upto

    return base.mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """All of ``parts``: (statistic, above, threshold), true where it is above or else at most that."""

    parts: tuple[tuple[int, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for statistic, above, threshold in self.parts:
            value = F.col(reserved(STATISTICS[statistic]))
            out = out & (value > threshold if above else value <= threshold)
        return out

    def holds(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), bool)
        for statistic, above, threshold in self.parts:
            out &= (values[:, statistic] > threshold) == above
        return out

    def __str__(self) -> str:
        return " and ".join(f"{STATISTICS[s]} {'>' if above else '<='} {t:.4g}" for s, above, t in self.parts)


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        logit = F.lit(self.intercept)
        for rule, weight in self.rules:
            logit = logit + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def best_split(codes: np.ndarray, labels: np.ndarray, weights: np.ndarray, statistics_tried: np.ndarray, bins: int) -> tuple[int, int] | None:
    """(statistic, code) whose "at most" split leaves the least impurity; None if none helps."""
    total, positive = weights.sum(), (weights * labels).sum()
    least, best = positive * (1 - positive / total) - 1e-9 * total, None
    for statistic in statistics_tried:
        code = codes[:, statistic]
        left = np.cumsum(np.bincount(code, weights, bins))[:-1]
        left_positive = np.cumsum(np.bincount(code, weights * labels, bins))[:-1]
        right, right_positive = total - left, positive - left_positive
        impurity = left_positive * (1 - ratio(left_positive, left)) + right_positive * (1 - ratio(right_positive, right))
        at = int(impurity.argmin())
        if impurity[at] < least:
            least, best = impurity[at], (int(statistic), at)
    return best


def paths(codes: np.ndarray, labels: np.ndarray, weights: np.ndarray, cuts: np.ndarray, depth: int, rng: np.random.Generator,
          taken: dict[tuple[int, bool], float] | None = None) -> Iterator[Rule]:
    """Grow one tree and give its conjunctions, one for each node below the root; repeated comparisons merge."""
    taken = taken or {}
    if taken:
        yield Rule(tuple((s, above, t) for (s, above), t in sorted(taken.items())))
    if depth == 0 or weights.sum() <= 0:
        return
    tried = rng.permutation(codes.shape[1])[:TRIED]
    split = best_split(codes, labels, weights, tried, len(cuts) + 1)
    if split is None:
        return
    statistic, code = split
    threshold = float(cuts[code, statistic])
    low, high = taken.get((statistic, False), np.inf), taken.get((statistic, True), -np.inf)
    side = codes[:, statistic] <= code
    for above, where, bound in ((False, side, min(low, threshold)), (True, ~side, max(high, threshold))):
        yield from paths(codes[where], labels[where], weights[where], cuts, depth - 1, rng, taken | {(statistic, above): bound})


def propose_rules(values: np.ndarray, labels: np.ndarray, weights: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> list[Rule]:
    rng = np.random.default_rng(seed)
    cuts = np.quantile(values, np.linspace(0, 1, THRESHOLDS + 2)[1:-1], axis=0)
    codes = np.stack([np.searchsorted(cuts[:, s], values[:, s]) for s in range(values.shape[1])], axis=1)
    found: dict[Rule, None] = {}
    for _ in range(trees):
        drawn = weights * np.bincount(rng.integers(0, len(labels), len(labels)), minlength=len(labels))
        found |= dict.fromkeys(paths(codes, labels, drawn, cuts, depth, rng))
    return list(found)


def lasso_logistic(truth: np.ndarray, labels: np.ndarray, weights: np.ndarray, lasso: float, steps: int = 1500) -> tuple[float, np.ndarray]:
    """Intercept and weights of the weighted mean logistic loss plus ``lasso`` times the weights' sizes.

    Accelerated proximal gradient steps; the intercept is not penalised.
    """
    design = np.concatenate([np.ones((len(truth), 1), np.float32), truth.astype(np.float32)], axis=1)
    share = (weights / weights.sum()).astype(np.float32)
    vector = np.ones(design.shape[1], np.float32)
    for _ in range(30):  # largest curvature, by power iteration
        vector = design.T @ (share * (design @ vector))
        size = np.linalg.norm(vector)
        vector /= size
    step = 1 / (0.26 * size)
    beta = ahead = np.zeros(design.shape[1])
    pace = 1.0
    for _ in range(steps):
        chance = 1 / (1 + np.exp(-(design @ ahead.astype(np.float32)).astype(np.float64)))
        moved = ahead - step * (design.T @ (share * (chance - labels)).astype(np.float32))
        moved[1:] = np.sign(moved[1:]) * np.maximum(0, np.abs(moved[1:]) - step * lasso)
        next_pace = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = moved + (pace - 1) / next_pace * (moved - beta)
        if np.abs(moved - beta).max() < 1e-6:
            return float(moved[0]), moved[1:]
        beta, pace = moved, next_pace
    return float(beta[0]), beta[1:]


def labelled_texts(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", label_column: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """Rows of ``docs`` with the label of at most ``max_rows`` labelled ids, as (doc_id, label, text)."""
    key, label = reserved("id"), reserved("label")
    marked = labels.filter(labels[label_column].isin(0, 1)).groupBy(labels[id_column].alias(key)).agg(F.max(labels[label_column]).alias(label))
    chosen = drawn(marked.filter(F.col(key).isNotNull()), key, max_rows)
    found = docs.select(docs[id_column].alias(key), docs["text"].alias(reserved("text"))).join(F.broadcast(chosen), key)  # at most max_rows ids
    return found.select(F.col(key).alias("doc_id"), F.col(label).alias("quality"), F.col(reserved("text")).alias("text"))


def fit(rows: DataFrame, label_column: str = "quality", max_rows: int = MAX_ROWS, trees: int = TREES, depth: int = DEPTH,
        lasso: float = LASSO, seed: int = 11) -> RuleModel:
    """Rules and weights from rows of ``with_statistics`` that kept a label of 0 or 1.

    Both classes weigh the same. ``max_rows`` bounds the sample.
    """
    usable = rows.filter(F.col("doc_id").isNotNull() & F.col(label_column).isin(0, 1))
    facts = F.struct(F.col(label_column).cast("double").alias("label"), *(reserved(s) for s in STATISTICS))
    one_each = usable.groupBy("doc_id").agg(F.min(facts).alias("facts"))  # an id of several texts: the same one in each run
    sample = drawn(one_each, "doc_id", max_rows).select("facts.*").collect()
    values = np.array([r[1:] for r in sample], np.float64).reshape(-1, len(STATISTICS))
    labels = np.array([r[0] for r in sample])
    if not len(labels):
        return RuleModel(0.0, ())
    if len(set(labels.tolist())) < 2:
        raise ValueError("labelled rows of both classes are needed")
    weights = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    rules = propose_rules(values, labels, weights, trees, depth, seed)
    truth = np.stack([r.holds(values) for r in rules], axis=1) if rules else np.empty((len(labels), 0))
    intercept, beta = lasso_logistic(truth, labels, weights, lasso)
    return RuleModel(intercept, tuple((r, float(w)) for r, w in zip(rules, beta) if w))
