"""Toxicity: averaged subword embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (bytes, with word boundaries) and of itself, hashed into
``buckets``; unseen misspellings share most of their n-grams with known words. A window of ``window``
words is the mean of its n-gram embeddings, and a linear softmax over that mean gives its classes. A
text is as toxic as its most toxic window: an insult counts the same in a short and in a long text.
Training knows labels of texts only, so each pass takes the currently most toxic windows of each text
as its example, starting from whole texts.

The model is fitted on at most ``max_rows`` labelled texts of each class, those with the smallest hash of
their id, and of these on the shortest as far as ``max_bytes`` a class go: a bounded sample by two parameters, and
the only thing that reaches the driver. The fitted model has ``buckets`` numbers, whatever the corpus. Every text
is scored whole, in the task that reads it.

Texts that are null, empty or without words have no window; their score is that of the bias alone, made
to be below one half. Repeated rows get equal scores. Rows with a null id are scored and are never used
in training. Labelled texts of one class only are an error; without any (as for an empty table, which has
no scores) every score is just below one half. An id of several texts teaches the smallest of them. Very long
texts are scored whole. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowbench.llm.common import drawn, reserved
from flowbench.sources.tables import write_table

BUCKETS = 1 << 18
DIMENSIONS = 8
SIZES = (3, 4, 5, 6)
WINDOW = 8
MAX_ROWS = 2000
MAX_BYTES = 1 << 25
PASSES = 12
#: Subwords in fewer training texts than this keep weight zero: they would only memorise single texts,
#: among them wrongly labelled ones.
LEAST_TEXTS = 3
#: Share of an embedding that each step in which it occurs takes off.
DECAY = 2e-3
#: Of them, the first that take whole texts instead of windows.
WHOLE_TEXTS = 3
SEED = 7
KNOWN_WORDS = 1_000_000

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all words on end, and where each word's begin (one more entry)."""
    parts = [few_subwords(words[k : k + 8192], buckets) for k in range(0, len(words), 8192)]
    sizes = np.concatenate([[0], *(np.diff(starts) for _, starts in parts)])
    return np.concatenate([grams for grams, _ in parts]), np.cumsum(sizes)


def few_subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    coded = [b"<" + w.encode("utf-8", "surrogatepass") + b">" for w in words]
    data = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint64)
    limits = np.zeros(len(coded) + 1, np.int64)
    np.cumsum([len(c) for c in coded], out=limits[1:])
    owner = np.repeat(np.arange(len(coded)), np.diff(limits))
    left = limits[owner + 1] - np.arange(len(data))  # bytes from here to the word's end
    hashes, owners = [], []
    value = np.zeros(len(data), np.uint64)
    for n in range(1, max(SIZES) + 1):
        size = len(data) - n + 1
        if size <= 0:
            break
        value = (value[:size] + data[n - 1 :] + np.uint64(1)) * MULTIPLIER
        value ^= value >> np.uint64(29)
        if n in SIZES:
            whole = left[:size] >= n
            hashes.append(value[whole] ^ np.uint64(n))
            owners.append(owner[:size][whole])
    for k, c in enumerate(coded):
        hashes.append(np.array([hash_bytes(c)], np.uint64))
        owners.append(np.array([k]))
    hashes, owners = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    hashes = (hashes[order] * MULTIPLIER) >> np.uint64(64 - int(buckets).bit_length() + 1)
    starts = np.searchsorted(owners[order], np.arange(len(coded) + 1))
    return hashes.astype(np.int32), starts


def hash_bytes(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data)


def split_words(text: str | None) -> list[str]:
    return (text or "").lower().split()


class Lexicon(dict):
    """Numbers words as they come and keeps, per word, the sum of its n-grams' weights and their count."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.figures = np.zeros((1 << 16, 2))

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = number = len(self)
        return number

    def look_up(self, words: list[str]) -> np.ndarray:
        """Per word, the sum of its n-grams' weights and their number."""
        if len(self) > KNOWN_WORDS:
            self.forget()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            grams, starts = subwords(self.new, len(self.weights))
            total = np.concatenate([[0.0], np.cumsum(self.weights[grams])])
            if len(self) > len(self.figures):
                self.figures = np.concatenate([self.figures, np.zeros((max(len(self), len(self.figures)), 2))])
            fresh = self.figures[len(self) - len(self.new) : len(self)]
            fresh[:, 0] = total[starts[1:]] - total[starts[:-1]]
            fresh[:, 1] = np.diff(starts)
            self.new = []
        return self.figures[at]


def window_means(figures: np.ndarray, limits: np.ndarray, window: int) -> np.ndarray:
    """Mean n-gram weight of the run of ``window`` words that begins at each word.

    ``limits`` are the first words of the texts, none empty, and the end. Runs that a text's end cuts
    short do not count, except the first of a text.
    """
    total = np.zeros((len(figures) + 1, 2))
    np.cumsum(figures, axis=0, out=total[1:])
    begin = np.arange(len(figures))
    last = np.repeat(limits[1:], np.diff(limits))
    end = np.minimum(begin + window, last)
    weight, grams = (total[end] - total[begin]).T
    means = weight / grams
    means[(begin + window > last) & (begin != np.repeat(limits[:-1], np.diff(limits)))] = -np.inf
    return means


@dataclass
class ToxicityModel:
    """``weights``: per bucket the difference of the two classes' logits; a text's logit is
    ``scale * (mean + bias) + shift`` of its most toxic window."""

    weights: np.ndarray
    bias: float
    window: int
    scale: float = 1.0
    shift: float = 0.0
    history: list[float] = field(default_factory=list)

    def logits(self, texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
        best = np.zeros(len(texts))
        parts = [split_words(t) for t in texts]
        full = [k for k, words in enumerate(parts) if words]
        for some in (full[k : k + 64] for k in range(0, len(full), 64)):
            limits = np.concatenate([[0], np.cumsum([len(parts[k]) for k in some])])
            figures = lexicon.look_up([w for k in some for w in parts[k]])
            best[some] = np.maximum.reduceat(window_means(figures, limits, self.window), limits[:-1])
        return self.scale * (best + self.bias) + self.shift


def training_rows(labelled: DataFrame, docs: DataFrame, id_column: str, text_column: str, label_column: str,
                  max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> list[tuple[int, str]]:
    """The bounded sample: of each class, the labelled texts with the smallest hash of their id."""
    key, label = reserved("id"), reserved("label")
    wanted = (
        labelled.filter(labelled[id_column].isNotNull() & labelled[label_column].isin(0, 1))
        .groupBy(labelled[id_column].alias(key)).agg(F.max(labelled[label_column]).cast("int").alias(label))
    )
    ids = drawn(wanted.filter(F.col(label) == 0), key, max_rows).unionByName(drawn(wanted.filter(F.col(label) == 1), key, max_rows))
    text = reserved("text")
    texts = docs.select(docs[id_column].alias(key), docs[text_column].cast("string").alias(text)).filter(F.col(text).isNotNull())
    found = texts.join(F.broadcast(ids), key).groupBy(key, label).agg(F.min(text).alias(text))  # at most 2 * max_rows ids
    found = write_table(found, "toxicity-texts")
    sizes = Window.partitionBy(label).orderBy(F.octet_length(text), key)  # over at most max_rows rows a class
    upto = found.select(key, label, F.sum(F.octet_length(text).cast("long")).over(sizes).alias(reserved("upto")))
    fitting = F.broadcast(upto.filter(F.col(reserved("upto")) <= max_bytes).select(key))
    rows = found.join(fitting, key).select(key, label, text).collect()
    return [(r[1], r[2]) for r in sorted(rows, key=lambda r: r[0])]


def fit(rows: list[tuple[int, str]], buckets: int = BUCKETS, dimensions: int = DIMENSIONS, window: int = WINDOW,
        passes: int = PASSES, seed: int = SEED) -> ToxicityModel:
    """Embeddings and softmax by gradient steps on the texts' most toxic windows (numpy, one process)."""
    rng = np.random.default_rng(seed)
    labels = np.array([y for y, _ in rows], np.float64)
    if not len(labels):
        return ToxicityModel(np.zeros(buckets), 0.0, window, shift=-1e-6)
    if len(set(labels.tolist())) < 2:
        raise ValueError("labelled texts of both classes are needed")
    numbers: dict[str, int] = {}
    docs = [np.array([numbers.setdefault(w, len(numbers)) for w in split_words(t)], np.int64) for _, t in rows]
    keep = [k for k, d in enumerate(docs) if len(d)]
    docs, labels = [docs[k] for k in keep], labels[keep]
    grams, starts = subwords(list(numbers), buckets)
    counts = np.diff(starts).astype(np.float64)
    texts_with = np.zeros(buckets, np.int32)
    for d in docs:
        words = np.unique(d)
        sizes = starts[words + 1] - starts[words]
        upto = np.cumsum(sizes)
        texts_with[np.unique(grams[np.repeat(starts[words] - upto + sizes, sizes) + np.arange(upto[-1])])] += 1
    common = (texts_with >= min(LEAST_TEXTS, 1 + len(docs) // 20))[:, None]
    embedding = (rng.random((buckets, dimensions)) - 0.5) / dimensions * common
    output = rng.normal(size=(dimensions, 2)) / np.sqrt(dimensions)
    bias = np.zeros(2)
    squares, output_squares, bias_squares = np.full(buckets, 1e-6), np.full_like(output, 1e-6), np.full(2, 1e-6)
    share = labels.mean()
    importance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    flat = np.concatenate(docs)
    limits = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    history = []

    def word_sums(weights):
        return np.add.reduceat(weights.astype(np.float32)[grams], starts[:-1]).astype(np.float64)

    for turn in range(passes):
        weights = embedding @ (output[:, 1] - output[:, 0])
        if turn >= WHOLE_TEXTS:
            means = window_means(np.stack([word_sums(weights)[flat], counts[flat]], axis=1), limits, window)
        bags = []
        for k in range(len(docs)):
            low, high = limits[k], limits[k + 1]
            if turn < WHOLE_TEXTS:
                bags.append(flat[low:high])
                continue
            at = low + int(means[low:high].argmax())
            bags.append(flat[at : min(high, at + window)])
        rate = 0.5 if turn < WHOLE_TEXTS else 0.2
        loss = 0.0
        for batch in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // 128)):
            words = np.concatenate([bags[k] for k in batch])
            sizes = starts[words + 1] - starts[words]
            upto = np.cumsum(sizes)
            ids = grams[np.repeat(starts[words] - upto + sizes, sizes) + np.arange(upto[-1])]
            bag_of_word = np.repeat(np.arange(len(batch)), [len(bags[k]) for k in batch])
            bag = np.repeat(bag_of_word, sizes)
            length = np.bincount(bag, minlength=len(batch)).astype(np.float64)
            edges = np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)
            mean = np.add.reduceat(embedding[ids], edges, axis=0) / length[:, None]
            logits = mean @ output + bias
            logits -= logits.max(axis=1, keepdims=True)
            chance = np.exp(logits)
            chance /= chance.sum(axis=1, keepdims=True)
            y = labels[batch].astype(int)
            loss -= (importance[batch] * np.log(chance[np.arange(len(batch)), y] + 1e-12)).sum()
            chance[np.arange(len(batch)), y] -= 1
            slope = chance * importance[batch][:, None]
            by_mean = slope @ output.T
            by_output, by_bias = mean.T @ slope / len(batch), slope.mean(axis=0)
            output_squares += by_output**2
            bias_squares += by_bias**2
            output -= rate * by_output / np.sqrt(output_squares)
            bias -= rate * by_bias / np.sqrt(bias_squares)
            each = (by_mean / length[:, None])[bag]
            unique, where = np.unique(ids, return_inverse=True)
            step = np.stack([np.bincount(where, each[:, d], len(unique)) for d in range(dimensions)], axis=1)
            squares[unique] += (step**2).mean(axis=1)
            move = rate * step / np.sqrt(squares[unique])[:, None] + DECAY * embedding[unique]
            embedding[unique] -= move * common[unique]
        history.append(loss / len(docs))
    weights = embedding @ (output[:, 1] - output[:, 0])
    model = ToxicityModel(weights, float(bias[1] - bias[0]), window, history=history)
    calibrate(model, [t for _, t in rows], np.array([y for y, _ in rows], np.float64))
    return model


def calibrate(model: ToxicityModel, texts: list[str], labels: np.ndarray) -> None:
    """One-dimensional logistic regression on the texts' logits, with a ridge so that it always exists.

    Classes weigh the same. The threshold never falls below the logit of a text without words.
    """
    x = model.logits(texts, Lexicon(model.weights))
    spread = x.std() or 1.0
    z = (x - x.mean()) / spread
    importance = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    beta = np.zeros(2)
    design = np.stack([z, np.ones_like(z)], axis=1)
    ridge = np.diag([1e-3, 1e-6]) * len(z)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = design.T @ (importance * (p - labels)) + ridge @ beta
        hessian = (design * (importance * p * (1 - p))[:, None]).T @ design + ridge
        move = np.linalg.solve(hessian, gradient)
        beta -= move
        if np.abs(move).max() < 1e-10:
            break
    model.scale = float(beta[0] / spread)
    model.shift = float(beta[1] - beta[0] * x.mean() / spread)
    empty = model.scale * model.bias + model.shift
    if empty >= 0:
        model.shift -= empty + 1e-6


def score(docs: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text_column: str = "text",
          keep: tuple[Column, ...] = ()) -> DataFrame:
    """``doc_id``, the columns of ``keep``, ``score`` in 0 to 1 and ``predicted`` for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of buckets
    base = docs.select(docs[id_column].alias("doc_id"), *keep, docs[text_column].alias(reserved("text")))
    schema = T.StructType(base.schema.fields[:-1] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(sent.value.weights)
        for batch in batches:
            logits = sent.value.logits(batch.column(batch.num_columns - 1).to_pylist(), lexicon)
            scores = 1 / (1 + np.exp(-np.clip(logits, -700, 700)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=schema.names
            )

    return base.mapInArrow(run, schema)
