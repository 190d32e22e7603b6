"""Maximal periodic runs of words, by recompression.

A run is a stretch of words with smallest period q, at least ``max(MIN_LENGTH, MIN_PERIODS * q)`` long,
that no neighbouring word extends. Words are numbered by an exact dictionary, and recompression builds
a grammar of the sequence: block compression gives every stretch of one repeated symbol a new symbol, pair
compression every neighbouring pair of a left and a right symbol (a hash bit of the symbol says which it
is). Both look at neighbours only, so equal stretches get equal symbols but for their ends, and each round
of the two leaves about three quarters of the sequence. The longest common extension of two places (LCE) climbs
the grammar while symbols agree and goes down where they first differ: a few steps per level, exact.

Candidates are a harmonic grid: for each period p, every ``max(2p, MIN_LENGTH - p)``-th place i with equal
words at i and i + p. A run of period p holds such a place, and the extensions of i and i + p to both sides
give the whole stretch of period p around it. A stretch found with several periods has the smallest of them
as its period, as all others are multiples (at three periods' length any two have a common divisor that
is one).

Texts are worked on where they are read, several short ones as one sequence with a separator of its own
after each; nothing is shuffled. A task holds one batch of texts, and about 150 bytes per word of one
group of them; a very long text is a group of its own. Candidates go through in chunks of fixed size.

Null, empty and wordless texts have no runs and collapse to the empty text. Equal texts have equal runs.
Ids do not matter: they may be null or repeated. An empty table gives no rows. Other columns are ignored
unless kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowbench.llm import words as W

MIN_LENGTH = 24
MIN_PERIODS = 3
#: Texts are taken in groups of about this many bytes, candidates in chunks of about this many places.
GROUP_BYTES = 1 << 19
CHUNK = 1 << 18
#: Recompression ends at so few symbols; what is left is compared one by one.
TOP = 8

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
RUN_ARROW = pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")])


def codes_of(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 on, equal for equal values."""
    return pa.array(values).dictionary_encode().indices.to_numpy().astype(np.int32)


def is_right(symbols: np.ndarray, turn: int) -> np.ndarray:
    return (W.mix64(symbols.astype(np.uint64) + np.uint64((turn + 1) << 40)) & np.uint64(1)).astype(bool)


@dataclass
class Level:
    """A sequence and how the next, shorter one groups it.

    ``first`` says where each symbol of the next sequence begins here (and where the last one ends),
    ``parent`` which of them each symbol here belongs to. ``right`` marks the symbols that end a pair;
    it is None where equal symbols became blocks.
    """

    symbols: np.ndarray
    first: np.ndarray | None = None
    parent: np.ndarray | None = None
    right: np.ndarray | None = None

    def mirrored(self) -> Level:
        """The same level read from its end."""
        n = len(self.symbols)
        if self.first is None:
            return Level(self.symbols[::-1])
        return Level(
            self.symbols[::-1], (n - self.first[::-1]).astype(np.int32),
            (len(self.first) - 2 - self.parent[::-1]).astype(np.int32),
            None if self.right is None else ~self.right[::-1],
        )


def grouped(symbols: np.ndarray, opens: np.ndarray, right: np.ndarray | None) -> Level:
    first = np.append(np.flatnonzero(opens), len(symbols)).astype(np.int32)
    return Level(symbols, first, (np.cumsum(opens) - 1).astype(np.int32), right)


def grammar(symbols: np.ndarray) -> list[Level]:
    """The levels of the recompressed sequence; symbols are numbered from 0."""
    levels, turn = [], 0
    names = int(symbols.max()) + 1 if len(symbols) else 0
    while len(symbols) > TOP:
        again = symbols[1:] == symbols[:-1]
        if again.any():
            opens = np.append(True, ~again)
            level = grouped(symbols, opens, None)
            length = np.diff(level.first)
            shorter = symbols[level.first[:-1]].copy()
            many = length > 1
            blocks = codes_of(shorter[many].astype(np.int64) << 32 | length[many])
            shorter[many] = names + blocks
            names += int(blocks.max()) + 1
            levels.append(level)
            symbols = shorter
        right = is_right(symbols, turn)
        opens = np.append(True, ~(right[1:] & ~right[:-1]))
        turn += 1
        if opens.all():
            continue
        level = grouped(symbols, opens, right)
        at = level.first[:-1]
        shorter = symbols[at].copy()
        paired = np.diff(level.first) == 2
        pairs = codes_of(symbols[at[paired]].astype(np.int64) << 32 | symbols[at[paired] + 1])
        shorter[paired] = names + pairs
        names += int(pairs.max()) + 1
        levels.append(level)
        symbols = shorter
    return [*levels, Level(symbols)]


def extensions(levels: list[Level], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many symbols of the lowest level agree from ``x`` and from ``y`` on, for each pair.

    No two different places may agree up to the end of the sequence (a separator there sees to that).
    """
    begun = x
    x, y = x.astype(np.int64), y.astype(np.int64)
    which = np.arange(len(x))
    stopped: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for level in levels:
        same = level.symbols[x] == level.symbols[y]
        if level.first is None:
            while same.any():  # at most ``TOP`` symbols are left
                x, y = x + same, y + same
                same = level.symbols[x] == level.symbols[y]
            stopped.append((which, x, y))
            break
        ends = np.zeros(len(x), bool)
        if level.right is not None:
            step = level.right[x] & same  # a right symbol ends its pair, a left one begins it
            x, y = x + step, y + step
        else:
            px, py = level.parent[x], level.parent[y]
            inside = same & ((level.first[px] != x) | (level.first[py] != y))
            left_x, left_y = level.first[px + 1] - x, level.first[py + 1] - y
            step = np.where(inside, np.minimum(left_x, left_y), 0)
            ends = inside & (left_x != left_y)  # one block goes on, the other is over
            x, y = x + step, y + step
        out = ~same | ends
        stopped.append((which[out], x[out], y[out]))
        go = ~out
        which, x, y = which[go], level.parent[x[go]].astype(np.int64), level.parent[y[go]].astype(np.int64)
    which, x, y = stopped.pop()
    for level, more in zip(levels[len(stopped) - 1 :: -1] if stopped else [], stopped[::-1]):
        # these symbols differ one level above: their parts here agree in the first one at most
        above_x, above_y = x, y
        x, y = level.first[x].astype(np.int64), level.first[y].astype(np.int64)
        same = level.symbols[x] == level.symbols[y]
        if level.right is not None:
            step = same
        else:
            step = np.where(same, np.minimum(level.first[above_x + 1] - x, level.first[above_y + 1] - y), 0)
        x, y = x + step, y + step
        which, x, y = (np.concatenate(both) for both in zip((which, x, y), more))
    out = np.empty(len(begun), np.int64)
    out[which] = x
    return out - begun


def grid(counts: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) to look at, for texts of ``counts`` words from the places ``first`` on, in chunks."""
    most = counts // MIN_PERIODS
    most[counts < MIN_LENGTH] = 0
    for low in range(0, len(counts), 4096):
        text = np.repeat(np.arange(low, min(low + 4096, len(counts))), most[low : low + 4096])
        if not len(text):
            continue
        ends = np.cumsum(most[low : low + 4096])
        period = np.arange(len(text)) - (ends - most[low : low + 4096])[text - low] + 1
        step = np.maximum((MIN_PERIODS - 1) * period, MIN_LENGTH - period)
        places = (counts[text] - period - 1) // step + 1
        upto = np.cumsum(places)
        at = 0
        while at < len(text):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, "right")))
            n = places[at:stop]
            which = np.repeat(np.arange(at, stop), n)
            k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            yield first[text[which]] + k * step[which], period[which]
            at = stop


def find_runs(symbols: np.ndarray, counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and then period; starts are places of ``symbols``.

    ``symbols`` holds the texts with a symbol that occurs nowhere else before the first and after each.
    """
    chunks = [(i[keep], p[keep]) for i, p in grid(counts, first) for keep in [symbols[i] == symbols[i + p]]]
    if not sum(len(i) for i, _ in chunks):
        return (np.empty(0, np.int64),) * 3
    levels = grammar(symbols)
    after = [extensions(levels, i, i + p) for i, p in chunks]
    levels = [level.mirrored() for level in levels]
    last = len(symbols) - 1
    found = []
    for (i, p), right in zip(chunks, after):
        left = extensions(levels, last - i, last - i - p)  # the place itself agrees and counts on both sides
        length = left - 1 + right + p
        run = length >= np.maximum(MIN_LENGTH, MIN_PERIODS * p)
        found.append(np.stack([(i - left + 1)[run], length[run], p[run]]))
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)  # one stretch with several periods: the smallest is its own
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def spaced_words(data: np.ndarray, words: W.Words) -> pa.Array:
    """All words, each followed by one space, end to end in one buffer."""
    size = words.end - words.begin
    ends = np.cumsum(size + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    letter = np.ones(len(out), bool)
    letter[ends - 1] = False
    out[letter] = data[~W.IS_SEPARATOR[data]]
    offsets = np.append(0, ends)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def runs_of_group(data: np.ndarray, limits: np.ndarray) -> tuple[W.Words, pa.Array, list[list[dict]], pa.Array]:
    """Words, their spaced form, runs per text, and the texts without what runs repeat."""
    words = W.find_words(data, limits)
    spaced = spaced_words(data, words)
    texts, total = len(words.count), len(words.begin)
    codes = spaced.dictionary_encode().indices.to_numpy().astype(np.int32) if total else np.empty(0, np.int32)
    symbols = np.empty(total + texts + 1, np.int32)
    place = np.arange(total) + words.text + 1
    symbols[place] = codes
    own = np.ones(len(symbols), bool)
    own[place] = False
    symbols[own] = np.arange(texts + 1) + (int(codes.max()) + 1 if total else 0)
    first = words.first + np.arange(texts) + 1
    start, length, period = find_runs(symbols, words.count.copy(), first)
    text = np.searchsorted(first, start, "right") - 1

    change = np.zeros(total + 1, np.int64)
    begin = start - text - 1  # among all words
    np.add.at(change, begin + period, 1)
    np.add.at(change, begin + length, -1)
    kept = np.cumsum(change[:-1]) == 0
    rest = spaced.take(pa.array(np.flatnonzero(kept)))
    ends = np.append(0, np.cumsum(kept))[np.append(words.first, total)]
    offsets = np.frombuffer(rest.buffers()[1], np.int64)[: len(rest) + 1] if len(rest) else np.zeros(1, np.int64)
    cuts = offsets[ends]
    body = rest.buffers()[2].to_pybytes()[: int(offsets[-1])] if len(rest) else b""
    collapsed = pa.array([body[a : b - 1] if b > a else b"" for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary()).cast(pa.string())

    runs: list[list[dict]] = [[] for _ in range(texts)]
    for t, s, n, p in zip(text.tolist(), (start - first[text]).tolist(), length.tolist(), period.tolist()):
        runs[t].append({"start": s, "length": n, "period": p})
    return words, spaced, runs, collapsed


def periodic_runs(docs: DataFrame, text_column: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep``, n_words, runs (by start, then period) and collapsed.

    ``collapsed`` holds the words, joined by one space, that no run repeats: of each run its first period
    stays, as far as no other run repeats it.
    """
    base = docs.select(*(docs[c] for c in keep), docs[text_column].cast("string").alias("text"))
    added = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())]
    schema = T.StructType(base.schema.fields[:-1] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, limits = W.text_bytes(batch.column(batch.num_columns - 1))
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(limits, limits[at] + GROUP_BYTES, "right")) - 1)
                words, _, runs, collapsed = runs_of_group(data[limits[at] : limits[upto]], limits[at : upto + 1] - limits[at])
                kept = [c.slice(at, upto - at) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(words.count, pa.int64()), pa.array(runs, pa.list_(pa.field("element", RUN_ARROW, False))), collapsed],
                    names=schema.names,
                )
                at = upto

    return base.mapInArrow(run, schema)
