"""Words of many texts at once, on their UTF-8 bytes: limits, hashes, shingles.

Texts come as an Arrow string column; nothing here makes a Python object per word. Words are runs of
bytes other than space and 0x09-0x0D, so they are the same as on code points.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from flowbench.llm.common import SEPARATORS

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes hashed at once; cuts fall between words.
SEGMENT = 1 << 21

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[list(SEPARATORS)] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each input bit moves all output bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and where each begins (one more entry than texts); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    limits = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[limits[0] : limits[-1]], limits - limits[0]


@dataclass
class Words:
    begin: np.ndarray
    end: np.ndarray
    text: np.ndarray  # which text each word belongs to
    count: np.ndarray  # words per text
    first: np.ndarray  # place of each text's first word


def find_words(data: np.ndarray, limits: np.ndarray) -> Words:
    inside = ~IS_SEPARATOR[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    cuts = limits[(limits > 0) & (limits < len(data))]
    opens[cuts] = inside[cuts]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    closes[cuts - 1] = inside[cuts - 1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(begin, limits)
    count = np.diff(first)
    return Words(begin, end, np.repeat(np.arange(len(count)), count), count, first[:-1])


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    """64-bit hash of each word: a polynomial in an odd base, then mixed with its length."""
    out = np.empty(len(words.begin), np.uint64)
    at = 0
    while at < len(out):
        low = words.begin[at]
        upto = max(at + 1, int(np.searchsorted(words.end, low + SEGMENT, "right")))
        part = data[low : words.end[upto - 1]]
        power = np.full(len(part) + 1, BASE)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
        begin, end = words.begin[at:upto] - low, words.end[at:upto] - low
        # the same word at another place differs by a power of the base; bring all to one power
        value = (total[end] - total[begin]) * power[len(part) - begin]
        out[at:upto] = value * inverse_power(len(part))
        at = upto
    return mix64(out + (words.end - words.begin).astype(np.uint64))


INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def inverse_power(n: int) -> np.uint64:
    return np.uint64(pow(int(INVERSE), n, 1 << 64))


def shingles(hashes: np.ndarray, words: Words, k: int) -> list[np.ndarray]:
    """Per text, the sorted distinct hashes of its runs of ``k`` words.

    A text of fewer words has one, of all its words; a text without words has none.
    """
    n = len(hashes)
    run = np.zeros(n, np.uint64)
    for j in range(k):
        run[: n - j] += mix64(hashes[j:] + np.uint64(j + 1)) if j < n else 0
    run = mix64(run)
    out = []
    for first, count in zip(words.first.tolist(), words.count.tolist()):
        if count >= k:
            out.append(np.unique(run[first : first + count - k + 1]))
        elif count:
            place = np.arange(1, count + 1, dtype=np.uint64)
            short = mix64(hashes[first : first + count] + place).sum(dtype=np.uint64, keepdims=True)
            out.append(mix64(short ^ np.uint64(count)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
