"""Cost-balanced packing of documents into training sequences.

A document costs ``length + quadratic * length ** 2`` (feed-forward plus attention). Documents go, in
descending order of cost, to the cheapest sequence that has room for them; if none has, the cheapest
sequence takes what it can and the rest goes on. Sequences hold at most ``seq_len`` ids.

Everything happens where the rows are read: each task packs its documents in blocks of about
``block_tokens`` ids, so nothing is shuffled, no key can be hot, and a task holds one block. A lost
task packs the same rows in the same way again. Capacities in a block add up to its ids exactly: full
sequences, then powers of two, which need no padding.

Null or empty texts have the end id only. Null ids of documents stay null. Repeated rows are packed
as often as they occur. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SEQ_LEN = 2048
END_ID = 1
BLOCK_TOKENS = 1 << 20
#: Attention of one id to another, relative to the linear work per id.
QUADRATIC = 1 / 4096
#: Pieces remembered at a time, some 200 bytes each; Python workers keep them from task to task.
KNOWN_PIECES = 400_000
#: Sequence numbers of one task follow each other from ``partition << TASK_BITS``.
TASK_BITS = 40

#: The split of the byte-level vocabulary before its merges (fixed value of the public tokenizer:
#: contractions, letters, numbers, the rest, spaces), for the characters that ``UNUSUAL`` leaves.
#: Letters are written as ranges, which are found faster than what is left of all characters.
LETTERS = "[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]"
PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?{LETTERS}+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Outside these characters libraries may disagree about letters, numbers and spaces.
UNUSUAL = re.compile("[^\t\n\v\f\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]")


def byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary writes bytes: printable Latin-1 as itself, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(0x100) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + k) for k, b in enumerate(others)}


class PieceEncoder(dict):
    """Ids of a text; pieces met before are looked up instead of being merged again.

    Numbers pieces as they come; ``ends`` says where the ids of each lie in ``flat``, and ``used`` which
    text had it last. When there is no room for a text, pieces of the earliest texts are forgotten.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        #: Texts with an added token (the end of text) have its one id there; the library finds its places.
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.merge = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.space = self.letters[0x20]
        self.forget()

    def forget(self) -> None:
        self.clear()
        # Not NumPy arrays: they grow by single pieces, and are viewed as such for whole texts.
        self.flat = array("I")
        self.ends = array("q", [0])
        self.used = np.zeros(KNOWN_PIECES, np.int64)
        self.texts = 0

    def forget_earliest(self, most: int) -> None:
        """Keep fewer than ``most`` of more pieces, those of the last texts, in their order."""
        used = self.used[: len(self)]
        kept = np.flatnonzero(used > np.partition(used, -most)[-most])
        pieces, ids, ends, used = list(self), *self.ids_of(kept), used[kept]
        self.clear()
        self.update((pieces[number], k) for k, number in enumerate(kept.tolist()))
        self.flat, self.ends = array("I", ids.tobytes()), array("q", [0])
        self.ends.frombytes(ends.tobytes())
        self.used[: len(kept)] = used

    def ids_of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these pieces one after the other, and where those of each end."""
        ends = np.frombuffer(self.ends, np.int64)
        starts = ends[which]
        sizes = ends[which + 1] - starts
        upto = np.cumsum(sizes)
        total = int(upto[-1]) if len(upto) else 0
        return np.frombuffer(self.flat, np.uint32)[np.repeat(starts - upto + sizes, sizes) + np.arange(total)], upto

    def written(self, piece: str) -> str:
        """The piece as the vocabulary writes its bytes."""
        if piece.isascii() and piece.isprintable():
            return piece.replace(" ", self.space)
        return piece.encode().decode("latin-1").translate(self.letters)

    def __missing__(self, piece: str) -> int:
        self.flat.extend([token.id for token in self.merge(self.written(piece))])
        self.ends.append(len(self.flat))
        known = self[piece] = len(self)
        return known

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        if UNUSUAL.search(text) or (self.added and self.added.search(text)):
            return self.whole(text)
        pieces = PIECES.findall(text)
        if len(self) + len(pieces) > KNOWN_PIECES:
            if len(pieces) > KNOWN_PIECES:
                return self.whole(text)
            self.forget_earliest(max(1, min(KNOWN_PIECES // 2, KNOWN_PIECES - len(pieces))))
        which = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        self.texts += 1
        self.used[which] = self.texts
        return self.ids_of(which)[0]


@lru_cache(maxsize=1)
def encoder(vocabulary: str) -> PieceEncoder:
    return PieceEncoder(vocabulary)


def cost(length: np.ndarray | float, quadratic: float) -> np.ndarray | float:
    return length + quadratic * length * length


def capacities(total: int, seq_len: int) -> np.ndarray:
    """Full sequences, then powers of two that add up to the rest."""
    rest = total % seq_len
    powers = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return np.array([seq_len] * (total // seq_len) + powers, np.int64)


def assign(lengths: list[int], seq_len: int, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(item, start in the item, length, sequence, offset) for items of at most ``seq_len`` ids."""
    room = capacities(sum(lengths), seq_len)
    size = room.copy()
    load = np.zeros(len(room))
    placed = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[item]
        while left:
            fits = room >= left
            if not fits.any():
                fits = room > 0
            to = int(np.argmin(np.where(fits, load, np.inf)))
            take = min(left, int(room[to]))
            placed.append((item, start, take, to, int(size[to] - room[to])))
            load[to] += cost(take, quadratic)
            room[to] -= take
            start += take
            left -= take
    return placed


def pack(
    docs: DataFrame,
    vocabulary: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    seq_len: int = SEQ_LEN,
    end_id: int = END_ID,
    block_tokens: int = BLOCK_TOKENS,
    quadratic: float = QUADRATIC,
    keep_ids: bool = True,
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, its ids and their CRC-32.

    ``vocabulary`` is the path of a byte-level vocabulary file that every executor has.
    """
    if seq_len < 1 or seq_len & (seq_len - 1):
        raise ValueError("seq_len must be a power of two")
    id_type = docs.schema[id_column].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
            T.StructField("cost", T.DoubleType()),
        ]
        + ([T.StructField("ids", T.BinaryType())] if keep_ids else [])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        following = TaskContext.get().partitionId() << TASK_BITS
        tails: list[tuple[object, int, np.ndarray, int]] = []  # document, start, ids, its ids in all
        waiting = 0
        rows: list[tuple] = []

        def piece(doc, start, ids, total, sequence, offset):
            raw = ids.astype("<u4").tobytes()
            row = (doc, start, len(ids), zlib.crc32(raw), total, sequence, offset, cost(len(ids), quadratic))
            rows.append((*row, raw) if keep_ids else row)

        def block():
            nonlocal following, tails, waiting
            lengths = [len(t[2]) for t in tails]
            for item, start, length, to, offset in assign(lengths, seq_len, quadratic):
                doc, first, ids, total = tails[item]
                piece(doc, first + start, ids[start : start + length], total, following + to, offset)
            following += len(capacities(sum(lengths), seq_len))
            tails, waiting = [], 0

        def flush(id_arrow):
            columns = list(zip(*rows)) if rows else [[] for _ in schema]
            kinds = [id_arrow, *[pa.int64()] * 6, pa.float64(), *[pa.binary()] * keep_ids]
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names
            )
            rows.clear()
            return out

        id_arrow = None
        for batch in batches:
            id_arrow = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id))
                whole = len(ids) - len(ids) % seq_len
                for start in range(0, whole, seq_len):
                    piece(doc, start, ids[start : start + seq_len], len(ids), following, 0)
                    following += 1
                if whole < len(ids):
                    tails.append((doc, whole, ids[whole:], len(ids)))
                    waiting += len(ids) - whole
                if waiting >= block_tokens:
                    block()
                if len(rows) >= 4096:
                    yield flush(id_arrow)
        if tails:
            block()
        if rows:
            yield flush(id_arrow)

    return docs.select(docs[id_column], docs[text_column]).mapInArrow(run, schema)
