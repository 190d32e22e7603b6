"""Removing passages that repeat across documents, by a distributed sparse suffix array on bytes.

Each byte covered by a string of ``LENGTH`` bytes that also starts in a document with a smaller id is
removed. Strings that start next to each other and share their minimal ``ANCHOR``-byte token (by a hash)
form a run; equal strings have equal minimal tokens, so only runs of the same token can match.

1. Tokens are dealt by hash to buckets, and runs whose token occurs in one text only are dropped; what
   repeats within one batch of texts is known there, so a passage in every text costs two entries a batch.
2. The suffixes of the remaining runs are range-partitioned by the token's leading bytes, between splitters
   sampled from the texts. Buckets sort their suffixes by multikey quicksort, eight bytes at a time, parts
   of one element or one document dropping out.
3. A token that spans several splitters is too frequent for one bucket: its suffixes are dealt evenly,
   and compared across the boundaries by one minimum per string and a join that Spark can split.

Equal texts take part once, by their smallest id; the others are removed whole. Long texts are worked
through in segments. Matches never cross documents; strings are judged on the input.

Null texts are empty. Texts shorter than ``LENGTH`` keep all. Repeated rows have equal results: an id is
not smaller than itself. Null ids come after all others, so their texts never remove anything. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbench.llm import words as W
from flowbench.sources.tables import write_table

LENGTH = 50
ANCHOR = 20
#: Anchors in a string.
PLACES = LENGTH - ANCHOR + 1
#: Windows of a text are taken in segments of this many, and segments together up to this many bytes.
SEGMENT = 1 << 19
GROUP_BYTES = 1 << 20
#: Texts of an Arrow batch are taken together up to this many bytes.
PIECE_BYTES = 1 << 23
#: Bytes of a token's hash that go to its bucket: some two million tokens, of which a chance pair does no harm.
TOKEN_BYTES = 5
#: Text bytes per bucket of the first step; suffix buckets per such bucket.
BUCKET_BYTES = 32 << 20
SUFFIX_BUCKETS = 8
MAX_BUCKETS = 1 << 16
#: Texts that splitters are sampled from, about.
SAMPLED_TEXTS = 4000
LAST_ID = (1 << 63) - 1


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """At each byte, the number that it and the next seven make (little-endian); a view."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def runs(data: np.ndarray, limits: np.ndarray, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of strings in texts on end, group by group: (text, first string, strings, token hash, leading bytes).

    ``wanted`` are sorted numbers ``text << 32 | first``; with it, only those runs are given, and only
    then are the leading bytes of their tokens.
    """
    last = limits[1:] - LENGTH + 1  # past each text's last string
    full = np.flatnonzero(last > limits[:-1])
    pieces = -(-(last[full] - limits[full]) // SEGMENT)
    text = np.repeat(full, pieces)
    number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = limits[text] + number * SEGMENT
    end = np.minimum(begin + SEGMENT, last[text])
    at = 0
    while at < len(text):
        upto = max(at + 1, int(np.searchsorted(end, begin[at] + GROUP_BYTES, "right")))
        base = begin[at]
        part = np.ascontiguousarray(data[base : end[upto - 1] + LENGTH - 1])
        eight = eight_bytes(part)
        n = len(part) - ANCHOR + 1
        token = eight[:n] * np.uint64(0x9E3779B97F4A7C15) + W.mix64(eight[8 : 8 + n]) + eight[12 : 12 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
        token = W.mix64(token)  # of all ANCHOR bytes
        least = sliding_minimum(token, PLACES)
        inside = np.zeros(len(least) + 1, np.int8)
        inside[begin[at:upto] - base] += 1
        np.subtract.at(inside, end[at:upto] - base, 1)
        starts = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
        values = least[starts]
        new = np.ones(len(starts), bool)
        new[1:] = values[1:] != values[:-1]
        new[np.searchsorted(starts, begin[at:upto] - base)] = True
        heads = np.flatnonzero(new)
        first, count, hashed = starts[heads], np.diff(np.append(heads, len(starts))), values[heads]
        owner = text[at:upto][np.searchsorted(begin[at:upto], first + base, "right") - 1]
        place = first + base - limits[owner]
        lead = np.empty(0, np.uint64)
        if wanted is not None:
            key = owner << 32 | place
            where = np.minimum(np.searchsorted(wanted, key), max(0, len(wanted) - 1))
            take = wanted[where] == key if len(wanted) else np.zeros(len(key), bool)
            first, owner, place, count, hashed = (v[take] for v in (first, owner, place, count, hashed))
            lead = np.empty(len(first), np.uint64)
            for k in range(0, len(first), 1 << 15):
                some = first[k : k + (1 << 15)]
                lead[k : k + (1 << 15)] = eight[some + token[some[:, None] + np.arange(PLACES)].argmin(axis=1)]
            lead = lead.byteswap()
        yield owner, place, count, hashed, lead
        at = upto


def all_runs(data: np.ndarray, limits: np.ndarray, wanted: np.ndarray | None = None) -> list[np.ndarray]:
    parts = list(zip(*runs(data, limits, wanted)))
    return [np.concatenate(p) for p in parts] if parts else [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)] * 2


def pieces(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``PIECE_BYTES`` of text."""
    upto = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PIECE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


# --- step 1: which runs have a token that occurs in several texts

ENTRIES = "bucket int, known boolean, ids binary, texts binary, counts binary, tokens binary, places binary"


def planes(values: np.ndarray) -> bytes:
    """Differences of places, byte plane by byte plane: high planes are zeros, which compress."""
    return np.diff(values, prepend=0).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    part = np.frombuffer(data, np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(part).view("<i4")[:, 0], dtype=np.int64)


def entry(bucket: int, known: bool, ids: np.ndarray, texts: np.ndarray, owner: np.ndarray, place: np.ndarray, token: np.ndarray) -> dict:
    docs, counts = np.unique(owner, return_counts=True)
    return {
        "bucket": bucket, "known": known, "ids": ids[docs].tobytes(), "texts": texts[docs].tobytes(), "counts": counts.astype("<u4").tobytes(),
        "tokens": b"" if known else np.ascontiguousarray(token.view(np.uint8).reshape(-1, 8)[:, -TOKEN_BYTES:]).tobytes(), "places": planes(place),
    }


def token_entries(texts: DataFrame, buckets: int) -> DataFrame:
    schema = pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), *((c, pa.binary()) for c in ("ids", "texts", "counts", "tokens", "places"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, np.diff(W.text_bytes(whole.column(2))[1]))):
            ids, marks = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            owner, place, _, token, _ = all_runs(*W.text_bytes(batch.column(2)))
            if not len(owner):
                continue
            order = np.argsort(token, kind="stable")
            heads = np.flatnonzero(np.concatenate([[True], token[order][1:] != token[order][:-1]]))
            mark = marks[owner[order]]
            several = np.minimum.reduceat(mark, heads) != np.maximum.reduceat(mark, heads)
            group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
            known = several[group]
            sent = ~known
            # of a token known to repeat, two entries of different texts tell the other batches
            sent[heads[several]] = True
            other = np.flatnonzero(known & (mark != mark[heads][group]))
            sent[other[np.unique(group[other], return_index=True)[1]]] = True
            here, away = np.sort(order[known]), np.sort(order[sent])
            rows = []
            if len(here):
                rows.append(entry(int(ids[owner[here[0]]] % buckets), True, ids, marks, owner[here], place[here], token[here]))
            at = (token[away] % np.uint64(buckets)).astype(np.int64)
            by_bucket = np.argsort(at, kind="stable")
            edges = np.searchsorted(at[by_bucket], np.arange(buckets + 1)) if buckets <= len(at) else None
            for b in range(buckets) if edges is not None else np.unique(at):
                some = away[by_bucket[edges[b] : edges[b + 1]]] if edges is not None else away[at == b]
                if len(some):
                    rows.append(entry(int(b), False, ids, marks, owner[some], place[some], token[some]))
            for k in range(0, len(rows), 64):
                yield pa.RecordBatch.from_pylist(rows[k : k + 64], schema=schema)

    return texts.mapInArrow(run, ENTRIES)


def repeated_runs(entries: DataFrame, buckets: int) -> DataFrame:
    """(dk, mark, at): the runs whose token occurs in several texts, perhaps a few more."""

    def frame(ids: np.ndarray, marks: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(marks), pa.array(places.astype(np.int32))], names=["dk", "mark", "at"])

    def decode(row: dict) -> tuple[np.ndarray, ...]:
        """Ids and marks of the texts, and per run the text's number, place and token."""
        ids, marks = (np.frombuffer(row[c], np.int64) for c in ("ids", "texts"))
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), np.frombuffer(row["counts"], "<u4"))
        tokens = np.zeros((len(owner) if row["tokens"] else 0, 8), np.uint8)
        if row["tokens"]:
            tokens[:, :TOKEN_BYTES] = np.frombuffer(row["tokens"], np.uint8).reshape(-1, TOKEN_BYTES)
        return ids, marks, owner, from_planes(row["places"]).astype(np.int32), tokens.view("<u8")[:, 0]

    def settle(rows: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        first = np.cumsum([0, *(len(r[0]) for r in rows[:-1])])
        ids, marks = (np.concatenate([r[c] for r in rows]) for c in (0, 1))
        owner = np.concatenate([r[2] + np.int32(f) for r, f in zip(rows, first)])
        places, tokens = (np.concatenate([r[c] for r in rows]) for c in (3, 4))
        rows.clear()
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        heads = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        mark = marks[owner[order]]
        several = np.minimum.reduceat(mark, heads) != np.maximum.reduceat(mark, heads)
        found = order[np.repeat(several, np.diff(np.append(heads, len(order))))]
        for k in range(0, len(found), 1 << 16):
            some = found[k : k + (1 << 16)]
            yield frame(ids[owner[some]], marks[owner[some]], places[some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if row["known"]:
                    ids, marks, owner, places, _ = decode(row)
                    yield frame(ids[owner], marks[owner], places)
                    continue
                if row["bucket"] != bucket and rows:
                    yield from settle(rows)
                bucket = row["bucket"]
                rows.append(decode(row))
        if rows:
            yield from settle(rows)

    return entries.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "dk long, mark long, at int")


# --- step 2: sort the suffixes of what is left

def sampled_splitters(texts: DataFrame, count: int, buckets: int) -> np.ndarray:
    """Leading bytes that cut the suffixes into about equal buckets, from the runs of some texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, np.diff(W.text_bytes(whole.column(2))[1]))):
            data, limits = W.text_bytes(batch.column(2))
            owner, place, _, token, _ = all_runs(data, limits)
            some = np.argsort(token)[:: max(1, len(token) // (32 * batch.num_rows))]
            wanted = np.sort(owner[some] << 32 | place[some])
            yield pa.RecordBatch.from_arrays([pa.array(all_runs(data, limits, wanted)[4].view(np.int64))], names=["lead"])

    share = max(1, count // SAMPLED_TEXTS)
    sample = texts.filter(F.pmod(F.xxhash64("dk", "mark"), F.lit(share)) == 0).mapInArrow(run, "lead long")
    leads = np.sort(np.array([r[0] for r in sample.collect()], np.int64).view(np.uint64))  # about 32 of each sampled text
    return leads[(np.arange(1, buckets) * len(leads)) // buckets] if len(leads) else leads


def packed_texts(texts: DataFrame) -> DataFrame:
    """The texts compressed, for the joins that bring them together with what was found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = pa.Codec("zstd", compression_level=3)
        for batch in (piece for whole in batches for piece in pieces(whole, np.diff(W.text_bytes(whole.column(3))[1]))):
            packed, sizes = [], []
            for text in batch.column(3):
                raw = text.as_buffer()
                sizes.append(raw.size)
                packed.append(zstd.compress(raw, asbytes=True))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "dk", "mark", "size", "packed"]
            )

    return texts.select("doc_id", "dk", "mark", "text").mapInArrow(run, "doc_id long, dk long, mark long, size long, packed binary")


def unpacked(sizes: pa.Array, packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    zstd = pa.Codec("zstd")
    sizes = np.asarray(sizes)
    limits = np.concatenate([[0], np.cumsum(sizes)])
    data = np.empty(limits[-1], np.uint8)
    for k, part in enumerate(packed):
        if sizes[k]:
            data[limits[k] : limits[k + 1]] = np.frombuffer(zstd.decompress(part.as_buffer(), int(sizes[k])), np.uint8)
    return data, limits


RUNS = "bucket int, hot boolean, runs int, texts int, size long, body binary"


def pack_runs(bucket: int, hot: bool, ids: np.ndarray, marks: np.ndarray, owner: np.ndarray, place: np.ndarray, size: np.ndarray, content: bytes) -> dict:
    """Runs of one bucket from one piece of texts, compressed together."""
    texts, counts = np.unique(owner, return_counts=True)
    body = b"".join((
        np.diff(ids[texts], prepend=0).astype("<i8").tobytes(), marks[texts].astype("<i8").tobytes(), counts.astype("<u4").tobytes(),
        size.astype("<u4").tobytes(), planes(place), content,
    ))
    packed = pa.Codec("zstd", compression_level=1).compress(body, asbytes=True)
    return {"bucket": bucket, "hot": hot, "runs": len(owner), "texts": len(texts), "size": len(body), "body": packed}


def unpack_runs(row: dict) -> tuple[np.ndarray, ...]:
    """Per run: id and mark of its text, place, number of bytes; and all bytes on end."""
    body = np.frombuffer(pa.Codec("zstd").decompress(row["body"], row["size"]), np.uint8)
    runs, texts = row["runs"], row["texts"]
    cuts = np.cumsum([8 * texts, 8 * texts, 4 * texts, 4 * runs, 4 * runs])
    ids, marks, counts, size, place, content = np.split(body, cuts)
    counts = counts.view("<u4")
    return (
        np.repeat(np.cumsum(ids.view("<i8")), counts), np.repeat(marks.view("<i8"), counts), from_planes(place.tobytes()), size.view("<u4").astype(np.int64), content,
    )


def suffix_runs(found: DataFrame, splitters: np.ndarray) -> DataFrame:
    """The bytes of the runs, by the bucket of their token; ``hot`` if a token spans several buckets."""
    frequent = np.unique(splitters[1:][splitters[1:] == splitters[:-1]])
    schema = pa.schema([("bucket", pa.int32()), ("hot", pa.bool_()), ("runs", pa.int32()), ("texts", pa.int32()), ("size", pa.int64()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, np.asarray(whole.column(2)))):
            order = np.argsort(np.asarray(batch.column(0)), kind="stable")  # ids that ascend compress better
            batch = batch.take(pa.array(order))
            ids, marks = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            data, limits = unpacked(batch.column(2), batch.column(3))
            at = batch.column(4)
            wanted = np.sort(np.repeat(np.arange(len(ids)), np.diff(np.asarray(at.offsets))) << 32 | np.asarray(at.flatten()))
            owner, place, count, _, lead = all_runs(data, limits, wanted)
            if not len(owner):
                continue
            bucket = np.searchsorted(splitters, lead, "right")
            bucket[np.isin(lead, frequent)] = -1
            by_bucket = np.argsort(bucket, kind="stable")
            heads = np.flatnonzero(np.concatenate([[True], np.diff(bucket[by_bucket]) != 0]))
            rows = []
            for low, high in zip(heads, [*heads[1:], len(owner)]):
                some = by_bucket[low:high]
                size = count[some] + LENGTH - 1
                upto = np.cumsum(size)
                content = data[np.repeat(limits[owner[some]] + place[some] - upto + size, size) + np.arange(upto[-1])].tobytes()
                number = int(bucket[some[0]])
                to = number if number >= 0 else int(ids[0] % (len(splitters) + 1))
                rows.append(pack_runs(to, number < 0, ids, marks, owner[some], place[some], size, content))
            for k in range(0, len(rows), 64):
                yield pa.RecordBatch.from_pylist(rows[k : k + 64], schema=schema)

    return found.mapInArrow(run, RUNS)


def repeats(data: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which strings also start in a document with a smaller id: multikey quicksort, eight bytes a key."""
    out = np.zeros(len(starts), bool)
    eight = eight_bytes(data)
    left, part = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for offset in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        if not len(left):
            return out
        key = eight[starts[left] + offset].byteswap()
        order = np.argsort(key)
        if offset:  # within the parts: by part and rank of the key, as one number
            ordered = key[order]
            rank = np.empty(len(order), np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            order = np.argsort(part << 32 | rank)
        left, part, key = left[order], part[order], key[order]
        new = np.ones(len(left), bool)
        new[1:] = (part[1:] != part[:-1]) | (key[1:] != key[:-1])
        heads = np.flatnonzero(new)
        owners = ids[left]
        least = np.minimum.reduceat(owners, heads)
        part = np.cumsum(new) - 1
        several = (least != np.maximum.reduceat(owners, heads))[part]
        least = least[part][several]
        left, part = left[several], part[several]
    out[left] = ids[left] > least
    return out


SPANS = "dk long, mark long, begin int, end int, string binary"


def sorted_buckets(suffixes: DataFrame, buckets: int) -> DataFrame:
    """Spans of repeated bytes found within buckets, and single strings of hot tokens."""
    schema = pa.schema([("dk", pa.int64()), ("mark", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("string", pa.binary())])

    def strings_of(size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per string: where it starts in the bytes, its run, and its place within the run."""
        count = size - LENGTH + 1
        row = np.repeat(np.arange(len(count)), count)
        within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(np.cumsum(size) - size, count) + within, row, within

    def spans(ids: np.ndarray, marks: np.ndarray, begin: np.ndarray, end: np.ndarray, string: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(marks), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), string], schema=schema
        )

    def settle(rows: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        ids, marks, at, size, data = (np.concatenate(c) for c in zip(*rows))
        rows.clear()
        starts, row, within = strings_of(size)
        found = np.flatnonzero(repeats(data, starts, ids[row]))
        if not len(found):
            return
        row, place = row[found], at[row[found]] + within[found]
        new = np.ones(len(found), bool)
        new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(found)) - 1
        yield spans(ids[row[heads]], marks[row[heads]], place[heads], place[tails] + LENGTH, pa.nulls(len(heads), pa.binary()))

    def single(ids: np.ndarray, marks: np.ndarray, at: np.ndarray, size: np.ndarray, data: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts, row, within = strings_of(size)
        for k in range(0, len(starts), 1 << 15):
            some = slice(k, k + (1 << 15))
            bytes_ = data[starts[some][:, None] + np.arange(LENGTH)].reshape(-1)
            offsets = (np.arange(len(bytes_) // LENGTH + 1) * LENGTH).astype(np.int32)
            string = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(bytes_)])
            begin = at[row[some]] + within[some]
            yield spans(ids[row[some]], marks[row[some]], begin, begin + LENGTH, string)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if row["hot"]:
                    yield from single(*unpack_runs(row))
                    continue
                if row["bucket"] != bucket and rows:
                    yield from settle(rows)
                bucket = row["bucket"]
                rows.append(unpack_runs(row))
        if rows:
            yield from settle(rows)

    return suffixes.repartition(buckets, "bucket").sortWithinPartitions("hot", "bucket").mapInArrow(run, SPANS)


# --- step 3: put spans together and cut them out

CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def cut_out(found: DataFrame, keep_bytes: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, np.asarray(whole.column(1)))):
            data, limits = unpacked(batch.column(1), batch.column(2))
            rows = []
            for k, (doc, copy, spans) in enumerate(zip(batch.column(0), batch.column(3), batch.column(4))):
                text = data[limits[k] : limits[k + 1]]
                depth = np.zeros(len(text) + 1, np.int32)
                if copy.as_py() and len(text) >= LENGTH:
                    depth[0], depth[-1] = 1, -1
                elif spans.is_valid:
                    values = spans.values
                    np.add.at(depth, np.asarray(values.field("begin")), 1)
                    np.subtract.at(depth, np.asarray(values.field("end")), 1)
                gone = np.cumsum(depth[:-1]) > 0
                kept = text[~gone].tobytes()
                n_spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
                rows.append((doc.as_py(), len(text), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in CUT.split(", ")])

    return found.mapInArrow(run, CUT)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_bytes: bool = True) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the ``kept`` bytes if asked for."""
    text = F.coalesce(docs[text_column].cast("string"), F.lit(""))
    texts = docs.select(docs[id_column].cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", F.coalesce("doc_id", F.lit(LAST_ID)).alias("dk"), F.xxhash64("text").alias("mark"), "text"
    )
    same = ("mark", F.hash("text").alias("other"), F.crc32(F.encode("text", "UTF-8")).alias("third"))
    marks = write_table(texts.select("dk", *same, F.octet_length("text").cast("long").alias("size")), "repeats-texts")
    count, size = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = min(MAX_BUCKETS, size // BUCKET_BYTES + 1)
    first = marks.groupBy("mark", "other", "third").agg(F.min("dk").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = marks.join(first, ["mark", "other", "third"]).filter("dk > first").select("dk", "mark").distinct()
    copies = write_table(copies.withColumn("copy", F.lit(True)), "repeats-copies")

    plain = texts.select("dk", "mark", "text")
    splitters = sampled_splitters(plain, count, min(MAX_BUCKETS, SUFFIX_BUCKETS * buckets))
    places = repeated_runs(token_entries(plain, buckets), buckets)
    by_text = places.groupBy("dk", "mark").agg(F.collect_set("at").alias("places")).join(copies, ["dk", "mark"], "left_anti")
    held = packed_texts(texts)
    found = by_text.join(held, ["dk", "mark"]).select("dk", "mark", "size", "packed", "places")
    spans = write_table(sorted_buckets(suffix_runs(found, splitters), len(splitters) + 1), "repeats-spans")

    hot = spans.filter("string is not null")
    least = hot.groupBy("string").agg(F.min("dk").alias("least"))
    across = hot.join(least, "string").filter("least < dk").select("dk", "mark", "begin", "end")
    whole = spans.filter("string is null").select("dk", "mark", "begin", "end").unionByName(across)
    by_text = whole.groupBy("dk", "mark").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    joined = held.join(by_text, ["dk", "mark"], "left").join(copies, ["dk", "mark"], "left")
    out = cut_out(joined.select("doc_id", "size", "packed", F.coalesce("copy", F.lit(False)).alias("copy"), "spans"), keep_bytes)
    return out if keep_bytes else out.drop("kept")
