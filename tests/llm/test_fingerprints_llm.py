import hashlib
import random
import re
import struct

import pytest
import xxhash
from llm_samples import awkward_docs, awkward_texts
from pyspark.sql import functions as F

from flowbench.llm import fingerprints as P


def test_edits_likeness_and_order(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS_PER_BUCKET", 10)
    rows = [(i, t) for i, t in awkward_texts() if i is not None]
    rows = list(dict(rows).items())
    frame = P.edit_report(awkward_docs(spark, rows).repartition(3))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    got = {r.doc_id: r for r in frame.collect()}
    texts = [(i, t or "") for i, t in sorted(rows)]
    prints = {}
    for k, (i, text) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        row = got[i]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, row.fingerprint) == row.fingerprint
        if edited == text:
            assert row.edited_fingerprint == row.fingerprint and row.near_edited == 1.0
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
        if text == after:
            assert row.near_next == 1.0
    assert got[200].near_edited > 0.5 > got[200].near_next
    assert len(got) == len(rows)


def test_repeated_rows_nulls_and_empty(spark):
    rows = awkward_texts()
    out = P.edit_report(awkward_docs(spark, rows)).collect()
    assert len(out) == len(rows)
    assert P.edit_report(awkward_docs(spark, [])).count() == 0
    one = P.edit_report(awkward_docs(spark, [(5, "a b c d e f g h")])).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a b c d e fa b").hexdigest() or one.n_chars == 15


def test_order_matters_and_occurrences_count(spark):
    words = [f"w{k}" for k in range(400)]
    swapped = words[200:] + words[:200]
    rows = [(1, " ".join(words)), (2, " ".join(swapped)), (3, " ".join(words[:390])), (4, "a b " * 40), (5, "a b " * 80)]
    docs = awkward_docs(spark, rows).select("doc_id", P.sketch(F.col("text")).alias("s"))
    pairs = docs.alias("a").join(docs.alias("b"), F.col("a.doc_id") < F.col("b.doc_id")).select(
        F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"), P.likeness(F.col("a.s"), F.col("b.s")).alias("l")
    )
    like = {(r.a, r.b): r.l for r in pairs.collect()}
    assert like[1, 3] > 0.85 > like[1, 2] > 0  # same k-mers, halves exchanged
    assert like[4, 5] < 1  # the longer one repeats the k-mers more often


def chained(*parts):
    """Spark's xxhash64 of several values: each hash seeds the next."""
    seed = 42
    for part in parts:
        seed = xxhash.xxh64_intdigest(part, seed)
    return seed


def long(x):
    return struct.pack("<Q", x % (1 << 64))


def plain_sketch(text):
    tokens = [xxhash.xxh64_intdigest(t.encode(), 42) for t in re.findall(P.TOKEN, text)]
    if not tokens:
        return []
    tokens += [0] * (P.K - len(tokens))
    seen, cells = {}, {}
    for i in range(len(tokens) - P.K + 1):
        kmer = chained(*map(long, tokens[i : i + P.K])) % (1 << P.KMER_BITS)
        number = seen[kmer] = seen.get(kmer, -1) + 1
        value = chained(long(kmer), struct.pack("<i", number))
        cells.setdefault(value % P.CELLS, []).append((value >> 32, i))
    order = sorted(cells)
    smallest = {c: sorted(cells[c]) for c in order}
    out = []
    for c, following in zip(order, [*order[1:], order[0]]):
        first = smallest[c][0]
        second = smallest[c][1] if len(smallest[c]) > 1 else smallest[following][0]
        pair = [v for v, _ in sorted([first, second], key=lambda e: (e[1], e[0]))]
        out.append((c << P.HASH_BITS) | (chained(*map(long, pair)) & P.HASHES))
    return out


def plain_likeness(a, b):
    either = {x >> P.HASH_BITS for x in a} | {x >> P.HASH_BITS for x in b}
    return (len(set(a) & set(b)) / len(either)) ** 0.5 if either else 1.0


def test_equals_plain_version(spark):
    rng = random.Random(5)
    rows = [(i, t) for i, t in dict(awkward_texts()).items() if i is not None]
    rows += [(10_000 + n, " ".join(rng.choice(["ab", "cde", "fghijk", "λμ", "x"]) + str(rng.randrange(n)) for _ in range(n))) for n in range(1, 90, 7)]
    got = {r.doc_id: r for r in P.edit_report(awkward_docs(spark, rows)).collect()}
    texts = [(i, t or "") for i, t in sorted(rows)]
    for k, (i, text) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        cut = len(text) // 4
        own, edited, next_own = map(plain_sketch, (text, text[: len(text) - cut] + after[:cut], after))
        assert got[i].fingerprint == "-".join(f"{x:x}" for x in own), i
        assert got[i].edited_fingerprint == "-".join(f"{x:x}" for x in edited), i
        assert got[i].near_edited == pytest.approx(plain_likeness(own, edited))
        assert got[i].near_next == pytest.approx(plain_likeness(own, next_own))


def test_short_texts_keep_their_order(spark):
    rows = []
    for n in (30, 60, 100):
        for trial in range(20):
            words = [f"{trial:x}{k:02x}" for k in range(n)]
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[n // 2 :] + words[: n // 2]))]
            rows += [(len(rows), " ".join([*words[:-2], "zz", "zy"])), (len(rows) + 1, None)]
    sketches = dict(awkward_docs(spark, rows).select("doc_id", P.sketch(F.col("text"))).collect())
    for n, start in ((30, 0), (60, 80), (100, 160)):
        base = range(start, start + 80, 4)
        swapped = sum(plain_likeness(sketches[i], sketches[i + 1]) for i in base) / 20
        ended = sum(plain_likeness(sketches[i], sketches[i + 2]) for i in base) / 20
        # halves exchanged, nearly all k-mers kept: about half of the pairs change their order
        assert swapped < 0.8 < ended, (n, swapped, ended)


def test_positions_of_very_long_texts(spark, monkeypatch):
    """Beyond the positions' width they are counted in steps; order over longer distances stays."""
    words = [f"w{k}" for k in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join(words[150:] + words[:150])), (3, " ".join(words[:295]))]
    monkeypatch.setattr(P, "POSITION_BITS", 5)
    monkeypatch.setattr(P, "POSITIONS", 31)
    monkeypatch.setattr(P, "KMER_BITS", 58)
    got = dict(awkward_docs(spark, rows).select("doc_id", P.sketch(F.col("text"))).collect())
    assert plain_likeness(got[1], got[3]) > 0.8 > plain_likeness(got[1], got[2])
