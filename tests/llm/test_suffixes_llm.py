import hashlib

import numpy as np
import pyarrow as pa
import pytest
from llm_samples import awkward_docs, awkward_texts

from flowbench.llm import suffixes as S
from flowbench.llm import words as W

LAST = S.LAST_ID


def expected(rows):
    least = {}
    coded = [(LAST if i is None else i, i, (t or "").encode()) for i, t in rows]
    for key, _, raw in coded:
        for p in range(len(raw) - 49):
            least[raw[p : p + 50]] = min(key, least.get(raw[p : p + 50], LAST))
    out = []
    for key, i, raw in coded:
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if least[raw[p : p + 50]] < key:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out.append((str(i), len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(docs):
    return sorted((str(r[0]), *r[1:5]) for r in S.remove_repeats(docs, keep_bytes=False).collect())


def test_awkward_texts(spark):
    rows = awkward_texts()
    assert found(awkward_docs(spark, rows).repartition(3)) == expected(rows)
    assert found(awkward_docs(spark, [])) == []


def test_tokens_too_frequent_for_one_bucket(spark, monkeypatch):
    rows = [(i, t) for i, t in awkward_texts() if t and len(t) >= 50]
    data, limits = W.text_bytes(pa.array([t for _, t in rows]))
    owner, place, _, _, _ = S.all_runs(data, limits)
    leads = np.sort(S.all_runs(data, limits, np.sort(owner << 32 | place))[4])
    frequent = np.repeat(np.unique(leads)[::2], 2)  # every second token spans two splitters
    monkeypatch.setattr(S, "sampled_splitters", lambda *_: frequent)
    assert found(awkward_docs(spark, rows)) == expected(rows)


def test_kept_bytes(spark):
    rows = [(1, "a" * 60 + "tail"), (2, "head" + "a" * 60)]
    kept = {r.doc_id: r.kept for r in S.remove_repeats(awkward_docs(spark, rows)).collect()}
    assert kept == {1: b"a" * 60 + b"tail", 2: b"head"}


@pytest.mark.parametrize("segment", [64, 1 << 19])
def test_runs_cover_every_string_once(monkeypatch, segment):
    monkeypatch.setattr(S, "SEGMENT", segment)
    texts = [(t or "").encode() for _, t in awkward_texts()]
    data, limits = W.text_bytes(pa.array(texts, pa.binary()).cast(pa.large_binary()))
    owner, place, count, token, _ = S.all_runs(data, limits)
    starts = {(o, p + k) for o, p, c in zip(owner.tolist(), place.tolist(), count.tolist()) for k in range(c)}
    assert starts == {(k, p) for k, t in enumerate(texts) for p in range(len(t) - 49)} and count.sum() == len(starts)
    tokens = {}
    for o, p, c, h in zip(owner.tolist(), place.tolist(), count.tolist(), token.tolist()):
        for k in range(p, p + c):
            assert tokens.setdefault(texts[o][k : k + 50], h) == h  # equal strings, equal tokens


def test_multikey_quicksort_finds_what_a_dictionary_finds():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[2000:3500] = data[:1500]
    starts, ids = np.arange(3950), rng.integers(0, 9, 3950)
    least = {}
    for s, i in zip(starts, ids):
        key = data[s : s + 50].tobytes()
        least[key] = min(i, least.get(key, 99))
    want = [least[data[s : s + 50].tobytes()] < i for s, i in zip(starts, ids)]
    assert S.repeats(data, starts, ids).tolist() == want
