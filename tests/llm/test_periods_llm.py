"""Periodic runs against a scan of every period, on short alphabets and awkward rows."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
from llm_samples import SCHEMA, awkward_docs, awkward_texts

from flowbench.llm import catalog, periods
from flowbench.llm import words as W


def plain_runs(words):
    found, n = {}, len(words)
    for p in range(1, n // 3 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(24, 3 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((start, p, length) for (start, length), p in found.items())


def collapsed(words, runs):
    gone = {i for start, p, length in runs for i in range(start + p, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return [w.decode() for w in (text or "").encode().translate(bytes(32 if b in W.SEPARATORS else b for b in range(256))).split(b" ") if w]


def repetitive(rng):
    letters, words = rng.choice([1, 2, 3, 50]), []
    for _ in range(rng.randint(0, 5)):
        unit = [f"w{rng.randrange(letters)}" for _ in range(rng.randint(1, rng.choice([2, 5, 30])))]
        words += unit * rng.randint(1, rng.choice([2, 8, 40])) + unit[: rng.randint(0, len(unit))]
    return words


def fibonacci(n):
    a, b = ["a"], ["a", "b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def runs_of(texts):
    data, limits = W.text_bytes(pa.array([" ".join(w) for w in texts]))
    _, _, runs, rest = periods.runs_of_group(data, limits)
    return [[(r["start"], r["period"], r["length"]) for r in found] for found in runs], rest.to_pylist()


def test_runs_of_groups_equal_a_scan_of_every_period():
    rng = random.Random(1)
    for _ in range(150):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 6))]
        found, rest = runs_of(texts)
        for words, runs, left in zip(texts, found, rest):
            assert runs == plain_runs(words)
            assert left == collapsed(words, runs)


def test_hard_words():
    thue = [str(bin(i).count("1") % 2) for i in range(600)]
    for words in (fibonacci(700), thue, ["a"] * 500, ["a", "b"] * 200 + ["a"] * 100, ["a"] * 24, ["a"] * 23, ["a", "b", "c"] * 8):
        assert runs_of([words])[0] == [plain_runs(words)]


def test_extensions_equal_comparison():
    rng = np.random.default_rng(3)
    for letters in (1, 2, 5):
        body = rng.integers(0, letters, 400)
        body[100:300] = np.resize(body[100:107], 200)
        symbols = np.concatenate([[letters], body, [letters + 1]]).astype(np.int32)
        levels = periods.grammar(symbols)
        x = rng.integers(1, 401, 3000)
        y = rng.integers(1, 401, 3000)
        x, y = x[x != y], y[x != y]

        def agree(a, b):
            k = 0
            while symbols[a + k] == symbols[b + k]:
                k += 1
            return k

        assert periods.extensions(levels, x, y).tolist() == [agree(a, b) for a, b in zip(x, y)]


def test_long_texts_take_time_in_proportion():
    n = 400_000
    for words in (["a"] * n, [str(i % 7) for i in range(n)]):
        (runs,), (rest,) = runs_of([words])
        period = len(set(words))
        assert runs == [(0, period, n)] and rest == " ".join(words[:period])


def test_awkward_rows(spark):
    docs = awkward_docs(spark)
    found = periods.periodic_runs(docs, keep=["doc_id", "size"])
    assert found.columns == ["doc_id", "size", "n_words", "runs", "collapsed"]
    want = []
    for i, t in awkward_texts():
        runs = plain_runs(split(t))
        want.append((i, len(split(t)), [(s, n, p) for s, p, n in runs], collapsed(split(t), runs)))
    rows = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))
    assert periods.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_plain_version(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(repetitive(rng)) if i % 3 else " \t".join(rng.choices("abcdefg", k=rng.randint(0, 90)))) for i in range(150)]
    rows += [(None, "a " * 30), (None, None), (7, None), rows[10], rows[10], (30, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(repr(tuple(r)) for r in catalog.op11_periods(spark, str(tmp_path)).collect())
    want = []
    for doc_id, text in rows:
        words = split(text)
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        best = (None,) * 4
        for start, p, length in runs:
            if best[0] is None or length * best[2] > best[1] * p:
                best = (start, length, p, 1000 * length // p)
        listed = "".join(f"{s},{k},{p}\n" for s, p, k in runs)
        digests = (hashlib.sha256(x.encode()).hexdigest() for x in (listed, collapsed(words, runs)))
        want.append(repr((doc_id, len(runs), *best, *digests)))
    assert found == sorted(want)
