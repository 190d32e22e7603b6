import random
import re

import numpy as np
import pyarrow as pa
from llm_samples import awkward_docs, awkward_texts

from flowbench.llm import components as C
from flowbench.llm import minhash as M
from flowbench.llm import words as W


def shingles(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def expected(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            both = len(a & b)
            if both and None not in (i, j) and 100 * both >= 75 * (len(a) + len(b) - both):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return sorted((str(i), len(s), None if i is None else root(i), i is not None and root(i) == i) for i, s in sets)


def found(docs):
    return sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(docs).collect())


def test_awkward_texts(spark):
    rows = awkward_texts()
    assert found(awkward_docs(spark, rows).repartition(4)) == expected(rows)
    assert found(awkward_docs(spark, [])) == []
    assert found(awkward_docs(spark, [(1, None), (2, "")])) == expected([(1, None), (2, "")])


def test_a_large_group_with_a_halo_of_edited_copies(spark):
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(150)]
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    assert found(awkward_docs(spark, rows)) == expected(rows)


def test_an_id_of_several_texts_links_them(spark):
    rows = [(1, "a a a a a"), (2, "b b b b b"), (5, "a a a a a"), (5, "b b b b b"), (7, "c c"), (8, "d d"), (7, "e"), (9, "e"), (9, None), (11, "f f")]
    got = {(r.doc_id, r.component_id, r.kept) for r in M.near_duplicates(awkward_docs(spark, rows)).collect()}
    assert {x for x in got if x[0] != 9} == {(1, 1, True), (2, 1, False), (5, 1, False), (7, 7, True), (8, 8, True), (11, 11, True)}
    assert (9, 7, False) in got


def test_sets_and_words_do_not_depend_on_place():
    texts = [t for _, t in awkward_texts()]
    column = pa.array(["prefix", *texts, "suffix"]).slice(1, len(texts))
    sets = [s for _, group in M.shingle_sets(column) for s in group]
    alone = [s for t in texts for _, group in M.shingle_sets(pa.array([t], pa.string())) for s in group]
    assert all(np.array_equal(a, b) for a, b in zip(sets, alone))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    data, limits = W.text_bytes(column)
    words = W.find_words(data, limits)
    assert [bytes(data[a:b]).decode() for a, b in zip(words.begin, words.end)] == [
        w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")
    ]


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 199)]
    got = dict(C.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 140)}, 199: 199, 200: 199}
