import numpy as np
from pyspark.sql import functions as F

from flowbench.llm import neighbours as N


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")


def test_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(1500, 24)).astype(np.float32)
    vectors[:300] = vectors[0]  # one very common vector
    vectors[300:900] *= rng.uniform(0.2, 3, 600)[:, None].astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    odd = [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] + [1.0] * 23), (2060, [float("inf")] + [1.0] * 23),
           (2080, [None] + [1.0] * 23), (2100, [1.0] * 23), (None, [1.0] * 24)]
    out = N.nearest(frame(spark, rows + odd), F.col("vec_id") % 20 == 0, 20, block_rows=400, group_queries=30).toPandas()
    assert set(out.query_id) == set(range(0, 1500, 20))
    assert out.vec_id.max() < 1500 and (out.query_id != out.vec_id).all()
    exact = vectors.astype(np.float64)
    hits = 0
    for query, part in out.groupby("query_id"):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21))
        scores = exact @ exact[query]
        assert np.allclose(part.score, scores[part.vec_id])
        order = list(zip(-part.score, part.vec_id))
        assert order == sorted(order)
        scores[query] = -np.inf
        hits += len(set(part.vec_id) & set(np.lexsort((np.arange(1500), -scores))[:20].tolist())) if query >= 300 else 20
        if query < 300:
            assert (part.score >= np.sort(scores)[-20] - 1e-9).all()
    assert hits / len(out) > 0.9


def test_few_rows(spark):
    few = N.nearest(frame(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 2.0]), (20, [0.0, 2.0])]), F.col("vec_id") % 20 == 0)
    assert [tuple(r) for r in few.orderBy("query_id", "rank").collect()] == [
        (0, 1, 1, 0.5), (0, 2, 20, 0.0), (0, 3, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 0, 0.0)]
    assert N.nearest(frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def recalls(spark, vectors, asked, k=20):
    """Recall of each asked row; equal scores count for each other."""
    rows = frame(spark, [(i, v.tolist()) for i, v in enumerate(vectors)])
    out = N.nearest(rows, F.col("vec_id").isin([int(a) for a in asked]), k).toPandas()
    exact = np.asarray(vectors, np.float32).astype(np.float64)
    shares = []
    for query in asked:
        scores = exact @ exact[query]
        scores[query] = -np.inf
        shares.append((out[out.query_id == query].score >= np.sort(scores)[-k] - 1e-9).sum() / k)
    return np.array(shares)


def directions(rows, seed=1):
    unit = np.random.default_rng(seed).normal(size=(rows, 64))
    return unit / np.linalg.norm(unit, axis=1)[:, None]


def test_recall_does_not_depend_on_the_norms(spark):
    unit = directions(5900)
    outlier, spread = unit.copy(), unit * np.random.default_rng(2).lognormal(0, 1, 5900)[:, None]
    outlier[7] *= 3
    for vectors in (outlier, spread):
        shares = recalls(spark, vectors, range(0, 5900, 30))
        assert shares.mean() > 0.91 and np.sort(shares)[: len(shares) // 10].mean() > 0.7


def test_recall_next_to_many_copies(spark):
    vectors = directions(5900).astype(np.float32)
    vectors[:1960] = vectors[0]
    near = 1960 + np.argsort(-(vectors[1960:] @ vectors[0]))[100:200]
    assert recalls(spark, vectors, near).mean() > 0.88


def test_bands_of_norms(spark):
    assert N.band_blocks({}, 10, 3) == ([], 0)
    assert N.band_blocks({-4: 1, 0: 25, 1: 2, 2: 1, 5: 1}, 10, 3) == ([(-4, 0, 1), (0, 1, 3), (1, 4, 1), (2, 4, 1), (5, 5, 1)], 6)
    huge = [(0, [1e200, 0.0]), (1, [1e-200, 0.0]), (2, [3e-200, 0.0]), (3, [1.0, 1.0])]
    rows = spark.createDataFrame(huge, "vec_id long, embedding array<double>")
    out = N.nearest(rows, F.col("vec_id") == 0, 3).orderBy("rank").collect()
    assert [r.vec_id for r in out] == [3, 2, 1]


def test_bit_planes_count_as_plain_sums():
    rng = np.random.default_rng(4)
    for arrays in (1, 2, 3, 7, 40):
        bits = rng.random((arrays, 3, 128)) < 0.6
        for least in (1, 2, arrays // 2 + 1, arrays, arrays + 1, 100):
            planes = N.Planes((3, 2))
            for one in bits:
                planes.add(np.packbits(one, axis=1, bitorder="little").view(np.uint64))
            met = np.unpackbits(planes.at_least(least).view(np.uint8), axis=1, bitorder="little")
            assert (met.astype(bool) == (bits.sum(axis=0) >= least)).all()


def test_collisions_cover_the_plain_windows():
    vectors = directions(700)
    index = N.Index(np.arange(700), vectors, cells=16)
    scale = np.abs(index.vectors).max()
    centres = np.ascontiguousarray((vectors[:5] / scale @ index.lines[:-1]).T)
    radius = np.full(5, 0.9 * index.norm)
    met = np.unpackbits(index.colliding(centres, radius, 100).view(np.uint8), axis=1, bitorder="little")[:, :700]
    values = index.vectors / scale @ index.lines[:-1]  # equal norms: the further component is nothing
    for at in range(5):
        inside = np.abs(values - centres[:, at]) <= radius[at] * (1 - 1e-6)
        assert met[at][inside.sum(axis=1) >= 100].all()
        assert met[at].sum() < 700


def test_few_vectors_are_verified(monkeypatch):
    seen, verify = [], N.Index.verify

    def counted(self, found, *rest):
        seen.append(len(found) / len(self.vectors))
        return verify(self, found, *rest)

    monkeypatch.setattr(N.Index, "verify", counted)
    unit = directions(12000)
    asked = np.arange(0, 12000, 60)
    queries, _, scores = N.Index(np.arange(12000), unit).search(asked, unit[asked], 20)
    shares = []
    for query in asked:
        products = unit @ unit[query]
        products[query] = -np.inf
        shares.append((scores[queries == query] >= np.sort(products)[-20] - 1e-9).mean())
    assert np.mean(shares) > 0.95 and np.mean(seen) < 0.05


def test_a_query_id_of_several_vectors_asks_with_the_smallest(spark):
    rows = [(0, [1.0, 0.0]), (0, [-1.0, 0.0]), (1, [2.0, 0.0]), (2, [-3.0, 0.0])]
    for some in (rows, rows[::-1]):
        out = N.nearest(frame(spark, some), F.col("vec_id") == 0, 1).collect()
        assert [(r.query_id, r.vec_id, r.score) for r in out] == [(0, 2, 3.0)]
