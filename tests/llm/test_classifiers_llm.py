import numpy as np
import pyarrow as pa
import pytest
from llm_samples import awkward_docs, awkward_texts

from flowbench.llm import catalog, quality, toxicity
from flowbench.llm import words as W

FOLDER = "/root/testdata/sf0.01"


def judged(spark, name, label):
    out = catalog.QUERIES[name](spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", label)
    frame = out.join(labels, "doc_id").toPandas()
    assert out.count() == 1000 and frame.score.between(0, 1).all()
    assert (frame.predicted == (frame.score >= 0.5)).all()
    return frame[frame.held_out], label


@pytest.mark.parametrize("name, label, least", [("op3_quality", "quality", 0.97), ("op10_toxicity", "toxic", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    frame, label = judged(spark, name, label)
    right = (frame.predicted == frame[label])
    assert len(frame) > 50 and right.mean() >= least
    # a few labels of the small tables are wrong on purpose
    assert right[frame[label] == 0].mean() >= 0.9 and right[frame[label] == 1].mean() >= 0.8


def test_misspellings_share_subwords():
    clean = ["the quick report came in", "we met at noon by the river", "numbers went up in spring", "a calm walk home"] * 20
    foul = [c + " you worthless idiot" for c in clean]
    model = toxicity.fit([(0, t) for t in clean] + [(1, t) for t in foul], buckets=1 << 14)
    seen = model.logits(["such a worthles idiott here", "we met by the river", "", None], toxicity.Lexicon(model.weights))
    assert seen[0] > 0 > seen[1] and seen[2] < 0 and seen[2] == seen[3]
    long_text = " ".join(clean * 5) + " worthless idiot " + " ".join(clean * 5)
    assert model.logits([long_text], toxicity.Lexicon(model.weights))[0] > 0  # as toxic as its worst window
    with pytest.raises(ValueError):
        toxicity.fit([(0, "a b c")])


def test_toxicity_scores_awkward_rows(spark):
    model = toxicity.fit([(0, "good day"), (1, "bad scum")] * 5, buckets=1 << 10)
    docs = awkward_docs(spark)
    got = toxicity.score(docs, model, keep=(docs["kept"],)).toPandas()
    assert len(got) == len(awkward_texts()) and got.score.between(0, 1).all() and (got.kept == "x").all()
    assert toxicity.score(awkward_docs(spark, []), model).count() == 0


def test_statistics_do_not_depend_on_neighbours(spark):
    docs = awkward_docs(spark)
    rows = quality.with_statistics(docs, [docs["doc_id"], docs["text"]]).toPandas()
    assert len(rows) == len(awkward_texts())
    for row in rows.itertuples(index=False):
        alone = quality.statistics(*W.text_bytes(pa.array([row[1]], pa.string())))
        assert np.allclose(alone[0], np.array(row[2:], float)), row[1]
    empty = awkward_docs(spark, [])
    assert quality.with_statistics(empty, [empty["doc_id"]]).count() == 0


def test_rules_as_columns_equal_rules_in_numpy(spark):
    rng = np.random.default_rng(0)
    values = rng.random((400, len(quality.STATISTICS)))
    labels = ((values[:, 0] > 0.5) & (values[:, 3] < 0.7)).astype(float)
    weights = np.ones(400)
    rules = quality.propose_rules(values, labels, weights, trees=6)
    intercept, beta = quality.lasso_logistic(np.stack([r.holds(values) for r in rules], axis=1), labels, weights, 1e-3)
    model = quality.RuleModel(intercept, tuple((r, float(b)) for r, b in zip(rules, beta) if b))
    assert 0 < len(model.rules) < len(rules)
    frame = spark.createDataFrame(values.tolist(), [f"__llm_{s}" for s in quality.STATISTICS]).select(model.score())
    logit = intercept + sum(b * r.holds(values) for r, b in model.rules)
    assert np.allclose(sorted(r[0] for r in frame.collect()), sorted(1 / (1 + np.exp(-logit))))
    assert ((logit > 0) == labels).mean() > 0.95


@pytest.mark.parametrize("name", ["op3_quality", "op10_toxicity"])
def test_queries_on_awkward_tables(spark, tmp_path, name):
    clean, poor = "we met at noon by the river and talked about the weather. ", "BUY!!! $$$ | | | idiot scum "
    rows = [(i, (poor if i % 3 == 0 else clean) * (1 + i % 5)) for i in range(90)]
    rows += [(None, clean), (None, None), (200, ""), (201, None), (3, poor), (3, clean), (3, clean), (202, clean * 40_000)]
    awkward_docs(spark, rows).write.parquet(f"{tmp_path}/some/documents.parquet")
    awkward_docs(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    labels = [(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(90)] + [(None, 1, 0), (5, None, None), (7, 1, 0)]
    for folder in ("some", "none"):
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{folder}/labels.parquet")
    runs = [catalog.QUERIES[name](spark, f"{tmp_path}/some").select("doc_id", "held_out", "score", "predicted").collect() for _ in range(2)]
    assert sorted(map(repr, runs[0])) == sorted(map(repr, runs[1]))
    assert sorted(str(r.doc_id) for r in runs[0]) == sorted(str(i) for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in runs[0])
    judged = [r for r in runs[0] if r.doc_id is not None and r.doc_id < 90 and r.doc_id != 3]
    want = (lambda i: i % 3 != 0) if name == "op3_quality" else (lambda i: i % 3 == 0)
    assert all(r.predicted == want(r.doc_id) for r in judged)
    empty = catalog.QUERIES[name](spark, f"{tmp_path}/none")
    assert empty.count() == 0 and {"doc_id", "held_out", "score", "predicted"} <= set(empty.columns)


def test_sample_is_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(i, "long text " * 1000 if i % 2 else "short") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 4 // 2) for i in range(40)], "doc_id long, toxic int")
    rows = toxicity.training_rows(labels, docs, "doc_id", "text", "toxic", max_bytes=30_100)
    assert sorted((y, len(t)) for y, t in rows) == sorted((y, n) for y in (0, 1) for n in [5] * 10 + [10_000] * 3)
    assert len(toxicity.training_rows(labels, docs, "doc_id", "text", "toxic", max_rows=3)) == 6


def plain_statistics(text):
    """The statistics by plain loops over words and lines."""
    text = text or ""
    spaces = " \t\n\v\f\r"
    for s in spaces:
        text = text.replace(s, "\n" if s == "\n" else " ")
    lines = text.split("\n")
    words_of = [[w for w in line.split(" ") if w] for line in lines]
    words = [w for line in words_of for w in line]
    lower = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    raw = "".join(words).encode()
    share = lambda n, of: n / of if of else 0.0
    full = [tuple("".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in line) for line in words_of if line]
    bags = [tuple(sorted(line)) for line in full]
    stops = [w for w in words if w.endswith(".")]
    ends = set(quality.MARKS + quality.SYMBOLS)
    doubled = [w for w in (w.encode() for w in words) if len(w) > 1 and w[-1] == w[-2] and w[-1] in ends]
    many = len(words)
    return [
        share(sum(65 <= b <= 90 for b in raw), len(raw)), share(sum(48 <= b <= 57 for b in raw), len(raw)),
        share(sum(b in quality.MARKS for b in raw), len(raw)), share(sum(b in quality.SYMBOLS for b in raw), len(raw)),
        share(sum(b > 127 for b in raw), len(raw)), share(raw.count(b"!"), many), share(raw.count(b"|"), many),
        share(sum(a == b for a, b in zip(lower, lower[1:])), many), share(len(set(lower)), many),
        share(sum(len(w.encode()) == 1 for w in words), many),
        share(sum(2 * sum("A" <= c <= "Z" for c in w) > len(w.encode()) for w in words), many),
        share(len(doubled), many), share(len(stops), many), share(len(bags) - len(set(bags)), len(bags)),
        np.log1p(share(len(raw), many)), np.log1p(many), np.log1p(share(many, len(lines))),
    ]


def test_statistics_equal_plain_loops():
    texts = [t for _, t in awkward_texts()] + ["A a!! x..\nx.. A\n\nA a!! x..", "\n\n", "é É $$ || 12", "a\tb\x0bc\rd"]
    for text in texts:
        got = quality.statistics(*W.text_bytes(pa.array([text], pa.string())))
        assert np.allclose(got[0], plain_statistics(text)), text
