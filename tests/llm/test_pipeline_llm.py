import corpus_pipeline as P
import pytest
from llm_samples import awkward_docs, awkward_texts

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_stages_in_turn(spark, docs):
    frame = docs
    counts = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        before = frame
        frame = P.write_table(stage(spark, frame, FOLDER), f"test-{name}")
        assert frame.columns == docs.columns and frame.dtypes == docs.dtypes
        counts.append(frame.count())
        if name == "quality":
            labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
            judged = before.join(labels, "doc_id")
            kept = frame.join(labels, "doc_id")
            assert kept.filter("quality = 1").count() >= 0.95 * judged.filter("quality = 1").count()
            assert kept.filter("quality = 0").count() <= 0.1 * judged.filter("quality = 0").count()
        if name == "near_duplicates":
            assert frame.select("doc_id").distinct().count() == frame.count()
            assert P.minhash.near_duplicates(frame).filter("not kept").count() == 0
        if name == "secrets":
            assert frame.filter("text like '%AKIA%'").count() <= before.filter("text like '%AKIA%'").count()
            assert frame.filter("n_chars <> length(text)").count() == 0
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[2]
    assert P.STAGES[-1][1](spark, frame, FOLDER).count() >= counts[-1]


def test_awkward_rows_pass(spark):
    rows = awkward_docs(spark).select("doc_id", "text", "lang", "source", "n_chars", "kept", "bucket")
    empty = rows.limit(0)
    for name, stage in P.STAGES:
        # the fixture's ids have labels of the small table, its texts are others: quality may keep any of them
        assert name == "quality" or stage(spark, rows, FOLDER).count() > 0, name
        assert stage(spark, empty, FOLDER).count() == 0, name
    unique = P.drop_near_duplicates(spark, rows, FOLDER).collect()
    assert sum(r.doc_id is None for r in unique) == sum(i is None for i, _ in awkward_texts())
    same = [r for r in unique if r.text == "one two"]
    assert [r.doc_id for r in same] == [6]


def test_all_texts_of_a_kept_id_stay_once(spark):
    rows = [(1, "a a a a a"), (2, "b b b b b"), (5, "a a a a a"), (5, "b b b b b"), (7, "c c"), (7, "d d"), (7, "c c")]
    kept = P.drop_near_duplicates(spark, awkward_docs(spark, rows), FOLDER).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, "a a a a a"), (7, "c c"), (7, "d d")]


def test_the_query_is_the_stages(spark):
    assert P.run(spark, FOLDER).count() > 0 and P.ORACLE_SQL is None
