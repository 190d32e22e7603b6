import pytest
from llm_samples import SCHEMA, awkward_docs
from pyspark.sql import functions as F

from flowbench.llm import mixing


def shares(sizes, weights, cap=3):
    """The rule for targets, as a plain loop."""
    total, fixed = sum(sizes), set()
    while True:
        free = [k for k in range(len(sizes)) if k not in fixed]
        left = total - sum(cap * sizes[k] for k in fixed)
        share = left / sum(weights[k] for k in free) if free else 0
        above = {k for k in free if share * weights[k] > cap * sizes[k]}
        if not above:
            return [cap * sizes[k] if k in fixed else share * weights[k] for k in range(len(sizes))]
        fixed |= above


def test_targets_and_tokens(spark):
    rows = [(k, "w " * (1 + k * k % 97), None, s, None, 1, 2, True, "x") for k in range(900) for s in ["a" if k % 3 else None]]
    rows += [(1000 + k, "w " * (k % 40), None, "b", None, 1, 2, True, "x") for k in range(60)]
    rows += [(2000 + k, "same text here", None, "c", None, 1, 2, True, "x") for k in range(700)]
    rows += [(5000, "word", None, "tiny", None, 1, 2, True, "x"), (5001, None, None, "none", None, 1, 2, True, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(5)).toPandas()
    key = ["doc_id", "copies"]
    assert out.sort_values(key)[key].values.tolist() == again.sort_values(key)[key].values.tolist()
    source = {r[0]: r[3] for r in rows}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    out["name"] = out.doc_id.map(source)
    groups = [out[out.name.isna()] if n is None else out[out.name == n] for n in names]
    wanted = shares([int(g["size"].sum()) for g in groups], [mixing.WEIGHTS[k % 3] for k in range(len(names))])
    for group, target in zip(groups, wanted):
        assert group.target.iloc[0] == pytest.approx(target, rel=1e-9, abs=1e-9)
        assert group.source_size.iloc[0] == group["size"].sum()
        assert abs(group.taken.sum() - target) <= max(2, 0.01 * target)
    assert (out.taken == out.copies * out["size"]).all() and (out.copies <= 3).all() and (out.copies >= 0).all()


def test_rates_are_tilted_by_size_and_only_functions_run(spark):
    rows = [(k, "w " * (1 + k % 50), None, "a" if k % 5 else "b", None, 1, 2, True, "x") for k in range(2000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    frame = mixing.mix(docs)
    by_size = frame.join(docs.select("doc_id", "source"), "doc_id").filter("source = 'a'").groupBy("size").agg(F.avg("copies").alias("rate"))
    rates = [r.rate for r in by_size.orderBy("size").collect()]
    assert rates[0] > rates[-1]  # the source is cut down: long documents more than short ones
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_awkward_rows_and_carried_columns(spark):
    docs = awkward_docs(spark)
    assert mixing.mix(docs).count() == docs.count()
    carried = mixing.mix(docs, carry=docs.columns)
    assert set(docs.columns) < set(carried.columns) and carried.count() == docs.count()
    assert mixing.mix(awkward_docs(spark, [])).count() == 0
    assert mixing.mix(awkward_docs(spark, [(1, None), (2, "")])).count() == 2
