"""Infilling against a plain Python version, on awkward rows."""

import hashlib
import re

from llm_samples import SCHEMA, awkward_docs, awkward_texts
from pyspark.sql import functions as F

from flowbench.llm import infill

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_infill(doc_id, text):
    text = text or ""
    hex_ = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hex_[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:low], units[low:high], units[high:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows():
    more = [
        (1000 + i, t) for i in range(40)
        for t in ("a $1 \\b <P", "> <M> x", "  \n", " \U0001f600 　 é", "x<", "<S", " ")
    ]
    return [*awkward_texts(), *more]


def test_equals_plain_version_and_restores(spark):
    docs = awkward_docs(spark, rows())
    done = infill.infill(docs).withColumn("restored", infill.restore(F.col("output"), F.col("form")))
    found = sorted(map(repr, map(tuple, done.collect())))
    assert found == sorted(repr((i, *plain_infill(i, t), t or "")) for i, t in rows())
    assert {r["form"] for r in done.collect()} == {"plain", "psm", "spm"}


def test_long_texts_need_no_recursion(spark):
    long = [(i, ("w " * 400_000 + "\n" * 50_000) if i % 2 else "x" * 1_000_000) for i in range(24)]
    docs = spark.createDataFrame(long, "doc_id long, text string")
    digest = F.sha2(F.encode("output", "UTF-8"), 256)
    found = {r[0]: tuple(r) for r in infill.infill(docs).select("doc_id", "n", "form", digest).collect()}
    for i, t in long:
        n, form, _, _, output = plain_infill(i, t)
        assert found[i] == (i, n, form, hashlib.sha256(output.encode()).hexdigest())


def test_empty_table_and_kept_columns(spark):
    empty = infill.infill(spark.createDataFrame([], SCHEMA), keep=["lang", "size"])
    assert empty.columns == ["doc_id", "lang", "size", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert empty.count() == 0
    kept = infill.infill(awkward_docs(spark), keep=["text"])
    assert kept.filter("form = 'plain'").filter("output <> coalesce(text, '')").count() == 0


def test_plan_has_no_python_and_no_shuffle(spark):
    plan = infill.infill(awkward_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
