"""From raw documents to packed training sequences: quality, near-duplicates, secrets, mixing, packing.

Each stage works on what its predecessor kept. All but the last return the columns of ``documents``, so
any of them can be left out or run alone. Null, empty or very long texts, repeated rows and further
columns pass through every stage:

* quality: a row goes if its score is below ``KEEP_SCORE``; null and empty texts are scored like others.
* near duplicates: of each component the row with the smallest id stays, once if it is repeated; all
  texts of that id stay, once each. Rows without id are not compared and stay.
* secrets: texts keep all but the secrets, whose places are marked; ``n_chars`` follows the text.
* mixing: a row occurs as often as the mix takes its document, from not at all to three times.
* packing: the pieces of all rows; the last stage returns these instead of documents.

An empty table of documents gives an empty table of pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbench.llm import minhash, mixing, packing, quality, secret_scan
from flowbench.llm.catalog import held_out
from flowbench.llm.common import reserved, table
from flowbench.sources.tables import write_table

#: Lower than the one half that tells the classes apart: a filter should rather keep than lose clean text.
KEEP_SCORE = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rules learned from the labels of the tables; labelled rows that are held out are never learned from."""
    labels = table(spark, sf_dir, "labels")
    known = quality.labelled_texts(docs, labels.filter(~held_out(labels, 3, 1)))
    model = quality.fit(quality.with_statistics(known, [known["doc_id"], known["quality"]]))
    scored = quality.with_statistics(docs, [docs[c] for c in docs.columns])
    return scored.filter(model.score() >= KEEP_SCORE).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = minhash.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias(reserved("id"))).distinct()
    known = docs.filter(docs["doc_id"].isNotNull())
    one_each = known.join(kept, known["doc_id"] == kept[reserved("id")], "left_semi").dropDuplicates(["doc_id", "text"])
    return one_each.unionByName(docs.filter(docs["doc_id"].isNull()))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs, carry=docs.columns)
    copies = F.explode(F.array_repeat(F.lit(1), F.col(reserved("copies")).cast("int"))).alias(reserved("copy"))
    return mixed.select(*docs.columns, copies).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Signatures, rules and tokens have no SQL. The operators' own tests compare them with plain versions; the test
#: of the stages checks properties of what each keeps, not every row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
