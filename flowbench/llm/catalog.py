"""The queries over the corpus tables, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbench.llm import fingerprints, infill, minhash, mixing, neighbours, packing, periods, quality, secret_scan, sharding, suffixes, toxicity, warc
from flowbench.llm.common import WORD, reserved, table
from flowbench.sources.tables import new_path, write_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(table(spark, folder, "documents"), vocabulary, keep_ids=False)


@query
def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive = new_path(spark, "warc")
    warc.write_warc(table(spark, folder, "pages"), archive)
    return warc.read_warc(spark, archive).drop("url")


#: Five bits of a digest at a time, as base32 writes them.
BASE32 = """list_aggregate(list_transform(range(0, 32), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(0, 5), lambda b:
        (CAST(instr('0123456789abcdef', substr({hex}, 1 + (5 * j + b) // 4, 1)) - 1 AS INT)
            >> CAST(3 - (5 * j + b) % 4 AS INT) & 1) * (1 << CAST(4 - b AS INT)))) AS INT), 1)), 'string_agg', '')"""

ORACLES["op9_warc"] = f"""
    WITH page AS (
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
    ), first AS (SELECT hex, min(page_id) AS first_id FROM page GROUP BY hex)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {BASE32.format(hex="hex")} AS payload_digest,
        CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
    FROM page JOIN first USING (hex)
"""


def held_out(docs: DataFrame, modulus: int, remainder: int) -> F.Column:
    """Rows that fitting never sees, by the CRC-32 of the id as text; ids that are null are not held out."""
    return F.coalesce(F.crc32(docs["doc_id"].cast("string")) % modulus == remainder, F.lit(False))


@query
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


@query
def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, folder, "documents"))
    base = F.filter("secrets", lambda s: s["place"] < len(secret_scan.BASE_KINDS))

    def count(kind: str) -> F.Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(count, secret_scan.BASE_KINDS)
    return found.select(
        "doc_id", *counts,
        F.sha2(F.encode(secret_scan.listed(base), "UTF-8"), 256).alias("base_sha256"),
        secret_scan.listed(F.col("secrets")).alias("spans"),
    )


@query
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.fit(
        toxicity.training_rows(labels.filter(~held_out(labels, 5, 0)), docs, "doc_id", "text", "toxic")
    )
    return toxicity.score(docs, model, keep=(held_out(docs, 5, 0).alias("held_out"),))


def quality_statistics(docs: DataFrame) -> DataFrame:
    """Statistics of all texts, stored: fitting and scoring read them, the texts are read once."""
    return write_table(quality.with_statistics(docs, [docs["doc_id"], held_out(docs, 3, 1).alias("held_out")]), "quality")


def quality_model(rows: DataFrame, labels: DataFrame) -> quality.RuleModel:
    """Fitted on labelled rows that are not held out."""
    marked = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return quality.fit(rows.filter("not held_out").join(marked, "doc_id"), "quality")


@query
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality_statistics(table(spark, folder, "documents"))
    model = quality_model(rows, table(spark, folder, "labels"))
    return rows.select("doc_id", "held_out", model.score().alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


@query
def op5_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


ORACLES["op5_minhash"] = r"""
    WITH RECURSIVE word AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), shingle AS (
        SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
            lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM word WHERE len(w) > 0
    ), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
    ), overlap AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingle a JOIN shingle b USING (s)
        WHERE a.doc_id <> b.doc_id GROUP BY ALL
    ), link AS (
        SELECT a, b FROM overlap JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
        WHERE 100 * c >= 75 * (x.n + y.n - c)
    ), reach AS (
        SELECT doc_id AS a, doc_id AS b FROM documents
        UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
    ), least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM documents JOIN least USING (doc_id) LEFT JOIN size USING (doc_id)
"""


@query
def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edit_report(table(spark, folder, "documents"))


@query
def op2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, 20)


@query
def op4_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, folder, "documents"), keep_bytes=False)


def hashed(text: F.Column) -> F.Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


@query
def op13_infill(spark: SparkSession, folder: str) -> DataFrame:
    done = infill.infill(table(spark, folder, "documents"))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", hashed(F.col("output")).alias("output_sha256"),
        hashed(infill.restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLES["op13_infill"] = r"""
    WITH drawn AS (
        SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex,
            regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS unit
        FROM documents
    ), number AS (
        SELECT doc_id, text, unit, len(unit) AS n, list_transform([0, 1, 2, 3], lambda k:
            CAST('0x' || substr(hex, CAST(1 + 8 * k AS INT), 8) AS BIGINT)) AS h FROM drawn
    ), cut AS (
        SELECT doc_id, text, unit, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50
                THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM number
    ), part AS (
        SELECT doc_id, text, n, form, array_to_string(unit[1:low], '') AS p, array_to_string(unit[low + 1:high], '') AS m,
            array_to_string(unit[high + 1:], '') AS s FROM cut
    )
    SELECT doc_id, CAST(n AS BIGINT) AS n, form,
        CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
            ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
        sha256(text) AS restored_sha256
    FROM part
"""


def with_repetitions(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in one document of ten, told by the CRC-32 of its id, the words from some place on repeat.

    Rows with a null id keep their text. Only the chosen rows are taken apart into words.
    """
    h = F.crc32(docs["doc_id"].cast("string"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    g, words, n, a, p = (F.col(reserved(name)) for name in ("g", "words", "n", "a", "p"))
    split = docs.select(
        "doc_id", "text", F.floor(h / 10).alias(reserved("g")),
        F.when(chosen, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias(reserved("words")),
    )
    split = split.withColumn(reserved("n"), F.size(words)).withColumn(reserved("a"), F.when(n > 0, g % n))
    split = split.withColumn(reserved("p"), (1 + F.floor((n - a) / (3 + g % 8))).cast("int"))
    a, p = a.cast("int"), p.cast("int")
    head, unit = F.slice(words, F.lit(1), a), F.slice(words, a + 1, p)
    times = F.ceil((n - a) / p).cast("int")
    repeated = F.concat(head, F.slice(F.flatten(F.array_repeat(unit, times)), F.lit(1), n - a))
    return split.select("doc_id", F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


@query
def op11_periods(spark: SparkSession, folder: str) -> DataFrame:
    found = periods.periodic_runs(with_repetitions(table(spark, folder, "documents")))
    best = F.reduce(
        F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)),
        lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b),
    )
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best_run = found.withColumn("best", best)
    return best_run.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        hashed(listed).alias("runs_sha256"), hashed(F.col("collapsed")).alias("collapsed_sha256"),
    )


#: The shards that the documents come from, dealt by source, and those they go to.
OLD_SHARDS, NEW_SHARDS = 6, 8


@query
def op12_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    by_source = F.crc32(F.coalesce("source", F.lit(""))) % OLD_SHARDS
    old = sharding.write_shards(docs, new_path(spark, "shards"), by_source)
    return sharding.reshard(old, NEW_SHARDS).rows().select(
        "doc_id", F.col(sharding.SIZE).alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("bytes").alias("law"), F.col(sharding.SHARD).alias("shard"), F.col(reserved("slot")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
