"""Deterministic sharded WARC writer, and a reader for what it writes.

Records are sorted by id and cut into shards of about equal bytes; a shard starts a new file when the
compressed size passes ``roll_bytes``. Record ids, dates, HTTP headers and digests are made anew from
the row, so the same rows give the same bytes whatever the number of tasks. A file is written under a
temporary name that holds the attempt and renamed when whole; a repeated attempt writes the same bytes
again. The manifest, a Spark table of files with their sizes and digests, is written last: only
what it lists belongs to the archive.

Equal payloads of at least ``min_payload`` bytes are stored once, by the smallest id; the others are
revisit records. Null payloads are empty. Repeated rows: the first is the response, the others revisit
it. Rows without id come first, refer to the smallest id of their payload, or are responses if there
is none. An empty table gives an archive without files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbench.sources.tables import write_table

ROLL_BYTES = 32 << 20
SHARD_BYTES = 64 << 20
#: Id ranges whose bytes are counted to find the cuts between shards; a driver-side list of this length.
RANGES = 16384
#: Records carry this date unless the caller gives another; the tables have none.
DATE = "2024-01-01T00:00:00Z"

MANIFEST = "shard long, sequence long, file string, records long, size long, sha256 string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, copy: int) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest}:{copy}>"


def page_of(urn: str) -> int | None:
    number = urn.split(":")[2]
    return None if number == "none" else int(number)


def http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def header_value(text: str | None) -> str:
    """A header is one line: control characters and spaces of an address are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text or "urn:none")


def record(kind: str, name: str, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    head = http_head(len(payload))
    block = head + payload if kind == "response" else head
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {header_value(url)}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to:
        lines.append(f"WARC-Refers-To: {refers_to}")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warcinfo(file: str, date: str) -> bytes:
    block = b"software: flowbench\r\nformat: WARC File Format 1.1\r\n"
    lines = [
        "WARC/1.1",
        "WARC-Type: warcinfo",
        f"WARC-Record-ID: <urn:file:{file}>",
        f"WARC-Date: {date}",
        f"WARC-Filename: {file}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/warc-fields",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Roller:
    """Writes the files of one shard, each under a temporary name until it is whole."""

    def __init__(self, folder: str, shard: int, roll_bytes: int, date: str):
        from pyarrow import fs

        self.files, self.root = fs.FileSystem.from_uri(folder)
        self.shard, self.roll_bytes, self.date = shard, roll_bytes, date
        self.sequence, self.stream = -1, None
        self.attempt = TaskContext.get().taskAttemptId()

    def add(self, data: bytes) -> dict | None:
        if self.stream is None:
            self.sequence += 1
            self.name = f"shard-{self.shard:06d}-{self.sequence:05d}.warc.gz"
            self.temporary = f"{self.root}/{self.name}.{self.attempt}.tmp"
            self.stream = self.files.open_output_stream(self.temporary)
            self.size, self.records, self.digest = 0, 0, hashlib.sha256()
            self._member(warcinfo(self.name, self.date))
        self._member(data)
        self.records += 1
        return self.close() if self.size >= self.roll_bytes else None

    def _member(self, data: bytes) -> None:
        packed = gzip.compress(data, 6, mtime=0)
        self.stream.write(packed)
        self.size += len(packed)
        self.digest.update(packed)

    def close(self) -> dict | None:
        if self.stream is None:
            return None
        self.stream.close()
        self.stream = None
        self.files.move(self.temporary, f"{self.root}/{self.name}")
        return {
            "shard": self.shard, "sequence": self.sequence, "file": self.name,
            "records": self.records, "size": self.size, "sha256": self.digest.hexdigest(),
        }


def shard_column(index: DataFrame, shard_bytes: int) -> F.Column:
    """The shard of an id: ids are cut into ranges of one width, and ranges joined until a shard is full."""
    low, high, total = index.agg(F.min("id"), F.max("id"), F.sum("bytes")).first()
    if low is None:
        return F.lit(0)
    ranges = max(1, min(RANGES, 8 * (1 + (total or 0) // shard_bytes)))
    width = (high - low) // ranges + 1
    at = F.floor((F.col("id").cast("decimal(20)") - F.lit(low).cast("decimal(20)")) / F.lit(width).cast("decimal(20)"))
    at = F.least(F.greatest(F.coalesce(at, F.lit(0)), F.lit(0)), F.lit(ranges - 1)).cast("int")
    weights = dict(index.groupBy(at.alias("at")).agg(F.sum("bytes")).collect())
    shards, shard, filled = [], 0, 0
    for k in range(ranges):
        if filled and filled + weights.get(k, 0) > shard_bytes:
            shard, filled = shard + 1, 0
        filled += weights.get(k, 0)
        shards.append(shard)
    return F.element_at(F.array(*map(F.lit, shards)), at + 1)


def write_warc(
    pages: DataFrame,
    folder: str,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
    min_payload: int = 0,
    roll_bytes: int = ROLL_BYTES,
    shard_bytes: int = SHARD_BYTES,
    date: str = DATE,
) -> DataFrame:
    """Write the archive below ``folder``, a place all executors reach; returns its manifest."""
    spark = pages.sparkSession
    rows = pages.select(
        pages[id_column].cast("long").alias("id"),
        pages[url_column].cast("string").alias("url"),
        F.coalesce(pages[payload_column].cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    index = write_table(rows.select("id", "digest", F.octet_length("payload").alias("bytes")), "warc-index")
    shard = shard_column(index, shard_bytes)
    repeated = (
        index.filter(F.col("bytes") >= min_payload)
        .groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and first is not null")
    )
    markers = (
        index.join(repeated.select("digest", "first"), "digest")
        .filter(~F.col("id").eqNullSafe(F.col("first")) | F.col("id").isNull())
        .select("id", "digest", "first").distinct()
        .select(shard.alias("shard"), "id", "digest", F.lit(0).alias("kind"), "first",
                F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    )
    bodies = rows.select(
        shard.alias("shard"), "id", "digest", F.lit(1).alias("kind"),
        F.lit(None).cast("long").alias("first"), "url", "payload",
    )
    shards = (index.agg(F.max(shard)).first()[0] or 0) + 1
    ordered = (
        markers.unionByName(bodies)
        .repartitionByRange(shards, "shard")
        .sortWithinPartitions("shard", "id", "digest", "kind", "url")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        roller, done = None, []
        previous = marked = None
        copies = 0
        for batch in batches:
            for shard_number, page, digest, kind, first, url, payload in zip(*batch.columns):
                page, digest = page.as_py(), digest.as_py()
                if kind.as_py() == 0:
                    marked = (page, digest, first.as_py())
                    continue
                if roller is None or roller.shard != shard_number.as_py():
                    done.append(roller and roller.close())
                    roller = Roller(folder, shard_number.as_py(), roll_bytes, date)
                payload = payload.as_py()
                copies = copies + 1 if previous == (page, digest) else 0
                previous = (page, digest)
                refers = None
                if marked and marked[:2] == previous:
                    refers = marked[2]
                elif copies and page is not None and len(payload) >= min_payload:
                    refers = page
                name = record_id(page, digest, copies)
                target = None if refers is None else record_id(refers, digest, 0)
                kind_name = "response" if refers is None else "revisit"
                done.append(roller.add(record(kind_name, name, url.as_py(), payload, target, date)))
            done = [d for d in done if d]
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=manifest_schema)
                done = []
        last = roller and roller.close()
        if last:
            yield pa.RecordBatch.from_pylist([last], schema=manifest_schema)

    manifest_schema = pa.schema([
        ("shard", pa.int64()), ("sequence", pa.int64()), ("file", pa.string()),
        ("records", pa.int64()), ("size", pa.int64()), ("sha256", pa.string()),
    ])
    manifest = ordered.mapInArrow(write, MANIFEST)
    manifest.write.mode("overwrite").json(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{folder}/manifest")


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an opened, decompressed archive file."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"a record begins with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[name] = value
        block = stream.read(int(headers["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"{headers['WARC-Record-ID']} does not end where its length says")
        if headers["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
            raise ValueError(f"{headers['WARC-Record-ID']} has another digest than its block")
        yield headers, block


def page_row(headers: dict[str, str], block: bytes) -> dict:
    """What a record says of its page; the full payload's size stands in the HTTP header."""
    head, _, payload = block.partition(b"\r\n\r\n")
    length = int(head.rpartition(b"Content-Length: ")[2])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError(f"{headers['WARC-Record-ID']} has another payload than its digest")
    refers = headers.get("WARC-Refers-To")
    return {
        "page_id": page_of(headers["WARC-Record-ID"]), "payload_bytes": length, "payload_digest": digest,
        "record_type": headers["WARC-Type"], "refers_to": page_of(refers) if refers else None,
        "url": headers["WARC-Target-URI"],
    }


def read_warc(spark: SparkSession, folder: str, tasks: int | None = None) -> DataFrame:
    """The pages of an archive; a record that does not fit its digests or lengths is an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with files.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for headers, block in parse_records(stream):
                        if headers["WARC-Type"] != "warcinfo":
                            rows.append(page_row(headers, block))
                        if len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=record_schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=record_schema)

    record_schema = pa.schema([
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()),
    ])
    manifest = read_manifest(spark, folder).select("file")
    return manifest.repartition(tasks or spark.sparkContext.defaultParallelism, "file").mapInArrow(read, RECORD)
