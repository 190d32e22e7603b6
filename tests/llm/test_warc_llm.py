import base64
import gzip
import hashlib
from pathlib import Path

from llm_samples import awkward_texts

from flowbench.llm import warc

ROWS = [(1, "http://a/ b", "x"), (2, None, "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u\r\nInjected: 1", "é" * 500),
        (None, "n", "x"), (None, "n", "only null"), (9, "u", "only nine"), (1, "again", "other payload of one")]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 7) for i, u, h in rows], "page_id long, url string, html string, shard int")


def expected(rows, least=0):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    seen, out = set(), []
    for i, _, h in rows:
        raw = (h or "").encode()
        target = first.get(h or "") if len(raw) >= least else None
        response = target is None or (target == i and (i, h) not in seen)
        seen.add((i, h))
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((i, len(raw), digest, "response" if response else "revisit", None if response else target))
    return sorted(out, key=str)


def read(spark, folder):
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r[c] for c in columns) for r in warc.read_warc(spark, folder).collect()), key=str)


def test_round_trip(spark, tmp_path):
    warc.write_warc(pages(spark, ROWS), str(tmp_path / "a"))
    assert read(spark, str(tmp_path / "a")) == expected(ROWS)
    warc.write_warc(pages(spark, ROWS), str(tmp_path / "b"), min_payload=5)
    assert read(spark, str(tmp_path / "b")) == expected(ROWS, 5)


def test_same_bytes_whatever_the_tasks(spark, tmp_path):
    rows = [(k, f"http://x/{k}", (t or "") * (1 + k % 3)) for k, (_, t) in enumerate(awkward_texts())]
    for name, parts in (("one", 1), ("many", 7)):
        warc.write_warc(pages(spark, rows).repartition(parts), str(tmp_path / name), roll_bytes=4000, shard_bytes=20_000)
    one, many = ({p.name: p.read_bytes() for p in (tmp_path / n).glob("*.warc.gz")} for n in ("one", "many"))
    assert one == many and len(one) > 5
    assert not list(tmp_path.rglob("*.tmp"))
    manifest = {r.file: r for r in warc.read_manifest(spark, str(tmp_path / "one")).collect()}
    assert {n: hashlib.sha256(b).hexdigest() for n, b in one.items()} == {n: r.sha256 for n, r in manifest.items()}
    assert all(r.size == len(one[n]) for n, r in manifest.items())
    assert read(spark, str(tmp_path / "one")) == expected(rows)
    text = gzip.decompress(Path(tmp_path / "one" / sorted(one)[0]).read_bytes())
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


def test_empty_table(spark, tmp_path):
    warc.write_warc(pages(spark, []), str(tmp_path / "e"))
    assert read(spark, str(tmp_path / "e")) == []
