import base64
import gzip
import hashlib
import os
import zlib

import pytest
from pyspark.sql import functions as F

from agentcorpus.llm import warc

SCHEMA = "page_id long, url string, html string, digest int, record_id int, path string, split int"


def pages_of(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, "p", 3) for r in rows], SCHEMA).repartition(parts)


def brute(rows):
    """What must be read back of (page_id, url, html)."""
    out, firsts = [], {}
    for page_id, _, html in rows:
        payload = (html or "").encode()
        if page_id is not None:
            firsts[payload] = min(page_id, firsts.get(payload, page_id))
    for page_id, url, html in rows:
        payload = (html or "").encode()
        first = firsts.get(payload)
        revisit = first is not None and first != page_id
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page_id, url, len(payload), digest, "revisit" if revisit else "response",
                    first if revisit else None, None))
    return sorted(out, key=repr)


def back(pages):
    found = warc.archived(pages)
    assert found.columns == [
        "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "error"
    ]
    return sorted((tuple(r) for r in found.collect()), key=repr)


ROWS = [
    (1, "http://a/1", "<html>one</html>"), (2, "http://a/2", "<html>one</html>"), (3, None, None),
    (4, "http://a/4", ""), (5, "http://a/5", "Straße \U0001f600\r\n\r\nWARC/1.1\r\n"),
    (None, "http://a/6", "<html>one</html>"), (None, "http://a/7", "alone"), (None, "http://a/8", "alone"),
    (1, "http://a/1", "<html>one</html>"), (1, "http://a/9", "other"), (9, "http://b", "x" * 3_000_000),
    (-7, "http://c", "x" * 3_000_000), (10, "http://d", "".join(chr(33 + i * i % 9000) for i in range(400_000))),
]


@pytest.mark.parametrize("split", [900, 1 << 22])
def test_round_trip(spark, monkeypatch, split):
    monkeypatch.setattr(warc, "FILE_BYTES", 4000)  # several files a task
    monkeypatch.setattr(warc, "SPLIT_BYTES", split)
    assert back(pages_of(spark, ROWS)) == brute(ROWS)


def test_many_records_over_many_splits(spark, monkeypatch):
    monkeypatch.setattr(warc, "SPLIT_BYTES", 777)
    rows = [(i, f"http://h/{i}", f"page {i % 7} " * (i % 50)) for i in range(700)]
    assert back(pages_of(spark, rows, 2)) == brute(rows)


def test_equal_payloads_below_the_least_length(spark):
    rows = [(i, "u", "ab" if i < 4 else "abc") for i in range(8)]
    records = pages_of(spark, rows).select(
        F.col("page_id").alias("record_id"), "url", F.col("html").cast("binary").alias("payload")
    )
    marked = warc.mark_revisits(records, least=3).collect()
    assert {(r["record_id"], r["record_type"], r["refers_to"]) for r in marked} == {
        *((i, "response", None) for i in range(5)), *((i, "revisit", 4) for i in range(5, 8))
    }


def test_empty(spark):
    assert back(pages_of(spark, [])) == []


def test_urls_cannot_break_a_header(spark):
    found = back(pages_of(spark, [(1, "http://a/b c\r\nX: y", "text")]))
    assert [r[1] for r in found] == ["http://a/b%20c%0D%0AX:%20y"]


def sample(page_id, payload):
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return warc.record(str(page_id), "http://a", payload, digest, None, False, warc.DATE)


def files_of(spark, folder, contents):
    rows = []
    for name, data in contents.items():
        (folder / name).write_bytes(data)
        rows.append((str(folder / name), len(data), 0))
    return spark.createDataFrame(rows, warc.FILES)


def test_standard_gzip_members(tmp_path):
    text = gzip.decompress(sample(1, b"abc") + sample(2, b""))
    assert text.count(b"WARC/1.1\r\n") == 2 and text.endswith(b"\r\n\r\n\r\n\r\n")


@pytest.mark.parametrize("split", [61, 400, 100_000])
def test_archive_inside_a_record(spark, tmp_path, split):
    """Members that lie as they are in the stored bytes of another record are no records."""
    inner = b"".join(sample(100 + i, os.urandom(300)) for i in range(5))
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored, not compressed
    head = (
        "WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:7>\r\n"
        f"Content-Type: application/gzip\r\nContent-Length: {len(inner)}\r\n\r\n"
    )
    outer = packer.compress(head.encode() + inner + b"\r\n\r\n") + packer.flush()
    files = files_of(spark, tmp_path, {"a": sample(1, b"one") + outer + sample(2, b"two"), "b": inner})
    index = warc.index_archives(files, split)
    found = sorted((os.path.basename(r["path"]), r["record_id"]) for r in index.collect())
    assert found == [("a", "1"), ("a", "2"), ("a", "7"), *[("b", str(100 + i)) for i in range(5)]]
    payloads = {r["record_id"]: r["payload"] for r in warc.read_records(index).collect()}
    assert payloads["7"] == inner and payloads["1"] == b"one"


def test_broken_archives(spark, tmp_path):
    good, cut = sample(1, b"one"), sample(2, os.urandom(5000))
    bad = bytearray(sample(3, os.urandom(5000)))
    bad[3000] ^= 255
    noise = warc.MAGIC + b"no gzip" + gzip.compress(b"no record") + gzip.compress(b"WARC/1.0 but no header")
    contents = {"a": good + cut[:-9], "b": noise + bytes(bad) + good, "c": b"", "d": warc.MAGIC, "e": b"plain"}
    rows = warc.index_archives(files_of(spark, tmp_path, contents), 500).collect()
    found = {(os.path.basename(r["path"]), r["record_id"], r["error"] is None) for r in rows}
    assert found == {("a", "1", True), ("a", "2", False), ("b", "1", True), ("b", "3", False)}


def test_payloads_are_read_back(spark, tmp_path):
    texts = {str(i): os.urandom(i * 700) for i in range(40)}
    files = files_of(spark, tmp_path, {"a": b"".join(sample(k, v) for k, v in texts.items())})
    records = warc.read_records(warc.index_archives(files, 1000))
    assert {r["record_id"]: bytes(r["payload"]) for r in records.collect()} == texts


def test_query(matches):
    matches("op13_warc")
