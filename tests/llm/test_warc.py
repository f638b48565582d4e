"""Archives as an exact round trip; the loser tree and the index order against sorting."""

import gzip
import hashlib
import random

import pytest

from crawlsift.llm import warc
from crawlsift.llm.storage import new_path

SCHEMA = "page_id long, url string, html string, archive string"


def test_round_trip(spark):
    long = "é" * 600 + "\r\n\r\nWARC/1.1\r\n"
    pages = [(1, "http://www.B.example/x?b=1&a=2", long, "c"), (9, "http://a.example/", long, "c"), (4, None, long, "c"), (2, "http://a.example:8080/Y#f", "short", "c"), (3, "http://a.example/", "short", "c"), (5, "not a url\r\nX: 1", None, "c"), (6, "http://[bad", "", "c"), (None, "http://n.example/", long, "c"), (9, "http://a.example/", long, "c")]
    path = new_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(pages, SCHEMA), path, records_per_file=2)
    rows = warc.capture_index(spark, path, rows_per_range=3).collect()
    assert len(rows) == len(pages)
    for r in rows:
        html = next((h or "") for p, _, h, _ in pages if p == r.page_id)
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == hashlib.sha1(html.encode()).hexdigest()
        other = html == long and r.page_id != 9
        assert (r.record_type, r.refers_to) == (("revisit", 9) if other else ("response", None))
    assert [(r.urlkey, r.timestamp) for r in rows] == sorted((r.urlkey, r.timestamp) for r in rows)
    assert {r.url for r in rows if r.page_id in (4, 9)} == {None, "http://a.example/"}


def test_records_step_by_step(monkeypatch):
    """Steps much shorter than a record, and a record much longer than a step; what is cut short is told."""
    head = lambda n, text: f"WARC/1.1\r\nWARC-Type: response\r\nN: {n}\r\nContent-Length: {len(text)}\r\n\r\n"
    texts = ["", "a\r\n\r\nb", "x" * 300_000, "y"]
    whole = "".join(head(i, t) + t + "\r\n\r\n" for i, t in enumerate(texts)).encode()
    for step in (1 << 20, 1000, 7):
        monkeypatch.setattr(warc, "CHUNK", step)
        found = list(warc.records(gzip.compress(whole)))
        assert [b.decode() for _, _, _, b in found] == texts and [h["N"] for _, _, h, _ in found] == ["0", "1", "2", "3"]
        for offset, length, _, block in found:
            assert whole[offset : offset + length].endswith(block + b"\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc.records(gzip.compress(whole[:-5])))


def test_many_equal_urls_in_global_order(spark):
    pages = [(i, f"http://h.example/{i % 2}", f"p{i % 7}" * 300, "") for i in range(500)]
    path = new_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(pages, SCHEMA).repartition(5), path, records_per_file=40)
    rows = warc.capture_index(spark, path, rows_per_range=100).collect()
    keys = [(r.urlkey, r.timestamp, r.page_id) for r in rows]
    assert len(keys) == 500 and keys == sorted(keys)
    assert sum(r.record_type == "response" for r in rows) == 500


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((str(rng.randrange(9)), "t", rng.randrange(5), "", "", 0, 0, "", f"f{i}", j, 0, f"f{i}") for j in range(rng.randrange(6))) for i in range(k)]
        runs = [sorted(r, key=warc.order) for r in runs]
        assert [warc.order(x) for x in warc.LoserTree(runs)] == sorted(warc.order(x) for r in runs for x in r)


def test_empty(spark):
    path = new_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert warc.capture_index(spark, path).count() == 0
