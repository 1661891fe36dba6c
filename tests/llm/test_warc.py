import gzip
import hashlib
import random

import pytest

from windrow.llm import warc


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(((f"k{rng.randrange(9)}", f"t{rng.randrange(3)}", rng.randrange(5), f"r{i}", n) for n in range(rng.randrange(30))), key=warc.order) for i in range(k)]
    assert list(warc.loser_tree([iter(run) for run in runs])) == sorted((r for run in runs for r in run), key=warc.order)


@pytest.mark.parametrize("url,key", [("http://www.Example.com:80/A?b=2&a=1#x", "com,example)/a?a=1&b=2"), ("https://blog.example.org", "org,example,blog)/"), (None, ""), ("http://[bad", "http://[bad"), ("http://a.b:8080/c", "b,a:8080)/c")])
def test_url_keys(url, key):
    assert warc.url_key(url) == key


def test_archives(spark, tmp_path):
    big, other = "é" * 600, "x\r\n\r\nWARC/1.0\r\n" * 200
    rows = [(1, "http://a.example/1", big), (5, "http://a.example/1", big), (3, "http://b.example/\r\nx", big), (2, None, None), (4, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "v", other), (9, "v", other), (9, "v", other), (None, "w", big), (None, "w", "only " * 300)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS payload", "2 AS keeper", "3 AS record_type")
    path = f"file://{tmp_path}/w"
    warc.write_archives(df, path)
    got = warc.merge_index(warc.capture_runs(spark, path)).collect()
    seen = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str)
    keep = {big: 5, other: 9}
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        again = html in keep and page != keep[html]
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", keep[html] if again else None))
    assert seen == sorted(want, key=str)
    files = [gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz")]
    assert sum(f.count(b"WARC-Type: ") for f in files) == len(rows) and all(f.endswith(b"\r\n\r\n") for f in files if f)
    assert {r.url for r in got if r.page_id == 3} == {"http://b.example/%0D%0Ax"}


def test_global_order_over_many_partitions(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, "http://hot.example/" if i % 3 == 0 else f"http://h{rng.randrange(20)}.example/p{rng.randrange(4)}", f"body {i % 50}") for i in range(900)]
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(7), path)
    merged = warc.merge_index(warc.capture_runs(spark, path))
    keys = [(r.urlkey, r.timestamp, r.page_id) for r in merged.toLocalIterator()]
    assert len(keys) == 900 and keys == sorted(keys)


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.merge_index(warc.capture_runs(spark, path)).collect() == []


def test_records_in_chunks():
    record = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n\r\n".encode()
    for size in (1, 2, 3, 7, 1000):
        data = record + record
        chunks = [data[i : i + size] for i in range(0, len(data), size)]
        assert [(o, b) for o, _, b in warc.records(chunks)] == [(0, b"abc\r\n"), (len(record), b"abc\r\n")]
    for broken in (record[:-3], record + b"WARC/1.0"):
        with pytest.raises(ValueError):
            list(warc.records([broken]))


def test_payloads_with_blank_lines_and_a_long_one(spark, tmp_path):
    bodies = ["\r\n", "\r\n\r\n", "a\r\n\r\n\r\n", "\n\r\n\r\nb\r", "x" * 3_000_000 + "\r\n\r\n" * 50_000, "é\r\n\r\nWARC/1.0\r\n\r\n"]
    rows = [(i, f"http://h{i}.example/", b) for i, b in enumerate(bodies)]
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1), path)
    got = {r.page_id: r.payload_digest for r in warc.merge_index(warc.capture_runs(spark, path)).collect()}
    assert got == {i: hashlib.sha1(b.encode()).hexdigest() for i, b in enumerate(bodies)}
