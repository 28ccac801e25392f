import gzip
import hashlib
import json
import random
from collections import Counter
from pathlib import Path

import pytest

from callsheet.llm import warc
from callsheet.llm.common import new_folder


def record(content, extra=""):
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nPage-ID: {len(content)}\r\n{extra}Content-Length: {len(content)}\r\n\r\n"
    return head.encode() + content + b"\r\n\r\n"


CONTENTS = [b"", b"one", b"\r\n\r\nWARC/1.1\r\n\r\n", b"x" * 3_000_000, "é".encode() * 10, b"\r\n"]


@pytest.mark.parametrize("step", [1, 7, 100_000])
def test_records_are_split_whatever_the_chunks(step):
    contents = CONTENTS if step > 7 else [c for c in CONTENTS if len(c) < 1000]
    raw = b"".join(record(c, "Folded: a\r\n b\r\n") for c in contents)
    chunks = (raw[i : i + step] for i in range(0, len(raw), step))
    found = [(h, b"".join(c)) for h, c in warc.split_records(chunks)]
    assert [c for _, c in found] == [c + b"\r\n\r\n" for c in contents]
    assert all(warc.headers(h)["folded"] == "a b" for h, _ in found)


@pytest.mark.parametrize("cut", [5, 30, -3])
def test_a_cut_archive_is_an_error(cut):
    raw = record(b"content")
    with pytest.raises(ValueError, match="ends within"):
        for _, content in warc.split_records(iter([raw[:cut]])):
            list(content)


@pytest.mark.parametrize("members", ["one", "several"])
def test_normalised_archives_have_a_member_and_an_entry_per_record(spark, members):
    folder = new_folder(spark, "warc-test")
    system, root = warc._open(folder)
    raw = [record(c) for c in CONTENTS]
    source = f"{root}/source.warc.gz"
    Path(source).write_bytes(gzip.compress(b"".join(raw)) if members == "one" else b"".join(map(gzip.compress, raw)))
    (row,) = warc.normalise(spark.createDataFrame([(source,)], "archive string"), folder).collect()
    assert row["records"] == len(CONTENTS)
    data = Path(row["archive"]).read_bytes()
    entries = [json.loads(line) for line in Path(row["index"]).read_bytes().splitlines()]
    assert [gzip.decompress(data[e["offset"] : e["offset"] + e["length"]]) for e in entries] == raw
    assert sum(e["length"] for e in entries) == len(data)
    assert [e["page_id"] for e in entries] == [str(len(c)) for c in CONTENTS]


def run(spark, df, **options):
    folder = new_folder(spark, "warc-test")
    written = warc.write_archives(warc.with_record_types(df), folder, **options)
    normal = warc.normalise(written, folder)
    return written, warc.read_records(normal, folder, with_payload=True)


def brute(rows):
    last = {}
    for page, _, html in rows:
        if page is not None:
            last[html or ""] = max(last.get(html or "", page), page)
    out = []
    for page, url, html in rows:
        html = html or ""
        data = html.encode()
        revisit = len(data) >= 1000 and html in last and last[html] != page
        out.append((None if page is None else str(page), url, len(data), hashlib.sha1(data).hexdigest(),
                    "revisit" if revisit else "response", str(last[html]) if revisit else None,
                    None if revisit else data))
    return Counter(out)


@pytest.mark.parametrize("few", [warc.BROADCAST_ROWS, 3])
def test_pages_come_back(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", few)
    rng = random.Random(1)
    bodies = [None, "", "short", "é" * 499, "é" * 500, "b" * 1000, "c\r\n\r\n" * 300, "d" * 2_000_000]
    rows = [(n, f"http://h/{n}?a=é b\r\nX: y", rng.choice(bodies)) for n in range(60)]
    rows += [(5, None, "b" * 1000), (59, "u", "b" * 1000), (59, "u", "b" * 1000), (None, "n", "b" * 1000), (None, "n", "e" * 1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS id")
    written, found = run(spark, df.repartition(3), archive_bytes=3_000)
    assert written.count() > 3  # small archives, so that several are made
    got = Counter(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in found.collect())
    assert got == brute(rows)


def test_empty_table(spark):
    _, found = run(spark, spark.createDataFrame([], "page_id long, url string, html string"))
    assert found.collect() == []


def test_a_payload_that_differs_from_its_digest_is_an_error():
    row = {"id": 1, "url": "u", "html": "text", "digest": "0" * 40, "record_type": "response", "refers_to": None}
    with pytest.raises(ValueError, match="has digest"):
        warc.parse_record(warc.record_bytes(row, "2024-01-01T00:00:00Z"))


@pytest.mark.parametrize("folder, want", [
    ("/data/x", "/data/x"), ("file:/data/x", "file:///data/x"), ("file:///data/x", "file:///data/x"),
    ("s3a://bucket/x", "s3://bucket/x"), ("s3n://bucket/x", "s3://bucket/x"), ("gs://bucket/x", "gs://bucket/x"),
    ("abfss://c@a.dfs.core.windows.net/x", "abfs://c@a.dfs.core.windows.net/x"), ("hdfs://host/x", "hdfs://host/x"),
])
def test_spark_paths_have_names_that_the_file_systems_know(folder, want):
    assert warc.folder_uri(folder) == want


def test_a_store_without_a_file_system_fails_before_the_job(spark):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        warc.write_archives(spark.range(1), "dbfs://x/y")
