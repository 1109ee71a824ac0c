"""WARC archives: their SQL, the round trip, broken files, and the merge against sorting."""

import base64
import glob
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from skylattice.llm import queries, warc
from tests.oracle import compare


def test_as_sql(spark):
    name = "op13_warc_index"
    n, differs = compare(spark, queries.QUERIES[name], queries.ORACLES[name], "/root/testdata/sf0.01")
    assert n and not differs


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()


#: Payloads that look like records, ends of records and nothing.
PAYLOADS = ["", None, "a", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n", "\r\n\r\n", "\n\0\x1f", "ü€😀\r\n", "HTTP/1.1 200 OK\r\n\r\n", "x" * 3_000_000]


def test_round_trip(spark, tmp_path):
    r = random.Random(3)
    pages = [(i, r.choice(["http://b.Example.org/p?q#f", "https://u:p@a.example.org:8/", "x y\r\nz", None, "http://h"]), r.choice(PAYLOADS)) for i in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(5)
    for least in (0, 2, 1000):
        path = f"file://{tmp_path}/{least}"
        warc.write_archives(df, path, min_bytes=least, per_file=17)
        last = {}
        for i, _, html in pages:
            last[html or ""] = i if len((html or "").encode()) >= least else None
        made = {x["page_id"]: x for x in warc.histories(warc.runs(spark, path), 40).collect()}
        held = {x["page_id"]: x["payload"] for x in warc.payloads(spark, path).collect()}
        assert len(made) == len(held) == 300
        for i, url, html in pages:
            text, x = html or "", made[i]
            to = last[text] if last[text] not in (None, i) else None
            assert (x["payload_bytes"], x["payload_digest"]) == (len(text.encode()), digest(text))
            assert (x["record_type"], x["refers_to"]) == ("response" if to is None else "revisit", to)
            assert held[i] == (text.encode() if to is None else None)
        order = sorted(made.values(), key=lambda x: x["capture_no"])
        assert [x["capture_no"] for x in order] == list(range(300))
        assert order == sorted(order, key=lambda x: (x["url_key"], x["page_id"]))
    whole = b"".join(gzip.open(f).read() for f in sorted(glob.glob(f"{tmp_path}/0/part-*")))
    assert whole.startswith(b"WARC/1.1\r\n")
    assert whole.endswith(b"\r\n\r\n")
    assert len(list(warc.parsed(whole))) == 300  # plain archives, and several in one, are read as well
    assert len(glob.glob(f"{tmp_path}/0/part-*")) > 15


def test_broken_archives():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:%b\r\nContent-Length: 7\r\n\r\nH\r\n\r\nab\r\n\r\n"
    good = record % digest("ab").encode()
    assert warc.capture("f", *next(warc.parsed(good)))[1] == b"ab"
    assert len(list(warc.parsed(gzip.compress(good) + gzip.compress(good)))) == 2
    assert list(warc.parsed(gzip.compress(b""))) == []
    for bad in (good[:-1], good[:30], gzip.compress(good)[:-9], good.replace(b"h: 7", b"h: 6"), b"x" + good):
        with pytest.raises(ValueError, match="archive|record"):
            list(warc.parsed(bad))
    with pytest.raises(ValueError, match="digest"):
        warc.capture("f", *next(warc.parsed(record % digest("abc").encode())))


def test_keys():
    keys = {"http://A.b.Com": "com,b,a)/", "https://u:p@h:80/X?y#z": "h)/X?y", "http://h?x": "h)?x", "mailto:x": "mailto:x", "": "", "h.org/p": "h.org/p"}
    assert {u: warc.key_of(u) for u in keys} == keys


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_merge_as_sorting(k):
    r = random.Random(k)
    for _ in range(30):
        parts = [sorted((r.randint(0, 9), r.random()) if r.random() < 0.7 else (5, 0.5) for _ in range(r.choice([0, 1, 5, 40]))) for _ in range(k)]
        made = [parts[a][i] for a, i in warc.merged(parts)]
        assert made == sorted(x for p in parts for x in p)


def test_defined_results(spark, tmp_path):
    rows = [(None, "http://h/", "same"), (None, "http://h/", "same"), (7, None, "same"), (7, "http://h/", "same"), (None, "http://h/", "lone"), (None, "http://h/", "lone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(df, f"file://{tmp_path}/w")
    made = sorted((x["payload_bytes"], x["page_id"] or 0, x["record_type"], x["refers_to"]) for x in warc.histories(warc.runs(spark, f"file://{tmp_path}/w")).collect())
    assert made == [(4, 0, "response", None)] * 2 + [(4, 0, "revisit", 7)] * 2 + [(4, 7, "response", None)] * 2
    warc.write_archives(df.limit(0), f"file://{tmp_path}/none")
    assert warc.histories(warc.runs(spark, f"file://{tmp_path}/none")).count() == 0
