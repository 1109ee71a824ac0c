"""The paged HTTP source against a local server; tables, views and functions between schemas; streams."""

import json
import threading
import uuid
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from skylattice.operators import catalog
from skylattice.sources import dimensions, map_search, sinks
from skylattice.streaming.polling import unseen

TOTAL = 7


class Handler(BaseHTTPRequestHandler):
    limited: set = set()

    def do_POST(self):
        self.answer(self.rfile.read(int(self.headers["Content-Length"])).decode())

    def do_GET(self):
        self.answer(urlparse(self.path).query)

    def answer(self, form):
        q = {k: v[0] for k, v in parse_qs(form).items()}
        status, body = 200, {}
        if "postStr" in q:
            post = json.loads(q["postStr"])
            start, size = int(post["start"]), int(post["count"])
            body = {"status": {"infocode": 1000}, "resultType": 1, "count": TOTAL, "pois": [{"hotPointID": f"h{i}"} for i in range(start, min(TOTAL, start + size))]}
        elif q.get("what") == "types":
            body = {"status": "1", "types": [{"code": "9", "name": "n", "subtypes": [{"code": "91", "name": "m"}]}]} if self.headers.get("X-Who") == "me" else {"status": "0", "info": "NO"}
        elif q.get("what") == "drones":
            body = {"drones": [{"slug": "d1", "name": "one"}, {"slug": "d1", "name": "one"}, {"name": "none"}]}
        elif "zone" in q:
            body = {"code": 0, "data": {"areas": [{"area_id": 1}, {"area_id": 2}]}}
        elif q.get("what") == "bad":
            status, body = 500, {"code": 9, "msg": "broken"}
        elif q.get("what") == "denied":
            body = {"status": "0", "info": "NO_RIGHT"}
        elif q.get("what") == "none":
            body = {"status": "1", "count": "0", "pois": []}
        elif q.get("what") == "slow" and q["page_num"] not in self.limited:
            self.limited.add(q["page_num"])
            body = {"status": "0", "info": map_search.LIMIT}
        else:
            page, size = int(q.get("page_num") or q["page"]), int(q.get("page_size") or q["offset"])
            body = {"status": "1", "count": str(TOTAL), "pois": [{"id": f"p{i}"} for i in range((page - 1) * size, min(TOTAL, page * size))]}
        data = json.dumps(body).encode()
        self.send_response(status)
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def server():
    httpd = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}/s"
    httpd.shutdown()


def search(spark, url, kind, requests, **options):
    map_search.register(spark)
    reader = spark.read.format("map_search").option("url", url).option("kind", kind).option("requests", json.dumps(requests)).option("pause_s", 0).option("wait_s", 0.01)
    return reader.options(**options).load()


def test_pages_of_version_3(spark, server):
    rows = search(spark, server, "a", [{"idx": 0, "params": {"what": "ok"}}], page_size=3, paging="page,offset").collect()
    assert sorted(json.loads(r["record"])["id"] for r in rows) == [f"p{i}" for i in range(TOTAL)]


def test_pages_and_faults(spark, server):
    requests = [{"idx": i, "params": {"what": w}} for i, w in enumerate(("ok", "bad", "denied", "none", "slow"))]
    rows = search(spark, server, "a", requests, page_size=3).collect()
    by = lambda i: [r for r in rows if r["idx"] == i]
    assert [json.loads(r["record"])["id"] for r in sorted(by(0), key=lambda r: (r["page"], r["pos"]))] == [f"p{i}" for i in range(TOTAL)]
    assert [(r["status"], r["record"]) for r in by(1)] == [("failed", "9: broken")]
    assert [(r["status"], r["record"]) for r in by(2)] == [("failed", "NO_RIGHT")]
    assert [(r["status"], r["record"]) for r in by(3)] == [("empty", None)]
    assert len(by(4)) == TOTAL


def test_other_providers(spark, server):
    b = search(spark, server, "b", [{"idx": 1, "kw": 2, "params": {"queryType": "2", "keyWord": None}}], page_size=4).collect()
    assert {json.loads(r["record"])["hotPointID"] for r in b} == {f"h{i}" for i in range(TOTAL)} and {r["kw"] for r in b} == {2}
    assert search(spark, server, "zones", [{"idx": 1, "params": {"zone": "1"}}]).count() == 2
    with pytest.raises(Exception, match="holds no key"):
        search(spark, server, "a", [{"idx": 1}], key_env="SKYLATTICE_NO_SUCH_KEY").collect()
    assert map_search.error_text("x" * 900) == "x" * 300


def test_requests_from_a_table(spark, server):
    asked = spark.createDataFrame([(i, i % 2, json.dumps({"what": w}) if w else None) for i, w in enumerate(("ok", "bad", "none", None))], "idx int, kw int, params string")
    options = {"url": server, "page_size": "3", "pause_s": "0", "method": "POST"}
    rows = map_search.searched(asked, options).collect()
    assert {i: (len(some := [r for r in rows if r["idx"] == i]), some[0]["status"]) for i in range(4)} == {0: (TOTAL, "ok"), 1: (1, "failed"), 2: (1, "empty"), 3: (TOTAL, "ok")}
    assert map_search.searched(asked.where("false"), options).count() == 0
    with pytest.raises(ValueError, match="GET or POST"):
        map_search.searched(asked, {"url": server, "method": "PUT"})


def test_types_and_drones(spark, server):
    answer = lambda kind, **o: search(spark, server, kind, [{"idx": 0, "params": {"what": kind}}], **o)
    assert [(r["code"], r["subtypes"][0]["name"]) for r in dimensions.types_or_shipped(answer("types", headers='{"X-Who": "me"}'), "b").collect()] == [("9", "m")]
    assert dimensions.types_or_shipped(answer("types"), "b").count() == len(dimensions.TYPES_B)
    listed = dimensions.drones(answer("drones"))
    assert [tuple(r) for r in listed.collect()] == [("d1", "one")]
    wanted = spark.createDataFrame([("d1",), ("d2",), (None,)], "slug string")
    assert {r["slug"]: r["listed"] for r in dimensions.with_membership(wanted, listed, "slug").collect()} == {"d1": True, "d2": False, None: False}


def test_reachable(spark):
    catalog.reachable(spark, catalog.jdbc_options(f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "t"))
    with pytest.raises(ConnectionError, match="does not answer"):
        catalog.reachable(spark, catalog.jdbc_options("jdbc:derby:memory:none", "t"))


def test_catalog(spark):
    a, b = (f"s{uuid.uuid4().hex[:8]}" for _ in "ab")
    spark.sql(f"CREATE SCHEMA {a}")
    sinks.save_table(spark.range(5).withColumn("k", F.col("id") % 2), f"{a}.t", "it's a table", {"id": "number"}, by=("k",))
    assert "it's a table" in str(spark.sql(f"DESCRIBE EXTENDED {a}.t").collect())
    assert [(r["name"], r["rows"]) for r in catalog.sync_tables(spark, ["t"], a, b).collect()] == [("t", 5)]
    assert catalog.sync_tables(spark, ["t"], a, b, clean=False).first()["rows"] == 10
    assert catalog.sync_views(spark, {"v1": f"SELECT * FROM {b}.v2", "v2": f"SELECT id FROM {b}.t"}, b) == ["v2", "v1"]
    assert spark.table(f"{b}.v1").count() == 10
    assert catalog.sync_functions(spark, {"plus": "(x INT) RETURNS INT RETURN x + 1"}, b) == ["plus"]
    assert spark.sql(f"SELECT {b}.plus(1) AS y").first()["y"] == 2
    found = {(r["name"], r["kind"]) for r in catalog.objects(spark, [a, b]).where(F.col("schema") == b).collect()}
    assert {("t", "table"), ("v1", "view"), ("v2", "view")} <= found
    assert catalog.chosen([], catalog.objects(spark, [b]), "view") == ["v1", "v2"] and catalog.chosen(["x"], catalog.objects(spark, [b]), "view") == ["x"]
    with pytest.raises(ValueError):
        catalog.in_order({"a": {"b"}, "b": {"a"}})
    assert catalog.jdbc_options("jdbc:x", "t", "SKYLATTICE_NONE", "id", 0, 9, 4)["numPartitions"] == "4"


def test_upserted(spark):
    old = spark.createDataFrame([("a", "1", 1, "old"), ("a", None, 1, "n")], "p string, k string, seq int, v string")
    new = spark.createDataFrame([("a", "1", 2, "new"), ("a", None, 2, "m")], "p string, k string, seq int, v string")
    assert sorted(r["v"] for r in sinks.upserted(old, new, ["p", "k"], "seq").collect()) == ["m", "n", "new"]


def test_unseen(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 01:00:00"), ("b", "2024-01-01 02:00:00")], "k string, t string")
    rows.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, t timestamp").json(str(tmp_path / "in"))
    name = f"q{uuid.uuid4().hex[:8]}"
    unseen(stream, ["k"], "t").writeStream.format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination()
    assert sorted(r["k"] for r in spark.table(name).collect()) == ["a", "b"]
