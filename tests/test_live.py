"""Live runs against a local server: stopped and gone on, failures asked again, regions from tables, routing, reports."""

import json
import threading
import uuid
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from skylattice.__main__ import run
from skylattice.plans import live
from skylattice.sources.asking import Run

CITY = "郑州市"


class Handler(BaseHTTPRequestHandler):
    """Points on a lattice of a tenth of a degree; a search finds those in its box, two a page. All requests are noted."""

    seen: Counter = Counter()
    broken: set = set()
    lock = threading.Lock()

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        post = json.loads(q["postStr"]) if "postStr" in q else None
        with self.lock:
            Handler.seen[self.path] += 1
        if "polygon" not in q and not post:
            self.send_error(404)
            return
        box = (post.get("polygon") or post.get("mapBound")) if post else q["polygon"]
        sides = [float(x) for x in box.split(",")]
        west, east, south, north = min(sides[::2]), max(sides[::2]), min(sides[1::2]), max(sides[1::2])
        found = [(x, y) for x in range(1130, 1140) for y in range(340, 350) if west <= x / 10 <= east and south <= y / 10 <= north]
        status, body = 200, {}
        if any(west <= x <= east and south <= y <= north for x, y in self.broken):
            status = 500
        elif post:
            start, size = int(post["start"]), int(post["count"])
            found = found if "mapBound" in post else [p for p in found if p[0] % 2]  # polygons find some columns only
            body = {"status": {"infocode": 0}, "resultType": 1, "count": len(found), "pois": [{"hotPointID": f"{x}-{y}", "name": "n", "lonlat": "", "lon": x / 10, "lat": y / 10} for x, y in found[start : start + size]]}
        else:
            page, size = int(q["page_num"]), int(q["page_size"])
            body = {"status": "1", "count": str(len(found)), "pois": [{"id": f"{x}-{y}", "name": q.get("keywords", "n"), "location": f"{x / 10},{y / 10}", "cityname": CITY if x < 1136 else "", "typecode": "1"} for x, y in found[(page - 1) * size : page * size]]}
        data = json.dumps(body).encode()
        self.send_response(status)
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


@pytest.fixture
def url():
    Handler.seen, Handler.broken = Counter(), set()
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/s"
    server.shutdown()


BOX = ["--lat-min", "34", "--lat-max", "35", "--lng-min", "113", "--lng-max", "114", "--cell-m", "30000"]


def options(url, kind="a"):
    return {"url": url, "kind": kind, "pause_s": "0", "page_size": "2"}


def test_stopped_and_gone_on(spark, tmp_path, url):
    requests = live.asked(spark.createDataFrame([(i, 34.0 + i / 10, 34.1 + i / 10, 113.0, 114.0) for i in range(9)], "idx long, lat_min double, lat_max double, lng_min double, lng_max double"), "a", ["x", "y"])
    first = Run(spark, f"file://{tmp_path}/run", options(url), 2, 4)
    first.plan(requests)
    left = first.ask(batches=2)
    assert left >= 1
    half = sum(Handler.seen.values())
    assert half > 0
    # another process: nothing but the folder is known
    second = Run(spark, f"file://{tmp_path}/run", options(url), 2, 4)
    second.plan(requests.where("false"))
    assert second.ask() == 0
    assert sum(Handler.seen.values()) > half
    assert set(Handler.seen.values()) == {1}  # no request twice
    assert second.open_batches() == []
    n = second.hits().count()
    assert n == sum(r["records"] for r in second.counts().collect())
    assert {r["idx"] for r in second.hits().select("idx").distinct().collect()} == set(range(9))
    assert second.counts().groupBy().sum("requests").first()[0] == 18


def test_failures_are_asked_again(spark, tmp_path, url):
    squares = spark.createDataFrame([(i, 34.0 + i / 10, 34.05 + i / 10, 113.0, 113.3 if i else 112.0) for i in range(6)], "idx long, lat_min double, lat_max double, lng_min double, lng_max double")
    squares = squares.selectExpr("idx", "lat_min", "lat_max", "least(lng_min, lng_max) - 0.01 AS lng_min", "IF(idx = 0, 112.5, lng_max) AS lng_max")
    made = Run(spark, f"file://{tmp_path}/run", options(url), 2, 3)
    made.plan(live.asked(squares, "a", []))
    Handler.broken = {(113.1, 34.3), (113.1, 34.2)}
    made.ask()
    status = made.cells().first().asDict()
    assert status == {"total_cells": 6, "success_cells": 3, "empty_cells": 1, "failed_cells": 2}
    with pytest.raises(RuntimeError, match="weren't asked"):
        fresh = Run(spark, f"file://{tmp_path}/none", options(url))
        fresh.plan(live.asked(squares, "a", []))
        fresh.again()
    before = sum(Handler.seen.values())
    Handler.broken = set()
    assert made.again() == 2
    made.ask()
    assert made.cells().first()["failed_cells"] == 0
    assert made.again() == 0
    again = [n for n in Handler.seen.values() if n > 1]
    assert len(again) == 2  # the first pages of what failed, nothing else
    assert sum(Handler.seen.values()) > before
    ids = [r["idx"] for r in made.hits().select("idx").collect()]
    assert set(ids) == {1, 2, 3, 4, 5}
    assert len(ids) == made.hits().dropDuplicates(["idx", "kw", "page", "pos"]).count()


def test_command_for_provider_a(spark, tmp_path, url, capsys):
    name = f"t{uuid.uuid4().hex[:8]}"
    regions = spark.createDataFrame([(CITY, "4101", 34.0, 35.0, 113.0, 114.0), ("别处", "1", 0.0, 1.0, 0.0, 1.0)], "name string, code string, lat_min double, lat_max double, lng_min double, lng_max double")
    regions.write.saveAsTable(name)
    more = ["--pause-s", "0", "--option", "page_size=2", "--cities", name, "--cell-m", "30000", "--per-batch", "5"]
    run(spark, ["search", "a", url, f"file://{tmp_path}/all", "--region", "郑州", "--keyword", "all", *more])
    report = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert (report["table"], report["saved"], report["failed_cells"], report["region"]) == ("gis_poi_gd_4101", 60, 0, CITY)
    assert report["total_cells"] == report["success_cells"] == report["requests"]
    rows = spark.table("gis_poi_gd_4101")
    assert rows.select("poi_id").distinct().count() == rows.count() == 60
    assert json.loads(rows.first()["raw_data"])["typecode"] == "1"
    run(spark, ["search", "a", url, f"file://{tmp_path}/some", "--region", CITY, "--keyword", "school", "--keyword", "shop", *more])
    assert spark.table("gis_poi_gd_4101_keywords").count() == 60
    run(spark, ["search", "a", url, f"file://{tmp_path}/none", "--region", CITY, "--keyword", "", *more])
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["table"] is None
    with pytest.raises(SystemExit):
        run(spark, ["search", "a", url, f"file://{tmp_path}/no", "--region", "nowhere", *more])
    for t in (name, "gis_poi_gd_4101", "gis_poi_gd_4101_keywords"):
        spark.sql(f"DROP TABLE {t}")


def test_command_for_provider_b(spark, tmp_path, url, capsys):
    name = f"t{uuid.uuid4().hex[:8]}"
    narrow = [*BOX[:-1], "9000"]  # cells of less than a tenth of a degree: polygons find nothing in many, their rectangles do
    asked = ["search", "b", url, f"file://{tmp_path}/b", *narrow, "--table", name, "--pause-s", "0", "--option", "page_size=2", "--parallel", "8"]
    run(spark, asked)
    assert spark.table(name).count() == 100
    assert {json.loads(p)["postStr"].count("mapBound") for p in [json.dumps({k: v[0] for k, v in parse_qs(urlparse(s).query).items()}) for s in Handler.seen]} == {0, 1}
    before = sum(Handler.seen.values())
    run(spark, asked)  # all is there already
    assert sum(Handler.seen.values()) == before
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["saved"] == 100
    spark.sql(f"DROP TABLE {name}")


def test_types_are_asked_for(spark, url, capsys):
    name = f"t{uuid.uuid4().hex[:8]}"
    run(spark, ["types", "a", "--url", url + "/types", "--table", name])  # no types there: the shipped ones
    assert spark.table(name).count() > 10
    spark.sql(f"DROP TABLE {name}")


def test_everything_of_provider_b_is_a_search_for_each_type(spark, tmp_path, url, capsys):
    name = f"t{uuid.uuid4().hex[:8]}"
    box = ["--lat-min", "34", "--lat-max", "34.2", "--lng-min", "113", "--lng-max", "113.2", "--cell-m", "50000"]
    run(spark, ["search", "b", url, f"file://{tmp_path}/b", *box, "--keyword", "all", "--table", name, "--pause-s", "0", "--parallel", "8"])
    asked = {json.loads(parse_qs(urlparse(s).query)["postStr"][0]).get("keyWord") for s in Handler.seen}
    assert len(asked) > 20
    assert None not in asked
    spark.sql(f"DROP TABLE {name}")
