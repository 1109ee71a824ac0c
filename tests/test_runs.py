"""Answers, catalogs that don't answer, and what runs write."""

import json
import uuid

import pytest

from skylattice.__main__ import parser, sync
from skylattice.operators import catalog, zones
from skylattice.plans import pipelines, run_queries
from skylattice.functions.geo import Bounds


def answer(code, *areas):
    return json.dumps({"code": code, "data": {"areas": list(areas)}})


def test_answers(spark):
    ring = [[[113.0, 31.0], [113.5, 31.0], [113.5, 31.5], [113.0, 31.0]]]
    fine = {"area_id": 1, "name": "one", "lat": 31.0, "lng": 113.0, "radius": 500, "shape": 0, "sub_areas": [{"shape": 1, "polygon_points": ring}], "unknown": {"x": 1}}
    bodies = [answer(0, fine, {"area_id": 2, "name": "no place"}), answer(0, fine), answer(1, fine), answer(0), '{"code": 0}', '{"code": 0, "data": null}', "<html>", "", None, "[]"]
    given = spark.createDataFrame([(i, b, "x") for i, b in enumerate(bodies)], "idx int, body string, name string")
    read = zones.from_answers(given, keep=("idx",))
    assert sorted((r["idx"], r["area_id"], r["name"]) for r in read.collect()) == [(0, 1, "one"), (0, 2, "no place"), (1, 1, "one")]
    found = zones.unique(zones.features(read, keep=("idx",)), ["idx"]).collect()
    assert [(r["idx"], r["area_id"], r["geometry"]["kind"], r["lng_max"]) for r in found] == [(0, 1, "Polygon", 113.5)]
    assert zones.from_answers(given.limit(0)).count() == 0


def test_a_catalog_that_does_not_answer_stops_a_sync_before_it_writes(spark):
    source = f"s_{uuid.uuid4().hex}"
    spark.sql(f"CREATE SCHEMA {source}")
    spark.range(3).write.saveAsTable(f"{source}.t")
    args = parser().parse_args(["sync", source, "nowhere.there"])
    with pytest.raises(ConnectionError, match="nowhere.there"):
        sync(spark, args)
    catalog.answering(spark, source)
    assert spark.catalog.tableExists(f"{source}.t")


def test_runs_without_rows(spark):
    zone = spark.createDataFrame([], "area_id long, lat_min double, lat_max double, lng_min double, lng_max double")
    point = spark.createDataFrame([], "poi_id long, lat double, lng double")
    bounds = Bounds(31.0, 32.0, 113.0, 114.0)
    assert pipelines.zones_around(zone, 31.5, 113.5, 1000.0).count() == pipelines.region_zones(zone, bounds, 50_000.0).count() == 0
    assert pipelines.region_points(point, bounds, 50_000.0).count() == pipelines.points_around(point, 31.5, 113.5, 1000.0).count() == 0


def test_what_is_written_is_new_each_time(spark):
    assert run_queries.scratch(spark, "a") != run_queries.scratch(spark, "a")
