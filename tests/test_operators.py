"""Operators on literal rows: the awkward cases of loosely typed geodata."""

import json
import math

import pytest
from pyspark.sql import functions as F

from skylattice.functions import geo, values
from skylattice.operators import dedupe, fences, poi, regions, route, schedule, spatial_join, type_tree, zones
from skylattice.plans import pipelines
from skylattice.sources import dimensions, sinks


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_grid_golden_values(spark):
    china = geo.grid(spark, geo.Bounds(18.0, 54.0, 73.0, 135.0), 1_000_000.0).orderBy("idx").collect()
    assert len(china) == 24 and china[0]["lat"] == 49.5 and china[0]["lng"] == pytest.approx(78.1667, abs=1e-4)
    small = geo.grid(spark, geo.Bounds(31.4, 36.4, 110.4, 116.7), 200_000.0).orderBy("idx").collect()
    assert len(small) == 9 and small[0]["lat"] == pytest.approx(35.5667, abs=1e-4) and small[0]["lng"] == pytest.approx(111.45)
    lone = geo.Bounds(34.65, 34.80, 113.55, 113.75)
    edge, centre = geo.grid(spark, lone, 50_000.0, compat=True).first(), geo.grid(spark, lone, 50_000.0).first()
    assert (edge["lat"], edge["lng"]) == (34.80, 113.55)
    assert (centre["lat"], centre["lng"]) == pytest.approx((34.725, 113.65))
    with pytest.raises(ValueError):
        geo.counts(lone, 0)


@pytest.mark.parametrize("bounds", [(0.0, 1.0, 0.0, 3.0), (-1.0, 1.0, 10.0, 10.2), (10.0, 10.1, 5.0, 9.0)])
def test_grids_agree(spark, bounds):
    """One region's grid by range() and by a table of regions."""
    b = geo.Bounds(*bounds)
    table = spark.createDataFrame([("r", *b)], "name string, lat_min double, lat_max double, lng_min double, lng_max double")
    a = [(r["idx"], round(r["lat"], 9), round(r["lng"], 9)) for r in geo.grid(spark, b, 60_000.0).orderBy("idx").collect()]
    assert a == [(r["idx"], round(r["lat"], 9), round(r["lng"], 9)) for r in geo.grids(table, F.lit(60_000.0)).orderBy("idx").collect()]


def test_rectangle_and_ring(spark):
    r = one(spark, *geo.rectangle(F.lit(34.72), F.lit(113.62), 50_000.0))
    assert (r["lat_max"], r["lng_min"], r["lat_min"], r["lng_max"]) == pytest.approx((35.17045045045045, 113.07197026590121, 34.269549549549545, 114.1680297340988), abs=1e-12)
    # the formula that takes the latitude itself for its cosine would give 112.87665583
    assert abs(r["lng_min"] - 112.87665583) > 0.1
    ring = one(spark, geo.circle_ring(F.lit(34.5), F.lit(113.8), F.lit(6000.0)).alias("r"))["r"]
    assert len(ring) == 37 and ring[0] == pytest.approx(ring[-1]) and ring[0][1] == 34.5 and ring[0][0] > 113.8 and ring[9][1] > 34.5


def test_lng_lat(spark):
    cases = {"113.6,34.7": (113.6, 34.7), "": None, None: None, "113.6": None, "1,2,3": None, "x,1": None, " 0 , -1.5 ": (0.0, -1.5), "NaN,1": None}
    rows = spark.createDataFrame([(c,) for c in cases], "c string").select("c", values.lng_lat(F.col("c")).alias("p")).collect()
    for r in rows:
        want = cases[r["c"]]
        assert (r["p"]["lng"], r["p"]["lat"]) == (want or (None, None))


def test_aliases_and_zero(spark):
    raw = spark.createDataFrame([("0", "113.5", "[]", "", "h", None)], "lon string, lng string, hotPointID string, typeCode string, typecode string, id string").withColumn("lat", F.lit("34.5"))
    kept, older = poi.from_provider_b(raw).first(), poi.from_provider_b(raw, zero_is_missing=True).first()
    assert kept["lng"] == 0.0 and older["lng"] == 113.5
    assert kept["poi_id"] is None and kept["type_code"] == "h"
    assert json.loads(kept["raw_data"])["lng"] == "113.5"
    assert tuple(poi.from_provider_a(raw.select("lon")).columns) == poi.COLUMNS


def test_keywords(spark):
    words = ["all", " 'ALL' ", '"全部"', "全部", "school", "", None]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(values.is_everything(F.col("w"))).collect()]
    assert got == [True, True, True, True, False, False, False]
    assert one(spark, values.distinct_keywords(F.array(F.lit("b"), F.lit(""), F.lit("a"), F.lit("b"), F.lit(None))).alias("k"))["k"] == ["b", "a"]
    assert poi.target_table("4100", None) == poi.target_table("4100", "") == "gis_poi_gd_4100" and poi.target_table("4100", "school") == "gis_poi_gd_4100_keywords"


def test_object_names(spark):
    cases = {"f": ("public", "f", None), "s.f": ("s", "f", None), "s.f()": ("s", "f", ""), "s.f(integer, text)": ("s", "f", "integer, text"), 'a"b.c': ('a"b', "c", None)}
    for name, want in cases.items():
        assert tuple(one(spark, values.object_name(F.lit(name)).alias("o"))["o"]) == want
    assert one(spark, values.quoted(F.lit('a"b')).alias("q"))["q"] == '"a""b"'


def test_first_and_last_wins(spark):
    rows = [("a", 2, "x"), ("a", 1, "y"), (None, 1, "n1"), (None, 2, "n2"), ("", 1, "e1"), ("", 2, "e2")]
    df = spark.createDataFrame(rows, "id string, idx int, v string")
    assert sorted(r["v"] for r in dedupe.first_wins(df, ["id"], ["idx"]).collect()) == ["e1", "e2", "n1", "n2", "y"]
    assert [r["v"] for r in dedupe.first_wins(df, ["id"], ["idx"], keep_missing=False).collect()] == ["y"]
    assert sorted(r["v"] for r in dedupe.last_wins(df, ["id"], ["idx"]).collect()) == ["e1", "e2", "n1", "n2", "x"]
    once = dedupe.first_wins(df, ["id"], ["idx"])
    assert once.exceptAll(dedupe.first_wins(once, ["id"], ["idx"])).isEmpty()
    plan = dedupe.first_wins(df, ["id"], ["idx"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_bucketed_join_is_the_plain_join(spark):
    points = spark.range(500).selectExpr("id AS p", "(id*37%400)/100e0-2 AS lng", "(id*53%300)/100e0-1 AS lat")
    rects = spark.range(40).selectExpr("id AS q", "(id*7%30)/10e0-2 AS lng_min", "(id*7%30)/10e0-2+(id%5)*0.4e0 AS lng_max", "(id*11%25)/10e0-1 AS lat_min", "(id*11%25)/10e0-1+(id%3)*0.5e0 AS lat_max")
    made = spatial_join.points_in_rectangles(points, rects, 0.5)
    want = points.join(rects, F.expr("lat BETWEEN lat_min AND lat_max AND lng BETWEEN lng_min AND lng_max"))
    assert {(r["p"], r["q"]) for r in made.collect()} == {(r["p"], r["q"]) for r in want.collect()}
    assert "NestedLoop" not in made._jdf.queryExecution().toString()
    other = rects.withColumnRenamed("q", "o")
    pairs = [(r["q"], r["o"]) for r in spatial_join.meeting_rectangles(rects, other, 0.3).select("q", "o").collect()]
    box = rects.collect()
    meet = lambda a, b: a["lng_min"] <= b["lng_max"] and b["lng_min"] <= a["lng_max"] and a["lat_min"] <= b["lat_max"] and b["lat_min"] <= a["lat_max"]
    assert sorted(pairs) == sorted((a["q"], b["q"]) for a in box for b in box if meet(a, b))
    # points inside the bounds that nothing holds are reported, and only those
    held = {r["p"] for r in made.collect()}
    assert {r["p"] for r in spatial_join.uncovered(points, rects, 0.5, "p").collect()} == set(range(500)) - held


def test_region_filter_and_lookup(spark):
    df = spark.createDataFrame([("郑州市",), (" 郑州市 ",), ("郑州高新",), ("开封市",), (None,)], "city string")
    assert poi.in_region(df, "郑州市", "city").count() == 3
    assert poi.in_region(df, "郑州市", None).count() == 5
    assert poi.in_region(df, "郑", "city").count() == 0
    table = spark.createDataFrame([("a%b", "1"), ("axb", "2"), ("xa%b", "3"), ("a_b", "4")], "name string, code string")
    assert [r["code"] for r in regions.best_matches(table, "a%b", 5).collect()] == ["1", "3"]
    none = table.where("false")
    assert regions.resolve(none, table, none, "axb").first()["level"] == "city"
    assert regions.resolve(table.where("name = 'xa%b'"), table, none, "a%b").first()["level"] == "province"
    assert regions.resolve(none, none, none, "axb").isEmpty()


def test_types(spark):
    for provider, top, sub in (("a", 14, 60), ("b", 8, 32)):
        tree = dimensions.type_tree(spark, provider)
        flat = type_tree.flatten(tree)
        assert flat.where("level = 1").count() == top and flat.where("level = 2").count() == sub
        assert type_tree.nest(flat).orderBy("code").collect() == tree.orderBy("code").collect()
    assert type_tree.keywords(dimensions.type_tree(spark, "b")).count() == 40
    odd = spark.createDataFrame([("1", "p", None, 1), ("2", "q", None, 1), ("21", "c", "2", 2), ("91", "d", "9", 2)], "type_code string, type_name string, parent_code string, level int")
    assert [(r["code"], len(r["subtypes"])) for r in type_tree.nest(odd).orderBy("code").collect()] == [("1", 0), ("2", 1)]
    named = poi.with_type_name(spark.createDataFrame([("110000",), ("150104",), ("110100",), (None,)], "type_code string"), dimensions.type_tree(spark, "a"))
    assert {r["type_code"]: r["type_name"] for r in named.collect()} == {"110000": "交通设施服务", "150104": "150104", "110100": "铁路与地铁", None: None}


def test_validity(spark):
    cases = [(0, None, 1, True), (1000, 0, 1, True), (None, None, 1, False), (0, 301012, 1, False), (301012, None, 1, False), (0, 0, 2, False), (0, 0, None, False)]
    df = spark.createDataFrame([c[:3] for c in cases], "i int, c int, r int")
    assert [r[0] for r in df.select(poi.valid_b(F.col("i"), F.col("c"), F.col("r"))).collect()] == [c[3] for c in cases]


SQUARE = [[[113.0, 34.0], [114.0, 34.0], [114.0, 35.0], [113.0, 35.0], [113.0, 34.0]]]
HOLED = SQUARE + [[[113.4, 34.4], [113.6, 34.4], [113.6, 34.6], [113.4, 34.6], [113.4, 34.4]]]


def area(**x):
    return json.dumps(x)


def read_areas(spark, rows):
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    schema = zones.SCHEMA.replace("\n", " ")
    return df.select(F.from_json("v", schema).alias("a")).select("a.*")


def test_zone_geometry(spark):
    rows = [
        area(area_id=1, shape=2, lat=34.5, lng=113.8, radius=6000, level=7),
        area(area_id=2, shape=1, polygon_points=SQUARE, level=10),
        area(area_id=3, shape=1, polygon_points=HOLED),
        area(area_id=4, shape=0, lat=34.5, lng=113.8),
        area(area_id=5, lat=34.5, lng=113.8, radius=6000, sub_areas=[{"polygon_points": SQUARE}]),
        area(area_id=6, lat=34.5, lng=113.8, radius=6000, sub_areas=[{"polygon_points": SQUARE}, {"shape": 2}, {"shape": 0}]),
        area(area_id=7, shape=2, lat=34.5, lng=113.8, radius=100, sub_areas=[{"shape": 1}]),
        area(area_id=8, shape=2, lat=34.5, lng=113.8, radius=0),
        area(area_id=9, shape=2),
        area(area_id=10, lat=0, lng=113.8, radius=5),
    ]
    found = {r["area_id"]: r for r in zones.features(read_areas(spark, rows)).collect()}
    kinds = {k: r["geometry"]["kind"] for k, r in found.items()}
    assert kinds == {1: "Polygon", 2: "Polygon", 3: "Polygon", 4: "Point", 5: "Polygon", 6: "MultiPolygon", 7: "Polygon", 8: "Point", 10: "Polygon"}
    assert len(found[6]["geometry"]["polygons"]) == 2 and len(found[1]["geometry"]["polygons"][0][0]) == 37
    assert (found[1]["level_name"], found[2]["level_name"], found[4]["level_name"]) == ("干扰源区域", "特殊管控区", None)
    assert (found[2]["lng_min"], found[2]["lat_max"]) == (113.0, 35.0)
    assert {r["area_id"] for r in zones.features(read_areas(spark, rows), zero_is_missing=True).collect()} == set(found) - {10}
    rows_of = {r["area_id"]: r["geom"] for r in zones.table_rows(zones.features(read_areas(spark, rows)), {"shicode": "1"}).collect()}
    assert rows_of[2] == "MULTIPOLYGON(((113.000000 34.000000,114.000000 34.000000,114.000000 35.000000,113.000000 35.000000,113.000000 34.000000)))"
    assert rows_of[3].count("(113.4") == 1 and rows_of[4] is None
    outer = {r["area_id"]: r["geom"] for r in zones.table_rows(zones.features(read_areas(spark, rows)), holes=False).collect()}
    assert outer[3] == rows_of[2]
    lines = [json.loads(r["value"]) for r in sinks.geojson_lines(zones.features(read_areas(spark, rows))).collect()]
    by_id = {x["properties"]["area_id"]: x["geometry"] for x in lines}
    assert by_id[2] == {"type": "Polygon", "coordinates": SQUARE} and by_id[4] == {"type": "Point", "coordinates": [113.8, 34.5]}


def fence(spark, rows):
    df = spark.createDataFrame(rows, "area_id long, fence_type int, polygons array<array<array<array<double>>>>")
    return df.select("*", *geo.envelope(F.flatten(F.flatten(F.col("polygons")))))


def test_points_and_routes(spark):
    there = fence(spark, [(1, 1, [SQUARE]), (2, 1, [HOLED])])
    points = spark.createDataFrame([("in", 113.2, 34.2), ("hole", 113.5, 34.5), ("out", 115.0, 34.5), ("none", None, 34.5)], "p string, lng double, lat double")
    got = {(r["p"], r["area_id"]) for r in fences.points_in_fences(points, there).collect()}
    assert got == {("in", 1), ("in", 2), ("hole", 1)}
    lines = [("across", [[112.5, 34.5], [114.5, 34.5]]), ("inside", [[113.1, 34.1], [113.2, 34.2]]), ("near", [[112.99, 33.0], [112.99, 36.0]]), ("far", [[110.0, 30.0], [111.0, 30.0]]), ("hops", [[112.0, 36.0], [113.5, 36.0], [116.0, 33.0]])]
    routes = spark.createDataFrame(lines, "r string, line array<array<double>>")
    one_fence = there.where("area_id = 1")
    assert {r["r"] for r in fences.routes_across(routes, one_fence).collect()} == {"across", "inside"}
    assert {r["r"] for r in fences.routes_near(routes, one_fence, 2000.0).collect()} == {"across", "inside", "near"}


def test_conflict_rules(spark):
    side = dict(zip(regions.SIDES, (34.0, 35.0, 113.0, 114.0)))
    new = spark.createDataFrame([(k, k, *side.values()) for k in (1, 2, 3)], "new int, fence_type int, lat_min double, lat_max double, lng_min double, lng_max double")
    old = spark.createDataFrame([(k, k, 34.9, 36.0, 113.9, 115.0) for k in (1, 2, 3)], "old int, right_type int, lat_min double, lat_max double, lng_min double, lng_max double")
    assert {(r["new"], r["old"]) for r in fences.conflicts(new, old).collect()} == {(2, 1), (3, 1), (3, 2)}


def test_flight_plan(spark):
    bounds = geo.Bounds(34.0, 34.05, 113.0, 113.06)
    wall = [[[113.028, 34.0], [113.032, 34.0], [113.032, 34.04], [113.028, 34.04], [113.028, 34.0]]]
    there = fence(spark, [(1, 1, [wall])])
    free = route.nodes(spark, bounds, 1000.0, [100.0], there)
    way = route.flight_plan(free, (34.01, 113.01, 50.0), (34.01, 113.05, 50.0), there).collect()
    assert (way[0]["lat"], way[0]["alt"], way[-1]["lng"]) == (34.01, 50.0, 113.05)
    assert max(r["lat"] for r in way) > 34.04 and {r["alt"] for r in way[1:-1]} == {100.0}
    said = json.loads(route.as_json(spark.createDataFrame(way).orderBy(F.desc("step"))).first()["plan"])
    assert [(p["lng"], p["lat"], p["alt"]) for p in said] == [(r["lng"], r["lat"], r["alt"]) for r in way]
    blocked = free.where("lng < 113.02 OR lng > 113.04")
    assert len(route.flight_plan(blocked, (34.01, 113.01, 50.0), (34.01, 113.05, 50.0)).collect()) == 2
    assert len(route.flight_plan(free.where("false"), (34.01, 113.01, 50.0), (34.01, 113.05, 50.0)).collect()) == 2


def test_cheapest_as_plain_relaxation(spark):
    free = route.nodes(spark, geo.Bounds(10.0, 10.05, 20.0, 20.05), 1000.0, [50.0, 150.0])
    links = [(r["a"], r["b"], r["cost"]) for r in route.neighbours(free).collect()]
    best = {0: 0.0}
    for _ in range(20):
        for a, b, c in links:
            if a in best and best[a] + c < best.get(b, math.inf):
                best[b] = best[a] + c
    got = {r["node"]: r["cost"] for r in route.cheapest(route.neighbours(free), 0).collect()}
    assert got == pytest.approx(best)


def test_schedules_and_metrics(spark):
    pages = schedule.pages(spark.createDataFrame([(1, 0), (2, 25), (3, 26)], "idx int, total int"), F.col("total"), 25)
    assert [(r["idx"], r["page"], r["start"]) for r in pages.orderBy("idx", "page").collect()] == [(1, 1, 0), (2, 1, 0), (3, 1, 0), (3, 2, 25)]
    assert [r["wait_s"] for r in schedule.waits(spark.range(1)).orderBy("try").collect()] == [10, 20, 40, 80, 160]
    hits = spark.createDataFrame([(1, 1, 1, 0, "a"), (1, 1, 1, 1, "b"), (3, 1, 1, 0, "a")], "idx int, kw int, page int, pos int, poi_id string")
    second = spark.createDataFrame([(2, 1, 1, 0, "c"), (1, 1, 1, 0, "z")], "idx int, kw int, page int, pos int, poi_id string")
    assert sorted(r["poi_id"] for r in pipelines.bounds_points(hits, second).collect()) == ["a", "b", "c"]
    shares = poi.type_shares(spark.createDataFrame([("x",), ("x",), (None,)], "type_code string"))
    assert {r["type_code"]: (r["n"], r["percentage"]) for r in shares.collect()} == {"x": (2, 66.7), "unknown": (1, 33.3)}


def test_routes_are_refused_at_the_limit(spark):
    links = spark.createDataFrame([(i, i + 1, 1.0) for i in range(6)], "a long, b long, cost double")
    assert route.cheapest(links, 0).count() == 7
    with pytest.raises(RuntimeError):
        route.cheapest(links, 0, rounds=3)


def test_runs_around_a_place_keep_repeats(spark):
    points = spark.createDataFrame([("p", 34.0, 113.0), ("p", 34.0, 113.0), ("q", 35.0, 113.0)], "poi_id string, lat double, lng double")
    assert pipelines.points_around(points, 34.0, 113.0, 500.0).count() == 2
    zone = spark.createDataFrame([(1, 33.9, 34.1, 112.9, 113.1), (1, 33.9, 34.1, 112.9, 113.1), (2, 36.0, 36.1, 113.0, 113.1)], "area_id long, lat_min double, lat_max double, lng_min double, lng_max double")
    assert pipelines.zones_around(zone, 34.0, 113.0, 500.0).count() == 2


def test_zone_zero_is_no_zone(spark):
    found = spark.createDataFrame([(0, 1), (7, 2), (7, 1), (None, 1)], "area_id long, idx long")
    assert [tuple(r) for r in zones.unique(found, ["idx"]).collect()] == [(7, 1)]


def test_rows_written_are_counted(spark, tmp_path):
    rows = spark.range(5)
    assert sinks.save_json(rows, str(tmp_path / "j")) == 5
    assert spark.read.json(str(tmp_path / "j")).count() == 5
