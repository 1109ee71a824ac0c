"""Geometries as WKT and WKB, and layouts along the curve."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from skylattice.functions import wkb
from skylattice.functions.geo import Bounds
from skylattice.sources import layout

SQUARE = [[1.0, 2.0], [3.5, 2.0], [3.5, -4.25], [1.0, 2.0]]
HOLE = [[1.5, 1.0], [2.0, 1.0], [2.0, 0.0], [1.5, 1.0]]
CASES = {
    "POINT(1 2)": ("Point", None, [[[[1.0, 2.0]]]]),
    " srid=4326 ; Point ( -1.5e2  .25 ) ": ("Point", 4326, [[[[-150.0, 0.25]]]]),
    "POLYGON((1 2,3.5 2,3.5 -4.25,1 2))": ("Polygon", None, [[SQUARE]]),
    "SRID=3857;POLYGON ((1 2, 3.5 2, 3.5 -4.25, 1 2), (1.5 1, 2 1, 2 0, 1.5 1))": ("Polygon", 3857, [[SQUARE, HOLE]]),
    "MULTIPOLYGON(((1 2,3.5 2,3.5 -4.25,1 2)),((1.5 1,2 1,2 0,1.5 1)))": ("MultiPolygon", None, [[SQUARE], [HOLE]]),
    "MULTIPOLYGON EMPTY": ("MultiPolygon", None, []),
}
BAD = [None, "", "POINT", "POINT(1)", "POINT(1 2 3)", "POINT Z (1 2 3)", "LINESTRING(1 2,3 4)", "POLYGON((1 2,x 3))", "POLYGON((1 2,3 4)", "1 2"]


def test_wkt(spark):
    df = spark.createDataFrame([(t,) for t in [*CASES, *BAD]], "t string").select("t", wkb.from_wkt(F.col("t")).alias("g"))
    made = {r["t"]: r["g"] and (r["g"]["kind"], r["g"]["srid"], r["g"]["polygons"]) for r in df.collect()}
    assert {t: made[t] for t in CASES} == CASES
    assert [t for t in BAD if made[t] is not None] == []
    again = df.where("g IS NOT NULL").select("g", wkb.from_wkt(wkb.to_wkt(F.col("g"))).alias("h")).collect()
    assert len(again) == len(CASES)
    assert all(r["g"] == r["h"] for r in again)


def test_wkb(spark):
    df = spark.createDataFrame([(t,) for t in [*CASES, *BAD]], "t string").select("t", wkb.from_wkt(F.col("t")).alias("g"))
    made = df.withColumn("b", wkb.to_wkb("g")).withColumn("h", wkb.from_wkb("b")).collect()
    assert all(r["g"] == r["h"] for r in made)
    by = {r["t"]: r["b"] for r in made}
    assert bytes(by["POINT(1 2)"]) == struct.pack("<BI2d", 1, 1, 1.0, 2.0)
    assert bytes(by[" srid=4326 ; Point ( -1.5e2  .25 ) "]).hex().upper().startswith("0101000020E6100000")
    big = struct.pack(">BIi2d", 0, 0x20000001, 4326, 1.0, 2.0)
    bad = [b"", b"\x01", struct.pack("<BI", 1, 2), struct.pack("<BI2d", 1, 1, 1.0, 2.0) + b"x", bytes(by["MULTIPOLYGON EMPTY"])[:-1], struct.pack("<BIII", 1, 3, 1, 1 << 30), None]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate([big, *bad])], "i int, b binary").select("i", wkb.from_wkb("b").alias("g")).orderBy("i").collect()
    assert rows[0]["g"].asDict() == {"kind": "Point", "srid": 4326, "polygons": [[[[1.0, 2.0]]]]}
    assert all(r["g"] is None for r in rows[1:])


BOUNDS = Bounds(30.0, 40.0, 110.0, 120.0)


def test_curve(spark):
    rows = [(110.0, 30.0), (119.99999, 39.99999), (110.0, 35.0), (115.0, 30.0), (0.0, 99.0), (None, 30.0)]
    made = [r[0] for r in spark.createDataFrame(rows, "lng double, lat double").select(layout.curve(F.col("lng"), F.col("lat"), BOUNDS)).collect()]
    assert made == [0, (1 << 32) - 1, 1 << 31, 1 << 30, 0xAAAAAAAA, None]


def test_searches_read_few_files(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, 114.5 + r.random() / 100, 34.5 + r.random() / 100) if i % 3 == 0 else (i, 110 + 10 * r.random(), 30 + 10 * r.random()) for i in range(6000)] + [(-1, None, 31.0)]
    points = spark.createDataFrame(rows, "k int, lng double, lat double")
    path = f"file://{tmp_path}/points"
    layout.save(points, path, BOUNDS, 40)
    whole = spark.read.parquet(f"{path}/rows")
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(rows, key=str)
    total = len(whole.inputFiles())
    assert total >= 35
    boxes = [(0, 34.50, 34.5005, 114.50, 114.5005), (1, 39.0, 39.2, 119.0, 119.2), (2, 0.0, 1.0, 0.0, 1.0)]
    asked = spark.createDataFrame(boxes, "b int, lat_min double, lat_max double, lng_min double, lng_max double")
    made = {(x["b"], x["k"]) for x in layout.in_boxes(spark, path, asked).collect()}
    assert made == {(b, k) for b, s, n, w, e in boxes for k, x, y in rows if x is not None and s <= y <= n and w <= x <= e}
    assert made
    assert len(layout.read(spark, path, asked).inputFiles()) <= total / 5
    assert layout.in_boxes(spark, path, asked.where("b = 2")).count() == 0
    # the crowded place is many files, none much larger than others
    sizes = [r["n"] for r in whole.groupBy(F.col("_metadata.file_path")).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 3 * 6000 / 40


def test_bounds_of_files_hold_all_points(spark, tmp_path):
    with pytest.raises(Exception, match="lng"):
        layout.save(spark.range(3).withColumn("lat", F.lit(1.0)), f"file://{tmp_path}/x", BOUNDS, 2)
