"""Polygons against polygons: exact overlap, holes, touching, containment, and fences of projects as tables."""

import random

import pytest
from pyspark.sql import functions as F

from skylattice.operators import fences, overlap

SHAPE = "k int, polygons array<array<array<array<double>>>>"


def square(x, y, a, b=None):
    x, y, a, b = float(x), float(y), float(a), float(b or a)
    return [[x, y], [x + a, y], [x + a, y + b], [x, y + b], [x, y]]


def meets(p, q):
    """Brute force: corners are on a coarse grid, so shared points are found among crossings, corners and insides in exact integers."""
    edges = lambda poly: [(r[i], r[i + 1]) for part in poly for r in part for i in range(len(r) - 1)]
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    on = lambda a, b, c: side(a, b, c) == 0 and min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])

    def cross(a, b, c, d):
        if on(a, b, c) or on(a, b, d) or on(c, d, a) or on(c, d, b):
            return True
        return (side(a, b, c) > 0) != (side(a, b, d) > 0) and (side(c, d, a) > 0) != (side(c, d, b) > 0)

    def inside(c, part):
        return sum((a[1] > c[1]) != (b[1] > c[1]) and c[0] < (b[0] - a[0]) * (c[1] - a[1]) / (b[1] - a[1]) + a[0] for r in part for a, b in zip(r, r[1:])) % 2 == 1

    if any(cross(*e, *f) for e in edges(p) for f in edges(q)):
        return True
    return any(inside(part[0][0], other) for part in p for other in q) or any(inside(part[0][0], other) for part in q for other in p)


def shapes(r, n):
    """Squares, squares with holes, triangles (long and upright ones too), pairs of squares; corners are whole numbers."""
    found = []
    for k in range(n):
        x, y, a = float(r.randint(-12, 12)), float(r.randint(-12, 12)), float(r.randint(1, 6))
        kind = r.randint(0, 4)
        if kind == 0:
            polygons = [[square(x, y, a)]]
        elif kind == 1:
            polygons = [[square(x, y, a + 4), square(x + 1, y + 1, a + 2)]]
        elif kind == 2:
            polygons = [[[[x, y], [x + r.randint(1, 20), y + r.randint(-3, 3)], [x, y + a], [x, y]]]]
        elif kind == 3:
            polygons = [[square(x, y, a)], [square(x + 8, y - 5, 2.0)]]
        else:
            polygons = r.choice([None, [], [[]], [[[]]]]) if r.random() < 0.3 else [[square(x, y, 1.0, a)]]
        found.append((k, polygons))
    return found


@pytest.mark.parametrize("width", [0.7, 3.0, 50.0])
def test_overlap_as_brute_force(spark, width):
    r = random.Random(int(width))
    left, right = shapes(r, 60), shapes(r, 60)
    whole = lambda p: [part for part in p or [] if part and part[0]]
    theirs = {(i, j) for i, p in left for j, q in right if meets(whole(p), whole(q))}
    a, b = spark.createDataFrame(left, SHAPE), spark.createDataFrame(right, SHAPE)
    made = overlap.overlapping(a, F.col("k"), b, F.col("k"), width).collect()
    assert len(made) == len({tuple(x) for x in made})
    assert {tuple(x) for x in made} == theirs
    assert len(theirs) > 100


def test_plans_hold_no_nested_loop(spark):
    df = spark.createDataFrame(shapes(random.Random(1), 9), SHAPE)
    plan = overlap.overlapping(df, F.col("k"), df, F.col("k"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
    assert "Cartesian" not in plan


def fence(spark, rows, key="area_id"):
    return spark.createDataFrame(rows, f"{key} long, fence_type int, polygons array<array<array<array<double>>>>")


def test_conflicts_by_polygon(spark):
    there = fence(spark, [(k, k, [[square(0, 0, 3.0)]]) for k in (1, 2, 3)])
    corner = [[[2.9, 3.2], [3.2, 2.9], [4.0, 4.0], [2.9, 3.2]]]  # its box meets the square, it doesn't
    new = fence(spark, [(k, k, [[square(1, 1, 0.5)]]) for k in (1, 2, 3)] + [(9, 3, [corner])], "new_id")
    made = {tuple(x) for x in fences.polygon_conflicts(new, there).collect()}
    assert made == {(2, 1), (3, 1), (3, 2)}


def test_project_tables(spark):
    there = fence(spark, [(1, 1, [[square(0, 0, 1.0)]]), (2, 2, [[square(0, 0, 1.0)]]), (3, 3, [[square(5, 5, 1.0)]])])
    areas = lambda *ids: spark.createDataFrame([(p, [[square(0, 0, 9.0)]]) for p in ids], "project_id string, polygons array<array<array<array<double>>>>")
    spark.sql("DROP SCHEMA IF EXISTS project_fences CASCADE")
    names = fences.save_project_fences(fences.polygons_of_project(there, areas("p1", "p2")), "project_fences", ["p1", "p2"])
    assert names == ["project_fences.gis_electric_fence_p1", "project_fences.gis_electric_fence_p2"]
    assert sorted(r["area_id"] for r in spark.table(names[0]).collect()) == [1, 3]
    # a second run replaces its projects and leaves the others
    fences.save_project_fences(fences.polygons_of_project(there.where("area_id = 3"), areas("p2")), "project_fences")
    assert [spark.table(n).count() for n in names] == [2, 1]
    fences.save_project_fences(fences.polygons_of_project(there.where("false"), areas("p2")), "project_fences", ["p2"])
    assert [spark.table(n).count() for n in names] == [2, 0]
    with pytest.raises(ValueError, match="no name"):
        fences.save_project_fences(fences.polygons_of_project(there, areas("p1")), "project_fences", ["p1; DROP"])
    spark.sql("DROP SCHEMA project_fences CASCADE")


def test_lines_near_as_distances(spark):
    """Ends to pieces, pieces to ends, crossings, insides and lone points, against every pair."""
    r = random.Random(5)
    there = fence(spark, [(k, 1, [[square(r.uniform(110, 112), r.uniform(30, 32), r.uniform(0.01, 0.4))]]) for k in range(60)])
    lines = [(k, [[r.uniform(110, 112), r.uniform(30, 32)] for _ in range(r.choice([1, 2, 4]))]) for k in range(40)]
    df = spark.createDataFrame(lines, "r int, line array<array<double>>")
    theirs = {(x["r"], x["area_id"]) for x in fences.routes_near(df, there.selectExpr("*", "polygons[0][0][0][1] AS lat_min", "polygons[0][0][2][1] AS lat_max", "polygons[0][0][0][0] AS lng_min", "polygons[0][0][2][0] AS lng_max"), 9_000.0).collect()}
    for width in (0.1, 1.0):
        assert {tuple(x) for x in overlap.lines_near(df, F.col("r"), there, F.col("area_id"), 9_000.0, width).collect()} == theirs
    assert len(theirs) > 100


def test_copies_are_compared_once(spark, monkeypatch):
    """40 new fences of one shape and 50 of one shape: 2,000 pairs, but one shape's pieces on each side."""
    seen, real = [], overlap.pieces
    monkeypatch.setattr(overlap, "pieces", lambda *a: seen.append(real(*a)) or seen[-1])
    there = fence(spark, [(k, 1, [[square(0, 0, 3.0)]]) for k in range(50)])
    new = fence(spark, [(k, 2, [[square(1, 1, 0.5)]]) for k in range(40)], "new_id")
    pairs = {(i, j) for i in range(40) for j in range(50)}
    assert sorted(tuple(x) for x in fences.polygon_conflicts(new, there).collect()) == sorted(pairs)
    areas = new.select(F.col("new_id").alias("project_id"), "polygons")
    assert sorted((x["project_id"], x["area_id"]) for x in fences.polygons_of_project(there, areas).collect()) == sorted(pairs)
    lines = spark.createDataFrame([(7, [[0.0, 0.0], [1.0, 1.0]])], "r int, line array<array<double>>")
    assert sorted(tuple(x) for x in overlap.lines_near(lines, F.col("r"), there, F.col("area_id"), 900.0).collect()) == [(7, k) for k in range(50)]
    straight = lines.selectExpr("r", "0D AS x1", "0D AS y1", "1D AS x2", "1D AS y2")
    assert sorted(tuple(x) for x in overlap.lines_across(straight, F.col("r"), there, F.col("area_id")).collect()) == [(7, k) for k in range(50)]
    assert max(p.count() for p in seen) == 4


def test_a_key_of_several_rows_gives_each_pair_once(spark):
    there = fence(spark, [(1, 1, [[square(0, 0, 3.0)]]), (1, 2, [[square(2, 2, 3.0)]]), (1, 1, None), (2, 2, [[square(0, 0, 3.0)]])])
    new = fence(spark, [(5, 2, [[square(1, 1, 0.5)]]), (5, 3, [[square(1, 1, 0.5)]]), (5, 3, [[square(2.5, 2.5, 0.5)]]), (6, 1, [[square(1, 1, 0.5)]])], "new_id")
    assert sorted(tuple(x) for x in fences.polygon_conflicts(new, there).collect()) == [(5, 1), (5, 2)]
    made = overlap.overlapping(new, F.col("new_id"), there, F.col("area_id")).collect()
    assert sorted(tuple(x) for x in made) == [(5, 1), (5, 2), (6, 1), (6, 2)]


def test_points_are_tested_once_a_place(spark, monkeypatch):
    seen, real = [], fences.points_in_rectangles
    monkeypatch.setattr(fences, "points_in_rectangles", lambda p, r, w: seen.append((p.count(), r.count())) or real(p, r, w))
    sides = ["0D AS lat_min", "3D AS lat_max", "0D AS lng_min", "3D AS lng_max"]
    there = fence(spark, [(k, 1, [[square(0, 0, 3.0)]]) for k in range(20)] + [(20, 1, None), (21, 1, [[square(9, 9, 1.0)]])]).selectExpr("*", *sides)
    points = spark.createDataFrame([(k, 1.0, 2.0) for k in range(30)] + [(30, 8.0, 8.0), (31, None, 1.0)], "p int, lat double, lng double")
    made = fences.points_in_fences(points, there).select("p", "area_id").collect()
    assert sorted(tuple(x) for x in made) == [(i, j) for i in range(30) for j in range(20)]
    counted = {x["area_id"]: x["n_points"] for x in fences.counted_in_fences(points, there).collect()}
    assert counted == {**dict.fromkeys(range(20), 30), 20: 0, 21: 0}
    assert seen == [(3, 3), (3, 3)]
