"""Grown fences against distances, and by known areas."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions.geo import METRES
from skylattice.operators import buffer


def ring(*points, turn=False):
    p = [*points, points[0]]
    return [list(map(float, x)) for x in (p[::-1] if turn else p)]


def metric(polygons, lat=0.0):
    """Metres to degrees at the equator."""
    return [[[[x / METRES, y / METRES] for x, y in r] for r in part] for part in polygons]


SQUARE = [[ring((0, 0), (100, 0), (100, 100), (0, 100))]]


def test_known_areas():
    quarter = 64
    circle = 4 * quarter * math.sin(math.pi / 2 / quarter) / 2  # of radius 1, by chords
    dents = 2 * (50 - 2 * (1.25 * math.sqrt(100 - 6.25) + 50 * math.asin(0.25)))  # where the arcs of two corners 5 apart meet, above and below
    cases = {
        "square": (SQUARE, 10, 100 * 100 + 400 * 10 + 100 * circle),
        "the other way round": ([[ring((0, 0), (100, 0), (100, 100), (0, 100), turn=True)]], 10, 100 * 100 + 400 * 10 + 100 * circle),
        "a hole": ([[SQUARE[0][0], ring((20, 20), (80, 20), (80, 80), (20, 80))]], 10, 100 * 100 + 400 * 10 + 100 * circle - 40 * 40),
        "a hole that closes": ([[SQUARE[0][0], ring((45, 45), (55, 45), (55, 55), (45, 55))]], 10, 100 * 100 + 400 * 10 + 100 * circle),
        "two that grow together": ([SQUARE[0], [ring((105, 0), (205, 0), (205, 100), (105, 100))]], 10, 205 * 100 + 610 * 10 + 100 * circle - dents),
        "two apart": ([SQUARE[0], [ring((300, 0), (400, 0), (400, 100), (300, 100))]], 10, 2 * (100 * 100 + 400 * 10 + 100 * circle)),
        "two side by side": ([SQUARE[0], [ring((100, 0), (200, 0), (200, 100), (100, 100))]], 10, 200 * 100 + 600 * 10 + 100 * circle),
        "the same twice": ([SQUARE[0], SQUARE[0]], 10, 100 * 100 + 400 * 10 + 100 * circle),
        "corners on a line": ([[ring((0, 0), (50, 0), (100, 0), (100, 100), (0, 100))]], 10, 100 * 100 + 400 * 10 + 100 * circle),
        # at the inner corner two rectangles overlap in a square
        "an L": ([[ring((0, 0), (100, 0), (100, 50), (50, 50), (50, 100), (0, 100))]], 10, 7500 + 400 * 10 - 100 + 5 / 4 * 100 * circle),
        "nothing grown": (SQUARE, 0, 100 * 100),
        "a point": ([[[[3.0, 4.0]]]], 10, 100 * circle),
    }
    for name, (polygons, r, area) in cases.items():
        made = buffer.grown_polygons(metric(polygons), r, quarter)
        assert made[1] == pytest.approx(area, rel=3e-6), name
    for nothing in (None, [], [[]], [[[]]]):
        assert buffer.grown_polygons(nothing, 10, quarter) is None


def inside(polygons, p):
    return any(sum((y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1 for r in part for (x1, y1), (x2, y2) in zip(r, r[1:])) % 2 for part in polygons)


def away(polygons, p):
    """Distance of a point to polygons."""
    if inside(polygons, p):
        return 0.0
    least = math.inf
    for part in polygons:
        for r in part:
            for (x1, y1), (x2, y2) in zip(r, r[1:]):
                dx, dy = x2 - x1, y2 - y1
                t = max(0, min(1, ((p[0] - x1) * dx + (p[1] - y1) * dy) / ((dx * dx + dy * dy) or 1)))
                least = min(least, math.hypot(p[0] - x1 - t * dx, p[1] - y1 - t * dy))
    return least


@pytest.mark.parametrize("seed", range(6))
def test_as_distances(seed):
    """Stars with deep bays, some with holes, some of two parts: a point is in the grown fence if its distance says so."""
    r = random.Random(seed)

    def star(x, y, size, n):
        return ring(*[(x + size * k * math.cos(2 * math.pi * i / n), y + size * k * math.sin(2 * math.pi * i / n)) for i, k in enumerate(r.choice([0.25, 0.6, 1.0]) for _ in range(n))])

    polygons = [[star(0, 0, 100, r.randint(5, 14))]]
    if seed % 3 == 1:
        polygons[0].append(ring((-8, -8), (8, -8), (8, 8), (-8, 8)))
    if seed % 3 == 2:
        polygons.append([star(90, 60, 70, 7)])
    grow = r.choice([3, 12, 30])
    quarter = 64
    made, area = buffer.grown_polygons(metric(polygons), grow, quarter)
    back = [[[[x * METRES, y * METRES] for x, y in g] for g in part] for part in made]
    sliver = grow * (1 - math.cos(math.pi / 4 / quarter)) + 1e-6
    hits = n = 0
    for x in np.arange(-150, 220, 6.0):
        for y in np.arange(-150, 190, 6.0):
            p = (x + 0.123, y + 0.321)
            d = away(polygons, p)
            n += 1
            if abs(d - grow) > sliver:
                assert inside(back, p) == (d < grow), (p, d)
            hits += d < grow
    assert area == pytest.approx(hits * 36, rel=0.05)


def test_as_rows(spark):
    rows = [(1, metric(SQUARE), 5.0), (2, None, 5.0), (3, [], None)]
    df = spark.createDataFrame(rows, "area_id long, polygons array<array<array<array<double>>>>, area_m2 double")
    made = {x["area_id"]: x for x in buffer.grown_solid(df, 10.0, F.lit(5.0), F.lit(50.0)).collect()}
    assert made[1]["area_m2"] == pytest.approx(14_000 + 100 * math.pi, rel=1e-4)
    assert (made[1]["low_m"], made[1]["high_m"]) == (0.0, 60.0)
    assert made[1]["volume_m3"] == pytest.approx(60 * made[1]["area_m2"])
    assert made[1]["lat_max"] == pytest.approx(110 / METRES)
    assert (made[2]["polygons"], made[3]["area_m2"], made[2]["lat_min"]) == (None, None, None)
    with pytest.raises(ValueError, match="0 metres"):
        buffer.grown(df, -1.0)


def test_copies_are_grown_once(spark, tmp_path):
    df = spark.createDataFrame([(k, metric(SQUARE), 5.0) for k in range(50)] + [(50, None, 5.0)], "area_id long, polygons array<array<array<array<double>>>>, area_m2 double").repartition(5)
    made = buffer.grown(df, 10.0)
    assert made.columns == ["area_id", "polygons", "area_m2", "lat_min", "lat_max", "lng_min", "lng_max"]
    assert "FlatMap" not in (plan := made._jdf.queryExecution().optimizedPlan().toString())
    below = plan[plan.index("MapInArrow") :]
    assert "Aggregate [_shape" in below  # what is grown is grouped by shape
    rows = made.collect()
    assert len(rows) == 51
    assert {round(x["area_m2"] or 0) for x in rows} == {0, 14_314}


@pytest.mark.parametrize("seed", range(8))
def test_convex_as_any(seed):
    """The short way of convex rings and the general one give one outline."""
    r = random.Random(seed)
    turns = sorted(r.uniform(0, 2 * math.pi) for _ in range(r.randint(3, 40)))
    corners = buffer.turned(np.array(ring(*[(100 * math.cos(t), 60 * math.sin(t)) for t in turns], turn=seed % 2 == 1)), True)
    made = buffer.straightened(buffer.convex_outline(corners, 20.0, 16))
    theirs = [buffer.straightened(x) for x in buffer.rings_of(buffer.outline([[corners]], 20.0, 16))]
    assert len(theirs) == 1
    assert buffer.area(made) == pytest.approx(buffer.area(theirs[0]), rel=1e-9)
    gaps = np.hypot(*(made[:, None] - theirs[0][None]).transpose(2, 0, 1))
    assert max(gaps.min(0).max(), gaps.min(1).max()) < 1e-3


def test_what_is_not_convex():
    star = [(100 * math.cos(2 * math.pi * 2 * i / 5), 100 * math.sin(2 * math.pi * 2 * i / 5)) for i in range(5)]  # left turns alone, but twice round
    bay = [(0, 0), (100, 0), (100, 100), (50, 10), (0, 100)]
    for points in (star, bay, [(0, 0), (100, 0)], [(0, 0), (100, 0), (50, 0)]):
        assert buffer.convex_outline(buffer.turned(np.array(ring(*points)), True), 5.0, 16) is None
