"""Flight plans against Dijkstra's rounds on small lattices, and the rules of smooth plans."""

import heapq
import itertools
import json
import math

import pytest
from pyspark.sql import functions as F

from skylattice.functions.geo import METRES, Bounds
from skylattice.operators import flight

BOUNDS = Bounds(34.0, 34.06, 113.0, 113.08)
ALTITUDES = [100.0, 200.0, 300.0]


def fences(spark, *rows):
    """Boxes (west, south, east, north, height)."""
    ring = lambda w, s, e, n: [[w, s], [e, s], [e, n], [w, n], [w, s]]
    made = [(k, float(h), [[ring(w, s, e, n)]]) for k, (w, s, e, n, h) in enumerate(rows)]
    return spark.createDataFrame(made, "area_id long, height double, polygons array<array<array<array<double>>>>")


WALLS = ((113.025, 33.99, 113.03, 34.045, 250), (113.05, 34.02, 113.055, 34.09, 900))


def cheapest(lattice, moves, first, last):
    """Dijkstra over states; the cost, or None."""
    out = {}
    for m in moves:
        out.setdefault(m["a"], []).append(m)
    heap, done = [(0, first, -9, -9)], set()
    while heap:
        mm, node, h, v = heapq.heappop(heap)
        if node == last:
            return mm
        if (node, h, v) in done:
            continue
        done.add((node, h, v))
        for m in out.get(node, []):
            turned = abs((m["h"] - h + 4) % 8 - 4)
            if h == -9 or not lattice.smooth or (turned <= 1 and m["v"] * v >= 0):
                heapq.heappush(heap, (mm + m["mm"], m["b"], m["h"], m["v"]))
    return None


@pytest.mark.parametrize("smooth", [True, False])
def test_as_dijkstra(spark, smooth):
    lattice = flight.Lattice(BOUNDS, 1000.0, ALTITUDES, smooth, 4.0)
    there = fences(spark, *WALLS)
    free = spark.createDataFrame(flight.nodes(spark, lattice, there).collect())
    moves = spark.createDataFrame(flight.links(free, lattice, there).collect())
    places = [(34.05, 113.005, 100.0), (34.005, 113.075, 100.0), (34.055, 113.04, 300.0), (34.03, 113.062, 200.0)]
    asked = [(i, *a, *b) for i, (a, b) in enumerate(itertools.permutations(places, 2))]
    requests = spark.createDataFrame(asked, "route_id int, lat double, lng double, alt double, lat2 double, lng2 double, alt2 double")
    way = {}
    for r in flight.ways(free, moves, requests, lattice).collect():
        way.setdefault(r["route_id"], []).append(r)
    node = {r["node"]: r for r in free.collect()}
    all_moves, by_ends = moves.collect(), {}
    for m in all_moves:
        by_ends.setdefault((m["a"], m["b"]), []).append(m)

    def closest(p):
        far = lambda n: math.dist((n["lat"] * METRES, n["lng"] * METRES * math.cos(math.radians(p[0])), n["alt"]), (p[0] * METRES, p[1] * METRES * math.cos(math.radians(p[0])), p[2]))
        return min(node.values(), key=far)["node"]

    assert len(way) == len(asked)
    for i, *p in asked:
        steps = sorted(way[i], key=lambda r: r["step"])
        assert [r["step"] for r in steps] == list(range(len(steps)))
        assert (steps[0]["node"], steps[-1]["node"]) == (closest(p[:3]), closest(p[3:]))
        taken = [by_ends[a["node"], b["node"]][0] for a, b in itertools.pairwise(steps)]
        assert sum(m["mm"] for m in taken) == steps[0]["mm"] == cheapest(lattice, all_moves, steps[0]["node"], steps[-1]["node"])
        if smooth:
            for a, b in itertools.pairwise(taken):
                assert abs((b["h"] - a["h"] + 4) % 8 - 4) <= 1
                assert a["v"] * b["v"] >= 0
            for a, b in itertools.pairwise(steps):
                flat = math.hypot((b["lat"] - a["lat"]) * METRES, (b["lng"] - a["lng"]) * METRES * math.cos(math.radians((a["lat"] + b["lat"]) / 2)))
                assert abs(b["alt"] - a["alt"]) <= math.tan(math.radians(4.0)) * flat * (1 + 1e-6)


def blocked(a, b, walls):
    """Fine steps along a line: True if one lies in a wall that reaches above the lower end."""
    for n in range(1001):
        x, y = (a["lng"] + (b["lng"] - a["lng"]) * n / 1000, a["lat"] + (b["lat"] - a["lat"]) * n / 1000)
        if any(w < x < e and s < y < t and min(a["alt"], b["alt"]) < h for w, s, e, t, h in walls):
            return True
    return False


def test_plans(spark):
    lattice = flight.Lattice(BOUNDS, 1000.0, ALTITUDES, True, 4.0)
    there = fences(spark, *WALLS)
    asked = [(1, 34.005, 113.005, 50.0, 34.005, 113.075, 60.0), (2, 34.05, 113.005, 50.0, 34.05, 113.015, 50.0), (3, 10.0, 10.0, 0.0, 34.05, 113.005, 0.0)]
    requests = spark.createDataFrame(asked, "route_id int, lat double, lng double, alt double, lat2 double, lng2 double, alt2 double")
    made = flight.plans(spark, requests, lattice, there)
    rows = {}
    for r in made.collect():
        rows.setdefault(r["route_id"], []).append(r)
    for own in rows.values():
        own.sort(key=lambda r: r["step"])
        assert [r["step"] for r in own] == list(range(len(own)))
    assert {k: (len(v) > 2, v[0]["found"]) for k, v in rows.items()} == {1: (True, True), 2: (True, True), 3: (False, False)}
    for own in rows.values():
        if own[0]["found"]:
            assert not any(blocked(a, b, WALLS) for a, b in itertools.pairwise(own[1:-1]))
    first = rows[1]
    assert (first[0]["lat"], first[-1]["alt"]) == (34.005, 60.0)
    # pulled straight: far fewer points than cells on the way, and no point could be left out towards the next but one
    assert len(first) <= 9
    said = {r["route_id"]: json.loads(r["plan"]) for r in flight.as_json(made).collect()}
    assert said[3] == [{"lng": 10.0, "lat": 10.0, "alt": 0.0}, {"lng": 113.005, "lat": 34.05, "alt": 0.0}]
    assert [p["lat"] for p in said[1]] == [r["lat"] for r in first]


def test_fences_end_at_their_height(spark):
    lattice = flight.Lattice(BOUNDS, 1000.0, ALTITUDES, False)
    low = fences(spark, (112.0, 33.0, 114.0, 35.0, 150))
    assert {r["alt"] for r in flight.nodes(spark, lattice, low).select("alt").distinct().collect()} == {200.0, 300.0}
    assert flight.nodes(spark, lattice, fences(spark, (112.0, 33.0, 114.0, 35.0, 1000))).isEmpty()
    with pytest.raises(ValueError, match="rise"):
        flight.Lattice(BOUNDS, 1000.0, [2.0, 1.0])


def test_rounds_are_limited(spark):
    lattice = flight.Lattice(BOUNDS, 1000.0, [100.0], False)
    free = spark.createDataFrame(flight.nodes(spark, lattice).collect())
    ends = free.agg(F.lit(1).alias("route_id"), F.min("node").alias("first"), F.max("node").alias("last"))
    with pytest.raises(RuntimeError, match="not settled"):
        flight.settled(flight.links(free, lattice), free, ends, lattice, rounds=2)
