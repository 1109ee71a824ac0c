"""Fences grown by a distance, as geometry: offset edges, arcs at corners, and a height range.

What lies within r metres of a polygon is the polygon, a rectangle on the outer side of each edge and a wedge at each corner that turns
outwards; nothing else can be nearest. The grown outline consists of those borders of these pieces that no other piece covers: every border
is cut where it meets others, and the parts whose middles lie in another piece go. What is left is linked to rings; rings that run clockwise are
holes (what a fence encloses, or leaves between its arms). The plane is the ground in metres around the middle of the fence's box.
Rows are independent: different shapes are dealt out evenly and grown one by one, equal ones once; a shape with n corners costs some n squared comparisons
of boxes. A single convex ring needs none: its outline is its edges, moved, and the arcs between them, in order.

Defined results: null, empty and degenerate polygons grow to null (a lone point or a line without area: a point grows to a circle, two points or more
of no area count by their edges). A distance of 0 keeps the shape, a negative one is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.geo import METRES, envelope
from skylattice.operators.overlap import named

POLYGONS = "array<array<array<array<double>>>>"
#: Chords of a quarter circle.
QUARTER = 16
#: Metres: borders closer than this count as one, corners within ten times of it as one corner.
CLOSE = 1e-5
#: Cells of a table of borders against pieces.
CELLS = 1 << 22


def turned(ring: np.ndarray, left: bool) -> np.ndarray:
    """The ring's corners without repeats, with its inside on the left (or right) hand."""
    corners = ring[np.r_[True, (np.abs(np.diff(ring, axis=0)) > CLOSE).any(1)]]
    if len(corners) > 1 and np.allclose(corners[0], corners[-1], rtol=0, atol=CLOSE):
        corners = corners[:-1]
    x, y = corners.T
    area = np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y)
    return corners[::-1] if (area < 0) == left and area != 0 else corners


def convex_pieces(corners: np.ndarray, r: float, quarter: int) -> list[np.ndarray]:
    """Rectangles on the right hand of a ring's edges and wedges at corners that turn left, anticlockwise."""
    if len(corners) == 1:
        turn = np.arange(4 * quarter) * (math.pi / 2 / quarter)
        return [corners + r * np.stack([np.cos(turn), np.sin(turn)], 1)]
    ahead = np.roll(corners, -1, 0)
    along = ahead - corners
    along /= np.hypot(*along.T)[:, None]
    out = r * np.stack([along[:, 1], -along[:, 0]], 1)
    found = [np.array([p, p + n, q + n, q]) for p, q, n in zip(corners, ahead, out)]
    before = np.roll(out, 1, 0)
    angle = np.arctan2(before[:, 0] * out[:, 1] - before[:, 1] * out[:, 0], (before * out).sum(1))
    # an end that turns right round is half a circle
    angle = np.where(angle <= -math.pi + 1e-12, math.pi, angle)
    for p, n, a in zip(corners, before, angle):
        if a > 1e-12:
            turn = np.linspace(0, a, max(1, math.ceil(a / (math.pi / 2 / quarter) - 1e-9)) + 1)
            arc = p + np.stack([n[0] * np.cos(turn) - n[1] * np.sin(turn), n[0] * np.sin(turn) + n[1] * np.cos(turn)], 1)
            found.append(np.concatenate([[p], arc]))
    return found


def convex_outline(corners: np.ndarray, r: float, quarter: int) -> np.ndarray | None:
    """The corners, anticlockwise, of all that lies within r of a ring of turned(); None unless it is convex."""
    if len(corners) < 3:
        return None
    along = np.roll(corners, -1, 0) - corners
    along /= np.hypot(*along.T)[:, None]
    out = r * np.stack([along[:, 1], -along[:, 0]], 1)
    before = np.roll(out, 1, 0)
    angle = np.arctan2(before[:, 0] * out[:, 1] - before[:, 1] * out[:, 0], (before * out).sum(1))
    # left turns alone, and once round
    if (angle < 0).any() or (angle > math.pi - 1e-6).any() or abs(angle.sum() - 2 * math.pi) > 1e-6:
        return None
    chords = np.maximum(1, np.ceil(angle / (math.pi / 2 / quarter) - 1e-9).astype(np.int64))
    i = np.repeat(np.arange(len(corners)), chords + 1)
    nth = np.arange(len(i)) - np.repeat(np.cumsum(chords + 1) - chords - 1, chords + 1)
    turn = angle[i] * nth / chords[i]
    n = before[i]
    arcs = corners[i] + np.stack([n[:, 0] * np.cos(turn) - n[:, 1] * np.sin(turn), n[:, 0] * np.sin(turn) + n[:, 1] * np.cos(turn)], 1)
    return arcs[(np.abs(arcs - np.roll(arcs, 1, 0)) > CLOSE).any(1)]


def cuts(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
    """For each border a-b the places (0 to 1) where it meets lines c-d within their length; only those whose boxes meet are compared."""
    low, high, low2, high2 = np.minimum(a, b) - CLOSE, np.maximum(a, b) + CLOSE, np.minimum(c, d), np.maximum(c, d)
    found = []
    step = max(1, CELLS // max(1, len(c)))
    for at in range(0, len(a), step):
        part = slice(at, at + step)
        near = (low[part, None, 0] <= high2[None, :, 0]) & (high[part, None, 0] >= low2[None, :, 0]) & (low[part, None, 1] <= high2[None, :, 1]) & (high[part, None, 1] >= low2[None, :, 1])
        i, j = np.nonzero(near)
        p, u, v = a[at + i], (b - a)[at + i], (d - c)[j]
        across = lambda m, n: m[:, 0] * n[:, 1] - m[:, 1] * n[:, 0]
        cross, length = across(u, v), (u * u).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            t, s = across(c[j] - p, v) / cross, across(c[j] - p, u) / cross
        meets = (cross != 0) & (s > -1e-9) & (s < 1 + 1e-9) & (t > 0) & (t < 1)
        places, of = [t[meets]], [i[meets]]
        for e in (c[j], d[j]):  # ends of c-d that lie on a-b, for borders that run along each other
            along = ((e - p) * u).sum(1) / length
            on = (np.abs(across(e - p, u)) / np.sqrt(length) < CLOSE) & (along > 0) & (along < 1)
            places.append(along[on])
            of.append(i[on])
        rows = min(step, len(a) - at)
        places, of = np.concatenate([*places, np.zeros(rows), np.ones(rows)]), np.concatenate([*of, np.arange(rows), np.arange(rows)])
        order = np.lexsort((places, of))
        places, of = places[order], of[order]
        new = np.r_[True, (np.diff(places) != 0) | (np.diff(of) != 0)]
        found += np.split(places[new], np.searchsorted(of[new], np.arange(1, rows)))
    return found


def outline(parts: list[list[np.ndarray]], r: float, quarter: int) -> np.ndarray:
    """Borders (x1, y1, x2, y2), the inside on their left hand, of all that lies within r of polygons (lists of rings)."""
    rings = [[turned(ring, i == 0) for i, ring in enumerate(part)] for part in parts]
    pieces = [p for part in rings for ring in part for p in convex_pieces(ring, r, quarter)] if r else []
    solid = [np.stack([ring, np.roll(ring, -1, 0)], 1) for part in rings for ring in part if len(ring) > 2]
    owner_of_ring = [i for i, part in enumerate(rings) for ring in part if len(ring) > 2]
    borders = [np.stack([p, np.roll(p, -1, 0)], 1) for p in pieces] + solid
    of = np.repeat(np.arange(len(borders)), [len(b) for b in borders])
    lines = np.concatenate(borders)
    a, b = lines[:, 0], lines[:, 1]
    places = cuts(a, b, a, b)
    n = np.array([len(p) - 1 for p in places])
    t1, t2 = np.concatenate([p[:-1] for p in places]), np.concatenate([p[1:] for p in places])
    i = np.repeat(np.arange(len(a)), n)
    start, end, of = a[i] + t1[:, None] * (b - a)[i], a[i] + t2[:, None] * (b - a)[i], of[i]
    long = np.hypot(*(end - start).T) > CLOSE
    start, end, of = start[long], end[long], of[long]
    middle, way = (start + end) / 2, end - start
    way = way / np.hypot(*way.T)[:, None]
    covered = np.zeros(len(middle), bool)
    for k, piece in enumerate(pieces):
        here = np.flatnonzero(((middle >= piece.min(0) - 1) & (middle <= piece.max(0) + 1)).all(1) & ~covered & (of != k))
        inside, at, ways = np.ones(len(here), bool), middle[here], way[here]
        for p, q in zip(piece, np.roll(piece, -1, 0)):
            u = (q - p) / max(np.hypot(*(q - p)), 1e-300)
            depth = u[0] * (at[:, 1] - p[1]) - u[1] * (at[:, 0] - p[0])
            # borders that run along each other the same way: the first piece keeps its own
            same = (ways @ u > 1 - 1e-9) & (k > of[here])
            inside &= depth > np.where(same, CLOSE, -CLOSE)
        covered[here[inside]] = True
    for part in range(len(parts)):
        edges = np.concatenate([s for s, o in zip(solid, owner_of_ring) if o == part] or [np.zeros((0, 2, 2))])
        if not len(edges):
            continue
        # a little to the right of each border, so that a part's own edges lie outside of it
        probe = middle + 2 * CLOSE * np.stack([way[:, 1], -way[:, 0]], 1)
        crossed = np.zeros(len(probe), np.int64)
        for (x1, y1), (x2, y2) in edges:
            if y1 != y2:
                crossed += ((y1 > probe[:, 1]) != (y2 > probe[:, 1])) & (probe[:, 0] < (x2 - x1) * (probe[:, 1] - y1) / (y2 - y1) + x1)
        covered |= crossed % 2 == 1
    return np.concatenate([start, end], 1)[~covered]


def rings_of(borders: np.ndarray) -> list[np.ndarray]:
    """The borders linked to closed rings; at a corner where several go on, the one that turns most to the left."""
    name = lambda p: tuple(np.round(p / (10 * CLOSE)).astype(np.int64))
    near = lambda p: ((p[0] + i, p[1] + j) for i in (0, -1, 1) for j in (0, -1, 1))
    onward: dict[tuple, list[int]] = {}
    for i, border in enumerate(borders):
        onward.setdefault(name(border[:2]), []).append(i)
    used, found = np.zeros(len(borders), bool), []
    for first in range(len(borders)):
        ring, i = [], first
        while not used[i]:
            used[i] = True
            ring.append(borders[i, :2])
            way = borders[i, 2:] - borders[i, :2]
            ahead = [j for at in near(name(borders[i, 2:])) for j in onward.get(at, []) if not used[j]]
            if not ahead:
                break
            turn = [math.atan2(way[0] * w[1] - way[1] * w[0], way @ w) for w in (borders[j, 2:] - borders[j, :2] for j in ahead)]
            i = ahead[int(np.argmax(turn))]
        if len(ring) > 2:
            found.append(np.array(ring))
    return found


def straightened(ring: np.ndarray) -> np.ndarray:
    """The ring without corners on a straight line."""
    before, after = ring - np.roll(ring, 1, 0), np.roll(ring, -1, 0) - ring
    bend = np.abs(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0]) > 1e-9 * np.hypot(*before.T) * np.hypot(*after.T)
    return ring[bend] if bend.sum() > 2 else ring


def area(ring: np.ndarray) -> float:
    x, y = (ring - ring.mean(0)).T
    return float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y)) / 2


def holds(ring: np.ndarray, p: np.ndarray) -> bool:
    (x, y), (u, v) = ring.T, np.roll(ring, -1, 0).T
    with np.errstate(divide="ignore", invalid="ignore"):
        return int(np.sum(((y > p[1]) != (v > p[1])) & (p[0] < (u - x) * (p[1] - y) / (v - y) + x))) % 2 == 1


def grown_polygons(polygons: list | None, r: float, quarter: int) -> tuple[list, float] | None:
    """The polygons within r metres of some, and their area in square metres."""
    parts = [[np.array(ring, float) for ring in part if ring] for part in polygons or []]
    parts = [part for part in parts if part]
    if not parts:
        return None
    every = np.concatenate([ring for part in parts for ring in part])
    middle = (every.min(0) + every.max(0)) / 2
    scale = np.array([METRES * math.cos(math.radians(middle[1])), METRES])
    flat = [[(ring - middle) * scale for ring in part] for part in parts]
    convex = convex_outline(turned(flat[0][0], True), r, quarter) if r and len(flat) == len(flat[0]) == 1 else None
    rings = [straightened(ring) for ring in (rings_of(outline(flat, r, quarter)) if convex is None else [convex])]
    outer = [[ring] for ring in rings if area(ring) > CLOSE]
    for hole in (ring for ring in rings if area(ring) < -CLOSE):
        holders = [o for o in outer if holds(o[0], hole[0])]
        if holders:
            min(holders, key=lambda o: area(o[0])).append(hole)
    if not outer:
        return None
    total = sum(area(ring) for o in outer for ring in o)
    return [[[(p / scale + middle).tolist() for p in (*ring, ring[0])] for ring in o] for o in outer], total


def grown(fences: DataFrame, metres: float, quarter: int = QUARTER) -> DataFrame:
    """fences(polygons, ...) with their polygons grown by some metres, area_m2, and the sides of their boxes anew."""
    if metres < 0:
        raise ValueError("fences grow by 0 metres or more")
    rest = [c for c in fences.columns if c not in ("lat_min", "lat_max", "lng_min", "lng_max", "area_m2")]
    kind = pa.list_(pa.list_(pa.list_(pa.list_(pa.float64()))))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [grown_polygons(p, metres, quarter) or (None, None) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.float64())], ["_shape", "polygons", "area_m2"])

    known = fences.select(*rest).withColumn("_shape", named(F.col("polygons")))
    shapes = known.where("_shape IS NOT NULL").groupBy("_shape").agg(F.first("polygons").alias("polygons"))
    # a shape can cost as much as a thousand others, so they are dealt out anew whatever their files
    dealt = shapes.repartition(fences.sparkSession.sparkContext.defaultParallelism * 4)
    found = dealt.mapInArrow(made, f"_shape binary, polygons {POLYGONS}, area_m2 double")
    sides = envelope(F.flatten(F.flatten("polygons")))
    return known.drop("polygons").join(found.select("*", *sides), "_shape", "left").select(*rest, "area_m2", "lat_min", "lat_max", "lng_min", "lng_max")


def grown_solid(fences: DataFrame, metres: float, low: Column, high: Column, quarter: int = QUARTER) -> DataFrame:
    """grown() with low_m and high_m, the heights grown by as much (not below the ground), and volume_m3. Corners of the solid stay sharp."""
    named = fences.withColumn("low_m", F.greatest(low - metres, F.lit(0.0))).withColumn("high_m", high + metres)
    return grown(named, metres, quarter).withColumn("volume_m3", F.col("area_m2") * (F.col("high_m") - F.col("low_m")))
