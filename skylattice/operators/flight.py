"""Flight plans for many routes at once: cheapest ways over states of a node and a heading, around fences with heights.

A move goes to a node next door in one of eight directions, level, or up or down a layer. Smooth plans climb over as many cells as the
climb angle allows, turn by 45 degrees at most from move to move and put a level move between a climb and a descent; direct plans go
straight up and down and turn as they like. So the cheapest way depends on how a node was reached, and a state is node, heading (h) and slope (v).

All routes are relaxed together: a round joins the states that the last one improved with the moves; only costs travel, in whole
millimetres, so that sums are exact and equal in any order. States that cannot lead to a cheaper way than one already found are left out (straight
distance to the goal, as in A*). Rounds are tables of their own in the shared folder, put together now and then, and never rewritten each
time. Predecessors come from one join at the end (of equal ones the least state), ways from that table by doubling: the number of joins
is the logarithm of the way's length. A way is then pulled straight: from each point on to the furthest point in sight, where no
fence as high as the lower end lies between and the climb angle holds. Routes without a way get the straight line.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skylattice import runtime
from skylattice.functions.geo import METRES, Bounds, counts, grid
from skylattice.operators.overlap import holding, lines_across, pieces

#: Directions in order of h: east, then anticlockwise, as steps of (row from the north, column).
DIRECTIONS = ((0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1))
#: h of a move straight up or down.
UPRIGHT = -1
#: Rounds whose tables are put together.
TOGETHER = 6


class Lattice:
    """Where the nodes are: cell centres of bounds at every altitude, and how steeply smooth plans may climb."""

    def __init__(self, bounds: Bounds, cell_m: float, altitudes: list[float], smooth: bool = True, max_climb_deg: float = 10.0) -> None:
        if altitudes != sorted(set(altitudes)):
            raise ValueError("altitudes rise")
        self.bounds, self.cell_m, self.altitudes, self.smooth = bounds, cell_m, [float(a) for a in altitudes], smooth
        self.rows, self.cols = counts(bounds, cell_m)
        self.tan = math.tan(math.radians(max_climb_deg))
        #: The smallest cosine there: distances east to west are never shorter than with it.
        self.shrink = math.cos(math.radians(max(abs(bounds.lat_min), abs(bounds.lat_max))))

    def moves(self) -> list[tuple[int, int, int, int, int, int]]:
        """k, h, v and the steps in rows, columns and layers of every move: at most 26 a layer."""
        tall, wide = (self.bounds.lat_max - self.bounds.lat_min) / self.rows * METRES, (self.bounds.lng_max - self.bounds.lng_min) / self.cols * METRES * self.shrink
        found = []
        for k, alt in enumerate(self.altitudes):
            for h, (di, dj) in enumerate(DIRECTIONS):
                found.append((k, h, 0, di, dj, 0))
                for v in (-1, 1):
                    if self.smooth and 0 <= k + v < len(self.altitudes):
                        n = math.ceil(abs(self.altitudes[k + v] - alt) / (self.tan * math.hypot(di * tall, dj * wide)) - 1e-9)
                        found.append((k, h, v, di * max(1, n), dj * max(1, n), v))
            found += [(k, UPRIGHT, v, 0, 0, v) for v in (-1, 1) if not self.smooth and 0 <= k + v < len(self.altitudes)]
        return found


def nodes(spark: SparkSession, lattice: Lattice, fences: DataFrame | None = None, width: float = 0.25) -> DataFrame:
    """node, i, j, k, lat, lng, alt of the nodes that no fence(area_id, height, polygons) holds; above its height a fence holds nothing."""
    cells = grid(spark, lattice.bounds, lattice.cell_m)
    top = F.lit(-math.inf)
    if fences is not None:
        held = holding(cells.select(F.col("idx").alias("left"), F.col("lng").alias("x"), F.col("lat").alias("y")), pieces(fences, F.struct("area_id", "height"), F.col("polygons")), width)
        highest = held.groupBy(F.col("left").alias("idx")).agg(F.max("right.height").alias("top"))
        cells, top = cells.join(highest, "idx", "left"), F.coalesce("top", top)
    place = F.col("idx") - 1
    layers = F.posexplode(F.array(*[F.lit(a) for a in lattice.altitudes])).alias("k", "alt")
    made = cells.select("idx", "lat", "lng", top.alias("top"), layers).where("alt >= top")
    return made.select(
        (place * len(lattice.altitudes) + F.col("k")).alias("node"), F.floor(place / F.lit(lattice.cols)).alias("i"), F.pmod(place, F.lit(lattice.cols)).alias("j"),
        F.col("k").cast("long").alias("k"), "lat", "lng", "alt",
    )


def flat_m(lat: Column, lng: Column, lat2: Column, lng2: Column) -> Column:
    """Metres over the ground, with the cosine half-way."""
    dy, dx = (lat2 - lat) * METRES, (lng2 - lng) * METRES * F.cos(F.radians((lat + lat2) / 2))
    return F.sqrt(dx * dx + dy * dy)


def seen(lines: DataFrame, key: Column, fences: DataFrame | None, width: float) -> DataFrame:
    """lines(key, lat_a, lng_a, alt_a, lat, lng, alt) without those that a fence cuts at the height of their lower end or above."""
    if fences is None:
        return lines
    flat = lines.select(key.alias("key"), F.col("lng_a").alias("x1"), F.col("lat_a").alias("y1"), F.col("lng").alias("x2"), F.col("lat").alias("y2"), F.least("alt_a", "alt").alias("low"))
    cut = lines_across(flat, F.struct("key", "low"), fences, F.struct("area_id", "height"), width).where("left.low < right.height")
    return lines.withColumn("_key", key).join(cut.select(F.col("left.key").alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def links(free: DataFrame, lattice: Lattice, fences: DataFrame | None = None, width: float = 0.25) -> DataFrame:
    """a, b, h, v, mm of the moves between free nodes that no fence cuts. Moves are broadcast: 26 rows a layer."""
    moves = free.sparkSession.createDataFrame(lattice.moves(), "k long, h int, v int, di int, dj int, dk int")
    begun = free.join(F.broadcast(moves), "k").select(
        F.col("node").alias("a"), "h", "v", (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"), (F.col("k") + F.col("dk")).alias("k"),
        F.col("lat").alias("lat_a"), F.col("lng").alias("lng_a"), F.col("alt").alias("alt_a"),
    )
    made = begun.join(free.select(F.col("node").alias("b"), "i", "j", "k", "lat", "lng", "alt"), ["i", "j", "k"])
    flat, rise = flat_m(F.col("lat_a"), F.col("lng_a"), F.col("lat"), F.col("lng")), F.col("alt") - F.col("alt_a")
    open_ = seen(made, F.struct("a", "b"), fences, width)
    return open_.select("a", "b", "h", "v", F.round(F.sqrt(flat * flat + rise * rise) * 1000).cast("long").alias("mm"))


def may_follow(lattice: Lattice, h: str, v: str) -> Column:
    """True if a move (columns h and v) may come after one (named h, v); both are null before the first move."""
    if not lattice.smooth:
        return F.lit(True)
    turn = F.pmod(F.col("h") - F.col(h) + 4, F.lit(8)) - 4
    return F.coalesce((F.abs(turn) <= 1) & (F.col("v") * F.col(v) >= 0), F.lit(True))


def nearest(free: DataFrame, places: DataFrame, lattice: Lattice, search: int = 3) -> DataFrame:
    """route_id and node: the free node nearest to each of places(route_id, lat, lng, alt), of those at most `search` cells away."""
    b, tall, wide = lattice.bounds, (lattice.bounds.lat_max - lattice.bounds.lat_min) / lattice.rows, (lattice.bounds.lng_max - lattice.bounds.lng_min) / lattice.cols
    around = [F.explode(F.sequence(c - search, c + search)) for c in (F.floor((F.lit(b.lat_max) - F.col("lat0")) / tall), F.floor((F.col("lng0") - F.lit(b.lng_min)) / wide))]
    asked = places.select("route_id", F.col("lat").alias("lat0"), F.col("lng").alias("lng0"), F.col("alt").alias("alt0")).withColumn("i", around[0]).withColumn("j", around[1])
    flat, rise = flat_m(F.col("lat0"), F.col("lng0"), F.col("lat"), F.col("lng")), F.col("alt") - F.col("alt0")
    far = F.round(F.sqrt(flat * flat + rise * rise) * 1000).cast("long")
    return asked.join(free, ["i", "j"]).groupBy("route_id").agg(F.min(F.struct(far.alias("mm"), F.col("node"))).alias("m")).select("route_id", F.col("m.node").alias("node"))


def settled(moves: DataFrame, free: DataFrame, ends: DataFrame, lattice: Lattice, rounds: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """States (route_id, node, h, v, mm) on ways that may be the cheapest, and for each route with a way its last state: of ends(route_id, first, last)."""
    spark = moves.sparkSession
    goals = runtime.written(ends.join(free.select(F.col("node").alias("last"), F.col("lat").alias("lat_g"), F.col("lng").alias("lng_g"), F.col("alt").alias("alt_g")), "last"), "goals")
    place = free.select("node", "lat", "lng", "alt")
    dy, dx, dz = (F.col("lat") - F.col("lat_g")) * METRES, (F.col("lng") - F.col("lng_g")) * METRES * lattice.shrink, F.col("alt") - F.col("alt_g")
    left = F.floor(F.sqrt(dx * dx + dy * dy + dz * dz) * 999)  # never more than what is left: a little under the straight distance

    state = ["route_id", "node", "h", "v"]
    front = runtime.written(ends.select("route_id", F.col("first").alias("node"), F.lit(None).cast("int").alias("h"), F.lit(None).cast("int").alias("v"), F.lit(0).cast("long").alias("mm")), "front")
    tables = [front]

    def best() -> DataFrame:
        found = tables[0]
        for t in tables[1:]:
            found = found.unionByName(t)
        return found.groupBy(*state).agg(F.min("mm").alias("mm"))

    def hopeful(found: DataFrame, reached: DataFrame) -> DataFrame:
        """Without states that cannot lead to a way as cheap as the route's cheapest so far."""
        with_goal = found.join(goals.drop("first"), "route_id").join(place, "node").join(reached, "route_id", "left")
        return with_goal.where(F.col("most").isNull() | (F.col("mm") + left <= F.col("most"))).select(*state, "mm")

    def cheapest(found: DataFrame) -> DataFrame:
        return found.join(goals.select("route_id", F.col("last").alias("node")), ["route_id", "node"]).groupBy("route_id").agg(F.min("mm").alias("most"))

    moves = runtime.written(moves, "moves")
    for _ in range(rounds):
        before = front.select("route_id", F.col("node").alias("a"), F.col("h").alias("h0"), F.col("v").alias("v0"), F.col("mm").alias("mm0"))
        tried = before.join(moves, "a").where(may_follow(lattice, "h0", "v0")).select("route_id", F.col("b").alias("node"), "h", "v", (F.col("mm0") + F.col("mm")).alias("mm"))
        tried = tried.groupBy(*state).agg(F.min("mm").alias("mm"))
        known = best()
        new = hopeful(tried, cheapest(known)).join(known.withColumnRenamed("mm", "old"), state, "left").where("old IS NULL OR mm < old").drop("old")
        front = runtime.written(new, "front")
        if front.isEmpty():
            break
        tables.append(front)
        if len(tables) > TOGETHER:
            tables[:] = [runtime.written(best(), "best")]
    else:
        raise RuntimeError(f"the routes are not settled after {rounds} rounds")
    done = best()
    done = runtime.written(hopeful(done, cheapest(done)), "settled")
    last = done.join(goals.select("route_id", F.col("last").alias("node")), ["route_id", "node"]).groupBy("route_id").agg(F.min(F.struct("mm", "node", "h", "v")).alias("m"))
    return done, last.select("route_id", "m.*")


def predecessors(done: DataFrame, moves: DataFrame, lattice: Lattice) -> DataFrame:
    """route_id, now and prev (structs of node, h, v): the least state from which each settled one is reached at its cost."""
    named = lambda *c: F.struct(*[F.col(x).alias(n) for x, n in zip(c, ("node", "h", "v"))])
    before = done.select("route_id", F.col("node").alias("a"), F.col("h").alias("h0"), F.col("v").alias("v0"), F.col("mm").alias("mm0"))
    stepped = before.join(moves, "a").where(may_follow(lattice, "h0", "v0"))
    stepped = stepped.select("route_id", F.col("b").alias("node"), "h", "v", (F.col("mm0") + F.col("mm")).alias("mm"), named("a", "h0", "v0").alias("prev"))
    return stepped.join(done, ["route_id", "node", "h", "v", "mm"]).groupBy("route_id", named("node", "h", "v").alias("now")).agg(F.min("prev").alias("prev"))


def followed(begin: DataFrame, pointers: DataFrame) -> DataFrame:
    """route_id, now, pos: what is passed from begin(route_id, now) along pointers(route_id, now, prev), by doubling."""
    chain, jump, n = runtime.written(begin.select("route_id", "now", F.lit(0).cast("long").alias("pos")), "chain"), runtime.written(pointers, "jump"), 1
    while True:
        further = runtime.written(chain.join(jump, ["route_id", "now"]).select("route_id", F.col("prev").alias("now"), (F.col("pos") + n).alias("pos")), "chain")
        if further.isEmpty():
            return chain
        chain = chain.unionByName(further)
        n *= 2
        over = jump.select("route_id", F.col("now").alias("prev"), F.col("prev").alias("to"))
        jump = runtime.written(jump.join(over, ["route_id", "prev"]).select("route_id", "now", F.col("to").alias("prev")), "jump")


def ways(free: DataFrame, moves: DataFrame, requests: DataFrame, lattice: Lattice, search: int = 3) -> DataFrame:
    """route_id, step (from 0), node, lat, lng, alt, mm (of the whole way) of requests(route_id, lat, lng, alt, lat2, lng2, alt2) that have a way."""
    first = nearest(free, requests, lattice, search).withColumnRenamed("node", "first")
    goal = requests.select("route_id", F.col("lat2").alias("lat"), F.col("lng2").alias("lng"), F.col("alt2").alias("alt"))
    ends = runtime.written(first.join(nearest(free, goal, lattice, search).withColumnRenamed("node", "last"), "route_id"), "ends")
    done, last = settled(moves, free, ends, lattice)
    last = runtime.written(last, "last")
    chain = followed(last.select("route_id", F.struct("node", "h", "v").alias("now")), predecessors(done, moves, lattice))
    chain = runtime.written(chain, "way")
    length = chain.groupBy("route_id").agg(F.max("pos").alias("n"))
    steps = chain.join(length, "route_id").select("route_id", (F.col("n") - F.col("pos")).alias("step"), F.col("now.node").alias("node"))
    return steps.join(free.select("node", "lat", "lng", "alt"), "node").join(last.select("route_id", "mm"), "route_id").select("route_id", "step", "node", "lat", "lng", "alt", "mm")


def pulled(way: DataFrame, lattice: Lattice, fences: DataFrame | None = None, reach: int = 32, width: float = 0.25) -> DataFrame:
    """The points of ways that stay when each goes on to the furthest of the next `reach` points in sight; the next point is always in sight."""
    there = way.select("route_id", F.col("step").alias("to"), "lat", "lng", "alt")
    here = way.select("route_id", "step", F.col("lat").alias("lat_a"), F.col("lng").alias("lng_a"), F.col("alt").alias("alt_a"), F.explode(F.sequence(F.col("step") + 1, F.col("step") + reach)).alias("to"))
    pairs = runtime.written(here.join(there, ["route_id", "to"]), "sights")
    next_ = F.col("to") == F.col("step") + 1
    far = pairs.where(~next_)
    if lattice.smooth:
        rise = F.abs(F.col("alt") - F.col("alt_a"))
        far = far.where(rise <= F.lit(lattice.tan * (1 + 1e-9)) * flat_m(F.col("lat_a"), F.col("lng_a"), F.col("lat"), F.col("lng")))
    else:
        far = far.where("alt = alt_a")  # direct plans stay level between their climbs
    seen_ = seen(far, F.struct("route_id", "step", "to"), fences, width).unionByName(pairs.where(next_))
    onward = seen_.groupBy("route_id", F.col("step").alias("now")).agg(F.max("to").alias("prev"))
    begin = way.where("step = 0").select("route_id", F.col("step").alias("now"))
    stays = followed(begin, onward).select("route_id", F.col("now").alias("step"))
    return way.join(stays, ["route_id", "step"])


def plans(spark: SparkSession, requests: DataFrame, lattice: Lattice, fences: DataFrame | None = None, search: int = 3, reach: int = 32, width: float = 0.25) -> DataFrame:
    """route_id, step, lat, lng, alt, found: whole plans of requests(route_id, lat, lng, alt, lat2, lng2, alt2), with the asked places as ends.

    Where no way is found (found: false) the plan is the straight line. The limits of smooth plans hold between nodes; the way from
    and to the asked places is straight, and pulling keeps the climb angle only.
    """
    free = runtime.written(nodes(spark, lattice, fences, width), "nodes")
    moves = runtime.written(links(free, lattice, fences, width), "moves")
    way = runtime.written(ways(free, moves, requests, lattice, search), "ways")
    kept = pulled(way, lattice, fences, reach, width).select("route_id", F.col("step").cast("long"), "lat", "lng", "alt")
    first = requests.select("route_id", F.lit(-1).cast("long").alias("step"), "lat", "lng", "alt")
    last = requests.select("route_id", F.lit(1 << 40).cast("long").alias("step"), F.col("lat2").alias("lat"), F.col("lng2").alias("lng"), F.col("alt2").alias("alt"))
    numbered = kept.unionByName(first).unionByName(last).withColumn("step", F.row_number().over(W.partitionBy("route_id").orderBy("step")) - 1)
    has = way.where("step = 0").select("route_id", F.lit(True).alias("found"))
    return numbered.join(has, "route_id", "left").na.fill(False, ["found"])


def as_json(plan: DataFrame) -> DataFrame:
    """route_id, found, plan: the points of each plan in order as a JSON array. A plan is one way, bounded by the lattice's extent."""
    points = F.array_sort(F.collect_list(F.struct("step", "lng", "lat", "alt")))
    return plan.groupBy("route_id", "found").agg(F.to_json(F.transform(points, lambda p: p.dropFields("step"))).alias("plan"))
