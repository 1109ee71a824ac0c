"""Routes on a grid of nodes around fences: relaxation from the start, one join a round, until no open node can better the goal.

A round joins only the nodes that the last one improved with their neighbours. Once the goal is reached, open nodes that cannot lead to a
cheaper way (cost so far plus straight distance) are left out, as A* would. Each round is written to the shared folder, so the plan stays
short and lost executors cost one round at most.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skylattice import runtime
from skylattice.functions.geo import METRES, Bounds, counts, grid
from skylattice.operators.fences import points_in_fences, routes_across


def nodes(spark: SparkSession, bounds: Bounds, cell_m: float, altitudes: list[float], fences: DataFrame | None = None, width: float = 0.5) -> DataFrame:
    """node, i, j, k, lat, lng, alt of the free grid points: cell centres at every altitude, without those inside a fence."""
    _, cols = counts(bounds, cell_m)
    cells = grid(spark, bounds, cell_m)
    if fences is not None:
        held = points_in_fences(cells, fences, width).select("idx").distinct()
        cells = cells.join(held, "idx", "left_anti")
    layer = F.posexplode(F.array(*[F.lit(float(a)) for a in altitudes])).alias("k", "alt")
    made = cells.select("idx", "lat", "lng", layer)
    place = F.col("idx") - 1
    return made.select(
        (place * len(altitudes) + F.col("k")).alias("node"),
        F.floor(place / F.lit(cols)).alias("i"), F.pmod(place, F.lit(cols)).alias("j"), F.col("k").cast("long").alias("k"), "lat", "lng", "alt",
    )


def neighbours(of: DataFrame, fences: DataFrame | None = None, width: float = 0.5) -> DataFrame:
    """a, b, cost (metres) of nodes next to each other, edges and corners included, unless a fence lies between them."""
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) != (0, 0, 0)]
    offset = F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip("ijk", s)]) for s in steps])).alias("o")
    near = of.select(F.col("node").alias("a"), F.col("lat").alias("lat_a"), F.col("lng").alias("lng_a"), F.col("alt").alias("alt_a"), "i", "j", "k", offset)
    near = near.select("a", "lat_a", "lng_a", "alt_a", *[(F.col(n) + F.col(f"o.{n}")).alias(n) for n in "ijk"])
    joined = near.join(of.select(F.col("node").alias("b"), "i", "j", "k", "lat", "lng", "alt"), ["i", "j", "k"])
    dy, dz = (F.col("lat") - F.col("lat_a")) * METRES, F.col("alt") - F.col("alt_a")
    dx = (F.col("lng") - F.col("lng_a")) * METRES * F.cos(F.radians((F.col("lat") + F.col("lat_a")) / 2))
    line = F.array(F.array("lng_a", "lat_a"), F.array("lng", "lat"))
    links = joined.select("a", "b", F.sqrt(dx * dx + dy * dy + dz * dz).alias("cost"), line.alias("line"))
    if fences is not None:
        links = links.join(routes_across(links, fences, width).select("a", "b").distinct(), ["a", "b"], "left_anti")
    return links.drop("line")


def cheapest(links: DataFrame, start: int, goal: int | None = None, straight: DataFrame | None = None, rounds: int = 10_000) -> DataFrame:
    """node, cost, path of the nodes reached from start over links(a, b, cost). With a goal only what it takes to settle it is explored.

    straight: node, left (a distance that no way to the goal undercuts), for leaving nodes out.
    """
    spark = links.sparkSession
    links = runtime.written(links.select("a", F.col("b").alias("next"), F.col("cost").alias("more")), "links")
    best = spark.createDataFrame([(start, 0.0, [start])], "node long, cost double, path array<long>")
    front = best
    for _ in range(rounds):  # leaving it means that nothing is left open
        reached = front.join(links, F.col("node") == F.col("a")).select(F.col("next").alias("node"), (F.col("cost") + F.col("more")).alias("cost"), F.concat("path", F.array("next")).alias("path"))
        least = reached.groupBy("node").agg(F.min(F.struct("cost", "path")).alias("m")).select("node", "m.cost", "m.path")
        old = best.select("node", F.col("cost").alias("old"))
        better = runtime.written(least.join(old, "node", "left").where("old IS NULL OR cost < old").drop("old"), "front")
        if better.isEmpty():
            break
        best = runtime.written(best.join(better.select("node"), "node", "left_anti").unionByName(better), "best")
        front = better
        if goal is not None and (found := best.where(F.col("node") == goal).select("cost").first()):
            if straight is not None:
                front = front.join(straight, "node").where(F.col("cost") + F.col("left") < found["cost"]).drop("left")
            else:
                front = front.where(F.col("cost") < found["cost"])
    else:
        raise RuntimeError(f"the routes are not settled after {rounds} rounds")
    return best


def flight_plan(free: DataFrame, start: tuple[float, float, float], goal: tuple[float, float, float], fences: DataFrame | None = None) -> DataFrame:
    """step, lat, lng, alt from start to goal, both (lat, lng, alt): climb at the start, the cheapest way over free nodes, descent at the goal.

    Points that lie on a straight line between their neighbours are left out. Where no way exists the answer is the straight line.
    """
    spark = free.sparkSession

    def nearest(p: tuple[float, float, float]) -> int | None:
        dy, dz = (F.col("lat") - p[0]) * METRES, F.col("alt") - p[2]
        dx = (F.col("lng") - p[1]) * METRES * math.cos(math.radians(p[0]))
        row = free.agg(F.min(F.struct(F.sqrt(dx * dx + dy * dy + dz * dz).alias("d"), "node")).alias("m")).first()
        return row["m"]["node"] if row["m"] else None

    ends = spark.createDataFrame([(0, *map(float, start)), (1 << 40, *map(float, goal))], "step long, lat double, lng double, alt double")
    a, b = nearest(start), nearest(goal)
    if a is None or b is None:
        return ends.orderBy("step")
    at = free.where(F.col("node") == b).select(F.col("lat").alias("y"), F.col("lng").alias("x"), F.col("alt").alias("z"))
    dy, dz = (F.col("lat") - F.col("y")) * METRES, F.col("alt") - F.col("z")
    # nine tenths: longitudes shrink differently along the way, and the estimate must not be too long
    straight = free.crossJoin(F.broadcast(at)).select("node", (F.lit(0.9) * F.sqrt(dy * dy + dz * dz)).alias("left"))  # at is one row
    way = cheapest(neighbours(free, fences), a, b, straight).where(F.col("node") == b).select(F.posexplode("path").alias("pos", "node"), F.size("path").alias("n"))
    points = way.join(free, "node").select("pos", "i", "j", "k", "lat", "lng", "alt")
    # the way is one list of nodes: bounded by the grid's diameter, so one window over it is small
    turn = W.partitionBy().orderBy("pos")
    step = lambda c: (F.col(c) - F.lag(c).over(turn), F.lead(c).over(turn) - F.col(c))
    straight_on = F.lit(True)
    for c in "ijk":
        before, after = step(c)
        straight_on = straight_on & (before == after)
    kept = points.withColumn("on", F.coalesce(straight_on, F.lit(False))).where("NOT on").select((F.col("pos") + 1).cast("long").alias("step"), "lat", "lng", "alt")
    return kept.unionByName(ends).orderBy("step")


def as_json(plan: DataFrame) -> DataFrame:
    """`plan`: one row with the points of a flight plan in order as a JSON array. A plan is one way, bounded by the grid's diameter."""
    points = F.sort_array(F.collect_list(F.struct("step", "lng", "lat", "alt")))
    return plan.agg(F.to_json(F.transform(points, lambda p: p.dropFields("step"))).alias("plan"))
