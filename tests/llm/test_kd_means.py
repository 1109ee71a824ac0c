"""Clustering by kd-trees against Lloyd's rounds over all vectors, and its SQL."""

import hashlib

import numpy as np
import pytest

from skylattice.llm import kd_means, queries
from tests.oracle import compare


def test_as_sql(spark):
    name = "op12_kd_filtering"
    n, differs = compare(spark, queries.QUERIES[name], queries.ORACLES[name], "/root/testdata/sf0.01")
    assert n and not differs


def lloyd(ids, points, k, rounds):
    """Plain rounds, with Python's integers."""
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    order = sorted(range(len(ids)), key=lambda i: (name(ids[i]), points[i]))
    centroids = [list(points[i]) for i in order[:k]]
    far = lambda p, c: sum((a - b) ** 2 for a, b in zip(p, c))
    nearest = lambda p: min(range(len(centroids)), key=lambda z: (far(p, centroids[z]), z))
    for _ in range(rounds):
        of = [nearest(p) for p in points]
        for z in range(len(centroids)):
            own = [p for p, o in zip(points, of) if o == z]
            if own:
                centroids[z] = [sum(x) // len(own) for x in zip(*own)]
    of = [nearest(p) for p in points]
    return centroids, of, [far(p, centroids[o]) for p, o in zip(points, of)]


@pytest.mark.parametrize("spread", [2, 300, 1_000_000])
def test_as_plain_rounds(spark, spread):
    """Small spreads give many ties; large ones whole nodes, and products beyond the exact range of floats."""
    r = np.random.default_rng(spread)
    centres = r.integers(-spread, spread + 1, (5, 3))
    points = [tuple(int(x) for x in centres[i % 5] + r.integers(-2, 3, 3)) for i in range(1500)]
    ids = [None if i % 50 == 0 else i % 700 for i in range(1500)]
    rows = [(i, [x / 4 for x in p], 1) for i, p in zip(ids, points)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int").repartition(3)
    made = kd_means.clusters(df, dim=3, k=7, rounds=3, scale=4).collect()
    centroids, of, away = lloyd(ids, points, 7, 3)
    total = {z: sum(a for a, o in zip(away, of) if o == z) for z in range(7)}
    theirs = [(-1 if i is None else i, o, a, total[o], sum(away), tuple(centroids[o])) for i, o, a in zip(ids, of, away)]
    assert sorted((-1 if x["vec_id"] is None else x["vec_id"], *x[1:5], tuple(x["centroid"])) for x in made) == sorted(theirs)


def test_whole_nodes_are_assigned():
    """Well parted clusters: hardly any point reaches a leaf, and the sums are those of all points."""
    r = np.random.default_rng(1)
    centres = r.integers(-5000, 5000, (8, 16))
    of = np.arange(4000) % 8
    points = centres[of] + r.integers(-9, 10, (4000, 16))
    tree = kd_means.Tree.read(kd_means.Tree.of(list(range(4000)), points).row(), 16)
    nodes, assigned, rest = tree.assign(centres)
    assert len(nodes) and len(rest) < 400
    assert (assigned == of[tree.ids]).all()
    counts, sums = tree.totals(centres)
    assert (counts == 500).all()
    assert (sums == np.stack([points[of == z].sum(0) for z in range(8)])).all()


def test_defined_results(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    made = kd_means.clusters(df, dim=2).collect()
    assert sorted(x["vec_id"] for x in made) == [1, 7, 7]
    assert {x["cluster"] for x in made} == {0}
    empty = kd_means.digested(kd_means.clusters(df.limit(0), dim=2))
    assert empty.count() == 0
    assert empty.columns == kd_means.digested(kd_means.clusters(df, dim=2)).columns
    with pytest.raises(Exception, match="beyond"):
        kd_means.clusters(spark.createDataFrame([(1, [-1e30, 0.0])], "vec_id long, embedding array<double>"), dim=2).collect()
