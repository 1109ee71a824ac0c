"""Centroid clustering (Lloyd's rounds) by kd-tree filtering, in integers throughout.

Every partition deals its vectors into blocks of BLOCK and builds a kd-tree over each: a complete tree of halvings along the widest
side, with the count, the integer sums and the box of every node. The trees are made once and written; a round only reads them. It goes
down a tree level by level with the centroids that are still open at each node: a centroid is pruned where another is nearer
for every point of the box (strictly, so that ties reach the leaves), a node with one centroid left is assigned whole by its sums, and
what reaches a leaf is resolved exactly, the smaller number on ties. A task hands on one row of sums for each centroid; the driver sees k
rows of sums a round.

Defined results: vectors with another number of components, or with a null or a non-finite one, are left out; so are null vectors.
Components count as floor(scale * x) and must lie within +-LARGEST, else the run ends with an error: squared distances stay exact in
64 bits. Rows that repeat a vector or an id are clustered each on its own. Of k starting vectors, those with equal hashes (rows that repeat an
id, or have none) are ordered by their components; fewer than k vectors make fewer centroids. An empty table gives an empty result.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice import runtime

#: Vectors of a tree, and of a leaf at most.
BLOCK = 8192
LEAF = 32
#: Components may be this large; and so large that floating-point products are exact over any number of components in use.
LARGEST = 1 << 26
TREE = "ids array<bigint>, points binary, counts binary, sums binary, low binary, high binary"


def vectors(df: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """vec_id and the components as integers, of the vectors that are whole."""
    x = F.col(f"`{vector_col}`")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    whole = df.where((F.size(x) == dim) & F.forall(x, finite))
    return whole.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(scale))).alias("v"))


def starts(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the least SHA-256 of `seed:id`, in that order: k rows at most reach the driver."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    found = points.withColumn("h", F.sha2(name.cast("binary"), 256)).orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in found], np.int64)


def halves(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """The order of points by leaves, and the edges of the leaves: a power of two of them, of at most `leaf` points."""
    order, edges = np.arange(len(points)), np.array([0, len(points)])
    while np.diff(edges).max() > leaf:
        middles = []
        for a, b in zip(edges[:-1], edges[1:]):
            own, middle = order[a:b], (b - a) // 2
            if b - a > 1:
                part = points[own]
                widest = int(np.argmax(part.max(0) - part.min(0)))
                order[a:b] = own[np.argpartition(part[:, widest], middle)]
            middles.append(a + middle)
        edges = np.sort(np.concatenate([edges, middles]))
    return order, edges


class Tree:
    """A block of points: the leaves' edges, and for each level from the root the nodes' counts, sums and boxes."""

    def __init__(self, ids: list[int | None], points: np.ndarray, counts: np.ndarray, sums: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.ids, self.points, self.counts, self.sums, self.low, self.high = ids, points, counts, sums, low, high

    @classmethod
    def of(cls, ids: list[int | None], points: np.ndarray) -> Tree:
        order, edges = halves(points)
        points = points[order]
        n = len(edges) - 1
        # nodes in rows as in a heap: 1 is the root, 2 i and 2 i + 1 are below i, the leaves are n .. 2 n - 1
        counts, sums = np.zeros(2 * n, np.int64), np.zeros((2 * n, points.shape[1]), np.int64)
        low, high = np.full_like(sums, LARGEST), np.full_like(sums, -LARGEST)
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            if b > a:
                own = points[a:b]
                counts[n + i], sums[n + i], low[n + i], high[n + i] = b - a, own.sum(0), own.min(0), own.max(0)
        for i in range(n - 1, 0, -1):
            counts[i], sums[i] = counts[2 * i] + counts[2 * i + 1], sums[2 * i] + sums[2 * i + 1]
            low[i], high[i] = np.minimum(low[2 * i], low[2 * i + 1]), np.maximum(high[2 * i], high[2 * i + 1])
        return cls([ids[i] for i in order], points, counts, sums, low, high)

    def row(self) -> dict[str, object]:
        narrow = {k: getattr(self, k).astype(np.int32) for k in ("points", "low", "high")}
        packed = narrow | {"counts": self.counts, "sums": self.sums}
        return {"ids": self.ids, **{k: v.tobytes() for k, v in packed.items()}}

    @classmethod
    def read(cls, row: dict[str, object], dim: int) -> Tree:
        get = lambda name, kind: np.frombuffer(row[name], kind).astype(np.int64)
        points, low, high = (get(k, np.int32).reshape(-1, dim) for k in ("points", "low", "high"))
        return cls(row["ids"], points, get("counts", np.int64), get("sums", np.int64).reshape(-1, dim), low, high)

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nodes assigned whole with their centroids, as pairs; the centroid of every point; the points that leaves resolved."""
        n, k = len(self.counts) // 2, len(centroids)
        open_at = np.zeros((2 * n, k), bool)
        open_at[1] = True
        level, whole = np.array([1]), [np.zeros((0, 2), np.int64)]
        while len(level):
            left = kept(self.low[level], self.high[level], open_at[level], centroids)
            one = left.sum(1) == 1
            whole.append(np.stack([level[one], left[one].argmax(1)], 1))
            level, left = level[~one], left[~one]
            open_at[level] = left
            inner = level < n
            children = np.concatenate([2 * level[inner], 2 * level[inner] + 1])
            open_at[children] = np.concatenate([left[inner], left[inner]])
            level = np.sort(children[self.counts[children] > 0])
        nodes = np.concatenate(whole)
        of, ends = np.full(len(self.points), -1), np.cumsum(self.counts[n:])
        for node, z in nodes.tolist():
            last = node
            while last < n:
                last = 2 * last + 1
            of[ends[last - n] - self.counts[node] : ends[last - n]] = z
        rest = np.flatnonzero(of < 0)
        if len(rest):
            leaf = np.repeat(np.arange(n), self.counts[n:])[rest] + n
            far = np.where(open_at[leaf], distances(self.points[rest], centroids), np.iinfo(np.int64).max)
            of[rest] = far.argmin(1)  # the smaller number on ties
        return nodes, of, rest

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and sums of the points of each centroid: whole nodes by their sums, the others one by one."""
        nodes, of, rest = self.assign(centroids)
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
        np.add.at(counts, nodes[:, 1], self.counts[nodes[:, 0]])
        np.add.at(sums, nodes[:, 1], self.sums[nodes[:, 0]])
        np.add.at(counts, of[rest], 1)
        np.add.at(sums, of[rest], self.points[rest])
        return counts, sums


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exact: by floating-point products where all of them stay below 2^53."""
    largest = max(int(np.abs(points).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    exact = np.float64 if largest * largest * points.shape[1] < 1 << 53 else np.int64
    cross = (points.astype(exact) @ centroids.T.astype(exact)).astype(np.int64)
    return (points * points).sum(1)[:, None] - 2 * cross + (centroids * centroids).sum(1)[None, :]


def kept(low: np.ndarray, high: np.ndarray, is_open: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The open centroids of each box that the one nearest to its middle doesn't beat everywhere in the box."""
    # distances to the middle of the box, doubled to stay in integers
    far = np.where(is_open, distances(low + high, 2 * centroids), np.iinfo(np.int64).max)
    best = far.argmin(1)
    left = is_open.copy()
    near = centroids[best]
    for z, c in enumerate(centroids):
        rows = np.flatnonzero(is_open[:, z] & (best != z))
        if len(rows):
            towards = c[None, :] - near[rows]
            corner = np.where(towards > 0, high[rows], low[rows])
            # the corner that suits z best: if even there the other is nearer, z never wins in the box
            left[rows, z] = ((corner - c) ** 2).sum(1) <= ((corner - near[rows]) ** 2).sum(1)
    return left


def trees(points: DataFrame, dim: int) -> DataFrame:
    """One row a block of vectors, with its kd-tree."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        held: list[np.ndarray] = []

        def tree() -> pa.RecordBatch:
            found = Tree.of(ids, np.concatenate(held)).row()
            return pa.RecordBatch.from_pylist([found], pa.schema([("ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("points", "counts", "sums", "low", "high")]]))

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                own = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)
                if ((own > LARGEST) | (own < -LARGEST)).any():
                    raise ValueError(f"a component lies beyond {LARGEST}")
                ids += part.column(0).to_pylist()
                held.append(own)
                if len(ids) >= BLOCK:
                    yield tree()
                    ids, held = [], []
        if ids:
            yield tree()

    return points.select("vec_id", "v").mapInArrow(made, TREE)


def sums(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, n and the sums of components over all trees: a row a centroid."""
    dim = centroids.shape[1]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
        for batch in batches:
            for i in range(batch.num_rows):
                n, s = Tree.read(batch.slice(i, 1).to_pylist()[0], dim).totals(centroids)
                counts, total = counts + n, total + s
        places = np.arange(len(centroids), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(counts), pa.array(list(total), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    of_tasks = blocks.mapInArrow(made, "cluster int, n long, s array<bigint>")
    return of_tasks.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(dim)]).alias("s"))


def assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""
    dim = centroids.shape[1]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree = Tree.read(batch.slice(i, 1).to_pylist()[0], dim)
                _, of, _ = tree.assign(centroids)
                away = ((tree.points - centroids[of]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(tree.ids, pa.int64()), pa.array(of.astype(np.int32)), pa.array(away)], ["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(made, "vec_id long, cluster int, distance long")


def clusters(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid (its final components) of every whole vector."""
    spark = df.sparkSession
    points = vectors(df, id_col, vector_col, dim, scale)
    centroids = starts(points, k, seed)
    if not len(centroids):
        return points.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid", "array<bigint>"))])
    blocks = runtime.written(trees(points, dim), "kd-trees")
    for _ in range(rounds):
        for r in sums(blocks, centroids).collect():  # k rows
            if r["n"]:
                centroids[r["cluster"]] = [x // r["n"] for x in r["s"]]
    found = runtime.written(assigned(blocks, centroids), "assigned")
    totals = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    rows = [(z, totals.get(z, 0), sum(totals.values()), c.tolist()) for z, c in enumerate(centroids)]
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<bigint>")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # k rows


def digested(found: DataFrame) -> DataFrame:
    """clusters() with the digest of the centroid in place of its components."""
    text = F.array_join(F.transform("centroid", lambda c: c.cast("string")), ",")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(text.cast("binary"), 256).alias("centroid_sha256"))
