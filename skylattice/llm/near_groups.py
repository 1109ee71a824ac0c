"""Groups of near copies from band keys: linear candidates, exact verification, distributed union-find.

A bucket (the items with one band key) is never expanded into its pairs: its members are candidates of its least member only. Each
batch names the least member of its share of a bucket itself and sends that one alone to the bucket; the others are settled. So a
bucket that a third of all items share gets an entry from each batch at most. Entries are dealt into parts by band key and travel packed,
12 bytes each, so that Spark copies a binary value for many of them: band keys keep their 48 high bits, and items have keys of 48 bits.

Candidate pairs are verified on whole sets and united. Where a bucket is then still in several groups, those of its members outside
its largest group (the strays) meet all its members block by block, so that no link is lost. Two blocks are one task's input: parity
sketches of the sets bound each pair's difference from below, pairs that this leaves are compared as whole sets.

Candidates are named by 48-bit keys of their content, and a key that two contents share only means more candidates: nodes of the
verified graph are numbered rows of `texts`, one for each content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice import runtime
from skylattice.llm.hashing import ELEMENT, ELEMENT_BITS, slices

#: Members of a block of a bucket whose groups are compared with one another.
BLOCK = 256
#: Edges of one union-find task.
TASK_EDGES = 1_000_000
#: Pairs of a hot item that go to one salted part.
PART = 256
#: Elements of sets sorted at once, so that they stay in the cache.
SORTED = 1 << 16
#: Entries (a band key and an item's key) of a part of the band keys.
PART_ENTRIES = 1 << 18
#: Schema of banded_rows(): packed entries of one part; head is null where it isn't known yet.
BANDED = "part long, band binary, key binary, head binary"
#: Bits of a band key that don't travel, and bytes of a number that do.
BAND_REST = 16
WIDE = 6

Ids = Callable[[list[str | None]], list[np.ndarray]]


def parts_for(items: int, bands: int) -> int:
    """Parts into which the band keys of so many items are dealt."""
    return max(1, -(-items * bands // PART_ENTRIES))


def heads(band: np.ndarray, key: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries that share their band with a lesser key, and the least key of that band; order: the entries sorted by band."""
    ranked = band[order]
    same = np.concatenate([[False], ranked[1:] == ranked[:-1], [False]])  # as the one before
    shared = np.flatnonzero(same[:-1] | same[1:]) if len(band) else np.zeros(0, np.int64)
    if not len(shared):
        return shared, np.zeros(0, np.int64)
    some, first = order[shared], ~same[shared]
    own = key[some]
    head = np.minimum.reduceat(own, np.flatnonzero(first))[np.cumsum(first) - 1]
    return some[head != own], head[head != own]


def packed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes of values[a:b] as one binary value for each two edges a, b in a row; values: as an array of rows, or structures."""
    width = values.nbytes // max(1, len(values))
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((np.asarray(edges) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.ChunkedArray, kind: np.dtype | str) -> np.ndarray:
    """All values of a column of packed() ones, in order; nulls hold none."""
    return np.frombuffer(b"".join(column.drop_null().to_pylist()), kind)


def narrow(values: np.ndarray) -> np.ndarray:
    """(values, WIDE) bytes of numbers of 48 bits."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDE]


def widened(column: pa.ChunkedArray) -> np.ndarray:
    """The numbers of a column of packed narrow() ones."""
    made = np.zeros((len(few := unpacked(column, np.uint8).reshape(-1, WIDE)), 8), np.uint8)
    made[:, :WIDE] = few
    return made.view("<i8").ravel()


def banded_rows(keys: np.ndarray, bands: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows of BANDED for items with different keys of 48 bits and their (items, bands) band keys.

    The first member of each bucket here travels to the bucket's part, a range of the band keys. The others are settled: they go to all parts alike.
    """
    band, key = bands.ravel().view(np.uint64) >> np.uint64(BAND_REST), np.repeat(keys, bands.shape[1])
    order = np.argsort(band)
    some, head = heads(band, key, order)
    rest = np.ones(len(band), bool)
    rest[some] = False
    left = order[rest[order]]
    part = ((band[left] >> np.uint64(32 - BAND_REST)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    lists = [(part, band[left], key[left], None), (np.arange(len(some)) * parts // max(1, len(some)), band[some], key[some], head)]
    found = []
    for at, *columns in lists:
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        edges = np.append(starts, len(at))
        arrays = [packed(narrow(c), edges) if c is not None else pa.nulls(len(starts), pa.binary()) for c in columns]
        found.append(pa.RecordBatch.from_arrays([pa.array(at[starts]), *arrays], names=["part", "band", "key", "head"]))
    return pa.Table.from_batches(found).combine_chunks().to_batches()[0] if len(band) else found[0]


def bucket_pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """band, a, b: each member a of a bucket of two or more items, and a lesser one, b; table: rows of BANDED of one part."""
    known = pa.compute.is_valid(table.column("head"))
    settled, open_ = table.filter(known), table.filter(pa.compute.invert(known))
    band, key = widened(open_.column("band")), widened(open_.column("key"))
    some, head = heads(band, key, np.argsort(band))
    columns = [(band[some] << BAND_REST, widened(settled.column("band")) << BAND_REST), (key[some], widened(settled.column("key"))), (head, widened(settled.column("head")))]
    return tuple(np.concatenate(c) for c in columns)


def candidates(rows: DataFrame) -> DataFrame:
    """band, a, b of bucket_pairs(); rows: BANDED."""

    def run(table: pa.Table) -> pa.Table:
        return pa.table(dict(zip(("band", "a", "b"), map(pa.array, bucket_pairs(table)))))

    return rows.groupBy("part").applyInArrow(run, "band long, a long, b long")


def forest(edges: DataFrame) -> DataFrame:
    """Union-find within each partition: the same components from at most one edge a node, from a node to the least of its own there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        found = [(x, r) for x in parent if (r := root(x)) != x]
        for i in range(0, len(found), 10_000):
            part = found[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def settled(now: DataFrame) -> bool:
    """True if every node has one edge and no node with an edge is the end of another's."""
    ends = now.select(F.col("a").alias("node"), F.lit(1).alias("starts"), F.lit(0).alias("ends")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("starts"), F.lit(1).alias("ends")))
    return ends.groupBy("node").agg(F.sum("starts").alias("starts"), F.max("ends").alias("ends")).where("starts > 1 OR starts = 1 AND ends = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of edges(a, b), a written table; roots themselves are left out.

    Union-find in tasks of about TASK_EDGES edges each, then large-star and small-star steps between tasks until every node points at its
    root; each step groups with partial aggregation, so a node with many neighbours is no large group. Where one task has seen all
    edges there is nothing left between tasks.
    """
    down = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    tasks = max(1, -(-edges.count() // TASK_EDGES))
    now = runtime.written(forest(edges.coalesce(tasks)), "forest")
    while tasks > 1 and not settled(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = down(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now = runtime.written(down(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))), "stars")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def grown(roots: DataFrame, new: DataFrame) -> DataFrame:
    """roots after further edges; those that hold so far stand for the edges that led to them."""
    return components(new.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def salted_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """node_a, node_b, text_a, text_b of pairs(a, b). b may be in very many pairs: its text is copied to parts of PART pairs."""
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    left = pairs.join(many, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    left = left.join(texts.select(F.col("key").alias("a"), F.col("node").alias("node_a"), F.col("text").alias("text_a")), "a").select("b", "part", "node_a", "text_a")
    right = many.join(texts.select(F.col("key").alias("b"), F.col("node").alias("node_b"), F.col("text").alias("text_b")), "b").select("b", "node_b", "text_b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return left.join(right, ["b", "part"]).select("node_a", "node_b", "text_a", "text_b")


def alike(sets: list[np.ndarray], one: np.ndarray, two: np.ndarray, least: float) -> np.ndarray:
    """For pairs of places in sets (one, two) whether their Jaccard similarity is `least` or more."""
    sizes = np.array([len(x) for x in sets], np.int64)
    small, large = np.minimum(sizes[one], sizes[two]), np.maximum(sizes[one], sizes[two])
    good = np.zeros(len(one), bool)
    open_ = np.flatnonzero(small >= least * large - 1e-9)
    for some in np.array_split(open_, max(1, -(-int((small + large)[open_].sum()) // SORTED))):
        # an element that both sets of a pair hold comes twice with the number of the pair
        both = [x for p in some for x in (sets[one[p]], sets[two[p]])]
        if both:
            pair = np.repeat(np.arange(len(some), dtype=np.uint64), (small + large)[some]) << np.uint64(ELEMENT_BITS)
            every = np.sort(np.concatenate(both).view(np.uint64) & ELEMENT | pair, kind="stable")  # sorted sets are merged
            shared = np.bincount((every[1:][every[1:] == every[:-1]] >> np.uint64(ELEMENT_BITS)).astype(np.int64), minlength=len(some))
            good[some] = shared >= least * (small[some] + large[some] - shared) - 1e-9
    return good


def similar(pairs: DataFrame, texts: DataFrame, ids: Ids, least: float) -> DataFrame:
    """Edges a, b (nodes) of those of pairs(a, b), keys, whose texts' sets have a Jaccard similarity of `least` or more; texts: node, key, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            a, b, text_a, text_b = (c.to_pylist() for c in batch.columns)
            named = dict(zip(a, text_a)) | dict(zip(b, text_b))
            place = {n: i for i, n in enumerate(named)}
            good = alike(ids(list(named.values())), np.array([place[x] for x in a]), np.array([place[x] for x in b]), least) if a else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good))

    return salted_pairs(pairs, texts).mapInArrow(run, "a long, b long")


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 64-bit words for each set: bit i is the parity of its elements that hash to i. As many bits as the largest set has elements, 8,192 at most."""
    sizes = [len(x) for x in sets]
    bits = 1 << min(13, max(8, max(sizes, default=1).bit_length()))
    place = (np.concatenate(sets).view(np.uint64) & np.uint64(bits - 1)).astype(np.int64) + np.repeat(np.arange(len(sets)) * bits, sizes)
    return np.packbits(np.bincount(place, minlength=len(sets) * bits).reshape(len(sets), bits) & 1, axis=1).view(np.uint64)


def links(sets: list[np.ndarray], roots: list[int], strays: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Places (i, j), i a stray, of similar sets in different groups, as few as join the same sets.

    The number of differing parities is at most the number of elements that only one of two sets has, and that is at most
    (1 - least) / (1 + least) of both sizes if they are similar.
    """
    sizes = np.array([len(x) for x in sets])
    sketch = parities(sets)
    group = {r: r for r in roots}
    found = []

    def top(r: int) -> int:
        while group[r] != r:
            group[r] = group[group[r]]
            r = group[r]
        return r

    for i in np.flatnonzero(strays).tolist():
        apart = np.bitwise_count(sketch ^ sketch[i]).sum(1)
        most = (1 - least) / (1 + least) * (sizes + sizes[i]) + 1e-9
        for j in np.flatnonzero((apart <= most) & (np.abs(sizes - sizes[i]) <= most)).tolist():
            if (a := top(roots[i])) != (b := top(roots[j])):
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if shared >= least * (sizes[i] + sizes[j] - shared) - 1e-9:
                    group[a] = b
                    found.append((i, j))
    return found


def unsettled(found: DataFrame, pairs: DataFrame, texts: DataFrame, roots: DataFrame) -> DataFrame:
    """band, node, root, stray of the members of buckets of three and more that lie in two or more groups; a stray isn't of the bucket's largest group."""
    # written, as three joins read it: each plan stays short, for the driver too
    nodes = runtime.written(texts.join(roots, "node", "left").select("node", "key", F.coalesce("root", "node").alias("root")), "nodes")
    a, b = (nodes.select(F.col("key").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    failed = pairs.join(a, "a").join(b, "b").where("root_a <> root_b").select("a", "b").distinct()
    ordered = found.select("band", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    bands = ordered.join(failed.withColumn("failed", F.lit(1)), ["a", "b"], "left").groupBy("band").agg(F.max("failed").alias("failed"), F.count("*").alias("n")).where("failed = 1 AND n > 1")
    rows = runtime.written(ordered.join(bands.select("band"), "band", "left_semi"), "unsettled")
    members = rows.select("band", F.col("a").alias("key")).unionByName(rows.select("band", F.col("b").alias("key"))).distinct()
    members = runtime.written(members.join(nodes, "key").select("band", "node", "root"), "members")
    counts = members.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("groups"))
    return members.join(counts.where("groups > 1"), "band").select("band", "node", "root", (F.col("root") != F.col("main")).alias("stray"))


def across(left: DataFrame, texts: DataFrame, ids: Ids, least: float, block: int) -> DataFrame:
    """a, b: links between the groups of each bucket, as few as join the same groups; left: unsettled(), a written table.

    The strays of a bucket are dealt into blocks of about `block`, and so are all its members; a block of strays meets each block of
    members in one task, which compares whole sets. Pairs are neither rows nor shuffled: a member goes to as many places as its
    bucket has blocks of strays, a stray also to each block of members.
    """
    sized = runtime.written(left.join(left.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.col("stray").cast("int")).alias("strays")), "band"), "sized")
    # the same few items often share several buckets: each set of up to `block` members is compared once, many such sets in a task
    few = sized.where(F.col("n") <= block).groupBy("band").agg(F.sort_array(F.collect_list(F.struct("node", "root", "stray"))).alias("members"))
    tasks = max(1, left.count() // (16 * block))
    few = few.select("members").distinct().select(F.xxhash64("members").alias("bucket"), F.explode("members").alias("m"))
    few = few.select(F.pmod("bucket", F.lit(tasks)).alias("task"), "bucket", "m.node", "m.root", "m.stray")
    many = sized.where(F.col("n") > block).withColumn("ones", F.ceil(F.col("strays") / block).cast("int")).withColumn("twos", F.ceil(F.col("n") / block).cast("int"))
    many = many.withColumn("own_one", F.pmod(F.xxhash64("node"), F.col("ones")).cast("int")).withColumn("own_two", F.pmod(F.xxhash64("node"), F.col("twos")).cast("int"))
    member = many.select("band", F.explode(F.sequence(F.lit(0), F.col("ones") - 1)).alias("one"), F.col("own_two").alias("two"), "node", "root", F.lit(False).alias("stray"))
    stray = many.where("stray").select("band", F.col("own_one").alias("one"), F.explode(F.sequence(F.lit(0), F.col("twos") - 1)).alias("two"), "node", "root", F.lit(True).alias("stray"))
    met = member.unionByName(stray).select(F.xxhash64("band", "one", "two").alias("task"), F.xxhash64("band", "one", "two").alias("bucket"), "node", "root", "stray")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")
        node, root, stray = (np.asarray(table.column(c)) for c in ("node", "root", "stray"))
        text = dict(zip(node.tolist(), table.column("text").to_pylist()))
        sets = dict(zip(text, ids(list(text.values()))))
        edges = np.flatnonzero(np.diff(np.asarray(table.column("bucket")))) + 1
        found = []
        for at in np.split(np.arange(len(node)), edges):
            here = node[at].tolist()
            found += [(here[i], here[j]) for i, j in links([sets[x] for x in here], root[at].tolist(), stray[at], least)]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return few.unionByName(met).join(texts.select("node", "text"), "node").groupBy("task").applyInArrow(run, "a long, b long")


def near_groups(found: DataFrame, texts: DataFrame, ids: Ids, least: float, block: int = BLOCK) -> DataFrame:
    """node, root of all items with a verified link.

    found: candidates(); texts: node, key, text of every item whose key is in found; both written. ids: texts -> the set of each as distinct numbers of ELEMENT_BITS bits.
    """
    pairs = runtime.written(found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    # contents that share a key are candidates of one another
    same = texts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("a"), F.col("key").alias("b"))
    roots = components(runtime.written(similar(pairs.unionByName(same), texts, ids, least).where("a <> b"), "edges"))
    left = runtime.written(unsettled(found, pairs, texts, roots), "left")
    if not left.isEmpty():
        roots = grown(roots, runtime.written(across(left, texts, ids, least, block), "edges"))
    return roots


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows with `node`, a number of each, as a written table."""
    return runtime.written(rows.withColumn("node", F.monotonically_increasing_id()), name)
