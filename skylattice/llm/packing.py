"""Best-fit packing by patterns: length patterns, repeat counts by non-negative least squares, residuals best-fit.

Only the histogram of piece lengths (at most `most` bins, whatever the input) reaches the driver. There, patterns of any number of
lengths that fill FULL of a sequence are enumerated, their repeat counts are fitted to the histogram by non-negative least
squares, rounded down and cut to what there is; what remains goes best-fit into sequences by length, again on counts alone. Where
best-fit alone needs fewer sequences, its plan is taken. The outcome is, for each length, a short list of runs: so many pieces of
that length, dealt to so many successive sequences, from one offset on. A piece finds its run by its rank among the pieces of its length. Ranks are counted in
salted parts of about PART pieces (so a length that a third of all pieces share is no hot group) and offset by the parts' sizes.

Defined results: null and empty texts are one piece with the end id alone. Repeated rows are packed each on its own. An empty
table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import bisect
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skylattice import runtime
from skylattice.llm.piece_tokens import SEQUENCE, pieces

#: Pieces of a salted part of a length, and the patterns offered to the fit for each length.
PART = 200_000
PATTERNS_OF_A_LENGTH = 6
#: Share of a sequence that a pattern fills to be offered to the fit.
FULL = 0.99


def patterns(counts: dict[int, int], most: int) -> list[tuple[int, ...]]:
    """Patterns of present lengths, repeats included, that fill at least FULL of a sequence, a few for each longest length; lengths fall within a pattern."""
    lengths = sorted(counts, reverse=True)
    found: set[tuple[int, ...]] = set()

    def fitting(room: int) -> int:
        """The place of the longest length that fits."""
        return bisect.bisect_left(lengths, -room, key=lambda n: -n)

    def offer(starts: dict[int, int]) -> None:
        """The pattern of these lengths and repeats, filled up with the longest lengths that fit, if it gets full."""
        held = Counter(starts)
        room = most - sum(n * k for n, k in starts.items())
        while room and (at := fitting(room)) < len(lengths) and (k := min(room // lengths[at], counts[lengths[at]] - held[lengths[at]])) > 0:
            held[lengths[at]] += k
            room -= lengths[at] * k
        if room <= (1 - FULL) * most:
            found.add(tuple(sorted(held.elements(), reverse=True)))

    for a in lengths:
        whole = min(most // a, counts[a])
        for k in sorted({1, 2, whole // 2, whole - 1, whole} & set(range(1, whole + 1))):
            room = most - a * k
            fits = lengths[fitting(min(room, a - 1)) :]
            offer({a: k})
            for b in [*fits[:PATTERNS_OF_A_LENGTH], *fits[:: max(1, len(fits) // PATTERNS_OF_A_LENGTH)]]:
                offer({a: k, b: 1})
    return sorted(found, reverse=True)


def fitted(chosen: list[tuple[int, ...]], counts: dict[int, int], rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|^2, A[length, pattern] the pieces of a length in a pattern (projected, accelerated gradient steps; A is sparse)."""
    row = {n: i for i, n in enumerate(sorted(counts))}
    want = np.array([counts[n] for n in sorted(counts)], float)
    held = [(row[n], j, k) for j, p in enumerate(chosen) for n, k in Counter(p).items()]
    at, of, times = (np.array(c) for c in zip(*held))
    apply = lambda x: np.bincount(at, times * x[of], len(want))
    back = lambda y: np.bincount(of, times * y[at], len(chosen))
    probe = np.ones(len(chosen))
    for _ in range(30):
        probe = back(apply(probe))
        probe /= np.linalg.norm(probe)
    step = 1 / (1.05 * np.linalg.norm(back(apply(probe))))
    x = y = np.zeros(len(chosen))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(apply(y) - want))
        later = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / later * (new - x), new, later
    return x


def best_fit(left: dict[int, int], most: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and their repeats, which use every piece of left: the longest that is left, then whatever fits best, as often as there are such pieces."""
    left, laid = dict(left), []
    rest = sorted((n for n, c in left.items() if c), reverse=True)
    while rest:
        taken: dict[int, int] = {}
        room = most
        for n in rest:
            if k := min(room // n, left[n]):
                taken[n] = k
                room -= n * k
        times = min(left[n] // k for n, k in taken.items())
        laid.append((tuple(n for n, k in taken.items() for _ in range(k)), times))
        for n, k in taken.items():
            left[n] -= k * times
        rest = [n for n in rest if left[n]]
    return laid


def by_patterns(left: dict[int, int], most: int) -> list[tuple[tuple[int, ...], int]]:
    """Full patterns as often as the fit says, then best-fit."""
    left, laid = dict(left), []
    if left and (chosen := patterns(left, most)):
        repeats = np.floor(fitted(chosen, left) + 1e-6).astype(int)
        for j in sorted(range(len(chosen)), key=lambda j: (most - sum(chosen[j]), j)):
            need = Counter(chosen[j])
            if (times := min(int(repeats[j]), *(left[n] // k for n, k in need.items()))) > 0:
                laid.append((chosen[j], times))
                for n, k in need.items():
                    left[n] -= k * times
    return laid + best_fit(left, most)


def runs(counts: dict[int, int], most: int = SEQUENCE) -> dict[int, list[tuple[int, int, range, int]]]:
    """For each length its runs (first rank, number, sequences, offset), which use every piece once.

    The pieces of a run are dealt to its sequences in turn; where there are more of them, they follow one another from the offset on.
    """
    used: dict[int, int] = defaultdict(int)
    found: dict[int, list[tuple[int, int, range, int]]] = defaultdict(list)
    partial = {n: c for n, c in counts.items() if c and n < most}
    laid = [((n,), c) for n, c in counts.items() if c and n >= most]
    laid += min(by_patterns(partial, most), best_fit(partial, most), key=lambda plan: sum(times for _, times in plan))
    sequence = 0
    for pattern, times in laid:
        offset = 0
        for n, k in sorted(Counter(pattern).items(), reverse=True):
            found[n].append((used[n], k * times, range(sequence, sequence + times), offset))
            used[n] += k * times
            offset += n * k
        sequence += times
    return found


def packed(made: DataFrame, most: int = SEQUENCE) -> DataFrame:
    """made's rows (with a column length) and their sequence_id and offset. made is read three times: pass a written table."""
    spark = made.sparkSession
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    parts = F.lit([-(-counts.get(n, 1) // PART) for n in range(most + 1)])
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(parts, F.col("length").cast("int"))).cast("int")
    sizes = made.groupBy("length", part.alias("part")).count()
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("from"))
    laid = [(n, first, sequences.start, len(sequences), offset) for n, rs in runs(counts, most).items() for first, _, sequences, offset in rs]
    plan = spark.createDataFrame(laid, "length long, first long, sequence long, sequences long, offset long")
    plan = plan.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "sequence", "sequences", "offset"))).alias("runs"))
    ranked = made.withColumn("part", part).withColumn("row", F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "piece")))
    ranked = ranked.join(F.broadcast(starts), ["length", "part"]).withColumn("rank", F.col("from") + F.col("row") - 1).drop("part", "row", "from")
    found = ranked.join(F.broadcast(plan), "length").withColumn("run", last_run()).withColumn("nth", F.col("rank") - F.col("run.first"))
    return found.select(*made.columns, F.expr("run.sequence + nth % run.sequences").alias("sequence_id"), F.expr("run.offset + nth div run.sequences * length").alias("offset"))


def last_run():
    """Of the sorted runs of a length the last one that starts at the rank or before: a binary search in 17 steps."""
    low = F.aggregate(
        F.array(*[F.lit(1 << s) for s in range(16, -1, -1)]),
        F.lit(1),
        lambda at, jump: F.when((at + jump <= F.size("runs")) & (F.get("runs", at + jump - 1)["first"] <= F.col("rank")), at + jump).otherwise(at),
    )
    return F.element_at("runs", low)


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", most: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of every document."""
    return packed(runtime.written(pieces(docs, vocabulary, id_col, text_col, most), "pieces"), most)
