"""Periodic runs of words by an all-lag vectorised scan, and texts without the repeats.

A run is a stretch of consecutive words with smallest period q that holds at least `min_exp` periods and `min_len` words and that no
neighbouring word extends. The array of word ids is compared with itself shifted by every lag up to n / min_exp; stretches that are
true throughout are runs. Many texts are scanned as one array (ids of different texts never agree). As a stretch of a lag q is at
least (min_exp - 1) q long, it is first looked for at every eighth of that length, and measured exactly where all samples agree: the
work of a lag falls as 1 / q and no run can be missed. A stretch inside a run of a period that divides the lag is that run again.

Texts of at most min_exp x LAGS words are scanned where they are read. For longer ones Spark deals out (text, range of LAGS lags)
over the machines; the runs of the first range travel along, so that multiples of short periods are skipped. The runs of a text come
together by its number; a text of n words has less than n of them.

Defined results: null text has no word, no run and an empty collapsed text. Rows that repeat an id or a text are done each on its
own. Ids may be null. Extra columns are not read. An empty table gives an empty result. Words are what white space of ASCII parts;
other letters, invalid ones too, are kept as bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice import runtime
from skylattice.llm.hashing import slices

#: Lags of a range: so many shifts of one text are one piece of work.
LAGS = 2048
#: Samples of the shortest stretch of a lag.
SAMPLES = 8
WORD = r"[^\x20\x09-\x0D]+"
RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"
FOUND = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def split(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """A number for every word of all texts, words of each text, and the words."""
    words = [(t or b"").split() for t in texts]
    flat = pa.array([w for ws in words for w in ws], pa.large_binary())
    ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
    return ids, np.array([len(ws) for ws in words], np.int64), words


def all_true(same: np.ndarray, k: int) -> np.ndarray:
    """Where k neighbours in a row are true."""
    have = 1
    while have < k and len(same):
        step = min(have, k - have)
        same = same[:-step] & same[step:]
        have += step
    return same


def reach(x: np.ndarray, lag: int, at: int, way: int) -> int:
    """The last place from `at` onwards (way 1) or backwards (way -1) up to which every word agrees with the one a lag later."""
    size, last = 64, len(x) - lag
    while True:
        a, b = (at, min(last, at + size)) if way > 0 else (max(0, at - size), at)
        differ = np.flatnonzero(x[a:b] != x[a + lag : b + lag])
        if len(differ):
            return a + int(differ[0]) if way > 0 else a + int(differ[-1]) + 1
        at, size = (b, size * 2) if way > 0 else (a, size * 2)
        if at in (0, last):
            return at


def primes(n: int) -> list[int]:
    """The different prime divisors of n."""
    found, d = [], 2
    while d * d <= n:
        if n % d == 0:
            found.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return found + [n] if n > 1 else found


class Known:
    """Stretches of one text whose smaller period is known: start, end, period."""

    def __init__(self, runs: list[tuple[int, int, int]] = ()) -> None:
        self.all = list(runs)
        self.arrays: tuple[np.ndarray, ...] | None = None

    def add(self, start: int, end: int, period: int) -> None:
        self.all.append((start, end, period))
        self.arrays = None

    def holds(self, at: np.ndarray, lag: int, length: int) -> np.ndarray:
        """True for places whose next `length` words lie in a stretch with a period that divides the lag."""
        if not self.all:
            return np.zeros(len(at), bool)
        if self.arrays is None:
            self.arrays = tuple(np.array(sorted(self.all), np.int64).T)
        start, end, period = self.arrays
        fits = lag % period == 0
        if not fits.any():
            return np.zeros(len(at), bool)
        start, end = start[fits], np.maximum.accumulate(end[fits])
        of = np.searchsorted(start, at, "right") - 1
        return (of >= 0) & (end[of] >= at + length)


def scan(ids: np.ndarray, counts: np.ndarray, known: list[Known], lags: tuple[int, int], min_exp: int, min_len: int) -> list[list[tuple[int, int, int]]]:
    """start, length, period of the runs of each text whose period is one of the lags; known grows."""
    order = np.argsort(-counts, kind="stable")
    edges = np.concatenate([[0], np.cumsum(counts[order])])
    begins = np.concatenate([[0], np.cumsum(counts)])
    x = ids[np.repeat(begins[order] - edges[:-1], counts[order]) + np.arange(edges[-1])]
    x = x + np.repeat(np.arange(len(counts), dtype=np.int64), counts[order]) * (int(ids.max(initial=0)) + 1)
    falling, found = -counts[order], [[] for _ in counts]
    for lag in range(lags[0], min(lags[1], int(counts.max(initial=0)) // min_exp) + 1):
        texts = int(np.searchsorted(falling, -max(min_len, min_exp * lag), "right"))
        if not texts:
            break
        end, least = int(edges[texts]), max(min_len - lag, (min_exp - 1) * lag)
        step = max(1, least // SAMPLES)
        places = np.flatnonzero(all_true(x[: end - lag : step] == x[lag:end:step], least // step)) * step
        if not len(places):
            continue
        owner = np.searchsorted(edges, places, "right") - 1
        for o in np.unique(owner):
            base, text = int(edges[o]), int(order[o])
            own, at = x[base : edges[o + 1]], places[owner == o] - base
            done = 0
            # the samples from a place on span this much: a stretch and its first period
            for p in at[~known[text].holds(at, lag, (least // step - 1) * step + 1 + lag)]:
                if p < done:
                    continue
                start, done = reach(own, lag, int(p), -1), reach(own, lag, int(p), 1)
                if done - start < least:
                    continue
                stop, period = done + lag, lag
                for r in primes(lag):
                    if np.array_equal(own[start : stop - lag // r], own[start + lag // r : stop]):
                        period = lag // r
                if period == lag:
                    found[text].append((start, stop - start, lag))
                known[text].add(start, stop, period)
    return found


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join(w for w, n in zip(words, np.cumsum(change)) if not n)


def as_struct(runs: list[tuple[int, int, int]]) -> list[dict[str, int]]:
    return [dict(zip(("start", "length", "period"), r)) for r in sorted(runs, key=lambda r: (r[0], r[2]))]


def as_tuples(runs: list[dict[str, int]] | None) -> list[tuple[int, int, int]]:
    return [(r["start"], r["length"], r["period"]) for r in runs or []]


def short_texts(docs: DataFrame, min_exp: int, min_len: int) -> DataFrame:
    """docs(doc_id, text as bytes), scanned many at once over all their lags."""

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, 1, 1 << 22)):
            ids, counts, words = split(batch.column(1).to_pylist())
            runs = scan(ids, counts, [Known() for _ in words], (1, int(counts.max(initial=0))), min_exp, min_len)
            texts = [collapse(ws, rs) for ws, rs in zip(words, runs)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array([as_struct(r) for r in runs], FOUND), pa.array(texts, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"]
            )

    return docs.mapInArrow(done, f"doc_id long, n_words long, runs {RUN}, collapsed binary")


def ranged(texts: DataFrame, min_exp: int, min_len: int) -> DataFrame:
    """texts(text_no, text, known, low, high): text_no and the runs of each whose period lies in its range of lags."""

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, counts, _ = split([row["text"]])
                known = Known([(s, s + n, p) for s, n, p in as_tuples(row["known"])])
                runs = scan(ids, counts, [known], (row["low"], row["high"]), min_exp, min_len)[0]
                yield pa.RecordBatch.from_arrays([pa.array([row["text_no"]], pa.int64()), pa.array([as_struct(runs)], FOUND)], ["text_no", "runs"])

    return texts.select("text_no", "text", "known", "low", "high").mapInArrow(done, f"text_no long, runs {RUN}")


def collapsed(texts: DataFrame) -> DataFrame:
    """texts(doc_id, n_words, runs, text) with the text collapsed."""

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [collapse((t or b"").split(), as_tuples(r)) for t, r in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

    return texts.select("doc_id", "n_words", "runs", "text").mapInArrow(done, f"doc_id long, n_words long, runs {RUN}, collapsed binary")


def long_texts(docs: DataFrame, min_exp: int, min_len: int, lags: int) -> DataFrame:
    """As short_texts, for docs(doc_id, n_words, text) whose lags are dealt out in ranges."""
    none = F.array().cast(RUN)
    whole = runtime.written(docs.withColumn("text_no", F.monotonically_increasing_id()), "long-texts")
    one = whole.select("text_no", "text", none.alias("known"), F.lit(1).alias("low"), F.lit(lags).alias("high"))
    first = runtime.written(ranged(one.repartition("text_no"), min_exp, min_len).withColumnRenamed("runs", "known"), "first-lags")
    low = F.explode(F.sequence(F.lit(lags + 1).cast("long"), F.greatest(F.floor(F.col("n_words") / min_exp), F.lit(lags + 1)), F.lit(lags).cast("long"))).alias("low")
    pieces = whole.join(first, "text_no").select("text_no", "text", "known", low).withColumn("high", F.col("low") + lags - 1)
    rest = ranged(pieces.repartition("text_no", "low"), min_exp, min_len)
    runs = first.withColumnRenamed("known", "runs").unionByName(rest).groupBy("text_no").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"))
    by_place = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"]).cast("int")
    return collapsed(whole.join(runs, "text_no").withColumn("runs", F.array_sort("runs", by_place)))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_exp: int = 3, min_len: int = 24, lags: int = LAGS) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed, the text without the repeats: one row per row of docs.

    min_exp (2 or more) and min_len: periods and words that a run holds at least. lags: what one piece of work compares of a long text.
    """
    if min_exp < 2:
        raise ValueError("a run holds two periods at least")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    words, raw = F.regexp_count("text", F.lit(WORD)), F.col("text").cast("binary").alias("text")
    # a word and the space after it are two bytes at least, so most texts are known to be short without counting
    few = F.when(F.octet_length("text") < 2 * min_exp * lags, True).otherwise(F.coalesce(words <= min_exp * lags, F.lit(True)))
    here = short_texts(rows.where(few).select("doc_id", raw), min_exp, min_len)
    there = long_texts(rows.where(~few).select("doc_id", words.cast("long").alias("n_words"), raw), min_exp, min_len, lags)
    return here.unionByName(there).withColumn("collapsed", F.col("collapsed").cast("string"))


def with_planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where of one in ten documents (by the CRC-32 of the id) the words from a place on repeat a part of them."""
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = (text or b"").split()
                if words:
                    a = g % len(words)
                    p = 1 + (len(words) - a) // (3 + g % 8)
                    words = words[:a] + (words[a : a + p] * (len(words) // p + 1))[: len(words) - a]
                made.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["doc_id", "text"])

    chosen = F.coalesce(hashed % 10 == 0, F.lit(False))
    some = docs.where(chosen).select("doc_id", F.col("text").cast("binary"), F.floor(hashed / 10).alias("g"))
    done = some.mapInArrow(planted, "doc_id long, text binary").select("doc_id", F.col("text").cast("string"))
    return docs.where(~chosen).select(F.col("doc_id").cast("long"), "text").unionByName(done)


def digested(found: DataFrame) -> DataFrame:
    """Counts, the run with the greatest exponent and digests of periodic_runs()."""
    kind = "struct<start: bigint, length: bigint, period: bigint>"

    def better(a: Column, b: Column) -> Column:
        """b if its exponent is greater; in order of start and period the first one wins."""
        return F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)

    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    best = found.select("doc_id", "n_words", "runs", "collapsed", F.aggregate("runs", F.lit(None).cast(kind), better).alias("best"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}") for c in ("start", "length", "period")],
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
