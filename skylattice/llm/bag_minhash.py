"""MinHash near-dedup by BagMinHash: weighted signatures, bands, exact multiset overlap, groups.

A document is the multiset of its shingles of five words (lower-cased runs of letters, digits, underscores and non-ASCII). An
element of weight w owns the discretised weights 0 .. w-1, cut into dyadic intervals [0,1), [1,2), [2,4) ...; each interval has a
Poisson process of points, of a rate that is its width times the signature's length, with hashed gaps, signature places and levels;
points at or above w are thinned out. A signature place keeps its earliest point, so two signatures agree at a place with a chance
that is exactly the weighted Jaccard similarity, and points later than any place needs are never made: the cost hardly depends on weights.

BANDS bands of ROWS places make a pair at similarity 0.8 a candidate with a chance of 1 - 3e-6. Candidates are verified on the
shingle multisets of whole texts: overlap (sum of least weights / sum of largest) of 0.8 or more. Groups are connected components.

Defined results: texts with the same words are one item; texts without a word (null as empty among them) are copies if they are
the same text, and near nothing else. Rows that repeat doc_id and text are one document: alike in what they get. class_id is the
least doc_id of the class (null ids come last). An empty table gives an empty result. Other columns pass through dedup(), whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice import runtime
from skylattice.llm import hashing
from skylattice.llm.near_groups import BANDED, banded_rows, candidates, near_groups, numbered, parts_for
from skylattice.llm.rows import with_row

BANDS, ROWS = 24, 4
PLACES = BANDS * ROWS
#: Candidate texts up to this number are fetched with broadcast ids (some 50 bytes each); more of them by a shuffle.
FEW = 1_000_000


def signatures(element: np.ndarray, of: np.ndarray, weight: np.ndarray, texts: int, reach: float = 1.0, places: int = PLACES) -> np.ndarray:
    """The signature of each text (64-bit values): element, of, weight as from hashing.multiset()."""
    total = np.bincount(of, weight, texts)
    limit = reach * (np.log(places) + 5) / np.maximum(total, 1)
    seed, low, width, top, text = [], [], [], [], []
    level = 0
    while len(some := np.flatnonzero(weight > (level and 1 << (level - 1)))):
        seed.append(hashing.mix(element[some] ^ (np.uint64(level + 1) << np.uint64(56))))
        low.append(np.full(len(some), float(level and 1 << (level - 1))))
        width.append(np.full(len(some), float(1 << max(0, level - 1))))
        top.append(weight[some].astype(float))
        text.append(of[some])
        level += 1
    best = np.full(texts * places, np.inf)
    if seed:
        state, low, width, top, text = map(np.concatenate, (seed, low, width, top, text))
        at = np.zeros(len(state))
        while len(state):
            state = hashing.mix(state + np.uint64(hashing.BASE))
            at = at - np.log(((state >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / (places * width)
            on = at < limit[text]
            state, at, low, width, top, text = state[on], at[on], low[on], width[on], top[on], text[on]
            draw = hashing.mix(state ^ np.uint64(0xD6E8FEB86659FD93))
            place = ((draw >> np.uint64(40)) * np.uint64(places) >> np.uint64(24)).astype(np.int64)
            fits = low + width * ((draw & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32) < top
            np.minimum.at(best, (text * places + place)[fits], at[fits])
    best = best.reshape(texts, places)
    unfilled = np.flatnonzero(np.isinf(best).any(1) & (total > 0))
    if len(unfilled):
        some = np.isin(of, unfilled)
        best[unfilled] = signatures(element[some], np.searchsorted(unfilled, of[some]), weight[some], len(unfilled), 4 * reach, places).view(float)
    return best.view(np.uint64)


def keys(texts: list[str | None], hashes: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """A 128-bit key of each text's words, or of the text itself where it has none."""
    ends = np.cumsum(counts)
    data = (hashes[e - n : e].tobytes() if n else b"raw" + (t or "").encode("utf-8", "surrogatepass") for t, e, n in zip(texts, ends, counts))
    return [hashlib.blake2b(x, digest_size=16).digest() for x in data]


def shingle_ids(texts: list[str | None]) -> list[np.ndarray]:
    """The shingles of each text as a set: the second, third ... occurrence of one counts as another, so overlaps of sets are those of multisets."""
    element, of, weight = hashing.multiset(*hashing.word_shingles(*hashing.words(texts)))
    nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    found = hashing.mix(np.repeat(element, weight) + nth.astype(np.uint64) * np.uint64(hashing.BASE)) & hashing.ELEMENT
    edges = np.searchsorted(np.repeat(of, weight), np.arange(len(texts) + 1))
    return [found[a:b] for a, b in zip(edges, edges[1:])]


def sketched(docs: DataFrame) -> DataFrame:
    """row, doc_id, content, key (48 bits of the content's 128), bands (null where the text has no word) of docs(row, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in hashing.slices(whole, 2)):
            texts = batch.column(2).to_pylist()
            hashes, counts = hashing.words(texts)
            element, of, weight = hashing.multiset(*hashing.word_shingles(hashes, counts))
            band = hashing.banded(signatures(element, of, weight, len(texts)), ROWS)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(band.ravel()), mask=pa.array(counts == 0))
            content = keys(texts, hashes, counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(content, pa.binary()), pa.array(np.frombuffer(b"".join(content), np.int64)[::2] & int(hashing.ELEMENT)), lists], names=["row", "doc_id", "content", "key", "bands"])

    return docs.select("row", "doc_id", "text").mapInArrow(run, "row binary, doc_id long, content binary, key long, bands array<long>")


def banded(items: DataFrame) -> DataFrame:
    """near_groups.BANDED rows of sketched items, a written table."""
    parts = parts_for(items.count(), BANDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, at = np.unique(np.asarray(batch.column(0)), return_index=True)
            yield banded_rows(key, np.asarray(batch.column(1).flatten()).reshape(-1, BANDS)[at], parts)

    return items.where("bands is not null").select("key", "bands").mapInArrow(run, BANDED)


def classes(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """row, doc_id, class_id, class_size, kept: one row per row of docs(row, doc_id, text)."""
    items = runtime.written(sketched(docs), "sketches")
    found = runtime.written(candidates(banded(items)), "buckets")
    wanted = found.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    chosen = items.join(wanted, "key", "left_semi").groupBy("content").agg(F.min("row").alias("row"), F.first("key").alias("key"))
    chosen = runtime.written(chosen, "wanted")
    small = runtime.is_under(chosen, FEW)
    texts = docs.select("row", "text").join(F.broadcast(chosen) if small else chosen, "row")
    # rows that repeat give a text several nodes, which near_groups() unites as they share a key
    texts = numbered(texts.select("content", "key", "text"), "texts")
    roots = near_groups(found, texts, shingle_ids, least)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    sized = items.groupBy("content").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    # the group of an item without links is named by its content, any other by its root
    group = texts.groupBy("content").agg(F.min("node").alias("node")).join(roots, "node", "left").select("content", F.concat(F.lit("node "), F.coalesce("root", "node").cast("string")).cast("binary").alias("group"))
    named = runtime.written(sized.join(group, "content", "left").withColumn("group", F.coalesce("group", "content")), "named")
    whole = named.groupBy("group").agg(F.min("first").alias("stays"), F.sum("n").alias("class_size"))
    by_content = named.join(whole, "group").select("content", "stays", "class_size")
    return items.select("row", "doc_id", "content").join(by_content, "content").select("row", "doc_id", F.col("stays.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("stays.row")).alias("kept"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """doc_id, class_id, class_size, kept: one row per document; the kept one of a class has the least doc_id."""
    return classes(with_row(docs, id_col, text_col), least).drop("row")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """The rows of docs that stay, with their own columns: one of each class."""
    rows = with_row(docs, id_col, text_col)
    kept = classes(rows, least).where("kept").select("row")
    stay = rows.join(kept, "row", "left_semi").dropDuplicates(["row"])  # on the same partitioning: no further shuffle
    return stay.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
