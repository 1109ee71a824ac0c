"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: each slot holds a mask with a bit for each language. An n-gram's masks, and-ed
over its slots, tell at once which languages contain it. A text's n-grams are looked up and counted for each language (popcounts),
the counts are corrected for the slice's share of false positives, and the largest wins.

The filters hold each language's byte n-grams (those that it only quotes left out), counted over the whole texts of about SAMPLE
training documents a language: a documented bound of the fit alone, so the filter's size never grows with the input.

Defined results: `und` with score 0 if the text is null or has no letter, or if nothing was learned; ties go to the language that
sorts first. Repeated rows get the same result; an empty table gives an empty result. Languages beyond 64 are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice import runtime
from skylattice.llm.learning import class_counts, held_out, sampled_ids

SAMPLE = 3000
#: A language contains an n-gram if the n-gram's share there is within this factor of its largest share: texts quote other languages.
LEAST = 2.0
#: Slots of the filter, as a power of two, and slots an n-gram takes. An n-gram has four bytes.
SLOT_BITS = 20
HASHES = 3
#: Odd multipliers of the slot hashes.
FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
#: Language and n-gram columns of the counts.
COUNTS = "lang string, gram long, n long"


def slots(grams: np.ndarray) -> list[np.ndarray]:
    """The filter slots of each n-gram."""
    return [((grams ^ (grams >> np.uint32(15))) * np.uint32(f)) >> np.uint32(32 - SLOT_BITS) for f in FACTORS[:HASHES]]


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte 4-grams of the lower-cased texts as uint32, the first of each text, and whether each text has a letter.

    Characters that are no letters count as spaces, and each text has one before and three after it.
    """
    low = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\pL\pM]+", " ")
    front, back, glue = (pa.scalar(x, pa.large_string()) for x in (" ", "   ", ""))
    framed = pc.binary_join_element_wise(front, low, back, glue)
    letter = np.asarray(pc.match_substring_regex(low, r"\pL"))
    ends = np.frombuffer(framed.buffers()[1], np.int64)[framed.offset : framed.offset + len(framed) + 1]
    data = np.frombuffer(framed.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.uint32)
    starts = ends - ends[0]
    if len(data) < 4:
        return np.zeros(0, np.uint32), starts, letter
    found = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)
    return found, starts, letter


def spans(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last n-gram that lies within each text."""
    return starts[:-1], np.maximum(starts[:-1], starts[1:] - 3)


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, n over docs(text, lang), added up batch by batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.asarray(batch.column(1).to_pylist(), object)
            for one in dict.fromkeys(lang):
                found, starts, _ = grams(batch.column(0).filter(pa.array(lang == one)))
                across = (starts[1:-1, None] - np.arange(1, 4)).ravel()  # from the end of one text into the next
                values, n = np.unique(np.delete(found, across), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([one] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return docs.select("text", "lang").mapInArrow(run, COUNTS)


@dataclass
class Filters:
    """The learned filter: languages, masks by slot, and each language's share of false positives."""

    langs: list[str]
    masks: np.ndarray
    false: np.ndarray

    @staticmethod
    def of(langs: list[str], masks: np.ndarray) -> Filters:
        share = [float(((masks >> np.uint64(i)) & np.uint64(1)).mean()) for i in range(len(langs))]
        return Filters(langs, masks, np.array(share) ** HASHES)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        found, starts, letter = grams(texts)
        masks = np.full(len(found), ~np.uint64(0))
        for at in slots(found):
            masks &= self.masks[at]
        first, last = spans(starts)
        hits = np.empty((len(texts), len(self.langs)))
        for i in range(len(self.langs)):
            sums = np.concatenate([[0], np.cumsum((masks >> np.uint64(i)) & np.uint64(1), dtype=np.int64)])
            hits[:, i] = sums[last] - sums[first] if len(found) else 0
        total = (last - first)[:, None]
        real = np.maximum(0, hits - total * self.false) / (1 - self.false)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = real.argmax(1)
        share = real[np.arange(len(texts)), best] / np.maximum(real.sum(1), 1e-9)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, letter)], np.where(letter, np.clip(share, 0, 1), 0)


def learn(docs: DataFrame, sample: int = SAMPLE) -> Filters:
    """docs: doc_id, text, lang of the documents that may be learned from."""
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    known = class_counts(usable, "lang")
    ids = F.broadcast(sampled_ids(usable, "doc_id", "lang", known, sample).select("doc_id").distinct())  # some 64 x sample ids at most
    counts = runtime.written(count_grams(usable.join(ids, "doc_id", "left_semi")).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    counts = counts.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total"))
    largest = counts.groupBy("gram").agg(F.max("share").alias("largest"))
    kept = counts.join(largest, "gram").where(F.col("share") * LEAST >= F.col("largest")).select("lang", "gram")
    langs = sorted(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = {lang: np.uint64(1 << i) for i, lang in enumerate(langs)}
        for batch in batches:
            mask = np.array([bit[x] for x in batch.column(0).to_pylist()], np.uint64).view(np.int64)
            for at in slots(np.asarray(batch.column(1)).astype(np.uint32)):
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(mask)], names=["slot", "mask"])

    # one row for each slot of the filter at most
    held = kept.mapInArrow(run, "slot int, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    masks = np.zeros(1 << SLOT_BITS, np.uint64)
    masks[held.column("slot").to_numpy()] = held.column("mask").to_numpy().view(np.uint64)
    return Filters.of(langs, masks)


def predicted(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred, score of docs(doc_id, text, held_out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score = filters.predict(batch.column(1)) if batch.num_rows else ([], np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, rest: int = 2) -> DataFrame:
    """Learn from the documents outside the held-out fold, then predict every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.col("lang").alias("lang"), held_out("doc_id", folds, rest).alias("held_out"))
    return predicted(rows, learn(rows.where(~F.col("held_out"))))
