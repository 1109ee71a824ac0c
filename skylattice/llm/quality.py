"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is described by the shares of its words that hash to each of WORDS
buckets, by shares of kinds of characters and by how much its words repeat, and encoded by a small tanh layer; gated attention (tanh times sigmoid) weighs the passages, and the weighted mean
of their codes is scored. Labels are of documents alone: the attention learns which passages decide.

It is fitted on about SAMPLE labelled documents of each label, and on FITTED passages of each at most, spread evenly over its text (bounds
of the fit alone); Spark describes these passages, and only the numbers reach the driver. Scoring reads all passages of whole texts.

Defined results: a null text, or one without a word, scores 0 (there is no passage to judge). Labels other than 0 and 1 and null
ids are not learned from; with fewer than two kinds of label every document that has words scores the label that there is, or 1.
A label that a document has several times counts once, and of rows that repeat an id one text is learned from; each such row is
scored. Very long texts are scored whole. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.learning import fold, held_out, sampled_texts
from skylattice.llm.memo import Memo

SAMPLE = 4000
FITTED = 32
PASSAGE = 64
#: Buckets of hashed words.
WORDS = 128
CODE, GATE = 12, 8
#: Kinds of bytes whose shares describe a passage.
KINDS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"-()", b"!", b"|", b"#$%&*", b"<>[]{}=/\\~^_+@`", bytes(range(128, 256)), b" ")
FACTS = len(KINDS) + 4 + WORDS
TABLE = np.zeros((256, len(KINDS)), np.float32)
for _i, _kind in enumerate(KINDS):
    TABLE[list(_kind), _i] = 1


def bucket(word: str) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORDS


def passages(text: str | None, buckets: dict[str, int], most: int = 0) -> np.ndarray:
    """A row of facts for each passage, or for `most` of them; buckets: a memo of bucket()."""
    split = text.split() if text else []
    starts = list(range(0, len(split), PASSAGE))
    if 0 < most < len(starts):
        starts = [starts[i * len(starts) // most] for i in range(most)]
    if not starts:
        return np.zeros((0, FACTS), np.float32)
    shares, facts = np.empty((len(starts), 256)), np.empty((len(starts), 4), np.float32)
    words = np.zeros((len(starts), WORDS), np.float32)
    for i, a in enumerate(starts):
        part = split[a : a + PASSAGE]
        data = " ".join(part).encode("utf-8", "surrogatepass")
        n = len(part)
        shares[i] = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data)
        words[i] = np.bincount([buckets[w] for w in part], minlength=WORDS) / n
        facts[i] = len(set(part)) / n, sum(map(eq, part, part[1:])) / n, min(2.0, len(data) / n / 10), n / PASSAGE
    return np.concatenate([shares.astype(np.float32) @ TABLE, facts, words], axis=1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Attention:
    """Mean and scale of the facts, encoder, gated attention, and output weights, by name."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, facts: np.ndarray, starts: np.ndarray, of: np.ndarray) -> dict[str, np.ndarray]:
        """facts: passages of several documents; starts: the first of each; of: the document of each."""
        p, x = self.p, (facts - self.mean) / self.scale
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
        e = (t * s) @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[of])
        weight = e / np.add.reduceat(e, starts)[of]
        z = np.add.reduceat(weight[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "s": s, "weight": weight, "z": z, "y": sigmoid(z @ p["c"] + p["d"])}

    def back(self, f: dict[str, np.ndarray], of: np.ndarray, starts: np.ndarray, label: np.ndarray, share: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the logistic loss, with a weight for each document."""
        p, error = self.p, (f["y"] - label) * share
        dz = error[:, None] * p["c"]
        da = (dz[of] * f["h"]).sum(1)
        de = f["weight"] * (da - np.add.reduceat(f["weight"] * da, starts)[of])
        dt, ds = de[:, None] * p["a"] * f["s"] * (1 - f["t"] ** 2), de[:, None] * p["a"] * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["weight"][:, None] * dz[of] + dt @ p["v"].T + ds @ p["u"].T) * (1 - f["h"] ** 2)
        return {"w": f["x"].T @ dh, "b": dh.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ ds, "a": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ error, "d": error.sum(keepdims=True)}

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(b) for b in bags], np.int64)
        out, there = np.zeros(len(bags)), np.flatnonzero(sizes)
        if len(there):
            n = sizes[there]
            out[there] = self.forward(np.concatenate([bags[i] for i in there]), np.cumsum(n) - n, np.repeat(np.arange(len(n)), n))["y"]
        return out


def spread(every: np.ndarray, most: int = 16) -> np.ndarray:
    """Standard deviations of the columns, a few at once, so that no second table of all values is made."""
    return np.concatenate([every[:, a : a + most].std(0) for a in range(0, every.shape[1], most)])


def fit(bags: list[np.ndarray], labels: np.ndarray, **how: float) -> Attention:
    """fit_table() of the passages of each document."""
    return fit_table(np.concatenate(bags), np.array([len(b) for b in bags]), labels, **how)


def fit_table(every: np.ndarray, sizes: np.ndarray, labels: np.ndarray, epochs: int = 25, size: int = 128, rate: float = 0.01, decay: float = 1e-4) -> Attention:
    """Adam over shuffled mini-batches; both labels weigh the same, so 0.7 asks for clear evidence of quality. every: the passages of one document after another; sizes: their numbers."""
    random = np.random.default_rng(7)
    bags = np.split(every, np.cumsum(sizes)[:-1])
    shape = {"w": (FACTS, CODE), "b": (CODE,), "v": (CODE, GATE), "u": (CODE, GATE), "a": (GATE,), "c": (CODE,), "d": (1,)}
    model = Attention(every.mean(0), spread(every) + 1e-3, {k: random.normal(0, 0.3, s) for k, s in shape.items()})
    one, two, step = {k: np.zeros(s) for k, s in shape.items()}, {k: np.zeros(s) for k, s in shape.items()}, 0
    good = labels.mean()
    if good in (0.0, 1.0):
        model.p |= {"c": np.zeros(CODE), "d": np.array([30.0 if good else -30.0])}
        return model
    share = np.where(labels == 1, 0.5 / good, 0.5 / (1 - good))
    for _ in range(epochs):
        order = random.permutation(len(bags))
        for a in range(0, len(order), size):
            pick = order[a : a + size]
            n = np.array([len(bags[i]) for i in pick])
            starts, of = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
            f = model.forward(np.concatenate([bags[i] for i in pick]), starts, of)
            step += 1
            for k, g in model.back(f, of, starts, labels[pick], share[pick] / len(pick)).items():
                g = g + decay * model.p[k]
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.999 * two[k] + 0.001 * g * g
                model.p[k] = model.p[k] - rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
    return model


def learn(docs: DataFrame, labels: DataFrame, folds: int = 4, rest: int = 2, sample: int = SAMPLE) -> Attention:
    """labels: doc_id, quality. Learns only from ids outside the held-out fold."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    usable = usable.where(F.col("label").isin(0, 1) & (fold("doc_id", folds) != rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Memo(bucket)
        for batch in batches:
            found = [passages(t, held, FITTED).astype("<f2").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], names=["doc_id", "label", "facts"])

    taken = sampled_texts(docs, usable, sample)
    rows = taken.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, facts binary").where(F.length("facts") > 0)
    found = rows.toArrow()
    found = found.take(pa.compute.sort_indices(found, sort_keys=[("doc_id", "ascending"), ("label", "ascending")]))
    if not len(found):
        return fit([np.zeros((1, FACTS), np.float32)], np.ones(1))
    sizes = pa.compute.binary_length(found.column("facts")).to_numpy() // (2 * FACTS)
    # one table of all passages, filled a document at a time
    every, at = np.empty((int(sizes.sum()), FACTS), np.float32), 0
    for facts in found.column("facts"):
        own = np.frombuffer(facts.as_buffer(), "<f2").reshape(-1, FACTS)
        every[at : at + len(own)] = own
        at += len(own)
    labels = found.column("label").to_numpy().astype(float)
    del found
    return fit_table(every, sizes, labels)


def scored(docs: DataFrame, model: Attention, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of docs(doc_id, text, held_out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Memo(bucket)
        for batch in batches:
            score = model.score([passages(t, held) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= least).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def with_fold(docs: DataFrame, folds: int = 4, rest: int = 2) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), held_out("doc_id", folds, rest).alias("held_out"))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels outside the held-out fold, then score every document."""
    return scored(with_fold(docs), learn(docs, labels))


def kept(docs: DataFrame, model: Attention, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, with their own columns, that score `least` or more."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Memo(bucket)
        for batch in batches:
            yield batch.filter(pa.array(model.score([passages(t, held) for t in batch.column(at).to_pylist()]) >= least))

    return docs.mapInArrow(run, docs.schema)


def reject_poor(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels outside the held-out fold, then leave the documents out that aren't predicted good."""
    return kept(docs, learn(docs, labels))
