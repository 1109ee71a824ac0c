"""Language, toxicity and quality: held-out accuracy, folds, defined results."""

import zlib
from collections import Counter

import numpy as np
import pytest

from skylattice.llm import language_id, quality, toxicity
from skylattice.runtime import table

SF = "/root/testdata/sf0.01"


def area(score, label):
    """Chance that a positive scores above a negative."""
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_language_of_held_out_documents(spark):
    docs = table(spark, SF, "documents")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    made = language_id.identify(docs).collect()
    assert len(made) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in made)
    out = [r for r in made if r["held_out"] and truth[r["doc_id"]]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in out) >= 0.97 * len(out)


@pytest.mark.parametrize("score, label, folds, rest, bar", [(toxicity.score_toxicity, "toxic", 5, 0, 0.9), (quality.score_quality, "quality", 4, 2, 0.85)])
def test_held_out_labels(spark, score, label, folds, rest, bar):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    made = score(docs, labels).collect()
    assert len(made) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == rest) and 0 <= r["score"] <= 1 for r in made)
    assert all(r["predicted"] == (r["score"] >= (0.5 if label == "toxic" else 0.7)) for r in made)
    out = [r for r in made if r["held_out"] and truth.get(r["doc_id"]) in (0, 1)]
    assert area(np.array([r["score"] for r in out]), np.array([truth[r["doc_id"]] for r in out])) >= bar


def test_interactions_are_learned():
    """Neither term alone says anything: only both together do."""
    rows = [[a, b] if a is not None else [b] for a in (0, 1) for b in (2, 3) for _ in range(200)]
    label = np.array([float((r[0] == 0) == (r[1] == 2)) for r in rows])
    machine = toxicity.fit(rows, label, np.arange(4), epochs=60)
    assert all((machine.score(r) > 0.5) == bool(y) for r, y in zip(rows, label))


def test_attention_finds_the_passage_that_decides():
    r = np.random.default_rng(0)
    bags, labels = [], []
    for i in range(400):
        bag = r.normal(0, 1, (6, quality.FACTS)).astype(np.float32)
        bag[:, 0] = -2
        if i % 2:
            bag[r.integers(6), 0] = 4
        bags.append(bag)
        labels.append(float(i % 2))
    model = quality.fit(bags, np.array(labels), epochs=40)
    assert ((model.score(bags) >= 0.5) == np.array(labels)).mean() > 0.97


def test_defined_results(spark):
    rows = [(i, t, lang, None, 1) for i, (t, lang) in enumerate([("the cat sat on the mat and the dog", "en"), ("der hund und die katze auf der matte", "de"), (None, "en"), ("", None), ("12 34 !", "en"), ("the cat " * 30_000, "en")] * 4)]
    rows.append((None, "the dog and the cat", "en", None, 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, label int")
    labels = spark.createDataFrame([(0, 1, 1), (1, 0, 0), (1, 0, 0), (5, 2, None), (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    made = language_id.identify(docs).collect()
    assert Counter(r["lang_pred"] for r in made)["und"] == 12
    assert all(r["score"] == 0 for r in made if r["lang_pred"] == "und")
    for score in (toxicity.score_toxicity, quality.score_quality):
        assert score(docs, labels).count() == len(rows)
        assert score(docs, labels.limit(0)).count() == len(rows)
        assert score(docs.limit(0), labels).count() == 0
    assert language_id.identify(docs.limit(0)).count() == 0
    assert all(r["lang_pred"] == "und" for r in language_id.identify(docs.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")).collect())
    for keep in (toxicity.reject_toxic, quality.reject_poor):
        assert keep(docs, labels).schema == docs.schema
