"""Learned operators against plain Python: counts, selection and scores, term by term."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex

from skylattice.llm import language_id, learning, quality, toxicity
from skylattice.runtime import table

SF = "/root/testdata/sf0.001"


def byte_grams(text):
    data = (" " + regex.sub(r"[^\p{L}\p{M}]+", " ", text.lower()) + "   ").encode()
    return [int.from_bytes(data[i : i + 4], "little") for i in range(len(data) - 3)]


def places(gram):
    return [((gram ^ gram >> 15) * f % (1 << 32)) >> (32 - language_id.SLOT_BITS) for f in language_id.FACTORS]


def plain_languages(rows):
    """doc_id -> (language, score): all n-grams counted by dictionaries, a set of slots for each language."""
    counts = defaultdict(Counter)
    for _, text, lang, out in rows:
        if not out and text is not None and lang is not None:
            counts[lang].update(byte_grams(text))
    share = {lang: {g: n / c.total() for g, n in c.items()} for lang, c in counts.items()}
    largest = Counter()
    for held in share.values():
        for g, s in held.items():
            largest[g] = max(largest[g], s)
    filled = {lang: {p for g, s in held.items() if s * language_id.LEAST >= largest[g] for p in places(g)} for lang, held in share.items()}
    false = {lang: (len(f) / (1 << language_id.SLOT_BITS)) ** language_id.HASHES for lang, f in filled.items()}
    found = {}
    for d, text, _, _ in rows:
        if not regex.search(r"\p{L}", text or ""):
            found[d] = ("und", 0.0)
            continue
        all_of = [places(g) for g in byte_grams(text)]
        real = {lang: max(0.0, sum(all(p in filled[lang] for p in ps) for ps in all_of) - len(all_of) * false[lang]) / (1 - false[lang]) for lang in sorted(filled)}
        best = max(real, key=real.get)  # the first of equal ones
        found[d] = (best, real[best] / max(sum(real.values()), 1e-9))
    return found


def test_languages(spark):
    docs = table(spark, SF, "documents").where("length(text) < 20000")  # the plain version is slow
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", learning.held_out("doc_id", 4, 2)).collect()]
    want = plain_languages(rows)
    made = language_id.identify(docs).collect()
    assert len(made) == len(rows) > 100
    for r in made:
        assert (r["lang_pred"], r["score"]) == (want[r["doc_id"]][0], pytest.approx(want[r["doc_id"]][1], abs=1e-9))


def test_ties_between_languages(spark):
    docs = spark.createDataFrame([(i, "the very same text in two of them", "ba"[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    taken = docs.where(~learning.held_out("doc_id", 4, 2)).groupBy("lang").count().collect()
    assert len(taken) == 2
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(docs).collect()} == {("a", 0.5)}


def plain_terms(text):
    return sorted({b for w in toxicity.words(text) for b in toxicity.buckets(w)})


def test_terms_and_pairs_of_the_machine(spark):
    """Which terms are kept, by counting; scores by a sum over all pairs of terms."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    machine = toxicity.learn(docs, labels)
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    known = {(r[0], r[1]) for r in labels.where("toxic IN (0, 1)").where(learning.fold("doc_id", 5) != 0).select("doc_id", "toxic").collect()}
    rows = [(y, plain_terms(text[d])) for d, y in known if d in text]
    p, q = sum(y for y, _ in rows), sum(1 - y for y, _ in rows)
    n, a = Counter(), Counter()
    for y, terms in rows:
        n.update(terms)
        a.update(terms if y else [])
    chi = {t: (p + q) * (a[t] * q - (n[t] - a[t]) * p) ** 2 / (n[t] * max(p + q - n[t], 1) * max(p * q, 1)) for t in n}
    assert machine.kept.tolist() == sorted(t for t in n if chi[t] >= toxicity.LEAST and n[t] >= toxicity.FEW or n[t] >= toxicity.COMMON * (p + q))

    made = {r["doc_id"]: r for r in toxicity.scored(toxicity.with_fold(docs), machine).collect()}
    at = {t: i for i, t in enumerate(machine.kept.tolist())}
    short = [d for d, t in text.items() if len(t or "") < 1500]
    assert len(short) > 30
    for d in short:
        own = [at[t] for t in plain_terms(text[d]) if t in at]
        z = machine.bias + sum(machine.weight[i] for i in own) + sum(float(machine.factor[i] @ machine.factor[j]) for x, i in enumerate(own) for j in own[x + 1 :])
        score = 1 / (1 + math.exp(-min(30, max(-30, z))))
        assert made[d]["score"] == pytest.approx(score, abs=1e-9) and made[d]["predicted"] == (made[d]["score"] >= 0.5)


def test_attention_passage_by_passage(spark):
    """Scores by loops over passages and cells; repeated rows and ties get the same."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.learn(docs, labels)
    p, sig = model.p, lambda z: 1 / (1 + math.exp(-min(30, max(-30, z))))
    rows = docs.select("doc_id", "text").collect()
    made = {r["doc_id"]: r for r in quality.scored(quality.with_fold(docs.unionByName(docs)), model).collect()}
    for d, text in rows:
        words = (text or "").split()
        if not words:
            assert made[d]["score"] == 0
            continue
        hidden, pull = [], []
        for a in range(0, len(words), quality.PASSAGE):
            part = " ".join(words[a : a + quality.PASSAGE])
            facts = quality.passages(part, {w: quality.bucket(w) for w in part.split()})
            assert facts.shape == (1, quality.FACTS)
            x = (facts[0] - model.mean) / model.scale
            h = np.tanh(x @ p["w"] + p["b"])
            hidden.append(h)
            pull.append(sum(float(np.tanh(h @ p["v"][:, j])) * sig(float(h @ p["u"][:, j])) * float(p["a"][j]) for j in range(quality.GATE)))
        share = [math.exp(e - max(pull)) for e in pull]
        z = sum(s / sum(share) * h for s, h in zip(share, hidden))
        assert made[d]["score"] == pytest.approx(sig(float(z @ p["c"] + p["d"][0])), abs=1e-5)
        assert made[d]["predicted"] == (made[d]["score"] >= 0.7)
