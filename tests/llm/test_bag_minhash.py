"""Near-dedup against brute force, and its defined results."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np

from skylattice.llm import hashing
from skylattice.llm.bag_minhash import dedup, near_classes, signatures


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def bag(text):
    w = words(text)
    return Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []))


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(docs):
    """doc_id -> least doc_id of its class."""
    parent = {d: d for d, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = {d: bag(t) for d, t in docs}
    texts = dict(docs)
    for a, b in combinations(parent, 2):
        alike = similarity(bags[a], bags[b]) >= 0.8 - 1e-9 if bags[a] and bags[b] else not bags[a] and not bags[b] and (texts[a] or "") == (texts[b] or "")
        if alike:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in parent}


def corpus(n):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    bases = [[r.choice(vocabulary) for _ in range(r.choice((1, 3, 6, 40, 200)))] * r.choice((1, 1, 3)) for _ in range(12)]
    docs = []
    for d in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice((0, 0, 1, 2, 5))):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        docs.append((d * 7, r.choice((" ", "  ", ", ")).join(w)))
    return docs + [(90_000, None), (90_001, ""), (90_002, "?!"), (90_003, "?!"), (90_004, "...")]


def test_as_brute_force(spark):
    docs = corpus(160)
    made = near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = brute(docs)
    assert {r["doc_id"]: r["class_id"] for r in made} == want
    sizes = Counter(want.values())
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (r["doc_id"] == r["class_id"]) for r in made)


def test_signature_places_agree_as_often_as_weights():
    r = random.Random(1)
    same, want = [], []
    for _ in range(60):
        base = [f"x{r.randrange(60)}" for _ in range(150)]
        other = base[:100] + [f"x{r.randrange(60)}" for _ in range(50)]
        rows = []
        bags = []
        for w in (base, other):
            h, n = hashing.words([" ".join(w)])
            bags.append(Counter(w))
            element, of, weight = hashing.multiset(h & hashing.ELEMENT, np.zeros(len(h), np.int64))
            rows.append(signatures(element, of, weight, 1)[0])
        same.append(float((rows[0] == rows[1]).mean()))
        want.append(similarity(*bags))
    assert abs(np.mean(same) - np.mean(want)) < 0.02


def test_defined_results(spark):
    schema = "doc_id long, text string, row long, key string, bands string, doc int"
    text = "one two three four five six seven eight nine ten"
    rows = [(3, text, 1, "k", "b", 0), (None, text, None, None, None, None), (2, text.upper(), 1, "k", "b", 0), (2, text.upper(), 1, "k", "b", 0), (4, None, 1, "k", "b", 0), (5, "", 1, "k", "b", 0)]
    docs = spark.createDataFrame(rows, schema)
    made = dedup(docs)
    assert made.schema == docs.schema
    assert sorted((r["doc_id"], r["text"]) for r in made.collect()) == [(2, text.upper()), (4, None)]
    assert near_classes(docs).count() == len(rows)
    assert dedup(docs.limit(0)).count() == 0 and near_classes(docs.limit(0)).count() == 0


def test_a_large_group_of_near_copies(spark):
    r = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    docs = []
    for d in range(600):
        w = list(base)
        w[r.randrange(80)] = f"new{d}"
        docs.append((d, " ".join(w)))
    made = near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in made} == {0}
