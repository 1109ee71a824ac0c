"""Line dedup against brute force, and its defined results."""

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from skylattice.llm import fuzzy_lines
from skylattice.llm.fuzzy_lines import dedup_lines, deduplicated, plain, shingles, signatures


def brute(docs: list[tuple]) -> dict[int, list[int]]:
    """doc_id -> numbers of the lines that go; docs: (doc_id, text), ids distinct."""
    first: dict[str, tuple] = {}
    places: dict[str, list[tuple]] = {}
    for doc_id, text in sorted(docs):
        for i, line in enumerate((text or "").split("\n")):
            if line := plain(line):
                first.setdefault(line, (doc_id, i))
                places.setdefault(line, []).append((doc_id, i))
    lines = list(first)
    parent = {x: x for x in lines}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {x: shingles(x) for x in lines}
    for a, b in combinations(lines, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            parent[root(a)] = root(b)
    stays: dict[str, tuple] = {}
    for x in lines:
        r = root(x)
        stays[r] = min(stays.get(r, first[x]), first[x])
    goes: dict[int, list[int]] = {}
    for x in lines:
        for at in places[x]:
            if at != stays[root(x)]:
                goes.setdefault(at[0], []).append(at[1])
    return {d: sorted(v) for d, v in goes.items()}


def corpus(n: int) -> list[tuple[int, str | None]]:
    """Documents whose lines are near and exact copies of a few, short ones among them."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzäéß") for _ in range(r.randint(2, 9))) for _ in range(300)]
    stock = [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(80)] + ["ab", "{", "x y", "short one"]
    docs = []
    for d in range(n):
        lines = []
        for _ in range(r.randint(0, 6)):
            line = r.choice(stock)
            if r.random() < 0.5:
                w = line.split()
                w[r.randrange(len(w))] = r.choice(words)
                line = " ".join(w)
            if r.random() < 0.2:
                line = "  " + line.upper() + " \t"
            lines.append(line)
            if r.random() < 0.2:
                lines.append("")
        docs.append((d * 3, "\n".join(lines)))
    return docs + [(100_000, None), (100_001, ""), (100_002, "\n\n")]


def test_as_brute_force(spark):
    docs = corpus(150)
    made = deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(made) == len(docs)
    assert {r["doc"]["doc_id"]: r["lines"] for r in made if r["lines"]} == brute(docs)
    texts = dict(docs)
    for r in made:
        text = texts[r["doc"]["doc_id"]]
        assert r["text"] == (None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in r["lines"]))


def test_one_character_edits(spark):
    """Lines of 40 to 80 characters with one character changed are found, and strangers are not; nothing here knows of shingles."""
    r = random.Random(11)
    lines = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n)).strip().center(n, "x") for n in range(40, 81) for _ in range(5)]
    docs = [(i, line) for i, line in enumerate(lines)] + [(10_000, "Copyright 2021 Foo Inc. All rights reserved."), (10_001, "Copyright 2022 Foo Inc. All rights reserved.")]
    for i, line in enumerate(lines):
        k = r.randrange(len(line))
        docs.append((1_000 + i, line[:k] + "#" + line[k + 1 :]))
    made = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(made[i] == line for i, line in enumerate(lines)) and made[10_000] and not made[10_001]
    assert sum(bool(made[1_000 + i]) for i in range(len(lines))) <= 0.02 * len(lines)


def test_signatures_agree_as_often_as_shingles():
    r = random.Random(1)
    for n in (6, 30, 400):
        same, want = [], []
        for _ in range(120):
            a = "".join(r.choice("abcdef ") for _ in range(n + SHINGLES))
            b = a[: n // 2] + "Z" + a[n // 2 + 1 :]
            one, two = signatures([a, b])
            same.append(float((one == two).mean()))
            x, y = shingles(a), shingles(b)
            want.append(len(x & y) / len(x | y))
        assert abs(np.mean(same) - np.mean(want)) < 0.03


SHINGLES = fuzzy_lines.SHINGLE


def test_defined_results(spark):
    schema = "doc_id long, text string, row long, lines string, doc string, key int"
    rows = [
        (2, "the very same line of text\nother words that stay here", 1, "a", "b", 3),
        (1, "The very  same line of text", None, None, None, None),
        (None, "the very same line of text", 1, "a", "b", 3),
        (2, "the very same line of text\nother words that stay here", 1, "a", "b", 3),
        (5, None, 1, "a", "b", 3),
        (6, "", 1, "a", "b", 3),
    ]
    docs = spark.createDataFrame(rows, schema)
    made = dedup_lines(docs)
    assert made.schema == docs.schema
    found = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in made.collect()), key=str)
    assert found == sorted([(False, 2, "other words that stay here")] * 2 + [(False, 1, "The very  same line of text"), (True, 0, ""), (False, 5, None), (False, 6, "")], key=str)
    assert dedup_lines(docs.limit(0)).count() == 0


def test_long_texts_and_a_hot_line(spark):
    hot = "one line that every single document of the table repeats"
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit(hot + "\n"), F.repeat(F.concat(F.lit("w"), F.col("id"), F.lit(" ")), 3000)).alias("text"))
    made = dedup_lines(docs).collect()
    assert sum(hot in r["text"] for r in made) == 1
    assert all(f"w{r['doc_id']} " in r["text"] for r in made)


def test_places_without_a_value():
    """Few and many values, and more lines than are filled at once, against the definition."""
    rng = np.random.default_rng(3)
    none, places = ~np.uint64(0), fuzzy_lines.PLACES
    counts = [1, 1, 2, fuzzy_lines.SPARSE, fuzzy_lines.SPARSE + 1, places - 1, places, *rng.integers(1, places + 1, 300), *rng.integers(1, 4, 300)]
    best = np.full((len(counts), places), none)
    for row, n in zip(best, counts):
        row[rng.choice(places, n, replace=False)] = rng.integers(0, 1 << 62, n, np.uint64)
    theirs = [[next(v for p in fuzzy_lines.ORDERS[place] if (v := row[p]) != none) for place in range(places)] for row in best]
    assert (fuzzy_lines.filled(best.copy()) == np.array(theirs)).all()


def test_plain_lines_as_words_joined():
    """Every character alone, doubled, within, before and after words."""
    for c in map(chr, range(0x3100)):
        for line in (c, c + c, f"A{c}b", f"A{c}{c}B", f"{c}Ab", f"Ab{c}", f"A {c}b", f" A{c} "):
            assert plain(line) == " ".join(line.lower().split())
