"""Periodic runs against brute force over all lags and places."""

import hashlib
import random
import re
import zlib

from skylattice.llm import periodic_runs, queries


def smallest_period(words, start, stop):
    return next(q for q in range(1, stop - start + 1) if words[start : stop - q] == words[start + q : stop])


def brute(words, min_exp=3, min_len=24):
    """Every stretch that agrees with itself a lag later and no further, if the lag is its smallest period."""
    found = []
    for q in range(1, len(words) // min_exp + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_len, min_exp * q) and j > i and smallest_period(words, i, j + q) == q:
                found.append((i, j + q - i, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def stretches(r):
    """Words with nested and neighbouring repeats, among them near misses."""
    out = []
    for _ in range(r.randint(1, 6)):
        part = [r.choice("abc") for _ in range(r.randint(1, 15))]
        out += part * r.choice([1, 2, 3, 4, 9]) + part[: r.randint(0, len(part))] + [r.choice("abcd")] * r.choice([0, 1, 30])
    return out * r.choice([1, 1, 3])


def test_as_brute_force(spark):
    r = random.Random(8)
    texts = [" ".join(stretches(r)) for _ in range(120)]
    texts += ["", None, " \t\n", "x", "x " * 5000, "é b " * 30, "\x1ca \x1fb " * 25, " ".join(str(i % 700) for i in range(2500)), " ".join(r.choice("ab") for _ in range(3000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, runs string").selectExpr("doc_id", "runs AS text", "doc_id AS runs", "1 AS known")
    for lags in (2048, 7):  # 7: nearly all texts are dealt out in ranges of lags
        made = {x["doc_id"]: x for x in periodic_runs.periodic_runs(docs, lags=lags).collect()}
        assert len(made) == len(texts)
        for d, text in enumerate(texts):
            words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
            runs = brute(words)
            assert [tuple(x) for x in made[d]["runs"]] == runs, d
            assert made[d]["collapsed"] == " ".join(kept(words, runs))
            assert made[d]["n_words"] == len(words)
    assert sum(len(x["runs"]) for x in made.values()) > 200


def test_other_exponents(spark):
    r = random.Random(9)
    texts = [" ".join(stretches(r)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for exp, least in ((2, 4), (4, 40)):
        made = {x["doc_id"]: x for x in periodic_runs.periodic_runs(docs, min_exp=exp, min_len=least, lags=16).collect()}
        assert all([tuple(x) for x in made[d]["runs"]] == brute(t.split(), exp, least) for d, t in enumerate(texts))


def test_repeats_nulls_and_long_texts(spark):
    docs = spark.createDataFrame([(None, "a " * 30), (1, "a " * 30), (1, "a " * 30), (2, None)], "doc_id long, text string")
    made = periodic_runs.periodic_runs(docs).collect()
    assert sorted((x["doc_id"] or 0, x["collapsed"]) for x in made) == [(0, "a"), (1, "a"), (1, "a"), (2, "")]
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "one two " * 200_000), (2, " ".join(map(str, range(100_000))))], "doc_id long, text string")
    made = {x["doc_id"]: x for x in periodic_runs.periodic_runs(long).collect()}
    assert (made[1]["collapsed"], made[2]["runs"]) == ("one two", [])


def test_query(spark):
    made = {x["doc_id"]: x for x in queries.QUERIES["op11_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(made) == len(docs)
    assert sum(x["n_runs"] > 0 for x in made.values()) >= 5
    for d in docs:
        words, x = planted(d["doc_id"], d["text"]), made[d["doc_id"]]
        if len(words) > 3000 and zlib.crc32(str(d["doc_id"]).encode()) % 10:
            continue  # brute force takes long
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        assert (x["n_runs"], x["start"], x["length"], x["period"]) == (len(runs), *(best or (None,) * 3))
        assert x["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert x["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert x["collapsed_sha256"] == sha(" ".join(kept(words, runs)))
