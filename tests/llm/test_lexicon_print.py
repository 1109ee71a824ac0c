"""I-Match fingerprints: edits, likeness, neighbours, against plain Python."""

import hashlib
import random
import struct
from collections import Counter

import regex
import xxhash

from skylattice.llm import lexicon_print
from skylattice.llm.lexicon_print import fingerprints


def corpus(n):
    r = random.Random(8)
    common, rare = [f"c{i}" for i in range(40)], [f"r{i}" for i in range(900)]
    docs = []
    for d in range(n):
        words = [r.choice(common) if r.random() < 0.5 else r.choice(rare) for _ in range(r.choice((3, 40, 300)))]
        docs.append((d * 5, " ".join(words)))
    docs += [(10_000, None), (10_001, ""), (10_002, "é" * 9), (10_003, docs[4][1]), (10_004, docs[4][1]), (10_005, docs[4][1] + " c1")]
    r.shuffle(docs)
    return docs


def test_edits_and_likeness(spark):
    docs = corpus(120)
    made = {r["doc_id"]: r for r in fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(made) == len(docs)
    by_id = sorted((d, t or "") for d, t in docs)
    prints: dict[str, set[str]] = {}
    for i, (d, t) in enumerate(by_id):
        after = by_id[(i + 1) % len(by_id)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        r = made[d]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints.setdefault(t, set()).add(r["fingerprint"])
        prints.setdefault(edited, set()).add(r["edited_fingerprint"])
        if edited == t:
            assert r["near_edited"] == 1
        if after == t:
            assert r["near_next"] == 1
    assert all(len(p) == 1 for p in prints.values())
    # edited texts keep three quarters: they are nearer on average than strangers
    some = [made[d] for d, t in by_id if len(t) > 500]
    assert sum(r["near_edited"] for r in some) > 3 * sum(r["near_next"] for r in some)


def test_a_third_of_copies_and_short_texts(spark):
    r = random.Random(4)
    words = [f"r{i}" for i in range(900)]
    hot = " ".join(r.choice(words) for _ in range(300))
    near = hot.replace(hot.split()[7], "other", 1)
    short = "common words of one short text that are in no other place here"
    docs = [(i, hot) for i in range(60)] + [(60, near)] + [(100 + i, " ".join(r.choice(words) for _ in range(200))) for i in range(110)]
    docs += [(1000, short), (1001, short + " now")]
    made = {r["doc_id"]: r for r in fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert made[0]["near_next"] == 1 and made[59]["near_next"] > 0.5 and made[60]["near_edited"] > 0.3
    assert made[1000]["near_next"] > 0.5 and made[100]["near_next"] < 0.3


def test_defined_results(spark):
    docs = spark.createDataFrame([(None, "b c d", 1), (None, "a b c", 1), (3, None, 1), (3, "x y z", 1)], "doc_id long, text string, fingerprint int")
    assert fingerprints(docs).count() == 4
    assert fingerprints(docs.limit(0)).count() == 0
    lone = fingerprints(docs.where("text = 'x y z'")).collect()
    assert len(lone) == 1 and lone[0]["near_next"] == 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashed(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed=seed)


def plain_terms(text):
    return {hashed(t.encode()) for t in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if t}


def plain_print(text, band):
    """The kinds to be compared, each a dictionary of sub-lexicon number to hash, and the text's own hash where it has no term."""
    every = sorted(plain_terms(text))
    kept = [t for t in every if t % lexicon_print.SLOTS in band]
    slot = lambda k, t: (t >> (22 + 13 * k)) % lexicon_print.SHARES[k]
    assert len(kept) <= lexicon_print.LOOK
    wide = len({slot(0, t) for t in kept}) < lexicon_print.ENOUGH
    found = {}
    for first, held in ((0, kept), (lexicon_print.KINDS, every if wide else [])):
        groups = []
        for k in range(lexicon_print.KINDS):
            by: dict[int, list[int]] = {}
            for t in held:
                if k == 0 or slot(k, t) < lexicon_print.GROUPS:
                    by.setdefault(slot(k, t), []).append(t)
            groups.append(by)
        for k in range(lexicon_print.KINDS):
            if all(len(groups[j]) < lexicon_print.ENOUGH for j in range(k + 1, lexicon_print.KINDS)):
                for number, members in groups[k].items():
                    packed = sorted(signed(((number + (first + k) * lexicon_print.GROUPS) << lexicon_print.BITS) % (1 << 64) | t % (1 << lexicon_print.BITS)) for t in members)
                    h = 42
                    for p in packed:
                        h = hashed(struct.pack("<q", p), h)
                    found[(number + (first + k) * lexicon_print.GROUPS) % (1 << (64 - lexicon_print.BITS))] = h % (1 << 40)
    return found or {None: hashed(text.encode())}


def plain_likeness(a, b):
    if a == b:
        return 1.0
    shares = []
    for k in (*range(lexicon_print.KINDS), *range(lexicon_print.KINDS, 2 * lexicon_print.KINDS)):
        one, two = ({n: h for n, h in p.items() if n is not None and n // lexicon_print.GROUPS == k} for p in (a, b))
        used = one.keys() | two.keys()
        shares.append((len(used), sum(one.get(n) == two.get(n) for n in used) / max(1, len(used))))
    # the sparsest share of the lexicon's kinds that is used enough, else of the kinds over all terms, else the densest of these
    for kinds in ((2, 1, 0), (5, 4, 3)):
        for k in kinds:
            if shares[k][0] >= lexicon_print.ENOUGH:
                return shares[k][1]
    return shares[3][1]


def test_fingerprints_by_brute_force(spark):
    docs = corpus(120)
    texts = {t or "" for _, t in docs}
    slots = Counter(s for t in texts for s in {x % lexicon_print.SLOTS for x in plain_terms(t)})
    least, most = max(2, int(lexicon_print.RARE * len(texts))), max(2, int(lexicon_print.COMMON * len(texts)))
    band = {s for s, n in slots.items() if least <= n <= most}
    made = {r["doc_id"]: r for r in fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    by_id = sorted((d, t or "") for d, t in docs)
    for i, (d, t) in enumerate(by_id):
        after = by_id[(i + 1) % len(by_id)][1]
        cut = len(t) // 4
        own, edited, following = (plain_print(x, band) for x in (t, t[: len(t) - cut] + after[:cut], after))
        for name, want in (("fingerprint", own), ("edited_fingerprint", edited)):
            if None in want:
                assert made[d][name] == f"{(-(want[None] >> 2) - 1) % (1 << 64):x}"
            else:
                assert {int(x, 16) >> 40: int(x, 16) % (1 << 40) for x in made[d][name].split()} == want
        assert abs(made[d]["near_edited"] - plain_likeness(own, edited)) < 1e-12
        assert abs(made[d]["near_next"] - plain_likeness(own, following)) < 1e-12
