"""What travels between tasks of line dedup: packed entries, each place once; sets and first places against plain Python."""

import random

import numpy as np
import pyarrow as pa

from skylattice.llm import fuzzy_lines
from skylattice.llm.fuzzy_lines import PLACE, entries, firsts, gathered, key_of, plain, report, shingle_hashes, shingle_ids
from skylattice.llm.hashing import ELEMENT
from skylattice.llm.near_groups import SORTED, alike, banded_rows, bucket_pairs, unpacked
from skylattice.llm.rows import with_row
from tests.llm.test_fuzzy_lines import corpus


def test_entries_take_twelve_bytes():
    rng = np.random.default_rng(1)
    keys, bands = rng.integers(0, 1 << 48, 2000), rng.integers(-(1 << 63), 1 << 63, (2000, 30))
    made = banded_rows(keys, bands, 7)
    assert made.nbytes <= 12.1 * bands.size
    # twice the same items: each bucket has two members alike, so nothing is listed; other keys: every band is
    assert not len(bucket_pairs(pa.Table.from_batches([made, made]))[0])
    band, a, b = bucket_pairs(pa.Table.from_batches([made, banded_rows(keys ^ 1, bands, 7)]))
    assert set(band.tolist()) == set((bands >> 16 << 16).ravel().tolist()) and (a == b + 1).all() and set((a >> 1).tolist()) == set((keys >> 1).tolist())


def test_each_place_travels_once(spark):
    docs = [*corpus(60), *[(10**6 + i, "a line that all have\nand another\na line that all have") for i in range(30)], (None, "and another"), (-5, "And  another")]
    rows = entries(with_row(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").select("row", "doc_id", "text"), 3)
    sent = pa.table({"places": pa.array([r["places"] for r in rows.select("places").collect()], pa.binary())})
    want = sorted((key_of(x), i) for _, text in docs for i, line in enumerate((text or "").split("\n")) if (x := plain(line)))
    assert len(unpacked(sent.column("places"), PLACE)) == len(want)
    made = [r for r in gathered(rows, twice=False).collect() if r["content"]]
    assert sorted((bytes(r["content"]), r["line"]) for r in made) == want
    assert [(r["doc_id"], r["line"]) for r in made if r["n"] and bytes(r["content"]) == key_of("and another")] == [(-5, 0)]
    counts = {c: n for c, n in ((bytes(r["content"]), r["n"]) for r in made if r["n"])}
    assert counts == {k: sum(k == x for x, _ in want) for k in {k for k, _ in want}}


def test_firsts_as_sorted():
    """Few halves of contents and rows, so that each half alone decides somewhere."""
    r = random.Random(3)
    for size in (0, 1, 2, 50, 500):
        rows = [(*(r.choice((1, 2**63 + 5, 2**64 - 1)) for _ in range(4)), r.choice((-(2**63), -1, 0, 7)), r.randrange(4), r.randint(1, 9), r.randrange(2)) for _ in range(size)]
        rows = [(*x[:4], 0 if x[7] else x[4], *x[5:]) for x in rows]
        first, rest = firsts(np.array(rows, PLACE))
        want = {}
        for x in sorted(rows, key=lambda x: (x[0], x[1], x[7], x[4], x[2], x[3], x[5])):
            want.setdefault(x[:2], []).append(x)
        assert [(*x[:6], x[7]) for x in first.tolist()] == [(*w[0][:6], w[0][7]) for w in want.values()]
        assert first["n"].tolist() == [sum(x[6] for x in w) for w in want.values()]
        assert len(rest) == size - len(want) and not rest["n"].any()


def test_sets_and_likeness_as_plain_sets():
    r = random.Random(4)
    lines = ["".join(r.choice("ab ü") for _ in range(r.choice([0, 1, 2, 3, 4, 5, 9, 400]))) for _ in range(2000)] + [None, "", "aaaa" * 9, "aaaa", "aaaa", "b" * (fuzzy_lines.CHUNK + 9)]
    sets = shingle_ids(lines)
    for line, got in zip(lines, sets, strict=True):
        assert np.array_equal(got, np.unique(shingle_hashes([plain(line or "") or " "])[0] & ELEMENT))
    sets = [np.sort(np.array(r.sample(range(40), r.randint(1, 40)), np.uint64)) for _ in range(400)] + [np.arange(SORTED + i, dtype=np.uint64) for i in (0, 9)]
    one, two = np.array(r.choices(range(402), k=5000)), np.array(r.choices(range(402), k=5000))
    plainly = [len(a & b) >= 0.8 * len(a | b) - 1e-9 for a, b in ((set(sets[i].tolist()), set(sets[j].tolist())) for i, j in zip(one, two))]
    assert alike(sets, one, two, 0.8).tolist() == plainly


def test_lines_are_counted_without_splitting(spark):
    texts = [None, "", "\n", "a", "a\n", "\n\na\r\n b ü\n", "\x00\nü"]
    made = report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["n_lines"] for r in made.collect()} == {i: 0 if t is None else len(t.split("\n")) for i, t in enumerate(texts)}
