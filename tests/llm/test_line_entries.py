"""The one pass of line dedup over the texts: plain lines of a text at once, places and first places, buckets."""

import random

import numpy as np
import pyarrow as pa

from skylattice.llm.fuzzy_lines import entries, gathered, key_of, plain, plain_lines
from skylattice.llm.near_groups import banded_rows, bucket_pairs
from skylattice.llm.rows import with_row
from tests.llm.test_fuzzy_lines import corpus


def test_plain_lines_of_a_text():
    r = random.Random(2)
    letters = [*map(chr, range(1, 0x180)), *map(chr, range(0x390, 0x3D0)), *map(chr, range(0x2000, 0x2030)), *" \nAb" * 60]
    for _ in range(3000):
        text = "".join(r.choices(letters, k=r.randint(0, 25)))
        assert plain_lines(text) == [plain(x) for x in text.split("\n")] == [" ".join(x.lower().split()) for x in text.split("\n")]


def test_places_in_one_pass(spark):
    docs = [*corpus(60), (None, "twice here\ntwice here\n"), (None, "Twice  here")]
    made = gathered(entries(with_row(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").select("row", "doc_id", "text"), 3)).collect()
    places = {}
    for doc_id, text in docs:
        for i, line in enumerate((text or "").split("\n")):
            if line := plain(line):
                places.setdefault(key_of(line), []).append((doc_id is None, doc_id or 0, i))
    assert sorted((bytes(r["content"]), r["line"]) for r in made if r["content"] and r["n"] is None) == sorted((k, i) for k, at in places.items() for *_, i in at)
    n, first = {}, {}
    for r in made:
        if r["n"] is not None:
            k = bytes(r["content"])
            n[k] = n.get(k, 0) + r["n"]
            first[k] = (r["doc_id"] is None, r["doc_id"] or 0, r["line"])
    assert n == {k: len(at) for k, at in places.items()}
    assert {k: v for k, v in first.items() if not v[0]} == {k: min(at) for k, at in places.items() if not min(at)[0]}


def test_buckets_as_brute_force():
    """Over batches and parts, what is listed joins exactly the items that share a band."""
    rng = np.random.default_rng(5)
    batches = [(rng.permutation(1000)[:80] + 1000 * i, rng.integers(0, 150, (80, 4)) << 55) for i in range(3)]
    made = [r for keys, bands in batches for r in banded_rows(keys, bands, 5).to_pylist()]
    found = []
    for part in range(5):
        schema = banded_rows(*batches[0], 5).schema
        found += zip(*(c.tolist() for c in bucket_pairs(pa.Table.from_pylist([r for r in made if r["part"] == part], schema))))
    want = {}
    for keys, bands in batches:
        for key, own in zip(keys.tolist(), bands.tolist()):
            for band in own:
                want.setdefault(band, set()).add(key)
    for band, members in want.items():
        up = {a: b for x, a, b in found if x == band}
        assert all(b < a for a, b in up.items()) and set(up) == members - {min(members)}
    assert {x for x, *_ in found} == {band for band, members in want.items() if len(members) > 1}
