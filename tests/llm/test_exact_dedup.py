"""Exact dedup against its SQL and brute force."""

import hashlib
import random
import re

from skylattice.llm import exact_dedup, queries
from tests.oracle import compare


def test_as_sql(spark):
    name = "op8_exact_dedup"
    n, differs = compare(spark, queries.QUERIES[name], queries.ORACLES[name], "/root/testdata/sf0.001")
    assert n and not differs


def test_as_brute_force(spark):
    r = random.Random(4)
    stock = ["", None, "a b", "a  b", "a\t\n b", "a b", "A b", " a b", *(f"text {i}" for i in range(30)), "x " * 50_000]
    docs = [(d, r.choice(stock) if d % 3 else "a b", "e") for d in range(400)]
    made = {x["doc_id"]: x for x in exact_dedup.exact_dedup(spark.createDataFrame(docs, "doc_id long, text string, group_size string")).collect()}
    groups: dict[str, list[int]] = {}
    for d, t, _ in docs:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), []).append(d)
    assert len(made) == len(docs)
    for text, own in groups.items():
        for d in own:
            x = made[d]
            assert (x["keep_id"], x["group_size"], x["kept"]) == (min(own), len(own), d == min(own))
            assert x["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_defined_results(spark):
    docs = spark.createDataFrame([(None, "t"), (7, "t"), (7, "t"), (None, None), (None, "")], "doc_id long, text string")
    made = exact_dedup.exact_dedup(docs).collect()
    assert sum(x["kept"] for x in made) == 2
    assert {x["keep_id"] for x in made if x["group_size"] == 3} == {7}
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
