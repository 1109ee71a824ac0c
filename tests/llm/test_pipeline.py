"""The pipeline: each stage against brute force over what its predecessor kept."""

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from skylattice.llm import quality, toxicity
from skylattice.runtime import table
from tests.llm.test_bag_minhash import brute as near_brute
from tests.llm.test_fuzzy_lines import brute as line_brute
from tests.llm.test_tokens import check_packed

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    held, frames = {}, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, SF)
        made.write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        held[name], frames[name] = docs, before
        if name != "packing":
            assert docs.columns == columns
            assert docs.schema == before.schema
    labels = table(spark, SF, "labels")
    for name, score, passes in (("toxicity", toxicity.score_toxicity, 0), ("quality", quality.score_quality, 1)):
        want = {r["doc_id"] for r in score(frames[name], labels).collect() if r["predicted"] == passes}
        assert set(rows(held[name])) == want
    before, after = rows(frames["line_dedup"]), rows(held["line_dedup"])
    goes = line_brute([(d, r["text"]) for d, r in before.items()])
    assert set(before) == set(after)
    for d, r in before.items():
        text = "\n".join(x for i, x in enumerate(r["text"].split("\n")) if i not in goes.get(d, []))
        assert (after[d]["text"], after[d]["n_chars"], after[d]["source"]) == (text, len(text), r["source"])
    classes = near_brute([(d, r["text"]) for d, r in after.items()])
    assert set(rows(held["near_dedup"])) == set(classes.values())
    left = rows(held["near_dedup"])
    check_packed(held["packing"].collect(), [(d, r["text"]) for d, r in left.items()])
    assert public_tokenizers.path("byte_bpe_50k.json")
    assert corpus_pipeline.run(spark, SF).count() == held["packing"].count()


def test_odd_rows_pass_every_stage(spark):
    """Nulls, empty texts, repeated rows, null ids and columns whose names clash with the operators' own."""
    good = "The committee met on Monday, and it agreed on the plan for the next year, as the report says. " * 4
    rows = [(1, good, "en", "a", 1), (1, good, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (None, good + "More.", None, "b", 5), (None, None, None, None, None), (4, "word " * 40_000, "en", "a", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("row", "key", "content", "node", "label", "text_a", "lines", "stays"):
        docs = docs.withColumn(c, F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            made = stage(spark, given, SF)
            if name == "packing":
                assert {r["doc_id"] for r in made.collect()} == {r["doc_id"] for r in given.collect()}
            else:
                assert made.columns == given.columns
                assert made.count() <= given.count()
                assert {r["doc_id"] for r in made.collect()} <= {r["doc_id"] for r in given.collect()}
