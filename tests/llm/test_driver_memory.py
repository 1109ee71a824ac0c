"""What the learned operators hold on the driver while they learn."""

import random
import tracemalloc

from skylattice.llm import quality


def test_one_table_of_passages(spark):
    """The passages of all documents are held once, not as rows, as arrays of documents and joined."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(500)]
    n, passages = 1200, quality.FITTED
    docs = spark.createDataFrame([(i, " ".join(r.choices(words, k=passages * quality.PASSAGE))) for i in range(n)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, quality int")
    tracemalloc.start()
    try:
        model = quality.learn(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # three quarters of the documents are learned from
    assert peak < 2.2 * (0.75 * n * passages * quality.FACTS * 4)
    assert model.mean.shape == (quality.FACTS,)
