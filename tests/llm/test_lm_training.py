"""The language model learns from every training document and is better than its base on held-out ones."""

import numpy as np
from pyspark.sql import functions as F

from pagesift.llm import lm

CYCLE = "one two three four five six seven eight".split()


def cycle(at, n):
    return " ".join(CYCLE[(at + i) % len(CYCLE)] for i in range(n))


def test_every_training_document_moves_the_network(spark):
    """Each document repeats one token of its own over several windows; those that the gradient passes saw have a new
    embedding (not from a first window, where the softmax weights are still zero)."""
    docs = spark.createDataFrame([(i, f"own{i} " * 100) for i in range(160)], "doc_id long, text string").repartition(2)
    counts = [(w.encode(), 100) for w in sorted(f"own{i}" for i in range(160))] + [(lm.END, 160)]
    net, vocabulary = lm.train(docs, counts, 0)
    start = lm.Network([c for _, c in counts], 0)
    moved = np.abs(net.p["emb"] - start.p["emb"]).max(1)
    assert len(vocabulary) == 161
    assert [w for w, m in zip(vocabulary, moved) if m < 1e-6 and w != lm.END] == []  # the end token is never an input


def test_held_out_documents_score_above_the_base(spark):
    """Only documents outside the first two of 16 slices of the id hashes hold the cycle that held-out ones repeat."""
    ids = spark.range(4000).select("id", (F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(16)) < 2).alias("low")).collect()
    rows = [(r.id, "noise words only" if r.low else cycle(r.id, 60)) for r in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = lm.score_documents(docs).where("held_out and n_tokens > 10").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert got.n > 10_000
    assert (got.s - got.b) / got.n > 0.2, (got.s / got.n, got.b / got.n)  # log10 a token; the base has about -0.9
