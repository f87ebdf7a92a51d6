"""Large benchmarks, very long texts, hot ids and ordinary prose after licence tags."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesift.llm import decontamination, fingerprints, licenses, lm, simhash


def test_a_large_benchmark_takes_the_same_plan(spark):
    """300,000 windows, one of them shared by a thousand items."""
    bench = spark.range(1000).select(F.col("id").alias("item_id"), F.concat_ws(" ", F.lit("all items share these ten words at their very start"),
                                     F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: F.concat(F.lit("w"), F.col("id") * 300 + i))).alias("text"))
    docs = spark.createDataFrame([(1, "x all items share these ten words at their very start y"), (2, " ".join(f"w{i}" for i in range(290, 300))), (3, " ".join(f"w{i}" for i in range(295, 305))),
                                  (None, "nothing here"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in decontamination.contaminated_words(docs, bench).collect()}
    assert (got[1].n_hit, len(got[1]["items"])) == (10, 1000) and (got[2].n_hit, got[2]["items"]) == (10, ["0"])
    assert got[3].n_hit == got[None].n_hit == got[4].n_hit == 0
    plan = decontamination.found_windows(docs, bench)[0]._jdf.queryExecution().executedPlan().toString()
    assert "w290" not in plan and "Python" not in plan


def test_decontaminated_rows_keep_their_columns(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "one two three"), (None, "one two three four"), (None, "clean"), (2, None)], "doc_id long, text string")
    for name in ("doc", "k", "d", "suspect", "_text", "w", "at", "places"):
        docs = docs.withColumn(name, F.lit(name))
    out = decontamination.decontaminate(docs, bench)
    assert out.columns == docs.columns
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted((tuple(r) for r in docs.where("text is null or text = 'clean'").collect()), key=repr)
    assert decontamination.decontaminate(docs.limit(0), bench).count() == 0 and decontamination.decontaminate(docs, bench.limit(0)).count() == 4
    spans = {r.text for r in decontamination.decontaminate(docs, bench, "spans").collect()}
    assert spans == {"", "four", "clean", None}


def test_a_very_long_text_takes_memory_of_its_own_length():
    rng = np.random.default_rng(0)
    net = lm.Network([10] * 50, 5)
    docs = [rng.integers(0, 50, 40_000).astype(np.int32)] + [rng.integers(0, 50, 10).astype(np.int32) for _ in range(255)]
    tracemalloc.start()
    scores = net.score(docs)
    net.train(docs, 0.1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(scores) == 256 and peak < 30e6  # a dense matrix of 256 lanes would take some 120 MB


def test_two_million_tokens_are_held_once():
    long = np.arange(2_000_000, dtype=np.int32) % 40
    lanes = lm.Lanes([long] + [np.arange(10, dtype=np.int32)] * 100, lm.LANES)
    assert lanes.tokens.nbytes + lanes.head.nbytes < 11e6 and lanes.width == 101
    ids, inputs, fresh, on = lanes.window(0, 64)
    assert ids.shape == (64, 101) and on[:, 0].all() and on[:, 1:].sum() == 1000 and fresh[0].all()
    ids, inputs, fresh, on = lanes.window(1_999_936, 64)
    assert ids.shape == (64, 1) and (ids[:, 0] == long[-64:]).all() and (inputs[1:, 0] == ids[:-1, 0]).all() and inputs[0, 0] == long[-65]


@pytest.mark.parametrize("copies", [False, True])
def test_hot_ids_are_cut(spark, copies):
    """A third of the rows without an id, with different texts or all the same: no range holds them all."""
    rows = [(None if i % 3 == 0 else i, "same text" if copies and i % 3 == 0 else f"text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = fingerprints.fingerprints(docs)
    assert got.count() == 3000
    keys = docs.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("k"), F.xxhash64("text").alias("h"))
    cuts = fingerprints._cuts(keys, 30)
    assert sum(c[0] == 2**63 - 1 for c in cuts) >= 8 and len(cuts) <= 40
    if not copies:
        order = sorted(((d is None, d or 0), t) for d, t in rows if d is not None)
        nexts = {d[1]: order[(i + 1)][1] for i, (d, t) in enumerate(order[:-1])}
        by = {r.doc_id: r for r in got.collect()}
        for d in (1, 500, 1000, 2998):
            other = fingerprints.chunk_set(nexts[d].encode())
            assert by[d].near_next == fingerprints.containment(fingerprints.chunk_set(f"text {d}".encode()), other)


@pytest.mark.parametrize("text,labels,score", [
    ("the license expression is simple to read", "", 0.0), ("we use an SPDX license for all files", "", 0.0), ("SPDX-License-Identifier: MIT and other text follows", "mit", 0.2),
    ("SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) OR LicenseRef-own", "classpath-exception-2.0,gpl-2.0-only,licenseref-own", 0.525),
    ("license expression = Apache-2.0", "apache-2.0", 0.2), ("SPDX-License-Identifier: see the file", "", 0.0), ("SPDX-License-Identifier: MITIGATED", "", 0.0)])
def test_only_licence_identifiers_are_operands(text, labels, score):
    got = licenses.scan(text.encode(), licenses.automaton())
    assert (got[5], pytest.approx(got[6])) == (labels, score)


@pytest.mark.parametrize("n", [4096, 65536])
def test_rows_of_a_key_group_do_not_grow_with_it(spark, n):
    """Fingerprints that agree in 22 bits, otherwise at random, with close partners planted."""
    rng = np.random.default_rng(n)
    fp = rng.integers(0, 2**63, n, np.uint64) << np.uint64(1) & np.uint64(2**64 - 2**22) | np.uint64(5)
    fp[1:101] = fp[101:201] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64)) ^ np.uint64(7 << 40)
    fp = np.unique(fp)
    df = spark.createDataFrame([(int(x), int(x)) for x in fp.view(np.int64)], "fp long, label long")
    cells = simhash.cells(df, simhash.MAX_BITS).cache()
    assert cells.count() <= 20 * n
    assert cells.groupBy("cell").count().agg(F.max("count")).first()[0] <= 2 * simhash.BLOCK
    got = {r.node for r in simhash.link_fingerprints(df.select("fp", F.lit(1).alias("weight"))).collect()}
    ordered = np.sort(fp)
    want = set()
    for lo in range(0, len(fp), 256):
        near = np.bitwise_count(ordered[lo:lo + 256, None] ^ ordered[None, :]) <= simhash.MAX_BITS
        want |= set(ordered[lo:lo + 256][near.sum(1) > 1].view(np.int64).tolist())
    assert got == want and len(want) >= 200


def test_keys_cover_every_choice_of_differing_bits():
    rng = np.random.default_rng(1)
    for limit in (0, 1, 4):
        keys = simhash.key_masks(limit)
        assert all(m & (2**64 - 1) == m & f & (2**64 - 1) for m, fine in keys for f in fine)
        for _ in range(2000):
            x = sum(1 << int(i) for i in rng.choice(64, limit, replace=False))
            assert any(not m & x and any(not f & x for f in fine) for m, fine in keys)
        # a finer key is found under whichever coarse key agrees
        assert all(any(not f & x for f in fine) for m, fine in keys if not m & x)
