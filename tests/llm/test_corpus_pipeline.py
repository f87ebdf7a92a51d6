"""Stages of the corpus pipeline on null and repeated ids against brute force."""

import collections

import numpy as np
import pytest

import corpus_pipeline
from pagesift.llm import simhash

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(rng.integers(0, 20, n), rng.integers(0, 30, n)))


LEAK = prose(900, 12)
ROWS = [(1, prose(1)), (2, prose(2)), (None, prose(2)), (None, prose(3)), (None, prose(4)), (None, prose(4)), (None, prose(5)), (6, prose(6)), (6, prose(7)), (6, prose(7)),
        (7, prose(8)), (5, prose(8).upper()), (8, None), (None, ""), (9, prose(10) + " " + LEAK), (9, prose(11)), (None, prose(12) + " " + LEAK), (None, prose(13)), (None, LEAK), (1, prose(14))]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(i, t, len(t or "")) for i, t in ROWS], "doc_id long, text string, n_chars long").repartition(3)


def bag(rows):
    return collections.Counter((r[0], r[1] or "") for r in rows)


def test_near_duplicates_keep_one_row_of_each_component(spark, documents):
    fp = [simhash.fingerprint((t or "").encode()) for _, t in ROWS]
    group = list(range(len(ROWS)))
    for a in range(len(ROWS)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= simhash.MAX_BITS:
                group = [group[b] if g == group[a] else g for g in group]
    members = collections.defaultdict(list)
    for g, row in zip(group, ROWS):
        members[g].append(row)
    out = corpus_pipeline.drop_near_duplicates(spark, documents, "")
    got = out.collect()
    assert out.columns == documents.columns
    assert len(got) == len(members)
    for rows in members.values():
        least = min((i is None, i or 0) for i, _ in rows)
        allowed = {(i, t or "") for i, t in rows if (i is None, i or 0) == least}
        assert sum(n for row, n in bag(got).items() if row in allowed) == 1, rows


def test_only_contaminated_rows_are_dropped(spark, documents, monkeypatch):
    bench = spark.createDataFrame([(1, LEAK)], "item_id long, text string")
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: bench)
    out = corpus_pipeline.drop_contaminated(spark, documents, "")
    assert out.columns == documents.columns
    assert bag(out.collect()) == bag(r for r in ROWS if LEAK not in (r[1] or ""))
