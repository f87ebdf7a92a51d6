"""Tokens of many texts cut together, and the network's blocked steps, against plain versions."""

import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pagesift.llm import lm


def plain_tokens(text):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))] + [lm.END]


TEXTS = ["", " \n\t ", "One", " a B\x0bc\x0cD\re ", "\x1c x\x85y   É z", "a a a", "", "\x00 b\x00c", "end "]


@pytest.mark.parametrize("texts", [TEXTS, [""], [" "], ["", ""], ["x"], TEXTS[::-1]])
def test_tokens_of_texts_cut_together(texts):
    words, at, ends = lm.tokens([t.encode() for t in texts])
    words = words.to_pylist()
    assert len(set(words)) == len(words)
    got = [[words[i] for i in at[a:b]] for a, b in zip([0, *ends], ends)]
    assert got == [plain_tokens(t) for t in texts]


def _batch(texts):
    return pa.RecordBatch.from_arrays([pa.array([t.encode() for t in texts], pa.string())], names=["t"])


def _counted(batches):
    seen = Counter()
    for b in lm._count(batches):
        for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            seen[w] += c
    return seen


@pytest.mark.parametrize("cut,held", [(1 << 22, 1 << 24), (50, 64), (1, 1)])
def test_counts_merged_in_parts(monkeypatch, cut, held):
    monkeypatch.setattr(lm, "_CUT", cut)
    monkeypatch.setattr(lm, "_HELD", held)
    texts = TEXTS + [f"w{i % 7} v{i} W{i % 3}" for i in range(300)]
    assert _counted([_batch(texts[:100]), _batch([]), _batch(texts[100:])]) == Counter(w for t in texts for w in plain_tokens(t))


def test_counting_takes_less_time_than_a_python_counter():
    rng = np.random.default_rng(0)
    texts = [" ".join(f"word{i}" for i in np.minimum(rng.zipf(1.2, 400), 10**9)) for _ in range(2000)]
    batch = _batch(texts)

    def cpu(run):
        best = np.inf
        for _ in range(3):
            start = time.process_time()
            run()
            best = min(best, time.process_time() - start)
        return best

    def plain():
        seen = Counter()
        for t in batch.column(0).cast(pa.binary()).to_pylist():
            seen.update(t.lower().split() + [lm.END])
        return seen

    assert cpu(lambda: list(lm._count([batch]))) < 0.85 * cpu(plain)


@pytest.mark.parametrize("scale", [0.3, 30.0])  # logits that need no shift, and logits that do
def test_scores_equal_plain_steps(scale):
    """Texts in lanes, states carried over windows and documents, against one step a token in double precision."""
    rng = np.random.default_rng(1)
    net = lm.Network([200 - i for i in range(120)], 50)
    for k in ("cw", "ow", "b"):
        net.p[k] = rng.normal(0, scale if k != "b" else 0.3, net.p[k].shape).astype(np.float32)
    docs = [rng.integers(0, 121, n).astype(np.int32) for n in [1, 2, 70, 5, 1, 33, *rng.integers(1, 40, 700)]]
    got = net.score(docs)
    p, H, size = {k: x.astype(np.float64) for k, x in net.p.items()}, lm.HIDDEN, lm.CLASS_SIZE

    def log_softmax(x, i):
        return x[i] - x.max() - np.log(np.exp(x - x.max()).sum())

    for i in (*range(6), *rng.integers(6, len(docs), 20)):
        h, before, want = np.zeros(H), -1, 0.0
        for token in docs[i]:
            x = p["emb"][before] @ p["wx"] + p["b"]
            z, r = np.split(1 / (1 + np.exp(-(x[:2 * H] + h @ p["wh"][:, :2 * H]))), 2)
            n = np.tanh(x[2 * H:] + (r * h) @ p["wh"][:, 2 * H:])
            h = n + z * (h - n)
            c = token // size if token < 120 else net.classes
            want += log_softmax(h @ p["cw"] + p["cb"], c)
            if c < net.classes:
                want += log_softmax(h @ p["ow"][c] + p["ob"][c], token % size)
            before = token
        assert got[i] == pytest.approx(want, rel=1e-4, abs=1e-3)
