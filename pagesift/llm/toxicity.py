"""Toxicity: bags of subword embeddings, averaged into a linear softmax, trained jointly.

Every word gives its own vector and those of its character n-grams (with word-boundary marks), hashed into
``BUCKETS`` rows, so a misspelt word shares most of its vectors with the words it resembles.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, segments, text_of

BUCKETS = 1 << 18
DIM = 8
NGRAMS = (3, 4, 5)
#: Most labelled documents of each class that training sees (the lowest id hashes); the fit's only bound.
SAMPLE_PER_CLASS = 4000
#: Passes over the sample: enough for ``STEPS`` updates, from 3 to 30.
STEPS = 15_000
#: Zero vectors averaged into every text, so that a few words alone do not decide.
BLANKS = 100
_P = 0x9E3779B97F4A7C15


def features(text: str) -> np.ndarray:
    """Bucket numbers of all words and character n-grams of a lower-cased text (one segment), repeats included."""
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    c[(c >= 9) & (c <= 13)] = 32
    white = c == 32
    coded = mix(c + np.uint64(1))
    out = []
    for n in NGRAMS:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        inner = np.zeros(m, bool)
        for i in range(n):
            h = h * np.uint64(_P) + coded[i:i + m]
            if 0 < i < n - 1:
                inner |= white[i:i + m]
        ok = ~inner
        if n == 3:
            ok &= ~(white[:m] & white[2:])  # one letter between marks says nothing of a word
        out.append(mix(h[ok]))
    turn = np.flatnonzero(white[1:] != white[:-1])
    start, end = turn[0::2] + 1, turn[1::2] + 1
    if len(start):
        up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(c), 0xC2B2AE3D27D4EB4F, np.uint64))))
        inv = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(c), pow(0xC2B2AE3D27D4EB4F, -1, 2**64), np.uint64))))
        prefix = np.concatenate(([np.uint64(0)], np.cumsum(coded * up[:-1])))
        out.append(mix((prefix[end] - prefix[start]) * inv[start] ^ np.uint64(_P)))
    return (np.concatenate(out) % np.uint64(BUCKETS)).astype(np.int32) if out else np.zeros(0, np.int32)


def bag(text: str) -> np.ndarray:
    """The distinct buckets of a whole text, sorted.  Long texts are read segment by segment, so temporaries stay
    bounded; the result has at most ``BUCKETS`` values."""
    if len(text) <= 1 << 16:
        f = np.sort(features(text))
        return f[np.concatenate(([True], f[1:] != f[:-1]))] if len(f) else f
    seen = np.zeros(BUCKETS, bool)
    for part in segments(text.encode("utf-8", "surrogatepass"), 1 << 18):
        seen[features(part.decode("utf-8", "replace"))] = True
    return np.flatnonzero(seen).astype(np.int32)


def fit(bags: list, epochs: int | None = None, rate: float = 0.5, seed: int = 1) -> tuple[np.ndarray, float]:
    """Joint training of embeddings (BUCKETS x DIM) and the softmax layer by Adagrad, one document a step.

    ``bags``: (packed distinct buckets, label), unpacked one at a time.  Returns what scoring needs: the softmax's
    logit difference of each bucket's vector, and the bias.  No labelled documents: all logits and the bias are 0, so every score is 0.5.
    """
    if not bags:
        return np.zeros(BUCKETS, np.float32), 0.0
    epochs = epochs or max(3, min(30, STEPS // len(bags)))
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    emb_sq = np.full(BUCKETS, 1e-6, np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    out_sq, bias_sq = np.full((2, 1), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    out[0], out[1] = rng.normal(0, 0.1, (2, DIM))
    count = np.bincount([y for _, y in bags], minlength=2)
    weight = len(bags) / (2 * np.maximum(count, 1))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(bags)).tolist():
            packed, y = bags[i]
            at = _unpack(packed)
            share = np.float32(1 / (len(at) + BLANKS))
            vec = emb[at]
            mean = vec.sum(0) * share
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            g = p * weight[y]
            g_mean = g @ out
            g_out = np.outer(g, mean)
            out_sq += (g_out ** 2).mean(1, keepdims=True)
            bias_sq += g * g
            out -= 0.2 * step * g_out / np.sqrt(out_sq)
            bias -= 0.05 * step * g / np.sqrt(bias_sq)
            emb_sq[at] += share * share * float(g_mean @ g_mean) / DIM
            emb[at] = vec - (step * share / np.sqrt(emb_sq[at]))[:, None] * g_mean
    return (emb @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def score_text(text: str, logits: np.ndarray, bias: float) -> float:
    """Probability of label 1: the softmax of the averaged vectors, summed bucket by bucket."""
    at = bag(text)
    z = bias + float(logits[at].sum(dtype=np.float64)) / (len(at) + BLANKS)
    return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _pack(at: np.ndarray) -> bytes:
    """A sorted bag as compressed gaps, a third of its size on the way to the driver."""
    return zlib.compress(np.diff(at, prepend=0).astype("<i4").tobytes(), 1)


def _unpack(packed) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), "<i4"), dtype=np.int32)


def _bags(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([_pack(bag(t)) for t in part.column(2).to_pylist()], pa.binary())],
                                             names=["id", "y", "bag"])


def _fit(batches):
    """The whole sample -> one row of the model: ``BUCKETS`` logits and the bias."""
    bags = sorted((x, y) for batch in batches for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    logits, bias = fit(bags)
    yield pa.RecordBatch.from_arrays([pa.array([logits.tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["logits", "bias"])


def id_remainder(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus`` (null for a null id)."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", held_out_modulus: int = 5, per_class: int = SAMPLE_PER_CLASS,
          id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """Fits the model on the labelled documents whose id remainder is not 0: at most ``per_class`` of each label,
    those of the lowest id hashes.  Executors make the bags (at most BUCKETS numbers each, a few kB), and one task
    runs the numpy fit on that bounded sample; the driver receives the finished logits (1 MB).  Of repeated rows of
    an id the lowest bag is the example."""
    spark = docs.sparkSession
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
             .groupBy("id").agg(F.max("y").alias("y")).where(id_remainder("id", held_out_modulus) != 0).withColumn("h", F.xxhash64("id")))
    chosen = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy("h", "id").limit(per_class).select("id", "y").collect()]
    sample = spark.createDataFrame([(r["id"], r["y"]) for r in chosen], "id long, y int")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t")).join(F.broadcast(sample), "id")
    bags = rows.select("id", "y", "t").mapInArrow(_bags, "id long, y int, bag binary").groupBy("id", "y").agg(F.min("bag").alias("bag"))
    model = bags.select("bag", "y").repartition(1).mapInArrow(_fit, "logits binary, bias double").first()
    if model is None:  # no labelled documents
        return fit([])
    return np.frombuffer(bytes(model["logits"]), np.float32), model["bias"]


def _scores(logits: np.ndarray, bias: float):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                s = [score_text(t, logits, bias) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], names=["id", "score"])
    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score): the probability of label 1 for every whole text.  Null and empty texts have no features and
    get the bias alone; equal texts get equal scores; repeated rows are scored alike; null ids stay null; an empty
    table gives no rows; other columns are not read."""
    return docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t")).mapInArrow(
        _scores(*model), "id long, score double").withColumnRenamed("id", id_col)


def _keep(logits: np.ndarray, bias: float, at: int, threshold: float):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield part.filter(pa.array([score_text(t or "", logits, bias) < threshold for t in part.column(at).to_pylist()], pa.bool_()))
    return run


def reject(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns as they are."""
    return docs.mapInArrow(_keep(*model, docs.columns.index(text_col), threshold), docs.schema)
