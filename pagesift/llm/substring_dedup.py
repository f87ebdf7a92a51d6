"""Substring de-duplication by difference-cover anchors.

A window of ``WINDOW`` words that also starts in a document with a smaller id is removed there.  Hashing every
window of every document would move a row for each word of the corpus.  Instead only the ``ANCHOR``-word grams
that start at positions of a difference cover modulo ``PERIOD`` are hashed (6 of 31 positions): for any two
positions i, j there is a shift k < PERIOD so that i + k and j + k are both cover positions, hence two equal
windows of WINDOW >= PERIOD - 1 + ANCHOR words always share an aligned anchor.  Anchors that occur in two different
texts are then extended: the full windows around them are hashed and compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import gram_hashes, id_of, key_of, mix, signed, text_of, word_hashes

WINDOW = 50
PERIOD = 31
#: A perfect difference set modulo 31: every residue is a difference of two members.
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
_BASE1, _BASE2, _BASE3 = 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5
#: Rows that a task gathers before it groups them; bounds a task's memory, not what is found.
_CHUNK = 1_500_000


def _bytes(column) -> list:
    return column.cast(pa.binary()).to_pylist()


def _runs(order_key: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a sorted array."""
    return np.flatnonzero(np.concatenate(([True], order_key[1:] != order_key[:-1]))) if len(order_key) else np.zeros(0, np.int64)


def _spread(per_run: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(per_run, np.diff(np.append(starts, n)))


def _salted(h, k):
    """Another hash for each document, so that settled places of one hash spread over all partitions."""
    return signed(h.view(np.uint64) ^ mix(k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


# ---- anchors -------------------------------------------------------------------------------------------------

_ANCHOR_SCHEMA = "h long, th long, k long, pos int, sure boolean"


def _anchor_rows(h, th, k, pos):
    """Of the anchors of one chunk, what the other chunks must know.

    An anchor seen here in two different texts is settled: its places go out as sure, with two marker rows (two
    texts) for its hash.  One seen in a single text goes out once, for the smallest id that has the text.
    So a very frequent anchor sends a few rows per chunk to its hash's partition, whatever its count.
    """
    order = np.argsort(h, kind="stable")
    h, th, k, pos = h[order], th[order], k[order], pos[order]
    starts = _runs(h)
    n = len(h)
    low, high = np.minimum.reduceat(th, starts), np.maximum.reduceat(th, starts)
    mixed = low != high
    is_mixed = _spread(mixed, starts, n)
    own = ~is_mixed & (k == _spread(np.minimum.reduceat(k, starts), starts, n))
    sure = is_mixed
    salt = _salted(h[sure], k[sure])
    mh = h[starts][mixed]
    m = len(mh)
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([h[own], salt, mh, mh])),
        pa.array(np.concatenate([th[own], th[sure], low[mixed], high[mixed]])),
        pa.array(np.concatenate([k[own], k[sure], np.zeros(2 * m, np.int64)])),
        pa.array(np.concatenate([pos[own], pos[sure], np.full(2 * m, -1, np.int32)]).astype(np.int32)),
        pa.array(np.concatenate([np.zeros(own.sum(), bool), np.ones(sure.sum(), bool), np.zeros(2 * m, bool)])),
    ], names=["h", "th", "k", "pos", "sure"])


def _anchors(batches):
    parts, size = [], 0
    for batch in batches:
        ks, ths, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        for lo in range(0, batch.num_rows, 256):
            for i, text in enumerate(_bytes(texts.slice(lo, 256)), lo):
                grams = gram_hashes(word_hashes(text), ANCHOR, _BASE1)
                if len(grams) < WINDOW - ANCHOR + 1:
                    continue
                at = np.arange(len(grams), dtype=np.int32)
                at = at[_IN_COVER[at % PERIOD]]
                parts.append((signed(grams[at]), np.full(len(at), ths[i]), np.full(len(at), ks[i]), at))
                size += len(at)
                if size >= _CHUNK:
                    yield _anchor_rows(*map(np.concatenate, zip(*parts)))
                    parts, size = [], 0
    if parts:
        yield _anchor_rows(*map(np.concatenate, zip(*parts)))


_IN_COVER = np.zeros(PERIOD, bool)
_IN_COVER[list(COVER)] = True


# ---- windows -------------------------------------------------------------------------------------------------

_WINDOW_SCHEMA = "h long, g int, th long, k long, at array<int>, sure boolean"


def _window_rows(h, g, th, k, pos):
    """Windows of one chunk: those after the smallest id here are sure; only the smallest id's go to other chunks.
    A window that one document repeats is one row with all its places."""
    order = np.lexsort((g, h))
    h, g, th, k, pos = h[order], g[order], th[order], k[order], pos[order].astype(np.int32)
    starts = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]))))
    sure = k > _spread(np.minimum.reduceat(k, starts), starts, len(h))
    own = np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (k[1:] != k[:-1]) | (th[1:] != th[:-1])))
    first = np.flatnonzero(own)
    h = h.copy()
    h[sure] = _salted(h[sure], k[sure])
    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(h)).astype(np.int32)), pa.array(pos))
    return pa.RecordBatch.from_arrays([*[pa.array(x[first]) for x in (h, g, th, k)], places, pa.array(sure[first])],
                                      names=["h", "g", "th", "k", "at", "sure"])


def _windows(batches):
    parts, size = [], 0
    for batch in batches:
        ks, ths, texts, found = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2), batch.column(3)
        for lo in range(0, batch.num_rows, 256):
            places = found.slice(lo, 256).to_pylist()
            for i, text in enumerate(_bytes(texts.slice(lo, 256)), lo):
                words = word_hashes(text)
                n = len(words) - WINDOW + 1
                if n <= 0:
                    continue
                anchors = np.unique(np.asarray(places[i - lo], np.int64))
                # every window [s, s + WINDOW) that holds a whole anchor
                turn = np.zeros(n + 1, np.int64)
                np.add.at(turn, np.clip(anchors - (WINDOW - ANCHOR), 0, n), 1)
                np.add.at(turn, np.clip(anchors + 1, 0, n), -1)
                at = np.flatnonzero(np.cumsum(turn[:-1]) > 0)
                if not len(at):
                    continue
                h, g = gram_hashes(words, WINDOW, _BASE2), gram_hashes(words, WINDOW, _BASE3)
                parts.append((signed(h[at]), (g[at] >> np.uint64(33)).astype(np.int32), np.full(len(at), ths[i]), np.full(len(at), ks[i]), at))
                size += len(at)
                if size >= _CHUNK:
                    yield _window_rows(*map(np.concatenate, zip(*parts)))
                    parts, size = [], 0
    if parts:
        yield _window_rows(*map(np.concatenate, zip(*parts)))


# ---- removal -------------------------------------------------------------------------------------------------

_RESULT_SCHEMA = "k long, text_hash long, n_words long, n_removed long, kept_sha256 string, kept string"


def _remove(with_text: bool):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out = []
                for text, starts, copy in zip(_bytes(part.column(2)), part.column(3).to_pylist(), part.column(4).to_pylist()):
                    words = text.split()
                    n = len(words)
                    if copy and n >= WINDOW:
                        kept, removed = b"", n
                    elif starts:
                        turn = np.zeros(n + 1, np.int64)
                        at = np.unique(np.asarray(starts, np.int64))
                        np.add.at(turn, at, 1)
                        np.add.at(turn, at + WINDOW, -1)
                        gone = np.cumsum(turn[:-1]) > 0
                        kept, removed = b" ".join([w for w, x in zip(words, gone.tolist()) if not x]), int(gone.sum())
                    else:
                        kept, removed = b" ".join(words), 0
                    body = (kept if removed else text).decode("utf-8", "replace") if with_text else None
                    out.append((n, removed, hashlib.sha256(kept).hexdigest(), body))
                cols = list(zip(*out)) if out else [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())],
                    names=["k", "text_hash", "n_words", "n_removed", "kept_sha256", "kept"])
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Rows (id, text_hash, n_words, n_removed, kept_sha256, kept): every word covered by a window of 50 words that also starts
    in a document with a smaller id is removed.  ``kept`` is the text unchanged where nothing is removed, else the
    kept words joined by one space (null with ``with_text=False``).

    Exact copies of a text (128-bit digest) lose all words if they have a whole window, and only the first copy is
    extended.  Anchor and window rows are grouped within each task before the shuffle (``_anchor_rows``,
    ``_window_rows``), so a passage that a third of all documents share sends a few rows per task to its hash.  The
    text is shuffled once, by document; both passes read that exchange.

    Null text has no words, null ids sort last and are not "smaller" than each other, repeated rows with one id and
    text do not remove each other, texts under 50 words stay, an empty table gives no rows, other columns are not
    read.
    """
    rows = docs.select(key_of(id_col).alias("k"), text_of(text_col).alias("text"))
    texts = rows.select("k", F.xxhash64("text").alias("th"), "text")

    digests = rows.select("k", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), F.xxhash64("text").alias("th"))
    first = digests.groupBy("digest").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first < last")
    copies = (digests.join(first, "digest").where("k > first").select("k", "th").distinct().withColumn("copy", F.lit(True)))

    anchors = texts.mapInArrow(_anchors, _ANCHOR_SCHEMA)
    by_hash = Window.partitionBy("h")
    shared = (anchors.withColumn("low", F.min("th").over(by_hash)).withColumn("high", F.max("th").over(by_hash))
              .where("pos >= 0 and (sure or low <> high)").select("k", "th", "pos"))
    found = shared.groupBy("k", "th").agg(F.collect_list("pos").alias("places")).join(copies, ["k", "th"], "left_anti")

    by_doc = texts.repartition("k", "th")
    windows = by_doc.join(found, ["k", "th"]).select("k", "th", "text", "places").mapInArrow(_windows, _WINDOW_SCHEMA)
    by_window = Window.partitionBy("h", "g")
    repeats = (windows.withColumn("low", F.min("k").over(by_window)).where("sure or k > low")
               .groupBy("k", "th").agg(F.flatten(F.collect_list("at")).alias("starts")))

    marks = (repeats.select("k", "th", "starts", F.lit(False).alias("copy"))
             .unionByName(copies.select("k", "th", F.lit(None).cast("array<int>").alias("starts"), "copy")))
    out = by_doc.join(marks, ["k", "th"], "left").select("k", "th", "text", "starts", "copy").mapInArrow(_remove(with_text), _RESULT_SCHEMA)
    return out.select(id_of(F.col("k")).alias(id_col), "text_hash", "n_words", "n_removed", "kept_sha256", "kept")
