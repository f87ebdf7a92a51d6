"""Document fingerprints by content-defined chunking.

A gear hash over the last ``SPAN`` bytes decides chunk ends; normalised chunking asks for more zero bits before the
normal size and for fewer after it, so sizes gather around it.  Ends depend on nearby bytes alone, so an insertion
shifts chunks without changing those beyond it.  A fingerprint is the set of chunk digests with their lengths;
containment is the share of one text's set, by length, that the other has.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEGMENT, id_of, key_of, random_table, shuffle_partitions, text_of

#: Bytes that the gear hash sees; least, normal and largest chunk; zero bits asked for before and after the normal size.
SPAN, LEAST, NORMAL, MOST = 16, 16, 64, 255
STRICT, LOOSE = 7, 5
_GEAR = (random_table(11) >> np.uint64(32)).astype(np.uint32)


def _ends(data: bytes) -> tuple[list, list]:
    """Positions after which a chunk may end: by the strict and by the loose rule."""
    strict, loose = [], []
    for lo in range(0, len(data), SEGMENT):
        from_ = max(0, lo - SPAN)
        h = _GEAR[np.frombuffer(data, np.uint8, min(len(data), lo + SEGMENT) - from_, from_)]
        step = 1
        while step < SPAN:  # h_i = sum of gear[b_(i-k)] << k for k < SPAN, by doubling
            shifted = np.zeros_like(h)
            shifted[step:] = h[:-step] << np.uint32(step) if len(h) > step else 0
            h = h + shifted
            step *= 2
        h = (h >> np.uint32(SPAN - 8))[lo - from_:]
        at = np.flatnonzero((h & np.uint32((1 << LOOSE) - 1)) == 0)
        loose += (at + lo + 1).tolist()
        strict += (at[(h[at] & np.uint32((1 << STRICT) - 1)) == 0] + lo + 1).tolist()
    return strict, loose


def chunks(data: bytes) -> list[bytes]:
    strict, loose = _ends(data)
    out, at, n = [], 0, len(data)
    while n - at > LEAST:
        i = bisect_left(strict, at + LEAST)
        if i < len(strict) and strict[i] <= at + NORMAL:
            end = strict[i]
        else:
            i = bisect_left(loose, at + NORMAL)
            end = min(loose[i] if i < len(loose) else n, at + MOST, n)
        out.append(data[at:end])
        at = end
    if at < n:
        out.append(data[at:])
    return out


def chunk_set(data: bytes) -> dict:
    """Digest (40 bits) -> length of the distinct chunks."""
    digest = xxhash.xxh3_64_intdigest
    return {digest(c) >> 24: len(c) for c in chunks(data)}


def write_set(s: dict) -> str:
    """Sorted chunks, each 10 hex digits of digest and 2 of length."""
    return "".join([f"{d:010x}{s[d]:02x}" for d in sorted(s)])


def read_set(fingerprint: str) -> dict:
    return {int(fingerprint[i:i + 10], 16): int(fingerprint[i + 10:i + 12], 16) for i in range(0, len(fingerprint), 12)}


def containment(a: dict, b: dict) -> float:
    """The share of ``a``'s chunks, weighted by length, that ``b`` has; of an empty set 1 if both are empty, else 0."""
    total = sum(a.values())
    if not total:
        return 0.0 if b else 1.0
    return sum([n for d, n in a.items() if d in b]) / total


_SCHEMA = ("k long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def _compare(batches):
    """Rows sorted within their range, each range ended by a guest (the document after it)."""
    last, out = None, []

    def done(cur, nxt_text, nxt_set):
        k, text, own = cur
        n = len(text)
        cut = n // 4
        edited = (text[: n - cut] + nxt_text[:cut]).encode("utf-8", "surrogatepass")
        es = chunk_set(edited) if cut else own
        return (k, n, hashlib.sha256(edited).hexdigest(), write_set(own), write_set(es), containment(own, es), containment(own, nxt_set))

    def table(rows):
        cols = list(zip(*rows))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                          names=[c.split()[0] for c in _SCHEMA.split(", ")])

    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            for k, text, guest in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                own = chunk_set(text.encode("utf-8", "surrogatepass"))
                if last is not None:
                    out.append(done(last, text, own))
                last = None if guest else (k, text, own)
            if out:
                yield table(out)
                out = []


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has the last quarter of the code points (rounded down) replaced by as many, or all, of the first
    of the next document in ascending id order; the last document is followed by the first.  ``near_*`` are the
    containment of the text's fingerprint in the edited text's and in the next document's.

    Documents are dealt into ranges of (id, text hash, place in the input) at quantiles (four a shuffle partition,
    searched by bisection in the expression), so one id or one text may fill any number of them, and sorted there, so the next document is the next row; the first document of each range, one row,
    also goes to the end of the range before.  The text is shuffled once.

    Null text is empty (one empty set), null ids come last, equal ids are ordered by text hash, repeated rows are
    separate documents, a single document is its own next, an empty table gives no rows, other columns are not read.
    """
    spark = docs.sparkSession
    # repeated rows are told apart by their place in the input
    rows = docs.select(key_of(id_col).alias("k"), text_of(text_col).alias("text")).select("k", F.xxhash64("text").alias("h"), F.xxhash64(F.monotonically_increasing_id()).alias("u"), "text")
    cuts = _cuts(rows.select("k", "h"), 4 * shuffle_partitions(spark))
    depth = max(1, len(cuts).bit_length())
    padded = F.array(*[F.struct(*[F.lit(x).cast("long").alias(n) for x, n in zip(c, "khu")]) for c in cuts + [(_END,) * 3] * (2**depth - len(cuts))])
    step = F.sequence(F.lit(depth - 1), F.lit(0), F.lit(-1))
    place = F.struct("k", "h", "u")
    bucket = F.aggregate(step, F.lit(0), lambda at, s: F.when(F.element_at(padded, F.call_function("shiftleft", F.lit(1), s) + at) < place,
                                                            F.call_function("shiftleft", F.lit(1), s) + at).otherwise(at))
    rows = rows.withColumn("bucket", bucket if cuts else F.lit(0))
    # one row per range: the document that the range before it ends with
    firsts = sorted(tuple(r) for r in rows.groupBy("bucket").agg(F.min(place).alias("m")).select("bucket", "m.*").collect())
    guests = [(*m, firsts[i - 1][0]) for i, (_, *m) in enumerate(firsts)]
    guests = spark.createDataFrame(guests, "gk long, gh long, gu long, before int")
    rows = rows.join(F.broadcast(guests), (F.col("k") == F.col("gk")) & (F.col("h") == F.col("gh")) & (F.col("u") == F.col("gu")), "left")
    seat = F.when(F.col("before").isNull(), F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("g")))).otherwise(
        F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("g")), F.struct(F.col("before").alias("b"), F.lit(True).alias("g"))))
    rows = rows.select("k", "h", "u", "text", F.explode(seat).alias("s")).select("k", "h", "u", "text", "s.b", "s.g")
    out = rows.repartition("b").sortWithinPartitions("b", "g", "k", "h", "u").select("k", "text", "g").mapInArrow(_compare, _SCHEMA)
    return out.select(id_of(F.col("k")).alias(id_col), *[c.split()[0] for c in _SCHEMA.split(", ")[1:]])


_END = 2**63 - 1


def _cuts(keys: DataFrame, ranges: int) -> list[tuple[int, int, int]]:
    """At most ``ranges`` cuts (id, text hash, place) at quantiles.  An id that fills several ranges (null ids, a repeated id) is
    cut at quantiles of its text hashes, and a hash that fills several of these (copies) at even steps of the place."""
    def quantiles(c, n):
        return F.percentile_approx(c, [i / n for i in range(1, n)], 100 * n)

    at = keys.agg(quantiles("k", ranges).alias("c")).first()["c"] or []
    share = {k: at.count(k) for k in set(at)}
    heavy = {k: n for k, n in share.items() if n > 1}
    cuts = [(k, _END, _END) for k in share]
    if heavy:
        inside = keys.where(F.col("k").isin(list(heavy))).groupBy("k").agg(quantiles("h", ranges).alias("c")).collect()
        for r in inside:
            n = heavy[r["k"]] + 1
            hashes = [r["c"][i * len(r["c"]) // n] for i in range(1, n)]
            for h in set(hashes):
                m = hashes.count(h)
                cuts += [(r["k"], h, _END)] + [(r["k"], h, -(2**63) + j * 2**64 // m) for j in range(1, m)]
    return sorted(set(cuts))
