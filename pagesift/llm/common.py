"""Shared helpers of the operators: staged tables, word spans and rolling hashes over bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.session import scratch_path

#: Stands for a null document id, so that ids can be compared and joined; sorts after every real id.
NULL_ID = 2**63 - 1
#: Bytes that are handled in one numpy pass; bounds temporaries for very long texts.
SEGMENT = 1 << 20


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared checkpoint folder and read it back (cuts the lineage)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def key_of(id_col: str):
    """The id as a non-null long (``NULL_ID`` for null)."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))


def id_of(key):
    """The inverse of ``key_of``."""
    return F.when(key != F.lit(NULL_ID), key)


def text_of(text_col: str):
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def digest_of(text_col: str):
    """The text's 128-bit digest as 16 bytes; with the id it names a row where ids are null or repeated."""
    return F.unhex(F.md5(text_of(text_col).cast("binary")))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc, k, d): the whole row as one struct, so that no column name of the table can clash, its key and its
    text's digest."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), key_of(id_col).alias("k"), digest_of(text_col).alias("d"))


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser over uint64 (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_table(seed: int, n: int = 256) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BYTE_TABLE = random_table(7)


_POWERS: dict = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` mod 2**64 for i < n at least (base is odd); kept per task."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n).bit_length())

        def run(b: int) -> np.ndarray:
            out = np.full(size, b & (2**64 - 1), np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        have = _POWERS[base] = run(base), run(pow(base, -1, 2**64))
    return have


def gram_hashes(x: np.ndarray, width: int, base: int) -> np.ndarray:
    """A position-independent 64-bit hash of every run of ``width`` consecutive values of ``x``."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(x) + 1)
    prefix = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up[: len(x)], out=prefix[1:])
    return mix((prefix[width:] - prefix[:n]) * down[:n])


_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def segments(text: bytes, size: int = SEGMENT):
    """Cuts a long text at white space into parts of about ``size`` bytes (a longer word stays whole)."""
    at, n = 0, len(text)
    while n - at > size:
        cut = max(text.rfind(c, at, at + size) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= at:
            found = [p for p in (text.find(c, at + size) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if p >= 0]
            if not found:
                break
            cut = min(found)
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the white-space-separated words (``[^\\x20\\x09-\\x0D]+``) of a UTF-8 text, in order."""
    parts = []
    for part in segments(text):
        b = np.frombuffer(part, np.uint8)
        if not len(b):
            continue
        edge = np.empty(len(b) + 2, bool)
        edge[0] = edge[-1] = True
        edge[1:-1] = _WHITE[b]
        turn = np.flatnonzero(edge[1:] != edge[:-1])
        start, end = turn[0::2], turn[1::2]
        if not len(start):
            continue
        up, down = powers(0x9E3779B97F4A7C15, len(b) + 1)
        prefix = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(BYTE_TABLE[b] * up[: len(b)], out=prefix[1:])
        raw = (prefix[end] - prefix[start]) * down[start]
        parts.append(mix(raw ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
