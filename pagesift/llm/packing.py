"""Best-fit packing of token pieces into sequences, planned on the length histogram."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_of, key_of, stage, text_of

CAPACITY = 2048
END_ID = 0
#: Distinct spans of text that a Python worker keeps with their ids; further ones are encoded each time.
MEMO = 250_000


#: Fixed value: the pre-token pattern of the byte-level tokenizer.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNEVEN = re.compile(r" \s|\s ")


def _byte_of() -> dict:
    """The byte-level alphabet of such tokenizer files: printable Latin-1 characters stand for themselves, the other
    bytes, in order, for the code points from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class _Memo(dict):
    """Span of text -> its ids as little-endian unsigned 32-bit bytes.

    Spans of letters below U+0250 (whose character classes no library version changes) are encoded by ``tiktoken``
    with the file's own vocabulary as ranks, four times as fast and with the same ids; all others by ``tokenizers``.
    """

    def __init__(self, path: str):
        super().__init__()
        import tiktoken

        self.path, self.tokenizer = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_of()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("spans", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, span: str) -> bytes:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
            self.tokenizer.encode_special_tokens = True
        return np.array(self.tokenizer.encode(span, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, span):
        n = len(span)
        out = array("I", self.fast(span)).tobytes() if n < 1000 and max(span) < "\u0250" else self.ids(span)
        if n < 64 and len(self) < MEMO:
            self[span] = out
        return out


def encode(memo: _Memo, text: str) -> bytes:
    """The ids of a text.  The byte-level pre-tokeniser always starts a token at a single space between two other
    characters that are not white space, so the text is cut there and each span is encoded (or remembered) alone; a
    text with other white space next to a space, or a space at an end, is cut only where the rule holds."""
    if not text:
        return b""
    if text[0] != " " and text[-1] != " " and "\0" not in text and not _UNEVEN.search(text):
        return b"".join(map(memo.__getitem__, text.replace(" ", "\0 ").split("\0")))
    spans = text.split(" ")
    out, held = [], spans[0]
    for span in spans[1:]:
        if held and span and not held[-1].isspace() and not span[0].isspace():
            out.append(memo[held])
            held = " " + span
        else:
            held += " " + span
    out.append(memo[held])
    return b"".join(out)


_PIECES = "k long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        memo = _Memo(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part, out = batch.slice(lo, 512), []
                for k, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encode(memo, text) + end
                    n = len(ids) // 4
                    first = n % capacity or min(n, capacity)
                    bounds = [0, *range(first, n + 1, capacity)]
                    out += [(k, i, a, b - a, zlib.crc32(ids[4 * a:4 * b])) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]
                cols = list(zip(*out)) if out else [[]] * 5
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[c.split()[0] for c in _PIECES.split(", ")])
    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (k, piece, start, length, ids_crc32): token ids and ``end_id``, cut into pieces of ``capacity`` where
    longer (the first piece takes the remainder)."""
    return docs.select(key_of(id_col).alias("k"), text_of(text_col).alias("t")).mapInArrow(_cut(tokenizer, capacity, end_id), _PIECES)


def plan_best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, rank_from, rank_to, sequence, offset).

    The pieces of one length with ranks in [rank_from, rank_to) go, one each, to the sequences from ``sequence`` on,
    at ``offset``.  Open sequences with equal contents are one group (free space, first sequence, how many), so work
    and plan follow the number of lengths and groups, not of documents.
    """
    plan, groups, free, made = [], {}, [], 0  # groups: free space -> [(first, count)]

    def add(space, first, count):
        if count and space:
            if space not in groups:
                groups[space] = []
                insort(free, space)
            groups[space].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect_left(free, length)
            if i == len(free):
                # as many empty sequences as the rest needs at this length alone
                count = -(-left // (capacity // length))
                add_first, made = made, made + count
                space, first = capacity, add_first
            else:
                space = free[i]
                first, count = groups[space].pop()
                if not groups[space]:
                    del groups[space]
                    free.pop(i)
            take = min(left, count)
            plan.append((length, rank, rank + take, first, capacity - space))
            add(space, first + take, count - take)
            add(space - length, first, take)
            rank, left = rank + take, left - take
    return plan


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, sequence_id, offset).

    Pieces are written once as narrow rows.  The driver sees only the histogram (at most ``capacity`` rows) and plans
    best-fit on it; each piece then takes the planned slot of its rank within its length.  Ranks come from
    per-partition counts plus a rank within the partition, so a frequent length is not one window.  The plan (broadcast)
    has at most some rows per length and group of equal sequences, whatever the number of documents.

    Null and empty texts are one piece of the end id alone; repeated rows are separate documents; null ids stay null;
    an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = stage(pieces(docs, tokenizer, capacity, end_id, id_col, text_col).withColumn("part", F.spark_partition_id()), "pieces")
    counts = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(plan_best_fit(histogram, capacity) or [], "length long, rank_from long, rank_to long, first long, offset long")
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "part").orderBy("k", "piece", "ids_crc32")
    ranked = (rows.withColumn("r", F.row_number().over(order) - 1).join(before, ["length", "part"])
              .withColumn("rank", F.col("before") + F.col("r")))
    placed = ranked.join(F.broadcast(plan.withColumnRenamed("length", "l")),
                         (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    return placed.select(id_of(F.col("k")).alias(id_col), "piece", "start", "length", "ids_crc32",
                         (F.col("first") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset")
