"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints within ``MAX_BITS`` bits are linked and components are formed.  Candidates meet in key groups: of
MAX_BITS + 2 blocks, two such fingerprints agree in at least two (``key_masks``).  Inside a group the fingerprints are
sorted by Gray rank and indexed: each node holds a mask of the bits that all fingerprints below share and their
pattern, so a query adds up differences on newly shared bits on its way down and drops a whole node once they
exceed the limit.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import digest_of, id_of, key_of, signed, stage, text_of
from .components import components

MAX_BITS = 4
SHINGLE = 4
#: Rows of one side of a cell: larger key groups are divided by more bits, then split into cells of two blocks each.
BLOCK = 4096
#: Children of a node of the index.
FANOUT = 8
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, every word shingle
    (repeats included; fewer words: the whole sequence) hashed by XXH64 (seed 42); a bit is 1 if set in over half of
    the hashes; no words: 0."""
    words = text.translate(_LOWER).split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], 42) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1:].tolist())]
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[lo:lo + (1 << 16)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * ones > len(hashes)).astype(np.uint64)).sum(dtype=np.uint64))


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                fps = np.array([fingerprint(t, shingle) for t in part.column(1).cast(pa.binary()).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(signed(fps)), *part.columns[2:]], names=["k", "fp", *part.schema.names[2:]])
    return run


def simhash(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (k, fp): the id (null: the largest long) and the fingerprint's bits as a signed long."""
    return docs.select(key_of(id_col).alias("k"), text_of(text_col).alias("t")).mapInArrow(_fingerprints(shingle), "k long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each value in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Levels of (shared mask, pattern) over fingerprints sorted by Gray rank; the leaves are the fingerprints."""

    def __init__(self, values: np.ndarray):
        self.order = np.argsort(gray_rank(values), kind="stable")
        v = values[self.order]
        full = np.full(len(v), 2**64 - 1, np.uint64)
        levels = [(full, v)]
        while len(levels[-1][1]) > FANOUT:
            mask, pattern = levels[-1]
            starts = np.arange(0, len(pattern), FANOUT)
            shared = np.bitwise_and.reduceat(mask, starts)
            base = np.repeat(pattern[starts], np.diff(np.append(starts, len(pattern))))
            shared &= ~np.bitwise_or.reduceat(pattern ^ base, starts)
            levels.append((shared, pattern[starts] & shared))
        # a child only adds the bits that its parent does not share yet
        self.levels = []
        for i, (mask, pattern) in enumerate(levels):
            above = levels[i + 1][0] if i + 1 < len(levels) else np.zeros(1, np.uint64)
            up = above[np.arange(len(mask)) // FANOUT] if i + 1 < len(levels) else np.zeros(len(mask), np.uint64)
            self.levels.append((mask & ~up, pattern))

    def search(self, queries: np.ndarray, limit: int):
        """(query index, value index) of all pairs within ``limit`` bits, in blocks of queries."""
        top = len(self.levels) - 1
        width = len(self.levels[top][1])
        for lo in range(0, len(queries), 2048):
            q = np.repeat(np.arange(lo, min(lo + 2048, len(queries))), width)
            node = np.tile(np.arange(width), len(q) // width)
            gone = np.zeros(len(q), np.uint8)
            for level in range(top, -1, -1):
                mask, pattern = self.levels[level]
                gone = gone + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
                near = gone <= limit
                q, node, gone = q[near], node[near], gone[near]
                if level and len(q):
                    below = len(self.levels[level - 1][1])
                    node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    q, gone = np.repeat(q, FANOUT), np.repeat(gone, FANOUT)
                    real = node < below
                    q, node, gone = q[real], node[real], gone[real]
            yield q, self.order[node]


def _link_cell(fp: np.ndarray, label: np.ndarray, side: np.ndarray, limit: int) -> list:
    """Links (u, v) that join the labels of one cell as all its pairs would, at most one a label less one."""
    names, at = np.unique(label, return_inverse=True)
    if len(names) < 2:
        return []
    two = side.max() != side.min()
    left, right = (np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())) if two else (np.arange(len(fp)),) * 2
    if not two:  # a pair of two labels has one end outside the largest
        left = np.flatnonzero(at != np.bincount(at).argmax())
    parent = list(range(len(names)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links, root = [], np.arange(len(names))
    index = GrayIndex(fp[right])
    for q, v in index.search(fp[left], limit):
        a, b = left[q], right[v]
        ra, rb = root[at[a]], root[at[b]]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if len(a):
            _, one = np.unique(np.minimum(ra, rb) * len(names) + np.maximum(ra, rb), return_index=True)
            for i in one.tolist():
                x, y = find(int(ra[i])), find(int(rb[i]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    links.append((int(fp[a[i]]), int(fp[b[i]])))
            root = np.array([find(i) for i in range(len(names))])
    return links


def _cells(limit: int):
    """Rows sorted by cell -> links.  A cell has at most two blocks; cells are never split over batches' ends."""
    def run(batches):
        held: list = []

        def flush(cols):
            cell, fp, label, side = cols
            starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            out = []
            for lo, hi in zip(starts.tolist(), np.append(starts[1:], len(cell)).tolist()):
                if hi - lo > 1:
                    out += _link_cell(fp[lo:hi], label[lo:hi], side[lo:hi], limit)
            e = np.array(out, np.uint64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(signed(e[:, 0].copy())), pa.array(signed(e[:, 1].copy()))], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy() for c in batch.columns]
            cols[1] = cols[1].view(np.uint64)
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if last:
                yield flush([np.concatenate([h[i] for h in held] + [cols[i][:last]]) for i in range(4)])
                held = []
            held.append([c[last:] for c in cols])
        if held:
            yield flush([np.concatenate([h[i] for h in held]) for i in range(4)])
    return run


def key_masks(limit: int) -> list[tuple[int, list[int]]]:
    """(mask, finer masks) of each key.  Of limit + 2 blocks of the 64 bits, two fingerprints within ``limit`` bits
    agree in at least two, so every pair of blocks is a key; of limit + 1 bands of a key's other bits they agree in
    at least one, so the key with each band is a finer one."""
    def mask(bits):
        m = sum(1 << i for i in bits)
        return m - 2**64 if m >= 2**63 else m

    def cut(bits, n):
        return [bits[len(bits) * i // n:len(bits) * (i + 1) // n] for i in range(n)]

    out = []
    for pair in combinations(cut(range(64), limit + 2), 2):
        own = [i for block in pair for i in block]
        rest = [i for i in range(64) if i not in own]
        out.append((mask(own), [mask(own + band) for band in cut(rest, limit + 1)]))
    return out


def _longs(values):
    return F.array(*[F.lit(v).cast("long") for v in values])


def _keyed(rows: DataFrame, limit: int) -> DataFrame:
    """Each row with every (key, value) of its fingerprint."""
    masks = _longs([m for m, _ in key_masks(limit)])
    keys = F.transform(masks, lambda m, i: F.struct(i.alias("key"), F.col("fp").bitwiseAND(m).alias("value")))
    return rows.withColumn("b", F.explode(keys)).select(*rows.columns, "b.key", "b.value")


def _open_groups(keyed: DataFrame) -> DataFrame:
    """(key, value, n) of the groups that still hold several components."""
    return (keyed.groupBy("key", "value").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"))
            .where("lo <> hi").select("key", "value", "n"))


def cells(labelled: DataFrame, limit: int) -> DataFrame:
    """Rows (fp, label) -> (cell, fp, label, side), such that any two within ``limit`` bits and of different labels
    meet in a cell of at most two blocks of ``BLOCK``.

    A key has 21 bits or more at four differing bits.  Groups of more than ``BLOCK`` are divided by the finer keys,
    which multiplies their rows by limit + 1 and divides their size by 2 to the band's width, however large they are.
    Only what is still larger, thousands of fingerprints alike in 29 bits, is cut into cells of two blocks."""
    keyed = _keyed(labelled, limit)
    finer = F.array(*[_longs(fine) for _, fine in key_masks(limit)])
    at = (limit + 1) * F.col("key") + (limit + 2) * (limit + 1) // 2
    divided = F.transform(F.get(finer, F.col("key")), lambda m, i: F.struct((at + i).alias("key"), F.col("fp").bitwiseAND(m).alias("value")))
    parts = F.when(F.col("n") > BLOCK, divided).otherwise(F.array(F.struct("key", "value")))
    rows = keyed.join(_open_groups(keyed), ["key", "value"]).select("fp", "label", F.explode(parts).alias("b")).select("fp", "label", "b.key", "b.value")
    rows = stage(rows, "simhash-open")
    groups = _open_groups(rows).select("key", "value", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(groups, ["key", "value"]).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(F.xxhash64("key", "value", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), "fp", "label",
                       F.when(F.col("block") == F.col("other"), 0).otherwise(F.signum(F.col("block") - F.col("other"))).cast("int").alias("side"))


def _distance(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def link_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows (fp, weight) of distinct fingerprints -> (node, component) of those with a partner within ``max_bits``.

    First every key group links its members to its heaviest fingerprint where they are within the limit: joins and
    aggregates only, so groups of near copies of one text collapse without comparing their members.  Then only key
    groups that still hold several components are searched, in cells that bound a task's memory; a cell sends back
    at most one link for each pair of components that it joins, never its pairs.
    """
    keyed = _keyed(fps.select("fp", "weight"), max_bits)
    hub = keyed.groupBy("key", "value").agg(F.max(F.struct("weight", "fp")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    hub = hub.select("key", "value", F.col("hub.fp").alias("hub"))
    near = keyed.join(hub, ["key", "value"]).where((F.col("fp") != F.col("hub")) & (_distance("fp", "hub") <= max_bits))
    first = stage(near.select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct(), "simhash-hubs")
    labels = components(first)

    labelled = fps.select("fp").join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("label"))
    labelled = stage(labelled, "simhash-labels")
    second = cells(labelled, max_bits).repartition("cell").sortWithinPartitions("cell").mapInArrow(_cells(max_bits), "u long, v long")
    known = labelled.where("fp <> label").select(F.col("fp").alias("u"), F.col("label").alias("v"))
    return components(known.unionByName(second))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fingerprint, component_id): 16 hex digits and the smallest id reachable over links of at most
    ``max_bits`` differing bits, itself included.

    Exact copies and equal fingerprints are one row for the links.  Null text or text without words has fingerprint
    zero, linked like any other; null ids sort last (a component of null ids only has a null id); repeated rows give
    repeated results; an empty table gives no rows; other columns are not read.
    """
    fps = stage(simhash(docs, shingle, id_col, text_col), "simhash")
    distinct = stage(fps.groupBy("fp").agg(F.min("k").alias("first"), F.count("*").alias("weight")), "simhash-distinct")
    linked = link_fingerprints(distinct.select("fp", "weight"), max_bits)
    named = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    lowest = named.groupBy("component").agg(F.min("first").alias("c"))
    named = named.join(lowest, "component").select("fp", "c")
    return fps.join(named, "fp").select(id_of(F.col("k")).alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                        id_of(F.col("c")).alias("component_id"))


def first_rows(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (k, d), one per component: key and text digest of its row with the smallest id, then the smallest digest.
    Components are those of ``near_duplicates``, told apart by their fingerprints, so null and repeated ids in
    different components do not meet."""
    rows = docs.select(key_of(id_col).alias("k"), text_of(text_col).alias("t"), digest_of(text_col).alias("d"))
    fps = stage(rows.mapInArrow(_fingerprints(shingle), "k long, fp long, d binary"), "simhash")
    distinct = stage(fps.groupBy("fp").agg(F.min(F.struct("k", "d")).alias("first"), F.count("*").alias("weight")), "simhash-distinct")
    linked = link_fingerprints(distinct.select("fp", "weight"), max_bits)
    named = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("first", F.coalesce("component", "fp").alias("component"))
    return named.groupBy("component").agg(F.min("first").alias("first")).select("first.k", "first.d")
