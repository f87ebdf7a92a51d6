"""Merkle dataset manifest: one hash tree per source under one root, every row with its proof and a recomputed root.

Trees have 16 children a node and are cut into superblocks of 256 consecutive leaves.  On the way up each superblock
is reduced to its top node, and the tops of a source are the next round's leaves, until one is left.  On the way down
the leaves of a superblock and the outer nodes that its proofs need are cogrouped in ``applyInPandas``, which finishes
the local reduction, joins the proofs and folds the leaves under test.  Each task sees one superblock, so neither a
large source nor a large number of sources meets in one place.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_of, key_of, stage

ARITY = 16
#: Levels of the tree that a superblock holds; it has ARITY ** BLOCK_LEVELS leaves.
BLOCK_LEVELS = 2
SUPERBLOCK = ARITY**BLOCK_LEVELS
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---- hashes ----------------------------------------------------------------------------------------------------

def node(children: list[bytes]) -> bytes:
    """The parent of some digests: sha256 of their lowercase hex texts, concatenated."""
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


def levels(n: int) -> int:
    """How often n nodes are halved ARITY-fold until one is left."""
    k = 0
    while n > 1:
        n, k = -(-n // ARITY), k + 1
    return k


def leaf(*fields) -> Column:
    """sha256 over the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its text (integers decimal)."""
    parts = []
    for f in fields:
        s = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _block(digests: list[bytes], n: int) -> list[list[bytes]]:
    """The levels of one superblock of a tree with n nodes on its lowest level."""
    out = [digests]
    for _ in range(min(BLOCK_LEVELS, levels(n))):
        below = out[-1]
        out.append([node(below[i:i + ARITY]) for i in range(0, len(below), ARITY)])
    return out


def _local_path(block: list[list[bytes]], i: int) -> bytes:
    """The proof of leaf i inside its superblock: for each level the place in the run, the number of siblings and
    their digests."""
    out = []
    for row in block[:-1]:
        lo = i - i % ARITY
        run = row[lo:lo + ARITY]
        out += [bytes((i - lo, len(run) - 1)), *run[:i - lo], *run[i - lo + 1:]]
        i //= ARITY
    return b"".join(out)


def fold(digest: bytes, path: bytes) -> bytes:
    """The top of a proof, recomputed from a leaf and the siblings."""
    at = 0
    while at < len(path):
        place, n = path[at], path[at + 1]
        mid, end = at + 2 + 32 * place, at + 2 + 32 * n
        digest = hashlib.sha256((path[at + 2:mid] + digest + path[mid:end]).hex().encode()).digest()
        at = end
    return digest


def siblings(path: bytes) -> bytes:
    """All sibling digests of a proof, level by level, left to right."""
    out, at = [], 0
    while at < len(path):
        end = at + 2 + 32 * path[at + 1]
        out.append(path[at + 2:end])
        at = end
    return b"".join(out)


# ---- positions -------------------------------------------------------------------------------------------------

def ranked(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``idx``, their place (from 0) among the rows of their group, and ``total``, the group's size.

    Rows are range-partitioned and sorted once; the counts of each partition's groups, summed over the partitions
    before, place every row, so a group may span any number of partitions."""
    cols = [F.col(c) for c in (*group, *order)]
    placed = rows.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("at", F.monotonically_increasing_id())
    placed = stage(placed, name)
    part = F.shiftright("at", 33)
    runs = placed.groupBy(*group, part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    ahead = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    every = Window.partitionBy(*group)
    runs = runs.select(*group, "part", (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(every).alias("total"))
    return placed.withColumn("part", part).join(runs, [*group, "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _celled(nodes: DataFrame, n: int) -> DataFrame:
    """``nodes`` (g, idx, total, ...) with the key of their superblock; those of small trees share cells of about a
    superblock's size.  Two superblocks that meet in one cell are told apart inside it."""
    cells = max(1, n // SUPERBLOCK)
    block = F.floor(F.col("idx") / SUPERBLOCK)
    return nodes.withColumn("cell", F.when(F.col("total") > SUPERBLOCK, F.xxhash64("g", block)).otherwise(F.pmod(F.xxhash64("g"), F.lit(cells))))


def _superblocks(pdf: pd.DataFrame):
    """The superblocks of one cell: (g, number, total, rows in order)."""
    if not len(pdf):
        return
    pdf = pdf.assign(block=pdf["idx"] // SUPERBLOCK).sort_values(["g", "idx"], kind="stable")
    for (g, b), rows in pdf.groupby(["g", "block"], sort=False):
        yield g, int(b), int(rows["total"].iloc[0]), rows


# ---- up --------------------------------------------------------------------------------------------------------

def _reduce(pdf: pd.DataFrame) -> pd.DataFrame:
    out = [(g, b, -(-n // SUPERBLOCK), _block(rows["d"].tolist(), n)[-1][0]) for g, b, n, rows in _superblocks(pdf)]
    return pd.DataFrame(out, columns=["g", "idx", "total", "d"])


def _climb(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The rounds of all trees: each round's nodes (g, idx, total, d), the last with one a tree."""
    rounds = [nodes]
    while True:
        n, most = rounds[-1].agg(F.count("*"), F.coalesce(F.max("total"), F.lit(0))).first()
        if most <= 1 and len(rounds) > 1:
            return rounds
        up = _celled(rounds[-1].select("g", "idx", "total", "d"), n).groupBy("cell").applyInPandas(_reduce, "g string, idx long, total long, d binary")
        rounds.append(stage(up, name))
        if most == 0:
            return rounds


# ---- down ------------------------------------------------------------------------------------------------------

def _outer_of(outer: pd.DataFrame) -> dict:
    return {(g, b): (p, s) for g, b, p, s in zip(outer["g"], outer["idx"], outer["path"], outer["subroot"])}


def _descend_cell(pdf: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Paths of the nodes of one cell: the local siblings, then those of the outer nodes."""
    above, out = _outer_of(outer), []
    for g, b, n, rows in _superblocks(pdf):
        path, sub = above.get((g, b), (b"", None))
        block = _block(rows["d"].tolist(), n)
        out += [(g, i, _local_path(block, i % SUPERBLOCK) + path, sub) for i in rows["idx"].tolist()]
    return pd.DataFrame(out, columns=["g", "idx", "path", "subroot"])


def _prove_cell(pdf: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Proofs of the leaves of one cell, and the root folded from the leaf under test."""
    above, out = _outer_of(outer), []
    for g, b, n, rows in _superblocks(pdf):
        path, sub = above[g, b]
        block = _block(rows["d"].tolist(), n)
        for k, i, d, test in zip(rows["k"].tolist(), rows["idx"].tolist(), rows["d"], rows["test"]):
            proof = _local_path(block, i % SUPERBLOCK) + path
            out.append((g, k, i, d, sub, proof, hashlib.sha256(siblings(proof).hex().encode()).hexdigest(), fold(d if test is None else test, proof)))
    return pd.DataFrame(out, columns=["g", "k", "idx", "d", "subroot", "proof", "proof_sha256", "folded"])


def _cogroup(nodes: DataFrame, outer: DataFrame, run, schema: str) -> DataFrame:
    """Nodes and the outer nodes of their superblocks (g, idx: the superblock's number, path, subroot), by cell."""
    n = nodes.count()
    cells = _celled(nodes, n)
    # a superblock's outer nodes go where its leaves are: its number is the place of its first leaf
    first = outer.join(nodes.where(F.col("idx") % SUPERBLOCK == 0).select("g", F.floor(F.col("idx") / SUPERBLOCK).alias("idx"), "total"), ["g", "idx"])
    keys = _celled(first.withColumn("idx", F.col("idx") * SUPERBLOCK), n).withColumn("idx", F.floor(F.col("idx") / SUPERBLOCK)).drop("total")
    return cells.groupBy("cell").cogroup(keys.groupBy("cell")).applyInPandas(run, schema)


def _descend(rounds: list[DataFrame], outer: DataFrame, to: int, name: str) -> DataFrame:
    """Outer nodes of round ``to`` - 1's superblocks, that is paths of round ``to``'s nodes, from those of the tops."""
    for r in range(len(rounds) - 2, to - 1, -1):
        outer = stage(_cogroup(rounds[r].select("g", "idx", "total", "d"), outer, _descend_cell, "g string, idx long, path binary, subroot binary"), name)
    return outer


# ---- the manifest ----------------------------------------------------------------------------------------------

def manifest(docs: DataFrame, tampered: Column | None = None, changed: Column | None = None, id_col: str = "doc_id", group_col: str = "source",
             other_cols: tuple = ("lang", "n_chars"), text_col: str = "text") -> DataFrame:
    """Rows (id, source, position, leaf, subroot, root, proof, proof_sha256, folded_root, verified), one per row of
    ``docs``.

    A leaf hashes id, source, the other columns and text.  Per source the leaves ascend by id, and every 16 consecutive nodes
    become one until one is left, the subroot; the subroots in ascending order of the source (UTF-8 bytewise) give
    the root likewise.  ``proof`` holds, level by level up to the root, the place in the run, the number of siblings
    and their digests (binary).  Where ``tampered`` holds, the folded root starts from the leaf with ``changed`` as its text, else from the leaf
    itself; ``verified`` says whether it is the root.

    Null sources are one tree, before all others (an empty source is another one).  Null ids come last within their
    source; rows of equal id are ordered by leaf; repeated rows are separate leaves.  Empty and null texts have
    different leaves.  An empty table gives no rows.  Columns not named are not read.
    """
    fields = [F.col(id_col), F.col(group_col), *[F.col(c) for c in other_cols]]
    test = F.lit(None).cast("binary")
    if tampered is not None:
        test = F.when(tampered, leaf(*fields, F.col(text_col) if changed is None else changed))
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))  # null first, then bytewise
    rows = docs.select(group.alias("g"), key_of(id_col).alias("k"), leaf(*fields, F.col(text_col)).alias("d"), test.alias("test"))
    leaves = stage(ranked(rows, ["g"], ["k", "d"], "merkle-rows"), "merkle-leaves")
    rounds = _climb(leaves, "merkle-up")

    subroots = rounds[-1].select("g", "d")
    tops = ranked(subroots.select(F.lit("").alias("one"), F.col("g").alias("of"), "d"), ["one"], ["of"], "merkle-subroots")
    tops = stage(tops.select(F.col("one").alias("g"), "idx", "total", "d", "of"), "merkle-tops")
    over = _climb(tops, "merkle-top-up")
    root = over[-1].select("d").first()
    if root is None:
        return docs.sparkSession.createDataFrame([], _OUT.format(id_col))
    none = over[-1].select("g", "idx", F.lit(b"").alias("path"), F.lit(None).cast("binary").alias("subroot"))
    paths = _descend(over, none, 0, "merkle-top-down")
    outer = tops.join(paths.select("idx", "path"), "idx").select(F.col("of").alias("g"), F.lit(0).cast("long").alias("idx"), "path", F.col("d").alias("subroot"))
    outer = _descend(rounds, outer, 1, "merkle-down")
    done = _cogroup(leaves, outer, _prove_cell, "g string, k long, idx long, d binary, subroot binary, proof binary, proof_sha256 string, folded binary")
    top = F.lit(bytes(root["d"]))

    def text(c):
        return F.lower(F.hex(c))

    return done.select(id_of(F.col("k")).alias(id_col), F.when(F.col("g") != "", F.expr("substring(g, 2)")).alias("source"), F.col("idx").alias("position"), text("d").alias("leaf"),
                       text("subroot").alias("subroot"), text(top).alias("root"), "proof", "proof_sha256", text("folded").alias("folded_root"), (F.col("folded") == top).alias("verified"))


_OUT = "{} long, source string, position long, leaf string, subroot string, root string, proof binary, proof_sha256 string, folded_root string, verified boolean"


def lower_text(text_col: str = "text") -> Column:
    """The tampering of the registered query: A-Z of the text lower-cased."""
    return F.translate(F.col(text_col), _UPPER, _LOWER)
