"""Merkle manifest, centroid clustering and nearest neighbours against brute force and on awkward rows."""

import hashlib
import math
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesift.llm import ann, clustering, merkle

CLASH = ("g", "k", "d", "idx", "total", "at", "part", "cell", "path", "subroot", "root", "v", "r", "ids", "shard", "key", "near", "score", "cluster", "rank", "query_id", "x", "own", "place")


def clashing(df):
    for name in CLASH:
        df = df.withColumn(name, F.lit("clash"))
    return df


# ---- 11

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(d, text, lang, source, n):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text)))


def plain_tree(nodes):
    """(top, path of each node: (place, run) a level)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[i:i + 16] for i in range(0, len(level), 16)]
        for p, i in zip(paths, at):
            p.append((i % 16, runs[i // 16]))
        at, level = [i // 16 for i in at], [sha("".join(r)) for r in runs]
    return level[0], paths


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        leaves = sorted(
            ((r[0] is None, r[0] or 0, plain_leaf(*r), i) for i, r in enumerate(groups[g])))
        trees[g] = (leaves, *plain_tree([x[2] for x in leaves]))
    root, above = plain_tree([trees[g][1] for g in names])
    out = []
    for g, up in zip(names, above):
        leaves, sub, paths = trees[g]
        for (_, _, leaf, i), path in zip(leaves, paths):
            r = groups[g][i]
            whole = path + up
            proof = sha("".join(h for p, run in whole for j, h in enumerate(run) if j != p))
            f = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                f = plain_leaf(r[0], None if r[1] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
            for p, run in whole:
                f = sha("".join(run[:p] + [f] + run[p + 1:]))
            out.append((r[0], leaf, sub, root, proof, f, f == root))
    return out


def manifest_rows(df):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = merkle.manifest(df, tampered, merkle.lower_text())
    return [tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def order(rows):
    return sorted(rows, key=repr)


def test_manifest_against_plain_trees(spark):
    # one source of over two superblock levels' worth, some of exactly 1, 16, 17, 256 and 257 leaves, many small ones
    sizes = {"hot": 1500, "one": 1, "r16": 16, "r17": 17, "b256": 256, "b257": 257, "é": 3, "Z": 2, "": 5, None: 20} | {f"s{i}": 1 + i % 3 for i in range(40)}
    rows, d = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((d, f"Text {d} É", "en" if d % 7 else None, source, None if d % 11 == 0 else d))
            d += 1
    want = plain_manifest(rows)
    got = manifest_rows(spark.createDataFrame(rows, DOC).repartition(5))
    assert order(got) == order(want)
    assert {r[0] for r in got if not r[6]} == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0}


def test_manifest_of_many_sources(spark):
    """More sources than a superblock holds: the tree of subroots is cut as well."""
    rows = [(i, "A", "en", f"source {i % 300}", 1) for i in range(330)]
    assert order(manifest_rows(spark.createDataFrame(rows, DOC))) == order(plain_manifest(rows))


def test_manifest_awkward_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "", 0), (3, "A b", "en", "s", 3), (3, "A b", "en", "s", 3), (3, "A c", "en", "s", 3), (None, "X", "en", "s", 1), (None, None, None, None, None),
            (4, "x Y" * 300_000, "en", "s", 900_000), (2**40, "\x00 Ünï \U0001f600", "de", "s", 5), (-7, "neg", "en", None, 3)]
    df = spark.createDataFrame(rows, DOC)
    assert order(manifest_rows(clashing(df).repartition(3))) == order(plain_manifest(rows))
    empty = merkle.manifest(spark.createDataFrame([], DOC))
    assert empty.count() == 0 and empty.columns == merkle.manifest(df).columns


def test_untouched_manifest_verifies_and_proofs_fold(spark):
    rows = [(i, f"T{i}", "en", f"s{i % 2}", i) for i in range(600)]
    got = merkle.manifest(spark.createDataFrame(rows, DOC)).collect()
    assert all(r.verified and merkle.fold(bytes.fromhex(r.leaf), bytes(r.proof)).hex() == r.root for r in got)
    assert sorted((r.source, r.position) for r in got) == [(f"s{j}", i) for j in range(2) for i in range(300)]


# ---- 12

VEC = "vec_id long, embedding array<double>"


def plain_clusters(rows, dims, k=8, rounds=10):
    kept = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, sha(f"3:{r[0]}"), r[1]))
    cents = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cents = [[sum(col) // len(groups[n]) for col in zip(*groups[n])] if n in groups else c for n, c in enumerate(cents)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, n, d in out:
        inertia[n] = inertia.get(n, 0) + d
    return [(i, n, min(d, 2**63 - 1), min(inertia[n], 2**63 - 1), min(sum(min(x, 2**63 - 1) for x in inertia.values()), 2**63 - 1), sha(",".join(map(str, cents[n])))) for i, n, d in out]


def clusters(df, dims):
    return [tuple(r) for r in clustering.cluster(df, dims=dims)[0].collect()]


@pytest.mark.parametrize("spread", [0.3, 3.0, 0.0])
def test_clusters_against_plain_rounds(spark, spread):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (5, 12)) * spread
    rows = [(i, (centres[i % 5] + rng.normal(0, 0.2 if spread else 0.001, 12)).tolist()) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(400, 700)]  # a group of copies
    got = clusters(spark.createDataFrame(rows, VEC).repartition(4), 12)
    assert sorted(got) == sorted(plain_clusters(rows, 12))


def test_clusters_awkward_rows(spark):
    good = [(i, [float(i % 3), -0.5, i / 7]) for i in range(12)]
    bad = [(50, None), (51, []), (52, [1.0, 2.0]), (53, [1.0, None, 2.0]), (54, [1.0, float("nan"), 2.0]), (55, [1.0, float("inf"), 2.0]), (56, [1.0, 2.0, 3.0, 4.0])]
    rows = [*good, *bad, (3, [9.0, 9.0, 9.0]), (3, [0.0, -0.5, 3 / 7]), (None, [0.25, 0.0, -0.0])]
    got = clusters(clashing(spark.createDataFrame(rows, VEC)), 3)
    assert order(got) == order(plain_clusters(rows, 3))
    few = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (None, [0.0, 0.0, 0.0])]
    assert order(clusters(spark.createDataFrame(few, VEC), 3)) == order(plain_clusters(few, 3))
    for rows in ([], bad):
        assert clusters(spark.createDataFrame(rows, VEC), 3) == []


def test_clusters_of_huge_components(spark):
    """Distances beyond 64 bits are compared exactly and given as the largest long."""
    rows = [(i, [float(i % 4) * 1e30, (-1.0) ** i * 1e18, 0.1 * i, -1.7e308 if i == 5 else 0.0]) for i in range(20)]
    got = clusters(spark.createDataFrame(rows, VEC), 4)
    want = plain_clusters(rows, 4)
    assert [(r[0], *r[1:3], r[5]) for r in sorted(got)] == [(r[0], *r[1:3], r[5]) for r in sorted(want)]


def test_orchard_measures_fewer_and_agrees():
    rng = np.random.default_rng(1)
    cents = rng.integers(-1000, 1000, (40, 6))
    x = np.concatenate([cents[rng.integers(0, 40, 500)] + rng.integers(-20, 20, (500, 6)), rng.integers(-2000, 2000, (100, 6)), (cents[:20] + cents[20:]) // 2])
    got, dist, measured = clustering.Neighbours(cents.tolist(), 6).nearest(x)
    every = ((x[:, None] - cents[None]) ** 2).sum(2)
    assert (got == every.argmin(1)).all() and (dist == every.min(1)).all()
    assert measured < 0.7 * every.size


# ---- 13

def plain_nearest(rows, queries, k=10):
    def ok(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    usable = [(i, v) for i, v in enumerate(rows) if ok(v[1])]
    out = []
    for at, (q, qv) in usable:
        if q is None or not queries(q):
            continue
        near = sorted((float(np.sqrt(((np.array(qv) - np.array(v)) ** 2).sum())), i is None, i or 0) for j, (i, v) in usable if j != at and len(v) == len(qv))
        out += [(q, r + 1, None if n else i, s) for r, (s, n, i) in enumerate(near[:k])]
    return out


def recall(got, want):
    by = {}
    for q, _, i, s in want:
        by.setdefault(q, []).append(round(s, 9))
    hits = 0
    for q, _, i, s in got:
        if round(s, 9) in by.get(q, []):
            by[q].remove(round(s, 9))
            hits += 1
    return hits / max(1, len(want))


def find(df, by=100, **kw):
    return [tuple(r) for r in ann.nearest(df, df.where(F.col("vec_id") % by == 0), **kw).collect()]


@pytest.mark.parametrize("shard_size", [8192, 700])
def test_recall(spark, shard_size):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (30, 32))
    rows = [(i, (centres[i % 30] + rng.normal(0, 0.5, 32)).tolist() if i % 3 else rng.normal(0, 1, 32).tolist()) for i in range(3000)]
    got = find(spark.createDataFrame(rows, VEC).repartition(5), by=20, shard_size=shard_size)
    want = plain_nearest(rows, lambda q: q % 20 == 0)
    assert len(got) == len(want) and recall(got, want) >= 0.95
    score = {(q, i): s for q, _, i, s in got}
    x = {i: np.array(v) for i, v in rows}
    assert all(abs(s - np.linalg.norm(x[q] - x[i])) < 1e-12 for (q, i), s in score.items())


def test_nearest_of_copies_and_awkward_rows(spark):
    """Small tables are searched completely: equal to brute force, ties included."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(60)]
    rows += [(i, [1.0, 2.0, 0.0, -1.0]) for i in range(60, 300)]  # a hot vector, queries 100 and 200 among its rows
    rows += [(100, [5.0, 5.0, 5.0, 5.0]), (200, [1.0, 2.0, 0.0, -1.0]), (None, [1.0, 2.0, 0.0, -1.0]), (None, [7.0, 5.0, 5.0, 5.0])]
    rows += [(400, None), (500, []), (600, [0.0, 0.0, 0.0, -0.0]), (700, [1.0, None, 0.0, 1.0]), (800, [float("nan"), 1.0, 0.0, 0.0]), (900, [float("inf"), 1.0, 0.0, 0.0]),
             (1000, [1.0, 1.0]), (1100, [1.0, 1.0]), (1101, [-1.0, 1.0]), (1200, [3.0])]
    got = find(clashing(spark.createDataFrame(rows, VEC).repartition(3)))
    assert order(got) == order(plain_nearest(rows, lambda q: q % 100 == 0))
    assert find(spark.createDataFrame([], VEC)) == [] and find(spark.createDataFrame([(100, [1.0, 2.0])], VEC)) == []


def test_graph_levels_and_links():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (2000, 16)).astype(np.float32)
    g = ann.Graph.build(x)
    assert len(g.links) > 1 and [len(y) for y in g.links] == sorted([len(y) for y in g.links], reverse=True)
    assert all(y.max() < len(y) for y in g.links) and all(len(set(r[r >= 0])) == (r >= 0).sum() for r in g.links[0])
    reached, frontier = {0}, [0]
    while frontier:
        frontier = [v for u in frontier for v in g.links[0][u].tolist() if v >= 0 and v not in reached]
        frontier = list(dict.fromkeys(frontier))
        reached |= set(frontier)
    assert len(reached) >= 0.999 * len(x)


def test_nodes_that_choose_each_other_are_linked_once():
    """Two nodes of one block hold each other before links go back; a list with room and one that overflows."""
    x = np.array([[0.0], [1.0], [3.0], [7.0]], np.float32)
    for width in (2, 4):
        links = np.full((4, width), -1, np.int32)
        chosen = np.array([[1, 2], [0, 2], [1, 0], [2, 1]], np.int32)
        links[:, :2] = chosen
        ann._link_back(x, links, np.arange(4), chosen)
        assert all(len(set(r[r >= 0])) == (r >= 0).sum() for r in links)
        assert width == 2 or [set(r[r >= 0].tolist()) for r in links] == [{1, 2}, {0, 2, 3}, {0, 1, 3}, {1, 2}]
