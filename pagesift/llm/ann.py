"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

Distinct vectors are dealt to shards of bounded size by their hash.  A shard's graph is one flat array of neighbour
numbers per level: the nodes of a level are the first ones of the shard, so a row's place is its node number.  Nodes
are linked level by level from the top, in blocks: every block searches the graph as it stands, keeps diverse near
neighbours, and its neighbours link back.  A query walks down the levels and searches the lowest with a beam.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_of, key_of, stage

#: Distinct vectors of a shard on average; bounds a task's memory and work.
SHARD = 8192
#: Links of a node on upper levels; the lowest has twice as many.
LINKS = 16
BUILD_BEAM, SEARCH_BEAM, UPPER_BEAM = 64, 160, 8
#: Nodes expanded together in a step of a beam search.
EXPAND = 4
_BLOCK = 256
#: Distinct query vectors that meet one shard in one task.
_SLICE = 65_536


# ---- one graph -------------------------------------------------------------------------------------------------

def _distances(x: np.ndarray, a: np.ndarray, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows x[a] and q[b]."""
    d = x[a] - q[b]
    return np.einsum("ij,ij->i", d, d)


def _beam(x: np.ndarray, links: np.ndarray, n: int, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For every row of ``q`` the ``width`` nearest of the first n nodes found from its entries: (nodes, squared
    distances) by ascending distance, -1 and inf where there are fewer."""
    b = len(q)
    seen = np.zeros((b, n), bool)
    node = np.full((b, width), -1, np.int32)
    dist = np.full((b, width), np.inf, np.float32)
    open_ = np.zeros((b, width), bool)
    live = np.arange(b)
    cand = np.where(entry < n, entry, 0)
    while True:
        # the new candidates of every live query, each node once
        cand = np.sort(cand, axis=1)
        new = cand >= 0
        new[:, 1:] &= cand[:, 1:] != cand[:, :-1]
        new &= ~seen[live[:, None], cand]
        r, c = np.nonzero(new)
        to = cand[r, c]
        seen[live[r], to] = True
        d = np.full(cand.shape, np.inf, np.float32)
        d[r, c] = _distances(x, to, q, live[r])
        every = np.concatenate([dist[live], d], 1)
        best = np.argpartition(every, width - 1, axis=1)[:, :width] if every.shape[1] > width else np.tile(np.arange(width), (len(live), 1))
        dist[live] = np.take_along_axis(every, best, 1)
        node[live] = np.take_along_axis(np.concatenate([node[live], np.where(new, cand, -1)], 1), best, 1)
        open_[live] = np.take_along_axis(np.concatenate([open_[live], new], 1), best, 1)
        left = np.where(open_[live], dist[live], np.inf)
        some = np.isfinite(left).any(1)
        live, left = live[some], left[some]
        if not len(live):
            break
        e = min(EXPAND, width)
        take = np.argpartition(left, e - 1, axis=1)[:, :e] if width > e else np.tile(np.arange(width), (len(live), 1))
        go = np.isfinite(np.take_along_axis(left, take, 1))
        rows = np.broadcast_to(live[:, None], take.shape)
        open_[rows[go], take[go]] = False
        nxt = links[node[rows, take]]
        nxt[~go] = -1
        cand = nxt.reshape(len(live), -1)
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(node, order, 1), np.take_along_axis(dist, order, 1)


def _diverse(x: np.ndarray, near: np.ndarray, dist: np.ndarray, m: int) -> np.ndarray:
    """Up to m of each row's candidates (ascending): first those closer to the row than to any taken before, then
    the nearest of the rest."""
    b, c = near.shape
    if c <= m:
        out = np.full((b, m), -1, np.int32)
        out[:, :c] = np.where(np.isfinite(dist), near, -1)
        return out
    v = x[near]  # a missing candidate stands last and is never taken: its distance is infinite
    sq = np.einsum("bcd,bcd->bc", v, v)
    between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    taken = np.zeros((b, c), bool)
    number = np.zeros(b, np.int64)
    for i in range(c):
        closest = np.where(taken, between[:, i], np.inf).min(1)
        ok = (dist[:, i] < closest) & (number < m) & np.isfinite(dist[:, i])
        taken[:, i] = ok
        number += ok
    rank = np.where(taken, 0, 1) * c + np.arange(c)  # taken ones first, each part by distance
    rank[~np.isfinite(dist)] = 3 * c
    first = np.argsort(rank, axis=1)[:, :m]
    return np.where(np.take_along_axis(rank, first, 1) < 3 * c, np.take_along_axis(near, first, 1), -1).astype(np.int32)


def _link_back(x: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Adds each new node to the lists of its chosen neighbours, but for those that hold it (two nodes of a block may
    choose each other); lists that overflow are cut to diverse ones."""
    m = links.shape[1]
    src, dst = np.repeat(new, chosen.shape[1]), chosen.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    fresh = ~(links[dst] == src[:, None]).any(1)
    src, dst = src[fresh], dst[fresh]
    if not len(src):
        return
    d = _distances(x, src, x, dst)
    order = np.lexsort((d, dst))
    src, dst = src[order], dst[order]
    who, start, count = np.unique(dst, return_index=True, return_counts=True)
    place = np.arange(len(dst)) - np.repeat(start, count)
    add = np.full((len(who), min(m, int(count.max()))), -1, np.int32)
    ok = place < add.shape[1]
    add[np.repeat(np.arange(len(who)), count)[ok], place[ok]] = src[ok]
    used = (links[who] >= 0).sum(1)
    fits = used + np.minimum(count, add.shape[1]) <= m
    for w, u, row in zip(who[fits].tolist(), used[fits].tolist(), add[fits]):
        row = row[row >= 0]
        links[w, u:u + len(row)] = row
    for lo in range(0, int((~fits).sum()), 512):
        w = who[~fits][lo:lo + 512]
        every = np.concatenate([links[w], add[~fits][lo:lo + 512]], 1)
        r, c = np.nonzero(every >= 0)
        dist = np.full(every.shape, np.inf, np.float32)
        dist[r, c] = _distances(x, every[r, c], x, w[r])
        order = np.argsort(dist, axis=1, kind="stable")
        links[w] = _diverse(x, np.take_along_axis(every, order, 1), np.take_along_axis(dist, order, 1), m)


class Graph:
    """A hierarchical navigable small-world graph over the rows of ``x`` (distinct, scaled to about 1)."""

    def __init__(self, x: np.ndarray, links: list[np.ndarray]):
        self.x, self.links = x, links  # of the lowest level first; level l holds the first len(links[l]) nodes

    @classmethod
    def build(cls, x: np.ndarray, m: int = LINKS, beam: int = BUILD_BEAM, seed: int = 1) -> Graph:
        n = len(x)
        top = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(m)).astype(int)
        sizes = [n]
        while (above := int((top >= len(sizes)).sum())) and above < sizes[-1]:
            sizes.append(above)
        graph = cls(x, [np.zeros((0, 0), np.int32)] * len(sizes))
        for level in range(len(sizes) - 1, -1, -1):
            graph._link_level(level, sizes[level], 2 * m if level == 0 else m, m, beam)
        return graph

    def _link_level(self, level: int, n: int, width: int, m: int, beam: int) -> None:
        x = self.x
        links = self.links[level] = np.full((n, width), -1, np.int32)
        done = 0
        while done < n:
            block = np.arange(done, min(n, max(1, min(2 * done, done + _BLOCK))))
            q = x[block]
            peers = q @ q.T
            sq = np.einsum("ij,ij->i", q, q)
            peers = np.maximum(sq[:, None] + sq[None, :] - 2 * peers, 0).astype(np.float32)
            np.fill_diagonal(peers, np.inf)
            few = min(m, len(block) - 1)
            near_p = np.argsort(peers, axis=1, kind="stable")[:, :few]
            node, dist = block[near_p].astype(np.int32), np.take_along_axis(peers, near_p, 1)
            if done:
                found, far = _beam(x, links, done, q, self._enter(q, level), min(beam, done))
                node, dist = np.concatenate([found, node], 1), np.concatenate([far, dist], 1)
                order = np.argsort(dist, axis=1, kind="stable")
                node, dist = np.take_along_axis(node, order, 1), np.take_along_axis(dist, order, 1)
            chosen = _diverse(x, node, dist, m)
            links[block, :m] = chosen
            _link_back(x, links, block, chosen)
            done += len(block)

    def _enter(self, q: np.ndarray, level: int) -> np.ndarray:
        """Entries of the queries on a level, from the levels above."""
        entry = np.zeros((len(q), 1), np.int32)
        for above in range(len(self.links) - 1, level, -1):
            links = self.links[above]
            entry = _beam(self.x, links, len(links), q, entry, min(UPPER_BEAM, len(links)))[0]
        return entry

    def search(self, q: np.ndarray, k: int, beam: int = SEARCH_BEAM) -> np.ndarray:
        """The k nearest nodes found for each row of ``q``, -1 where there are fewer."""
        n = len(self.x)
        out = np.full((len(q), k), -1, np.int32)
        for lo in range(0, len(q), _BLOCK):
            part = q[lo:lo + _BLOCK]
            node, _ = _beam(self.x, self.links[0], n, part, self._enter(part, 0), min(max(beam, k), n))
            out[lo:lo + len(part), :min(k, node.shape[1])] = node[:, :k]
        return out


# ---- shards ----------------------------------------------------------------------------------------------------

_INDEX = "shard int, dims int, scale double, ids binary, id_ends binary, vectors binary, level_sizes binary, links binary"


def _scale(x: np.ndarray) -> float:
    return float(np.abs(x).max()) or 1.0


def _build(m: int, beam: int):
    def run(table: pa.Table) -> pa.Table:
        out = []
        if table.num_rows:
            shard = table.column("shard")[0].as_py()
            size = np.asarray(table.column("dims").to_numpy())
            for dims in np.unique(size).tolist():
                part = table.filter(pa.array(size == dims)).combine_chunks()
                x = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
                ids = part.column("ids").combine_chunks()
                graph = Graph.build((x / _scale(x)).astype(np.float32), m, beam)
                ends = np.cumsum(ids.value_lengths().to_numpy()).astype(np.int32)
                out.append((shard, dims, _scale(x), ids.flatten().to_numpy().astype(np.int64).tobytes(), ends.tobytes(), x.tobytes(),
                            np.array([v for y in graph.links for v in y.shape], np.int32).tobytes(), b"".join(y.tobytes() for y in graph.links)))
        types = [pa.int32(), pa.int32(), pa.float64(), *[pa.binary()] * 5]
        names = [c.split()[0] for c in _INDEX.split(", ")]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)
    return run


def index(vectors: DataFrame, keep: int, shard_size: int = SHARD, links: int = LINKS, beam: int = BUILD_BEAM, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """The staged index: one row per shard and number of components, with the distinct vectors, the ``keep`` smallest
    ids of each and the graph's flat neighbour arrays, level by level."""
    rows = _usable(vectors, id_col, vector_col)
    # of equal vectors only the smallest ids can be among the nearest; each task drops the others before the shuffle
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("k"))).where(F.col("r") <= keep)
    distinct = stage(ranked.groupBy("v").agg(F.array_sort(F.collect_list("k")).alias("ids")), "ann-vectors")
    shards = max(1, -(-distinct.count() // shard_size))
    dealt = distinct.select(F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), F.size("v").alias("dims"), "v", "ids")
    # a shard is one task's work: more partitions than shards keep two from meeting in one
    return stage(dealt.repartition(4 * shards, "shard").groupBy("shard").applyInArrow(_build(links, beam), _INDEX), "ann-index")


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (k, v): vectors that are not null or zero and have no null or non-finite component."""
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.where(whole).select(key_of(id_col).alias("k"), v.alias("v"))


_FOUND = "key string, k long, score double"


def _search(keep: int, beam: int):
    def run(queries: pa.Table, shard: pa.Table) -> pa.Table:
        keys, ids, scores = [], [], []
        for row in shard.to_pylist() if queries.num_rows else []:
            x = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dims"])
            own = queries.filter(pa.array(queries.column("v").combine_chunks().value_lengths().to_numpy() == row["dims"]))
            if not own.num_rows:
                continue
            flat, shape, at, links = np.frombuffer(row["links"], np.int32), np.frombuffer(row["level_sizes"], np.int32).reshape(-1, 2), 0, []
            for a, b in shape.tolist():
                links.append(flat[at:at + a * b].reshape(a, b))
                at += a * b
            graph = Graph((x / row["scale"]).astype(np.float32), links)
            all_ids, ends = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["id_ends"], np.int32)
            begins = np.append(0, ends[:-1])
            q = own.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, row["dims"])
            names = own.column("key").to_pylist()
            for lo in range(0, len(q), _BLOCK):
                part = q[lo:lo + _BLOCK]
                node = graph.search((part / row["scale"]).astype(np.float32), 2 * keep, beam)
                d = x[node] - part[:, None, :]
                exact = np.sqrt((d * d).sum(2))
                exact[node < 0] = np.inf
                node[node < 0] = -1
                for name, nodes, dist in zip(names[lo:lo + _BLOCK], node.tolist(), exact.tolist()):
                    best = sorted((s, i) for s, t in zip(dist, nodes) if t >= 0 for i in all_ids[begins[t]:ends[t]].tolist())[:keep]
                    keys += [name] * len(best)
                    ids += [i for _, i in best]
                    scores += [s for s, _ in best]
        return pa.table([pa.array(keys, pa.string()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], names=["key", "k", "score"])
    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_size: int = SHARD, links: int = LINKS, build_beam: int = BUILD_BEAM,
            beam: int = SEARCH_BEAM, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for every row of ``queries`` (a part of ``vectors``) its k nearest other
    rows found, by Euclidean distance in double precision on the vectors as given, ties to the smaller id.

    Every row is indexed; the search is approximate.  Equal vectors are one node of the graph with the smallest ids,
    equal queries are searched once; a query's own row is left out once, so its copies stay.  Null, zero (or empty)
    vectors and those with a null or non-finite component take no part on either side; vectors are compared with
    those of as many components only.  Null ids are candidates, after all others on ties, and queries if given.  Repeated rows are rows
    of their own.  Fewer candidates than k give as many rows, an empty table none.  Other columns are not read.
    """
    keep = k + 1
    found = index(vectors, keep, shard_size, links, build_beam, id_col, vector_col)
    shards = [r["shard"] for r in found.select("shard").distinct().collect()]
    asked = _usable(queries, id_col, vector_col).withColumn("key", F.md5(F.array_join(F.col("v").cast("array<string>"), ",").cast("binary")))
    asked = stage(asked, "ann-queries")
    once = asked.groupBy("key").agg(F.min("v").alias("v"))
    slices = max(1, -(-once.count() // _SLICE))
    cell = F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int")
    dealt = once.select("key", "v", cell.alias("slice"), F.explode(F.array(*[F.lit(s) for s in sorted(shards)]).cast("array<int>")).alias("shard"))
    copies = found.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    parts = 4 * max(1, len(shards) * slices)
    both = [df.repartition(parts, "shard", "slice").groupBy("shard", "slice") for df in (dealt, copies)]
    got = both[0].cogroup(both[1]).applyInArrow(_search(keep, beam), _FOUND)
    order = Window.partitionBy("key").orderBy("score", "k")
    best = got.withColumn("r", F.row_number().over(order)).where(F.col("r") <= keep)
    best = best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("r", "k", "score"))).alias("near"))  # k + 1 entries
    own = F.expr("array_position(transform(near, x -> x.k = k and x.score = 0), true)")
    rest = F.slice(F.filter("near", lambda x, i: i + 1 != F.col("own")), 1, k)
    rows = asked.select("key", "k").join(best, "key").withColumn("own", own)
    rows = rows.select("k", F.posexplode(rest).alias("place", "x"))
    return rows.select(id_of(F.col("k")).alias("query_id"), (F.col("place") + 1).cast("int").alias("rank"), id_of(F.col("x.k")).alias("vec_id"), F.col("x.score").alias("score"))
