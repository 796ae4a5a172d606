"""Approximate nearest neighbours with robust-pruned directed graphs, one for each shard.

Vectors of one direction (unit vectors equal in 12 digits) are one node, so copies and multiples neither crowd a graph nor get lost. Nodes are dealt by
hash into shards of bounded size. A shard's graph is built in rounds: every node searches the graph greedily from the
medoid, the nodes seen and its neighbours are its candidates, and robust pruning keeps a candidate unless a kept one is nearer to it
by the factor ``alpha``; edges are made two-way and pruned again. Queries run a beam search in every shard, in blocks of
queries; the results of the shards are merged and scored on the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specloom.llm.common import cut


def beam_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy beam search of many queries at once on unit vectors: (nodes, distances), each queries x width, nearest first.

    ``graph`` lists out-neighbours, -1 where there are fewer. A step expands the nearest unexpanded node of each beam.
    """
    n, q = len(x), len(queries)
    nodes = np.full((q, width), -1)
    far = np.full((q, width), np.inf, np.float32)
    begin = 1 - queries @ x[entry].T
    order = np.argsort(begin, 1, kind="stable")[:, :width]
    nodes[:, :order.shape[1]], far[:, :order.shape[1]] = entry[order], np.take_along_axis(begin, order, 1)
    seen = np.zeros((q, n), bool)
    np.put_along_axis(seen, entry[order], True, 1)
    expanded = np.zeros((q, n), bool)
    rows = np.arange(q)
    while True:
        open_ = np.where((nodes >= 0) & ~np.take_along_axis(expanded, np.maximum(nodes, 0), 1), far, np.inf)
        at = open_.argmin(1)
        live = np.isfinite(open_[rows, at])
        if not live.any():
            return nodes, far
        r = rows[live]
        node = nodes[r, at[live]]
        expanded[r, node] = True
        near = graph[node]
        fresh = (near >= 0) & ~seen[r[:, None], np.maximum(near, 0)]
        ri, ci = np.nonzero(fresh)
        seen[r[ri], near[ri, ci]] = True
        d = np.full(near.shape, np.inf, np.float32)
        d[ri, ci] = 1 - np.einsum("ij,ij->i", queries[r[ri]], x[near[ri, ci]])
        both, dist = np.concatenate([nodes[r], np.where(fresh, near, -1)], 1), np.concatenate([far[r], d], 1)
        order = np.argsort(dist, 1, kind="stable")[:, :width]
        nodes[r], far[r] = np.take_along_axis(both, order, 1), np.take_along_axis(dist, order, 1)


def robust_prune(x: np.ndarray, node: int, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Keep the nearest candidate, strike those that are nearer to it than to the node by the factor alpha, and so on."""
    candidates = candidates[candidates != node]
    d = 2 - 2 * (x[candidates] @ x[node])
    order = np.argsort(d, kind="stable")
    candidates, d = candidates[order], d[order]
    between = 2 - 2 * (x[candidates] @ x[candidates].T)
    alive, kept = np.ones(len(candidates), bool), []
    for i in range(len(candidates)):
        if alive[i]:
            kept.append(candidates[i])
            if len(kept) == degree:
                break
            alive &= alpha * between[i] > d
    return np.array(kept, np.int64)


def entries(graph, first: np.ndarray) -> np.ndarray:
    """``first`` and, while some node can't be reached, one node more of those that can't: all nodes are reachable from the result."""
    out, seen = list(first), np.zeros(len(graph), bool)
    frontier = np.asarray(first)
    while True:
        while len(frontier):
            seen[frontier] = True
            near = np.unique(graph[frontier])
            frontier = near[(near >= 0) & ~seen[near]]
        left = np.flatnonzero(~seen)
        if not len(left):
            return np.array(out)
        out.append(int(left[0]))
        frontier = left[:1]


def build_graph(x: np.ndarray, degree: int = 32, width: int = 64, alpha: float = 1.2, rounds: int = 2, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(graph, entry nodes) of unit vectors. The start is a random graph; every round replaces each node's edges.

    Many vectors of nearly one direction link to each other alone; entries are added so that every node stays reachable, while building and at the end.
    """
    n = len(x)
    degree = min(degree, max(1, n - 1))
    rng = np.random.default_rng(seed)
    medoid = np.array([int((x @ x.mean(0)).argmax())])
    graph = np.full((n, degree), -1)
    if n > 1:
        for i in range(n):
            pick = rng.choice(n - 1, degree, replace=False)
            graph[i] = pick + (pick >= i)
    for r in range(rounds if n > 1 else 0):
        factor = 1.0 if r + 1 < rounds else alpha
        for block in np.array_split(rng.permutation(n), max(1, n // 512)):
            found, _ = beam_search(x, graph, x[block], entries(graph, medoid), width)
            incoming: dict[int, list[int]] = {}
            for i, near in zip(block, found):
                kept = robust_prune(x, i, np.unique(np.concatenate([near[near >= 0], graph[i][graph[i] >= 0]])), degree, factor)
                graph[i] = -1
                graph[i, :len(kept)] = kept
                for k in kept:
                    incoming.setdefault(int(k), []).append(int(i))
            for k, new in incoming.items():
                has = graph[k][graph[k] >= 0]
                union = np.union1d(has, new)
                if len(union) > degree:
                    union = robust_prune(x, k, union, degree, factor)
                graph[k] = -1
                graph[k, :len(union)] = union
    return graph, entries(graph, medoid)


def valid_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part: not null, not empty, not zero, all components finite; ids not null."""
    v = F.col(embedding).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda c: c != 0))


def build_index(vectors: DataFrame, copies: int, shard_rows: int = 4096, **graph_options) -> DataFrame:
    """(shard, node, ids, vs, neighbours, entry): every valid vector is in one shard. ``ids`` and ``vs`` list the members with the ``copies`` smallest ids of a
    direction: their cosines are equal but for the last digit, so more can't be in any result list. The number of shards follows the number of nodes."""
    big = F.array_max(F.transform("v", lambda c: F.abs(c)))
    scaled = vectors.select("vec_id", "v", F.transform("v", lambda c: c / big).alias("s"))
    length = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, c: a + c * c))
    aimed = scaled.select("vec_id", "v", F.transform("s", lambda c: F.round(c / length, 12) + F.lit(0.0)).alias("aim"))
    ranked = aimed.withColumn("_r", F.dense_rank().over(Window.partitionBy("aim").orderBy("vec_id"))).where(F.col("_r") <= copies)
    members = F.array_sort(F.collect_set(F.struct("vec_id", "v")))
    nodes = cut(ranked.groupBy("aim").agg(members.alias("m")).select(F.col("m.vec_id").alias("ids"), F.col("m.v").alias("vs"), "aim"))
    shards = max(1, -(-nodes.count() // shard_rows))
    dealt = nodes.select("ids", "vs", "aim", F.pmod(F.xxhash64("aim"), F.lit(shards)).cast("int").alias("shard"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        sizes = group["aim"].map(len)
        out = []
        for size in sorted(sizes.unique()):  # vectors of another length are another space
            part = group[sizes == size].reset_index(drop=True)
            order = np.argsort([i[0] for i in part["ids"]], kind="stable")
            part = part.iloc[order].reset_index(drop=True)
            x = unit(np.array(part["aim"].tolist(), np.float64)).astype(np.float32)
            graph, entry = build_graph(x, **graph_options)
            out.append(pd.DataFrame({"shard": part["shard"], "node": np.arange(len(part), dtype=np.int32), "ids": part["ids"], "vs": part["vs"], "neighbours": [g[g >= 0].astype(np.int32) for g in graph], "entry": np.isin(np.arange(len(part)), entry)}))
        return pd.concat(out)

    return cut(dealt.groupBy("shard").applyInPandas(build, "shard int, node int, ids array<long>, vs array<array<double>>, neighbours array<int>, entry boolean"))


def unit(v: np.ndarray) -> np.ndarray:
    big = np.abs(v).max(1, keepdims=True)
    v = v / big
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def search(index: DataFrame, queries: DataFrame, k: int, width: int = 96, block_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best found of all shards for each (query_id, v)."""
    shards = 1 + (index.agg(F.max("shard").alias("m")).first()["m"] or 0)
    blocks = max(1, -(-queries.count() // block_rows))
    asked = queries.select("query_id", "v", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))
    # each block of the query set meets each shard once
    left = index.withColumnRenamed("shard", "s").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(nodes: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        sizes, lengths = nodes["vs"].map(lambda m: len(m[0])), asked["v"].map(len)
        for size in set(sizes) & set(lengths):
            part, ask = nodes[sizes == size].sort_values("node"), asked[lengths == size]
            q = np.array(ask["v"].tolist(), np.float64)
            # the members of node n are the rows starts[n] to starts[n + 1] of v
            starts = np.cumsum([0, *part["ids"].map(len)])
            v, ids = np.array([m for vs in part["vs"] for m in vs], np.float64), np.concatenate(part["ids"].tolist())
            x, u = unit(v[starts[:-1]]).astype(np.float32), unit(q).astype(np.float32)
            graph = np.full((len(part), max(1, part["neighbours"].map(len).max())), -1)
            for i, n in enumerate(part["neighbours"]):
                graph[i, :len(n)] = n
            entry = np.flatnonzero(part["entry"].to_numpy())
            names = ask["query_id"].tolist()
            for first in range(0, len(u), 512):
                found, _ = beam_search(x, graph, u[first:first + 512], entry, width)
                for i, near in enumerate(found, first):
                    at = np.concatenate([np.arange(starts[n], starts[n + 1]) for n in near[near >= 0]])
                    rows = [(s, j) for s, j in zip(cosine(v[at], q[i]).tolist(), ids[at].tolist()) if j != names[i]]
                    rows.sort(key=lambda r: (-r[0], r[1]))
                    out += [(names[i], j, s) for s, j in rows[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = left.groupBy("s", "b").cogroup(right.groupBy("shard", "block")).applyInPandas(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def cosine(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """In double precision on the vectors as given."""
    return np.clip((v * q).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((q * q).sum())), -1.0, 1.0)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding", width: int = 96, **index_options) -> DataFrame:
    """The k nearest found of every row whose id is divisible by ``every``, among all other rows.

    Nearest first, ties to the smaller id; with fewer candidates all of them. Null, empty, zero and non-finite vectors and null ids take
    no part; of rows that repeat an id with the same vector one counts; vectors of other lengths are no candidates; an empty table gives
    no rows; extra columns are left out.
    """
    valid = cut(valid_vectors(vectors, vec_id, embedding))
    index = build_index(valid, k + 1, **index_options)
    queries = valid.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v").distinct()
    return search(index, queries, k, width)
