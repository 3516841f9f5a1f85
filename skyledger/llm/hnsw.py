"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

A shard holds a bounded number of vectors and is indexed in one task: distinct vectors get a level by a hash of their id (one
in ``LEVEL`` reaches the next), every level links a vector to near and diverse others (a candidate nearer to a chosen
neighbour than to the vector is skipped while others are left) and to those that chose it. The index row stores flat
neighbour arrays. A query descends greedily through the upper levels and runs a beam on the lowest; the answers
of all shards are merged. Vectors are lengthened by one component to equal norms, so that the largest inner product
is the nearest vector. Equal vectors are one node with a list of ids, so copies neither crowd the graph nor get lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from skyledger.llm import vectors
from skyledger.session import cut_lineage

SHARD, QUERIES, LEVEL = 8192, 512, 16
LINKS, CANDIDATES, BEAM, FRONT = 32, 64, 128, 4
_INDEX = "shard int, ids binary, starts binary, vecs binary, width int, levels array<binary>, nodes array<binary>"


def _graph(x: np.ndarray) -> np.ndarray:
    """Flat neighbour array (n, LINKS), -1 where there are fewer."""
    n = len(x)
    out = np.full((n, LINKS), -1, np.int32)
    if n < 2:
        return out
    c = min(CANDIDATES, n - 1)
    chosen = np.full((n, LINKS // 2), -1, np.int32)
    for lo in range(0, n, 512):
        hi = min(n, lo + 512)
        sim = x[lo:hi] @ x.T
        sim[np.arange(hi - lo), np.arange(lo, hi)] = -np.inf
        near = np.argpartition(-sim, c - 1, axis=1)[:, :c]
        s = np.take_along_axis(sim, near, 1)
        order = np.argsort(-s, axis=1, kind="stable")
        near, s = np.take_along_axis(near, order, 1), np.take_along_axis(s, order, 1)
        y = x[near]
        among = y @ y.transpose(0, 2, 1)
        kept = np.zeros((hi - lo, c), bool)
        for j in range(c):
            closest = np.where(kept[:, :j], among[:, j, :j], -np.inf).max(axis=1, initial=-np.inf)
            kept[:, j] = (closest < s[:, j]) & (kept.sum(axis=1) < LINKS // 2)
        first = np.argsort(~kept, axis=1, kind="stable")[:, :LINKS // 2]  # the diverse ones, then the nearest others
        chosen[lo:hi, :first.shape[1]] = np.take_along_axis(near, first, 1)
    out[:, :LINKS // 2] = chosen
    # the other half: vectors that chose this one, nearest first
    source, target = np.repeat(np.arange(n, dtype=np.int32), LINKS // 2), chosen.ravel()
    source, target = source[target >= 0], target[target >= 0]
    closeness = np.einsum("ij,ij->i", x[source], x[target])
    order = np.lexsort((-closeness, target))
    source, target = source[order], target[order]
    place = np.arange(len(target)) - np.searchsorted(target, target, side="left")
    ok = place < LINKS // 2
    out[target[ok], LINKS // 2 + place[ok]] = source[ok]
    return out


def _beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries at once: the best ``beam`` nodes per query (-1: none) and their scores, best first."""
    m = len(q)
    seen = np.zeros((m, len(x) + 1), bool)
    seen[:, -1] = True  # place of -1
    node = np.full((m, beam), -1, np.int64)
    score = np.full((m, beam), -np.inf)
    done = np.ones((m, beam), bool)
    node[:, 0], score[:, 0], done[:, 0] = entry, np.einsum("ij,ij->i", q, x[entry]), False
    seen[np.arange(m), entry] = True
    while True:
        live = np.flatnonzero(~done.all(axis=1))
        if not len(live):
            return node, score
        r = np.arange(len(live))[:, None]
        pick = np.argsort(done[live], axis=1, kind="stable")[:, :FRONT]  # the beam is in order: the best not yet expanded
        fresh = ~done[live][r, pick]
        done[live[:, None], pick] = True
        around = np.where(fresh[:, :, None], links[node[live[:, None], pick]], -1).reshape(len(live), -1)
        around = np.sort(around, axis=1)
        around[:, 1:][around[:, 1:] == around[:, :-1]] = -1
        around[seen[live[:, None], around]] = -1
        seen[live[:, None], around] = True
        s = np.where(around >= 0, np.einsum("ij,ikj->ik", q[live], x[around]), -np.inf)
        nodes, scores = np.concatenate([node[live], around], 1), np.concatenate([score[live], s], 1)
        flags = np.concatenate([done[live], around < 0], 1)
        top = np.argpartition(-scores, beam - 1, axis=1)[:, :beam]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(scores, top, 1), axis=1, kind="stable"), 1)
        node[live], score[live] = np.take_along_axis(nodes, top, 1), np.take_along_axis(scores, top, 1)
        done[live] = np.take_along_axis(flags, top, 1) | np.isneginf(score[live])


def index(rows: DataFrame, n: int) -> DataFrame:
    """One row per shard: ids by node, vectors and, per level, its nodes and their flat neighbour arrays."""

    def run(key, batch: pd.DataFrame) -> pd.DataFrame:
        ids, x = batch["vec_id"].to_numpy(np.int64), vectors.matrix(batch["embedding"])
        order = np.lexsort((ids,))
        ids, x = ids[order], x[order]
        distinct, first, which = np.unique(x, axis=0, return_index=True, return_inverse=True)
        by_node = np.lexsort((ids, which))
        starts = np.searchsorted(which[by_node], np.arange(len(distinct) + 1))
        norms = (distinct**2).sum(axis=1)
        graph_x = np.hstack([distinct, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]]).astype(np.float32)
        h = (ids[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
        level = np.floor(-np.log((h.astype(np.float64) + 0.5) / 2.0**53) / np.log(LEVEL)).astype(int)
        nodes, levels = [], []
        for at in range(level.max() + 1):
            members = np.flatnonzero(level >= at)
            nodes.append(members.astype("<i4").tobytes())
            levels.append(_graph(graph_x[members]).astype("<i4").tobytes())
        return pd.DataFrame([(key[0], ids[by_node].astype("<i8").tobytes(), starts.astype("<i4").tobytes(), distinct.astype("<f8").tobytes(),
                              x.shape[1], levels, nodes)], columns=[c.split()[0] for c in _INDEX.split(", ")])

    return cut_lineage(vectors.sharded(rows, n, SHARD).groupBy("shard").applyInPandas(run, _INDEX))


def nearest(rows: DataFrame, is_query, k: int = 20, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest rows found for each query, by inner product.

    ``is_query``: a condition on vec_id. Rows with the query's own vec_id are no candidates. An empty table gives no rows.
    """
    rows = vectors.valid(rows, zero=False)
    queries = rows.filter(is_query)
    n = rows.count()
    graphs = index(rows, n)

    def run(graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        g = graph.iloc[0]
        ids, starts = np.frombuffer(g["ids"], "<i8"), np.frombuffer(g["starts"], "<i4")
        width = int(g["width"])
        x = np.frombuffer(g["vecs"], "<f8").reshape(-1, width)
        q = vectors.matrix(asked["embedding"], width)
        extra = q.shape[1] - width  # a longer query meets 0 there
        q = q[:, :width] if extra > 0 else q
        nodes = [np.frombuffer(b, "<i4") for b in g["nodes"]]
        links = [np.frombuffer(b, "<i4").reshape(-1, LINKS) for b in g["levels"]]
        near, qf = x.astype(np.float32), q.astype(np.float32)
        entry = np.full(len(q), nodes[-1][0])
        for at in range(len(nodes) - 1, 0, -1):
            place = np.searchsorted(nodes[at], entry)
            best, _ = _beam(near[nodes[at]], links[at], qf, place, 8)
            entry = nodes[at][best[:, 0]]
        found, _ = _beam(near, links[0], qf, entry, min(max(beam, k + 1), max(len(x), 1)))
        for row, own in enumerate(asked["vec_id"]):
            hits = found[row][found[row] >= 0]
            exact = x[hits] @ q[row]
            order = np.lexsort((ids[starts[hits]], -exact))
            for j in order[:k + 1]:  # one of them may be the query itself
                same = ids[starts[hits[j]]:starts[hits[j] + 1]]
                out += [(own, int(i), float(exact[j])) for i in same[same != own][:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    shards = max(1, -(-n // SHARD))
    return vectors.merged(vectors.answered(graphs, queries, shards, QUERIES, run, "query_id long, vec_id long, score double"), k)
