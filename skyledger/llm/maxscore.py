"""Exact top-k search by MaxScore over sharded postings.

A term is a component of the vectors. Its posting holds every row's value, shifted so that each contribution to a query's
score lies between 0 and the term's bound |q| * (largest - smallest value). Terms are ordered by bound. Those at the end
whose bounds together cannot lift a row above the k-th best score so far are non-essential: only the postings of
the essential terms are traversed, and the others are probed term group by term group for the rows still competitive.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import vectors

SHARD, QUERIES, SEED_ROWS, PROBE = 4096, 1024, 256, 8


def search(values: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and integer scores of the ``k`` best rows other than ``own``, ties to the smaller id.

    ``values``: postings, one row per term. Works in float64 where all sums are exact there, else in int64.
    """
    low, high = values.min(axis=1), values.max(axis=1)
    floor = np.minimum(query * low, query * high)
    bound = np.maximum(query * low, query * high) - floor
    order = np.argsort(-bound, kind="stable")
    rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])  # rest[i]: bounds of the terms from i on
    base = floor.sum()
    best_ids, best = np.empty(0, ids.dtype), np.empty(0, values.dtype)
    for part in (np.arange(min(SEED_ROWS, len(ids))), np.arange(SEED_ROWS, len(ids))):  # the first rows set the threshold
        at = part[ids[part] != own]
        least = best[-1] if len(best) == k else None
        # non-essential: the longest tail of terms with base + bounds below the threshold
        done = len(order) if least is None else max(1, int((base + rest >= least).sum()))
        done = min(done, len(order))
        terms = order[:done]
        score = query[terms] @ values[np.ix_(terms, at)] - floor[terms].sum()
        while len(at):
            if least is not None:
                alive = base + score + rest[done] >= least
                at, score = at[alive], score[alive]
            if done == len(order):
                break
            more = order[done:done + PROBE]
            score = score + query[more] @ values[np.ix_(more, at)] - floor[more].sum()
            done += len(more)
        best_ids, best = np.concatenate([best_ids, ids[at]]), np.concatenate([best, score + base])
        top = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[top], best[top]
    return best_ids, best


def top_k(rows: DataFrame, is_query, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score of each query's ``k`` best rows by integer inner product of floor(scale * x).

    ``is_query``: a condition on vec_id. Rows with the query's own vec_id are no candidates. An empty table gives no rows.
    Scores are exact while they fit in a long.
    """
    rows = vectors.valid(rows, zero=True)
    whole = F.transform("embedding", lambda x: F.floor(x * scale).cast("long"))
    rows = rows.withColumn("embedding", whole)
    queries = rows.filter(is_query)
    n = rows.count()

    def run(batch: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        width = max(max(map(len, batch["embedding"])), max(map(len, asked["embedding"])))
        v, q = vectors.matrix(batch["embedding"], width), vectors.matrix(asked["embedding"], width)
        if np.abs(v).max(initial=0) * np.abs(q).max(initial=0) * max(width, 1) * 4 >= 2.0**53:
            fill = lambda s: np.array([[*x, *[0] * (width - len(x))] for x in s], np.int64)
            v, q = fill(batch["embedding"]), fill(asked["embedding"])
        postings, ids = np.ascontiguousarray(v.T), batch["vec_id"].to_numpy(np.int64)
        for own, query in zip(asked["vec_id"], q, strict=True):
            found, score = search(postings, ids, query, own, k) if width else (ids[ids != own][:k], np.zeros(min(k, (ids != own).sum())))
            out += [(own, i, s) for i, s in zip(found.tolist(), score.astype(np.int64).tolist(), strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    shards = max(1, -(-n // SHARD))
    return vectors.merged(vectors.answered(vectors.sharded(rows, n, SHARD), queries, shards, QUERIES, run, "query_id long, vec_id long, score long"), k)
