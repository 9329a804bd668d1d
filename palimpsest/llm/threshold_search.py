"""Exact top-k inner-product search by Fagin's threshold algorithm (operator 4).

Vectors become integer components. Candidates are dealt into blocks and queries
into blocks; a task takes one pair of blocks. In it every dimension's list is
sorted once. Sorted access goes down all lists in parallel, from the top end
where a query's component is positive and from the bottom end where it is
negative; each candidate met is scored in full. After each step a query's bound
is the score of a vector made of the last values seen; it stops once the bound
is below its kth score (at an equal bound an unseen smaller id could still tie).
The blocks' lists of k are merged by rank. Queries against candidates in blocks
are the stated query set; no pair of single rows is emitted.

Defined cases: vectors that are null, empty or hold null or non-finite
components take no part; equal rows (same id and components) count once, rows
with one id and different vectors are all candidates, and none of them is a
candidate of a query of that id; vectors are compared with those of their own
length only; an empty table gives no rows; extra columns are ignored. Inner
products whose size could pass 2^62 are computed with unbounded integers and
clamped to the range of long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOUND = "query_id long, vec_id long, score long"


def quantized(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, q array<long>) of the rows of ``vectors`` (vec_id, embedding) that take part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (
        vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(finite, F.lit(False)))
        .select(F.col("vec_id").cast("long"), F.transform(x, lambda v: F.floor(v * scale)).alias("q"))
        .dropDuplicates()
    )


def _products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Integer inner products, queries x rows, by the fastest exact arithmetic."""
    if not rows.size or not queries.size:
        return np.zeros((len(queries), len(rows)), np.int64)
    most = float(np.abs(rows.astype(float)).max()) * float(np.abs(queries.astype(float)).max()) * rows.shape[1]
    if most < 2**53:
        return np.rint(queries.astype(float) @ rows.T.astype(float)).astype(np.int64)
    if most < 2**62:
        return queries @ rows.T
    exact = queries.astype(object) @ rows.T.astype(object)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def threshold_top_k(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, step: int = 64) -> list[tuple[int, int, int]]:
    """(query, id, score) of each query's k best rows, ties to the smaller id."""
    by_id = np.argsort(ids, kind="stable")
    ids, rows = ids[by_id], rows[by_id]
    order = np.argsort(rows, axis=0, kind="stable")  # each dimension's list, ascending
    n, dims = rows.shape
    top_scores = np.full((len(queries), 0), 0, np.int64)
    top_places = np.zeros((len(queries), 0), np.int64)
    seen, open_, depth = np.zeros(n, bool), np.arange(len(queries)), 0
    while len(open_) and depth < n:
        upto = min(n, depth + step)
        up, down = (queries[open_] > 0).any(0), (queries[open_] < 0).any(0)
        met = np.concatenate([order[n - upto : n - depth][:, up].ravel(), order[depth:upto][:, down].ravel()])
        if not len(met):  # queries of zeros: all rows score 0
            met, upto = np.arange(n), n
        fresh = np.unique(met[~seen[met]])
        seen[fresh] = True
        if len(fresh):
            scores = _products(rows[fresh], queries[open_])
            scores_all = np.concatenate([top_scores[open_], scores], 1)
            places = np.concatenate([top_places[open_], np.broadcast_to(fresh, scores.shape)], 1)
            own = ids[places] == query_ids[open_][:, None]
            # best score first, then the smaller place, which is the smaller id; the query's own rows last
            best = np.lexsort((places, -scores_all.clip(-(2**63) + 1), own), axis=1)[:, : k + 1] if scores_all.shape[1] <= 4 * k else _best(scores_all, places, own, k)
            if top_scores.shape[1] != best.shape[1]:
                grown = np.zeros((len(queries), best.shape[1]), np.int64), np.zeros((len(queries), best.shape[1]), np.int64)
                grown[0][:, : top_scores.shape[1]], grown[1][:, : top_places.shape[1]] = top_scores, top_places
                top_scores, top_places = grown
            top_scores[open_], top_places[open_] = np.take_along_axis(scores_all, best, 1), np.take_along_axis(places, best, 1)
        depth = upto
        if depth < n and top_scores.shape[1] > k:
            cols = np.arange(dims)
            high, low = rows[order[n - depth], cols], rows[order[depth - 1], cols]
            q = queries[open_].astype(float)
            limit = (np.where(q > 0, q, 0) * high + np.where(q < 0, q, 0) * low).sum(1)
            kth = top_scores[open_][:, k - 1].astype(float)
            slack = 1 + 1e-9 * np.abs(limit)  # the bound is a double; never stop early for its rounding
            real = ids[top_places[open_][:, k - 1]] != query_ids[open_]
            open_ = open_[~(real & (limit + slack < kth))]
    out = []
    for q, (scores, places) in enumerate(zip(top_scores, top_places)):
        out += [(int(query_ids[q]), int(ids[p]), int(s)) for s, p in zip(scores, places) if ids[p] != query_ids[q]][:k]
    return out


def _best(scores: np.ndarray, places: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k + 1 best of each row, best first."""
    out = np.empty((len(scores), k + 1), np.int64)
    for r, (s, p, o) in enumerate(zip(scores, places, own)):
        s = np.where(o, -(2**63), s)
        floor = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
        near = np.flatnonzero(s >= floor)
        out[r] = near[np.lexsort((p[near], -(s[near].clip(-(2**63) + 1)), o[near]))[: k + 1]]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, block: int = 8192, query_block: int = 2048, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` (vec_id, embedding) where ``is_query`` holds."""
    base = quantized(vectors, scale).withColumn("dims", F.size("q"))
    asks = base.where(is_query)
    counts = base.agg(F.count("*").alias("n"), F.count_if(is_query).alias("m")).first()
    blocks, query_blocks = -(-counts["n"] // block) or 1, -(-counts["m"] // query_block) or 1
    salt = lambda n: F.pmod(F.xxhash64("vec_id", "q"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asks.select("*", salt(query_blocks).alias("qb"), spread(blocks).alias("cb"))
    right = base.select("*", salt(blocks).alias("cb"), spread(query_blocks).alias("qb"))

    def search(ask: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(ask) and len(rows):
            found = threshold_top_k(rows["vec_id"].to_numpy(), np.stack(rows["q"]).astype(np.int64), ask["vec_id"].to_numpy(), np.stack(ask["q"]).astype(np.int64), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    keys = ("dims", "cb", "qb")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, FOUND)
    best = F.row_number().over(_by_query())
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_query():
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
