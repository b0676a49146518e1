"""Exact top-k by inner product with Fagin's threshold algorithm.

Candidates are dealt to blocks of bounded size, queries to blocks of their own; every pair of blocks is one task group.  In a
group each dimension has a list of candidates sorted by value.  A query walks the lists from their best end; once the sum of the
values last seen cannot beat its k-th score, the group is done.  A final ranking joins the groups' k best.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoweave.llm.common import small_batches, stored

#: Candidates and queries in one group; first step down the sorted lists.
BLOCK, QUERY_BLOCK, STEP = 2048, 1024, 64
SCALE = 1024


class SortedLists:
    """One sorted list of candidates for each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")

    def top(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """``(score, id)`` of the k best, other than ``own``; ties to smaller ids."""
        n, dims = self.vectors.shape
        used = np.flatnonzero(query)
        seen = np.zeros(n, bool)
        score = np.zeros(n, np.int64)
        depth, step = 0, STEP
        while True:
            new = min(n, depth + step)
            for d in used:
                part = self.order[depth:new, d] if query[d] < 0 else self.order[n - new: n - depth, d]
                seen[part] = True
            fresh = np.flatnonzero(seen & (score == 0)) if depth else np.flatnonzero(seen)
            score[fresh] = self.vectors[fresh] @ query
            depth, step = new, step * 2
            if depth == n or not len(used):
                seen[:] = True
                score = self.vectors @ query
                break
            edge = [self.order[depth - 1, d] if query[d] < 0 else self.order[n - depth, d] for d in used]
            bound = int(sum(int(query[d]) * int(self.vectors[e, d]) for d, e in zip(used, edge, strict=True)))
            known = score[seen & (self.ids != own)]
            if len(known) >= k and int(np.partition(known, -k)[-k]) > bound:
                break
        good = np.flatnonzero(seen & (self.ids != own))
        best = good[np.lexsort((self.ids[good], -score[good]))[:k]]
        return [(int(score[i]), int(self.ids[i])) for i in best]


def matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def top_inner_products(embeddings: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """``query_id, rank, vec_id, score`` for each query, a row whose ``vec_id`` is divisible by ``every``.

    Components are floor(1024 * x) of x as double, scores 64-bit integer inner products over all other rows, ties to the smaller
    vec_id; a query has fewer rows if there are fewer candidates.  Null vectors, vectors that hold a null or non-finite component and rows
    without vec_id take no part; a vector that is shorter counts as filled with zeros; repeated rows are one row, while
    rows that share an id but not the vector all stand as candidates and queries; an empty table gives no rows.
    """
    small_batches(embeddings.sparkSession)
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = (embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
            .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
            .select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v")).distinct())
    rows = stored(rows, "vectors")
    size = rows.agg(F.count("*").alias("n"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("q"), F.max(F.size("v")).alias("d")).first()
    blocks, query_blocks = max(1, -(-size.n // BLOCK)), max(1, -(-(size.q or 0) // QUERY_BLOCK))
    dims = max(1, size.d or 1)
    one = rows.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).withColumn(
        "cb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int"))
    two = (rows.where(F.col("vec_id") % every == 0).withColumn("qb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(query_blocks)).cast("int"))
           .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))

    def search(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(candidates) and len(queries):
            lists = SortedLists(candidates["vec_id"].to_numpy(), matrix(candidates["v"], dims))
            for i, q in enumerate(matrix(queries["v"], dims)):
                own = int(queries["vec_id"].iloc[i])
                out += [(own, v, s) for s, v in lists.top(q, own, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = one.groupBy("qb", "cb").cogroup(two.groupBy("qb", "cb")).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
