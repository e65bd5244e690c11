"""Exact top-k inner products by MaxScore over shards of integer vectors.

A component is a term, a vector's value in it the posting weight. Candidates are dealt into shards by a hash of their
id; a shard holds its postings term by term with the largest and least weight of each. For a query, a term's bound
is the most it can add. Terms in ascending order of bound whose bounds together stay below the k-th best score
so far are non-essential: a vector in none of the other, essential, postings cannot compete. Essential postings are
traversed; their vectors are kept while partial score plus the bounds left can reach the k-th score, and probed in
the non-essential terms, largest bound first. The best of all shards are merged per query.

Queries are taken in blocks of about ``QUERY_BLOCK`` by a hash of their id, and only one block at a time is collected, sent to the tasks
and searched; its candidates are written before the next one.
Rows with a null id, a null vector or a null or non-finite component take no part. Rows of one id count once (with
several vectors: the least). Shorter vectors end in zeros. Ties go to the smaller id. Scores beyond a long saturate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farewise.session import materialize

K = 5
SCALE = 256
QUERY_BLOCK = 2048
SHARD_ROWS = 8192
PROBE_TERMS = 8
#: Sums of products below this are exact in doubles.
EXACT = 2 ** 53
LONG = 2 ** 63 - 1


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``vec_id, w`` with w = floor(scale * x) per component, one row per id."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    ok = F.col(id_col).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.filter(ok).select(F.col(id_col).cast("long").alias("vec_id"),
                                     F.transform(x, lambda v: F.floor(F.lit(scale) * v)).alias("w"))
    return rows.groupBy("vec_id").agg(F.min("w").alias("w"))


def _matrix(rows: list[list[int]], width: int) -> np.ndarray:
    """Rows cut or zero-filled to ``width``, as 64-bit integers."""
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, :min(width, len(r))] = r[:width]
    return out


class Shard:
    """Postings of some vectors, term by term, with bounds of their weights."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, exact: bool):
        self.ids = ids
        self.weights = np.ascontiguousarray(weights.T.astype(np.float64 if exact else object))
        self.high, self.low = self.weights.max(axis=1), self.weights.min(axis=1)
        self.postings = [np.flatnonzero(w) for w in self.weights]
        self.sparse = sum(len(p) for p in self.postings) < 0.25 * self.weights.size

    def _essential(self, query: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, partial scores) of the vectors in at least one posting of ``terms``."""
        if not self.sparse:
            return np.arange(len(self.ids)), query[terms] @ self.weights[terms]
        total = np.zeros(len(self.ids), self.weights.dtype)
        seen = np.zeros(len(self.ids), bool)
        for t in terms:
            p = self.postings[t]
            total[p] += query[t] * self.weights[t, p]
            seen[p] = True
        rows = np.flatnonzero(seen)
        return rows, total[rows]

    def search(self, query: np.ndarray, own: int, best: tuple[np.ndarray, np.ndarray], k: int):
        """The k best (scores, ids) of ``best`` and this shard, without the query's own id."""
        floor = best[0][-1] if len(best[0]) == k else None
        bound = np.maximum(np.maximum(query * self.high, query * self.low), 0)
        order = np.argsort(bound, kind="stable")
        sums = np.cumsum(bound[order])
        cut = int(np.searchsorted(sums, floor, side="left")) if floor is not None else 0
        others, essential = order[:cut][::-1], order[cut:]
        rows, score = self._essential(query, essential)
        # a vector in no essential posting of a sparse shard scores what the others give it, below the floor; without a
        # floor, or with one of zero or less, all terms are essential and it scores zero, which may compete
        rest = np.setdiff1d(np.arange(len(self.ids)), rows) if floor is None or floor <= 0 else rows[:0]
        left = sums[cut - 1] if cut else 0
        if floor is not None:
            keep = score + left >= floor
            rows, score = rows[keep], score[keep]
        for a in range(0, len(others), PROBE_TERMS):
            if not len(rows):
                break
            some = others[a:a + PROBE_TERMS]
            score = score + query[some] @ self.weights[np.ix_(some, rows)]
            left = sums[cut - a - len(some) - 1] if cut - a - len(some) else 0
            keep = score + left >= floor
            rows, score = rows[keep], score[keep]
        if len(rest):
            rows, score = np.concatenate([rows, rest]), np.concatenate([score, np.zeros(len(rest), score.dtype)])
        ids = self.ids[rows]
        mine = ids != own
        score, ids = np.concatenate([best[0], score[mine]]), np.concatenate([best[1], ids[mine]])
        if len(score) > 4 * k and score.dtype != object:
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            score, ids = score[keep], ids[keep]
        top = sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[:k]
        return score[top], ids[top]


def search_block(vectors: DataFrame, query_ids: list[int], query_weights: np.ndarray, k: int) -> DataFrame:
    """The k best of each partition for each query: ``query_id, vec_id, score``."""
    width, most = query_weights.shape[1], int(np.abs(query_weights.astype(object)).max(initial=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list = [(np.zeros(0), np.zeros(0, np.int64)) for _ in query_ids]
        for batch in batches:
            for lo in range(0, batch.num_rows, SHARD_ROWS):
                part = batch.slice(lo, SHARD_ROWS)
                weights = _matrix(part.column("w").to_pylist(), width)
                exact = most * int(np.abs(weights.astype(object)).max(initial=0)) * max(width, 1) < EXACT
                shard = Shard(part.column("vec_id").to_numpy(), weights, exact)
                for i, own in enumerate(query_ids):
                    q = query_weights[i].astype(shard.weights.dtype)
                    best[i] = shard.search(q, own, best[i], k)
        rows = [(own, int(v), max(-LONG - 1, min(LONG, int(s)))) for own, (ss, vs) in zip(query_ids, best)
                for s, v in zip(ss, vs)]
        yield pa.record_batch({n: pa.array([r[j] for r in rows], pa.int64())
                               for j, n in enumerate(["query_id", "vec_id", "score"])})

    return vectors.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
          scale: int = SCALE, query_block: int = QUERY_BLOCK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows of each row for which ``is_query`` (over vec_id) holds."""
    spark = vectors.sparkSession
    data = materialize(quantised(vectors, id_col, vector_col, scale), "vectors")
    rows = data.count()
    shards = data.repartition(max(1, -(-rows // shard_rows)), "vec_id")
    asked = data.filter(is_query)
    blocks = -(-asked.count() // query_block)
    found = None
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").collect()
        if block:
            width = max(len(r.w) for r in block)
            part = materialize(search_block(shards, [r.vec_id for r in block], _matrix([r.w for r in block], width), k), "block")
            found = part if found is None else found.unionAll(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS w
           FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""
