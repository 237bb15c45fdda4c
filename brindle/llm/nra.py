"""Exact top-k by inner product with no-random-access aggregation.

A block of candidates is indexed as one list for each dimension, sorted by the component. For a query a list is read from its high
end where the query's component is positive and from its low end where it is negative, always in sequence and all lists to the same
depth. What has been read gives each candidate an upper bound (unread components count as the value at the reading front) and a
lower bound (as the worst value of their list); a candidate that no list has shown yet is bounded by the fronts alone. A query's *bar* is
the k-th best score it is sure of. Reading of its lists begins to be judged at the depth where outsiders are below the bar; from
there on, candidates whose upper bound is below it leave, lower bounds raise it, and each query stops by itself when no more than k
are left or the lists end. The scores of what is left are resolved from its remaining entries.

The candidates stay where they are read: a task goes through its blocks in turn, and the bar a query has reached in one block holds in
the next. Queries go to the tasks in rounds of at most QUERIES, which bounds what is sent whatever the size of the table. The
bar of a round starts from one block of at most BLOCK rows that the driver scores. A task passes on k rows a query, so what is shuffled
is k rows for each query and task and no vector at all.

Scores are integers. Products are taken in double precision while they must be below 2**53 and in Python integers beyond it; scores
outside 64 bits stand as the largest or smallest 64-bit integer. Defined cases: vectors that are null or hold null
or non-finite components take no part; shorter vectors count as padded with zeros; rows with a query's own id are never its
candidates; repeated rows of an id are one candidate each, ranked by score; equal query rows are one query (of different rows of one id the
smallest vector); ties go to the smaller id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Work

#: Candidates of one block, queries of one round, and queries whose bounds are taken together.
BLOCK, QUERIES, TOGETHER = 4096, 4096, 512
#: Shares of the lists at which bounds are taken.
DEPTHS = np.arange(1, 9) / 8


def usable(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v: integer components of the vectors that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))) & F.col("vec_id").isNotNull()
    return vectors.filter(ok).select("vec_id", F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), width), np.int64)
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def nra_top_k(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, trace: list | None = None, bar: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top k of a block for each query, as far as they reach its bar: index of the query, index of the candidate, score. Ties to the smaller id.

    trace receives (depth, queries still open, their candidates) before each depth, and at last (1.0, queries, candidates) for what is resolved.
    """
    n, width = x.shape
    lists = np.sort(x, axis=0)  # the sorted lists, worst first for a positive component
    both = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1)
    bar = np.full(len(q), -np.inf) if bar is None else bar.astype(float)
    alive = ids[None, :] != q_ids[:, None]
    need = np.minimum(k, alive.sum(axis=1))
    at = [max(1, math.ceil(n * d)) for d in DEPTHS]
    fronts = np.stack([np.concatenate([lists[n - t], lists[t - 1]]) for t in at])
    out = (both @ fronts.T) < bar[:, None]  # at which depths a candidate that no list has shown is out
    begin = np.where(np.isinf(bar), len(at) // 2 - 1, np.where(out.any(axis=1), out.argmax(axis=1), len(at) - 1))
    for step, depth in enumerate(DEPTHS[:-1]):
        rows = np.flatnonzero((begin <= step) & (alive.sum(axis=1) > need))  # a query with no more than it needs reads no further
        if not len(rows) or at[step] == n:
            continue
        if trace is not None:
            trace.append((float(depth), len(rows), int(alive[rows].sum())))
        high, low = fronts[step][:width], fronts[step][width:]
        cols = np.flatnonzero(alive[rows].any(axis=0))
        own = x[cols]
        upper = both[rows] @ np.concatenate([np.maximum(own, high), np.minimum(own, low)], axis=1).T
        open_ = alive[np.ix_(rows, cols)] & (upper >= bar[rows, None])
        keep = np.flatnonzero(open_.any(axis=0))
        own = own[keep]
        lower = both[rows] @ np.concatenate([np.where(own >= high, own, lists[0]), np.where(own <= low, own, lists[-1])], axis=1).T
        sure = np.where(open_[:, keep], lower, -np.inf)
        full = np.flatnonzero((open_.sum(axis=1) >= k) & (need[rows] == k))
        if len(full) and len(keep) >= k > 0:
            bar[rows[full]] = np.maximum(bar[rows[full]], np.partition(sure[full], len(keep) - k, axis=1)[:, len(keep) - k])
        alive[np.ix_(rows, cols)] = open_ & (upper >= bar[rows, None])
    alive &= (need > 0)[:, None]
    if trace is not None:
        trace.append((1.0, int(alive.any(axis=1).sum()), int(alive.sum())))
    out_a, out_b, out_s = [], [], []
    for i in np.flatnonzero(alive.any(axis=1)):  # what is left of the lists resolves the scores of those that qualify
        c = np.flatnonzero(alive[i])
        score = x[c] @ q[i]
        best = np.lexsort((ids[c], -score))[:k]
        best = best[score[best] >= bar[i]]
        out_a.append(np.full(len(best), i))
        out_b.append(c[best])
        out_s.append(score[best])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(out_a, np.int64), join(out_b, np.int64), join(out_s, float)


def _large(x: np.ndarray, q: np.ndarray) -> bool:
    """Whether a score could pass 2**53, where doubles are no longer exact."""
    return bool(x.size and q.size) and float(np.abs(x.astype(float)).max()) * float(np.abs(q.astype(float)).max()) * x.shape[1] >= 2.0**53


def _all_scores(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For blocks with components so large that bounds in doubles would not be exact: Python integers."""
    out, wide = [], x.astype(object)
    for i, v in enumerate(q.astype(object)):
        score = np.array([min(2**63 - 1, max(-(2**63), s)) for s in wide @ v], np.int64)
        c = np.flatnonzero(ids != q_ids[i])
        best = c[np.lexsort((ids[c], ~score[c]))[:k]]
        out.append((np.full(len(best), i), best, score[best]))
    return tuple(np.concatenate(p) for p in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


class Best:
    """The k best of each query of a round so far, by score and then the smaller id."""

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, k: int, bar: np.ndarray):
        self.q, self.q_ids, self.k, self.bar = q, q_ids, k, bar
        self.row, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def meet(self, x: np.ndarray, ids: np.ndarray) -> None:
        parts = []
        exact = _large(x, self.q)
        values = x if exact else x.astype(float)
        for a in range(0, len(self.q), TOGETHER):
            own = slice(a, a + TOGETHER)
            row, col, score = _all_scores(x, ids, self.q[own], self.q_ids[own], self.k) if exact else nra_top_k(values, ids, self.q[own].astype(float), self.q_ids[own], self.k, None, self.bar[own])
            parts.append((row + a, ids[col], score.astype(np.int64)))
        row, id_, score = (np.concatenate([old, *new]) for old, new in zip((self.row, self.id, self.score), zip(*parts, strict=True), strict=True))
        order = np.lexsort((id_, ~score, row))  # ~score: descending, without overflow
        row, id_, score = row[order], id_[order], score[order]
        start = np.searchsorted(row, np.arange(len(self.q) + 1))
        place = np.arange(len(row)) - start[row]
        full = np.flatnonzero(np.diff(start) >= self.k)
        if self.k:
            last = score[start[full] + self.k - 1]
            self.bar[full] = np.maximum(self.bar[full], np.where(np.abs(last) < 2**53, last, -np.inf))
        stay = place < self.k
        self.row, self.id, self.score = row[stay], id_[stay], score[stay]


OUT = "query_id long, vec_id long, score long"


def top_k_search(vectors: DataFrame, k: int = 10, is_query: F.Column | None = None, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score."""
    work = Work(vectors.sparkSession, "nra")
    rows = work.keep(usable(vectors, scale), "vectors")
    is_query = F.col("vec_id") % 100 == 0 if is_query is None else is_query
    queries = work.keep(rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    rounds = max(1, math.ceil(queries.count() / (QUERIES * 0.9)))  # hashing deals them unevenly
    seed = rows.limit(BLOCK).toArrow()
    found = [_round(queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == i), rows, seed, k, width) for i in range(rounds)]
    if rounds > 1:
        found = [work.keep(t, f"round-{i}") for i, t in enumerate(found)]
    whole = found[0]
    for t in found[1:]:
        whole = whole.unionByName(t)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return whole.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _round(queries: DataFrame, rows: DataFrame, seed: pa.Table, k: int, width: int) -> DataFrame:
    """The k best of each task for one round of queries."""
    asked = queries.toArrow()
    q, q_ids = _matrix(asked["v"], width), asked["vec_id"].to_numpy()
    start = Best(q, q_ids, k, np.full(len(q), -np.inf))
    if seed.num_rows and len(q):
        start.meet(_matrix(seed["v"], width), seed["vec_id"].to_numpy())
    first_bar = start.bar

    def run(batches):
        best = Best(q, q_ids, k, first_bar.copy())
        for batch in batches:
            for a in range(0, batch.num_rows if len(q) else 0, BLOCK):
                part = batch.slice(a, BLOCK)
                best.meet(_matrix(part.column("v"), width), part.column("vec_id").to_numpy())
        for a in range(0, len(best.row), 10_000):
            own = slice(a, a + 10_000)
            yield pa.RecordBatch.from_pydict({"query_id": q_ids[best.row[own]], "vec_id": best.id[own], "score": best.score[own]})

    return rows.mapInArrow(run, OUT)
