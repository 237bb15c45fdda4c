"""Rank fusion, reranking and diversity selection over ranked lists keyed by query."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K, MMR_LAMBDA = 60, 0.7


def reciprocal(rank: Column, k: int = RRF_K) -> Column:
    """1 / (k + rank); nothing for a missing rank or one below 1."""
    return F.when(rank > 0, 1.0 / (F.lit(float(k)) + rank)).otherwise(F.lit(0.0))


def ranked(df: DataFrame, by: list[Column], k: int | None = None, keys: tuple[str, ...] = ("query_id",), name: str = "rank") -> DataFrame:
    out = df.drop(name).withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*by)))
    return out if k is None else out.filter(F.col(name) <= k)


def rrf(dense: DataFrame, sparse: DataFrame, k: int = 10, rrf_k: int = RRF_K) -> DataFrame:
    """Full outer join of two ranked lists: query_id, chunk_id, dense_score, sparse_score, fusion_score, rank."""
    d = dense.select("query_id", "chunk_id", F.col("score").alias("dense_score"), F.col("rank").alias("d"))
    s = sparse.select("query_id", "chunk_id", F.col("score").alias("sparse_score"), F.col("rank").alias("s"))
    both = d.join(s, ["query_id", "chunk_id"], "full_outer").withColumn("raw", reciprocal(F.col("d"), rrf_k) + reciprocal(F.col("s"), rrf_k))
    out = ranked(both, [F.desc(F.round("raw", 9)), F.col("chunk_id")], k)
    return out.select("query_id", "chunk_id", "dense_score", "sparse_score", F.round("raw", 6).alias("fusion_score"), "rank")


def fuse_branches(hits: DataFrame, k: int = 10, rrf_k: int = RRF_K) -> DataFrame:
    """hits: query_id, branch, branch_ord, weight, pos, chunk_id, scores. Weighted sum over branches by list position.

    The best of each score stays, matched branches come in their order with the rank and score of each; ties go to the better
    position, then the smaller id. The hidden text of a generated branch is masked.
    """
    score = F.col("weight") * reciprocal(F.col("pos"), rrf_k)
    detail = F.struct("branch_ord", "branch", "weight", F.col("pos").alias("rank"), F.round(score, 6).alias("branch_score"))
    best = [F.max(c).alias(c) for c in ("dense_score", "sparse_score", "rerank_score", "mmr_score") if c in hits.columns]
    out = hits.groupBy("query_id", "chunk_id").agg(F.sum(score).alias("raw"), F.min("pos").alias("best_rank"), F.array_sort(F.collect_list(detail)).alias("details"), *best)
    out = ranked(out, [F.desc(F.round("raw", 9)), F.col("best_rank"), F.col("chunk_id")], k)
    return out.withColumn("matched_branches", F.array_distinct(F.transform("details", lambda x: x["branch"]))).withColumn("fusion_score", F.round("raw", 6)).drop("raw")


def rerank(candidates: DataFrame, score: Column) -> DataFrame:
    """Every candidate gets the score, rounded first; then rank by score, previous rank, id. A null score keeps the old order last."""
    out = candidates.withColumn("rerank_score", F.round(score, 6)).withColumn("_old", F.col("rank"))
    return ranked(out, [F.desc_nulls_last("rerank_score"), F.col("_old"), F.col("chunk_id")]).withColumn("stage4_rank", F.col("rank")).drop("_old")


def final_slice(candidates: DataFrame, k: int) -> DataFrame:
    """The first k by rank, renumbered; the second-stage rank is set only where a second-stage score exists."""
    out = ranked(candidates.withColumnRenamed("rank", "_old"), [F.col("_old"), F.col("chunk_id")], k).drop("_old")
    staged = F.lit(False)
    for c in ("rerank_score", "mmr_score"):
        if c in candidates.columns:
            staged = staged | F.col(c).isNotNull()
    return out.withColumn("stage4_rank", F.when(staged, F.col("rank")))


def pick_mmr(relevance: np.ndarray, vectors: np.ndarray, k: int, weight: float) -> tuple[list[int], list[float]]:
    """Greedy picks: weight * relevance - (1 - weight) * largest cosine to what is picked. Ties: relevance, then the earlier."""
    rel = relevance.astype(np.float32)
    lo, hi = rel.min(), rel.max()
    rel = np.ones_like(rel) if hi == lo else (rel - lo) / (hi - lo)
    n = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(n == 0, 1, n)
    cosine = np.clip(unit @ unit.T, -1, 1)
    picked, scores = [int(np.argmax(rel))], [float(rel.max())]
    while len(picked) < min(k, len(rel)):
        value = weight * rel - (1 - weight) * cosine[:, picked].max(axis=1)
        value[picked] = -np.inf
        best = max(range(len(rel)), key=lambda i: (value[i], rel[i], -i))
        picked.append(best)
        scores.append(float(value[best]))
    return picked, scores


def mmr(candidates: DataFrame, vectors: DataFrame, k: int = 10, weight: float = MMR_LAMBDA, depth: int = 20) -> DataFrame:
    """candidates: query_id, chunk_id, rank, relevance. The first ``depth`` by rank are joined with their vectors, k are picked.

    A group holds at most ``depth`` rows, so it fits a task whatever the data.
    """
    if not 0 <= weight <= 1:
        raise ValueError("weight must be within [0, 1]")
    pool = candidates.filter(F.col("rank") <= depth).join(vectors.select("chunk_id", F.col("vector").cast("array<double>").alias("vector")), "chunk_id")
    qtype, ctype = dict(candidates.dtypes)["query_id"], dict(candidates.dtypes)["chunk_id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "chunk_id"])
        if len(pdf) == 1:
            picked, scores = [0], [1.0]
        else:
            picked, scores = pick_mmr(pdf["relevance"].to_numpy(), np.stack(pdf["vector"].to_numpy()), k, weight)
        out = pdf.iloc[picked]
        return pd.DataFrame({"query_id": out["query_id"], "chunk_id": out["chunk_id"], "mmr_score": np.round(scores, 6), "rank": range(1, len(picked) + 1)})

    return pool.select("query_id", "chunk_id", "rank", F.col("relevance").cast("double").alias("relevance"), "vector").groupBy("query_id").applyInPandas(run, f"query_id {qtype}, chunk_id {ctype}, mmr_score double, rank int")


def first_as_mmr(candidates: DataFrame, k: int) -> DataFrame:
    """A stand-in for mmr in quick runs: the first k by rank with score 1 / rank."""
    out = ranked(candidates.withColumnRenamed("rank", "_old"), [F.col("_old"), F.col("chunk_id")], k).drop("_old")
    return out.withColumns({"mmr_score": F.round(1.0 / F.col("rank"), 6), "stage4_rank": F.col("rank")})


def candidate_depth(top: int, rerank_top: int, mmr_pre: int) -> int:
    return max(top, rerank_top, mmr_pre)
