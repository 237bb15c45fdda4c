"""The whole way from questions to packed evidence and answers, for a batch of questions at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import lexicons as L

from . import answers, context, dense, fusion, models, queries, sparse
from .store import keep as keep_rows
from .store import small


@dataclass(frozen=True)
class Options:
    """Depths of a search. A depth of 0 is that of the question's type; reranker and diversity None follow the type as well."""

    top_k: int = 10
    dense_top_k: int = 30
    sparse_top_k: int = 30
    rerank_top_k: int = 30
    mmr_pre: int = 20
    mmr_top: int = 10
    branch_candidates: int = 10
    max_branches: int | None = None
    reranker: bool | None = None
    diversity: bool | None = None
    branch_k: int = fusion.RRF_K
    weight: float = fusion.MMR_LAMBDA
    budget: int = 1200
    extra: int = 1
    hyde: str = "disabled"

    def __post_init__(self):
        if min(self.top_k, self.dense_top_k, self.sparse_top_k, self.rerank_top_k, self.mmr_pre, self.mmr_top, self.branch_candidates, self.extra) < 0:
            raise ValueError("depths must not be negative")
        if self.budget <= 0 or self.branch_k <= 0:
            raise ValueError("budget and branch_k must be positive")


def branch_queries(questions: DataFrame, opts: Options) -> DataFrame:
    """query_id, branch, branch_ord, query, weight and what the branch's search takes: dense_k, sparse_k, depth, rerank, diverse.

    Raw, normalised and expanded texts by the question's plan; a hypothetical text is a branch of vectors alone, neither reranked nor diversified.
    """
    o, plans = opts, queries.analyze(questions)
    rows = queries.branches(plans, limit=o.max_branches)
    if o.hyde != "disabled":
        made = queries.hyde(plans, o.hyde).filter("used and content <> ''").select("query_id", F.lit(3).alias("branch_ord"), F.lit("hyde").alias("branch"), F.col("content").alias("query"), F.lit(L.WEIGHTS["hyde"]).alias("weight"))
        rows = rows.unionByName(made)
    policy = plans.select("query_id", "use_reranker", "use_mmr", "dense_top_k", "sparse_top_k", "rerank_top_k")
    plain = F.col("branch") != "hyde"
    chosen = lambda flag, name: plain & (F.col(name) if flag is None else F.lit(flag))
    depth = lambda n, name: F.lit(n) if n else F.col(name)
    rows = rows.join(policy, "query_id").withColumns({"rerank": chosen(o.reranker, "use_reranker"), "diverse": chosen(o.diversity, "use_mmr"), "dense_k": depth(o.dense_top_k, "dense_top_k"), "sparse_k": F.when(plain, depth(o.sparse_top_k, "sparse_top_k")).otherwise(0)})
    wide = F.greatest(F.lit(max(o.branch_candidates, o.top_k)), F.when(F.col("rerank"), depth(o.rerank_top_k, "rerank_top_k")).otherwise(0), F.when(F.col("diverse"), o.mmr_pre).otherwise(0))
    return rows.withColumn("depth", wide).select("query_id", "branch", "branch_ord", "query", "weight", "dense_k", "sparse_k", "depth", "rerank", "diverse")


def search(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, opts: Options | None = None, encoder: Callable | None = None, score: Column | None = None, keep: Column | None = None, index: sparse.Index | None = None, files: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, scores, rank, matched_branches. All branches of all questions run as one batch keyed by (query, branch).

    keep: a filter over chunks that both searchers apply. score: a rerank expression over query, content and candidate columns.
    index: a term index built before. files: known file names; a question that names one is searched within it alone.
    """
    o = opts or Options()
    rows = branch_queries(questions, o).withColumn("key", F.concat_ws("|", F.col("query_id").cast("string"), "branch"))
    if files is not None:
        rows = rows.join(queries.detect_file(questions, files), "query_id", "left")
    rows = keep_rows(rows, "branches")  # a few rows a question, read by every step below
    flags = rows.select(F.col("key").alias("query_id"), F.col("query_id").alias("_q"), "branch", "branch_ord", "weight", "dense_k", "sparse_k", "depth", "rerank", "diverse", F.col("query").alias("_query"))
    asked = rows.select(F.col("key").alias("query_id"), "query", "branch", *(["source_file"] if files is not None else []))
    most = rows.agg(*[F.max(c).alias(c) for c in ("dense_k", "sparse_k", "depth")]).first()
    if o.top_k == 0 or most.depth is None:
        return fusion.fuse_branches(_no_hits(chunks, questions), 0, o.branch_k)
    within = None if keep is None else chunks.filter(keep).select("chunk_id")
    pool = vectors if within is None else vectors.join(within, "chunk_id", "left_semi")
    near = dense.dense_topk(models.embed(asked, "query", encoder), pool, most.dense_k)
    terms = sparse.bm25_topk(asked.filter("branch <> 'hyde'"), index or chunks, most.sparse_k, within=within)
    cut = lambda t, c: t.join(flags.select("query_id", c), "query_id").filter(F.col("rank") <= F.col(c)).drop(c)
    hits = cut(fusion.rrf(cut(near, "dense_k"), cut(terms, "sparse_k"), most.depth), "depth").join(flags.drop("dense_k", "sparse_k", "depth"), "query_id")
    if score is not None:
        text = small(keep_rows(hits, "fused")).withColumnRenamed("_query", "query").join(chunks.select("chunk_id", "content"), "chunk_id")
        hits = fusion.rerank(text, F.when(F.col("rerank"), score)).drop("content", "query", "stage4_rank")
    else:
        hits = hits.withColumn("rerank_score", F.lit(None).cast("double"))
    hits = keep_rows(hits, "hits")  # a ranked list for each branch, read twice below: bounded by depth
    top = max(o.branch_candidates, o.top_k)
    mixed = small(hits.filter("diverse").select("query_id", "chunk_id", "rank", F.coalesce("rerank_score", "fusion_score").alias("relevance")))
    picked = fusion.mmr(mixed, vectors, top, o.weight, max(o.mmr_pre, top))
    chosen = hits.join(picked.select("query_id", "chunk_id", "mmr_score", F.col("rank").alias("mmr_rank")), ["query_id", "chunk_id"], "left")
    chosen = chosen.filter("mmr_rank is not null or not diverse").withColumn("pos", F.coalesce("mmr_rank", "rank")).filter(F.col("pos") <= top)
    return fusion.fuse_branches(chosen.select(F.col("_q").alias("query_id"), "branch", "branch_ord", "weight", "pos", "chunk_id", "dense_score", "sparse_score", "rerank_score", "mmr_score"), o.top_k, o.branch_k)


def _no_hits(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    kinds = dict(questions.dtypes)["query_id"], dict(chunks.dtypes)["chunk_id"]
    return chunks.sparkSession.createDataFrame([], f"query_id {kinds[0]}, branch string, branch_ord int, weight double, pos int, chunk_id {kinds[1]}, dense_score double, sparse_score double, rerank_score double, mmr_score double")


def ask(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, opts: Options | None = None, outside: DataFrame | None = None, **how) -> dict[str, DataFrame]:
    """hits, packed context, evidence and answers for a batch of questions.

    The domain gate gets each question's best confidence. outside: a gate of another kind (query_id, decision), asked where the rules are uncertain.
    """
    o = opts or Options()
    hits = keep_rows(search(questions, chunks, vectors, o, **how), "ranked")  # top_k rows a question, read by every later step
    packed = keep_rows(context.pack(hits, chunks, o.budget, o.extra), "packed")
    found = keep_rows(answers.evidence(packed.select("query_id", F.col("chunk_ids")[0].alias("chunk_id"), F.col("pack_order").alias("rank"), "source_file", "section_path_text", "content", *context.SCORES, "chunk_ids")), "evidence")
    best = found.groupBy("query_id").agg(F.max("retrieval_confidence").alias("_best"))
    gate = queries.domain_gate(questions.join(best, "query_id", "left"), confidence=F.col("_best"))
    if outside is not None:
        gate = queries.second_gate(gate, outside)
    return {"hits": hits, "packed": packed, "evidence": found, "gate": gate, "answers": answers.answer(questions, found, gate)}


def contents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The texts of hits, in rank order for each question, as one array."""
    rows = hits.join(chunks.select("chunk_id", "content"), "chunk_id")
    return rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]).alias("contents"))
