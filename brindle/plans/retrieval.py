"""Queries of the index, the searchers and rank fusion, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import dense, fusion, selection, sparse

from . import corpus as C

TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+|[一-鿿]')"
CHUNKS = "SELECT 'doc_' || doc_id || '.md::0' AS chunk_id, 'doc_' || doc_id || '.md' AS source_file, source AS section_path_text, text AS content, doc_id FROM documents"
POSTINGS = f"""
chunks AS ({CHUNKS}),
toks AS (SELECT chunk_id, source_file, section_path_text, {TOKENS.format("concat_ws(chr(10), source_file, section_path_text, content)")} AS t FROM chunks),
post AS (SELECT chunk_id, term, count(*) AS tf, n AS doc_len FROM (SELECT chunk_id, len(t) AS n, unnest(t) AS term FROM toks) GROUP BY chunk_id, term, n),
stats AS (SELECT count(*) AS doc_count, avg(len(t)) AS avg_doc_len FROM toks)"""
BM25 = (
    POSTINGS
    + f""",
wanted AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOKENS.format("text")}) AS term FROM benchmark) GROUP BY query_id, term),
freq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
scored AS (SELECT w.query_id, p.chunk_id, sum(w.qtf * ln(1 + (s.doc_count - f.df + 0.5) / (f.df + 0.5)) * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.doc_len / s.avg_doc_len))) AS raw
  FROM post p JOIN wanted w USING (term) JOIN freq f USING (term) CROSS JOIN stats s {{where}} GROUP BY w.query_id, p.chunk_id),
bm25 AS (SELECT query_id, chunk_id, round(raw, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, chunk_id) AS INTEGER) AS rank FROM scored WHERE raw > 0)"""
)
ALL = BM25.format(where="")
VEC = "CAST(embedding AS DOUBLE[])"
DENSE = """
vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, {score} AS raw FROM vecs q, vecs c WHERE q.vec_id % 100 = 0 {more}),
dense AS (SELECT query_id, chunk_id, round(raw, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) {order}, chunk_id) AS INTEGER) AS rank FROM pairs)"""
COSINE = "list_inner_product(q.v, c.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(c.v, c.v)))"


def bm25_postings(s, d):
    return sparse.postings(C.chunks(s, d)).select("chunk_id", "term", "tf")


def bm25_stats(s, d):
    c = C.chunks(s, d)
    terms = sparse.term_table(sparse.postings(c))
    return sparse.corpus_stats(c, terms).join(F.broadcast(terms.agg(F.count("*").alias("terms")))).select("doc_count", F.round("avg_doc_len", 6).alias("avg_doc_len"), "terms")


def bm25_topk(s, d):
    return sparse.bm25_topk(C.questions(s, d), C.index(s, d), 10)


def bm25_topk_filtered(s, d):
    return sparse.bm25_topk(C.questions(s, d), C.index(s, d), 10, within=C.chunks(s, d).filter("section_path_text = 'src1'"))


def bm25_matched_terms(s, d):
    q, index = C.questions(s, d), C.index(s, d)
    hits = sparse.bm25_topk(q, index, 3)
    return sparse.matched_terms(q, hits, index.postings).select("query_id", "chunk_id", F.array_join("matched_terms", " ").alias("terms"))


def _dense(metric):
    return lambda s, d: dense.dense_topk(C.vector_queries(s, d), C.vectors(s, d), 10, metric)


def dense_topk_filtered(s, d):
    return dense.dense_topk(C.vector_queries(s, d), C.vectors(s, d), 10, "cosine", keep=dense.payload_filter({"label": [1, 2, 3], "chunk_id": None}))


def _lists(s, d, k=30):
    """Vector hits and term hits for the benchmark's questions; question i has vector i."""
    q = C.questions(s, d)
    v = C.vectors(s, d)
    near = dense.dense_topk(q.join(v, q["query_id"] == v["chunk_id"]).select("query_id", "vector"), v, k)
    return near.select("query_id", F.concat(F.lit("doc_"), F.col("chunk_id").cast("string"), F.lit(".md::0")).alias("chunk_id"), "score", "rank"), sparse.bm25_topk(q, C.index(s, d), k)


def hybrid_rrf(s, d):
    return fusion.rrf(*_lists(s, d), k=10)


def branch_weighted_rrf(s, d):
    a, b = _lists(s, d, 20)
    none = F.lit(None).cast("double")
    rows = a.select("query_id", "chunk_id", F.lit("raw").alias("branch"), F.lit(0).alias("branch_ord"), F.lit(1.0).alias("weight"), F.col("rank").alias("pos"), F.col("score").alias("dense_score"), none.alias("sparse_score"))
    rows = rows.union(b.select("query_id", "chunk_id", F.lit("expanded"), F.lit(1), F.lit(0.7), "rank", none, "score"))
    return fusion.fuse_branches(rows, 10).select("query_id", "chunk_id", "fusion_score", "best_rank", "rank", F.array_join("matched_branches", ",").alias("branches"), "dense_score", "sparse_score")


_FAKE = "1 / (1 + abs(doc % 17 - query_id % 17))"


def fake_rerank(s, d):
    hits = sparse.bm25_topk(C.questions(s, d), C.index(s, d), 10)
    doc = F.regexp_extract("chunk_id", "doc_([0-9]+)", 1).cast("long")
    out = fusion.rerank(hits, 1 / (1 + F.abs(doc % 17 - F.col("query_id") % 17)))
    return out.select("query_id", "chunk_id", "rerank_score", "rank", "stage4_rank")


def final_slice(s, d):
    hits = sparse.bm25_topk(C.questions(s, d), C.index(s, d), 10).filter("rank > 2").withColumn("rerank_score", F.when(F.col("rank") % 2 == 0, 1.0))
    return fusion.final_slice(hits, 5).select("query_id", "chunk_id", "rank", "stage4_rank")


def mmr_select(s, d):
    near = dense.dense_topk(C.vector_queries(s, d), C.vectors(s, d), 20)
    return fusion.mmr(near.withColumn("relevance", F.col("score")), C.vectors(s, d), 10)


def vector_upsert(s, d):
    v = C.vectors(s, d).select("chunk_id", "label")
    new = v.filter("label = 1").select("chunk_id", F.lit(100).alias("label"), F.lit(1).alias("seq")).union(v.filter("chunk_id < 50").select("chunk_id", F.lit(200), F.lit(2))).union(v.filter("chunk_id < 20").select(F.col("chunk_id") + 10_000_000, "label", F.lit(1)))
    return dense.upsert(v, new, "chunk_id")


def vector_delete(s, d):
    v = C.vectors(s, d).select("chunk_id", "label")
    return dense.delete_by(v, v.filter("label = 2"), "chunk_id")


def collection_info(s, d):
    return dense.collection_info(C.vectors(s, d))


def width_check(s, d):
    """Vectors whose label is odd lose their last component, so they are what is found."""
    v = C.vectors(s, d).withColumn("vector", F.when(F.col("label") % 2 == 1, F.slice("vector", 1, 63)).otherwise(F.col("vector")))
    return dense.width_violations(v, 64).select("chunk_id")


def payload_projection(s, d):
    c = C.chunks(s, d)
    return c.select("chunk_id", "source_file", "chunk_index", F.coalesce("section_path_text", F.lit("")).alias("section_path_text"), F.substring("content", 1, 160).alias("content_preview"), F.sha2("content", 256).alias("content_hash"), F.lit(True).alias("is_active"))


def file_catalog(s, d):
    """Different sections in order of first appearance."""
    return selection.catalog(C.chunks(s, d), "section_path_text", "doc_id").select("section_path_text", F.col("first").alias("first_doc"), "place")


def first_as_mmr(s, d):
    hits = sparse.bm25_topk(C.questions(s, d), C.index(s, d), 10)
    return fusion.first_as_mmr(hits, 5).select("query_id", "chunk_id", "mmr_score", "rank", "stage4_rank")


QUERIES = {
    "bm25_postings": bm25_postings, "bm25_stats": bm25_stats, "bm25_topk": bm25_topk, "bm25_topk_filtered": bm25_topk_filtered, "bm25_matched_terms": bm25_matched_terms,
    "dense_topk_cosine": _dense("cosine"), "dense_topk_dot": _dense("dot"), "dense_topk_l2": _dense("l2"), "dense_topk_filtered": dense_topk_filtered,
    "hybrid_rrf": hybrid_rrf, "branch_weighted_rrf": branch_weighted_rrf, "fake_rerank": fake_rerank, "final_slice": final_slice, "mmr_select": mmr_select, "first_as_mmr": first_as_mmr,
    "vector_upsert": vector_upsert, "vector_delete": vector_delete, "collection_info": collection_info, "width_check": width_check, "payload_projection": payload_projection, "file_catalog": file_catalog,
}

BOTH = (
    ALL
    + """,
vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, 'doc_' || c.vec_id || '.md::0' AS chunk_id, c.vec_id, """
    + COSINE
    + """ AS raw FROM vecs q JOIN benchmark b ON b.item_id = q.vec_id, vecs c),
dense AS (SELECT query_id, chunk_id, round(raw, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, vec_id) AS rank FROM pairs)"""
)

ORACLE = {
    "bm25_postings": f"WITH {POSTINGS} SELECT chunk_id, term, tf FROM post",
    "bm25_stats": f"WITH {POSTINGS} SELECT doc_count, round(avg_doc_len, 6) AS avg_doc_len, (SELECT count(DISTINCT term) FROM post) AS terms FROM stats",
    "bm25_topk": f"WITH {ALL} SELECT * FROM bm25 WHERE rank <= 10",
    "bm25_topk_filtered": "WITH " + BM25.format(where="JOIN chunks c ON c.chunk_id = p.chunk_id AND c.section_path_text = 'src1'") + " SELECT * FROM bm25 WHERE rank <= 10",
    "bm25_matched_terms": f"""WITH {ALL}, said AS (SELECT item_id AS query_id, unnest({TOKENS.format("text")}) AS term, generate_subscripts({TOKENS.format("text")}, 1) AS pos FROM benchmark)
SELECT b.query_id, b.chunk_id, string_agg(s.term, ' ' ORDER BY s.pos) AS terms FROM bm25 b JOIN said s USING (query_id) JOIN post p ON p.chunk_id = b.chunk_id AND p.term = s.term WHERE b.rank <= 3 GROUP BY ALL""",
    "dense_topk_cosine": "WITH " + DENSE.format(score=COSINE, more="", order="DESC") + " SELECT * FROM dense WHERE rank <= 10",
    "dense_topk_dot": "WITH " + DENSE.format(score="list_inner_product(q.v, c.v)", more="", order="DESC") + " SELECT * FROM dense WHERE rank <= 10",
    "dense_topk_l2": "WITH " + DENSE.format(score="list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))", more="", order="ASC") + " SELECT * FROM dense WHERE rank <= 10",
    "dense_topk_filtered": "WITH " + DENSE.format(score=COSINE, more="AND c.label IN (1, 2, 3)", order="DESC") + " SELECT * FROM dense WHERE rank <= 10",
    "hybrid_rrf": f"""WITH {BOTH}, j AS (SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.chunk_id, y.chunk_id) AS chunk_id, x.score AS dense_score, y.score AS sparse_score,
  coalesce(1 / (60.0::DOUBLE + x.rank), 0) + coalesce(1 / (60.0::DOUBLE + y.rank), 0) AS raw FROM (SELECT * FROM dense WHERE rank <= 30) x FULL JOIN (SELECT * FROM bm25 WHERE rank <= 30) y ON x.query_id = y.query_id AND x.chunk_id = y.chunk_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, chunk_id) AS INTEGER) AS rank FROM j)
SELECT query_id, chunk_id, dense_score, sparse_score, round(raw, 6) AS fusion_score, rank FROM r WHERE rank <= 10""",
    "branch_weighted_rrf": f"""WITH {BOTH}, u AS (SELECT query_id, chunk_id, 'raw' AS branch, 0 AS o, 1.0::DOUBLE AS w, rank, score AS dense_score, NULL::DOUBLE AS sparse_score FROM dense WHERE rank <= 20
  UNION ALL SELECT query_id, chunk_id, 'expanded', 1, 0.7::DOUBLE, rank, NULL, score FROM bm25 WHERE rank <= 20),
g AS (SELECT query_id, chunk_id, sum(w / (60.0::DOUBLE + rank)) AS raw, CAST(min(rank) AS INTEGER) AS best_rank, string_agg(branch, ',' ORDER BY o) AS branches, max(dense_score) AS dense_score, max(sparse_score) AS sparse_score FROM u GROUP BY query_id, chunk_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, best_rank, chunk_id) AS INTEGER) AS rank FROM g)
SELECT query_id, chunk_id, round(raw, 6) AS fusion_score, best_rank, rank, branches, dense_score, sparse_score FROM r WHERE rank <= 10""",
    "fake_rerank": f"""WITH {ALL}, f AS (SELECT query_id, chunk_id, rank AS old, round(1 / (1.0::DOUBLE + abs(CAST(regexp_extract(chunk_id, 'doc_([0-9]+)', 1) AS BIGINT) % 17 - query_id % 17)), 6) AS rerank_score FROM bm25 WHERE rank <= 10),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, old, chunk_id) AS INTEGER) AS rank FROM f)
SELECT query_id, chunk_id, rerank_score, rank, rank AS stage4_rank FROM r""",
    "final_slice": f"""WITH {ALL}, r AS (SELECT query_id, chunk_id, rank AS old, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS INTEGER) AS rank FROM bm25 WHERE rank BETWEEN 3 AND 10)
SELECT query_id, chunk_id, rank, CASE WHEN old % 2 = 0 THEN rank END AS stage4_rank FROM r WHERE rank <= 5""",
    "first_as_mmr": f"WITH {ALL} SELECT query_id, chunk_id, round(1.0::DOUBLE / rank, 6) AS mmr_score, rank, rank AS stage4_rank FROM bm25 WHERE rank <= 5",
    "mmr_select": """WITH RECURSIVE vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, """
    + COSINE
    + """ AS raw FROM vecs q, vecs c WHERE q.vec_id % 100 = 0),
top AS (SELECT query_id, chunk_id, CAST(round(raw, 6) AS FLOAT) AS rel, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, chunk_id) AS pos FROM pairs QUALIFY pos <= 20),
cand AS (SELECT query_id, chunk_id, pos, CASE WHEN max(rel) OVER w = min(rel) OVER w THEN CAST(1 AS FLOAT) ELSE (rel - min(rel) OVER w) / (max(rel) OVER w - min(rel) OVER w) END AS rel FROM top WINDOW w AS (PARTITION BY query_id)),
sims AS (SELECT a.query_id, a.chunk_id AS x, b.chunk_id AS y, least(1, greatest(-1, """
    + COSINE
    + """)) AS sim FROM cand a JOIN cand b USING (query_id) JOIN vecs q ON q.vec_id = a.chunk_id JOIN vecs c ON c.vec_id = b.chunk_id),
g AS (SELECT query_id, chunk_id, pos, rel, CAST(NULL AS DOUBLE) AS near, 0 AS step, CAST(NULL AS BIGINT) AS best, CAST(NULL AS DOUBLE) AS mmr_score FROM cand
  UNION ALL SELECT n.query_id, n.chunk_id, n.pos, n.rel, greatest(coalesce(n.near, -2), s.sim), n.step + 1, n.best, n.score FROM (
    SELECT g.query_id, chunk_id, pos, rel, near, step, first_value(chunk_id) OVER w AS best, first_value(CASE WHEN near IS NULL THEN CAST(rel AS DOUBLE) ELSE CAST(CAST(0.7 AS FLOAT) * rel AS DOUBLE) - 0.30000000000000004::DOUBLE * near END) OVER w AS score
    FROM g WHERE step < 10 AND chunk_id IS DISTINCT FROM g.best
    WINDOW w AS (PARTITION BY g.query_id ORDER BY CASE WHEN near IS NULL THEN CAST(rel AS DOUBLE) ELSE CAST(CAST(0.7 AS FLOAT) * rel AS DOUBLE) - 0.30000000000000004::DOUBLE * near END DESC, rel DESC, pos)) n JOIN sims s ON s.query_id = n.query_id AND s.x = n.chunk_id AND s.y = n.best)
SELECT DISTINCT query_id, best AS chunk_id, round(mmr_score, 6) AS mmr_score, CAST(step AS INTEGER) AS rank FROM g WHERE step > 0""",
    "vector_upsert": """SELECT vec_id AS chunk_id, CASE WHEN vec_id < 50 THEN 200 WHEN label = 1 THEN 100 ELSE label END AS label FROM embeddings
UNION ALL SELECT vec_id + 10000000, label FROM embeddings WHERE vec_id < 20""",
    "vector_delete": "SELECT vec_id AS chunk_id, label FROM embeddings WHERE label <> 2",
    "collection_info": "SELECT count(*) AS points, CAST(min(len(embedding)) AS INTEGER) AS min_width, CAST(max(len(embedding)) AS INTEGER) AS max_width FROM embeddings",
    "width_check": "SELECT vec_id AS chunk_id FROM embeddings WHERE embedding IS NULL OR label % 2 = 1 OR len(embedding) <> 64",
    "payload_projection": f"SELECT chunk_id, source_file, 0 AS chunk_index, coalesce(section_path_text, '') AS section_path_text, substring(content, 1, 160) AS content_preview, sha256(content) AS content_hash, true AS is_active FROM ({CHUNKS})",
    "file_catalog": "SELECT source AS section_path_text, min(doc_id) AS first_doc, CAST(row_number() OVER (ORDER BY min(doc_id)) AS INTEGER) AS place FROM documents GROUP BY source",
}
