"""Queries of context packing, answers, evaluation and upkeep, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brindle.functions import lexicons as L
from brindle.operators import answers, context, evaluation, models, pipeline, selection, sparse, sync
from brindle.operators import dense as dn
from brindle.operators import queries as qu
from brindle.functions.text import strip

from . import corpus as C
from .retrieval import ALL, CHUNKS, COSINE, DENSE


def _line_hits(s, d, k=8):
    """The best lines of each question as candidates."""
    hits = sparse.bm25_topk(C.questions(s, d), C.index(s, d, "lines"), k)
    return hits.select("query_id", "chunk_id", F.round(1.0 / (60 + F.col("rank")), 6).alias("fusion_score"))


def context_neighbors(s, d):
    out = context.expand(_line_hits(s, d), C.lines(s, d), extra=1)
    return out.select("query_id", "chunk_id", F.round("fusion_score", 6).alias("fusion_score"), F.round("sort_score", 6).alias("sort_score"))


def context_islands(s, d):
    lines = C.lines(s, d)
    out = context.merge_adjacent(context.expand(_line_hits(s, d), lines, extra=1), lines)
    return out.select("query_id", "source_file", "section_path_text", F.array_join(F.transform("chunk_indexes", lambda x: x.cast("string")), ",").alias("indexes"), F.md5("content").alias("digest"), "token_count", F.round("sort_score", 6).alias("sort_score"))


def context_budget(s, d):
    out = context.pack(_line_hits(s, d), C.lines(s, d), budget=1200)
    return out.select("query_id", "citation_id", "source_file", F.array_join("chunk_ids", ",").alias("chunk_ids"), "token_count", "total_tokens")


def _hits(s, d, k=8):
    hits = sparse.bm25_topk(C.questions(s, d), C.index(s, d), k)
    late = hits.join(C.chunks(s, d).select("chunk_id", "source_file", "section_path_text", "content"), "chunk_id")
    return late.withColumns({"fusion_score": F.round(1.0 / (60 + F.col("rank")), 6), "dense_score": F.when(F.col("rank") % 3 != 0, F.round(F.col("score") / 100, 6)), "rerank_score": F.when(F.col("rank") % 4 == 0, F.round(F.col("score") / 50, 6))})


def evidence_rank(s, d):
    twice = _hits(s, d).unionByName(_hits(s, d, 2).withColumn("rerank_score", F.lit(0.9)))
    return answers.evidence(twice).select("query_id", "citation_id", "chunk_id", "sort_score", "retrieval_confidence", "confidence_type", "confidence_state")


def template_answer(s, d):
    out = answers.compose(C.questions(s, d), answers.evidence(_hits(s, d)))
    return out.select("query_id", F.md5("answer").alias("digest"), F.size("citation_ids").alias("n"))


def answer_batch(s, d):
    q = C.questions(s, d)
    found = answers.evidence(_hits(s, d))
    return answers.answer(q, found, qu.domain_gate(q)).select("query_id", "is_fallback", "fallback_reason", "decision", "evidence_count", "confidence_state")


def _marked(s, d):
    """Turns as answers: their length says which markers they carry."""
    n = F.length("text")
    mark = lambda i: F.concat(F.lit("[S"), (n % i + 1).cast("string"), F.lit("]"))
    t = C.table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.concat("text", F.lit(" "), mark(5), F.lit(" "), mark(3), F.when(n % 2 == 0, F.lit("\n120人 hurt")).otherwise("")).alias("answer"))
    return t.withColumns({"known": F.array(F.lit("[S1]"), F.lit("S2"), F.lit("S3")), "citation_ids": F.array(F.lit("S1"), F.lit("S2"), F.lit("S3")), "evidence_ids": F.array(F.lit("S1"), F.lit("S2"))})


def citation_mapping(s, d):
    out = answers.citation_mapping(_marked(s, d))
    return out.select("answer_id", *[F.array_join(c, ",").alias(c) for c in ("used_ids", "mapped_ids", "unknown_ids")], "all_mapped", F.round("mapping_ratio", 6).alias("mapping_ratio"))


def citation_verify(s, d):
    out = answers.verify(_marked(s, d))
    return out.select("answer_id", *[F.array_join(c, ",").alias(c) for c in ("used_ids", "missing_ids", "unused_ids", "reasons")], "uncited_fact", "passed")


def guardrail(s, d):
    found = answers.evidence(_hits(s, d))
    rows = C.questions(s, d).select("query_id", F.when(F.col("query_id") % 3 == 0, F.array(F.lit("missing_citation"))).otherwise(F.array().cast("array<string>")).alias("reasons"))
    out = answers.guardrail(rows, found, low=0.3)
    return out.select("query_id", "evidence_count", "max_score", "confidence_type", F.array_join("guard_reasons", ",").alias("guard_reasons"), "guard_passed", "confidence_state")


def _label_runs(s, d):
    q, v = C.vector_queries(s, d), C.vectors(s, d)
    ranked = evaluation.ranked_lists(dn.dense_topk(q, v, 10))
    rel = v.groupBy("label").agg(F.array_sort(F.collect_set("chunk_id")).alias("relevant"))
    return q.join(rel, "label").join(ranked, "query_id").select("query_id", "ranked", "relevant")


def recall_mrr_ndcg(s, d):
    return evaluation.per_query(_label_runs(s, d))


def metric_summary(s, d):
    rows = recall_mrr_ndcg(s, d)
    return evaluation.mean_summary(rows, [c for c in rows.columns if c != "query_id"])


def ranking_agreement(s, d):
    q, v = C.vector_queries(s, d), C.vectors(s, d)
    short = lambda t: t.withColumn("vector", F.slice("vector", 1, 32))
    return evaluation.agreement(evaluation.ranked_lists(dn.dense_topk(q, v, 10)), evaluation.ranked_lists(dn.dense_topk(short(q), short(v), 10)))


def ablation_rank_shift(s, d):
    runs = _label_runs(s, d)
    k = 10
    base = evaluation.first_hit(F.filter("ranked", lambda x: x != F.col("query_id")), F.col("relevant"), k)
    other = evaluation.first_hit(F.filter(F.reverse("ranked"), lambda x: x != F.col("query_id")), F.col("relevant"), k)
    return runs.select("query_id", base.alias("base_rank"), other.alias("other_rank"), evaluation.rank_shift(base, other, k).alias("shift"))


def latency_percentiles(s, d):
    return C.table(s, d, "events").groupBy("event_type").agg(*evaluation.latency("value"))


def latency_p95_truncated(s, d):
    return evaluation.truncated_percentile(C.table(s, d, "events"), ["event_type"], "value")


def _results(s, d):
    t = C.table(s, d, "documents").join(C.table(s, d, "labels"), "doc_id")
    return t.select("doc_id", "lang", "source", F.when(F.col("n_chars") % 11 == 0, "timeout").alias("error"), (F.col("toxic") == 1).alias("is_fallback"), F.when(F.col("n_chars") % 3 != 0, F.col("quality") == 0).alias("expected_fallback"), F.when(F.col("n_chars") % 5 != 0, F.round(F.col("n_chars") % 100 / 100.0, 2)).alias("faithfulness"), F.col("n_chars").cast("double").alias("latency_ms"), (F.col("quality") == 0).alias("out_of_domain"))


def answer_summary(s, d):
    return evaluation.answer_summary(_results(s, d), ["lang"])


def decision_confusion(s, d):
    return evaluation.confusion(_results(s, d))


def group_summary(s, d):
    return evaluation.group_summary(_results(s, d), "source")


def dataset_validation(s, d):
    t = C.table(s, d, "documents").select((F.floor(F.col("doc_id") / 2) + F.col("doc_id") % 3).alias("query_id"), F.col("text").alias("query"), F.array(F.col("doc_id"), F.col("doc_id") + 7).alias("relevant"))
    return evaluation.dataset_problems(t, C.table(s, d, "documents").select(F.col("doc_id").alias("chunk_id")))


def worst_examples(s, d):
    return evaluation.worst_examples(_results(s, d), "doc_id").select("doc_id", "error", "is_fallback", "faithfulness")


def judge_ratios(s, d):
    facts = F.transform(F.sequence(F.lit(1), (F.col("n_chars") % 5 + 1).cast("int")), lambda i: F.struct(((F.col("doc_id") + i) % 2 == 0).alias("supported"), ((F.col("doc_id") + i) % 3 != 0).alias("cited")))
    t = C.table(s, d, "documents").select("doc_id", facts.alias("facts"))
    return t.select("doc_id", *[F.round(c, 6).alias(n) for n, c in evaluation.judged(F.col("facts")).items()])


def acceptance_gate(s, d):
    t = evaluation.answer_summary(_results(s, d), ["lang"])
    return evaluation.acceptance(t, {"success_rate": 0.9, "fallback_accuracy": 0.5}).select("lang", "success_rate_ok", "fallback_accuracy_ok", "accepted")


def metric_delta(s, d):
    one = lambda t: t.agg(F.avg("faithfulness").alias("faithfulness"), F.avg("latency_ms").alias("latency_ms"))
    t = _results(s, d)
    return selection.compare_summaries(one(t.filter("not is_fallback")), one(t.filter("is_fallback")), ["faithfulness", "latency_ms"]).select("metric", "delta")


def _snapshots(s, d):
    t = C.table(s, d, "documents")
    file = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md"))
    old = t.filter("n_chars % 7 <> 1").select(file.alias("source_file"), F.sha2("text", 256).alias("content_hash"), F.when(F.col("n_chars") % 13 == 0, "deleted").otherwise("active").alias("status"), F.lit(1).alias("chunk_count"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"))
    new = t.filter("n_chars % 7 <> 2").select(file.alias("source_file"), F.sha2(F.when(F.col("n_chars") % 7 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"))
    return new, old


def change_set(s, d):
    return sync.change_set(*_snapshots(s, d))


def registry_upsert(s, d):
    new, old = _snapshots(s, d)
    rows = new.select("source_file", "content_hash", F.lit("active").alias("status"), F.lit(2).alias("chunk_count"), F.lit("2024-02-01").cast("timestamp").alias("updated_at"))
    return sync.upsert_documents(old, rows).select("source_file", "content_hash", "status", "chunk_count")


def _mappings(s, d):
    return C.lines(s, d).select("chunk_id", "source_file", "chunk_index", F.md5("content").alias("content_hash"))


def registry_soft_delete(s, d):
    new, old = _snapshots(s, d)
    gone = sync.change_set(new, old).filter("change_type = 'deleted'")
    registry, mappings = sync.soft_delete(old, _mappings(s, d), gone)
    left = mappings.groupBy("source_file").agg(F.count("*").alias("mappings"))
    return registry.join(left, "source_file", "left").select("source_file", "status", "chunk_count", F.coalesce("mappings", F.lit(0)).alias("mappings"))


def chunk_mapping_replace(s, d):
    m = _mappings(s, d)
    new = m.filter("chunk_index = 0 and length(source_file) % 2 = 0").withColumn("content_hash", F.lit("new"))
    return sync.replace_mappings(m, new).groupBy("source_file").agg(F.count("*").alias("n"), F.count_if(F.col("content_hash") == "new").alias("renewed"))


def resume_antijoin(s, d):
    done = C.table(s, d, "labels").select(F.col("doc_id").alias("query_id"), F.when(F.col("toxic") == 1, "error").otherwise("ok").alias("status"))
    q = C.table(s, d, "documents").select(F.col("doc_id").alias("query_id"), "lang")
    return sync.not_done(q, done, retry_failed=True)


def stratified_sample(s, d):
    t = C.table(s, d, "documents").select("doc_id", "lang", "source")
    return evaluation.stratified_sample(t, F.col("lang"), 5, "doc_id").select("doc_id", "stratum", "pick")


def template_cross(s, d):
    """Templates filled with every nation and its region."""
    t = C.table(s, d, "nation").join(C.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    made = selection.template_queries(["how does {nation} in {region} respond", "which office of {nation} in {region} decides"], t)
    return made.select(F.concat_ws("|", "nation", "region").alias("key"), "query", "place")


def hit_rate_summary(s, d):
    return evaluation.hit_rates(_label_runs(s, d))


def row_status(s, d):
    t = _results(s, d)
    return t.groupBy(evaluation.row_status(F.col("error"), F.col("is_fallback")).alias("status")).agg(F.count("*").alias("n"))


def context_explode(s, d):
    """Packed chunks back to ranked rows: every chunk keeps the rank of its evidence."""
    return context.explode(context.pack(_line_hits(s, d), C.lines(s, d), budget=1200))


def agent_loop(s, d):
    q = C.table(s, d, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    propose = lambda t: t.withColumn("answer", F.concat_ws(" ", F.col("iteration").cast("string"), F.reverse("query")))
    critique = lambda t: t.withColumn("critique", F.when(F.length("answer") % 3 == F.col("iteration"), "approved").otherwise("refine"))
    return answers.refine_loop(q, propose, critique, ["approved"], rounds=3).select("query_id", "iteration", "critique", F.md5("answer").alias("digest"))


def compact_text(s, d):
    return C.table(s, d, "conversations").select("conv_id", "turn", F.md5(strip(F.regexp_replace("text", r"\s+", " "))).alias("digest"))


def _folder(s, d):
    """Documents cut into lines, and their vectors by the default encoder."""
    lines = C.lines(s, d, dealt=True).filter("content <> ''")
    return lines, models.embed(lines.select("chunk_id", "content"), "content").select("chunk_id", "vector")


def full_search(s, d):
    """Analysis, branches, both searchers, fusion, reranking by length, diversity, branch fusion, over all lines."""
    lines, vectors = _folder(s, d)
    out = pipeline.search(C.questions(s, d), lines, vectors, pipeline.Options(hyde="rule"), score=1.0 / (1 + F.abs(F.length("content") - F.length("query"))))
    return out.select("query_id", "chunk_id", "fusion_score", "rank", F.array_join("matched_branches", ",").alias("branches"))


def full_answers(s, d):
    lines, vectors = _folder(s, d)
    return pipeline.ask(C.questions(s, d), lines, vectors)["answers"].select("query_id", "is_fallback", "fallback_reason", "decision", "evidence_count")


def quota_selection(s, d):
    t = C.table(s, d, "documents").select("doc_id", "lang")
    return selection.quota(t, "lang", {"en": 4, "de": 2, "fr": 1}, [F.col("doc_id")])


def balanced_selection(s, d):
    return selection.balanced(C.table(s, d, "documents").select("doc_id", "source", "lang"), ("source", "lang"), "doc_id", 30)


def plain_chunks(s, d):
    t = C.table(s, d, "documents").select("doc_id", selection.plain_chunks("text").alias("c"))
    return t.select("doc_id", F.size("c").alias("n"), F.coalesce(F.array_max(F.transform("c", lambda x: F.length(x))), F.lit(0)).alias("longest"))


def category_rules(s, d):
    rules = [("loud", ["!!"]), ("table", [" | "]), ("mail", ["@"])]
    return C.table(s, d, "documents").select("doc_id", qu.coarse_category(F.col("text"), rules).alias("category"))


QUERIES = {
    f.__name__: f
    for f in (full_search, full_answers, quota_selection, balanced_selection, plain_chunks, category_rules, context_neighbors, context_islands, context_budget, context_explode, evidence_rank, template_answer, answer_batch, citation_mapping, citation_verify, guardrail, recall_mrr_ndcg, metric_summary, ranking_agreement, ablation_rank_shift, latency_percentiles, latency_p95_truncated, answer_summary, decision_confusion, group_summary, dataset_validation, worst_examples, judge_ratios, acceptance_gate, metric_delta, change_set, registry_upsert, registry_soft_delete, chunk_mapping_replace, resume_antijoin, stratified_sample, template_cross, hit_rate_summary, row_status, agent_loop, compact_text)
}

_LINES = (
    r"""
lines AS (SELECT 'doc_' || doc_id || '.md::' || i AS chunk_id, 'doc_' || doc_id || '.md' AS source_file, CAST(i AS INTEGER) AS chunk_index, 's' || (i // 5) AS section_path_text, content, len(regexp_extract_all(content, '[A-Za-z0-9]+|[^\s]')) AS token_count, doc_id
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)),"""
    + ALL.replace(f"chunks AS ({CHUNKS})", "chunks AS (SELECT * FROM lines)")
    + r""",
cand AS (SELECT query_id, l.*, round(1 / (60.0::DOUBLE + rank), 6) AS fs FROM bm25 JOIN lines l USING (chunk_id) WHERE rank <= 8),
mate AS (SELECT c.query_id, l.chunk_id, c.fs * 0.94::DOUBLE AS fs, row_number() OVER (PARTITION BY c.query_id, c.chunk_id ORDER BY l.chunk_index) AS n FROM cand c JOIN lines l USING (source_file, section_path_text) WHERE l.chunk_id <> c.chunk_id),
expanded AS (SELECT query_id, chunk_id, max(fs) AS fs FROM (SELECT query_id, chunk_id, fs FROM cand
  UNION ALL SELECT c.query_id, l.chunk_id, c.fs * 0.97::DOUBLE FROM cand c JOIN lines l USING (source_file, section_path_text) WHERE abs(l.chunk_index - c.chunk_index) = 1
  UNION ALL SELECT query_id, chunk_id, fs FROM mate WHERE n = 1) GROUP BY query_id, chunk_id),
e2 AS (SELECT e.query_id, l.*, e.fs, l.chunk_index - row_number() OVER (PARTITION BY e.query_id, l.source_file, l.section_path_text ORDER BY l.chunk_index) AS island FROM expanded e JOIN lines l USING (chunk_id)),
merged AS (SELECT query_id, source_file, section_path_text, min(chunk_index) AS first_index, string_agg(chunk_id, ',' ORDER BY chunk_index) AS chunk_ids, string_agg(CAST(chunk_index AS VARCHAR), ',' ORDER BY chunk_index) AS indexes,
  regexp_replace(string_agg(content, chr(10) ORDER BY chunk_index), '^\s+|\s+$', '', 'g') AS content, CAST(sum(token_count) AS BIGINT) AS token_count, max(fs) AS fs FROM e2 GROUP BY query_id, source_file, section_path_text, island)"""
)
_PACK = (
    "WITH RECURSIVE "
    + _LINES.lstrip()
    + """,
ord AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fs DESC, source_file, first_index) AS i FROM merged),
fold AS (SELECT query_id, i, CASE WHEN token_count <= 1200 THEN token_count ELSE 0 END AS used, token_count <= 1200 AS took, CASE WHEN token_count <= 1200 THEN 1 ELSE 0 END AS n FROM ord WHERE i = 1
  UNION ALL SELECT o.query_id, o.i, CASE WHEN f.used < 1200 AND f.used + o.token_count <= 1200 THEN f.used + o.token_count ELSE f.used END, f.used < 1200 AND f.used + o.token_count <= 1200, f.n + CASE WHEN f.used < 1200 AND f.used + o.token_count <= 1200 THEN 1 ELSE 0 END
  FROM fold f JOIN ord o ON o.query_id = f.query_id AND o.i = f.i + 1),
packed AS (SELECT o.*, f.n, max(f.used) OVER (PARTITION BY o.query_id) AS total_tokens, f.took FROM fold f JOIN ord o USING (query_id, i))"""
)
_HITS = (
    ALL
    + """,
hits AS (SELECT query_id, chunk_id, rank, round(1 / (60.0::DOUBLE + rank), 6) AS fusion_score, CASE WHEN rank % 3 <> 0 THEN round(score / 100, 6) END AS dense_score, CASE WHEN rank % 4 = 0 THEN round(score / 50, 6) END AS rerank_score FROM bm25 WHERE rank <= 8)"""
)
_STATE = "CASE WHEN {0} IS NULL THEN 'confidence_unavailable' WHEN {0} < 0.2 THEN 'low_confidence' WHEN {0} < 0.5 THEN 'uncertain' ELSE 'retrieval_confident' END"
_EVIDENCE = """
e AS (SELECT h.query_id, row_number() OVER (PARTITION BY h.query_id ORDER BY coalesce(rerank_score, fusion_score) DESC, rank, h.chunk_id) AS pos, coalesce(rerank_score, dense_score) AS conf, coalesce(rerank_score, dense_score, 0) AS score, source_file, section_path_text,
  trim(regexp_replace(content, '\\s+', ' ', 'g')) AS text FROM hits h JOIN chunks c USING (chunk_id))"""
_has = lambda words: "(" + " OR ".join(f"contains(lower(text), '{w.lower()}')" for w in words) + ")"
_TERMS = " + ".join(f"CAST(contains(x, '{w}') AS INTEGER)" for w in L.POLICY_TERMS)
_RUNS = (
    DENSE.format(score=COSINE, more="", order="DESC")
    + """,
top AS (SELECT d.query_id, d.chunk_id, d.rank, c.label = q.label AS hit, count(*) FILTER (true) OVER () AS x FROM dense d JOIN vecs q ON q.vec_id = d.query_id JOIN vecs c ON c.vec_id = d.chunk_id WHERE d.rank <= 10),
rel AS (SELECT label, count(*) AS n FROM vecs GROUP BY label)"""
)
_METRICS = (
    _RUNS
    + """,
m AS (SELECT t.query_id, round(count(*) FILTER (hit AND rank <= 5) / any_value(r.n), 6) AS chunk_recall_5, round(count(*) FILTER (hit) / any_value(r.n), 6) AS chunk_recall_10, round(coalesce(1 / CAST(min(rank) FILTER (hit) AS DOUBLE), 0), 6) AS chunk_mrr_10,
  round(coalesce(sum(1 / log2(rank + 1.0::DOUBLE)) FILTER (hit), 0) / any_value(list_sum(list_transform(range(1, least(r.n, 10) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE)))), 6) AS chunk_ndcg_10
  FROM top t JOIN vecs q ON q.vec_id = t.query_id JOIN rel r ON r.label = q.label GROUP BY t.query_id)"""
)
_MARKED = "SELECT conv_id * 1000 + turn AS answer_id, text || ' [S' || (length(text) % 5 + 1) || '] [S' || (length(text) % 3 + 1) || ']' || CASE WHEN length(text) % 2 = 0 THEN chr(10) || '120人 hurt' ELSE '' END AS answer, CASE WHEN length(text) % 5 = length(text) % 3 THEN ['S' || (length(text) % 5 + 1)] ELSE ['S' || (length(text) % 5 + 1), 'S' || (length(text) % 3 + 1)] END AS used, length(text) AS n FROM conversations"
_RESULTS = "SELECT d.doc_id, d.lang, d.source, CASE WHEN n_chars % 11 = 0 THEN 'timeout' END AS error, toxic = 1 AS is_fallback, CASE WHEN n_chars % 3 <> 0 THEN quality = 0 END AS expected_fallback, CASE WHEN n_chars % 5 <> 0 THEN round(n_chars % 100 / 100.0::DOUBLE, 2) END AS faithfulness, CAST(n_chars AS DOUBLE) AS latency_ms, quality = 0 AS out_of_domain FROM documents d JOIN labels l USING (doc_id)"
_SUMMARY = f"""SELECT lang, count(*) AS query_count, round(avg(CASE WHEN error IS NULL THEN 1.0::DOUBLE ELSE 0 END), 4) AS success_rate, round(avg(CASE WHEN is_fallback THEN 1.0::DOUBLE ELSE 0 END), 4) AS fallback_rate,
  round(avg(CASE WHEN expected_fallback IS NOT NULL THEN CASE WHEN expected_fallback = is_fallback THEN 1.0::DOUBLE ELSE 0 END END), 4) AS fallback_accuracy,
  round(coalesce(avg(CASE WHEN NOT is_fallback THEN CASE WHEN faithfulness IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END END), 0), 4) AS judge_coverage, round(avg(CASE WHEN NOT is_fallback THEN faithfulness END), 4) AS faithfulness,
  round(avg(latency_ms), 2) AS avg_latency_ms, round(quantile_cont(latency_ms, 0.5), 2) AS p50_latency_ms, round(quantile_cont(latency_ms, 0.95), 2) AS p95_latency_ms FROM ({_RESULTS}) GROUP BY lang"""
_SNAP = """
old AS (SELECT 'doc_' || doc_id || '.md' AS source_file, sha256(text) AS h, CASE WHEN n_chars % 13 = 0 THEN 'deleted' ELSE 'active' END AS status FROM documents WHERE n_chars % 7 <> 1),
new AS (SELECT 'doc_' || doc_id || '.md' AS source_file, sha256(CASE WHEN n_chars % 7 = 3 THEN text || '!' ELSE text END) AS h FROM documents WHERE n_chars % 7 <> 2),
changes AS (SELECT coalesce(n.source_file, o.source_file) AS source_file, coalesce(n.h, o.h) AS content_hash, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'deleted' WHEN o.h <> n.h THEN 'modified' ELSE 'unchanged' END AS change_type
  FROM new n FULL JOIN (SELECT * FROM old WHERE status = 'active') o ON n.source_file = o.source_file)"""
_MAP = "maps AS (SELECT 'doc_' || doc_id || '.md' AS source_file, len(string_split(text, chr(10))) AS n FROM documents)"
_LIST = "array_to_string({}, ',')"

ORACLE = {
    "quota_selection": "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) SELECT doc_id, lang FROM r WHERE n <= CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 1 ELSE 0 END",
    "balanced_selection": """WITH RECURSIVE g AS (SELECT 0 AS n, CAST(NULL AS BIGINT) AS doc_id, CAST([] AS BIGINT[]) AS taken
  UNION ALL SELECT n + 1, p.doc_id, list_append(taken, p.doc_id) FROM g, LATERAL (SELECT d.doc_id FROM documents d LEFT JOIN (SELECT source, lang, count(*) AS c FROM documents WHERE list_contains(g.taken, doc_id) GROUP BY ALL) t ON true
    WHERE NOT list_contains(g.taken, d.doc_id) GROUP BY d.doc_id, d.source, d.lang
    ORDER BY coalesce(sum(c) FILTER (t.source = d.source), 0) + coalesce(sum(c) FILTER (t.lang = d.lang), 0), coalesce(sum(c) FILTER (t.source = d.source), 0), coalesce(sum(c) FILTER (t.lang = d.lang), 0), d.doc_id LIMIT 1) p WHERE n < 30)
SELECT doc_id, source, lang FROM g JOIN documents USING (doc_id)""",
    "plain_chunks": r"""WITH RECURSIVE b AS (SELECT doc_id, regexp_extract_all(regexp_replace(regexp_replace(text, '<[^>]+>|[#*_`>|]', '', 'g'), '\s+', '', 'g'), '[^！？。；]+[！？。；]?|[！？。；]') AS p FROM documents),
f AS (SELECT doc_id, p, 1 AS i, CASE WHEN len(p) > 0 THEN 1 ELSE 0 END AS n, coalesce(length(p[1]), 0) AS now, coalesce(length(p[1]), 0) AS longest FROM b
  UNION ALL SELECT doc_id, p, i + 1, CASE WHEN now + length(p[i + 1]) > 250 THEN n + 1 ELSE n END, CASE WHEN now + length(p[i + 1]) > 250 THEN length(p[i + 1]) ELSE now + length(p[i + 1]) END,
    greatest(longest, CASE WHEN now + length(p[i + 1]) > 250 THEN length(p[i + 1]) ELSE now + length(p[i + 1]) END) FROM f WHERE i < len(p))
SELECT doc_id, CAST(max(n) AS INTEGER) AS n, CAST(max(longest) AS INTEGER) AS longest FROM f GROUP BY doc_id""",
    "category_rules": "SELECT doc_id, CASE WHEN contains(text, '!!') THEN 'loud' WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '@') THEN 'mail' ELSE 'other' END AS category FROM documents",
    "context_neighbors": f"WITH {_LINES} SELECT query_id, chunk_id, round(fs, 6) AS fusion_score, round(fs, 6) AS sort_score FROM expanded",
    "context_islands": f"WITH {_LINES} SELECT query_id, source_file, section_path_text, indexes, md5(content) AS digest, token_count, round(fs, 6) AS sort_score FROM merged",
    "context_budget": f"{_PACK} SELECT query_id, 'S' || n AS citation_id, source_file, chunk_ids, token_count, total_tokens FROM packed WHERE took",
    "context_explode": f"{_PACK} SELECT query_id, CAST(n AS INTEGER) AS rank, unnest(string_split(chunk_ids, ',')) AS chunk_id FROM packed WHERE took",
    "evidence_rank": f"""WITH {_HITS}, u AS (SELECT *, coalesce(rerank_score, fusion_score) AS sort_score FROM (SELECT * FROM hits UNION ALL SELECT query_id, chunk_id, rank, fusion_score, dense_score, 0.9::DOUBLE FROM hits WHERE rank <= 2)),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY sort_score DESC, rank) AS k FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sort_score DESC, rank, chunk_id) AS pos, coalesce(rerank_score, dense_score) AS conf FROM b WHERE k = 1)
SELECT query_id, 'S' || pos AS citation_id, chunk_id, sort_score, conf AS retrieval_confidence, CASE WHEN rerank_score IS NOT NULL THEN 'rerank' WHEN dense_score IS NOT NULL THEN 'dense' ELSE 'unavailable' END AS confidence_type, {_STATE.format("conf")} AS confidence_state FROM r""",
    "guardrail": f"""WITH {_HITS}, e AS (SELECT query_id, coalesce(rerank_score, dense_score) AS conf, CASE WHEN rerank_score IS NOT NULL THEN 'rerank' WHEN dense_score IS NOT NULL THEN 'dense' ELSE 'unavailable' END AS t FROM hits),
g AS (SELECT q.item_id AS query_id, count(e.query_id) AS evidence_count, max(conf) AS max_score, coalesce(arg_max(t, conf), 'unavailable') AS confidence_type FROM benchmark q LEFT JOIN e ON e.query_id = q.item_id GROUP BY q.item_id),
r AS (SELECT *, list_filter([CASE WHEN evidence_count < 1 THEN 'insufficient_evidence' END, CASE WHEN max_score < 0.3 THEN 'low_retrieval_score' END, CASE WHEN query_id % 3 = 0 THEN 'missing_citation' END], lambda x: x IS NOT NULL) AS why FROM g)
SELECT query_id, evidence_count, max_score, confidence_type, {_LIST.format("why")} AS guard_reasons, len(why) = 0 AS guard_passed, {_STATE.format("max_score")} AS confidence_state FROM r""",
    "citation_mapping": f"""WITH m AS ({_MARKED}), x AS (SELECT *, list_filter(used, lambda u: u IN ('S1', 'S2', 'S3')) AS mapped, list_filter(used, lambda u: u NOT IN ('S1', 'S2', 'S3')) AS unknown FROM m)
SELECT answer_id, {_LIST.format("used")} AS used_ids, {_LIST.format("mapped")} AS mapped_ids, {_LIST.format("unknown")} AS unknown_ids, len(unknown) = 0 AS all_mapped, round(len(mapped) / len(used), 6) AS mapping_ratio FROM x""",
    "citation_verify": f"""WITH m AS ({_MARKED}), x AS (SELECT *, list_filter(used, lambda u: u NOT IN ('S1', 'S2', 'S3')) AS missing, list_filter(['S1', 'S2', 'S3'], lambda u: NOT list_contains(used, u)) AS unused FROM m)
SELECT answer_id, {_LIST.format("used")} AS used_ids, {_LIST.format("missing")} AS missing_ids, {_LIST.format("unused")} AS unused_ids, CASE WHEN len(missing) > 0 THEN 'missing_citation,' ELSE '' END || 'citation_without_evidence' AS reasons, n % 2 = 0 AS uncited_fact, false AS passed FROM x""",
    "recall_mrr_ndcg": f"WITH {_METRICS} SELECT * FROM m",
    "metric_summary": f"WITH {_METRICS} SELECT count(*) AS query_count, round(avg(chunk_recall_5), 4) AS chunk_recall_5, round(avg(chunk_recall_10), 4) AS chunk_recall_10, round(avg(chunk_mrr_10), 4) AS chunk_mrr_10, round(avg(chunk_ndcg_10), 4) AS chunk_ndcg_10 FROM m",
    "hit_rate_summary": f"WITH {_RUNS}, o AS (SELECT query_id, hit, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM top WHERE chunk_id <> query_id), h AS (SELECT query_id, bool_or(hit AND k <= 1) AS a, bool_or(hit AND k <= 5) AS b FROM o GROUP BY query_id) SELECT count(*) AS queries, round(avg(CAST(a AS INTEGER)), 4) AS hit_1, round(avg(CAST(b AS INTEGER)), 4) AS hit_5 FROM h",
    "ranking_agreement": "WITH "
    + DENSE.format(score=COSINE, more="", order="DESC")
    + """, v32 AS (SELECT vec_id, v[1:32] AS v FROM vecs), p32 AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, """
    + COSINE
    + """ AS raw FROM v32 q, v32 c WHERE q.vec_id % 100 = 0), d32 AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, chunk_id) AS rank FROM p32)
SELECT a.query_id, round(count(*) FILTER (b.rank = a.rank) / 10, 6) AS prefix_match, round(count(b.chunk_id) / 10, 6) AS overlap FROM dense a LEFT JOIN d32 b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id AND b.rank <= 10 WHERE a.rank <= 10 GROUP BY a.query_id""",
    "ablation_rank_shift": f"""WITH {_RUNS}, o AS (SELECT query_id, hit, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS f, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) AS b FROM top WHERE chunk_id <> query_id),
g AS (SELECT query_id, CAST(coalesce(min(f) FILTER (hit), 11) AS INTEGER) AS base_rank, CAST(coalesce(min(b) FILTER (hit), 11) AS INTEGER) AS other_rank FROM o GROUP BY query_id)
SELECT *, CASE WHEN base_rank <= 10 OR other_rank <= 10 THEN base_rank - other_rank END AS shift FROM g""",
    "latency_percentiles": "SELECT event_type, round(avg(value), 2) AS avg_latency_ms, round(quantile_cont(value, 0.5), 2) AS p50_latency_ms, round(quantile_cont(value, 0.95), 2) AS p95_latency_ms FROM events GROUP BY event_type",
    "latency_p95_truncated": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, value AS p95 FROM r WHERE r = CASE WHEN floor(n * 0.95) = 0 THEN n ELSE floor(n * 0.95) END",
    "answer_summary": _SUMMARY,
    "acceptance_gate": f"WITH s AS ({_SUMMARY}) SELECT lang, success_rate >= 0.9 AS success_rate_ok, fallback_accuracy >= 0.5 AS fallback_accuracy_ok, coalesce(success_rate >= 0.9, false) AND coalesce(fallback_accuracy >= 0.5, false) AS accepted FROM s",
    "decision_confusion": f"""WITH c AS (SELECT count(*) FILTER (out_of_domain AND is_fallback) AS a, count(*) FILTER (out_of_domain AND NOT is_fallback) AS b, count(*) FILTER (NOT out_of_domain AND is_fallback) AS c, count(*) FILTER (NOT out_of_domain AND NOT is_fallback) AS d FROM ({_RESULTS}))
SELECT a AS ood_fallback, b AS ood_answered, c AS in_fallback, d AS in_answered, round(CASE WHEN a + b > 0 THEN a / (a + b) ELSE 0 END, 4) AS ood_fallback_rate, round(CASE WHEN c + d > 0 THEN c / (c + d) ELSE 0 END, 4) AS false_rejection_rate FROM c""",
    "group_summary": f"SELECT coalesce(source, 'unknown') AS grp, coalesce(error, 'none') AS reason, count(*) AS n, round(avg(faithfulness), 4) AS faithfulness FROM ({_RESULTS}) GROUP BY 1, 2",
    "dataset_validation": """WITH q AS (SELECT doc_id // 2 + doc_id % 3 AS query_id, text AS query, doc_id FROM documents)
SELECT 'duplicate_id' AS problem, CAST(query_id AS VARCHAR) AS value FROM q GROUP BY query_id HAVING count(*) > 1 UNION ALL SELECT 'duplicate_query', query FROM q GROUP BY query HAVING count(*) > 1
UNION ALL SELECT 'unknown_label', CAST(doc_id + 7 AS VARCHAR) FROM q WHERE doc_id + 7 NOT IN (SELECT doc_id FROM documents)""",
    "worst_examples": f"SELECT doc_id, error, is_fallback, faithfulness FROM ({_RESULTS}) ORDER BY CASE WHEN error IS NOT NULL THEN 0 WHEN is_fallback THEN 1 ELSE 2 END, coalesce(faithfulness, 1), doc_id LIMIT 5",
    "judge_ratios": """WITH f AS (SELECT doc_id, unnest(range(1, n_chars % 5 + 2)) AS i FROM documents), g AS (SELECT doc_id, (doc_id + i) % 2 = 0 AS s, (doc_id + i) % 3 <> 0 AS c FROM f)
SELECT doc_id, round(avg(CAST(s AS INTEGER)), 6) AS faithfulness, round(avg(CAST(c AS INTEGER)), 6) AS citation_completeness, round(avg(CAST(s AS INTEGER)) FILTER (c), 6) AS citation_correctness FROM g GROUP BY doc_id""",
    "metric_delta": f"""WITH t AS (SELECT is_fallback, avg(faithfulness) AS f, avg(latency_ms) AS l FROM ({_RESULTS}) GROUP BY is_fallback)
SELECT 'faithfulness' AS metric, round(max(f) FILTER (is_fallback) - max(f) FILTER (NOT is_fallback), 4) AS delta FROM t UNION ALL SELECT 'latency_ms', round(max(l) FILTER (is_fallback) - max(l) FILTER (NOT is_fallback), 4) FROM t""",
    "change_set": f"WITH {_SNAP} SELECT * FROM changes",
    "registry_upsert": f"WITH {_SNAP} SELECT source_file, h AS content_hash, 'active' AS status, 2 AS chunk_count FROM new UNION ALL SELECT source_file, h, status, 1 FROM old WHERE source_file NOT IN (SELECT source_file FROM new)",
    "registry_soft_delete": f"""WITH {_SNAP}, {_MAP}, gone AS (SELECT source_file FROM changes WHERE change_type = 'deleted')
SELECT o.source_file, CASE WHEN g.source_file IS NOT NULL THEN 'deleted' ELSE o.status END AS status, CASE WHEN g.source_file IS NOT NULL THEN 0 ELSE 1 END AS chunk_count, CASE WHEN g.source_file IS NOT NULL THEN 0 ELSE m.n END AS mappings FROM old o LEFT JOIN gone g USING (source_file) JOIN maps m USING (source_file)""",
    "chunk_mapping_replace": f"WITH {_MAP} SELECT source_file, CASE WHEN length(source_file) % 2 = 0 THEN 1 ELSE n END AS n, CASE WHEN length(source_file) % 2 = 0 THEN 1 ELSE 0 END AS renewed FROM maps",
    "resume_antijoin": "SELECT doc_id AS query_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic <> 1)",
    "stratified_sample": "WITH r AS (SELECT doc_id, lang AS stratum, CAST(row_number() OVER (PARTITION BY lang ORDER BY sha256('0:' || doc_id), doc_id) AS INTEGER) AS pick FROM documents) SELECT * FROM r WHERE pick <= 5",
    "template_cross": """WITH t AS (SELECT n_name || '|' || r_name AS key, unnest(['how does ' || n_name || ' in ' || r_name || ' respond', 'which office of ' || n_name || ' in ' || r_name || ' decides']) AS query FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT key, query, CAST(row_number() OVER (ORDER BY md5(query), query) AS INTEGER) AS place FROM t""",
    "row_status": f"SELECT CASE WHEN error IS NOT NULL THEN 'error' WHEN is_fallback THEN 'partial' ELSE 'ok' END AS status, count(*) AS n FROM ({_RESULTS}) GROUP BY 1",
    "agent_loop": """WITH c AS (SELECT conv_id * 1000 + turn AS query_id, text, (length(text) + 2) % 3 AS i FROM conversations WHERE role = 'user')
SELECT query_id, CAST(i + 1 AS INTEGER) AS iteration, 'approved' AS critique, md5(i || ' ' || array_to_string(list_reverse(string_split(text, '')), '')) AS digest FROM c""",
    "compact_text": r"SELECT conv_id, turn, md5(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM conversations",
    "template_answer": f"""WITH {_HITS}, {_EVIDENCE},
s AS (SELECT *, list_filter(string_split(regexp_replace(text, '([。！？；;])\\s*', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM e WHERE pos <= 4),
k AS (SELECT *, list_sort(list_transform(parts, lambda x, i: {{'a': {_TERMS}, 'b': least(length(x), 220), 'i': -i, 's': x}}), 'DESC')[1].s AS best FROM s),
t AS (SELECT query_id, pos, score, source_file, section_path_text, CASE WHEN text = '' THEN '{L.EMPTY_SNIPPET}' WHEN length(best) <= 180 THEN best ELSE regexp_replace(substring(best, 1, 179), '[，,；;。 ]+$', '') || '……' END AS sentence FROM k),
q AS (SELECT item_id AS query_id, CASE WHEN {_has(L.ASK_SOURCE)} THEN {L.LABELS_SOURCE!r} WHEN {_has(L.ASK_WHO)} THEN {L.LABELS_WHO!r} ELSE {L.LABELS!r} END AS labels FROM benchmark),
a AS (SELECT query_id, count(t.pos) AS n, CASE WHEN max(score) < 0.3 THEN '{L.LOW_HEADER}' ELSE '{L.HEADER}' END AS header, string_agg(pos || '. ' || labels[pos] || '：' || sentence || '[S' || pos || ']', chr(10) ORDER BY pos) AS body,
  string_agg('[S' || pos || '] ' || source_file || CASE WHEN section_path_text <> '' THEN ' / ' || section_path_text ELSE '' END, chr(10) ORDER BY pos) AS tail FROM q LEFT JOIN t USING (query_id) GROUP BY query_id)
SELECT query_id, md5(CASE WHEN n = 0 THEN '{L.NO_ANSWER}' ELSE concat_ws(chr(10), header, '', body, '', '{L.SOURCES}', tail) END) AS digest, CAST(n AS INTEGER) AS n FROM a""",
    "answer_batch": f"""WITH {_HITS}, {_EVIDENCE},
g AS (SELECT q.item_id AS query_id, q.text, count(e.query_id) AS evidence_count, max(conf) AS max_score FROM benchmark q LEFT JOIN e ON e.query_id = q.item_id GROUP BY q.item_id, q.text),
d AS (SELECT *, CASE WHEN {_has(L.DOMAIN)} OR {" OR ".join(f"regexp_matches(text, '{x}')" for x in L.DOMAIN_PATTERNS)} THEN 'in_domain' WHEN {_has(L.OUTSIDE)} THEN 'out_of_domain' ELSE 'uncertain' END AS decision,
  list_filter([CASE WHEN evidence_count < 1 THEN 'insufficient_evidence' END, CASE WHEN max_score < 0.3 THEN 'low_retrieval_score' END], lambda x: x IS NOT NULL) AS why FROM g),
r AS (SELECT *, CASE WHEN decision = 'out_of_domain' THEN 'out_of_domain' WHEN len(why) > 0 THEN array_to_string(why, ';') END AS reason FROM d)
SELECT query_id, reason IS NOT NULL AS is_fallback, reason AS fallback_reason, decision, evidence_count, {_STATE.format("max_score")} AS confidence_state FROM r""",
}
