"""Queries of run summaries, ablation arms and evaluation sets, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import evaluation, selection

from . import corpus as C

VARIANTS = ("plain", "rewrite", "multi", "hyde")


def _rows(s, d):
    """Result rows of a run over the labelled documents."""
    t = C.table(s, d, "documents").join(C.table(s, d, "labels"), "doc_id")
    n, i = F.col("n_chars"), F.col("doc_id")
    fallback = F.col("toxic") == 1
    return t.select(
        i.alias("query_id"), F.col("lang").alias("query_type"), F.when(n % 9 == 0, "out_of_domain").otherwise(F.col("source")).alias("disaster_type"), F.when(n % 10 == 0, "error").when(n % 6 == 0, "partial").otherwise("ok").alias("status"),
        F.when(n % 10 == 0, "failed").alias("error"), fallback.alias("is_fallback"), F.when(fallback & (n % 4 != 0), F.when(n % 3 == 0, "out_of_domain").otherwise("low_retrieval_score")).alias("fallback_reason"),
        F.when(n % 3 != 0, F.col("quality") == 0).alias("expected_fallback"), F.when(n % 5 == 1, "answered").when(n % 5 == 2, "fallback").alias("regression_decision"), F.when(n % 2 == 0, "chat").otherwise("template").alias("composer_mode"),
        F.when(n % 7 == 0, F.array(F.lit("S8"), F.lit("S9"))).alias("unknown_ids"), (n % 4 != 1).alias("all_citations_mapped"), (n % 5 != 0).alias("judged"), F.when(n % 5 != 0, n % 100 / 100.0).alias("faithfulness"), F.when(n % 5 != 0, n % 50 / 50.0).alias("answer_relevancy"),
        n.cast("double").alias("latency_ms"),
    )


def run_summary(s, d):
    return evaluation.run_summary(_rows(s, d))


def answer_summary_full(s, d):
    return evaluation.answer_summary(_rows(s, d), ["query_type"], mode="chat")


def fallback_reasons(s, d):
    return evaluation.reason_histogram(_rows(s, d))


def base_rows(s, d):
    return evaluation.base_rows(_rows(s, d).select("query_id", "query_type", "disaster_type", "expected_fallback", "regression_decision")).select("query_id", "disaster_type", "expected_fallback")


def decision_metrics(s, d):
    return evaluation.decision_metrics(_rows(s, d).withColumnRenamed("disaster_type", "kind"))


def _variants(s, d):
    """Four variants of a run: ranks come from the document's number and the variant's place."""
    n, v = F.col("n_chars"), F.col("v")
    t = C.table(s, d, "documents").select("doc_id", "n_chars", F.posexplode(F.array(*[F.lit(x) for x in VARIANTS])).alias("v", "variant"))
    rank = lambda m: F.when((n + 3 * v) % m < 14, ((n + 3 * v) % m + 1).cast("int"))
    runs = t.select(F.col("doc_id").alias("query_id"), "variant", rank(17).alias("doc_rank"), rank(29).alias("chunk_rank"), (n % 8 != v).alias("packed"), (n % 40 / 40.0).alias("token_ratio"), (n + v).cast("double").alias("latency_ms"), (v + 1).alias("branches"), (v == 3).alias("hyde_used"), ((v == 3) & (n % 6 == 0)).alias("fallback"))
    return evaluation.variant_rows(runs, "plain")


def variant_summary(s, d):
    return evaluation.variant_summary(_variants(s, d), "plain", guardrail=True)


def arm_summary(s, d):
    return evaluation.arm_summary(_variants(s, d), ("plain", "rewrite", "hyde"))


def pick_examples(s, d):
    return evaluation.pick_examples(_variants(s, d), "hyde", "plain")


def group_counts(s, d):
    return evaluation.group_counts_match(C.table(s, d, "documents"), "lang", {"en": 400, "xx": 3})


def regression_set(s, d):
    rows = _rows(s, d).withColumn("query_type", F.when(F.col("disaster_type") == "out_of_domain", "out_of_domain").otherwise(F.col("query_type")))
    return selection.regression_set(rows.filter("query_id % 2 = 0"), rows.filter("query_id % 2 = 1"), {"en": 1}, 6)


QUERIES = {f.__name__: f for f in (run_summary, answer_summary_full, fallback_reasons, base_rows, decision_metrics, variant_summary, arm_summary, pick_examples, group_counts, regression_set)}

_ROWS = """
r AS (SELECT doc_id AS query_id, lang AS query_type, CASE WHEN n_chars % 9 = 0 THEN 'out_of_domain' ELSE source END AS disaster_type, CASE WHEN n_chars % 10 = 0 THEN 'error' WHEN n_chars % 6 = 0 THEN 'partial' ELSE 'ok' END AS status, n_chars % 10 = 0 AS failed,
  toxic = 1 AS is_fallback, CASE WHEN toxic = 1 AND n_chars % 4 <> 0 THEN CASE WHEN n_chars % 3 = 0 THEN 'out_of_domain' ELSE 'low_retrieval_score' END END AS fallback_reason, CASE WHEN n_chars % 3 <> 0 THEN quality = 0 END AS expected_fallback,
  CASE n_chars % 5 WHEN 1 THEN 'answered' WHEN 2 THEN 'fallback' END AS regression_decision, n_chars, CASE WHEN n_chars % 5 <> 0 THEN n_chars % 100 / 100.0::DOUBLE END AS faithfulness, CASE WHEN n_chars % 5 <> 0 THEN n_chars % 50 / 50.0::DOUBLE END AS answer_relevancy
  FROM documents JOIN labels USING (doc_id))"""
_SHARE = "round(coalesce(avg(CASE WHEN {0} THEN 1.0::DOUBLE ELSE 0 END), 0), 4)"
_VARIANTS = f"""
v AS (SELECT doc_id AS query_id, n_chars AS n, unnest({list(VARIANTS)!r}) AS variant, unnest([0, 1, 2, 3]) AS v FROM documents),
k AS (SELECT *, CASE WHEN (n + 3 * v) % 17 < 10 THEN (n + 3 * v) % 17 + 1 END AS d, CASE WHEN (n + 3 * v) % 29 < 10 THEN (n + 3 * v) % 29 + 1 END AS c FROM v),
w AS (SELECT k.*, b.d AS bd, b.c AS bc, CASE WHEN k.d IS NOT NULL OR b.d IS NOT NULL THEN coalesce(k.d, 11) - coalesce(b.d, 11) END AS ds, CASE WHEN k.c IS NOT NULL OR b.c IS NOT NULL THEN coalesce(k.c, 11) - coalesce(b.c, 11) END AS cs FROM k JOIN k b USING (query_id) WHERE b.variant = 'plain')"""
_MEAN = "round(coalesce(avg({0}), 0), 4)"
_HIT = "round(avg(CASE WHEN {1} IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) FILTER (variant = '{0}'), 4) AS {0}_{2}_recall_10"

ORACLE = {
    "run_summary": f"""WITH {_ROWS} SELECT count(*) AS query_count, count(*) AS row_count, count(*) FILTER (status = 'ok') AS ok_count, count(*) FILTER (status = 'partial') AS partial_count, count(*) FILTER (status = 'error') AS error_count,
{_SHARE.format("status = 'ok'")} AS run_success_rate, {_SHARE.format("NOT is_fallback")} AS answer_rate, {_SHARE.format("is_fallback")} AS fallback_rate, CAST(2 * count(*) FILTER (n_chars % 7 = 0) AS BIGINT) AS unknown_citation_count, count(*) FILTER (n_chars % 2 = 0) AS chat_count FROM r""",
    "answer_summary_full": f"""WITH {_ROWS} SELECT query_type, count(*) AS query_count, {_SHARE.format("NOT failed")} AS success_rate, {_SHARE.format("is_fallback")} AS fallback_rate,
round(avg(CASE WHEN expected_fallback IS NOT NULL THEN CASE WHEN expected_fallback = is_fallback THEN 1.0::DOUBLE ELSE 0 END END), 4) AS fallback_accuracy, round(coalesce(avg(CASE WHEN n_chars % 5 <> 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (NOT is_fallback), 0), 4) AS judge_coverage,
round(avg(faithfulness) FILTER (NOT is_fallback), 4) AS faithfulness, round(avg(answer_relevancy) FILTER (NOT is_fallback), 4) AS answer_relevancy, round(avg(n_chars), 2) AS avg_latency_ms, round(quantile_cont(CAST(n_chars AS DOUBLE), 0.5), 2) AS p50_latency_ms, round(quantile_cont(CAST(n_chars AS DOUBLE), 0.95), 2) AS p95_latency_ms,
{_SHARE.format("n_chars % 4 <> 1")} AS all_citations_mapped_ratio, {_SHARE.format("(fallback_reason IS NOT NULL) = is_fallback")} AS fallback_reason_consistency FROM r WHERE n_chars % 2 = 0 GROUP BY query_type""",
    "fallback_reasons": f"WITH {_ROWS} SELECT coalesce(fallback_reason, 'missing_reason') AS fallback_reason, count(*) AS n FROM r WHERE is_fallback GROUP BY 1",
    "base_rows": f"WITH {_ROWS} SELECT query_id, disaster_type, CASE WHEN regression_decision IS NOT NULL THEN regression_decision = 'fallback' WHEN expected_fallback IS NOT NULL THEN expected_fallback WHEN disaster_type = 'out_of_domain' THEN true END AS expected_fallback FROM r",
    "decision_metrics": f"""WITH {_ROWS}, c AS (SELECT count(*) FILTER (expected_fallback AND is_fallback) AS a, count(*) FILTER (expected_fallback AND NOT is_fallback) AS b, count(*) FILTER (i AND is_fallback) AS c, count(*) FILTER (i AND NOT is_fallback) AS d
FROM (SELECT *, coalesce(NOT expected_fallback, disaster_type <> 'out_of_domain') AS i FROM r))
SELECT a AS ood_fallback, b AS ood_answered, c AS in_domain_fallback, d AS in_domain_answered, round(b / (a + b), 4) AS ood_false_accept_rate, round(c / (c + d), 4) AS in_domain_false_rejection_rate FROM c""",
    "variant_summary": f"""WITH {_VARIANTS}, s AS (SELECT variant, count(*) AS query_count, avg(CASE WHEN d IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS dr, avg(CASE WHEN c IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS cr, avg(coalesce(1.0::DOUBLE / d, 0)) AS dm, avg(coalesce(1.0::DOUBLE / c, 0)) AS cm,
  {_SHARE.format("n % 8 <> v")} AS packed_nonempty_ratio, {_MEAN.format("n % 40 / 40.0::DOUBLE")} AS avg_packed_token_ratio, round(avg(n + v), 2) AS avg_latency_ms, {_MEAN.format("ds")} AS avg_doc_rank_shift, {_MEAN.format("cs")} AS avg_chunk_rank_shift,
  {_MEAN.format("v + 1")} AS avg_branch_count, {_SHARE.format("v = 3")} AS hyde_used_ratio, count(*) FILTER (v = 3 AND n % 6 = 0) AS fallback_count FROM w GROUP BY variant),
t AS (SELECT * REPLACE (round(dr, 4) AS dr, round(cr, 4) AS cr, round(dm, 4) AS dm, round(cm, 4) AS cm) FROM s)
SELECT t.variant, t.query_count, t.dr AS doc_recall, t.cr AS chunk_recall, t.dm AS doc_mrr, t.cm AS chunk_mrr, t.packed_nonempty_ratio, t.avg_packed_token_ratio, t.avg_latency_ms, t.avg_doc_rank_shift, t.avg_chunk_rank_shift, t.avg_branch_count, t.hyde_used_ratio, t.fallback_count,
round(t.dm - b.dm, 4) AS doc_mrr_delta, round(t.cm - b.cm, 4) AS chunk_mrr_delta, CASE WHEN t.variant <> 'plain' THEN t.dr >= b.dr AND t.cr >= b.cr END AS no_regression FROM t JOIN t b ON b.variant = 'plain'""",
    "arm_summary": f"""WITH {_VARIANTS} SELECT count(DISTINCT query_id) AS query_count, {", ".join(_HIT.format(a, c, n) for a in ("plain", "rewrite", "hyde") for c, n in (("d", "doc"), ("c", "chunk")))},
round(avg(CASE WHEN d IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) FILTER (variant = 'hyde') - avg(CASE WHEN d IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) FILTER (variant = 'plain'), 4) AS doc_recall_gain FROM k""",
    "pick_examples": f"WITH {_VARIANTS} SELECT query_id FROM w WHERE variant = 'hyde' AND d IS NOT NULL AND bd IS NULL ORDER BY query_id DESC LIMIT 3",
    "group_counts": "SELECT coalesce(grp, e) AS grp, coalesce(n, 0) AS n, coalesce(w, 0) AS expected, coalesce(n, 0) = coalesce(w, 0) AS ok FROM (SELECT lang AS grp, count(*) AS n FROM documents GROUP BY lang) FULL JOIN (SELECT unnest(['en', 'xx']) AS e, unnest([CAST(400 AS BIGINT), 3]) AS w) ON grp = e",
}
