"""Retrieval and answer metrics as projections and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def recall_at(ranked: Column, relevant: Column, k: int) -> Column:
    """Share of the relevant among the first k different results; null without labels."""
    if k <= 0:
        raise ValueError("k must be positive")
    rel = F.array_distinct(relevant)
    return F.when(F.size(rel) > 0, F.size(F.array_intersect(F.slice(F.array_distinct(ranked), 1, k), rel)) / F.size(rel))


def _gains(ranked: Column, relevant: Column, k: int) -> Column:
    return F.transform(F.slice(F.array_distinct(ranked), 1, k), lambda x, i: F.when(F.array_contains(relevant, x), i + 1))


def mrr_at(ranked: Column, relevant: Column, k: int) -> Column:
    best = F.array_min(F.array_compact(_gains(ranked, relevant, k)))
    return F.when(F.size(relevant) > 0, F.coalesce(1.0 / best, F.lit(0.0)))


def ndcg_at(ranked: Column, relevant: Column, k: int) -> Column:
    dcg = F.aggregate(_gains(ranked, relevant, k), F.lit(0.0), lambda a, x: a + F.coalesce(1.0 / F.log2(x + F.lit(1.0)), F.lit(0.0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.size(F.array_distinct(relevant)), F.lit(k))), F.lit(0.0), lambda a, x: a + 1.0 / F.log2(x + F.lit(1.0)))
    return F.when(F.size(relevant) > 0, dcg / ideal)


def per_query(runs: DataFrame, ks: tuple[int, ...] = (5, 10), prefix: str = "chunk") -> DataFrame:
    """runs: query_id, ranked (array), relevant (array). One row for each query: recalls, mrr and ndcg at the largest k, rounded to 6."""
    top = max(ks)
    cols = {f"{prefix}_recall_{k}": recall_at(F.col("ranked"), F.col("relevant"), k) for k in ks} | {f"{prefix}_mrr_{top}": mrr_at(F.col("ranked"), F.col("relevant"), top), f"{prefix}_ndcg_{top}": ndcg_at(F.col("ranked"), F.col("relevant"), top)}
    return runs.select("query_id", *[F.round(v, 6).alias(n) for n, v in cols.items()])


def ranked_lists(hits: DataFrame, item: str = "chunk_id") -> DataFrame:
    return hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item))), lambda x: x[item]).alias("ranked"))


def mean_summary(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Means that skip nulls, rounded to 4, and the number of queries."""
    return rows.agg(F.count("*").alias("query_count"), *[F.round(F.avg(c), 4).alias(c) for c in columns])


def latency(column: str) -> list[Column]:
    """Mean and interpolated percentiles, zero for no rows."""
    q = F.percentile(column, F.array(F.lit(0.5), F.lit(0.95)))
    return [F.round(F.coalesce(F.avg(column), F.lit(0.0)), 2).alias("avg_latency_ms"), F.round(F.coalesce(F.get(q, F.lit(0)), F.lit(0.0)), 2).alias("p50_latency_ms"), F.round(F.coalesce(F.get(q, F.lit(1)), F.lit(0.0)), 2).alias("p95_latency_ms")]


def truncated_percentile(df: DataFrame, keys: list[str], column: str, share: float = 0.95) -> DataFrame:
    """The value at position floor(n * share), counted from one; the last one if that is zero."""
    w = W.partitionBy(*keys)
    rows = df.filter(F.col(column).isNotNull()).withColumns({"n": F.count("*").over(w), "r": F.row_number().over(w.orderBy(column))})
    at = F.floor(F.col("n") * share)
    return rows.filter(F.col("r") == F.when(at == 0, F.col("n")).otherwise(at)).select(*keys, F.col(column).alias("p95"))


def agreement(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """query_id, prefix_match (share of equal positions), overlap (share of common items)."""
    both = a.select("query_id", F.slice("ranked", 1, k).alias("x")).join(b.select("query_id", F.slice("ranked", 1, k).alias("y")), "query_id")
    same = F.size(F.filter(F.zip_with("x", "y", lambda p, q: p.eqNullSafe(q) & p.isNotNull()), lambda t: t))
    n = F.greatest(F.size("x"), F.size("y"), F.lit(1))
    return both.select("query_id", F.round(same / n, 6).alias("prefix_match"), F.round(F.size(F.array_intersect("x", "y")) / n, 6).alias("overlap"))


def first_hit(ranked: Column, relevant: Column, k: int) -> Column:
    """Position of the first relevant result, k + 1 if there is none."""
    return F.coalesce(F.array_min(F.array_compact(_gains(ranked, relevant, k))), F.lit(k + 1))


def rank_shift(base: Column, other: Column, k: int) -> Column:
    """Positive if the other variant is better; null if both miss."""
    return F.when((base > k) & (other > k), None).otherwise(base - other)


def judged(facts: Column) -> dict[str, Column]:
    """Ratios over an array of struct(supported, cited); null for none."""
    size = lambda f: F.size(F.filter(facts, f))
    none = F.size(facts) == 0
    cited = size(lambda x: x["cited"])
    return {
        "faithfulness": F.when(~none, size(lambda x: x["supported"]) / F.size(facts)), "citation_completeness": F.when(~none, cited / F.size(facts)),
        "citation_correctness": F.when(cited > 0, size(lambda x: x["cited"] & x["supported"]) / cited),
    }


QUALITY = ("faithfulness", "answer_relevancy", "citation_correctness", "citation_completeness")


def _ratio(c: Column, when: Column | None = None) -> Column:
    """Share of rows for which c holds (null does not), of those that ``when`` admits; 0 for none."""
    c = F.coalesce(c.cast("double"), F.lit(0.0))
    return F.round(F.coalesce(F.avg(c if when is None else F.when(when, c)), F.lit(0.0)), 4)


def answer_summary(rows: DataFrame, keys: list[str], mode: str | None = None) -> DataFrame:
    """Rates over answered queries; quality means leave out fallbacks; accuracy counts labelled rows alone. mode: rows of one composer.

    rows: error, is_fallback, expected_fallback, latency_ms, and as far as there: judged, all_citations_mapped, fallback_reason, composer_mode and QUALITY.
    """
    rows = rows if mode is None else rows.filter(F.col("composer_mode") == mode)
    has = set(rows.columns)
    good = ~F.col("is_fallback")
    judged_ = F.col("judged") if "judged" in has else F.col("faithfulness").isNotNull()
    cols = [
        F.count("*").alias("query_count"), _ratio(F.col("error").isNull()).alias("success_rate"), _ratio(F.col("is_fallback")).alias("fallback_rate"),
        F.round(F.avg(F.when(F.col("expected_fallback").isNotNull(), (F.col("expected_fallback") == F.col("is_fallback")).cast("double"))), 4).alias("fallback_accuracy"),
        _ratio(judged_, good).alias("judge_coverage"), *[F.round(F.avg(F.when(good, F.col(c))), 4).alias(c) for c in QUALITY if c in has], *latency("latency_ms"),
    ]
    if "all_citations_mapped" in has:
        cols.append(_ratio(F.col("all_citations_mapped")).alias("all_citations_mapped_ratio"))
    if "fallback_reason" in has:
        given = F.coalesce(F.col("fallback_reason"), F.lit("")) != ""
        cols.append(_ratio(given == F.coalesce("is_fallback", F.lit(False))).alias("fallback_reason_consistency"))
    return rows.groupBy(*keys).agg(*cols)


def run_summary(rows: DataFrame, asked: int | None = None) -> DataFrame:
    """One row over a run: counts by status, success, answer and fallback rate, unknown citations, answers of a language model.

    asked: how many queries were put, if not as many as there are rows.
    """
    status = lambda x: F.count_if(F.col("status") == x).alias(f"{x}_count")
    n = F.count("*")
    return rows.agg(
        (n if asked is None else F.lit(asked).cast("long")).alias("query_count"), n.alias("row_count"), status("ok"), status("partial"), status("error"), _ratio(F.col("status") == "ok").alias("run_success_rate"),
        _ratio(~F.coalesce("is_fallback", F.lit(False))).alias("answer_rate"), _ratio(F.col("is_fallback")).alias("fallback_rate"),
        F.coalesce(F.sum(F.size(F.coalesce("unknown_ids", F.array().cast("array<string>")))), F.lit(0)).alias("unknown_citation_count"), F.count_if(F.col("composer_mode") == "chat").alias("chat_count"),
    )


def reason_histogram(rows: DataFrame) -> DataFrame:
    """fallback_reason, n: of the rows that fell back."""
    reason = F.coalesce(F.when(F.col("fallback_reason") != "", F.col("fallback_reason")), F.lit("missing_reason"))
    return rows.filter("is_fallback").groupBy(reason.alias("fallback_reason")).agg(F.count("*").alias("n"))


def expected_fallback(regression_decision: Column, labelled: Column, *kinds: Column) -> Column:
    """A regression set's decision, else the label, else true for queries outside the domain, else unknown."""
    said = F.when(regression_decision.isin("answered", "fallback"), regression_decision == "fallback")
    outside = F.lit(False)
    for k in kinds:
        outside = outside | F.coalesce(k == "out_of_domain", F.lit(False))
    return F.coalesce(said, labelled, F.when(outside, True))


def decision_metrics(rows: DataFrame) -> DataFrame:
    """One row: expected_fallback against is_fallback; rows without a label count as inside unless they are of an outside kind. A rate without rows is null."""
    want, fall = F.col("expected_fallback"), F.coalesce("is_fallback", F.lit(False))
    out = F.coalesce(want, F.lit(False))
    inside = F.coalesce(~want, F.coalesce(F.col("kind") != "out_of_domain", F.lit(True)))
    counts = rows.agg(F.count_if(out & fall).alias("ood_fallback"), F.count_if(out & ~fall).alias("ood_answered"), F.count_if(inside & fall).alias("in_domain_fallback"), F.count_if(inside & ~fall).alias("in_domain_answered"))
    rate = lambda x, y: F.round(F.when(F.col(x) + F.col(y) > 0, F.col(x) / (F.col(x) + F.col(y))), 4)
    return counts.withColumns({"ood_false_accept_rate": rate("ood_answered", "ood_fallback"), "in_domain_false_rejection_rate": rate("in_domain_fallback", "in_domain_answered")})


def base_rows(queries: DataFrame) -> DataFrame:
    """A result row's query side: all its columns, with expected_fallback resolved. queries: regression_decision, expected_fallback, query_type, disaster_type."""
    return queries.withColumn("expected_fallback", expected_fallback(F.col("regression_decision"), F.col("expected_fallback"), F.col("query_type"), F.col("disaster_type"))).drop("regression_decision")


def variant_rows(runs: DataFrame, base: str, k: int = 10) -> DataFrame:
    """runs: query_id, variant, doc_rank, chunk_rank (null or over k: missed). Adds hits, reciprocal ranks, and the shift of each rank against the base variant
    (a miss stands at k + 1; null if both missed; below zero is better)."""
    own = W.partitionBy("query_id")
    out = runs
    for c in ("doc", "chunk"):
        rank = F.when(F.col(f"{c}_rank") <= k, F.col(f"{c}_rank"))
        before = F.max(F.when(F.col("variant") == base, rank)).over(own)
        shift = F.when(rank.isNotNull() | before.isNotNull(), F.coalesce(rank, F.lit(k + 1)) - F.coalesce(before, F.lit(k + 1)))
        out = out.withColumns({f"{c}_shift": shift, f"{c}_hit": rank.isNotNull(), f"{c}_mrr": F.coalesce(1.0 / rank, F.lit(0.0))})
    return out


def variant_summary(rows: DataFrame, base: str, guardrail: bool = False) -> DataFrame:
    """One row for each variant over variant_rows (with latency_ms, packed, token_ratio, and branches, hyde_used, fallback as far as there): recall, mrr, means,
    deltas against the base variant, and with guardrail whether neither recall is below the base's (null for the base)."""
    mean = lambda c: F.round(F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)), 4)
    more = [mean(c).alias(n) for c, n in (("branches", "avg_branch_count"), ("hyde_used", "hyde_used_ratio")) if c in rows.columns]
    more += [F.count_if(F.col("fallback")).alias("fallback_count")] if "fallback" in rows.columns else []
    out = rows.groupBy("variant").agg(
        F.count("*").alias("query_count"), mean("doc_hit").alias("doc_recall"), mean("chunk_hit").alias("chunk_recall"), mean("doc_mrr").alias("doc_mrr"), mean("chunk_mrr").alias("chunk_mrr"),
        mean("packed").alias("packed_nonempty_ratio"), mean("token_ratio").alias("avg_packed_token_ratio"), F.round(F.avg("latency_ms"), 2).alias("avg_latency_ms"),
        mean("doc_shift").alias("avg_doc_rank_shift"), mean("chunk_shift").alias("avg_chunk_rank_shift"), *more,
    )
    first = out.filter(F.col("variant") == base).agg(*[F.coalesce(F.max(c), F.lit(0.0)).alias(f"_{c}") for c in ("doc_mrr", "chunk_mrr", "doc_recall", "chunk_recall")])
    out = out.join(F.broadcast(first))  # one row
    out = out.withColumns({f"{c}_delta": F.round(F.col(c) - F.col(f"_{c}"), 4) for c in ("doc_mrr", "chunk_mrr")})
    if guardrail:
        out = out.withColumn("no_regression", F.when(F.col("variant") != base, (F.col("doc_recall") >= F.col("_doc_recall")) & (F.col("chunk_recall") >= F.col("_chunk_recall"))))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def arm_summary(runs: DataFrame, arms: tuple[str, ...] = ("dense", "sparse", "hybrid"), k: int = 10) -> DataFrame:
    """One row over variant_rows of three searchers: document and exact chunk recall of each arm, and the gain of the last over the first."""
    means = [F.round(F.coalesce(F.avg(F.when(F.col("variant") == a, F.col(f"{c}_hit").cast("double"))), F.lit(0.0)), 4).alias(f"{a}_{c}_recall_{k}") for a in arms for c in ("doc", "chunk")]
    hits = lambda a: F.avg(F.when(F.col("variant") == a, F.col("doc_hit").cast("double")))
    return runs.agg(F.countDistinct("query_id").alias("query_count"), *means, F.round(hits(arms[-1]) - hits(arms[0]), 4).alias("doc_recall_gain"))


def pick_examples(runs: DataFrame, better: str, worse: str, most: int = 3) -> DataFrame:
    """Up to ``most`` queries that one arm answers and the other misses, the last ids first."""
    hit = lambda a: F.max(F.when(F.col("variant") == a, F.col("doc_hit"))).alias(a)
    pairs = runs.groupBy("query_id").agg(hit(better), hit(worse))
    return pairs.filter(F.col(better) & ~F.coalesce(F.col(worse), F.lit(False))).orderBy(F.desc("query_id")).limit(most).select("query_id")


def group_counts_match(df: DataFrame, group: str, expected: dict[str, int]) -> DataFrame:
    """grp, n, expected, ok: every group of either side; a group that only one side has is a mismatch."""
    want = df.sparkSession.createDataFrame(sorted(expected.items()), "grp string, expected long")
    have = df.groupBy(F.col(group).cast("string").alias("grp")).agg(F.count("*").alias("n"))
    out = have.join(want, "grp", "full_outer").select("grp", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("expected", F.lit(0)).alias("expected"))
    return out.withColumn("ok", F.col("n") == F.col("expected"))


def group_summary(rows: DataFrame, group: str, reason: str = "error", value: str = "faithfulness") -> DataFrame:
    """grp, reason, n, mean value: rows without a group are unknown, rows without a reason have none."""
    return rows.groupBy(F.coalesce(group, F.lit("unknown")).alias("grp"), F.coalesce(reason, F.lit("none")).alias("reason")).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias(value))


def worst_examples(rows: DataFrame, key: str, most: int = 5) -> DataFrame:
    """Errors first, then fallbacks, then the least faithful."""
    order = [F.when(F.col("error").isNotNull(), 0).when(F.col("is_fallback"), 1).otherwise(2), F.coalesce("faithfulness", F.lit(1.0)), F.col(key)]
    return rows.orderBy(*order).limit(most)


def hit_rates(runs: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """One row: of runs (query_id, ranked, relevant), the shares of queries with a relevant result among the first k that is not the query itself."""
    others = F.filter("ranked", lambda x: x != F.col("query_id"))
    hit = lambda k: F.exists(F.slice(others, 1, k), lambda x: F.array_contains("relevant", x)).cast("double")
    return runs.agg(F.count("*").alias("queries"), *[F.round(F.avg(hit(k)), 4).alias(f"hit_{k}") for k in ks])


def confusion(rows: DataFrame) -> DataFrame:
    """One row: outside and inside questions by fallback or answer, and the rates."""
    out, fall = F.col("out_of_domain"), F.col("is_fallback")
    counts = [F.count_if(out & fall).alias("ood_fallback"), F.count_if(out & ~fall).alias("ood_answered"), F.count_if(~out & fall).alias("in_fallback"), F.count_if(~out & ~fall).alias("in_answered")]
    rate = lambda a, b: F.round(F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0), 4)
    return rows.agg(*counts).withColumns({"ood_fallback_rate": rate("ood_fallback", "ood_answered"), "false_rejection_rate": rate("in_fallback", "in_answered")})


def acceptance(metrics: DataFrame, limits: dict[str, float]) -> DataFrame:
    checks = {f"{n}_ok": F.col(n) >= v for n, v in limits.items()}
    out = metrics.withColumns(checks)
    passed = F.lit(True)
    for n in checks:
        passed = passed & F.coalesce(F.col(n), F.lit(False))
    return out.withColumn("accepted", passed)


def dataset_problems(queries: DataFrame, known: DataFrame, label: str = "chunk_id") -> DataFrame:
    """problem, value: ids and texts that repeat, and labels that no table knows. queries: query_id, query, relevant (array)."""
    twice = lambda c, name: queries.groupBy(c).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(name).alias("problem"), F.col(c).cast("string").alias("value"))
    unknown = queries.select(F.explode("relevant").alias(label)).distinct().join(known.select(label).distinct(), label, "left_anti").select(F.lit("unknown_label").alias("problem"), F.col(label).cast("string").alias("value"))
    return twice("query_id", "duplicate_id").unionByName(twice("query", "duplicate_query")).unionByName(unknown)


def stratified_sample(df: DataFrame, stratum: Column, per: int, key: str, seed: int = 0) -> DataFrame:
    """``per`` rows of each stratum, in hash order of their key: repeatable, and independent of partitioning."""
    w = W.partitionBy("stratum").orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256), key)
    return df.withColumn("stratum", stratum).withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= per)


def row_status(error: Column, degraded: Column) -> Column:
    return F.when(error.isNotNull(), "error").when(degraded, "partial").otherwise("ok")
