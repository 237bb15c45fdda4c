"""From evidence to checked answers: numbering, confidence, template answers, citation checks and repair, guardrail, refinement loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions import lexicons as L
from brindle.functions.text import count_any, has_any, squeeze, strip

from .context import sort_score, with_scores


def confidence_state(c: Column) -> Column:
    return F.when(c.isNull(), "confidence_unavailable").when(c < 0.20, "low_confidence").when(c < 0.50, "uncertain").otherwise("retrieval_confident")


def evidence(candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """Best row for each chunk, ranked by score, original rank, id; ids S1, S2, ...; absolute confidence from rerank, else dense score."""
    df = with_scores(candidates).withColumn("sort_score", F.coalesce(sort_score(), F.lit(0.0)))
    best = df.withColumn("_n", F.row_number().over(W.partitionBy("query_id", "chunk_id").orderBy(F.desc("sort_score"), "rank"))).filter("_n = 1 and chunk_id <> ''").drop("_n")
    out = best.withColumn("_r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sort_score"), F.col("rank"), F.col("chunk_id"))))
    out = out if limit is None else out.filter(F.col("_r") <= limit)
    confidence = F.coalesce("rerank_score", "dense_score")
    kind = F.when(F.col("rerank_score").isNotNull(), "rerank").when(F.col("dense_score").isNotNull(), "dense").otherwise("unavailable")
    return out.drop("rank").withColumns({"rank": F.col("_r"), "citation_id": F.concat(F.lit("S"), F.col("_r").cast("string")), "retrieval_confidence": confidence, "confidence_type": kind, "confidence_state": confidence_state(confidence), "score": F.coalesce(confidence, F.lit(0.0))}).drop("_r")


def key_sentence(content: Column, most: int = 180) -> Column:
    """The first sentence with most policy terms, then the longest up to 220; cut to ``most`` characters."""
    text = squeeze(content)
    parts = F.filter(F.transform(F.split(text, r"(?<=[。！？；;])\s*|\n+"), lambda x: strip(x)), lambda x: x != "")
    rated = F.transform(parts, lambda s: F.struct(count_any(s, L.POLICY_TERMS).alias("a"), F.least(F.length(s), F.lit(220)).alias("b"), s.alias("s")))
    worse = lambda a, x: (x["a"] > a["a"]) | ((x["a"] == a["a"]) & (x["b"] > a["b"]))
    best = F.aggregate(rated, F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.lit("").alias("s")), lambda a, x: F.when(worse(a, x), x).otherwise(a))["s"]
    cut = F.concat(F.regexp_replace(F.substring(best, 1, most - 1), "[，,；;。 ]+$", ""), F.lit("……"))
    return F.when(text == "", L.EMPTY_SNIPPET).when(F.length(best) <= most, best).otherwise(cut)


def compose(queries: DataFrame, found: DataFrame, items: int = 4, low: float = 0.3) -> DataFrame:
    """query_id, answer, used ids: a header, one key sentence with its marker for each item, and the sources."""
    words = lambda ws: F.array(*[F.lit(w) for w in ws])
    labels = F.when(has_any(F.col("query"), L.ASK_SOURCE), words(L.LABELS_SOURCE)).when(has_any(F.col("query"), L.ASK_WHO), words(L.LABELS_WHO)).otherwise(words(L.LABELS))
    row = F.struct("rank", "citation_id", key_sentence(F.col("content")).alias("sentence"), "source_file", F.coalesce("section_path_text", F.lit("")).alias("section"), "score")
    lists = found.filter(F.col("rank") <= items).groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("e"))
    df = queries.select("query_id", "query", labels.alias("labels")).join(lists, "query_id", "left")
    mark = lambda x: F.concat(F.lit("["), x["citation_id"], F.lit("]"))
    body = F.transform("e", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(F.get("labels", i), F.lit(L.LABELS[-1])), F.lit("："), x["sentence"], mark(x)))
    tail = F.transform("e", lambda x: F.concat(mark(x), F.lit(" "), x["source_file"], F.when(x["section"] != "", F.concat(F.lit(" / "), x["section"])).otherwise("")))
    header = F.when(F.forall("e", lambda x: x["score"] < low), L.LOW_HEADER).otherwise(L.HEADER)
    answer = F.array_join(F.concat(F.array(header, F.lit("")), body, F.array(F.lit(""), F.lit(L.SOURCES)), tail), "\n")
    empty = F.col("e").isNull()
    return df.select("query_id", "query", F.when(empty, L.NO_ANSWER).otherwise(answer).alias("answer"), F.when(empty, F.array().cast("array<string>")).otherwise(F.transform("e", lambda x: x["citation_id"])).alias("citation_ids"))


def used_ids(answer: Column) -> Column:
    """Citation ids in order of first use."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(S\d+)\]"), F.lit(1)))


def citation_mapping(df: DataFrame) -> DataFrame:
    """df: answer, known (array of ids). Adds used, mapped and unknown ids and the ratio (1.0 if none is used)."""
    known = F.transform("known", lambda x: F.regexp_replace(x, r"^[\[\] ]+|[\[\] ]+$", ""))
    df = df.withColumn("used_ids", used_ids(F.col("answer")))
    df = df.withColumns({"mapped_ids": F.array_intersect("used_ids", known), "unknown_ids": F.array_except("used_ids", known)})
    return df.withColumns({"all_mapped": F.size("unknown_ids") == 0, "mapping_ratio": F.when(F.size("used_ids") == 0, 1.0).otherwise(F.size("mapped_ids") / F.size("used_ids"))})


def _structural(s: Column) -> Column:
    return s.rlike(L.STRUCTURE) | s.startswith("#") | s.rlike(r"^\*\*[^*]+\*\*[:：]?$")


def uncited_fact(answer: Column) -> Column:
    """Whether a line states a policy fact without any citation."""
    rows = F.transform(F.split(F.coalesce(answer, F.lit("")), "\r\n|\n|\r"), lambda x: strip(x))
    skip = lambda s: (s == "") | s.startswith("[") | s.startswith("来源") | _structural(s)
    return F.exists(rows, lambda s: ~skip(s) & s.rlike(L.POLICY_FACT) & ~s.rlike(r"\[S\d+\]"))


def verify(df: DataFrame) -> DataFrame:
    """df: answer, citation_ids, evidence_ids. Adds used, missing and unused ids, reasons, passed, warning."""
    df = df.withColumn("used_ids", used_ids(F.col("answer")))
    number = lambda x: F.coalesce(F.try_to_number(F.regexp_extract(x, r"^S(\d+)$", 1), F.lit("999999999")).cast("long"), F.lit(10**9))
    unused = F.transform(F.array_sort(F.transform(F.array_except("citation_ids", "used_ids"), lambda x: F.struct(number(x).alias("n"), x.alias("id")))), lambda x: x["id"])
    reasons = F.array_compact(F.array(F.when(F.size("missing_ids") > 0, "missing_citation"), F.when(F.size(F.array_except("citation_ids", "evidence_ids")) > 0, "citation_without_evidence")))
    df = df.withColumn("missing_ids", F.array_except("used_ids", "citation_ids")).withColumns({"unused_ids": unused, "reasons": reasons, "uncited_fact": uncited_fact(F.col("answer"))})
    return df.withColumn("passed", F.size("reasons") == 0)


def repair(df: DataFrame) -> DataFrame:
    """df: answer, items (array of struct citation_id, content). The first uncited fact line whose fact stands word for word in an item gets its id."""
    rows = F.split("answer", "\n")
    start = F.struct(F.lit(False).alias("done"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        s = strip(line)
        fact = F.regexp_extract(s, f"({L.POLICY_FACT})", 1)
        hit = F.get(F.filter("items", lambda e: F.contains(e["content"], fact)), F.lit(0))["citation_id"]
        fix = ~acc["done"] & (fact != "") & ~s.rlike(r"\[S\d+\]") & ~_structural(s) & hit.isNotNull()
        fixed = F.concat(F.regexp_replace(line, r"\s+$", ""), F.lit(" ["), hit, F.lit("]"))
        return F.struct((acc["done"] | F.coalesce(fix, F.lit(False))).alias("done"), F.array_append(acc["out"], F.when(fix, fixed).otherwise(line)).alias("out"))

    return df.withColumn("answer", F.when(uncited_fact(F.col("answer")), F.array_join(F.aggregate(rows, start, step)["out"], "\n")).otherwise(F.col("answer")))


def guardrail(answers: DataFrame, found: DataFrame, least: int = 1, low: float = 0.3) -> DataFrame:
    """answers: query_id, reasons (of the verifier). Counts evidence and its best confidence; a missing confidence passes."""
    best = found.groupBy("query_id").agg(F.count("*").alias("evidence_count"), F.max("retrieval_confidence").alias("max_score"), F.max_by("confidence_type", "retrieval_confidence").alias("confidence_type"))
    df = answers.join(best, "query_id", "left").withColumns({"evidence_count": F.coalesce("evidence_count", F.lit(0)), "confidence_type": F.coalesce("confidence_type", F.lit("unavailable"))})
    own = F.array_compact(F.array(F.when(F.col("evidence_count") < least, "insufficient_evidence"), F.when(F.col("max_score") < low, "low_retrieval_score")))
    df = df.withColumn("guard_reasons", F.array_distinct(F.concat(own, F.coalesce("reasons", F.array().cast("array<string>")))))
    return df.withColumns({"guard_passed": F.size("guard_reasons") == 0, "confidence_state": confidence_state(F.col("max_score"))})


def answer(queries: DataFrame, found: DataFrame, gate: DataFrame | None = None, composer: Callable[[DataFrame, DataFrame], DataFrame] = compose) -> DataFrame:
    """query_id, answer, is_fallback, fallback_reason, decision, citation_ids: gate, compose, verify with one repair, guardrail."""
    said = composer(queries, found)
    items = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "citation_id", "content"))).alias("items"))
    said = said.join(items, "query_id", "left").withColumn("items", F.coalesce("items", F.array().cast("array<struct<rank:int,citation_id:string,content:string>>")))
    said = verify(repair(said).withColumn("evidence_ids", F.transform("items", lambda x: x["citation_id"])))
    done = guardrail(said, found)
    if gate is not None:
        done = done.join(gate.select("query_id", "decision"), "query_id", "left")
    else:
        done = done.withColumn("decision", F.lit("uncertain"))
    out = F.col("decision") == "out_of_domain"
    reason = F.when(out, "out_of_domain").when(~F.col("guard_passed"), F.array_join("guard_reasons", ";"))
    return done.select("query_id", F.when(reason.isNotNull(), L.NO_ANSWER).otherwise(F.col("answer")).alias("answer"), reason.isNotNull().alias("is_fallback"), reason.alias("fallback_reason"), "decision", "citation_ids", "evidence_count", "max_score", "confidence_state")


def refine_loop(rows: DataFrame, propose: Callable[[DataFrame], DataFrame], critique: Callable[[DataFrame], DataFrame], stop: list[str], rounds: int = 3) -> DataFrame:
    """propose and critique add ``answer`` and ``critique`` and see how many rounds are done; rows whose critique holds a stop word are final, others go round again.

    The whole batch advances together: the loop is over rounds, never over rows.
    """
    active, done = rows.withColumn("iteration", F.lit(0)), None
    for i in range(1, rounds + 1):
        active = critique(propose(active)).withColumn("iteration", F.lit(i))
        over = has_any(F.lower("critique"), [s.lower() for s in stop]) if i < rounds else F.lit(True)
        final = active.filter(over)
        done = final if done is None else done.unionByName(final, allowMissingColumns=True)
        active = active.filter(~over)
    return done


def trace(answers: DataFrame, hits: DataFrame, branches: DataFrame, gate: DataFrame) -> DataFrame:
    """query_id and what led to its answer: branches asked and matched (in order of the ranked hits), the hits themselves, the gate, and the decision."""
    row = F.struct("rank", "chunk_id", F.coalesce("rerank_score", "dense_score", "fusion_score").alias("score"), "rerank_score", "dense_score", "fusion_score", "mmr_score", "matched_branches")
    ranked = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("results"))
    asked = branches.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("branch_ord", "branch", "query", "weight"))), lambda b: F.struct(b["branch"].alias("branch"), b["query"].alias("query"), b["weight"].alias("weight"))).alias("branches"))
    out = answers.join(ranked, "query_id", "left").join(asked, "query_id", "left").join(gate.select("query_id", F.col("signals").alias("gate_signals"), F.col("reason").alias("gate_reason")), "query_id", "left")
    matched = F.array_distinct(F.flatten(F.transform("results", lambda r: r["matched_branches"])))
    decision = F.when(F.col("is_fallback"), "fallback").otherwise("answered")
    return out.select("query_id", decision.alias("answer_decision"), "fallback_reason", F.coalesce(F.size("results"), F.lit(0)).alias("result_count"), "evidence_count", F.coalesce(matched, F.array().cast("array<string>")).alias("matched_branches"), "branches", "results", "decision", "gate_signals", "gate_reason")
