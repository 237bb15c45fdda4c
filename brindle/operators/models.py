"""What models plug into: embedding, cross scoring, chat replies. Defaults are deterministic and need no weights."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import lexicons as L
from brindle.functions.text import strip

from .evaluation import judged

Encode = Callable[[list[str]], np.ndarray]


def hash_encoder(width: int = 64) -> Callable[[], Encode]:
    """A stand-in for an embedding model: signed hashed words, so that texts with common words are close."""

    def load() -> Encode:
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), width), np.float32)
            for i, t in enumerate(texts):
                for w in t.lower().split():
                    h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                    out[i, h % width] += 1.0 if h >> 63 else -1.0
            return out

        return encode

    return load


def embed(df: DataFrame, text: str, load: Callable[[], Encode] | None = None, prefix: str = "", out: str = "vector", batch: int = 16) -> DataFrame:
    """Adds unit-length vectors. ``load`` runs once for each worker task; a query's instruction is its ``prefix``."""
    load = load or hash_encoder()

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for part in parts:
            texts = [prefix + (t or "") for t in part]
            rows = [encode(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            whole = np.concatenate(rows) if rows else np.zeros((0, 1), np.float32)
            size = np.linalg.norm(whole, axis=1, keepdims=True)
            yield pd.Series(list((whole / np.where(size == 0, 1, size)).astype(np.float32)))

    return df.withColumn(out, run(F.col(text)))


def cross_scores(pairs: DataFrame, load: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> DataFrame:
    """Adds model_score to rows with query and content; a batch that fails gets null, so that ranking falls back to the old order."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        try:
            score = load()
        except Exception:  # noqa: BLE001  a model that can't be loaded is one that has no opinion
            score = None
        for q, c in parts:
            try:
                yield pd.Series([float(x) for x in score(q.tolist(), c.tolist())] if score else [None] * len(q), dtype="float64")
            except Exception:  # noqa: BLE001
                yield pd.Series([None] * len(q), dtype="float64")

    return pairs.withColumn("model_score", run("query", "content"))


def chat(df: DataFrame, prompt: str, load: Callable[[], Callable[[str], str]], out: str = "reply", retries: int = 0, wait: float = 0.5) -> DataFrame:
    """Adds the reply to a prompt column; a call that fails is tried again up to ``retries`` times; a failing or empty reply is null."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = load()
        for part in parts:
            got = []
            for p in part:
                reply = None
                for i in range(retries + 1):
                    try:
                        reply = ask(p) or None
                        break
                    except Exception:  # noqa: BLE001  what reads the reply has rules to fall back on
                        time.sleep(wait * 2**i if i < retries else 0)
                got.append(reply)
            yield pd.Series(got, dtype="object")

    return df.withColumn(out, run(F.col(prompt)))


def json_reply(reply: Column, schema: str) -> Column:
    """A typed struct from a chat reply: fences are stripped and the outermost braces taken; null if it is no such object."""
    bare = F.regexp_replace(strip(reply), r"(?i)^```(?:json)?\s*|\s*```$", "")
    return F.from_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), schema)


def truthy(c: Column) -> Column:
    """Booleans that were written as words or numbers."""
    return F.lower(strip(c.cast("string"))).isin("true", "yes", "1", "是")


def evidence_prompt(items: Column, chars: int = 1600, most: int = 6) -> Column:
    """items: array of struct(citation_id, source_file, content), cut to ``most`` items of ``chars`` characters."""
    return F.array_join(F.transform(F.slice(items, 1, most), lambda x: F.concat(F.lit("["), x["citation_id"], F.lit("] "), x["source_file"], F.lit("\n"), F.substring(x["content"], 1, chars))), "\n\n")


def compose_by_chat(said: DataFrame, reply: str = "reply", refusal: str = L.NO_ANSWER) -> DataFrame:
    """said: answer (template), citation_ids, reply. Adds composer_mode, answer_decision and used ids.

    A JSON object with decision and answer replaces the template; a refusal, by decision or as the refusal sentence alone, gives that sentence
    without citations; a plain text that cites evidence is an answer; anything else keeps the template.
    """
    r, text = json_reply(F.col(reply), "decision string, answer string, reason string"), strip(F.coalesce(F.col(reply), F.lit("")))
    said_so = r["answer"].isNotNull() & (strip(r["answer"]) != "") & r["decision"].isin("answer", "partial", "refuse")
    refuses = F.coalesce(r["decision"] == "refuse", F.lit(False)) | (text == refusal) | F.coalesce(strip(r["answer"]) == refusal, F.lit(False))
    plain = ~text.startswith("{") & ~text.startswith("```") & text.rlike(r"\[S\d+\]")
    good = F.coalesce(said_so, F.lit(False))
    used = F.array_distinct(F.regexp_extract_all(F.col("answer"), F.lit(r"\[(S\d+)\]"), F.lit(1)))
    out = said.withColumns({
        "composer_mode": F.when(good | refuses | plain, "chat").otherwise("template"), "answer_decision": F.when(refuses, "refuse").when(good, r["decision"]).otherwise("answer"),
        "answer": F.when(refuses, refusal).when(good, r["answer"]).when(plain, text).otherwise(F.col("answer")),
    })
    return out.withColumn("used_citation_ids", used)


def domain_by_chat(said: DataFrame, reply: str = "reply") -> DataFrame:
    """query_id, decision, reason from replies to a coverage prompt; any reply that is no such object is uncertain. For queries.second_gate."""
    r = json_reply(F.col(reply), "decision string, reason string")
    decision = F.when(r["decision"].isin("in_domain", "out_of_domain", "uncertain"), r["decision"]).otherwise("uncertain")
    return said.select("query_id", decision.alias("decision"), F.coalesce(r["reason"], F.lit("")).alias("reason"), F.array(F.lit("llm_coverage_check")).alias("signals"))


def hyde_by_chat(rule: DataFrame, plans: DataFrame, load: Callable[[], Callable[[str], str]], prompt: Column, retries: int = 1, most: int = 220) -> DataFrame:
    """Hypothetical texts of a model, with the rule's where it fails. rule: queries.hyde(plans, "rule"), whose ``used`` says which may have one."""
    asked = chat(plans.join(rule.filter("used").select("query_id"), "query_id").select("query_id", prompt.alias("_prompt")), "_prompt", load, "_reply", retries)
    text = F.substring(strip(F.regexp_replace(F.coalesce("_reply", F.lit("")), r"\s+", " ")), 1, most)
    got = rule.join(asked.select("query_id", text.alias("_text")), "query_id", "left")
    made = F.coalesce(F.col("_text") != "", F.lit(False))
    return got.select("query_id", F.when(made, F.col("_text")).otherwise(F.col("content")).alias("content"), "used", F.when(~F.col("used"), F.col("reason")).when(made, "chat_hyde").otherwise(F.concat(F.lit("chat_failed_fallback_"), "reason")).alias("reason"))


def judge_by_chat(rows: DataFrame, load: Callable[[], Callable[[str], str]], prompt: Column, retries: int = 1) -> DataFrame:
    """rows: query_id, known (array of citation ids). Adds judged, facts and the ratios; a failing judge leaves them null."""
    said = chat(rows.withColumn("_prompt", prompt), "_prompt", load, "_reply", retries)
    r = json_reply(F.col("_reply"), "facts array<struct<fact string, supported string, citation_ids array<string>>>, answer_relevancy double")
    facts = F.transform(r["facts"], lambda x: F.struct(x["fact"].alias("fact"), truthy(x["supported"]).alias("supported"), x["citation_ids"].alias("citation_ids")))
    out = said.withColumn("facts", judge_facts(facts, F.col("known"))).withColumn("judged", F.col("facts").isNotNull()).withColumn("answer_relevancy", r["answer_relevancy"])
    return out.withColumns({n: F.round(c, 4) for n, c in judged(F.col("facts")).items()}).drop("_prompt", "_reply")


def judge_facts(facts: Column, known: Column) -> Column:
    """Judged facts with support revoked where ids are missing or unknown. facts: array of struct(fact, supported, citation_ids)."""
    ids = lambda x: F.coalesce(x["citation_ids"], F.array().cast("array<string>"))
    mapped = lambda x: (F.size(ids(x)) > 0) & (F.size(F.array_except(ids(x), known)) == 0)
    return F.transform(facts, lambda x: F.struct(x["fact"].alias("fact"), (F.coalesce(x["supported"], F.lit(False)) & mapped(x)).alias("supported"), mapped(x).alias("cited")))
