"""Query understanding by rules: analysis, routing policy, rewriting into weighted branches, hypothetical text, file filter, domain gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions import lexicons as L
from brindle.functions.text import count_any, first_alias, found, has_any, match_key, meaning_key, normalize_query, squeeze, strip


def classify(q: Column) -> Column:
    level, year, article, number = F.lower(q).rlike(L.LEVEL), q.rlike(L.YEAR), q.rlike(L.ARTICLE), q.rlike(L.NUMBER)
    keyword, scenario, hops = has_any(q, L.KEYWORD), has_any(q, L.SCENARIO), count_any(q, L.MULTI_HOP)
    return (
        F.when(article | (keyword & (level | year | number)), "keyword")
        .when(level | year | (number & has_any(q, L.QUANTITY)), "exact_fact")
        .when(scenario & (hops >= 2), "multi_hop").when(scenario, "scenario").when(hops >= 2, "multi_hop")
        .when(F.length(q) <= 8, "ambiguous").when(keyword, "keyword").otherwise("scenario")
    )


def extracted_terms(q: Column, hints: list[Column]) -> Column:
    """Hints, then levels, articles and years as written, then known terms; each once, in that order."""
    matches = [F.transform(F.regexp_extract_all(q, F.lit(p), F.lit(0)), lambda x: strip(x)) for p in (L.LEVEL, L.ARTICLE, L.YEAR)]
    return F.array_distinct(F.filter(F.concat(F.array_compact(F.array(*hints)), *matches, found(q, L.TERMS)), lambda x: x != ""))


def analyze(queries: DataFrame, max_chars: int = 300) -> DataFrame:
    """query_id, query -> normalized_query, hints, extracted_terms, query_type, rewrite_confidence, policy columns, reason."""
    df = queries.select("query_id", strip(F.coalesce("query", F.lit(""))).alias("query"))
    q = F.col("normalized_query")
    year = F.regexp_extract(q, L.YEAR, 0)
    df = df.withColumn("normalized_query", F.substring(normalize_query(F.col("query")), 1, max_chars))
    df = df.withColumns({"region_hint": first_alias(q, L.REGIONS), "hazard_hint": first_alias(q, L.HAZARDS), "document_type_hint": first_alias(q, [(w, w) for w in L.DOCUMENT_KINDS]), "time_hint": F.when(year != "", strip(year))})
    df = df.withColumn("extracted_terms", F.when(q == "", F.array().cast("array<string>")).otherwise(extracted_terms(q, [F.col(c) for c in ("region_hint", "hazard_hint", "document_type_hint", "time_hint")])))
    df = df.withColumn("query_type", F.when(q == "", "ambiguous").otherwise(classify(q)))
    base = reduce(lambda c, kv: c.when(F.col("query_type") == kv[0], F.lit(kv[1])), L.CONFIDENCE.items(), F.when(F.lit(False), F.lit(0.0)))
    value = base + F.least(F.lit(0.08), F.lit(0.02) * F.size("extracted_terms")) - F.when(F.length(q) <= 6, 0.1).otherwise(0.0)
    df = df.withColumn("rewrite_confidence", F.when(q == "", 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.98), value)), 2)))
    names = ("use_rewrite", "use_multi_query", "use_reranker", "use_mmr", "dense_top_k", "sparse_top_k", "rerank_top_k", "max_branches")
    for i, name in enumerate(names):
        value = reduce(lambda c, kv, i=i: c.when(F.col("query_type") == kv[0], F.lit(kv[1][i])), L.POLICY.items(), F.when(F.lit(False), F.lit(L.POLICY["scenario"][i])))
        if name in ("use_rewrite", "use_multi_query"):
            value = value & ((F.col("query_type") != "ambiguous") | (F.col("rewrite_confidence") >= 0.4))
        df = df.withColumn(name, (value & (q != "")) if i < 4 else value)
    return df


def expanded_query(df: DataFrame) -> Column:
    """The normalised query and what its hints, subjects, intents and type add; each once, whatever its case."""
    q = F.col("normalized_query")
    none = F.array().cast("array<string>")
    words = lambda ws: F.array(*[F.lit(w) for w in ws])
    by_hint = lambda c, table: reduce(lambda a, kv: a.when(F.col(c) == kv[0], words(kv[1])), table.items(), F.when(F.col(c).isNull(), none)).otherwise(F.array(F.col(c)))
    inside = lambda table: [F.when(F.contains(q, F.lit(k)), words(v)).otherwise(none) for k, v in table.items()]
    tail = reduce(lambda a, kv: a.when(F.col("query_type") == kv[0], words(kv[1])), L.TYPE_MORE.items(), F.when(F.lit(False), none)).otherwise(none)
    tokens = F.filter(F.transform(F.concat(F.array(q), by_hint("region_hint", L.REGION_MORE), by_hint("hazard_hint", L.HAZARD_MORE), *inside(L.SUBJECT_MORE), *inside(L.INTENT_MORE), tail), lambda x: squeeze(x)), lambda x: x != "")
    once = F.aggregate(tokens, none, lambda a, x: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.array_append(a, x)))
    return squeeze(F.array_join(once, " "))


def branches(plans: DataFrame, max_chars: int = 220, limit: int | None = None) -> DataFrame:
    """query_id, branch, branch_ord, query, weight: raw always first, then normalised and expanded where they add something."""
    exact = F.col("query_type").isin("keyword", "exact_fact")
    want_normal = (F.col("normalized_query") != "") & (meaning_key("normalized_query") != meaning_key("query"))
    want_more = ~exact & (F.col("use_rewrite") | F.col("use_multi_query")) & (F.col("query") != "")
    cut = lambda c: F.substring(squeeze(c), 1, max_chars)
    row = lambda i, name, text: F.struct(F.lit(i).alias("branch_ord"), F.lit(name).alias("branch"), text.alias("query"), F.lit(L.WEIGHTS[name]).alias("weight"))
    rows = F.array(row(0, "raw", cut(F.col("query"))), row(1, "normalized", F.when(want_normal, cut(F.col("normalized_query")))), row(2, "expanded", F.when(want_more, cut(expanded_query(plans)))))
    rows = F.filter(rows, lambda r: r["query"].isNotNull() & (r["query"] != ""))
    once = F.filter(rows, lambda r: ~F.exists(rows, lambda o: (o["branch_ord"] < r["branch_ord"]) & (F.lower(squeeze(o["query"])) == F.lower(squeeze(r["query"])))))
    most = F.lit(limit) if limit else F.col("max_branches")
    return plans.select("query_id", F.explode(F.slice(once, F.lit(1), F.greatest(F.lit(1), most))).alias("b")).select("query_id", "b.*")


def hyde(plans: DataFrame, mode: str = "rule", content: str = "") -> DataFrame:
    """Hypothetical text for open queries: query_id, content, used, reason. Only a search branch, never evidence."""
    allowed = F.col("query_type").isin("scenario", "ambiguous") & F.col("time_hint").isNull() & ~has_any(F.col("normalized_query"), L.EXACT_MARKERS)
    hazard = F.coalesce("hazard_hint", F.lit(L.HYDE_HAZARD))
    region = F.coalesce(F.concat("region_hint", F.lit(L.HYDE_AREA)), F.lit(L.HYDE_REGION))
    terms = F.when(F.size("extracted_terms") > 0, F.array_join(F.slice("extracted_terms", 1, 4), "、")).otherwise(L.HYDE_TERMS)
    a, b, c = (F.lit(x) for x in L.HYDE_SHORT)
    short = F.concat(region, a, hazard, b, terms, c)
    a, b, c = (F.lit(x) for x in L.HYDE_LONG)
    long = F.concat(a, hazard, b, terms, c)
    text = {"rule": F.when(F.col("query_type") == "ambiguous", short).otherwise(long), "fake": F.lit(content), "disabled": F.lit("")}[mode]
    use = allowed if mode != "disabled" else F.lit(False)
    reason = F.lit("disabled") if mode == "disabled" else F.when(allowed, "rule_based_hyde" if mode == "rule" else f"{mode}_hyde").otherwise(F.concat(F.lit("query_type_"), F.col("query_type"), F.lit("_not_allowed")))
    return plans.select("query_id", F.when(use, F.substring(squeeze(text), 1, 220)).otherwise("").alias("content"), use.alias("used"), reason.alias("reason"))


def detect_file(queries: DataFrame, files: DataFrame, gram: int = 8) -> DataFrame:
    """query_id, source_file: the longest file name (or stem) that the query equals or contains; ties to the smaller name.

    A query gives one row for each of its places and each length of a name's start (its first ``gram`` characters, or all of a shorter one).
    Only where a start meets one are whole keys cut out of the query, in the lengths that names with this start have, and looked up; so a
    long query costs little beside its length, and names with a common opening never meet it one by one.
    """
    keyed = files.select("source_file").filter("trim(source_file) <> ''").distinct().select("source_file", F.explode(F.array_distinct(F.array(match_key("source_file"), match_key(F.regexp_replace("source_file", r"\.[^.]*$", ""))))).alias("key")).filter("key <> ''").withColumn("start", F.substring("key", 1, gram))
    starts = keyed.groupBy("start").agg(F.collect_set(F.length("key")).alias("sizes"))
    lengths = keyed.agg(F.array_sort(F.collect_set(F.length("start"))).alias("lengths"))  # one row of at most ``gram`` lengths
    q = queries.select("query_id", match_key("query").alias("q")).filter("q <> ''").join(F.broadcast(lengths))
    place = lambda n: F.when(F.length("q") >= n, F.transform(F.sequence(F.lit(1), F.length("q") - n + 1), lambda i: F.struct(i.alias("at"), F.substring(F.col("q"), i, n).alias("start")))).otherwise(F.array().cast("array<struct<at:int,start:string>>"))
    met = q.select("query_id", "q", F.explode(F.flatten(F.transform("lengths", place))).alias("p")).select("query_id", "q", "p.at", "p.start").join(starts, "start")
    keys = met.select("query_id", F.explode(F.transform("sizes", lambda n: F.substring(F.col("q"), F.col("at"), n))).alias("key")).distinct()
    hits = keys.join(keyed.drop("start"), "key")
    best = W.partitionBy("query_id").orderBy(F.desc(F.length("source_file")), "source_file")
    return hits.withColumn("n", F.row_number().over(best)).filter("n = 1").select("query_id", "source_file")


def filter_plan(queries: DataFrame, files: DataFrame) -> DataFrame:
    """query_id, source_file, hints, active (the filters a search applies): the file is applied, hints are reserved."""
    plan = filter_hints(queries).join(detect_file(queries, files), "query_id", "left")
    return plan.withColumn("active", F.when(F.col("source_file").isNotNull(), F.create_map(F.lit("source_file"), F.col("source_file"))).otherwise(F.create_map().cast("map<string,string>")))


def filter_hints(queries: DataFrame) -> DataFrame:
    same = lambda ws: [(w, w) for w in ws]
    return queries.select("query_id", first_alias(F.col("query"), same(L.FILTER_REGIONS)).alias("region_hint"), first_alias(F.col("query"), same(L.FILTER_HAZARDS)).alias("hazard_hint"), first_alias(F.col("query"), same(L.FILTER_KINDS)).alias("document_type_hint"))


def domain_gate(queries: DataFrame, confidence: Column | None = None, inside: list[str] | None = None, outside: list[str] | None = None, patterns: list[str] | None = None, sure: float = 0.5) -> DataFrame:
    """query_id, decision, signals, reason: a sign of the domain beats a sign against it; without either it is uncertain."""
    q = strip(F.coalesce("query", F.lit("")))
    hits = [F.regexp_extract_all(q, F.lit(p), F.lit(0)) for p in (L.DOMAIN_PATTERNS if patterns is None else patterns)]
    yes = F.array_distinct(F.concat(found(q, L.DOMAIN if inside is None else inside, fold=True), *hits))
    no = F.array_distinct(found(q, L.OUTSIDE if outside is None else outside, fold=True))
    high = F.lit(False) if confidence is None else F.coalesce(confidence >= sure, F.lit(False))
    said = queries.withColumns({"_yes": yes, "_no": no, "_high": high})
    decision = F.when(F.size("_yes") > 0, "in_domain").when(F.size("_no") > 0, "out_of_domain").otherwise("uncertain")
    signals = F.when(F.size("_yes") > 0, F.transform("_yes", lambda x: F.concat(F.lit("domain_term:"), x))).when(F.size("_no") > 0, F.transform("_no", lambda x: F.concat(F.lit("out_of_domain_term:"), x))).otherwise(F.array(F.lit("no_explicit_domain_signal")))
    reason = F.when(F.size("_yes") > 0, "transparent_domain_signal").when(F.size("_no") > 0, "transparent_out_of_domain_signal").when(F.col("_high"), "high_score_without_domain_signal").otherwise("ambiguous_domain_coverage")
    return said.select("query_id", decision.alias("decision"), signals.alias("signals"), reason.alias("reason"))


def second_gate(gate: DataFrame, other: DataFrame) -> DataFrame:
    """The rules' decision, and where it is uncertain that of another gate (query_id, decision); one that has no opinion changes nothing."""
    said = other.select("query_id", F.col("decision").alias("_other")).filter(F.col("_other").isin("in_domain", "out_of_domain"))
    use = (F.col("decision") == "uncertain") & F.col("_other").isNotNull()
    return gate.join(said, "query_id", "left").withColumns({"reason": F.when(use, "classifier_decision").otherwise(F.col("reason")), "decision": F.when(use, F.col("_other")).otherwise(F.col("decision"))}).drop("_other")


def coarse_category(text: Column, rules: list[tuple[str, list[str]]], default: str = "other") -> Column:
    """The first rule with a word in the text."""
    return reduce(lambda c, r: c.when(has_any(text, r[1]), r[0]), rules, F.when(F.lit(False), default)).otherwise(default)
