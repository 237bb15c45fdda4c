"""Building evaluation sets: quotas, balanced picks, categories, legacy chunking for baselines."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import keep


def quota(df: DataFrame, group: str, quotas: dict[str, int], order: list[Column]) -> DataFrame:
    """The first rows of each group, as many as its quota says; groups without one give none."""
    limit = F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))])
    n = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return df.withColumn("_n", n).filter(F.col("_n") <= F.coalesce(F.try_element_at(limit, F.col(group)), F.lit(0))).drop("_n")


def balanced(df: DataFrame, groups: tuple[str, str], key: str, total: int) -> DataFrame:
    """``total`` rows, each time the one whose two groups have been taken least: by the sum of both counts, then the first, the second, the key.

    Of each pair of groups only the first ``total`` rows by key can ever be taken, so what one task works on is bounded by the pairs.
    """
    a, b = groups
    first = df.withColumn("_n", F.row_number().over(W.partitionBy(a, b).orderBy(key))).filter(F.col("_n") <= total).drop("_n")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        queues = {pair: iter(rows) for pair, rows in ((p, g.sort_values(key).index.tolist()) for p, g in pdf.groupby([a, b], dropna=False))}
        heads = {p: next(q) for p, q in queues.items()}
        count_a, count_b, taken = {}, {}, []
        while heads and len(taken) < total:
            x, y = pair = min(heads, key=lambda p: (count_a.get(p[0], 0) + count_b.get(p[1], 0), count_a.get(p[0], 0), count_b.get(p[1], 0), pdf.at[heads[p], key]))
            taken.append(heads[pair])
            count_a[x], count_b[y] = count_a.get(x, 0) + 1, count_b.get(y, 0) + 1
            heads[pair] = next(queues[pair], None)
            if heads[pair] is None:
                del heads[pair]
        return pdf.loc[taken]

    return first.groupBy().applyInPandas(run, df.schema)


def enough(df: DataFrame, group: str, quotas: dict[str, int]) -> None:
    """Raises if a group has fewer rows than its quota."""
    have = {r[0]: r[1] for r in df.filter(F.col(group).isin(list(quotas))).groupBy(group).count().collect()}  # one row for each quota
    short = {g: (have.get(g, 0), n) for g, n in quotas.items() if have.get(g, 0) < n}
    if short:
        raise ValueError(f"not enough rows: {short}")


def regression_set(labelled: DataFrame, random: DataFrame, quotas: dict[str, int], controls: int, boundary: DataFrame | None = None) -> DataFrame:
    """query_id, query_type, disaster_type, expected_decision, regression_category, source_dataset: the rows a later run must not lose.

    Questions outside the domain (to fall back), labelled and random ones that fell back wrongly (the random ones by quota of their type), well
    answered ones as controls, balanced over type and subject, and given questions at the domain's border. Results: query_id, query_type,
    disaster_type, status, is_fallback, expected_fallback, faithfulness, answer_relevancy.
    """
    inside = random.filter("query_type <> 'out_of_domain'")
    wrong = inside.filter("is_fallback")
    enough(wrong, "query_type", quotas)
    good = inside.filter("status = 'ok' and not is_fallback and coalesce(faithfulness, 0) >= 0.9 and coalesce(answer_relevancy, 0) >= 0.8")
    parts = [
        (random.filter("query_type = 'out_of_domain'"), "final_random", "fallback", "ood_leak"), (labelled.filter("not expected_fallback and is_fallback"), "final_labeled", "answered", "false_rejection"),
        (quota(wrong, "query_type", quotas, [F.col("query_id")]), "final_random", "answered", "false_rejection"), (balanced(good, ("query_type", "disaster_type"), "query_id", controls), "final_random", "answered", "positive_control"),
    ]
    if boundary is not None:
        parts.append((boundary, "domain_boundary", "answered", "domain_boundary"))
    out = None
    for rows, source, decision, category in parts:
        part = rows.select("query_id", "query_type", "disaster_type", F.lit(decision).alias("expected_decision"), F.lit(category).alias("regression_category"), F.lit(source).alias("source_dataset"))
        out = part if out is None else out.unionByName(part)
    return out


def catalog(df: DataFrame, name: str, order: str) -> DataFrame:
    """Different values with the place of their first appearance; places are dealt over an aggregate, one row a value."""
    firsts = df.filter(F.col(name).isNotNull() & (F.trim(name) != "")).groupBy(name).agg(F.min(order).alias("first"))
    return numbered(firsts, [F.col("first"), F.col(name)], "place")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows numbered from 1 in an order, for results of any size: sorted in ranges, and each range starts behind the rows of those before it."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = keep(ranged, "ranges").withColumn("_part", F.shiftright("_at", 33))  # written, so the ids hold
    sizes = {r[0]: r[1] for r in ranged.groupBy("_part").count().collect()}  # one number a range
    starts, so_far = [(-1, 0)], 0
    for p in sorted(sizes):
        starts.append((p, so_far))
        so_far += sizes[p]
    base = df.sparkSession.createDataFrame(starts, "_part long, _base long")
    return ranged.join(F.broadcast(base), "_part").withColumn(name, (F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("int")).drop("_part", "_base", "_at")


def template_queries(templates: list[str], slots: DataFrame) -> DataFrame:
    """query and the slot columns: every template ({name} for a column) filled with every row, equal ones once, in hash order."""
    filled = []
    for t in templates:
        text = F.lit(t)
        for c in slots.columns:
            text = F.replace(text, F.lit("{" + c + "}"), F.col(c).cast("string"))
        filled.append(text)
    made = slots.select("*", F.explode(F.array(*filled)).alias("query")).dropDuplicates(["query"])
    return numbered(made, [F.md5("query"), F.col("query")], "place")


@F.pandas_udf(T.ArrayType(T.StringType()))
def plain_chunks(texts: pd.Series) -> pd.Series:
    """The baseline's chunks: no markup, no white space, sentences (ends: full-width marks) packed greedily up to 250 characters; a longer sentence stays whole."""

    def cut(text: str | None) -> list[str]:
        bare = re.sub(r"\s+", "", re.sub(r"<[^>]+>|[#*_`>|]", "", text or ""))
        out, now = [], ""
        for s in re.findall(r"[^！？。；]+[！？。；]?|[！？。；]", bare):
            if now and len(now) + len(s) > 250:
                out.append(now)
                now = ""
            now += s
        return [*out, now] if now else out

    return texts.map(cut)


def compare_summaries(a: DataFrame, b: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, a, b, delta for two one-row summaries."""
    long = lambda t, n: t.select(F.lit(1).alias("_one"), *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot("_one", metrics, "metric", n).drop("_one")
    return long(a, "a").join(long(b, "b"), "metric").withColumn("delta", F.round(F.col("b") - F.col("a"), 4))
