"""Context packing: neighbours and section mates join the candidates, adjacent chunks merge, a token budget is filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions.text import strip

from .store import keep, small

SCORES = ("fusion_score", "rerank_score", "mmr_score", "dense_score")


def sort_score() -> Column:
    return F.coalesce("mmr_score", "rerank_score", "fusion_score")


def with_scores(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast("double") for c in SCORES if c not in df.columns})


def expand(candidates: DataFrame, chunks: DataFrame, extra: int = 1, near: float = 0.97, section: float = 0.94) -> DataFrame:
    """Candidates, their neighbours by index in the same section and the first ``extra`` other chunks of the section, each with its best scores.

    Offsets are exploded first, so neighbours come by an equality join. Scores decay; missing ones stay missing. Candidates are few beside the
    chunks: they travel, the chunks stay where they are read, and places are counted in the candidates' sections alone.
    """
    place = chunks.select("chunk_id", "source_file", "chunk_index", "section_path_text")
    some = keep(with_scores(candidates).select("query_id", "chunk_id", *SCORES), "candidates")  # a query's depth of rows, read again below
    own = keep(small(some).join(place, "chunk_id"), "placed")
    scaled = lambda f: [(F.col(c) * f).alias(c) for c in SCORES]
    # The sections of candidates, in one pass over the chunks; a chunk stands there once.
    near_by = keep(place.join(small(own.select("source_file", "section_path_text").distinct()), ["source_file", "section_path_text"], "left_semi"), "sections")
    shift = own.select("query_id", "source_file", "section_path_text", *SCORES, F.explode(F.array(F.col("chunk_index") - 1, F.col("chunk_index") + 1)).alias("chunk_index"))
    beside = shift.join(near_by, ["source_file", "chunk_index", "section_path_text"]).select("query_id", "chunk_id", *scaled(near))
    rows = own.select("query_id", "chunk_id", *SCORES).unionByName(beside)
    if extra > 0:
        # The first extra + 1 chunks of a section are all that any of its chunks can need.
        first = near_by.withColumn("n", F.row_number().over(W.partitionBy("source_file", "section_path_text").orderBy("chunk_index"))).filter(F.col("n") <= extra + 1)
        mates = own.alias("o").join(first.alias("f"), ["source_file", "section_path_text"]).filter("o.chunk_id <> f.chunk_id")
        mates = mates.withColumn("m", F.row_number().over(W.partitionBy("query_id", "o.chunk_id").orderBy("f.n"))).filter(F.col("m") <= extra)
        rows = rows.unionByName(mates.select("query_id", F.col("f.chunk_id").alias("chunk_id"), *scaled(section)))
    rows = rows.withColumn("sort_score", sort_score())
    return rows.groupBy("query_id", "chunk_id").agg(*[F.max(c).alias(c) for c in (*SCORES, "sort_score")])


def merge_adjacent(expanded: DataFrame, chunks: DataFrame) -> DataFrame:
    """Runs of consecutive chunks of a section become one row: ids, indexes, joined content, summed tokens, best scores."""
    few = small(keep(expanded, "expanded"))
    df = few.join(chunks.select("chunk_id", "source_file", "chunk_index", "section_path_text", "content", "token_count"), "chunk_id")
    by = ("query_id", "source_file", "section_path_text")
    df = df.withColumn("island", F.col("chunk_index") - F.row_number().over(W.partitionBy(*by).orderBy("chunk_index")))
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "content")))
    out = df.groupBy(*by, "island").agg(parts.alias("p"), F.sum("token_count").alias("token_count"), *[F.max(c).alias(c) for c in (*SCORES, "sort_score")])
    pick = lambda name: F.transform("p", lambda x: x[name])
    return out.select("query_id", "source_file", "section_path_text", pick("chunk_id").alias("chunk_ids"), pick("chunk_index").alias("chunk_indexes"), strip(F.array_join(pick("content"), "\n")).alias("content"), "token_count", *SCORES, "sort_score")


def fill_budget(merged: DataFrame, budget: int = 1200, least: int = 1) -> DataFrame:
    """In order of score, file, first index: an item that would overflow is skipped and smaller ones are still tried. Citation ids by pick order.

    The fold runs over ids and sizes of one query's candidates (bounded by its depths); contents join afterwards.
    """
    if budget <= 0:
        raise ValueError("budget must be positive")
    key = F.struct((-F.col("sort_score")).alias("a"), F.col("source_file").alias("b"), F.col("chunk_indexes")[0].alias("c"), F.col("token_count").cast("long").alias("n"), F.col("chunk_ids")[0].alias("id"))
    lists = merged.groupBy("query_id").agg(F.array_sort(F.collect_list(key)).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("ids"))
    step = lambda acc, x: F.when((acc["used"] < budget) & (acc["used"] + x["n"] <= budget), F.struct((acc["used"] + x["n"]).alias("used"), F.array_append(acc["ids"], x["id"]).alias("ids"))).otherwise(acc)
    done = lists.select("query_id", F.aggregate("items", start, step).alias("r"))
    picked = done.select("query_id", F.col("r.used").alias("total_tokens"), (F.size("r.ids") < least).alias("insufficient"), F.posexplode("r.ids").alias("pos", "_first"))
    out = picked.join(merged.withColumn("_first", F.col("chunk_ids")[0]), ["query_id", "_first"])
    return out.select("query_id", F.concat(F.lit("S"), (F.col("pos") + 1).cast("string")).alias("citation_id"), (F.col("pos") + 1).alias("pack_order"), "source_file", "section_path_text", "chunk_ids", "chunk_indexes", "content", "token_count", *SCORES, "sort_score", "total_tokens", "insufficient")


def pack(candidates: DataFrame, chunks: DataFrame, budget: int = 1200, extra: int = 1, least: int = 1) -> DataFrame:
    merged = keep(merge_adjacent(expand(candidates, chunks, extra), chunks), "merged")  # read for its sizes and then for what is picked
    return fill_budget(merged, budget, least)


def explode(packed: DataFrame) -> DataFrame:
    """query_id, rank, chunk_id: the chunks of packed items, each with the rank of its item."""
    return packed.select("query_id", F.col("pack_order").alias("rank"), F.explode("chunk_ids").alias("chunk_id"))
