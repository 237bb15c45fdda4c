"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its result is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import Work, crc32_mod, read
from brindle.llm.exact_dedup import exact_dedup
from brindle.llm.packing import pack_sequences
from brindle.llm.pii import redact_texts
from brindle.llm.quality import fit_quality, keep_good
from brindle.llm.simhash import similar_groups


def _keep(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is among ids (null matches null)."""
    ids = ids.select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_kept_id"]), "left_semi")


def _one_of_each(docs: DataFrame, chosen: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of docs that ``chosen`` names by doc_id. Where ids repeat or are missing it sees numbers of rows in their place, in order of
    doc_id (missing ones last) and then of the other columns."""
    if len(set(docs.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first())) == 1:
        return _keep(docs, chosen(docs))
    order = [F.asc_nulls_last("doc_id"), *[F.asc(c) for c in docs.columns if c != "doc_id"]]
    own = docs.sort(*order).withColumns({"_own_id": F.col("doc_id"), "doc_id": F.monotonically_increasing_id()})
    own = Work(docs.sparkSession, "rows").keep(own, "rows")  # written, so the numbers hold
    return _keep(own, chosen(own)).select(*[F.col("_own_id").alias(c) if c == "doc_id" else c for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = fit_quality(docs, read(spark, sf_dir, "labels"), allowed=crc32_mod("doc_id", 4) != 2)
    return keep_good(docs, model, least=0.7)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) one row stays, that of the smallest doc_id; a row without an id stays only where none has one."""
    return _one_of_each(docs, lambda t: exact_dedup(t).filter("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that are similar by their five-word shingles (0.8 or more) one row stays, that of the smallest doc_id; a row without an id stays only where none has one."""
    return _one_of_each(docs, lambda t: similar_groups(t).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind in brackets."""
    return redact_texts(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_sequences(docs, capacity=4096, name="word_bpe_49k.json", end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("pii", private), ("packing", packing)]

#: No SQL can express the classifier; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = read(spark, sf_dir, "documents"), Work(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = work.keep(stage(spark, docs, sf_dir), name)
        if k:
            work.drop(STAGES[k - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
