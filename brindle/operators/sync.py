"""Change detection and the document registry, as keyed snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def change_set(snapshot: DataFrame, registry: DataFrame, only: list[str] | None = None) -> DataFrame:
    """source_file, content_hash, change_type: added, modified, unchanged or deleted, by one full outer join on the file name.

    Only active registry rows count, so a deleted file that comes back is added. only: changes of these files alone, cut before the join.
    """
    if only is not None:
        snapshot, registry = (t.filter(F.col("source_file").isin(only)) for t in (snapshot, registry))
    old = registry.filter("status = 'active'").select("source_file", F.col("content_hash").alias("old_hash"))
    both = snapshot.select("source_file", F.col("content_hash").alias("new_hash")).join(old, "source_file", "full_outer")
    kind = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "modified").otherwise("unchanged")
    return both.select("source_file", F.coalesce("new_hash", "old_hash").alias("content_hash"), kind.alias("change_type"))


def upsert_documents(registry: DataFrame, rows: DataFrame) -> DataFrame:
    """rows replace registry rows of the same file; of several the last by updated_at wins."""
    last = rows.withColumn("_n", F.row_number().over(W.partitionBy("source_file").orderBy(F.desc("updated_at"), "content_hash"))).filter("_n = 1").drop("_n")
    return registry.join(last.select("source_file"), "source_file", "left_anti").unionByName(last.select(*registry.columns))


def soft_delete(registry: DataFrame, mappings: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registry rows are marked deleted with no chunks; their mappings are removed."""
    marked = registry.join(gone.select("source_file", F.lit(True).alias("_gone")), "source_file", "left")
    hit = F.col("_gone").isNotNull()
    marked = marked.withColumns({"status": F.when(hit, "deleted").otherwise(F.col("status")), "chunk_count": F.when(hit, 0).otherwise(F.col("chunk_count"))}).drop("_gone")
    return marked.select(*registry.columns), mappings.join(gone.select("source_file"), "source_file", "left_anti")


def replace_mappings(mappings: DataFrame, new: DataFrame) -> DataFrame:
    """All mappings of the files in new are replaced."""
    return mappings.join(new.select("source_file").distinct(), "source_file", "left_anti").unionByName(new.select(*mappings.columns))


def listing(registry: DataFrame, include_deleted: bool = False) -> DataFrame:
    return registry if include_deleted else registry.filter("status = 'active'")


def sync(snapshot: DataFrame, registry: DataFrame, mappings: DataFrame, make_chunks: Callable[[DataFrame], DataFrame], now: str, scan_only: bool = False) -> dict[str, DataFrame]:
    """One plan for a whole batch of changed files. snapshot: source_file, content_hash, text. scan_only returns the change set alone."""
    changes = change_set(snapshot, registry)
    if scan_only:
        return {"changes": changes}
    todo = changes.filter("change_type in ('added', 'modified')").select("source_file")
    chunks = make_chunks(snapshot.join(todo, "source_file", "left_semi"))
    counts = chunks.groupBy("source_file").agg(F.count("*").cast("int").alias("chunk_count"))
    rows = snapshot.join(todo, "source_file", "left_semi").join(counts, "source_file", "left").select("source_file", "content_hash", F.lit("active").alias("status"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.lit(now).cast("timestamp").alias("updated_at"))
    gone = changes.filter("change_type = 'deleted'").select("source_file")
    new_registry, new_mappings = soft_delete(upsert_documents(registry, rows), mappings, gone)
    of_files = chunks.select("chunk_id", "source_file", "chunk_index", "content_hash")
    kept = new_mappings.join(todo, "source_file", "left_anti")
    return {"changes": changes, "registry": new_registry, "mappings": kept.unionByName(of_files.select(*mappings.columns)), "chunks": chunks}


def not_done(queries: DataFrame, results: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Queries that a resumed run still has to do; a failed one counts as done unless it is to be retried."""
    done = results.filter("status <> 'error'") if retry_failed else results
    return queries.join(done.select("query_id").distinct(), "query_id", "left_anti")
