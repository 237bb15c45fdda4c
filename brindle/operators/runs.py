"""Evaluation runs that can be resumed, vector imports, and reports over small summaries."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import delete
from .sync import not_done


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def resumable(queries: DataFrame, path: str, config: dict, evaluate: Callable[[DataFrame], DataFrame], retry_failed: bool = False) -> DataFrame:
    """Results for all queries at ``path``, of which only those missing are evaluated; results of another configuration are refused.

    evaluate: queries -> rows with query_id and status. Each call commits one batch folder, so a run that stops loses its batch alone.
    """
    spark, mark = queries.sparkSession, config_hash(config)
    todo, batch = queries, 0
    if exists(spark, path):
        done = spark.read.parquet(path)
        other = done.filter(F.col("config_hash") != mark).limit(1).count()
        if other:
            raise ValueError("results at this path belong to another configuration")
        todo = not_done(queries, latest(done), retry_failed)
        batch = done.agg(F.max("batch")).first()[0] + 1
    evaluate(todo).withColumn("config_hash", F.lit(mark)).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return latest(spark.read.parquet(path))


def latest(results: DataFrame, key: str = "query_id") -> DataFrame:
    """The rows of the last batch that holds their key."""
    last = results.groupBy(key).agg(F.max("batch").alias("batch"))
    return results.join(last, [key, "batch"], "left_semi")


def import_vectors(points: DataFrame, path: str, width: int, recreate: bool = False, limit: int = 0) -> int:
    """Writes chunk_id, vector and payload as a batch of its own; refuses other widths. limit > 0 takes the first rows by id. Returns the number of points there.

    Of a chunk_id that several batches hold the last counts, so an import that is repeated adds no points.
    """
    spark = points.sparkSession
    bad = points.filter(F.col("vector").isNull() | (F.size("vector") != width)).limit(1).count()
    if bad:
        raise ValueError(f"vectors must have width {width}")
    rows = points.orderBy("chunk_id").limit(limit) if limit > 0 else points
    batch = 0
    if recreate and exists(spark, path):
        delete(spark, path)
    elif exists(spark, path):
        batch = spark.read.parquet(path).agg(F.max("batch")).first()[0] + 1
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return spark.read.parquet(path).select("chunk_id").distinct().count()


def load_vectors(spark: SparkSession, path: str, chunks: DataFrame | None = None) -> DataFrame:
    """Saved vectors; with chunks, every chunk must have one and no other may be there."""
    vectors = latest(spark.read.parquet(path), "chunk_id").drop("batch")
    if chunks is not None:
        odd = vectors.select("chunk_id").join(chunks.select("chunk_id", F.lit(1).alias("_c")), "chunk_id", "full_outer").groupBy().agg(F.count("*").alias("n"), F.count("_c").alias("c")).first()
        if odd.n != odd.c or odd.n != vectors.count():
            raise ValueError("vectors and chunks do not match")
    return vectors


def few(df: DataFrame, limit: int) -> list:
    """All rows of a frame that has no more than ``limit``; raises for a larger one, so that no report leaves rows out."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    return rows


def markdown_table(summary: DataFrame, title: str = "", limit: int = 200) -> str:
    """A small frame (an aggregate) as a Markdown table."""
    said = lambda v: "" if v is None else f"{v:.4f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v).replace("|", "\\|")
    rows = [summary.columns, ["---"] * len(summary.columns)] + [[said(v) for v in r] for r in few(summary, limit)]
    table = "\n".join("| " + " | ".join(r) + " |" for r in rows)
    return f"## {title}\n\n{table}\n" if title else table + "\n"


def review_sheet(sample: DataFrame, columns: list[str], limit: int = 500) -> str:
    """A sample for human review: one section for each row, with room for a verdict."""
    parts = []
    for i, r in enumerate(few(sample.select(*columns), limit), 1):
        parts.append(f"### {i}\n\n" + "\n".join(f"- **{c}**: {r[c]}" for c in columns) + "\n- verdict: \n")
    return "\n".join(parts)
