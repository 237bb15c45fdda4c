"""python -m brindle build|search|answer|scan|sync|evaluate: small command-line front ends over Markdown folders."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import chunking, evaluation, models, pipeline, runs, sparse, store, sync
from brindle.sources import files


def build(spark: SparkSession, folder: str, out: str) -> None:
    chunks = chunking.chunk_files(files.markdown(spark, folder, recursive=True))
    chunks.write.mode("overwrite").parquet(f"{out}/chunks")
    chunks = spark.read.parquet(f"{out}/chunks")
    models.embed(chunks.select("chunk_id", "embedding_text"), "embedding_text").select("chunk_id", "vector").write.mode("overwrite").parquet(f"{out}/vectors")
    sparse.Index.build(chunks, f"{out}/bm25")
    chunking.quality_report(chunks).show(truncate=False)


REGISTRY = "source_file string, content_hash string, status string, chunk_count int, updated_at timestamp"
MAPPING = "chunk_id string, source_file string, chunk_index int, content_hash string"


def synchronise(spark: SparkSession, folder: str, out: str, only: list[str], scan_only: bool) -> DataFrame:
    """Brings registry, chunks and vectors at ``out`` up to the folder's files; each run writes a new snapshot folder and then its number."""
    last = spark.read.json(f"{out}/snapshots").agg(F.max("n")).first()[0] if runs.exists(spark, f"{out}/snapshots") else None
    kept = lambda name, schema: spark.createDataFrame([], schema) if last is None else spark.read.parquet(f"{out}/{last}/{name}")
    seen, registry, mappings = files.snapshot(spark, folder), kept("registry", REGISTRY), kept("mappings", MAPPING)
    if only:  # other files stay as they are
        seen, registry_rest = seen.filter(F.col("source_file").isin(only)), registry.filter(~F.col("source_file").isin(only))
        mappings_rest = mappings.filter(~F.col("source_file").isin(only))
        registry, mappings = registry.filter(F.col("source_file").isin(only)), mappings.filter(F.col("source_file").isin(only))
    got = sync.sync(seen, registry, mappings, chunking.chunk_files, "now", scan_only)
    changes = store.keep(got["changes"], "changes")
    if scan_only:
        return changes
    n = (last or 0) + 1
    fresh = store.keep(got["chunks"], "chunks")
    vectors = models.embed(fresh.select("chunk_id", "embedding_text"), "embedding_text").select("chunk_id", "vector")
    tables = {"registry": got["registry"], "mappings": got["mappings"], "chunks": fresh, "vectors": vectors}
    if only:
        tables["registry"], tables["mappings"] = tables["registry"].unionByName(registry_rest), tables["mappings"].unionByName(mappings_rest)
    if last is not None:  # chunks and vectors of files that did not change
        live = tables["mappings"].join(fresh.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id")
        for name in ("chunks", "vectors"):
            tables[name] = tables[name].unionByName(spark.read.parquet(f"{out}/{last}/{name}").join(live, "chunk_id", "left_semi"))
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{n}/{name}")
    spark.createDataFrame([(n,)], "n long").write.mode("append").json(f"{out}/snapshots")
    return changes


def evaluate(spark: SparkSession, path: str, questions: str, top_k: int) -> str:
    """Recall, mrr and ndcg of a built index over JSON lines with query_id, query and relevant (chunk ids), as a Markdown table."""
    chunks, vectors = spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/vectors")
    asked = files.json_lines(spark, questions, "query_id string, query string, relevant array<string>")
    hits = pipeline.search(asked, chunks, vectors, pipeline.Options(top_k=top_k), index=sparse.Index.load(spark, f"{path}/bm25"))
    rows = evaluation.per_query(asked.join(evaluation.ranked_lists(hits), "query_id", "left").withColumn("ranked", F.coalesce("ranked", F.array().cast("array<string>"))))
    return runs.markdown_table(evaluation.mean_summary(rows, [c for c in rows.columns if c != "query_id"]), "Retrieval")


def main(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="brindle")
    p.add_argument("command", choices=["build", "search", "answer", "scan", "sync", "evaluate"])
    p.add_argument("path", help="folder of Markdown files (build, scan, sync) or of a built index")
    p.add_argument("--out", default="brindle-index", help="folder of the index (build) or of the snapshots (scan, sync)")
    p.add_argument("--query", action="append", default=[])
    p.add_argument("--questions", help="JSON lines for evaluate")
    p.add_argument("--file", action="append", default=[], help="scan or sync these files alone")
    p.add_argument("--rebuild-all", action="store_true", help="refused: remove the folder and sync again")
    p.add_argument("--top-k", type=int, default=5)
    a = p.parse_args(argv)
    if a.rebuild_all:
        p.error("--rebuild-all is refused: remove the folder of the snapshots and sync again")
    spark = SparkSession.builder.appName("brindle").getOrCreate()
    if a.command == "build":
        build(spark, a.path, a.out)
        return 0
    if a.command in ("scan", "sync"):
        changes = synchronise(spark, a.path, a.out, a.file, a.command == "scan")
        print(runs.markdown_table(changes.groupBy("change_type").agg(F.count("*").alias("files")).orderBy("change_type"), "Changes"))
        return 0
    if a.command == "evaluate":
        print(evaluate(spark, a.path, a.questions, a.top_k))
        return 0
    chunks, vectors = spark.read.parquet(f"{a.path}/chunks"), spark.read.parquet(f"{a.path}/vectors")
    asked = spark.createDataFrame(list(enumerate(a.query)), "query_id long, query string")
    got = pipeline.ask(asked, chunks, vectors, pipeline.Options(top_k=a.top_k), index=sparse.Index.load(spark, f"{a.path}/bm25"))
    if a.command == "search":
        shown = got["hits"].join(chunks.select("chunk_id", F.substring("content", 1, 80).alias("preview")), "chunk_id").orderBy("query_id", "rank").select("query_id", "rank", "chunk_id", "fusion_score", "preview")
    else:
        shown = got["answers"].orderBy("query_id").select("query_id", "answer", "fallback_reason")
    print(runs.markdown_table(shown, limit=len(a.query) * max(1, a.top_k)))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
