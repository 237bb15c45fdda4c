"""Incremental ingestion as a file stream: each micro-batch is one sync, and repeating a batch changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.chunking import chunk_files
from brindle.operators.sync import change_set


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """source_file, content_hash, text of .md files as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(path)
    return rows.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source_file"), F.sha2("content", 256).alias("content_hash"), F.decode("content", "UTF-8").alias("text"))


def start(spark: SparkSession, path: str, out: str, checkpoint: str):
    """Writes one folder of chunks for each batch id: chunks of files that are new or changed against all earlier batches."""

    def write(batch: DataFrame, batch_id: int) -> None:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{out}/chunks")
        there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        schema = "source_file string, content_hash string, status string"
        known = spark.createDataFrame([], schema)
        if there:
            rows = spark.read.parquet(f"{out}/chunks").filter(F.col("batch") < batch_id)
            last = rows.groupBy("source_file").agg(F.max_by("file_hash", "batch").alias("content_hash"))
            known = last.withColumn("status", F.lit("active"))
        todo = change_set(batch, known).filter("change_type in ('added', 'modified')").select("source_file")
        fresh = batch.join(todo, "source_file", "left_semi")
        chunks = chunk_files(fresh).join(fresh.select("source_file", F.col("content_hash").alias("file_hash")), "source_file")
        chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={batch_id}")

    return file_stream(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
