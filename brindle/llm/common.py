"""What the corpus operators share: shared tables, code shipping, and text as byte buffers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="brindle-code-"), "brindle_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir, or a local one where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if not found:
        found = getattr(spark.sparkContext, "_brindle_dir", None)
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="brindle-")
            spark.sparkContext._brindle_dir = found
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Work:
    """Tables of one operator call in the shared folder.

    ``keep`` cuts the lineage: it writes a table and returns a frame that reads it, so a lost
    executor costs the tasks that read it and nothing before. ``drop`` removes a table that no later
    step reads; those that a returned frame still reads go when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.tables: list[str] = []
        ship(spark)
        atexit.register(self._end)

    def _end(self) -> None:
        try:
            for t in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {t}")
            _delete(self.spark, self.base)
        except Exception:  # noqa: BLE001  the application may have ended before
            return

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.free()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.base}/{name}")

    def free(self) -> None:
        """Let the driver forget the shuffles that no frame refers to any more, so their files go."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Null texts as empty ones; only the columns named, so that clashing extra columns do no harm."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *cols)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each text starts (one more entry than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), so that every bit depends on every bit."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(n, U64)
    size = 1
    step = U64(base)
    with np.errstate(over="ignore"):
        while size < n:
            m = min(size, n - size)
            out[size : size + m] = out[:m] * step
            step = step * step
            size += m
    return out


def crc32_mod(column: str, n: int) -> F.Column:
    """crc32 of an id as text, modulo n: the fold that a row belongs to."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)
