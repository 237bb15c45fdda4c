"""Tables that later steps read again, in the folder that all machines share; and checks of size and spread."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local folder where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = getattr(spark.sparkContext, "_brindle_dir", None)
        if not found:
            found = spark.sparkContext._brindle_dir = "file://" + tempfile.mkdtemp(prefix="brindle-")
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def end() -> None:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the application may have ended before
            return

    atexit.register(end)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: what reads it never works it out again, on a lost executor either."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether df has no more than so many rows, without counting on."""
    return df.limit(rows + 1).count() <= rows


#: Most rows of a small table that are broadcast whatever its estimated size.
FEW = 100_000


def small(df: DataFrame) -> DataFrame:
    """df, a table that is cheap to read again, marked for a broadcast if it has few rows: what it joins then stays where it is read."""
    return F.broadcast(df) if at_most(df, FEW) else df


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the files give fewer splits than there are cores; large tables stay as they are."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = len(df.inputFiles())
    if not files or files >= cores:
        return df
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < cores * (128 << 20) else df


def row_groups(df: DataFrame) -> list[int]:
    """Compressed bytes of each row group of the Parquet files that df reads. A row group is read by one task."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    parquet, found = jvm.org.apache.parquet.hadoop, []
    for file in df.inputFiles():
        reader = parquet.ParquetFileReader.open(parquet.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)), conf))
        try:
            found += [group.getCompressedSize() for group in reader.getRowGroups()]
        finally:
            reader.close()
    return found


#: Largest row group that several tasks read: each of them holds its compressed columns in memory.
SHARED_BYTES = 64 << 20
#: Of larger row groups, so many compressed bytes are shuffled at once.
DEALT_BYTES = 256 << 20


def parts(df: DataFrame, key: str) -> list[DataFrame]:
    """A Parquet table whose rows go over all cores, as one part or as several to be worked on one after the other; each row is in one of them.

    Of fewer row groups than cores, each is read by several tasks, and each task keeps its share of the rows by key: nothing is shuffled. For work
    that costs much more than reading. Larger row groups stay as they are if half the cores have one. Else their rows are shuffled, but only
    DEALT_BYTES of them in a part: each part reads the row groups again, and what it has shuffled can go before the next (``freed``). Rows are
    dealt by a hash of all columns, which needs no sort, so that nothing is spilled on the way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or not (groups := row_groups(df)) or len(groups) >= cores:
        return [df]
    if max(groups) <= SHARED_BYTES:
        n = -(-cores // len(groups))
        return [reduce(DataFrame.unionAll, [df.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)])]
    if 2 * len(groups) >= cores:
        return [df]
    n, row = -(-sum(groups) // DEALT_BYTES), F.xxhash64(*df.columns)
    return [df.filter(F.pmod(row, F.lit(n)) == i).repartition(cores, row) for i in range(n)]


def shares(df: DataFrame, key: str) -> DataFrame:
    """``parts`` as one table."""
    return reduce(DataFrame.unionAll, parts(df, key))


#: Spark removes what a query has shuffled as soon as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What is written here leaves no shuffle files, which otherwise stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
