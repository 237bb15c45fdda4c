"""Exact vector search for a batch of queries, and the vector table's upkeep."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METRICS = ("cosine", "dot", "l2")
#: Most queries that are sent to the workers at once; more go in rounds.
QUERY_BLOCK = 1024


def _scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    s = q @ x.T
    if metric == "cosine":
        n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
        return s / np.where(n == 0, 1, n)
    if metric == "l2":  # smaller is better: negated, so that the order is the same for all metrics
        return -np.stack([((x - v) ** 2).sum(axis=1) for v in q])
    return s


def _rows(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of each row, and all that tie with the last of them by rounded score."""
    if score.shape[1] <= k:
        return np.ones(score.shape, bool)
    bar = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    return score >= bar[:, None]


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, metric: str = "cosine", keep: Column | None = None) -> DataFrame:
    """queries: query_id, vector. vectors: chunk_id, vector (and what keep needs). query_id, chunk_id, score, rank.

    Queries go to the workers in blocks of at most QUERY_BLOCK rows, so what travels has a fixed bound; the vectors stay where they are
    read. A task meets its rows batch by batch as matrix products and keeps k rows a query, so what is shuffled is k rows for each query
    and task whatever the size of the table and however many rows tie (copies). Vectors of another width than the queries', or missing ones, raise.
    Where queries have a source_file, a query that names one meets the chunks of that file alone.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    vectors = vectors.filter(keep) if keep is not None else vectors
    qtype, ctype = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["chunk_id"]
    none = vectors.sparkSession.createDataFrame([], f"query_id {qtype}, chunk_id {ctype}, score double, rank int")
    file = F.col("source_file") if "source_file" in queries.columns else F.lit(None).cast("string")
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), file.alias("source_file"))
    n, low, high = asked.agg(F.count("*"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if k <= 0 or not n:
        return none
    if low != high or low < 1:
        raise ValueError("query vectors must have one width")
    x = vectors.select("chunk_id", F.when(F.size("vector") == low, F.col("vector").cast("array<double>")).otherwise(F.raise_error(F.lit(f"vectors must have width {low}"))).alias("vector"))
    blocks, found = -(-n // QUERY_BLOCK), None
    for i in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        got = _block_topk(part.toArrow(), x, k, metric, low, f"query_id {qtype}, chunk_id {ctype}, score double")
        found = got if found is None else found.unionByName(got)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id"))
    score = -F.col("score") if metric == "l2" else F.col("score")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "chunk_id", F.round(score, 6).alias("score"), "rank")


def _block_topk(asked: pa.Table, x: DataFrame, k: int, metric: str, width: int, schema: str) -> DataFrame:
    ids, q = asked["query_id"].combine_chunks(), _rows(asked["vector"], width)
    own = {i: f for i, f in enumerate(asked["source_file"].to_pylist()) if f is not None}

    def run(batches):
        held = []  # (query, chunk_id, score) of the best so far, a row for each
        rows, names, scores = np.zeros(0, np.int64), None, np.zeros(0)
        for batch in batches:
            if not batch.num_rows or not len(q):
                continue
            s = _scores(q, _rows(batch.column("vector"), width), metric)
            if own:
                names_of = pc.replace_substring_regex(batch.column("chunk_id").cast(pa.string()), "::[0-9]+$", "")
                for i, f in own.items():
                    s[i, ~pc.equal(names_of, f).to_numpy(zero_copy_only=False)] = -np.inf
            a, b = np.nonzero(_best(np.round(s, 9), k) & (s > -np.inf))
            held.append((a, batch.column("chunk_id").take(pa.array(b)), s[a, b]))
            rows = np.concatenate([rows, a])
            names = held[-1][1] if names is None else pa.concat_arrays([names, held[-1][1]])
            scores = np.concatenate([scores, held[-1][2]])
            held.clear()
            if len(rows) > 4 * k * len(q):  # cut back to the k best of each query
                stay = _cut(rows, scores, names, k)
                rows, names, scores = rows[stay], names.take(pa.array(stay)), scores[stay]
        if len(rows):
            stay = _cut(rows, scores, names, k)
            yield pa.RecordBatch.from_pydict({"query_id": ids.take(pa.array(rows[stay])), "chunk_id": names.take(pa.array(stay)), "score": scores[stay]})

    return x.mapInArrow(run, schema)


def _cut(rows: np.ndarray, scores: np.ndarray, names: pa.Array, k: int) -> np.ndarray:
    """Places of the k best of each row: by rounded score, then by the smaller name."""
    order = pc.sort_indices(pa.table({"r": rows, "s": np.round(scores, 9), "n": names}), [("r", "ascending"), ("s", "descending"), ("n", "ascending")]).to_numpy()
    sizes = np.bincount(rows)
    return order[np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < k]


def width_violations(vectors: DataFrame, width: int) -> DataFrame:
    """Rows whose vector is missing or not of the given width."""
    return vectors.filter(F.col("vector").isNull() | (F.size("vector") != width))


def collection_info(vectors: DataFrame) -> DataFrame:
    """One row: number of points, smallest and largest width."""
    return vectors.agg(F.count("*").alias("points"), F.min(F.size("vector")).alias("min_width"), F.max(F.size("vector")).alias("max_width"))


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace those of table with the same key, whole; within new the last by ``seq`` wins."""
    last = new.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc("seq")))).filter("_n = 1").drop("_n", "seq")
    return table.join(last.select(key), key, "left_anti").unionByName(last.select(*table.columns))


def delete_by(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


def payload_filter(conditions: dict) -> Column:
    """AND of equalities on text forms; a list matches any of its values; None is no condition."""
    out = F.lit(True)
    for name, want in conditions.items():
        if want is None:
            continue
        said = [str(v).lower() if isinstance(v, bool) else str(v) for v in (want if isinstance(want, list | tuple | set) else [want])]
        out = out & F.col(name).cast("string").isin(*said)
    return out
