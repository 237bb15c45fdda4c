"""Sum-of-squares packing of tokenised documents into sequences of a fixed capacity.

Every document's ids (with its end id) are cut into pieces only where it is longer than a sequence. Pieces are dealt
by a hash of the document into shards of about SHARD_PIECES pieces, so that a hot source is spread evenly, and each shard is
packed by itself: pieces in falling length; a piece goes to the open sequence whose choice makes the sum over gaps of
(number of open sequences with that gap) squared smallest, ties to the smaller gap; a new sequence opens only where no open
one has room. A shard leaves a sequence or two unfilled, so the loss against one packing of all is about one sequence in
SHARD_PIECES pieces. Only (doc_id, piece, length) travels, never ids.

Defined cases: null text counts as empty and is the end id alone; repeated rows of a doc_id are documents of their own,
told apart by ``copy``; ties between equal pieces go by doc_id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, tokenizer_path
from .common import ship, spread

SHARD_PIECES = 25_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int, name: str, end_id: int, folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece, in its document's order."""
    ship(docs.sparkSession)
    where = tokenizer_path(name, folder)

    def run(batches):
        enc = encoder(where, False)
        for batch in batches:
            total = np.concatenate([[0], np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64))])
            at = 0
            for i in range(len(batch)):
                if i + 1 < len(batch) and total[i + 1] - total[at] < 12_000_000:
                    continue
                rows = batch.slice(at, i + 1 - at)
                at = i + 1
                flat, starts = enc.column(rows["text"])
                ids = np.insert(flat, starts[1:], end_id).astype("<u4")
                size = np.diff(starts) + 1
                ends = np.cumsum(size)
                n = -(-size // capacity)
                doc = np.repeat(np.arange(len(rows)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                begin = piece * capacity
                length = np.minimum(size[doc] - begin, capacity)
                first = (ends - size)[doc] + begin
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(first.tolist(), length.tolist(), strict=True)]
                out = {"doc_id": rows["doc_id"].take(pa.array(doc)), "piece": piece.astype(np.int32), "start": begin, "length": length, "ids_crc32": np.array(crc, np.int64)}
                if with_ids:
                    out["ids"] = pa.array([ids[a : a + m].astype(np.int32) for a, m in zip(first, length, strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    return spread(docs).mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def sum_of_squares(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """length: falling. Returns the sequence of each piece and its offset there."""
    bins, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap; count[0] stays 0: full ones are closed
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    opened = 0
    for i, s in enumerate(length.tolist()):
        here = count[s:]
        gaps = np.flatnonzero(here)
        if len(gaps):
            after = count[gaps]  # number of sequences that already have the gap that would be left
            after[gaps == 0] = -1  # one that becomes full leaves the count: nothing is added, so 2 * after + 2 is 0
            change = 2 * (after - here[gaps]) + 2
            gap = int(gaps[int(np.argmin(change))]) + s
            b = by_gap[gap].pop()
            count[gap] -= 1
        else:
            gap, b = capacity, opened
            opened += 1
        bins[i], offset[i] = b, capacity - gap
        if gap > s:
            by_gap[gap - s].append(b)
            count[gap - s] += 1
    return bins, offset


def pack_sequences(docs: DataFrame, capacity: int = 4096, name: str = "word_bpe_49k.json", end_id: int = 1, folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): one row for each piece."""
    shards = max(1, math.ceil(docs.count() / SHARD_PIECES))  # a cheap count of rows; long documents add pieces to their shard
    cut = pieces(docs, capacity, name, end_id, folder, with_ids)
    shard = F.pmod(F.xxhash64("doc_id", "ids_crc32", "length"), F.lit(shards))

    def run(key, table):
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offset = sum_of_squares(table["length"].to_numpy(), capacity)
        seq = bins * shards + key[0].as_py()
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offset))

    schema = PIECES + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    return cut.withColumn("shard", shard).groupBy("shard").applyInArrow(run, schema)
