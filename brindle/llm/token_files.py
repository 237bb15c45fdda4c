"""Token-id files with Simple-8b word-aligned coding.

A 64-bit word holds a 4-bit selector and 60 bits of payload; the selector says how many ids of which width
follow (table below), lowest bits first. Selector 0 is the escape: the next word is one raw 64-bit value, so every
unsigned 64-bit value can be stored. Ids are packed in blocks of BLOCK_IDS; a document's ids may span blocks. A file is a Parquet
part; each of its rows is a group of blocks: a binary column with the words (little-endian), and where each block starts in
them. Reading goes through these offsets: all blocks of a row are decoded side by side with array operations, or only those that
hold a range of ids.

Files are written by Spark in ascending doc_id order (range partitions, sorted within), one part for each range, with
the running start of every document; they can be read by any reader that Spark has. Starts come from a sum over the parts,
of which there are few: only one number for each part reaches the driver.

Defined cases: null text counts as empty and is the end id alone; repeated rows of a doc_id follow each other in
text order; an empty table writes and reads no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, ragged, tokenizer_path
from .common import U64, Work, spread

#: ids in a word and bits of each, by selector; selector 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0])
WIDTHS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0])
BLOCK_IDS = 128
#: Blocks whose words are chosen side by side.
LANES = 1 << 14


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values: unsigned 64-bit. Returns words and where each block of BLOCK_IDS values starts in them."""
    n = len(values)
    values = values.astype(U64, copy=False)
    blocks = -(-n // BLOCK_IDS)
    parts, sizes = [], []
    for a in range(0, blocks, LANES):
        w, s = _pack(values[a * BLOCK_IDS : (a + LANES) * BLOCK_IDS])
        parts.append(w)
        sizes.append(s)
    at = np.zeros(blocks + 1, np.int64)
    if blocks:
        np.cumsum(np.concatenate(sizes), out=at[1:])
    return np.concatenate(parts) if parts else np.zeros(0, U64), at


def _pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(values)
    lanes = -(-n // BLOCK_IDS)
    size = np.full(lanes, BLOCK_IDS)
    size[-1] = n - (lanes - 1) * BLOCK_IDS
    # The selector that packs most ids from each place: the narrowest whose ids all fit, as far as the block goes.
    best = np.zeros(n, np.int8)
    place = np.arange(n)
    end = np.minimum((place // BLOCK_IDS + 1) * BLOCK_IDS, n)
    for s in range(14, 0, -1):
        big = values >> U64(WIDTHS[s]) != 0
        after = np.where(big, place, n)
        after = np.minimum.accumulate(after[::-1])[::-1]  # the next id that doesn't fit
        run = np.minimum(after, end) - place
        best[(run >= COUNTS[s])] = s
        if big.all():
            break
    words_at, firsts, sels = [], [], []
    at, lane, k = np.arange(lanes) * BLOCK_IDS, np.arange(lanes), 0
    stop = at + size
    while len(lane):  # every block takes one word a turn
        s = best[at]
        firsts.append(at)
        sels.append(s)
        words_at.append(lane * (2 * BLOCK_IDS) + k)
        at = at + COUNTS[s]
        go = at < stop[lane]
        at, lane, k = at[go], lane[go], k + 1
    order = np.argsort(np.concatenate(words_at), kind="stable")
    first, sel = np.concatenate(firsts)[order], np.concatenate(sels)[order].astype(np.int64)
    extra = sel == 0
    where = np.arange(len(sel)) + np.concatenate([[0], np.cumsum(extra)[:-1]]) if len(sel) else np.zeros(0, np.int64)
    words = np.zeros(len(sel) + int(extra.sum()), U64)
    words[where] = sel.astype(U64) << U64(60)
    words[where[extra] + 1] = values[first[extra]]
    for s in range(1, 15):
        rows = np.flatnonzero(sel == s)
        if len(rows):
            acc = np.zeros(len(rows), U64)
            for j in range(COUNTS[s]):
                acc |= values[first[rows] + j] << U64(j * WIDTHS[s])
            words[where[rows]] |= acc
    per = np.bincount(first // BLOCK_IDS, weights=1 + extra, minlength=lanes).astype(np.int64)
    return words, per


def unpack(words: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """All values; at: where blocks start in the words (one block, if not given). Blocks are decoded side by side."""
    n = len(words)
    at = np.array([0, n]) if at is None else at
    sel = (words >> U64(60)).astype(np.int64)
    raw = np.zeros(n, bool)
    if (sel == 0).any():  # a word after an escape is raw and may look like an escape itself: every block is walked from its start, all at once
        now, stop = at[:-1].copy(), at[1:]
        while len(now):
            escape = sel[now] == 0
            raw[now[escape] + 1] = True
            now = now + 1 + escape
            now, stop = now[now < stop], stop[now < stop]
    count = np.where(raw, 0, COUNTS[sel])
    start = np.zeros(n + 1, np.int64)
    np.cumsum(count, out=start[1:])
    out = np.zeros(start[-1], U64)
    for s in range(15):
        rows = np.flatnonzero((sel == s) & ~raw)
        if not len(rows):
            continue
        if s == 0:
            out[start[rows]] = words[rows + 1]
            continue
        mask = U64((1 << int(WIDTHS[s])) - 1)
        for j in range(COUNTS[s]):
            out[start[rows] + j] = (words[rows] >> U64(j * WIDTHS[s])) & mask
    return out


def unpack_range(words: np.ndarray, at: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Values start to stop: only the blocks that hold them are decoded."""
    a, b = start // BLOCK_IDS, min(-(-stop // BLOCK_IDS), len(at) - 1)
    if start >= stop or a >= b:
        return np.zeros(0, U64)
    return unpack(words[at[a] : at[b]], at[a : b + 1] - at[a])[start - a * BLOCK_IDS : stop - a * BLOCK_IDS]


FILE = "part int, before long, doc_ids array<long>, sizes array<long>, words binary, block_at array<long>"
#: Bytes of text that go into one row of a file.
ROW_BYTES = 4_000_000


def write_token_files(docs: DataFrame, path: str, name: str, end_id: int, folder: str | None = None, files: int | None = None, spaced: bool = True) -> DataFrame:
    """Encode and write; returns the frame that reads the files back. Rows: documents in ascending doc_id."""
    where = tokenizer_path(name, folder)

    def run(batches):
        from pyspark import TaskContext

        enc, part, before = encoder(where, spaced), TaskContext.get().partitionId(), 0
        for batch in batches:
            total = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
            at = 0
            for i in range(len(batch)):
                if i + 1 < len(batch) and total[i + 1] - total[at] < ROW_BYTES:
                    continue
                rows = batch.slice(at, i + 1 - at)
                at = i + 1
                flat, starts = enc.column(rows["text"])
                ids = np.insert(flat, starts[1:], end_id)
                words, blocks = pack(ids)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part], pa.int32()), "before": pa.array([before], pa.int64()), "doc_ids": pa.array([rows["doc_id"].to_pylist()], pa.list_(pa.int64())), "sizes": pa.array([np.diff(starts) + 1], pa.list_(pa.int64())),
                    "words": pa.array([words.astype("<u8").tobytes()], pa.binary()), "block_at": pa.array([blocks], pa.list_(pa.int64())),
                })
                before += len(ids)

    rows = spread(docs)
    ranged = rows.repartitionByRange(files, "doc_id") if files else rows.repartitionByRange("doc_id")
    ranged.sortWithinPartitions("doc_id", "text").mapInArrow(run, FILE).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(FILE).parquet(path)


READ = "doc_id long, start long, n_tokens long, ids_crc32 long, part int"


def read_token_files(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row for each document, decoded from the files: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    parts = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum(total).alias("n")).collect())  # one number for each file
    base, so_far = {}, 0
    for p, n in parts:
        base[p], so_far = so_far, so_far + n

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                words, blocks = np.frombuffer(batch["words"][i].as_buffer(), "<u8").astype(U64, copy=False), batch["block_at"][i].values.to_numpy()
                ids = unpack(words, blocks).astype("<u4")
                sizes = np.array(batch["sizes"][i].values.to_numpy(), np.int64)
                at = np.concatenate([[0], np.cumsum(sizes)])
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * at[k] : 4 * at[k + 1]]) for k in range(len(sizes))]
                out = {"doc_id": batch["doc_ids"][i].values, "start": at[:-1] + batch["before"][i].as_py(), "n_tokens": sizes, "ids_crc32": np.array(crc, np.int64), "part": np.full(len(sizes), batch["part"][i].as_py(), np.int32)}
                if with_ids:
                    out["ids"] = pa.array([ids[at[k] : at[k + 1]].astype(np.int64) for k in range(len(sizes))], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    spark = files.sparkSession
    starts = spark.createDataFrame(list(base.items()) or [(-1, 0)], "part int, base long")  # one row for each file: bounded by their number
    placed = files.join(F.broadcast(starts), "part").withColumn("before", F.col("base") + F.col("before"))
    return placed.mapInArrow(run, READ + (", ids array<long>" if with_ids else "")).drop("part")


def token_file_digests(docs: DataFrame, name: str = "byte_bpe_50k.json", end_id: int = 0, folder: str | None = None) -> DataFrame:
    work = Work(docs.sparkSession, "tokens")
    files = write_token_files(docs, f"{work.base}/files", name, end_id, folder)
    work.free()
    return read_token_files(files)


__all__ = ["pack", "ragged", "read_token_files", "token_file_digests", "unpack", "write_token_files"]
