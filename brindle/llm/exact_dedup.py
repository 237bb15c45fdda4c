"""Exact dedup against a minimal perfect hash over the digests of a history.

Every text is normalised (each run of the six ASCII white-space characters becomes one space) and
digested with SHA-256, all in the JVM. The distinct digests of the *history* are dealt into buckets by
their leading bits and each bucket becomes a minimal perfect hash: bit levels after the manner of cascaded
collision-free bit sets, in which a key's place is the rank of its bit. Slot i holds the full 32-byte digest,
the winner's locator (smallest doc_id) and the group's size. A digest of the *incoming* rows is looked up in
its bucket; as any key gets a slot, the slot's 32 bytes are compared with the key's, and only an equal digest
is a member. Members join the group of their slot; nonmembers are grouped separately by digest.

Digests are combined before every shuffle (one row for each distinct digest of a map task), so a group of
copies of any size costs one row a task. The one join back on digests is a plain sort-merge join, which
adaptive execution splits where one digest holds many rows.

Defined cases: null text counts as empty; empty texts are equal to one another; repeated rows of one doc_id
each give a row; a missing doc_id
wins only in a group without any, and its keep_id is null; ties cannot arise, since the smallest doc_id wins; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Work, mix, text_bytes

SPACES = "[\\x20\\x09-\\x0D]+"
GAMMA = 2.0
BUCKET_KEYS = 100_000
#: Stands for a missing doc_id, which never wins over another.
NO_ID = (1 << 63) - 1


def digests(docs: DataFrame) -> DataFrame:
    normal = F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, " ")
    return docs.select("doc_id", F.unhex(F.sha2(normal.cast("binary"), 256)).alias("digest"))


def _hash(words: np.ndarray, level: int) -> np.ndarray:
    return mix(words[:, 1] ^ mix(words[:, 2] + U64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))))


def mph_build(words: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """words: n distinct digests as n x 4 uint64. Returns the bit levels and each key's slot in 0..n-1."""
    n = len(words)
    slot, left, levels, base = np.zeros(n, np.int64), np.arange(n), [], 0
    while len(left):
        size = max(64, int(math.ceil(GAMMA * len(left) / 64)) * 64)
        at = (_hash(words[left], len(levels)) % U64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        rank = np.cumsum(alone) - 1
        placed = alone[at]
        slot[left[placed]] = base + rank[at[placed]]
        base += int(alone.sum())
        left = left[~placed]
    return levels, slot


def mph_find(levels: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """The slot of each key; keys outside the set get some slot, or -1."""
    slot, left, base = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for k, bits in enumerate(levels):
        at = (_hash(words[left], k) % U64(len(bits))).astype(np.int64)
        hit = bits[at]
        slot[left[hit]] = base + (np.cumsum(bits) - 1)[at[hit]]
        base += int(bits.sum())
        left = left[~hit]
    return slot


def _words(column) -> np.ndarray:
    data, _ = text_bytes(column)
    return np.ascontiguousarray(data).view(">u8").astype(U64).reshape(-1, 4)


INDEX = "bucket long, sizes array<long>, levels binary, digests binary, winners array<long>, counts array<long>"
HITS = "digest binary, keep_id long, group_size long"


def _build(table: pa.Table) -> pa.Table:
    words = _words(table["digest"])
    levels, slot = mph_build(words)
    order = np.argsort(slot)
    stored = np.ascontiguousarray(words[order].astype(">u8")).tobytes()
    bits = b"".join(np.packbits(x).tobytes() for x in levels)
    return pa.table({
        "bucket": table["bucket"].slice(0, 1), "sizes": pa.array([[len(x) for x in levels]], pa.list_(pa.int64())), "levels": pa.array([bits], pa.binary()), "digests": pa.array([stored], pa.binary()),
        "winners": pa.array([table["first_id"].to_numpy()[order]], pa.list_(pa.int64())), "counts": pa.array([table["n"].to_numpy()[order]], pa.list_(pa.int64())),
    })


def _probe(left: pa.Table, right: pa.Table) -> pa.Table:
    """left: incoming distinct digests of a bucket; right: the bucket's index, or nothing."""
    words = _words(left["digest"]) if left.num_rows else np.zeros((0, 4), U64)
    first, n = left["first_id"].to_numpy(), left["n"].to_numpy()
    keys = left["digest"].to_pylist()
    if not right.num_rows:  # no history here: all are nonmembers
        return pa.table({"digest": pa.array(keys, pa.binary()), "keep_id": first, "group_size": n})
    raw, levels, at = np.frombuffer(right["levels"][0].as_py(), np.uint8), [], 0
    for size in right["sizes"][0].as_py():
        levels.append(np.unpackbits(raw[at : at + size // 8]).astype(bool))
        at += size // 8
    stored = np.frombuffer(right["digests"][0].as_py(), ">u8").astype(U64).reshape(-1, 4)
    winners, counts = np.array(right["winners"][0].as_py(), np.int64), np.array(right["counts"][0].as_py(), np.int64)
    slot = mph_find(levels, words)
    member = slot >= 0
    member[member] = (stored[slot[member]] == words[member]).all(axis=1)  # byte for byte
    keep, size = winners.copy(), counts.copy()
    np.minimum.at(keep, slot[member], first[member])
    np.add.at(size, slot[member], n[member])
    plain = np.ascontiguousarray(stored.astype(">u8")).tobytes()
    return pa.table({
        "digest": pa.array([plain[32 * i : 32 * i + 32] for i in range(len(stored))] + [k for k, m in zip(keys, member, strict=True) if not m], pa.binary()),
        "keep_id": np.concatenate([keep, first[~member]]), "group_size": np.concatenate([size, n[~member]]),
    })


def exact_groups(rows: DataFrame, work: Work, is_history: F.Column | None = None) -> DataFrame:
    """rows: doc_id, digest. One row for each distinct digest: digest, keep_id, group_size."""
    if is_history is None:  # a stable half of the ids stands for what an earlier run has indexed
        is_history = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    first = rows.groupBy("digest", F.coalesce(is_history, F.lit(False)).alias("old")).agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("first_id"), F.count("*").alias("n"))
    first = work.keep(first, "distinct")
    buckets = max(8, math.ceil(first.count() / BUCKET_KEYS))
    first = first.withColumn("bucket", F.pmod(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long"), F.lit(buckets)))
    index = work.keep(first.filter("old").groupBy("bucket").applyInArrow(_build, INDEX), "index")
    return first.filter("not old").drop("old").groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(_probe, HITS).withColumn("keep_id", F.nullif("keep_id", F.lit(NO_ID)))


def exact_dedup(docs: DataFrame, is_history: F.Column | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs."""
    work = Work(docs.sparkSession, "exact")
    rows = work.keep(digests(docs), "digests")
    groups = exact_groups(rows, work, is_history)
    return rows.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
