"""Suffix dedup: distributed prefix doubling over sampled positions.

A byte goes if a ``threshold``-byte string (50) that covers it also starts in a document with a smaller doc_id. Prefix doubling
ranks the strings at all positions by sorting pairs of ranks at growing offsets, and lets go of positions whose rank is
unique. Here the ranks of the first round are those of half-length strings (25 bytes), taken only where they matter: every
50-byte window has 26 of them, and the one with the smallest fingerprint stands for the window. Windows that follow each
other and share it form a *run*, so about one position in thirteen is sorted. The rounds, each one shuffle by rank:

1. half: the rank of each run's 25-byte string. A run whose rank occurs in one document only is unique: it leaves.
2. span: the rank of a run's whole text, i.e. its windows from first to last (50 to 75 bytes), past the threshold. A run whose
   text also starts in a smaller doc_id is resolved at once, all its windows repeat. A run whose half rank always stands
   in the same text is resolved too: it is the first copy. Only first copies whose half rank occurs in different texts go on.
3. full: for each window of those, the pair of half ranks at offset 25, which is the rank of its 50 bytes.

Ranks are fingerprints, equal for equal strings: what decides a removal has 96 bits (round 2) or 128 bits (round 3), and bytes are not
compared again; among n different strings a false match has a chance of about n * n / 2**97, 4e-4 for the 8e12 runs of 100 TB. A rank
travels as a few bytes in a packed block (one row for each pair of document block and rank bucket that meet), sorted inside the bucket. Before
a round ships anything, equal ranks of a block become one entry with the smallest doc_id, and the others are resolved on the spot: a
passage in a third of all documents costs one entry a block, never one group. Documents are bucketed once by block into an external
table in the shared folder, so the rounds read texts without shuffling them again; answers travel as entry numbers. The result is
written, and the table and all answers are dropped before it is returned.

Blocks of documents grow with the table from 4 to 64 MB and rank buckets from 8 to 32 MB of text, so that a pair of them still shares
many entries; table buckets hold several blocks where there would be more than MOST_BUCKETS. A block works on what it has alone, never on
a list of all buckets.

Defined cases: null text counts as empty; texts under 50 bytes lose nothing; rows that repeat a doc_id don't count as earlier
documents for one another; matches never cross documents; very long texts are cut into overlapping pieces, in which
every window is in one piece; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Work, mix, power_table, spread, text_bytes

#: Bytes that are worked on together; small, so that their sums stay in a core's cache.
PIECE = 100_000
#: Bytes of text in a block of documents, about: the least and the most.
BLOCK_BYTES, MOST_BLOCK_BYTES = 4_000_000, 64_000_000
#: Bytes of text whose ranks meet in one bucket, at most; buckets of the table, at most (Spark allows 100,000).
RANK_BYTES, MOST_BUCKETS = 32_000_000, 65_536
_R = 0x2545F4914F6CDD1D | 1
_BYTE = mix(np.arange(1, 257, dtype=U64))
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
SENT = "bucket int, block int, kind int, data binary"
REPLY = "block int, bucket int, kind int, data binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _tables.get(0)
    if have is None or len(have[0]) < n:
        n = max(n, 2 * PIECE + 200)
        _tables[0] = power_table(_R, n), power_table(pow(_R, -1, 1 << 64), n)
    return _tables[0]


class Block:
    """The texts of one block, in ascending doc_id, and the runs of their windows."""

    def __init__(self, table: pa.Table, threshold: int):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids = table["doc_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
        self.raw_ids = table["doc_id"]
        self.data, self.at = text_bytes(table["text"])
        self.threshold, self.half = threshold, threshold // 2
        self.pieces = self._pieces()
        rows = [self._runs(*p) for p in self.pieces]
        cat = lambda k: np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, U64 if k in (2, 3) else np.int64)
        #: Of each run: first window's place in the buffer, number of windows, half rank, text rank, document.
        self.lo, self.n, self.half_rank, self.text_rank = cat(0), cat(1), cat(2), cat(3)
        self.doc = np.searchsorted(self.at, self.lo, side="right") - 1

    def _pieces(self) -> list[tuple[int, int]]:
        """Parts of the buffer that are worked on together: whole documents, or overlapping parts of a long one."""
        out, i, n = [], 0, len(self.at) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.at, self.at[i] + PIECE, side="right")) - 1)
            a, b = int(self.at[i]), int(self.at[j])
            if b - a > 2 * PIECE:
                out += [(s, min(b, s + PIECE + self.threshold - 1)) for s in range(a, b - self.threshold + 1, PIECE)]
            elif b > a:
                out.append((a, b))
            i = j
        return out

    def _sums(self, a: int, b: int) -> np.ndarray:
        total = np.zeros(b - a + 1, U64)
        np.cumsum(_BYTE[self.data[a:b]] * _powers(b - a)[0][: b - a], out=total[1:])
        return total

    def _runs(self, a: int, b: int):
        m, w = self.threshold, self.threshold - self.half + 1
        n = b - a - m + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64)
        total, inverse = self._sums(a, b), _powers(b - a + 1)[1]
        low = mix((total[self.half :] - total[: -self.half]) * inverse[: b - a - self.half + 1])
        size = 1
        while size * 2 <= w:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[: n], low[w - size : w - size + n])  # the smallest of the w half ranks of each window
        lo_doc, hi_doc = np.searchsorted(self.at, [a, b])
        inner = self.at[lo_doc : hi_doc + 1]
        valid = np.ones(n, bool)
        for e in inner[(inner > a) & (inner < b)] - a:  # windows that would cross into the next document
            valid[max(0, e - m + 1) : e] = False
        new = np.ones(n, bool)
        new[1:] = (low[1:] != low[:-1]) | ~valid[:-1]
        start = inner[(inner > a) & (inner < a + n)] - a
        new[start] = True
        at = np.flatnonzero(new & valid)
        stop = np.flatnonzero(new | ~valid)
        end = np.append(stop, n)[np.searchsorted(stop, at, side="right")]
        long = np.flatnonzero(end - at > w)
        if len(long):  # text that repeats itself: the same half rank over many windows, cut every w windows
            more = [np.arange(at[i] + w, end[i], w) for i in long]
            at = np.sort(np.concatenate([at, *more]))
            stop = np.sort(np.concatenate([stop, *more]))  # all different: the cuts lie inside runs
            end = np.append(stop, n)[np.searchsorted(stop, at, side="right")]
        count = end - at
        text = mix((total[at + count + m - 1] - total[at]) * inverse[at] + count.astype(U64) * U64(0x9E3779B97F4A7C15))
        return at + a, count, low[at], text

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows of some runs: place, half rank, half rank at offset half."""
        place, one, two = [np.zeros(0, np.int64)], [np.zeros(0, U64)], [np.zeros(0, U64)]
        lo = self.lo[runs]
        for a, b in self.pieces:
            own = np.flatnonzero((lo >= a) & (lo < b - self.threshold + 1))
            if b - a > PIECE and len(self.pieces) > 1:
                own = own[lo[own] < a + PIECE] if any(p[0] == a + PIECE for p in self.pieces) else own
            if not len(own):
                continue
            n = self.n[runs[own]]
            p = np.repeat(lo[own] - a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            total, inverse = self._sums(a, b), _powers(b - a + 1)[1]
            h = self.half
            one.append(mix((total[p + h] - total[p]) * inverse[p]))
            two.append(mix((total[p + self.threshold] - total[p + h]) * inverse[p + h]))
            place.append(p + a)
        return np.concatenate(place), np.concatenate(one), np.concatenate(two)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys stand together, and where each group starts in it."""
    order = np.argsort(keys[0])
    if len(order) < 2:
        return order, np.arange(len(order))
    k = keys[0][order]
    new = k[1:] != k[:-1]
    for other in keys[1:]:
        o = other[order]
        if (~new & (o[1:] != o[:-1])).any():  # one first key with several second ones, which a fingerprint hardly ever has
            order = np.lexsort(keys[::-1])
            new = np.zeros(len(order) - 1, bool)
            for key in keys:
                new |= key[order][1:] != key[order][:-1]
            break
    return order, np.flatnonzero(np.concatenate([[True], new]))


def _deal(rank: np.ndarray, buckets: int) -> np.ndarray:
    return ((rank >> U64(40)) % U64(buckets)).astype(np.int64)


def _low40(rank: np.ndarray) -> np.ndarray:
    return rank & U64((1 << 40) - 1)


def _pack5(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]


def _unpack5(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8")[:, 0].astype(U64)


class Rounds:
    """What a block ships in each round, and what the answers mean for it. Each round is worked out anew from the text."""

    def __init__(self, table: pa.Table, replies: pa.Table | None, threshold: int, buckets: int):
        self.b, self.buckets = Block(table, threshold), buckets
        self.replies: dict[int, dict[int, list[bytes]]] = {}
        if replies is not None:
            for bucket, kind, data in zip(replies["bucket"].to_pylist(), replies["kind"].to_pylist(), replies["data"].to_pylist(), strict=True):
                self.replies.setdefault(kind, {}).setdefault(bucket, []).append(data)

    def _numbers(self, kind: int, bucket_of: np.ndarray) -> np.ndarray:
        """Answers that name entries of a bucket by number, as numbers in the order in which the block has them."""
        order = np.argsort(bucket_of, kind="stable")
        answered = self.replies.get(kind, {})
        first = np.searchsorted(bucket_of[order], np.fromiter(answered, np.int64, len(answered)))
        got = [order[at + np.frombuffer(d, "<u4").astype(np.int64)] for at, v in zip(first, answered.values(), strict=True) for d in v]
        return np.concatenate(got) if got else np.zeros(0, np.int64)

    def _ship(self, kind: int, bucket_of: np.ndarray, columns: list[np.ndarray]):
        """Rows by bucket; within a bucket the entries keep the block's order, so their numbers are known on both sides."""
        order = np.argsort(bucket_of, kind="stable")
        met, edge = np.unique(bucket_of[order], return_index=True)
        for k, rows in zip(met.tolist(), np.split(order, edge[1:]), strict=False):
            yield k, kind, len(rows).to_bytes(4, "little") + b"".join(np.ascontiguousarray(c[rows]).tobytes() for c in columns)

    # round 1
    def halves(self):
        b = self.b
        rank = mix(b.half_rank)
        order, first = _groups(rank)
        doc = b.ids[b.doc[order]]
        top, low = np.maximum.reduceat(doc, first) if len(first) else doc, np.minimum.reduceat(doc, first) if len(first) else doc
        self.half_order, self.half_first, self.half_keys = order, first, rank[order[first]]
        self.half_many = top != low

    def send1(self):
        self.halves()
        yield from self._ship(1, _deal(self.half_keys, self.buckets), [_pack5(_low40(self.half_keys)), self.half_many.astype(np.uint8)])

    # round 2
    def spans(self):
        self.halves()
        b = self.b
        shared = np.zeros(len(self.half_keys), bool)
        shared[self._numbers(1, _deal(self.half_keys, self.buckets))] = True
        size = np.diff(np.append(self.half_first, len(self.half_order)))
        alive = np.zeros(len(b.lo), bool)
        alive[self.half_order] = np.repeat(shared, size)
        self.runs = np.flatnonzero(alive)
        half, text, doc = b.half_rank[self.runs], b.text_rank[self.runs], b.ids[b.doc[self.runs]]
        self.span_key, self.span_more = mix(text ^ mix(half)), mix(half + text * U64(3))
        order, first = _groups(self.span_key, self.span_more)
        self.span_of = np.empty(len(self.runs), np.int64)
        self.span_of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        self.span_doc = np.minimum.reduceat(doc[order], first) if len(first) else doc
        self.span_at = order[first]
        self.repeats = doc > self.span_doc[self.span_of]  # resolved inside the block
        # For each half rank, whether it stands in different texts here, else the one text.
        h_order, h_first = _groups(mix(half))
        self.mixed_keys = mix(half)[h_order[h_first]]
        t = text[h_order]
        self.mixed_here = (np.maximum.reduceat(t, h_first) != np.minimum.reduceat(t, h_first)) if len(h_first) else np.zeros(0, bool)
        self.mixed_text = t[h_first]
        self.mixed_of = np.empty(len(self.runs), np.int64)
        self.mixed_of[h_order] = np.repeat(np.arange(len(h_first)), np.diff(np.append(h_first, len(h_order))))

    def send2(self):
        self.spans()
        at = self.span_at
        yield from self._ship(2, _deal(self.span_key[at], self.buckets), [self.span_key[at].astype("<u8"), self.span_more[at].astype("<u4"), self.span_doc.astype("<i8")])
        yield from self._ship(3, _deal(self.mixed_keys, self.buckets), [_pack5(_low40(self.mixed_keys)), self.mixed_text.astype("<u8"), self.mixed_here.astype(np.uint8)])

    # round 3
    def fulls(self):
        self.spans()
        b = self.b
        earlier = np.zeros(len(self.span_at), bool)
        earlier[self._numbers(2, _deal(self.span_key[self.span_at], self.buckets))] = True
        self.repeats |= earlier[self.span_of]
        mixed = np.zeros(len(self.mixed_keys), bool)
        mixed[self._numbers(3, _deal(self.mixed_keys, self.buckets))] = True
        first_copy = b.ids[b.doc[self.runs]] == self.span_doc[self.span_of]
        go = self.runs[~self.repeats & mixed[self.mixed_of] & first_copy]
        self.place, one, two = b.windows(go)
        order, first = _groups(one, two)
        doc = b.ids[np.searchsorted(b.at, self.place, side="right") - 1]
        self.full_doc = np.minimum.reduceat(doc[order], first) if len(first) else doc
        self.full_of = np.empty(len(self.place), np.int64)
        self.full_of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        self.full_one, self.full_two = one[order[first]], two[order[first]]
        self.full_repeats = doc > self.full_doc[self.full_of]

    def send3(self):
        self.fulls()
        yield from self._ship(4, _deal(mix(self.full_one ^ mix(self.full_two)), self.buckets), [self.full_one.astype("<u8"), self.full_two.astype("<u8"), self.full_doc.astype("<i8")])

    # result
    def result(self) -> pa.Table:
        self.fulls()
        b, m = self.b, self.b.threshold
        earlier = np.zeros(len(self.full_one), bool)
        earlier[self._numbers(4, _deal(mix(self.full_one ^ mix(self.full_two)), self.buckets))] = True
        win = self.place[self.full_repeats | earlier[self.full_of]]
        run = self.runs[self.repeats]
        start, end = np.concatenate([win, b.lo[run]]), np.concatenate([win + m, b.lo[run] + b.n[run] + m - 1])
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
        if len(start):
            doc = np.searchsorted(b.at, start, side="right") - 1
            reach = np.maximum.accumulate(end)
            new = np.ones(len(start), bool)
            new[1:] = (start[1:] > reach[:-1]) | (doc[1:] != doc[:-1])
            k = np.flatnonzero(new)
            start, end = start[k], np.maximum.reduceat(end, k)
        n = len(b.ids)
        edge = np.searchsorted(start, b.at)
        data, removed, count, sha, spans = memoryview(b.data.tobytes()), [], [], [], []
        for i in range(n):
            lo, hi = int(b.at[i]), int(b.at[i + 1])
            s, e = start[edge[i] : edge[i + 1]], end[edge[i] : edge[i + 1]]
            h, at = hashlib.sha256(), lo
            for x, y in zip(s.tolist(), e.tolist(), strict=True):
                h.update(data[at:x])
                at = y
            h.update(data[at:hi])
            removed.append(int((e - s).sum()))
            count.append(len(s))
            sha.append(h.hexdigest())
            spans.append(np.stack([s - lo, e - lo], axis=1).astype("<i8").tobytes())
        return pa.table({"doc_id": b.raw_ids, "n_bytes": np.diff(b.at), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(count, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "spans": pa.array(spans, pa.binary())})


def _answer(table: pa.Table) -> pa.Table:
    """One bucket: all blocks' entries are sorted together; each block gets the numbers of its entries that aren't unique (1), that a smaller doc_id has (2, 4), or whose half rank stands in different texts (3)."""
    out = {"block": [], "bucket": [], "kind": [], "data": []}
    bucket, blocks, kinds, datas = (table[c].to_pylist() for c in ("bucket", "block", "kind", "data"))
    for kind in sorted(set(kinds)):
        rows = [i for i, k in enumerate(kinds) if k == kind]
        size = [int.from_bytes(datas[i][:4], "little") for i in rows]
        row = np.repeat(np.arange(len(rows)), size)
        number = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)

        def column(skip: int, width: int, kind_: str | None, rows=rows, size=size):
            parts = [datas[i][4 + skip * n : 4 + (skip + width) * n] for i, n in zip(rows, size, strict=True)]
            return np.concatenate([np.frombuffer(p, kind_) if kind_ else _unpack5(p) for p in parts])

        if kind == 1:
            key, many = column(0, 5, None), column(5, 1, "u1")
            order, first = _groups(key)
            n = np.diff(np.append(first, len(order)))
            hit = np.zeros(len(order), bool)
            hit[order] = np.repeat((n > 1) | (np.maximum.reduceat(many[order], first) > 0), n)
        elif kind == 3:
            key, text, here = column(0, 5, None), column(5, 8, "<u8"), column(13, 1, "u1")
            order, first = _groups(key)
            n = np.diff(np.append(first, len(order)))
            t = text[order]
            hit = np.zeros(len(order), bool)
            hit[order] = np.repeat((np.maximum.reduceat(t, first) != np.minimum.reduceat(t, first)) | (np.maximum.reduceat(here[order], first) > 0), n)
        else:
            if kind == 2:
                a, b, doc = column(0, 8, "<u8"), column(8, 4, "<u4"), column(12, 8, "<i8")
            else:
                a, b, doc = column(0, 8, "<u8"), column(8, 8, "<u8"), column(16, 8, "<i8")
            order, first = _groups(a, b)
            n = np.diff(np.append(first, len(order)))
            hit = np.zeros(len(order), bool)
            hit[order] = doc[order] > np.repeat(np.minimum.reduceat(doc[order], first), n)
        at = np.flatnonzero(hit)
        edge = np.searchsorted(row[at], np.arange(len(rows) + 1))
        for j, i in enumerate(rows):
            if edge[j] < edge[j + 1]:
                out["block"].append(blocks[i])
                out["bucket"].append(bucket[i])
                out["kind"].append(kind)
                out["data"].append(number[at[edge[j] : edge[j + 1]]].astype("<u4").tobytes())
    return pa.table({"block": pa.array(out["block"], pa.int32()), "bucket": pa.array(out["bucket"], pa.int32()), "kind": pa.array(out["kind"], pa.int32()), "data": pa.array(out["data"], pa.binary())})


def deal(total: int, block_bytes: int | None = None) -> tuple[int, int, int]:
    """For so many bytes of text: blocks of documents, rank buckets, buckets of the table."""
    size = block_bytes or min(MOST_BLOCK_BYTES, max(BLOCK_BYTES, total // 100_000))
    blocks = max(64, math.ceil(total / size))
    return blocks, max(64, math.ceil(total / min(2 * size, RANK_BYTES))), min(blocks, MOST_BUCKETS, max(64, math.ceil(total / BLOCK_BYTES)))


def suffix_dedup(docs: DataFrame, threshold: int = 50, block_bytes: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (pairs of little-endian 64-bit byte offsets of what goes)."""
    spark, work = docs.sparkSession, Work(docs.sparkSession, "suffix")
    rows = spread(docs)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets, table_buckets = deal(total, block_bytes)
    name = f"brindle_suffix_{uuid.uuid4().hex[:12]}"
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    table = rows.withColumn("block", block).repartition(table_buckets, "block").write.option("compression", "zstd").option("path", f"{work.base}/texts")
    table.bucketBy(table_buckets, "block").saveAsTable(name)
    work.tables.append(name)
    work.free()

    def texts():
        return spark.table(name).groupBy("block")

    def sender(step: str):
        def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
            got = list(getattr(Rounds(left.select(["doc_id", "text"]), right, threshold, buckets), step)()) if left.num_rows else []
            bucket, kind, data = zip(*got, strict=True) if got else ((), (), ())
            return pa.table({"bucket": pa.array(bucket, pa.int32()), "block": pa.array([key[0].as_py()] * len(got), pa.int32()), "kind": pa.array(kind, pa.int32()), "data": pa.array(data, pa.binary())})

        return run

    replies = spark.createDataFrame([], REPLY)
    for step in ("send1", "send2", "send3"):
        sent = texts().cogroup(replies.groupBy("block")).applyInArrow(sender(step), SENT)
        new = work.keep(sent.groupBy("bucket").applyInArrow(_answer, REPLY), step)
        replies = new if step == "send1" else replies.union(new)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.binary())]).empty_table()
        return Rounds(left.select(["doc_id", "text"]), right, threshold, buckets).result()

    result = work.keep(texts().cogroup(replies.groupBy("block")).applyInArrow(finish, RESULT), "result")
    spark.sql(f"DROP TABLE {name}")
    work.tables.remove(name)
    for step in ("texts", "send1", "send2", "send3"):
        work.drop(step)
    return result
