"""SimHash near-dedup with pivot distance tables.

Fingerprints: XXH64 (seed 42) of every 4-word shingle; a bit is set if more than half the hashes set it. Equal fingerprints
collapse to one node, named by their smallest doc_id, so copies cost nothing further.

Candidates: two fingerprints at most 4 bits apart agree on at least ``blocks - 4`` of ``blocks`` bit blocks, hence they meet in
one of the groups keyed by that many blocks. Within a group, each fingerprint has a row of Hamming distances to PIVOTS
reference fingerprints; as a distance to a reference changes by no more than the distance between two fingerprints, a pair
whose rows differ by more than 4 in any coordinate is discarded, and only survivors are compared. More blocks make more keys
and smaller groups; the number follows the count of nodes and never changes the result.

Large groups (many fingerprints close together) are not expanded into pairs: a search from the smallest doc_id takes the
whole neighbourhood out of the group in one array operation and goes on from there, so each node is linked once. Links form a star
for each local component; components across groups come from alternating large-star and small-star steps on tables in the
shared folder. No links or fingerprints reach the driver.

Defined cases: null and empty texts have fingerprint zero and link like any other; fewer than 4 words: the whole sequence is the
one shingle; repeated rows each give a row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Work, mix, spread

PIVOTS = 24
_PIVOT = mix(np.arange(1, PIVOTS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
#: Fingerprints side by side for similarity by shingles, their bits that may differ at a similarity of 0.8 (78 of 512 do on average), and minima.
WIDE, DIFFERING, MINIMA = 8, 86, 5
_WIDE = mix(np.arange(1, WIDE + 1, dtype=U64) * U64(0xBF58476D1CE4E5B9))
_MINIMA = mix(np.arange(1, MINIMA + 1, dtype=U64) * U64(0x94D049BB133111EB))
_WIDE_PIVOT = mix(np.arange(1, 4 * WIDE + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)).reshape(4, WIDE)
#: Groups up to this size are compared by shifted arrays, all groups of a batch at once.
SMALL = 8


def fingerprint(text: bytes, words: int = 4) -> int:
    hashes = shingle_hashes(text, words)
    if not len(hashes):
        return 0
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 50_000):
        count += np.unpackbits(hashes[i : i + 50_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view("<u8")[0])


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, in text order; fewer words: the whole sequence; none: no hash."""
    import xxhash

    parts = text.lower().split()
    if not parts:
        return np.zeros(0, U64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(parts))
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], 42) for a, b in zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], U64)


def wide_fingerprint(text: bytes, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The set of shingles as WIDE 64-bit fingerprints side by side, and its least hash by each of MINIMA mixings."""
    hashes = np.unique(shingle_hashes(text, words))
    if not len(hashes):
        return np.zeros(WIDE, U64), np.zeros(MINIMA, U64)
    count = np.zeros(64 * WIDE, np.int64)
    for i in range(0, len(hashes), 8192):
        mixed = mix(hashes[i : i + 8192, None] ^ _WIDE[None])
        count += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    least = np.array([mix(hashes ^ c).min() for c in _MINIMA], U64)
    return np.packbits(count * 2 > len(hashes), bitorder="little").view("<u8").astype(U64), least


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(x.as_buffer().to_pybytes(), words) for x in batch["text"].cast(pa.binary())], U64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "fp": fp.view(np.int64)})

    return spread(docs).mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int, bits: int = 4) -> list[int]:
    """Masks of every choice of blocks - bits blocks, as signed longs."""
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edge, edge[1:], strict=False)]
    out = [sum(c) for c in combinations(block, blocks - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _differ(a: np.ndarray) -> np.ndarray:
    """Set bits of each row."""
    count = np.bitwise_count(a)
    return count if count.ndim == 1 else count.sum(axis=-1, dtype=np.int16)


def distance_table(fp: np.ndarray) -> np.ndarray:
    if fp.ndim == 2:
        return np.stack([_differ(fp ^ p) for p in _WIDE_PIVOT], axis=1)
    return np.bitwise_count(fp[:, None] ^ _PIVOT[None]).astype(np.int8)


def near(fp: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray | int, bits: int) -> np.ndarray:
    """Which pairs are linked: few pivots first, then all, then the fingerprints themselves."""
    ok = np.ones(len(a), bool)
    for lo, hi in ((0, 4), (4, PIVOTS)):
        i = np.flatnonzero(ok)
        j = b[i] if isinstance(b, np.ndarray) else b
        ok[i] = (np.abs(table[a[i], lo:hi] - table[j, lo:hi]) <= bits).all(axis=1)
    i = np.flatnonzero(ok)
    ok[i] = _differ(fp[a[i]] ^ fp[b[i] if isinstance(b, np.ndarray) else b]) <= bits
    return ok


def star_links(fp: np.ndarray, table: np.ndarray, bits: int) -> list[tuple[np.ndarray, int]]:
    """Links of one group's components, each a star around its first member."""
    out, left = [], np.arange(len(fp))
    while len(left) > 1:
        seed, left = int(left[0]), left[1:]
        front = [seed]
        while front and len(left):
            x = front.pop()
            hit = near(fp, table, left, x, bits)
            if hit.any():
                got = left[hit]
                out.append((got, seed))
                front += got.tolist()
                left = left[~hit]
    return out


def _link_groups(bits: int):
    def links(key: np.ndarray, fp: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        """All rows of some keys, sorted by key and node."""
        new = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.flatnonzero(new)
        size = np.diff(np.concatenate([start, [len(key)]]))
        group = np.repeat(np.arange(len(start)), size)
        many = size[group] > 1
        fp, node, group = fp[many], node[many], group[many]
        table = distance_table(fp)
        u, v = [], []
        small = size[group] <= SMALL
        for d in range(1, SMALL):
            i = np.flatnonzero((group[:-d] == group[d:]) & small[d:]) if len(group) > d else np.zeros(0, np.int64)
            if not len(i):
                break
            ok = near(fp, table, i, i + d, bits)
            u.append(node[i[ok] + d])
            v.append(node[i[ok]])
        for g in np.unique(group[~small]):
            a, b = np.searchsorted(group, [g, g + 1])
            for got, seed in star_links(fp[a:b], table[a:b], bits):
                u.append(node[a:b][got])
                v.append(np.full(len(got), node[a + seed]))
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (u, v))
        return pa.RecordBatch.from_pydict({"u": u, "v": v})

    def run(batches):
        """Rows come sorted by key; a key's rows may span batches, and only the last key's rows wait."""
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not len(batch):
                continue
            fp = batch["fp"]
            fp = np.frombuffer(b"".join(fp.to_pylist()), "<u8").reshape(len(batch), -1).astype(U64) if pa.types.is_binary(fp.type) else fp.to_numpy()
            cols = batch["key"].to_numpy(), fp, batch["node"].to_numpy()
            cut = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
            if cut:
                ready = [*held, tuple(c[:cut] for c in cols)]
                yield links(*_whole(ready))
                held = []
            elif held and held[0][0][0] != cols[0][0]:
                yield links(*_whole(held))
                held = []
            held.append(tuple(c[cut:] for c in cols))
        if held:
            yield links(*_whole(held))

    return run


def _whole(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, fp, node = (np.concatenate(x) for x in zip(*parts, strict=True))
    return key, fp.view(U64), node


def links(nodes: DataFrame, bits: int = 4, blocks: int | None = None, n: int | None = None) -> DataFrame:
    """nodes: fp, node (unique). u > v: links that connect every component (not all pairs)."""
    if blocks is None:
        n = nodes.count() if n is None else n
        blocks = bits + (2 if n < 1 << 24 else 3 if n < 1 << 30 else 4)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(block_masks(blocks, bits))])
    return _linked(nodes.select("fp", "node", F.explode(keys).alias("key")), bits)


def _linked(rows: DataFrame, bits: int) -> DataFrame:
    """rows: key, fp, node. Links within each key."""
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_link_groups(bits), "u long, v long").filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, work: Work) -> DataFrame:
    """edges u > v. node, component (smallest reachable), for nodes that have a link."""
    edges, before, step = work.keep(edges, "links-0"), None, 0
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before, step = now, step + 1
        both = edges.union(edges.select("v", "u")).toDF("node", "other")
        least = both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("low"))
        large = both.filter("other > node").join(least, "node").select(F.col("other").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = work.keep(small, f"links-{step}")
        work.drop(f"links-{step - 1}")


def near_groups(docs: DataFrame, bits: int = 4, words: int = 4) -> DataFrame:
    """doc_id, fp, component_id: one row for each row of docs."""
    work = Work(docs.sparkSession, "simhash")
    rows = work.keep(fingerprints(docs, words), "fingerprints")
    nodes = work.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("node")).filter("node is not null"), "nodes")
    found = components(links(nodes, bits), work)
    labels = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return rows.join(labels, "fp", "left").select("doc_id", "fp", "component_id")


def similar_groups(docs: DataFrame, words: int = 5, differing: int = DIFFERING) -> DataFrame:
    """doc_id, component_id: one row for each row of docs, linked by the similarity of their sets of ``words``-word shingles.

    Two texts link if at least two of MINIMA least hashes agree (at a similarity of 0.8: 99 of 100 pairs) and at most ``differing`` of the 512
    bits differ, which estimates a similarity of some 0.76 or more with a standard deviation of 0.03. Candidates meet in groups keyed by two
    least hashes, so a passage that many texts share brings together only texts that have both least hashes in it.
    """
    work = Work(docs.sparkSession, "similar")

    def run(batches):
        for batch in batches:
            fp, least = [], []
            for x in batch["text"].cast(pa.binary()):
                a, b = wide_fingerprint(x.as_buffer().to_pybytes(), words)
                fp.append(a.astype("<u8").tobytes())
                least.append(b.view(np.int64))
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "fp": pa.array(fp, pa.binary()), "least": pa.array(least, pa.list_(pa.int64()))})

    rows = work.keep(spread(docs).mapInArrow(run, "doc_id long, fp binary, least array<long>"), "fingerprints")
    nodes = work.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("node"), F.min("least").alias("least")).filter("node is not null"), "nodes")
    keys = F.array(*[F.xxhash64(F.lit(i), F.get("least", F.lit(a)), F.get("least", F.lit(b))) for i, (a, b) in enumerate(combinations(range(MINIMA), 2))])
    found = components(_linked(nodes.select("fp", "node", F.explode(keys).alias("key")), differing), work)
    labels = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return rows.join(labels, "fp", "left").select("doc_id", "component_id")


def simhash_table(docs: DataFrame) -> DataFrame:
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
