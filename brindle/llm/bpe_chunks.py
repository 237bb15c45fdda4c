"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts every text into chunks whose borders depend on nearby content alone, so texts
that share a passage share its chunks wherever it stands. Each distinct chunk of a batch is encoded once and its ids
reused. A cut may fall inside a pre-token; then the ids at the join are wrong. Every join is therefore repaired: the
ids left of the last safe border before it and right of the first safe border after it are kept, and the text between is
encoded anew together with the unit on either side. The window widens until both its edges are borders of ids and the new ids of the
units beside it are those that are kept. A border is safe where white space follows another character: no pre-token spans it and
nothing to its left changes what follows.

Defined cases: null text counts as empty and gives no ids; ids of special tokens appear where the library puts them;
repeated rows each give a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Decoder, Encoder, encoder, ragged, tokenizer_path
from .common import U64, mix, ship, spread, text_bytes

#: Bytes that the rolling hash sees, and a chunk's mean length (a power of two).
WINDOW, MEAN = 16, 512
#: How far a border may move to reach white space.
NEAR = 48
_R = 0x2545F4914F6CDD1D | 1
_BYTE = mix(np.arange(1, 257, dtype=U64))
_decoders: dict[str, Decoder] = {}


def cuts(data: np.ndarray, at: np.ndarray, safe: np.ndarray) -> np.ndarray:
    """Sorted chunk borders in a buffer of texts: rolling-hash borders between characters, and all text borders."""
    n = len(data)
    inner = np.zeros(0, np.int64)
    if n > WINDOW:
        roll, size = _BYTE[data], 1
        while size < WINDOW:  # hash of 2m bytes from two hashes of m bytes
            roll = roll[: len(roll) - size] * U64(pow(_R, size, 2**64)) + roll[size:]
            size *= 2
        inner = np.flatnonzero((mix(roll) & U64(MEAN - 1)) == 0) + WINDOW
        inner = inner[inner < n]
        inner = inner[(data[inner] & 0xC0) != 0x80]
        own = np.searchsorted(at, inner, side="right") - 1
        own_at = at[own]
        inner, own = inner[inner - own_at >= WINDOW], own[inner - own_at >= WINDOW]  # a border sees only bytes of its own text
        if len(safe):  # move to a safe border that follows closely, so that few joins fall inside a pre-token
            k = np.minimum(np.searchsorted(safe, inner), len(safe) - 1)
            inner = np.where((safe[k] >= inner) & (safe[k] <= inner + NEAR) & (safe[k] < at[own + 1]), safe[k], inner)
    return np.unique(np.concatenate([inner, at]))


def safe_borders(data: np.ndarray) -> np.ndarray:
    """safe[i]: white space (space or line feed) at i follows another character."""
    white = (data == 32) | (data == 10)
    safe = np.zeros(len(data) + 1, bool)
    safe[1:-1] = white[1:] & ~((data[:-1] <= 32) | (data[:-1] >= 0x80) & _tail_space(data)[:-1])
    return safe


def _tail_space(data: np.ndarray) -> np.ndarray:
    """Whether the byte may end a wide white-space character (C2 85, C2 A0, E1 9A 80, E2 80 xx, E2 81 9F, E3 80 80)."""
    out = np.zeros(len(data), bool)
    if len(data) > 1:
        out[1:] = (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
        out[2:] |= ((data[:-2] == 0xE2) & (data[1:-1] <= 0x81)) | ((data[:-2] == 0xE3) & (data[1:-1] == 0x80)) | ((data[:-2] == 0xE1) & (data[1:-1] == 0x9A))
    return out


def encode_chunks(enc: Encoder, sizes: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int, int]:
    """ids and starts as the library gives them, the number of chunks and of those that had to be encoded.

    sizes: bytes of each id. Texts that hold a special token's string are encoded whole.
    """
    import pyarrow.compute as pc

    odd = pc.match_substring_regex(texts, "<\\|").to_numpy(zero_copy_only=False)
    plain = texts.filter(pa.array(~odd)) if odd.any() else texts
    data, at = text_bytes(plain)
    safe = np.flatnonzero(safe_borders(data))
    border = cuts(data, at, safe)
    chunks = pa.Array.from_buffers(pa.large_string(), len(border) - 1, [None, pa.py_buffer(border.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]) if len(border) > 1 else pa.array([], pa.large_string())
    coded = pc.dictionary_encode(chunks.cast(pa.string()))
    flat, starts = enc.column(coded.dictionary)
    ids, id_at = ragged(flat, starts, coded.indices.to_numpy())
    # Joins: all borders between chunks that are not borders of texts.
    joins = np.setdiff1d(border, at, assume_unique=False)
    if len(joins):
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(sizes[ids], out=ends[1:])  # where each id's bytes start in the buffer
        own = np.searchsorted(at, joins, side="right") - 1
        first, last = at[own], at[own + 1]
        k = np.searchsorted(safe, joins, side="right") - 1
        left = np.where((k >= 0) & (safe[np.maximum(k, 0)] > first), safe[np.maximum(k, 0)], first)
        k = np.searchsorted(safe, joins, side="left")
        right = np.where((k < len(safe)) & (safe[np.minimum(k, len(safe) - 1)] < last), safe[np.minimum(k, len(safe) - 1)], last) if len(safe) else last
        left = np.where(len(safe) > 0, left, first)
        left, right = _merge(left, right, at)
        while True:  # until every window's edges are borders of ids and what was encoded anew beyond them agrees with what is kept
            bad = (ends[np.searchsorted(ends, left)] != left) | (ends[np.searchsorted(ends, right)] != right)
            if not bad.any():
                lo, hi = _wider(left, right, at, safe)
                lo, hi = (np.where(ends[np.searchsorted(ends, x)] == x, x, y) for x, y in ((lo, left), (hi, right)))
                n_ids, n_at = _encode_windows(enc, data, lo, hi)
                before, behind = (np.searchsorted(ends, y) - np.searchsorted(ends, x) for x, y in ((lo, left), (right, hi)))
                fits = before + behind <= np.diff(n_at)
                before, behind = np.where(fits, before, 0), np.where(fits, behind, 0)
                bad = ~fits | _differ(ids, np.searchsorted(ends, lo), n_ids, n_at[:-1], before) | _differ(ids, np.searchsorted(ends, right), n_ids, n_at[1:] - behind, behind)
                if not bad.any():
                    break
            more_left, more_right = _wider(left, right, at, safe)
            left, right = _merge(np.where(bad, more_left, left), np.where(bad, more_right, right), at)
        if len(left):
            a, b = np.searchsorted(ends, left), np.searchsorted(ends, right)
            # Kept ids and new ids in turn: kept up to a[0], new 0, kept b[0]..a[1], new 1, ...
            pool = np.concatenate([ids, n_ids])
            lo, hi = np.empty(2 * len(left) + 1, np.int64), np.empty(2 * len(left) + 1, np.int64)
            lo[0::2], hi[0::2] = np.concatenate([[0], b]), np.concatenate([a, [len(ids)]])
            lo[1::2], hi[1::2] = len(ids) + n_at[:-1] + before, len(ids) + n_at[1:] - behind
            size = hi - lo
            pos = np.zeros(len(size) + 1, np.int64)
            np.cumsum(size, out=pos[1:])
            ids = pool[np.repeat(lo - pos[:-1], size) + np.arange(pos[-1])]
    ends = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(sizes[ids], out=ends[1:])
    starts = np.searchsorted(ends, at)
    n_chunks, n_new = len(chunks), len(coded.dictionary)
    if odd.any():
        slow, slow_at = enc.whole(texts.filter(pa.array(odd)).to_pylist())
        order = np.empty(len(texts), np.int64)
        order[~odd], order[odd] = np.arange((~odd).sum()), (~odd).sum() + np.arange(odd.sum())
        ids, starts = ragged(np.concatenate([ids, slow]), np.concatenate([starts, slow_at[1:] + len(ids)]), order)
    return ids, starts, n_chunks, n_new


def _merge(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a text that touch or overlap become one, empty ones go; both arrays ascend."""
    some = left < right
    left, right = left[some], right[some]
    new = np.ones(len(left), bool)
    reach = np.maximum.accumulate(right)[:-1]
    new[1:] = (left[1:] > reach) | (left[1:] == reach) & (at[np.searchsorted(at, left[1:])] == left[1:])
    k = np.flatnonzero(new)
    return left[k], np.maximum.reduceat(right, k) if len(k) else right


def _wider(left: np.ndarray, right: np.ndarray, at: np.ndarray, safe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each window up to the safe borders before and behind it, but not beyond its text."""
    own = np.maximum(np.searchsorted(at, right, side="left") - 1, 0)
    if not len(safe):
        return at[own], at[own + 1]
    k, j = np.searchsorted(safe, left, side="left") - 1, np.searchsorted(safe, right, side="right")
    return np.where((k >= 0) & (safe[k] > at[own]), safe[k], at[own]), np.where((j < len(safe)) & (safe[np.minimum(j, len(safe) - 1)] < at[own + 1]), safe[np.minimum(j, len(safe) - 1)], at[own + 1])


def _encode_windows(enc: Encoder, data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids of parts of the buffer, which may overlap; equal parts are encoded once."""
    import pyarrow.compute as pc

    flat, starts = ragged(data, *_ranges(lo, hi))
    whole = pa.Array.from_buffers(pa.large_string(), len(lo), [None, pa.py_buffer(starts), pa.py_buffer(flat)]) if len(lo) else pa.array([], pa.large_string())
    new = pc.dictionary_encode(whole.cast(pa.string()))
    return ragged(*enc.column(new.dictionary), new.indices.to_numpy())


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges as lists for ``ragged``: borders of all ranges and gaps in turn, and the numbers of the ranges."""
    edge = np.empty(2 * len(lo), np.int64)
    edge[0::2], edge[1::2] = lo, hi
    return edge, np.arange(0, 2 * len(lo), 2)


def _differ(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the pairs of ranges of one size each hold different ids."""
    x, _ = ragged(a, *_ranges(a_at, a_at + size))
    y, _ = ragged(b, *_ranges(b_at, b_at + size))
    return np.bincount(np.repeat(np.arange(len(size)), size)[x != y], minlength=len(size)) > 0


def decoder(path: str) -> Decoder:
    """This process's decoder for a file."""
    if path not in _decoders:
        _decoders[path] = Decoder(path)
    return _decoders[path]


def byte_sizes(path: str) -> np.ndarray:
    return np.diff(decoder(path).at)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chunks long"


def bpe_round_trip(docs: DataFrame, name: str = "byte_bpe_50k.json", folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each row of docs: digests of ids and of the decoded text; with_ids adds ids (array of int) and text."""
    ship(docs.sparkSession)
    path = tokenizer_path(name, folder)

    def run(batches):
        import pyarrow.compute as pc

        enc, dec, sizes = encoder(path, True), decoder(path), byte_sizes(path)
        for batch in batches:
            total = np.concatenate([[0], np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64))])
            at = 0
            for i in range(len(batch)):
                if i + 1 < len(batch) and total[i + 1] - total[at] < 12_000_000:
                    continue
                part = batch.slice(at, i + 1 - at)
                at = i + 1
                ids, starts, n_chunks, _ = encode_chunks(enc, sizes, part["text"])
                raw, _ = dec.raw(ids)
                ends = np.zeros(len(ids) + 1, np.int64)
                np.cumsum(sizes[ids], out=ends[1:])
                plain, words = raw.tobytes(), ids.astype("<u4").tobytes()
                of = ends[starts]
                decoded = [plain[of[k] : of[k + 1]].decode("utf-8", errors="replace") for k in range(len(part))]
                out = {
                    "doc_id": part["doc_id"], "n_tokens": np.diff(starts),
                    "ids_sha256": [hashlib.sha256(words[4 * starts[k] : 4 * starts[k + 1]]).hexdigest() for k in range(len(part))],
                    "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in decoded], "n_chunks": np.full(len(part), n_chunks),
                }
                if with_ids:
                    out |= {"ids": pa.array([ids[starts[k] : starts[k + 1]].astype(np.int32) for k in range(len(part))], pa.list_(pa.int32())), "text": decoded}
                yield pa.RecordBatch.from_pydict(out)

    return spread(docs).mapInArrow(run, SCHEMA + (", ids array<int>, text string" if with_ids else ""))
