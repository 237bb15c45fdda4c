"""Exact ids of the public byte-pair tokenizers at corpus speed.

The tokenizers library defines every id. What is saved is repetition: a text is cut where no pre-token can span
(before white space that follows other characters), each piece between two cuts is a *unit*, and each distinct
unit of a batch is encoded once. Cutting, finding the distinct units and putting the ids of a text together are
whole-array operations. Plain units go through a rank table made from the vocabulary's own merges; it is checked
against the library when a worker starts and left unused if any id differs. All other units, and whole texts for
which the cut is not safe (longer runs of white space, special tokens), are encoded by the library.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import text_bytes

#: Bytes of text that are cut and encoded together: bounds a worker's memory.
PIECE_BYTES = 12_000_000
CUT = "\x1f"
#: White space other than space and line feed, as the pre-tokenizer's pattern sees it, and the cut mark.
OTHER_SPACE = r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LETTERS = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]"
MARKS = r"[.,;:!?*$%&#|]"

_encoders: dict[tuple[str, bool], Encoder] = {}


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Where a public vocabulary file lies: a folder given, or the installed package."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(path)
    tk.no_truncation()
    tk.no_padding()
    return tk


def encoder(path: str, spaced: bool) -> Encoder:
    """This process's encoder for a file; it lives as long as the worker."""
    if (path, spaced) not in _encoders:
        _encoders[path, spaced] = Encoder(path, spaced)
    return _encoders[path, spaced]


def ragged(flat: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists that index names, one after the other, and where each starts."""
    sizes = (offsets[1:] - offsets[:-1])[index]
    starts = np.zeros(len(index) + 1, np.int64)
    np.cumsum(sizes, out=starts[1:])
    at = np.repeat(offsets[:-1][index] - starts[:-1], sizes)
    at += np.arange(len(at))
    return flat[at], starts


def _lists(got: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(got) + 1, np.int64)
    np.cumsum([len(x) for x in got], out=offsets[1:])
    flat = np.fromiter((i for x in got for i in x), np.uint32, int(offsets[-1]))
    return flat, offsets


def _join(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    offsets, base = [np.zeros(1, np.int64)], 0
    for flat, o in parts:
        offsets.append(o[1:] + base)
        base += len(flat)
    return np.concatenate([f for f, _ in parts] or [np.zeros(0, np.uint32)]), np.concatenate(offsets)


class Encoder:
    """spaced: white space is part of the ids (byte-level); else it only separates words, which end with a mark."""

    def __init__(self, path: str, spaced: bool):
        self.tk, self.spaced = load(path), spaced
        special = "|".join(pc_escape(t.content) for t in self.tk.get_added_tokens_decoder().values())
        self.odd = (rf"{OTHER_SPACE}|[ \n][ \n][ \n]|[ \n][ \n]\z|{special}" if spaced else special) or r"[^\s\S]"
        self.fast = self._spaced_table(path) if spaced else self._word_table(path)
        if not self._agrees():
            self.fast = None

    # -- rank tables ---------------------------------------------------------------------------

    def _spaced_table(self, path: str):
        import tiktoken

        vocab = json.loads(open(path, encoding="utf-8").read())["model"]["vocab"]
        chars = byte_chars()
        ranks = {bytes(chars[c] for c in t): i for t, i in vocab.items()}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        table = tiktoken.Encoding("spaced", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        sizes = np.zeros(max(vocab.values()) + 1, np.int64)
        for b, i in ranks.items():
            sizes[i] = len(b)
        return table, sizes

    def _word_table(self, path: str):
        """Symbols are (byte, last in its word) pairs; each becomes one two-byte character of the table's alphabet, made by the lowest ranks."""
        import tiktoken

        model = json.loads(open(path, encoding="utf-8").read())["model"]
        vocab, end, chars = model["vocab"], model["end_of_word_suffix"], byte_chars()
        ranks: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        ids = [-1] * 256
        singles, longer = [], []
        for t, i in vocab.items():
            done = t.endswith(end)
            raw = [chars.get(c) for c in (t[: -len(end)] if done else t)]
            if raw and None not in raw:
                (singles if len(raw) == 1 else longer).append((i, "".join(chr(0x100 + b) for b in raw[:-1]) + chr((0x200 if done else 0x100) + raw[-1]), done))
        for i, name, _ in sorted(singles) + sorted(longer):
            ranks[name.encode()] = len(ids)
            ids.append(i)
        last = np.zeros(len(ids), bool)
        for _, name, done in singles + longer:
            last[ranks[name.encode()]] = done
        table = tiktoken.Encoding("words", pat_str=r"[^ ]+", mergeable_ranks=ranks, special_tokens={})
        return table, np.array(ids, np.int64), last

    def _agrees(self) -> bool:
        vocab = [t for t in self.tk.get_vocab() if t.isalpha() and t.isascii()]
        rows = np.random.default_rng(7).permutation(sorted(vocab))[:1500]
        words = ["".join(rows[i : i + 3]) for i in range(0, len(rows), 3)] + ["über", "éèçanous", "façade", "niño", "straße", "a", "é"]
        words = [" " + w for w in words] if self.spaced else [w.lower() for w in words]
        flat, at = (self._spaced if self.spaced else self._words)(pa.array(words))
        slow, slow_at = self.whole(words)
        return np.array_equal(flat, slow) and np.array_equal(at, slow_at)

    def _spaced(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        """Units that start with white space and end with something else, encoded as one text."""
        table, sizes = self.fast
        data, at = text_bytes(units)
        ids = table.encode_to_numpy(data.tobytes().decode(), disallowed_special=())
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(sizes[ids], out=ends[1:])
        where = np.searchsorted(ends, at)
        if not np.array_equal(ends[where], at):
            return None
        return ids.astype(np.uint32), where

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        table, ids, last = self.fast
        data, at = text_bytes(words)
        code = data.astype(np.int32) + 0x100
        code[at[1:] - 1] += 0x100
        place = np.arange(len(data)) * 2 + np.repeat(np.arange(len(words)), np.diff(at))
        out = np.full(2 * len(data) + len(words), 32, np.uint8)
        out[place], out[place + 1] = 0xC0 | (code >> 6), 0x80 | (code & 63)
        got = table.encode_to_numpy(out.tobytes().decode(), disallowed_special=())
        ends = np.flatnonzero(last[got]) + 1
        if len(ends) != len(words) or (ids[got] < 0).any():
            return None
        return ids[got].astype(np.uint32), np.concatenate([[0], ends])

    # -- encoding -----------------------------------------------------------------------------

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """By the library, text by text."""
        parts = []
        for i in range(0, len(texts), 64):
            parts.append(_lists([e.ids for e in self.tk.encode_batch_fast(texts[i : i + 64], add_special_tokens=False)]))
        return _join(parts)

    def column(self, texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, one after the other, and where each text's ids start; null counts as empty."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        texts = pc.fill_null(texts.cast(pa.string()), "")
        size = pc.binary_length(texts).to_numpy().astype(np.int64)
        parts, at, so_far = [], 0, 0
        for i, n in enumerate(size):
            so_far += n
            if so_far > PIECE_BYTES or i == len(size) - 1:
                parts.append(self._some(texts.slice(at, i + 1 - at)))
                at, so_far = i + 1, 0
        return _join(parts)

    def _some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        plain = texts if not odd.any() else texts.filter(pa.array(~odd))
        if self.spaced:
            cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(plain, " ", CUT + " "), "\n", CUT + "\n"), CUT)
        else:
            cut = pc.ascii_split_whitespace(plain)
        per_text = cut.offsets.to_numpy().astype(np.int64)
        units = pc.dictionary_encode(cut.flatten())
        flat, at = self._units(units.dictionary)
        flat, starts = ragged(flat, at, units.indices.to_numpy())
        starts = starts[per_text - per_text[0]]
        if not odd.any():
            return flat, starts
        slow, slow_at = self.whole(texts.filter(pa.array(odd)).to_pylist())
        order = np.empty(len(texts), np.int64)
        order[~odd], order[odd] = np.arange((~odd).sum()), (~odd).sum() + np.arange(odd.sum())
        return ragged(*_join([(flat, starts), (slow, slow_at)]), order)

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of distinct units."""
        n = len(units)
        if not n or self.fast is None:
            return self.whole(units.to_pylist())
        if self.spaced:
            fit = pc.match_substring_regex(units, r"\A[ \n](?s:.*)[^ \n]\z").to_numpy(zero_copy_only=False)
            return self._two(units, fit, self._spaced)
        parts = pc.extract_regex(units, rf"\A(?P<word>{LETTERS}+)(?P<marks>{MARKS}*)\z")
        fit = pc.is_valid(parts).to_numpy(zero_copy_only=False)
        parts = parts.filter(pa.array(fit))
        word, marks = pc.dictionary_encode(pc.utf8_lower(pc.struct_field(parts, "word"))), pc.dictionary_encode(pc.struct_field(parts, "marks"))
        words = self._words(word.dictionary) if len(word.dictionary) else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        if words is None:
            words = self.whole(word.dictionary.to_pylist())
        flat, at = _join([words, self.whole(marks.dictionary.to_pylist()), self.whole(units.filter(pa.array(~fit)).to_pylist())])
        a, b = len(word.dictionary), len(word.dictionary) + len(marks.dictionary)
        pair = np.empty(n + int(fit.sum()), np.int64)  # a word and its marks, or a unit as a whole
        ends = np.cumsum(1 + fit)
        pair[ends[fit] - 2], pair[ends[fit] - 1], pair[ends[~fit] - 1] = word.indices.to_numpy(), a + marks.indices.to_numpy(), b + np.arange((~fit).sum())
        flat, starts = ragged(flat, at, pair)
        return flat, starts[np.concatenate([[0], ends])]

    def _two(self, units: pa.Array, fit: np.ndarray, quick) -> tuple[np.ndarray, np.ndarray]:
        some = units.filter(pa.array(fit))
        got = quick(some) if len(some) else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        if got is None:
            got = self.whole(some.to_pylist())
        order = np.empty(len(units), np.int64)
        order[fit], order[~fit] = np.arange(fit.sum()), fit.sum() + np.arange((~fit).sum())
        return ragged(*_join([got, self.whole(units.filter(pa.array(~fit)).to_pylist())]), order)


class Decoder:
    """decode(ids, skip_special_tokens=False) of a byte-level vocabulary, from a table of bytes."""

    def __init__(self, path: str):
        tk, chars = load(path), byte_chars()
        added = {i: t.content for i, t in tk.get_added_tokens_decoder().items()}
        table = [added[i].encode() if i in added else bytes(chars[c] for c in tk.id_to_token(i) or "") for i in range(tk.get_vocab_size(with_added_tokens=True))]
        self.flat, self.at = np.frombuffer(b"".join(table), np.uint8), np.zeros(len(table) + 1, np.int64)
        np.cumsum([len(x) for x in table], out=self.at[1:])

    def raw(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and where each id's bytes start."""
        return ragged(self.flat, self.at, ids)

    def text(self, ids: np.ndarray) -> str:
        return self.raw(ids)[0].tobytes().decode("utf-8", errors="replace")


def pc_escape(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in text)


def byte_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
