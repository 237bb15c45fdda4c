"""Language identification by a byte convolutional network.

Bytes are embedded; filters of widths 2, 3 and 4 slide over a fixed-length window, each filter keeps its largest response in the
window (max pooling), and a softmax layer names the language. The network is trained in numpy on labelled windows. For use, an
embedding and a filter's weights are folded into tables over byte pairs and bytes, so a response is a sum of
table rows: the same convolution without multiplications. Every whole text is cut into windows, the last one padded; the
probabilities of a text's windows are averaged by their length in bytes.

The fit uses a bounded sample: for each language at most FIT_ROWS texts (by hash of the id) and of each FIT_WINDOWS windows spread over it,
and of each text at most FIT_WINDOWS windows, evenly spread.

Defined cases: null text, or one without a letter: ``und`` with score 0; with no labelled row at all every text is ``und``;
repeated rows each give a row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ship, spread, text_bytes

FIT_ROWS, FIT_WINDOWS = 300, 6
LENGTH, EMBED, FILTERS, WIDTHS = 256, 8, 8, (2, 3, 4)
#: Windows that go through the tables together.
CHUNK = 512


def windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts: bytes (zeros where a text ends), the text of each, and its length in bytes."""
    size = np.diff(at)
    n = -(-size // LENGTH)
    text = np.repeat(np.arange(len(size)), n)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * LENGTH
    length = np.minimum(size[text] - start, LENGTH)
    padded = np.concatenate([data, np.zeros(LENGTH, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, LENGTH)
    out = view[at[:-1][text] + start] if len(text) else np.zeros((0, LENGTH), np.uint8)
    short = np.flatnonzero(length < LENGTH)
    if len(short):
        out[short] = np.where(np.arange(LENGTH)[None] < length[short][:, None], out[short], 0)
    return out, text, length


@dataclass
class LanguageModel:
    names: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Responses to the first two bytes (all widths), to the third (width 3), to the last two (width 4)."""
        two = lambda f: ((self.embed @ f[0])[:, None] + (self.embed @ f[1])[None]).reshape(65536, FILTERS)
        w2, w3, w4 = self.filters
        return np.ascontiguousarray(np.concatenate([two(w2[:2]), two(w3[:2]), two(w4[:2])], axis=1), np.float32), np.ascontiguousarray(self.embed @ w3[2], np.float32), two(w4[2:]).astype(np.float32)

    def probabilities(self, win: np.ndarray, tables) -> np.ndarray:
        head, third, tail = tables
        out = np.empty((len(win), len(self.names)))
        for i in range(0, len(win), CHUNK):
            w = win[i : i + CHUNK]
            code = (w[:, :-1].astype(np.int32) << 8) | w[:, 1:]
            z = head[code[:, :-2]]
            z[:, :, FILTERS : 2 * FILTERS] += third[w[:, 2:-1]]
            z[:, :, 2 * FILTERS :] += tail[code[:, 2:]]
            best = np.maximum(z.max(axis=1) + self.bias, 0)
            out[i : i + CHUNK] = softmax(best @ self.out + self.out_bias)
        return out

    def predict(self, texts: pa.Array, tables) -> tuple[list[str], np.ndarray]:
        text_has = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts))
        data, at = text_bytes(texts)
        total, weight = np.zeros((len(texts), len(self.names))), np.zeros(len(texts))
        first = 0
        while first < len(texts):  # about a megabyte of whole texts at a time; a longer text in slices of windows
            last = max(first + 1, int(np.searchsorted(at, at[first] + 1_000_000, side="right")) - 1)
            for a in range(int(at[first]), int(at[last]) or 0, 4096 * LENGTH):
                b = min(int(at[last]), a + 4096 * LENGTH) if last == first + 1 else int(at[last])
                cut = np.array([a, b]) if last == first + 1 else at[first : last + 1]
                win, text, length = windows(data[cut[0] : cut[-1]], cut - cut[0])
                np.add.at(total, first + text, self.probabilities(win, tables) * length[:, None])
                np.add.at(weight, first + text, length)
                if last != first + 1:
                    break
            first = last
        share = total / np.maximum(weight, 1)[:, None]
        best = share.argmax(axis=1)
        score = np.where(text_has, share[np.arange(len(best)), best], 0.0).clip(0, 1)
        return [self.names[b] if t else "und" for b, t in zip(best, text_has, strict=True)], score


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(win: np.ndarray, target: np.ndarray, names: list[str], epochs: int = 6, seed: int = 3) -> LanguageModel:
    if not names:
        return LanguageModel([], *[np.zeros(0)] * 5)
    rng = np.random.default_rng(seed)
    m = LanguageModel(names, rng.normal(0, 0.5, (256, EMBED)), [rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)) for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS), rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(names))), np.zeros(len(names)))
    m.embed[0] = 0
    params = [m.embed, *m.filters, m.bias, m.out, m.out_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs) + 1e-3
        for rows in np.array_split(rng.permutation(len(win)), max(1, len(win) // 64)):
            w = win[rows]
            x = m.embed[w]
            pooled, places = [], []
            for f in m.filters:
                k = len(f)
                z = sum(x[:, j : LENGTH - 3 + j] @ f[j] for j in range(k))  # the same places for every width
                at = z.argmax(axis=1)
                pooled.append(np.take_along_axis(z, at[:, None], 1)[:, 0])
                places.append(at)
            pre = np.concatenate(pooled, axis=1) + m.bias
            h = np.maximum(pre, 0)
            d = softmax(h @ m.out + m.out_bias)
            d[np.arange(len(rows)), target[rows]] -= 1
            d /= len(rows)
            back = (d @ m.out.T) * (pre > 0)
            grads = [np.zeros_like(p) for p in params]
            for i, f in enumerate(m.filters):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(len(f)):
                    seen = w[np.arange(len(rows))[:, None], places[i] + j]  # the byte at each filter's best place
                    grads[1 + i][j] = np.einsum("nfe,nf->ef", m.embed[seen], g)
                    np.add.at(grads[0], seen, g[:, :, None] * f[j].T[None])
            grads[-3], grads[-2], grads[-1] = back.sum(0), h.T @ d + 1e-4 * m.out, d.sum(0)
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] -= rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m


def fit_language(docs: DataFrame, allowed: F.Column | None = None, rows: int = FIT_ROWS) -> LanguageModel:
    """allowed: which ids may teach (a condition on doc_id)."""
    usable = docs.select("doc_id", "lang", F.length("text").alias("n")).filter("doc_id is not null and lang is not null").filter("n > 0").filter(F.lit(True) if allowed is None else allowed).select("doc_id", "lang")
    # A share of each language's hashes that holds about four times the rows wanted, so that ranking never gathers a whole language.
    share = usable.groupBy("lang").agg((F.lit(4.0 * rows) / F.count("*")).alias("share"))  # one row for each language
    few = usable.join(F.broadcast(share), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = few.select("doc_id", rank.alias("k")).filter(F.col("k") <= rows).select("doc_id").distinct()  # at most FIT_ROWS for each language
    some = docs.select("doc_id", "text", "lang").filter("lang is not null and length(text) > 0").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "lang")
    ship(docs.sparkSession)
    got = some.mapInArrow(_fit_windows, "doc_id long, lang string, place long, window binary").toArrow()  # at most FIT_WINDOWS short windows of each text
    got = got.sort_by([(c, "ascending") for c in ("doc_id", "place", "window")])
    if not got.num_rows:
        return train(np.zeros((0, LENGTH), np.uint8), np.zeros(0, np.int64), [])
    names = sorted(set(got["lang"].to_pylist()))
    win = np.frombuffer(b"".join(got["window"].to_pylist()), np.uint8).reshape(-1, LENGTH)
    return train(win, np.array([names.index(x) for x in got["lang"].to_pylist()]), names)


def _fit_windows(batches):
    """FIT_WINDOWS windows of each text, spread over the whole of it."""
    for batch in batches:
        for a in range(0, len(batch), 100):
            part = batch.slice(a, 100)
            win, text, _ = windows(*text_bytes(part["text"]))
            n = np.bincount(text, minlength=len(part))
            place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
            step = np.maximum(1, n // FIT_WINDOWS)[text]
            pick = np.flatnonzero((place % step == 0) & (place // step < FIT_WINDOWS))
            row = pa.array(text[pick])
            yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"].take(row), "lang": part["lang"].take(row), "place": place[pick], "window": pa.array([w.tobytes() for w in win[pick]], pa.binary())})


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        tables = shared.value.tables() if shared.value.names else None
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                names, score = shared.value.predict(part["text"], tables)
                yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "lang_pred": pa.array(names, pa.string()), "score": score})

    return spread(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
