"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Tokens are maximal runs of letters, digits or other signs, found and hashed in whole-array operations; each token also gives
a shape (kind, case, length, whether it repeats its predecessor). Every hash slot has a fixed sparse random index vector; a
token's vector is its own index vector plus the normalised sum of its neighbours' in the fit sample. A document is
the mean of its tokens' vectors and the shares of its shapes, over the whole text. The network (one hidden layer) is trained
with Adam; a temperature, fitted on rows that the training did not see, calibrates its probabilities.

The fit uses a bounded sample of labelled rows: at most FIT_ROWS texts of at most FIT_CHARS characters, those with the smallest hash of
their id among the rows that the caller allows. Scoring reads every whole text, a quarter of a megabyte at a time; slices end at white space, and
a run of four megabytes without any is divided there.

Defined cases: null text counts as empty; an empty text is a document without tokens and gets a score as any other;
labels that are null or contradict one another for an id are left out; with no usable label, or labels of one kind alone, every score is
that label's (1.0 without any); repeated rows each give a row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, power_table, ship, spread, text_bytes

FIT_ROWS, FIT_CHARS = 6000, 50_000
SLOTS, DIM, NONZERO, REACH = 1 << 14, 32, 4, 2
SHAPES = 4 * 16 * 2
SLICE = 250_000
_R = 0x2545F4914F6CDD1D | 1
_tables: list[tuple[np.ndarray, np.ndarray]] = []
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_CODE = mix(np.arange(1, 257, dtype=U64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, as many as the longest slice so far has needed."""
    if not _tables or len(_tables[-1][0]) < n:
        n = max(n, SLICE + 65_536)
        _tables[:] = [(power_table(_R, n), power_table(pow(_R, -1, 1 << 64), n))]
    return _tables[-1]


def tokens(data: np.ndarray, at: np.ndarray):
    """Yields (document, slot, shape) of the tokens in reading order, a slice at a time. at: starts of documents."""
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + SLICE)
        most = min(n, a + SLICE + 4_000_000)
        while b < most and _CLASS[data[b]]:
            white = _CLASS[data[b : b + 4096]] == 0
            b = min(most, b + (int(np.argmax(white)) if white.any() else 4096))
        part = data[a:b]
        kind = _CLASS[part]
        new = np.ones(len(part), bool)
        new[1:] = kind[1:] != kind[:-1]
        lo, hi = np.searchsorted(at, [a, b])
        new[at[lo:hi][at[lo:hi] < b] - a] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(part))
        keep = kind[start] > 0
        start, end = start[keep], end[keep]
        if len(start):
            total = np.zeros(len(part) + 1, U64)
            power, inverse = _powers(len(part))
            np.cumsum(_CODE[part] * power[: len(part)], out=total[1:])
            h = mix((total[end] - total[start]) * inverse[start])
            doc = np.searchsorted(at, start + a, side="right") - 1
            upper = np.zeros(len(part) + 1, np.int32)
            np.cumsum((part >= 65) & (part < 91), out=upper[1:])
            caps, size = upper[end] - upper[start], end - start
            case = np.where(kind[start] != 1, kind[start].astype(np.int64), np.where(caps * 2 > size, 0, 1))
            again = np.zeros(len(start), np.int64)
            again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
            yield doc, (h & U64(SLOTS - 1)).astype(np.int64), (case * 16 + np.minimum(size, 16) - 1) * 2 + again
        a = b


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(20240501)
    out = np.zeros((SLOTS, DIM), np.float32)
    rows = np.repeat(np.arange(SLOTS), NONZERO)
    out[rows, rng.integers(0, DIM, len(rows))] = rng.choice([-1.0, 1.0], len(rows)) / np.sqrt(NONZERO)
    return out


def word_vectors(texts: pa.Array) -> np.ndarray:
    index = index_vectors()
    context = np.zeros((SLOTS, DIM))
    for doc, slot, _ in tokens(*text_bytes(texts)):
        for d in range(1, REACH + 1):
            near = doc[d:] == doc[:-d]
            x, y = slot[:-d][near], slot[d:][near]
            pair, count = np.unique(np.concatenate([x * SLOTS + y, y * SLOTS + x]), return_counts=True)
            for c in range(DIM):
                context[:, c] += np.bincount(pair // SLOTS, weights=count * index[pair % SLOTS, c], minlength=SLOTS)
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return (index + context / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """One row of features for each text: mean vector, shares of shapes, log of the number of tokens."""
    data, at = text_bytes(texts)
    n = len(at) - 1
    out, count = np.zeros((n, DIM + SHAPES + 1)), np.zeros(n)
    starts = at[:-1]
    for doc, slot, shape in tokens(data, starts):
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        for i in range(0, len(slot), 1 << 16):  # sums by document, in slices that fit a cache
            j = min(len(slot), i + (1 << 16))
            cut = np.unique(np.concatenate([[i], first[(first >= i) & (first < j)]]))
            out[doc[cut], :DIM] += np.add.reduceat(vectors[slot[i:j]], cut - i, axis=0)
        base = doc[0]
        wide = int(doc[-1] - base) + 1
        out[base : base + wide, DIM:-1] += np.bincount((doc - base) * SHAPES + shape, minlength=wide * SHAPES).reshape(wide, SHAPES)
        count[base : base + wide] += np.bincount(doc - base, minlength=wide)
    out[:, :-1] /= np.maximum(count, 1)[:, None]
    out[:, -1] = np.log1p(count)
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(((x - self.shift) / self.scale).clip(-8, 8) @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-(self.logits(pooled(texts, self.vectors)) / self.temperature).clip(-60, 60)))


def train(texts: pa.Array, labels: np.ndarray, hidden: int = 24, epochs: int = 40, seed: int = 5) -> QualityModel:
    if not len(labels) or labels.min() == labels.max():
        return QualityModel(np.zeros((0, 0)), *[np.zeros(0)] * 5, 0.0, 1.0, float(labels[0]) if len(labels) else 1.0)
    vectors = word_vectors(texts)
    x = pooled(texts, vectors)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    shift, scale = x[used].mean(0), x[used].std(0) + 1e-3
    z, y = ((x - shift) / scale).clip(-8, 8), labels.astype(float)
    m = QualityModel(vectors, shift, scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0, 1.0)
    params = [m.w1, m.b1, m.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        for i in np.array_split(rng.permutation(used), max(1, len(used) // 64)):
            h = np.maximum(z[i] @ params[0] + params[1], 0)
            d = (1 / (1 + np.exp(-(h @ params[2] + params[3][0]))) - y[i]) / len(i)
            back = np.outer(d, params[2]) * (h > 0)
            step += 1
            for k, g in enumerate((z[i].T @ back + 1e-4 * params[0], back.sum(0), h.T @ d + 1e-4 * params[2], np.array([d.sum()]))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] -= rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    m.w1, m.b1, m.w2, m.b2 = params[0], params[1], params[2], float(params[3][0])
    if len(held):
        logit, grid = m.logits(x[held]), np.exp(np.linspace(-0.7, 2.5, 65))
        loss = [np.mean(np.logaddexp(0, np.where(y[held] > 0, -1, 1) * logit / t)) for t in grid]
        m.temperature = float(grid[int(np.argmin(loss))])
    return m


def fit_quality(docs: DataFrame, labels: DataFrame, allowed: F.Column | None = None, rows: int = FIT_ROWS) -> QualityModel:
    """allowed: which ids may teach (a condition on doc_id)."""
    clean = labels.filter("doc_id is not null and quality in (0, 1)").filter(F.lit(True) if allowed is None else allowed)
    clean = clean.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("top")).filter("y = top").select("doc_id", "y")
    chosen = clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # at most FIT_ROWS rows: small enough to broadcast
    # Of a longer text a piece of FIT_CHARS teaches, from a place that its id says: what reaches the driver is bounded by rows times FIT_CHARS.
    over = F.length("text") - FIT_CHARS
    piece = F.when(over <= 0, F.col("text")).otherwise(F.expr(f"substring(text, cast(pmod(xxhash64(doc_id), length(text) - {FIT_CHARS}) as int) + 1, {FIT_CHARS})"))
    got = spread(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", piece.alias("text"), "y").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return train(got["text"].combine_chunks() if got.num_rows else pa.array([], pa.string()), got["y"].to_numpy())


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score for every row of docs."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "score": shared.value.score(part["text"])})

    return spread(docs).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: QualityModel, least: float = 0.7) -> DataFrame:
    """The rows of docs whose score is at least ``least``, with all their columns."""
    ship(docs.sparkSession)
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                yield part.filter(pa.array(shared.value.score(part.column(names.index("text"))) >= least))

    return docs.mapInArrow(run, docs.schema)
