"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Score of a document with features x:  w0 + sum_j w_j x_j
+ 1/2 sum_f ((sum_j v_jf x_j)^2 - sum_j v_jf^2 x_j^2), linear in its features
by the sum-of-squares identity, then the logistic function.

Only training is bounded (``max_train`` labelled rows, drawn by hash of the id,
so that the draw does not depend on partitions). Features are made on the
executors, so the driver is sent them and no texts; scoring is one pass without
a shuffle, over whole texts.

Defined cases: null text is empty; a text without words scores 0.0; null source
or language is a value of its own, as are those of a table without the column;
repeated rows are scored each; rows without doc_id, or with one that is no whole
number, are scored like the rest; labels other than 0 and 1, or of unknown
documents, are not used; without labels of both classes there is no model and
every document with words scores 1.0. Other columns, whatever their names, are
passed through.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bare_columns, doc_key, ids_and_text, mapped, place, sized, text_of
from .textkernel import Words, groups, ranges

#: Production parameters.
MAX_TRAIN, WORD_BITS, RANK, EPOCHS, CUTOFF = 8000, 15, 8, 12, 0.5

N_STATS, BINS, META = 12, 12, 512
FIRST_WORD = N_STATS * BINS + META

_CLASS = np.zeros(256, dtype=np.uint8)  # 1 upper, 2 digit, 3 space, 4 newline, 5 sentence mark, 6 symbol, 7 bar
_CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9]], _CLASS[[10, 13]] = 1, 2, 3, 4
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 5
_CLASS[[ord(c) for c in "#$%&*@^~<>{}[]\\+=_/`"]] = 6
_CLASS[[ord("!"), ord("?")]] = 7
_CLASS[ord("|")] = 8
_EDGES = np.array([0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.12, 0.2, 0.35, 0.6, 0.9])


def features(buf: np.ndarray, offs: np.ndarray, meta: list[tuple[str, str]]):
    """(ptr, index, value, words): features of a group's documents by row."""
    n = len(offs) - 1
    w = Words(buf, offs, plain=True)
    words, size = np.diff(w.ptr), np.maximum(np.diff(offs), 1)
    doc = w.of()
    key = doc * (1 << WORD_BITS) + (w.hash & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
    key, tf = np.unique(key, return_counts=True)
    at = key >> WORD_BITS
    distinct = np.bincount(at, minlength=n)
    value = np.sqrt(tf)
    value = value / np.sqrt(np.maximum(np.bincount(at, weights=value * value, minlength=n), 1e-9))[at]
    kinds = _CLASS[buf]
    before = lambda k: np.concatenate([[0], np.cumsum(kinds == k)])[offs]
    share = [np.diff(before(k)) / size for k in range(1, 9)]
    length = np.bincount(doc, weights=w.ends - w.starts, minlength=n) / np.maximum(words, 1)
    stats = [*share, distinct / np.maximum(words, 1), length / 20, np.log1p(words) / 10, np.minimum(1, words / 40)]
    first = [s * BINS + np.digitize(x, _EDGES) for s, x in enumerate(stats)]
    tags = np.array([[zlib.crc32(f"{i}={x}".encode()) % META + N_STATS * BINS for i, x in enumerate(row)] for row in meta], dtype=np.int64).reshape(n, -1)
    dense = np.column_stack([*first, tags]) if n else np.zeros((0, N_STATS), dtype=np.int64)
    m = dense.shape[1]
    rows = np.concatenate([np.repeat(np.arange(n), m), at])
    index = np.concatenate([dense.ravel(), FIRST_WORD + (key & ((1 << WORD_BITS) - 1))])
    values = np.concatenate([np.full(n * m, 0.4), value])
    order = np.argsort(rows, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]), index[order], values[order].astype(np.float32), words


@dataclass
class Machine:
    """Weights; w is None where there was nothing to learn from."""

    w0: float
    w: np.ndarray | None
    v: np.ndarray | None

    def margin(self, ptr: np.ndarray, index: np.ndarray, value: np.ndarray):
        vx = self.v[index] * value[:, None]
        sums = np.add.reduceat(vx, ptr[:-1], axis=0)
        linear = np.add.reduceat(self.w[index] * value, ptr[:-1])
        return self.w0 + linear + 0.5 * ((sums * sums).sum(1) - np.add.reduceat((vx * vx).sum(1), ptr[:-1])), sums

    def scores(self, buf: np.ndarray, offs: np.ndarray, meta: list[tuple[str, str]]) -> np.ndarray:
        ptr, index, value, words = features(buf, offs, meta)
        if self.w is None:
            return np.where(words > 0, 1.0, 0.0)
        return np.where(words > 0, 1 / (1 + np.exp(-self.margin(ptr, index, value)[0].astype(float))), 0.0)


def learn(ptr: np.ndarray, index: np.ndarray, value: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-5, seed: int = 7, batch: int = 128) -> Machine:
    """AdaGrad on the logistic loss over features by row, both classes weighted alike."""
    if len(set(y.tolist())) < 2:
        return Machine(0.0, None, None)
    rng = np.random.default_rng(seed)
    dim = FIRST_WORD + (1 << WORD_BITS)
    m = Machine(0.0, np.zeros(dim, np.float32), rng.normal(0, 0.02, (dim, RANK)).astype(np.float32))
    gw, gv, g0 = np.full(dim, 1e-2, np.float32), np.full((dim, RANK), 1e-2, np.float32), 1e-2
    starts = np.arange(0, len(y), batch)
    weight = {1: 0.5 / y.mean(), 0: 0.5 / (1 - y.mean())}
    for _ in range(epochs):
        for a in rng.permutation(starts).tolist():
            b = min(a + batch, len(y))
            rows = slice(ptr[a], ptr[b])
            own, i, x, t = ptr[a : b + 1] - ptr[a], index[rows], value[rows], y[a:b]
            z, sums = m.margin(own, i, x)
            miss = ((1 / (1 + np.exp(-z)) - t) * np.where(t == 1, weight[1], weight[0])).astype(np.float32)
            each = np.repeat(miss, np.diff(own)) * x
            full = np.repeat(sums, np.diff(own), axis=0) - m.v[i] * x[:, None]
            uniq, inv = np.unique(i, return_inverse=True)
            dw = np.bincount(inv, weights=each).astype(np.float32) / len(t) + decay * m.w[uniq]
            dv = np.column_stack([np.bincount(inv, weights=each * full[:, f]) for f in range(RANK)]).astype(np.float32) / len(t) + decay * m.v[uniq]
            gw[uniq] += dw * dw
            gv[uniq] += dv * dv
            m.w[uniq] -= rate * dw / np.sqrt(gw[uniq])
            m.v[uniq] -= rate * dv / np.sqrt(gv[uniq])
            d0 = float(miss.mean())
            g0 += d0 * d0
            m.w0 -= rate * d0 / g0**0.5
    return m


def _featured(rows: DataFrame) -> DataFrame:
    """(doc_id, y, index, value) of rows (doc_id, y, text, source, lang)."""
    names = ["doc_id", "y", "index", "value"]

    def run(batches):
        for x in batches:
            meta = list(zip(map(str, x.column(3).to_pylist()), map(str, x.column(4).to_pylist()), strict=True))
            for a, b, buf, offs in groups(x.column(2)):
                ptr, index, value, _ = features(buf, offs, meta[a:b])
                at = pa.array(ptr, pa.int32())
                lists = (pa.ListArray.from_arrays(at, pa.array(v, t)) for v, t in ((index, pa.int32()), (value, pa.float32())))
                yield pa.RecordBatch.from_arrays([x.column(0).slice(a, b - a), x.column(1).slice(a, b - a), *lists], names)

    return rows.select("doc_id", "y", "text", "source", "lang").mapInArrow(run, "doc_id long, y int, index array<int>, value array<float>")


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Machine:
    """Fit on at most ``max_train`` labelled documents: a bound on the model's training only."""
    flat = labels.select(doc_key().alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    drawn = flat.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    side = sized(drawn, max_train)
    rows = _featured(ids_and_text(docs, extra=("source", "lang")).join(side, "doc_id")).toArrow()
    ids, y = rows["doc_id"].to_numpy(), rows["y"].to_numpy()
    index, value = (rows[c].combine_chunks() for c in ("index", "value"))
    order = np.argsort(ids, kind="stable")
    size = np.diff(index.offsets.to_numpy()) if len(ids) else np.zeros(0, np.int64)
    take = ranges(index.offsets.to_numpy()[:-1][order], index.offsets.to_numpy()[1:][order]) if len(ids) else np.zeros(0, np.int64)
    return learn(np.concatenate([[0], np.cumsum(size[order])]), index.values.to_numpy()[take] if len(ids) else take, value.values.to_numpy()[take] if len(ids) else take, y[order])


def _batch_scores(model: Machine, text: pa.Array, source: pa.Array, lang: pa.Array) -> np.ndarray:
    out = np.zeros(len(text))
    meta = list(zip(map(str, source.to_pylist()), map(str, lang.to_pylist()), strict=True))
    for a, b, buf, offs in groups(text):
        out[a:b] = model.scores(buf, offs, meta[a:b])
    return out


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """(doc_id, quality_score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for x in batches:
            s = _batch_scores(shared.value, *x.columns[1:])
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(s, pa.float64())], ["doc_id", "quality_score"])

    flat, at = bare_columns(docs), place(docs, "doc_id")
    return flat.select(doc_key(f"c{at}").alias("doc_id"), *(text_of(docs, c).alias(f"w{i}") for i, c in enumerate(("text", "source", "lang")))).mapInArrow(run, "doc_id long, quality_score double")


def keep(docs: DataFrame, model: Machine, cutoff: float = CUTOFF) -> DataFrame:
    """The rows that score at least ``cutoff``, with all their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return mapped(docs, ["text", "source", "lang"], lambda read, rows: rows.filter(pa.array(_batch_scores(shared.value, *read) >= cutoff)))
