"""Benchmark decontamination by latent semantic retrieval.

Texts are cut to passages of ``PASSAGE`` blocks of ``BLOCK`` words. A randomised
SVD of their TF-IDF rows A (hashed words; each word's occurrences count, and a row
is divided by the root of its occurrences' squared idf) is found in one distributed pass: with
a random test matrix W, each task adds up its part of A'(A W), and the driver
factors the sum by the Nystroem formula. The items' own rows enter with the
weight of the corpus, so that the latent space has their directions.

Each window of blocks of about an item's length is projected, and is a candidate
of the item where its cosine reaches ``COSINE`` of what the item has with
itself in that space (the norm is the whole window's, so that windows of other
subjects are not blown up). A cosine promises no common subsequence, and loses
short items and thin paraphrases; so a window is also a candidate where it has so
many of the item's rarer words that a subsequence of ``LCS`` is possible. That is
exact: without its most frequent words, up to ``COMMON`` of it, an item of n words
must still have (LCS - COMMON) n in the window. These windows hold every run of
n + n/4 + 1 words, wherever it begins.

Candidates are confirmed by the longest common subsequence of words with the item,
and of the item's answer: what follows its last "answer:", or else its last quarter.

One pass counts words, one adds up the sketch, one searches; texts are never
shuffled. Every window of every text is a query. The items' vectors lie in cells
of about the root of their number, by their directions, and a window looks into
the ``PROBES`` cells whose centres are nearest (all, of up to as many cells): a
window's work grows with that root. Items of other cells are left to the exact
path above, so no confirmed leak depends on it. The items, their vectors and the
space (2**BITS rows) are broadcast: they grow with the benchmark, not with the
corpus, and a benchmark of more than ``MAX_ITEMS`` is searched part by part.

Defined cases: null or empty text has no windows; a text shorter than a window
is a window; items without words, or of null item_id, are left out, items of equal
text are each reported; no items, no leaks; words that are in more than
``MAX_DF`` of the passages carry no weight (an item of such words only has no
cosine, 0, and is found by its words alone); repeated rows are reported once for each doc_id (the best window stands,
ties to the first); rows without doc_id, or with one that is no whole number, are
not reported, and kept by ``drop`` unless they leak. Other columns, whatever their
names, are ignored, or passed through by ``drop``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, mapped
from .textkernel import U, Words, groups, ranges

#: Production parameters.
BITS, RANK, OVER, BLOCK, PASSAGE, MAX_DF = 14, 64, 8, 12, 4, 0.05
COSINE, LCS, SURE, ANSWER, ANSWER_SHARE, MAX_ITEMS = 0.5, 0.6, 0.8, 0.5, 0.25, 200_000
COMMON, CELL, PROBES = 0.4, 64, 16

DIM = 1 << BITS
_PART = 512  # features in a message of the sketch
#: Bytes of text at a time: a projected word has RANK floats.
_CHUNK = 1 << 18
_ANSWER = "answer"


def _features(words: Words) -> np.ndarray:
    return (words.hash & U(DIM - 1)).astype(np.int64)


def _blocks(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each run of ``size`` words of a document, runs before each document)."""
    n = np.diff(words.ptr)
    runs = (n + size - 1) // size
    ptr = np.concatenate([[0], np.cumsum(runs)])
    inside = np.arange(ptr[-1]) - np.repeat(ptr[:-1], runs)
    return np.repeat(words.ptr[:-1], runs) + inside * size, ptr


def _grid(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each run by place, DIM beyond its end; first words; runs before each document)."""
    start, ptr = _blocks(words, size)
    end = np.append(start, len(words.hash))[1:]
    at = start[:, None] + np.arange(size)
    f = np.append(_features(words), np.full(size, DIM))[at]
    return np.where(at < end[:, None], f, DIM), start, ptr


def _sum_rows(table: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Sum of the table's rows over each row of the grid."""
    out = np.zeros((len(grid), table.shape[1]), table.dtype)
    part = np.empty_like(out)
    for j in range(grid.shape[1]):
        np.take(table, grid[:, j], axis=0, out=part)
        out += part
    return out


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Passages that hold each feature, over all documents, and the number of passages."""

    def run(batches):
        total, n = np.zeros(DIM, np.int64), 0
        for x in batches:
            for _, _, buf, offs in groups(x.column(0)):
                grid, start, _ = _grid(Words(buf, offs, plain=True), BLOCK * PASSAGE)
                grid.sort(axis=1)
                new = grid < DIM
                new[:, 1:] &= grid[:, 1:] != grid[:, :-1]
                total += np.bincount(grid[new], minlength=DIM)
                n += len(start)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n))], ["f", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(DIM, np.int64), 0
    for r in rows:
        if r.f < 0:
            n = r.n
        else:
            df[r.f] = r.n
    return df, n


def _weights(df: np.ndarray, n: int) -> np.ndarray:
    """Smoothed idf by feature, 0 for those in more than MAX_DF of the passages; at DIM, 0."""
    idf = np.log((1 + n) / (1 + df)) + 1
    return np.append(np.where(df > max(MAX_DF * n, 2), 0.0, idf), 0.0).astype(np.float32)


def _add(y: np.ndarray, words: Words, idf: np.ndarray, weighted: np.ndarray) -> None:
    """y += A'(A W) over the passages of a group; weighted: idf * W, with a row of 0 at DIM."""
    grid, start, _ = _grid(words, BLOCK * PASSAGE)
    if not len(start):
        return
    value = idf[grid]
    norm = np.maximum((value * value).sum(1), 1e-9)
    z = np.ascontiguousarray((_sum_rows(weighted, grid) / norm[:, None]).T)
    f, row = grid.ravel(), np.repeat(np.arange(len(start)), grid.shape[1])
    for j in range(y.shape[1]):
        y[:, j] += np.bincount(f, weights=z[j][row], minlength=DIM + 1)[:DIM] * idf[:DIM]


def _test_matrix(width: int) -> np.ndarray:
    return np.random.default_rng(20111217).standard_normal((DIM, width)).astype(np.float32)


def _weighted(idf: np.ndarray, table: np.ndarray) -> np.ndarray:
    return np.vstack([table * idf[:DIM, None], np.zeros((1, table.shape[1]))]).astype(np.float32)


def _summed(batches):
    """Adds up the messages (part, salt, y) of a partition, one batch at a time."""
    sums: dict[int, np.ndarray] = {}
    for x in batches:
        for part, y in zip(x.column(0).to_pylist(), x.column(2), strict=True):
            v = np.frombuffer(y.as_buffer(), dtype=np.float32)
            sums[part] = sums[part] + v if part in sums else v.astype(np.float64)
    for part, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([0], pa.int32()), pa.array([v.astype(np.float32).tobytes()], pa.binary())], ["part", "salt", "y"])


def sketch(docs: DataFrame, idf: np.ndarray, width: int) -> np.ndarray:
    """A'(A W) over all passages of all documents."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(idf)

    def run(batches):
        from pyspark import TaskContext

        y, weighted = np.zeros((DIM, width)), _weighted(shared.value, _test_matrix(width))
        for x in batches:
            for _, _, buf, offs in groups(x.column(0), _CHUNK):
                _add(y, Words(buf, offs, plain=True), shared.value, weighted)
        y = y.astype(np.float32)
        salt = TaskContext.get().partitionId() % 16
        for p in range(0, DIM, _PART):
            part = y[p : p + _PART]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([p // _PART], pa.int32()), pa.array([salt], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["part", "salt", "y"])

    schema = "part int, salt int, y binary"
    parts = docs.select(F.col("text").cast("string")).mapInArrow(run, schema)
    # two levels of streamed sums: no task holds more than its own partial sums
    level = parts.repartition("part", "salt").mapInArrow(_summed, schema).repartition("part").mapInArrow(_summed, schema)
    y = np.zeros((DIM, width), np.float64)
    for r in level.select("part", "y").collect():
        y[r.part * _PART : (r.part + 1) * _PART] = np.frombuffer(r.y, dtype=np.float32).reshape(-1, width)
    return y


def factor(y: np.ndarray, test: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors of A from Y = A'A W: a Nystroem approximation."""
    shift = 1e-6 * max(np.linalg.norm(y), 1e-12)
    y = y + shift * test
    gram = test.T @ y
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    good = values > 1e-9 * max(values[-1], 1e-300)
    root = y @ (vectors[:, good] / np.sqrt(values[good]))
    left, _, _ = np.linalg.svd(root, full_matrices=False)
    return left[:, :rank].astype(np.float32)


@dataclass
class Space:
    """The latent space and the items in it; items of one window length (in blocks) side by side."""

    idf: np.ndarray
    v: np.ndarray  # idf * V, by feature
    ids: list
    words: list[list[int]]  # hashes of each item's words
    sets: list[frozenset]
    answer: list[int]  # where each item's answer begins
    lengths: dict[int, Cells]  # by blocks
    scaled: np.ndarray  # vector of each item
    rare: Rare


@dataclass
class Cells:
    """Items of one window length: their scaled vectors, by cell."""

    items: np.ndarray
    vectors: np.ndarray
    ptr: np.ndarray  # items of each cell
    centres: np.ndarray

    def near(self, windows: np.ndarray, cosine: float, probes: int = PROBES):
        """(window, item, product) of all products of at least ``cosine`` in the cells that are looked into."""
        n = len(self.ptr) - 1
        look = None if n <= probes else np.argpartition(-(windows @ self.centres.T), probes, axis=1)[:, :probes]
        for c in range(n):
            rows = np.arange(len(windows)) if look is None else np.flatnonzero((look == c).any(1))
            if len(rows):
                sim = windows[rows] @ self.vectors[self.ptr[c] : self.ptr[c + 1]].T
                w, k = np.nonzero(sim >= cosine)
                yield from zip(rows[w].tolist(), self.items[self.ptr[c] + k].tolist(), sim[w, k].tolist(), strict=True)


def cells(items: list[int], vectors: np.ndarray, cell: int = CELL) -> Cells:
    """Cells of about ``cell`` items, or the root of their number where that is more, by a few rounds of spherical k-means."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    n = max(1, len(items) // max(cell, round(len(items) ** 0.5)))
    centres = unit[np.linspace(0, len(items) - 1, n).astype(int)]
    for _ in range(4 if n > 1 else 0):
        of = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, unit)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    of = (unit @ centres.T).argmax(1)
    by = np.argsort(of, kind="stable")
    return Cells(np.array(items)[by], vectors[by], np.searchsorted(of[by], np.arange(n + 1)), centres.astype(np.float32))


@dataclass
class Rare:
    """The rarer words of the items, and which items have each."""

    hot: np.ndarray  # by feature: some rarer word has it
    vocab: np.ndarray  # hashes, sorted
    ptr: np.ndarray
    item: np.ndarray
    dropped: np.ndarray  # words of each item that are left out
    size: np.ndarray  # words of each item
    blocks: np.ndarray  # of a window that holds any run of n + n/4 + 1 words


def rarer(items: list[list[int]], df: np.ndarray) -> Rare:
    words, of, dropped = [], [], []
    for k, item in enumerate(items):
        own, n = np.unique(np.array(item, U), return_counts=True)
        order = np.lexsort((own, -df[(own & U(DIM - 1)).astype(np.int64)]))
        out = int(np.searchsorted(np.cumsum(n[order]), COMMON * len(item), side="right"))
        dropped.append(int(n[order[:out]].sum()))
        words.append(own[order[out:]])
        of.append(np.full(len(own) - out, k))
    word, item = np.concatenate(words), np.concatenate(of)
    vocab, at = np.unique(word, return_inverse=True)
    by = np.argsort(at, kind="stable")
    hot = np.zeros(DIM, bool)
    hot[(vocab & U(DIM - 1)).astype(np.int64)] = True
    size = np.array([len(x) for x in items])
    return Rare(hot, vocab, np.searchsorted(at[by], np.arange(len(vocab) + 1)), item[by], np.array(dropped), size, -(-(size + size // 4) // BLOCK) + 1)


@dataclass
class Counts:
    """What all passages of the documents give, whatever the items."""

    df: np.ndarray
    n: int
    idf: np.ndarray
    y: np.ndarray


def count(docs: DataFrame, rank: int = RANK) -> Counts:
    df, n = document_frequencies(docs)
    idf = _weights(df, n)
    return Counts(df, n, idf, sketch(docs, idf, rank + OVER))


def parts(benchmark: DataFrame, most: int = MAX_ITEMS) -> Iterator[list]:
    """The items (item_id, text), sorted, in parts of about ``most``."""
    rows = benchmark.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("item_id is not null")
    n = -(-rows.count() // most)
    for i in range(n):
        yield sorted(rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect())


def build(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> Space | None:
    """The space of all items at once; None where no item has words."""
    return next(spaces(docs, benchmark, rank, 1 << 62), None)


def spaces(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, most: int = MAX_ITEMS) -> Iterator[Space]:
    """Counts and sketch over all of docs, and with them the space of each part of the items."""
    known = None
    for rows in parts(benchmark, most):
        if rows:
            known = known or count(docs, rank)
            space = _space(rows, known, rank)
            if space is not None:
                yield space


def _space(rows: list, known: Counts, rank: int) -> Space | None:
    _, _, buf, offs = next(groups(pa.array([r.text for r in rows], pa.string()), 1 << 40))
    words = Words(buf, offs, plain=True)
    df, n, idf = known.df, known.n, known.idf
    width = known.y.shape[1]
    test = _test_matrix(width)
    own = np.zeros((DIM, width))
    _add(own, words, idf, _weighted(idf, test))
    y = known.y + own * (max(n, 1) / len(rows))
    v = _weighted(idf, factor(y, test.astype(np.float64), rank))
    f = _features(words)
    ids, kept, answers, by = [], [], [], {}
    for i, r in enumerate(rows):
        a, b = words.ptr[i], words.ptr[i + 1]
        norm = np.sqrt((idf[f[a:b]] ** 2).sum())
        q = v[f[a:b]].sum(0)
        own_sim = float(q @ q)
        if a == b:
            continue
        local = r.text.encode().lower().rfind(_ANSWER.encode() + b":")
        size = b - a
        cut = int(np.searchsorted(words.starts[a:b] - offs[i], local + len(_ANSWER) + 1)) if local >= 0 else size - max(1, round(size * ANSWER_SHARE))
        if norm > 0 and own_sim > 1e-12:
            by.setdefault(-(-size // BLOCK) + 1, []).append((len(ids), q * (norm / own_sim)))
        ids.append(r.item_id)
        kept.append(words.hash[a:b].tolist())
        answers.append(min(cut, size - 1))
    if not ids:
        return None
    scaled = np.zeros((len(ids), v.shape[1]), np.float32)
    lengths = {}
    for k, x in by.items():
        at = [i for i, _ in x]
        scaled[at] = np.array([q for _, q in x], np.float32)
        lengths[k] = cells(at, scaled[at])
    return Space(idf, v, ids, kept, [frozenset(k) for k in kept], answers, lengths, scaled, rarer(kept, df))


def common_subsequence(item: list[int], window: list[int]) -> int:
    """Length of the longest common subsequence, by bits of whole numbers."""
    at: dict[int, int] = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    s = full
    for w in window:
        u = s & at.get(w, 0)
        if u:
            s = (s + u | s - u) & full
    return len(item) - s.bit_count()


def _sharing(rare: Rare, words: Words, start: np.ndarray, ptr: np.ndarray, doc: np.ndarray, lcs: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(items, first blocks, end blocks) of all windows with as many of an item's rarer words as lcs needs."""
    at = np.flatnonzero(rare.hot[_features(words)])
    w = np.minimum(np.searchsorted(rare.vocab, words.hash[at]), len(rare.vocab) - 1)
    own = rare.vocab[w] == words.hash[at]
    at, w = at[own], w[own]
    n = rare.ptr[w + 1] - rare.ptr[w]
    item = rare.item[ranges(rare.ptr[w], rare.ptr[w + 1])]
    block = np.repeat(np.searchsorted(start, at, side="right") - 1, n)
    # documents, and items, are so far apart that no window reaches from one to the next
    gap = int(rare.blocks.max())
    key = np.sort(item * (len(start) + gap * len(ptr)) + block + doc[block] * gap)
    item, place = np.divmod(key, len(start) + gap * len(ptr))
    need = np.maximum(np.ceil(lcs * rare.size - 1e-9).astype(np.int64) - rare.dropped, 1)[item]
    last = np.arange(len(key)) + need - 1  # the hit that makes them enough
    k = np.flatnonzero(last < len(key))
    k = k[key[last[k]] < key[k] + rare.blocks[item[k]]]
    if not len(k):
        return k, k, k
    item, size = item[k], rare.blocks[item[k]]
    d = np.searchsorted(ptr[:-1] + gap * np.arange(len(ptr) - 1), place[k], side="right") - 1
    low, high = place[last[k]] - d * gap - size + 1, place[k] - d * gap
    floor, ceiling = ptr[d], np.maximum(ptr[d], ptr[d + 1] - size)
    low, high = np.clip(low, floor, ceiling), np.clip(high, floor, ceiling)
    both = np.unique(np.repeat(item, high - low + 1) * len(start) + ranges(low, high + 1))
    item, first = np.divmod(both, len(start))
    return item, first, np.minimum(first + rare.blocks[item], ptr[doc[first] + 1])


def _candidates(space: Space, words: Words, cosine: float, lcs: float):
    """(document, item, first word, end word, cosine over the item's own) of a group's windows."""
    grid, start, ptr = _grid(words, BLOCK)
    if not len(start):
        return
    idf = space.idf[grid]
    sums = np.zeros((len(start) + 1, space.v.shape[1]), np.float64)
    np.cumsum(_sum_rows(space.v, grid), axis=0, out=sums[1:])
    norms = np.concatenate([[0.0], np.cumsum((idf * idf).sum(1), dtype=np.float64)])
    doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    ends = np.append(start, len(words.hash))
    for blocks, group in space.lengths.items():
        last = np.minimum(np.arange(len(start)) + blocks, ptr[doc + 1])
        use = np.flatnonzero((np.arange(len(start)) + blocks <= ptr[doc + 1]) | (np.arange(len(start)) == ptr[doc]))
        last = last[use]
        weight = np.sqrt(np.maximum(norms[last] - norms[use], 1e-9))
        near = ((sums[last] - sums[use]) / weight[:, None]).astype(np.float32)
        for w, k, sim in group.near(near, cosine):
            yield int(doc[use[w]]), k, int(start[use[w]]), int(ends[last[w]]), sim
    for k, a, b in zip(*(x.tolist() for x in _sharing(space.rare, words, start, ptr, doc, lcs)), strict=True):
        sim = (sums[b] - sums[a]) @ space.scaled[k] / np.sqrt(max(norms[b] - norms[a], 1e-9))
        yield int(doc[a]), k, int(start[a]), int(ends[b]), float(sim)


def leaks_of(space: Space, words: Words, cosine: float = COSINE, lcs: float = LCS, answer: float = ANSWER) -> dict[tuple[int, int], tuple]:
    """Confirmed leaks of a group: (document, item) -> (lcs share, answer share, cosine, first word, words)."""
    best: dict[tuple[int, int], tuple] = {}
    hashes = None
    for d, k, a, b, sim in _candidates(space, words, cosine, lcs):
        if hashes is None:
            hashes = words.hash.tolist()
        item, cut = space.words[k], space.answer[k]
        window, least = hashes[a:b], lcs * len(item)
        if len(item) - len(space.sets[k]) + len(space.sets[k].intersection(window)) < least:
            continue  # no common subsequence is longer than that
        share = common_subsequence(item, window) / len(item)
        if share < lcs or share <= best.get((d, k), (0,))[0]:
            continue
        said = common_subsequence(item[cut:], window) / (len(item) - cut)
        if said >= answer or share >= SURE:
            best[d, k] = (share, said, sim, a - int(words.ptr[d]), b - a)
    return best


_SCHEMA = "doc_id long, item long, lcs_share double, answer_share double, cosine double, word_start long, n_words long"


def leaks(docs: DataFrame, benchmark: DataFrame, space: Space | None = None, most: int = MAX_ITEMS) -> DataFrame:
    """(doc_id, item_id, lcs_share, answer_share, cosine, word_start, n_words), a row for
    each document and item that it leaks."""
    spark = docs.sparkSession
    kind = benchmark.schema["item_id"].dataType
    out = None
    for part in [space] if space else spaces(docs, benchmark, most=most):
        found = _leaks(docs, part, kind.simpleString())
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], _SCHEMA.replace("item long", f"item_id {kind.simpleString()}"))
    return out


def _leaks(docs: DataFrame, space: Space, kind: str) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(space)

    def run(batches):
        for x in batches:
            rows, ids = [], x.column(0).to_pylist()
            for a, _, buf, offs in groups(x.column(1), _CHUNK):
                for (d, k), (share, said, sim, at, n) in leaks_of(shared.value, Words(buf, offs, plain=True)).items():
                    rows.append((ids[a + d], k, share, said, sim, at, n))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [c.split()[0] for c in _SCHEMA.split(", ")])

    found = docs.select(doc_key().alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null").mapInArrow(run, _SCHEMA)
    order = F.struct(F.col("lcs_share"), F.col("cosine"), -F.col("word_start"))
    one = found.groupBy("doc_id", "item").agg(F.max_by(F.struct("lcs_share", "answer_share", "cosine", "word_start", "n_words"), order).alias("b"))
    names = spark.createDataFrame([(i, k) for i, k in enumerate(space.ids)], f"item long, item_id {kind}")
    return one.join(F.broadcast(names), "item").select("doc_id", "item_id", "b.*")  # MAX_ITEMS rows at most


def drop(docs: DataFrame, benchmark: DataFrame, space: Space | None = None, most: int = MAX_ITEMS) -> DataFrame:
    """The rows of docs whose texts leak no item, with all their columns."""
    out = docs
    for part in [space] if space else spaces(docs, benchmark, most=most):
        out = _without(out, part)
    return out


def _without(docs: DataFrame, space: Space) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def change(read, rows):
        clean = np.ones(rows.num_rows, dtype=bool)
        for a, _, buf, offs in groups(read[0], _CHUNK):
            for d, _ in leaks_of(shared.value, Words(buf, offs, plain=True)):
                clean[a + d] = False
        return rows.filter(pa.array(clean))

    return mapped(docs, ["text"], change)
