"""Toxicity by the nearest labelled examples: exact TF-IDF cosine, block-max indexes.

The terms are the words that go with the label: those whose chi-square of
presence against toxicity exceeds the Bonferroni limit of ``ALPHA`` over all
words of the examples. Weights are (1 + ln tf) * idf, with idf over the examples.
An inverted index holds, by term, the blocks of ``BLOCK`` examples that have it,
and the term's greatest weight in each. A document's bound in a block is the sum
of its weights times those; the blocks of the greatest bounds give a k-th
cosine, and blocks whose bounds are below it are skipped, so the k neighbours are exact.

Neighbours vote with their cosines (the distance is one minus it), and one vote
of ``PRIOR`` goes to the examples' rate. A logistic curve, fitted to the votes
that the examples get from each other, makes votes probabilities. Each document
is a query, with its whole text; a labelled document is no neighbour of itself.

Training is bounded: ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled rows, drawn by hash
of the id. The bounds change the classes' ratio, so a drawn row stands for as many
labelled ids as its class has to a row drawn (the weights have the mean 1): in the
chi-square, idf, votes, the prior's rate and the curve. Searching is one pass without a shuffle; the index that is broadcast
is bounded by the examples.

Defined cases: null or empty texts, and those without a term, have no neighbours
and the vote of the prior alone; ties of cosine go to the lesser example id;
repeated rows get a row each; rows without doc_id are scored, with a null id;
labels other than 0 and 1 are not used, an id labelled both ways is toxic;
without toxic and clean examples, or without terms, nothing is toxic. Other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_text, sized, store
from .textkernel import Words, groups

#: Production parameters.
MAX_TOXIC, MAX_CLEAN, ALPHA, NEAREST, BLOCK, FIRST, PRIOR, CUTOFF = 4000, 8000, 0.01, 15, 32, 4, 0.25, 0.5


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The whole numbers of each range, one range after the other."""
    size = end - start
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)


def _weighted(lists: tuple, at: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values of the lists of ``at``, each times its w, by place."""
    ptr, place, value = lists
    r = _ranges(ptr[at], ptr[at + 1])
    return np.bincount(place[r], weights=value[r] * np.repeat(w, ptr[at + 1] - ptr[at]), minlength=n)


@dataclass
class Index:
    """Examples that have terms, by block, and what is needed to weigh a query."""

    terms: np.ndarray  # hashes, sorted
    idf: np.ndarray
    rate: float  # of toxic among the examples
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ptr: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # terms of each example
    col: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    post: tuple = ()  # by term: bounds of its postings; examples; weights
    tops: tuple = ()  # by term: bounds of its blocks; blocks; greatest weights
    curve: tuple[float, float] = (0.0, 1.0)
    weights: tuple[float, float] = (1.0, 1.0)  # of a clean example, and of a toxic one
    prior: float = 0.0  # rate of toxic among the labels

    @property
    def n_blocks(self) -> int:
        return -(-len(self.ids) // BLOCK)

    def query(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Weights of a text's terms, of length 1."""
        w = (1 + np.log(tf)) * self.idf[at]
        return w / np.sqrt((w * w).sum())

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int = NEAREST, without: int | None = None) -> tuple[list[tuple[float, int]], int]:
        """([(cosine, example)] of the k nearest with a cosine above 0, blocks visited).

        The FIRST blocks by bound give a k-th cosine; of the others those are read
        whose bounds reach it, or the query's postings, if these are fewer."""
        bound = _weighted(self.tops, at, w, self.n_blocks)
        dense = np.zeros(len(self.terms))
        dense[at] = w
        first = np.argsort(-bound, kind="stable")[:FIRST]
        first = first[bound[first] > 0]
        cos, n = self._cosines(dense, first, without)
        least = np.partition(cos, len(cos) - k)[len(cos) - k] if len(cos) >= k else 0.0
        bound[first] = 0
        rest = np.flatnonzero(bound >= max(least - 1e-9, 1e-12))
        if len(rest):
            ends = self.ptr[np.minimum((rest + 1) * BLOCK, len(self.ids))]
            if (ends - self.ptr[rest * BLOCK]).sum() <= (self.post[0][at + 1] - self.post[0][at]).sum():
                more, m = self._cosines(dense, rest, without)
            else:  # the terms' postings are shorter than those blocks
                every = _weighted(self.post, at, w, len(self.ids))
                every[_ranges(first * BLOCK, np.minimum((first + 1) * BLOCK, len(self.ids)))] = 0
                m = np.flatnonzero(every >= max(least - 1e-9, 1e-12))
                m = m if without is None else m[self.ids[m] != without]
                more = np.round(every[m], 12)
            cos, n = np.concatenate([cos, more]), np.concatenate([n, m])
        if len(cos) > k:
            keep = cos >= np.partition(cos, len(cos) - k)[len(cos) - k]
            cos, n = cos[keep], n[keep]
        top = np.lexsort((self.ids[n], -cos))[:k]
        return list(zip(cos[top].tolist(), n[top].tolist(), strict=True)), len(first) + len(rest)

    def _cosines(self, dense: np.ndarray, blocks: np.ndarray, without) -> tuple[np.ndarray, np.ndarray]:
        """(cosines above 0, examples) of the blocks, all at once."""
        a = np.sort(blocks) * BLOCK
        n = _ranges(a, np.minimum(a + BLOCK, len(self.ids)))
        at = _ranges(self.ptr[n], self.ptr[n + 1])
        start = np.concatenate([[0], np.cumsum(self.ptr[n + 1] - self.ptr[n])[:-1]]) if len(n) else n
        # rounded, so that equal texts tie whatever the order of their sums
        cos = np.round(np.add.reduceat(dense[self.col[at]] * self.weight[at], start), 12) if len(n) else np.zeros(0)
        good = cos > 0
        if without is not None:
            good &= self.ids[n] != without
        return cos[good], n[good]

    def vote(self, near: list[tuple[float, int]]) -> float:
        whole = sum(c * self.weights[self.toxic[n]] for c, n in near)
        return (sum(c * self.weights[1] for c, n in near if self.toxic[n]) + PRIOR * self.prior) / (whole + PRIOR)

    def probability(self, vote: float) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-(a + b * vote))))


def vectors(words: Words, terms: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(document, terms, occurrences) of a group's documents that have terms."""
    if not len(terms) or not len(words.hash):
        return []
    at = np.searchsorted(terms, words.hash)
    at[at == len(terms)] = 0
    hit = np.flatnonzero(terms[at] == words.hash)
    if not len(hit):
        return []
    doc = np.searchsorted(words.ptr, hit, side="right") - 1
    key, tf = np.unique(doc * len(terms) + at[hit], return_counts=True)
    doc, t = key // len(terms), key % len(terms)
    edge = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    return [(int(doc[a]), t[a:b], tf[a:b]) for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(doc)], strict=True)]


def chi_limit(alpha: float, tests: int) -> float:
    """The chi-square (one degree of freedom) that chance exceeds with alpha / tests."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(max(alpha / max(tests, 1) / 2, 1e-300)) ** 2


def _calibrate(votes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Platt's logistic curve, with his smoothed targets, by Newton steps; rising at least slightly."""
    high, low = (weight[y == 1].sum() + 1) / (weight[y == 1].sum() + 2), 1 / (weight[y == 0].sum() + 2)
    t = np.where(y == 1, high, low)
    x = np.column_stack([np.ones(len(votes)), votes])
    c = np.array([-3.0, 6.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        g = x.T @ (weight * (p - t)) + 1e-3 * c
        h = (x.T * (weight * p * (1 - p))) @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        c -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return float(c[0]), float(max(c[1], 0.1))


def make_index(terms: np.ndarray, df: np.ndarray, n: int, n_toxic: int, examples: list[tuple[int, int, np.ndarray, np.ndarray]], weights: tuple[float, float] = (1.0, 1.0)) -> Index:
    """examples: (doc_id, toxic, terms, occurrences) of those that have terms; n: of all;
    weights: of a clean and of a toxic one, with the mean 1, which df has in it."""
    order = np.argsort(terms)
    place = np.empty(len(terms), np.int64)
    place[order] = np.arange(len(terms))
    index = Index(terms[order], np.log((1 + n) / (1 + df[order])) + 1, n_toxic / max(n, 1), weights=weights, prior=n_toxic * weights[1] / max(n, 1))
    rows = []
    for i, y, at, tf in examples:
        at = place[at]
        by = np.argsort(at)
        rows.append((i, y, at[by], index.query(at[by], tf[by])))
    # examples of like terms share blocks, which makes the bounds tight
    rows.sort(key=lambda r: (int(r[2][np.argmax(r[3])]), r[2].tolist(), r[0]))
    if not rows:
        return index
    index.ids, index.toxic = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    index.ptr = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])])
    index.col, index.weight = np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows])
    by = np.argsort(index.col, kind="stable")
    col, example, weight = index.col[by], np.repeat(np.arange(len(rows)), np.diff(index.ptr))[by], index.weight[by]
    index.post = np.searchsorted(col, np.arange(len(terms) + 1)), example, weight
    edge = np.flatnonzero(np.append(True, (col[1:] != col[:-1]) | (example[1:] // BLOCK != example[:-1] // BLOCK)))
    index.tops = np.searchsorted(col[edge], np.arange(len(terms) + 1)), example[edge] // BLOCK, np.maximum.reduceat(weight, edge)
    votes, y = [], []
    for k in range(len(rows)):
        at = slice(index.ptr[k], index.ptr[k + 1])
        votes.append(index.vote(index.nearest(index.col[at], index.weight[at], without=index.ids[k])[0]))
        y.append(int(index.toxic[k]))
    # the examples without terms all have the prior's vote
    bare = n_toxic - sum(y), n - n_toxic - (len(y) - sum(y))
    weight = np.array([weights[k] for k in y] + [max(b, 0) * w for b, w in zip(bare, (weights[1], weights[0]), strict=True)])
    votes, y = [*votes, index.prior, index.prior], [*y, 1, 0]
    index.curve = _calibrate(np.array(votes), np.array(y), weight)
    return index


def _example_words(texts: DataFrame) -> DataFrame:
    """(doc_id, toxic, h, tf): the distinct words of the examples."""

    def run(batches):
        for x in batches:
            ids, toxic = x.column(0).to_numpy(), x.column(2).to_numpy()
            for a, b, buf, offs in groups(x.column(1)):
                w = Words(buf, offs, plain=True)
                doc = w.of()
                order = np.lexsort((w.hash, doc))
                d, h = doc[order], w.hash[order]
                edge = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (h[1:] != h[:-1]))) if len(d) else np.zeros(0, np.int64)
                tf = np.diff(np.append(edge, len(d)))
                at = d[edge] + a
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(toxic[at]), pa.array(h[edge].view(np.int64)), pa.array(tf)], ["doc_id", "toxic", "h", "tf"])

    return texts.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, toxic int, h long, tf long")


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, alpha: float = ALPHA) -> Index | None:
    """The index of at most max_toxic + max_clean labelled documents; None without both kinds."""
    flat = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    one = flat.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = lambda y, n: one.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    drawn = store(draw(1, max_toxic).unionByName(draw(0, max_clean)), "toxic-examples")
    labelled, taken = ({r.toxic: r["count"] for r in x.groupBy("toxic").count().collect()} for x in (one, drawn))
    texts = ids_and_text(docs).join(sized(drawn, max_toxic + max_clean), "doc_id")
    words = store(_example_words(texts), "example-words")
    sizes = {r.toxic: r.n for r in words.groupBy("toxic").agg(F.countDistinct("doc_id").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    n1, n = sizes[1], sizes[0] + sizes[1]
    of = [labelled[y] / taken[y] for y in (0, 1)]
    w0, w1 = (x * n / (sizes[0] * of[0] + n1 * of[1]) for x in of)
    m1 = n1 * w1
    by = store(words.groupBy("h").agg((F.sum("toxic") * F.lit(w1)).alias("a"), (F.sum("toxic") * F.lit(w1) + F.sum(1 - F.col("toxic")) * F.lit(w0)).alias("df")), "word-counts")
    limit = chi_limit(alpha, by.count())
    b, a, df = F.col("df") - F.col("a"), F.col("a"), F.col("df")
    chi = n * F.pow(a * (n - m1 - b) - b * (m1 - a), F.lit(2.0)) / (df * (n - df) * m1 * (n - m1))
    rising = (df < n - 1e-6) & (a * (n - m1) > b * m1)
    terms = by.filter(rising).filter(chi > limit).select("h", "df").orderBy("h").toPandas()
    if terms.empty:
        return None
    hashes = terms["h"].to_numpy().view(np.uint64)
    at = {h: i for i, h in enumerate(terms["h"].tolist())}
    side = F.broadcast(docs.sparkSession.createDataFrame([(h,) for h in at], "h long"))
    rows = words.join(side, "h").groupBy("doc_id", "toxic").agg(F.collect_list("h").alias("hs"), F.collect_list("tf").alias("tfs")).orderBy("doc_id").collect()
    examples = [(r.doc_id, r.toxic, np.array([at[h] for h in r.hs]), np.array(r.tfs)) for r in rows]
    return make_index(hashes, terms["df"].to_numpy(), n, n1, examples, (w0, w1))


_SCHEMA = "doc_id long, toxicity double, vote double, n_neighbours long, evidence string"


def score(docs: DataFrame, index: Index | None, nearest: int = NEAREST) -> DataFrame:
    """One row for each document: its probability, its vote, and its nearest three
    examples as "id:label:cosine"."""
    if index is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("toxicity"), F.lit(0.0).alias("vote"), F.lit(0).cast("long").alias("n_neighbours"), F.lit("").alias("evidence"))
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        ix = shared.value
        bare = ix.vote([])
        seen: dict[tuple, tuple] = {}
        own = set(ix.ids.tolist())
        for x in batches:
            n = x.num_rows
            ids = x.column(0).to_pylist()
            p, vote, count, evidence = [ix.probability(bare)] * n, [bare] * n, [0] * n, [""] * n
            for a, _, buf, offs in groups(x.column(1)):
                for d, at, tf in vectors(Words(buf, offs, plain=True), ix.terms):
                    me = ids[a + d] if ids[a + d] in own else None
                    key = (me, at.tobytes(), tf.tobytes())
                    if key not in seen:
                        if len(seen) > 20_000:
                            seen.clear()
                        near, _ = ix.nearest(at, ix.query(at, tf), nearest, without=me)
                        v = ix.vote(near)
                        seen[key] = (ix.probability(v), v, len(near), ", ".join(f"{ix.ids[k]}:{ix.toxic[k]}:{c:.3f}" for c, k in near[:3]))
                    p[a + d], vote[a + d], count[a + d], evidence[a + d] = seen[key]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(p, pa.float64()), pa.array(vote, pa.float64()), pa.array(count, pa.int64()), pa.array(evidence, pa.string())], [c.split()[0] for c in _SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def toxic(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The documents whose probability reaches the cutoff, with score and evidence."""
    return score(docs, fit(docs, labels)).filter(F.col("toxicity") >= cutoff)
