"""MinHash near-dedup with sequential Bayesian verification.

Shingles are runs of K lower-cased words. Texts with equal words are collapsed
first (128 bits of hash and the count). Of the rest, documents whose signatures
agree in a band are candidates; a candidate pair's signatures are compared a
batch at a time, and the pair is dropped as soon as the posterior probability
(uniform prior) of a similarity of at least ``threshold`` is below ``miss`` over
the number of batches, so that all looks together miss by ``miss`` at most.
Survivors are verified on the exact shingle sets. Groups are the connected
components of verified pairs; the least doc_id of a group stays.

In each bucket all are compared with the least doc_id, which is found by an
aggregation with partial minima. Two that agree with it are in one group
already, so copies give pairs in proportion to their number, not to its square.
Only those that fail there are compared with each other document of the bucket
that is not of their group by then (no link between different texts is lost;
unlike texts of one bucket are what costs pairs).

Defined cases: null text is empty; texts without words are no one's copies; a
text of fewer than K words is one shingle; rows that share a doc_id are one
document (the least text stands); rows without doc_id, or with one that is no
whole number, are not compared, and kept by ``drop``; a similarity equal to the threshold is a copy. Other columns
are ignored, or passed through by ``drop``.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bare_columns, components, doc_key, ids_and_text, keep, place, scratch, session, sized, store
from .textkernel import U, Words, groups, inside, kgrams, mix, powers

#: Production parameters.
K, BANDS, ROWS, BATCH, THRESHOLD, MISS = 3, 32, 4, 32, 0.6, 0.01
PERMS = BANDS * ROWS

_rng = np.random.default_rng(20110930)
_A = _rng.integers(1, 1 << 63, PERMS, dtype=np.uint64) * U(2) + U(1)
_B = _rng.integers(0, 1 << 63, PERMS, dtype=np.uint64)


def shingles(words: Words, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a group's shingles in the order of documents, and where each document's begin."""
    n = len(words.ptr) - 1
    count = np.diff(words.ptr)
    parts, docs = [], []
    if len(words.hash):
        doc = words.of()
        for size in range(1, k + 1):
            g, ok = kgrams(words.hash, size), inside(words.ptr, len(words.hash), size)
            at = np.flatnonzero(ok & ((count[doc] == size) if size < k else True)[: len(g)]) if size < k else np.flatnonzero(ok)
            parts.append(g[at])
            docs.append(doc[at])
    if not parts:
        return np.zeros(0, dtype=U), np.zeros(n + 1, dtype=np.int64)
    doc, all_of = np.concatenate(docs), np.concatenate(parts)
    order = np.argsort(doc, kind="stable")
    return all_of[order], np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])


def signatures(h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """(documents, PERMS) 32-bit minima; all ones where there are no shingles."""
    out = np.full((len(ptr) - 1, PERMS), 0xFFFFFFFF, dtype=np.uint32)
    some = np.flatnonzero(np.diff(ptr))
    if len(some):
        for p in range(PERMS):
            out[some, p] = np.minimum.reduceat(h * _A[p] + _B[p], ptr[some]) >> U(32)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    s = sig.astype(U).reshape(len(sig), BANDS, ROWS)
    p, _ = powers(ROWS + 1)
    return mix((mix(s + U(1)) * p[:ROWS]).sum(axis=2, dtype=U) + np.arange(1, BANDS + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def least_matches(threshold: float = THRESHOLD, miss: float = MISS, batch: int = BATCH) -> list[int]:
    """For n = batch, 2 batch, .. values: matches below which the posterior
    P(similarity >= threshold), a binomial tail by Beta(m + 1, n - m + 1), is under miss
    over the number of batches."""
    out = []
    miss /= -(-PERMS // batch)
    for n in range(batch, PERMS + 1, batch):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
        out.append(m)
    return out


def survivors(a: np.ndarray, b: np.ndarray, need: list[int], batch: int = BATCH) -> np.ndarray:
    """Rows of signature pairs that no batch rules out."""
    live, same = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for i, least in enumerate(need):
        cut = slice(i * batch, (i + 1) * batch)
        same[live] += (a[live, cut] == b[live, cut]).sum(1)
        live = live[same[live] >= least]
    return live


def sketch(texts: DataFrame) -> DataFrame:
    """(doc_id, d1, d2, n, sig, bands) of texts with words."""
    names = ["doc_id", "d1", "d2", "n", "sig", "bands"]

    def run(batches):
        for x in batches:
            ids = x.column(0).to_numpy()
            for a, b, buf, offs in groups(x.column(1)):
                w = Words(buf, offs, plain=True)
                n = np.diff(w.ptr)
                p, q = powers(len(w.hash) + 1)
                sums = []
                for seq in (w.hash, mix(w.hash ^ U(0xA5A5A5A5A5A5A5A5))):
                    s = np.concatenate([np.zeros(1, dtype=U), np.cumsum(seq * p[: len(seq)])])
                    sums.append(mix((s[w.ptr[1:]] - s[w.ptr[:-1]]) * q[w.ptr[:-1]]).view(np.int64))
                sig = signatures(*shingles(w))
                keep = n > 0
                band = bands(sig[keep]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b][keep]), pa.array(sums[0][keep]), pa.array(sums[1][keep]), pa.array(n[keep].astype(np.int32)), pa.array([r.tobytes() for r in sig[keep]], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(band) + 1, dtype=np.int32) * BANDS), pa.array(band.ravel()))], names
                )

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, d1 long, d2 long, n int, sig binary, bands array<long>")


def _sets(column: pa.Array) -> list[np.ndarray]:
    out = []
    for _, _, buf, offs in groups(column):
        h, ptr = shingles(Words(buf, offs, plain=True))
        out += [np.unique(h[s:e]) for s, e in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)]
    return out


def _both(pairs: DataFrame, rows: DataFrame, col: str) -> DataFrame:
    """pairs (a, b) with the column of both documents; only documents of pairs are moved."""
    a = rows.join(sized(pairs.select(F.col("a").alias("doc_id")).distinct()), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col(col).alias("x"))
    b = rows.join(sized(pairs.select(F.col("b").alias("doc_id")).distinct()), "doc_id", "left_semi").select(F.col("doc_id").alias("b"), F.col(col).alias("y"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y")


def compare(texts: DataFrame, sigs: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """(a, b, jaccard) of stored pairs (a, b) whose exact similarity reaches the threshold, stored."""
    need = least_matches(threshold, miss)

    def prune(batches):
        for x in batches:
            if x.num_rows:
                s, t = (np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint32).reshape(-1, PERMS) for c in (x.column(2), x.column(3)))
                yield x.select([0, 1]).take(pa.array(survivors(s, t, need)))

    def exact(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                x = whole.slice(i, 256)
                value = []
                for s, t in zip(_sets(x.column(2)), _sets(x.column(3)), strict=True):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    value.append(both / max(1, len(s) + len(t) - both))
                out = pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(value, pa.float64())], ["a", "b", "jaccard"])
                yield out.filter(pa.array(np.array(value) >= threshold))

    left = store(_both(pairs, sigs, "sig").mapInArrow(prune, "a long, b long"), "survivors")
    return store(_both(left, texts, "text").mapInArrow(exact, "a long, b long, jaccard double"), "near-pairs")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """(doc_id, kept_doc_id, equal_words) of each document that goes."""
    with scratch(session(docs)):
        texts = ids_and_text(docs)
        sigs = store(sketch(texts), "signatures")
        words = sigs.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
        same = store(sigs.select("doc_id", "d1", "d2", "n").join(words, ["d1", "d2", "n"]).filter("doc_id <> rep").select("doc_id", "rep"), "equal-texts")
        reps = sigs.join(sized(same.select("doc_id")), "doc_id", "left_anti").select("doc_id", F.explode("bands").alias("h"))
        pivots = reps.groupBy("h").agg(F.min("doc_id").alias("pivot"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
        buckets = store(reps.join(pivots, "h").select("h", "doc_id", "pivot"), "buckets")
        pairs = store(buckets.filter("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")
        edges = compare(texts, sigs, pairs, threshold, miss)
        failed = store(pairs.join(edges, ["a", "b"], "left_anti"), "failed")
        if not failed.isEmpty():
            group = components(edges)
            member = buckets.join(group.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("h", "doc_id", "pivot", F.coalesce("component", "doc_id").alias("g"))
            some = member.join(failed.select(F.col("a").alias("pivot"), F.col("b").alias("doc_id")), ["pivot", "doc_id"], "left_semi")
            met = some.select("h", F.col("doc_id").alias("x"), F.col("g").alias("gx")).join(member.filter("doc_id <> pivot").select("h", F.col("doc_id").alias("y"), F.col("g").alias("gy")), "h").filter("gx <> gy")
            rest = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
            rest = store(rest, "other-pairs")
            if not rest.isEmpty():
                edges = edges.unionByName(compare(texts, sigs, rest, threshold, miss))
        whole = edges.select("a", "b").unionByName(same.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
        gone = components(whole).filter("node <> component").select(F.col("node").alias("doc_id"), F.col("component").alias("kept_doc_id"))
        equal = same.select("doc_id", F.col("rep").alias("kept_doc_id"), F.lit(True).alias("equal_words"))
        return keep(gone.join(equal, ["doc_id", "kept_doc_id"], "left").select("doc_id", "kept_doc_id", F.coalesce("equal_words", F.lit(False)).alias("equal_words")), "near-duplicates")


def drop(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs without near-duplicates: one row of each group, all its columns."""
    gone = near_duplicates(docs, **params).select(F.col("doc_id").alias("_id"))
    flat, at, text = bare_columns(docs), place(docs, "doc_id"), place(docs, "text")
    key = doc_key(f"c{at}")
    again = keep(flat.select(key.alias("_id")).filter("_id is not null").groupBy("_id").count().filter("count > 1").select("_id"), "repeated-ids")
    kept = flat.join(sized(gone), key == F.col("_id"), "left_anti")
    if not again.isEmpty():
        side = sized(again)
        first = Window.partitionBy(key).orderBy(F.coalesce(F.col(f"c{text}").cast("string"), F.lit("")))
        one = kept.join(side, key == F.col("_id"), "left_semi").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
        kept = kept.join(side, key == F.col("_id"), "left_anti").unionByName(one)
    return kept.toDF(*docs.columns)
