"""Shared passages: anchors of texts, verified extension, and windows for the rest.

Words are runs of bytes between ASCII white space, compared as they are. An
anchor is a minimiser: the least hash of any ``w`` neighbouring runs of ``k``
words, so that two texts that share k + w - 1 words share an anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, store
from .textkernel import Words, groups, inside, kgrams, minimisers

#: Passages of LEAST words are always found: K + W - 1 of them.
K, W = 25, 26
LEAST = K + W - 1


def anchors(docs: DataFrame, k: int = K, w: int = W, context: int = 0) -> DataFrame:
    """(h, doc_id, pos) of each anchor; with context, c1.. are the hashes (mixed with
    the distances) of the anchors that follow in the document, 0 beyond its end."""
    names = ["h", "doc_id", "pos", *(f"c{i + 1}" for i in range(context))]
    schema = "h long, doc_id long, pos int" + "".join(f", c{i + 1} long" for i in range(context))

    def run(batches):
        for x in batches:
            ids = x.column(0).to_numpy()
            for a, b, buf, offs in groups(x.column(1)):
                words = Words(buf, offs)
                at, h = minimisers(words.hash, words.ptr, k, w)
                doc = np.searchsorted(words.ptr, at, side="right") - 1
                cols = [h.view(np.int64), ids[a:b][doc], (at - words.ptr[doc]).astype(np.int32)]
                for i in range(1, context + 1):
                    c = np.zeros(len(at), dtype=np.int64)
                    same = doc[i:] == doc[:-i]
                    c[: len(at) - i][same] = (h[i:] + (at[i:] - at[:-i]).astype(np.uint64)).view(np.int64)[same]
                    cols.append(c)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def windows(docs: DataFrame, spots: DataFrame, least: int = LEAST, k: int = K) -> DataFrame:
    """(h, doc_id, pos) of each run of ``least`` words that holds the k words at one of
    the spots (doc_id, pos)."""
    spots = store(spots.groupBy("doc_id").agg(F.collect_set("pos").alias("at")), "spots")
    some = docs.join(sized(spots.select("doc_id")), "doc_id", "left_semi").join(sized(spots, weight=F.size("at")), "doc_id")

    def run(batches):
        for x in batches:
            ids, at = x.column(0).to_numpy(), x.column(2).to_pylist()
            for a, b, buf, offs in groups(x.column(1)):
                words = Words(buf, offs)
                g, whole = kgrams(words.hash, least), inside(words.ptr, len(words.hash), least)
                pick = np.zeros(len(words.hash) + 1, dtype=np.int64)
                for d in range(a, b):
                    here = np.asarray(at[d], dtype=np.int64) + words.ptr[d - a]
                    np.add.at(pick, np.maximum(here + k - least, words.ptr[d - a]), 1)
                    np.add.at(pick, here + 1, -1)
                got = np.flatnonzero((np.cumsum(pick)[: len(g)] > 0) & whole)
                doc = np.searchsorted(words.ptr, got, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(g[got].view(np.int64)), pa.array(ids[a:b][doc]), pa.array((got - words.ptr[doc]).astype(np.int32))], ["h", "doc_id", "pos"])

    return some.select("doc_id", "text", "at").mapInArrow(run, "h long, doc_id long, pos int")


def extend(a: list[bytes], b: list[bytes], spots: list[tuple[int, int, int]], k: int, least: int) -> tuple[list[tuple[int, int, int]], list[int]]:
    """Longest common runs through the spots (pos in a, pos in b, h), read word by
    word: (start, end, start in b) of those of ``least`` words, and h of the other spots."""
    done: dict[int, tuple[int, bool]] = {}
    spans, missed = [], []
    for pos, other, h in sorted(spots):
        d = other - pos
        end, good = done.get(d, (-1, False))
        if pos + k > end:
            if a[pos : pos + k] != b[other : other + k]:
                missed.append(h)
                continue
            s, e = pos, pos + k
            while s > 0 and s + d > 0 and a[s - 1] == b[s + d - 1]:
                s -= 1
            while e < len(a) and e + d < len(b) and a[e] == b[e + d]:
                e += 1
            good = e - s >= least
            done[d] = (e, good)
            if good:
                spans.append((s, e, s + d))
        if not good:
            missed.append(h)
    return spans, missed


_FOUND = "doc_id long, word_start long, n_words long, other_doc_id long, other_word_start long, missed long"


def verify(docs: DataFrame, pairs: DataFrame, k: int = K, least: int = LEAST) -> DataFrame:
    """Spans of pairs (doc_id, pos, other_doc_id, other_pos, h), stored: rows where
    missed is null are spans, the others the h of spots without one."""
    by = store(pairs.groupBy("doc_id", "other_doc_id").agg(F.collect_list(F.struct("pos", "other_pos", "h")).alias("spots")), "pairs")
    left = docs.join(sized(by.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", F.col("text").alias("text_a"))
    right = docs.join(sized(by.select(F.col("other_doc_id").alias("doc_id")).distinct()), "doc_id", "left_semi").select(F.col("doc_id").alias("other_doc_id"), F.col("text").alias("text_b"))
    both = by.join(right, "other_doc_id").join(left, "doc_id").select("doc_id", "other_doc_id", "spots", "text_a", "text_b")

    def run(batches):
        for x in batches:
            rows, last, words = [], None, None
            for i, j, spots, s, t in zip(*(x.column(c).to_pylist() for c in range(3)), x.column(3).cast(pa.binary()), x.column(4).cast(pa.binary()), strict=True):
                if last != i:
                    last, words = i, s.as_py().split()
                good, missed = extend(words, t.as_py().split(), [(p["pos"], p["other_pos"], p["h"]) for p in spots], k, least)
                rows += [(i, s0, e0 - s0, j, o0, None) for s0, e0, o0 in good]
                rows += [(i, None, None, j, None, h) for h in set(missed)]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [c.split()[0] for c in _FOUND.split(", ")])

    return store(both.mapInArrow(run, _FOUND), "spans")


def resolve(docs: DataFrame, pairs: DataFrame, all_anchors: DataFrame, choose, k: int = K, least: int = LEAST) -> DataFrame:
    """Spans of the pairs, and those that the pairs' partners miss.

    A spot has one partner, which may share less with it than a third document
    does. So where a partner shares fewer than ``least`` words, every occurrence
    of that anchor gives all runs of ``least`` words around it, and ``choose``
    pairs those: equal runs are the whole passage, so any partner will do.

    Every document of a shared passage is found so. Of its words the spans may
    leave out up to k at either edge, where a spot's partner shares ``least``
    words and a third document shares more.
    """
    found = verify(docs, pairs, k, least)
    spans = found.filter("missed is null").drop("missed")
    missed = store(found.filter("missed is not null").select(F.col("missed").alias("h")).distinct(), "missed")
    if missed.isEmpty():
        return spans
    spots = all_anchors.select("h", "doc_id", "pos").join(sized(missed), "h", "left_semi").select("doc_id", "pos")
    runs = windows(docs, spots, least, k)
    again = verify(docs, choose(runs), least, least).filter("missed is null").drop("missed")
    return spans.unionByName(again).distinct()
