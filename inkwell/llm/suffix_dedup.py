"""Substring dedup with sparse suffix arrays.

Of each text only the suffixes at minimiser positions are kept. A suffix's key
is the sequence of anchors from there on (their hashes and distances), so
documents that go on alike sort side by side. The array is sorted as a whole, by
ranges of the full key with document and position: copies of a passage meet, and
no passage, in however many documents, makes a task larger than the rest.
Neighbours in that order from different documents, also those on either side of
a range's end, are compared and extended to the left and right, word by word, to
their longest common run. Runs of at least ``LEAST`` words are reported for both
documents of a pair.

Every document that shares a passage of LEAST words with another one is
found: see ``spans.resolve`` for neighbours that share less.

Defined cases: as for substring_dedup; ties in the order fall to doc_id, then
position. Suffixes of one anchor that follow each other in one document have as
neighbour the one before them of another document, or, where they are the first
of their anchor, the one after them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_text, keep, scratch, session, store
from .spans import K, W, anchors, resolve

#: Anchors compared beyond a suffix's first one.
DEPTH = 3

_ROWS = "kind int, h long, doc_id long, pos int, other_doc_id long, other_pos int"
_PAIR, _ALONE, _EDGE = 0, 1, 2


def linked(h: np.ndarray, doc: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted suffixes: the start of each run of one anchor and document, and the place of
    each run's neighbour, -1 where it has none. first: neighbour of the first run that is
    known before, or -1."""
    start = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
    near = np.full(len(start), -1, dtype=np.int64)
    same = h[start[1:]] == h[start[:-1]]
    near[1:][same] = start[1:][same] - 1
    near[0] = first
    ahead = np.flatnonzero((near[:-1] < 0) & same)
    near[ahead] = start[ahead + 1]
    return start, near


def neighbours(suffixes: DataFrame, keys: list[str]) -> DataFrame:
    """Each suffix of (h, *keys, doc_id, pos) with its neighbour of another document, stored."""
    order = ["h", *keys, "doc_id", "pos"]
    names = [c.split()[0] for c in _ROWS.split(", ")]

    kinds = [np.int32, np.int64, np.int64, np.int32, np.int64, np.int32]

    def rows(*cols):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(t)) for c, t in zip(cols, kinds, strict=True)], names)

    def run(batches):
        held, before, low, ends = None, None, None, {}  # the last run so far, its neighbour, the least anchor, rows of the ends

        def out(h, doc, pos, o_doc, o_pos, met, high):
            yield rows(np.full(met.sum(), _PAIR), h[met], doc[met], pos[met], o_doc[met], o_pos[met])
            lost = np.flatnonzero(~met & ((h == low) | (h == high)))
            yield rows(np.full(len(lost), _ALONE), h[lost], doc[lost], pos[lost], doc[lost], pos[lost])

        for x in batches:
            if not x.num_rows:
                continue
            part = [x.column(c).to_numpy() for c in range(3)]
            low, high = part[0][0] if low is None else low, part[0][-1]
            ends = _ends(ends, *part, {int(low), int(high)})
            if held is not None:
                part = [np.concatenate(z) for z in zip(held, part, strict=True)]
            h, doc, pos = part
            # the neighbour that is known before has its place beyond the end
            start, near = linked(h, doc, -1 if before is None else len(h))
            o_doc, o_pos = np.append(doc, before[0] if before else 0), np.append(pos, before[1] if before else 0)
            each, last = np.repeat(near, np.diff(np.append(start, len(h)))), start[-1]
            yield from out(h[:last], doc[:last], pos[:last], o_doc[each[:last]], o_pos[each[:last]], each[:last] >= 0, high)
            held, before = [z[last:] for z in part], (int(o_doc[near[-1]]), int(o_pos[near[-1]])) if near[-1] >= 0 else None
        if held is not None:
            h, doc, pos = held
            met = np.full(len(h), before is not None)
            yield from out(h, doc, pos, np.full(len(h), before[0] if before else 0), np.full(len(h), before[1] if before else 0), met, h[-1])
            e = sorted({(a, *r) for a, pair in ends.items() for r in pair})
            if e:
                edge_h, edge_doc, edge_pos = zip(*e, strict=True)
                yield rows(np.full(len(e), _EDGE), edge_h, edge_doc, edge_pos, edge_doc, edge_pos)

    sorted_ = suffixes.repartitionByRange(*order).sortWithinPartitions(*order).select("h", "doc_id", "pos")
    found = store(sorted_.mapInArrow(run, _ROWS), "neighbours")
    pairs = found.filter(f"kind = {_PAIR}").drop("kind")
    alone = found.filter(f"kind = {_ALONE}").select("h", "doc_id", "pos")
    edges = found.filter(f"kind = {_EDGE}").select("h", F.col("doc_id").alias("e_doc"), F.col("pos").alias("e_pos"))
    met = alone.join(edges, "h").filter("doc_id <> e_doc").groupBy("h", "doc_id", "pos").agg(F.min(F.struct("e_doc", "e_pos")).alias("o"))
    return pairs.unionByName(met.select("h", "doc_id", "pos", F.col("o.e_doc").alias("other_doc_id"), F.col("o.e_pos").alias("other_pos")))


def _ends(known: dict, h: np.ndarray, doc: np.ndarray, pos: np.ndarray, at: set[int]) -> dict[int, list[tuple[int, int]]]:
    """Of the anchors ``at``: the rows of the least and of the greatest document so far."""
    out = {}
    for a in at:
        i, j = np.searchsorted(h, a), np.searchsorted(h, a, side="right")
        found = list(known.get(a, []))
        if i < j:
            found += [(int(doc[k]), int(pos[k])) for k in (i + int(doc[i:j].argmin()), i + int(doc[i:j].argmax()))]
        out[a] = [min(found), max(found)] if found else []
    return out


def dedup_suffixes(docs: DataFrame, k: int = K, w: int = W, depth: int = DEPTH) -> DataFrame:
    """(doc_id, word_start, n_words, other_doc_id, other_word_start) of shared passages."""
    with scratch(session(docs)):
        texts = ids_and_text(docs)
        keys = [f"c{i + 1}" for i in range(depth)]
        suffixes = store(anchors(texts, k, w, depth), "suffixes")
        found = resolve(texts, neighbours(suffixes, keys), suffixes, lambda runs: neighbours(runs, []), k, k + w - 1)
        return keep(found, "shared-passages")
