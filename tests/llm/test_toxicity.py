"""Operator 9: neighbours against brute force, and held-out accuracy."""

import random

import numpy as np

from inkwell.llm import toxicity
from inkwell.llm.toxicity import NEAREST, fit, make_index, score, toxic

BAD = ["grub", "snarl", "vile", "wretch", "fiend", "blight"]


def corpus(seed, n=400):
    r = random.Random(seed)
    word = lambda: r.choice("bcdfghklm") + r.choice("aeiou") + str(r.randint(0, 60))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.randint(5, 120))]
        y = int(r.random() < 0.2)
        for _ in range(r.randint(1, 4) if y else 0):
            w.insert(r.randint(0, len(w)), r.choice(BAD).upper() if r.random() < 0.3 else r.choice(BAD))
        docs.append((i, " ".join(w)))
        labels.append((i, y))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame([(i, t, 1, "v", 0.5) for i, t in docs], "doc_id long, text string, toxic int, vote string, h double"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_neighbours_are_exact():
    r = np.random.default_rng(4)
    m = 40
    examples = []
    for i in range(500):
        at = np.sort(r.choice(m, r.integers(1, 6), replace=False))
        examples.append((int(r.permutation(5000)[0]) * 1000 + i, int(r.random() < 0.4), at, r.integers(1, 4, len(at))))
    index = make_index(np.arange(m, dtype=np.uint64), r.integers(5, 200, m), 900, 250, examples)
    dense = np.zeros((len(index.ids), m))
    for k in range(len(index.ids)):
        at = slice(index.ptr[k], index.ptr[k + 1])
        dense[k, index.col[at]] = index.weight[at]
    assert np.allclose((dense**2).sum(1), 1)
    skipped = 0
    for q in range(200):
        at = np.sort(r.choice(m, r.integers(1, 8), replace=False))
        w = index.query(at, r.integers(1, 4, len(at)))
        without = int(index.ids[q]) if q % 2 else None
        full = np.zeros(m)
        full[at] = w
        cos = np.round(dense @ full, 12)
        want = sorted((-c, int(i)) for c, i in zip(cos, index.ids, strict=True) if c > 0 and i != without)[:NEAREST]
        got, visited = index.nearest(at, w, without=without)
        assert [(-c, int(index.ids[k])) for c, k in got] == want
        skipped += index.n_blocks - visited
    assert skipped > 200


def test_held_out(spark):
    docs, labels = corpus(1)
    d, lab = frames(spark, docs, labels[:250])
    got = {r.doc_id for r in toxic(d, lab).collect()}
    for part in (labels[:250], labels[250:]):
        bad, good = {i for i, y in part if y}, {i for i, y in part if not y}
        assert len(got & bad) >= 0.95 * len(bad) and len(got & good) <= 0.02 * len(good)
    rows = score(d, fit(d, lab)).collect()
    assert len(rows) == len(docs) and all(0 < r.toxicity < 1 for r in rows)
    assert all(r.evidence.count(":") == 2 * min(3, r.n_neighbours) for r in rows)
    mean = [np.mean([y == 1 for (i, y) in labels[250:] if lo <= p[i] < hi] or [0]) for p in [{r.doc_id: r.toxicity for r in rows}] for lo, hi in ((0, 0.5), (0.5, 1.01))]
    assert mean[0] < 0.1 and mean[1] > 0.9


def test_bounded_examples(spark):
    docs, labels = corpus(2)
    d, lab = frames(spark, docs, labels)
    index = fit(d, lab, max_toxic=30, max_clean=60)
    assert len(index.ids) <= 90 and abs(index.rate - 1 / 3) < 1e-9
    again = fit(d.repartition(7), lab.repartition(3), max_toxic=30, max_clean=60)
    assert (index.ids == again.ids).all() and index.curve == again.curve


def test_defined_cases(spark):
    docs, labels = corpus(3, 150)
    docs += [(1000, None), (1001, ""), (None, "vile grub wretch"), (1002, "vile grub wretch"), (1002, "vile grub wretch"), (1003, "n " * 40_000 + "vile vile grub")]
    labels += [(None, 1), (1000, 1), (5, None), (7777, 1), (0, 1), (0, 0)]
    d, lab = frames(spark, docs, labels)
    rows = score(d, fit(d, lab)).collect()
    assert len(rows) == len(docs)
    of = lambda i: [r.toxicity for r in rows if r.doc_id == i]
    assert of(1000) == of(1001) and of(1000)[0] < 0.5 and of(None)[0] > 0.5
    assert len(of(1002)) == 2 and of(1002)[0] == of(1002)[1] > 0.5 and of(1003)[0] > 0.5
    assert fit(d, lab.filter("toxic = 0")) is None and fit(d.filter("false"), lab) is None
    assert toxic(d, lab.filter("false")).count() == 0
    assert score(d, None).count() == len(docs)
    assert score(d.filter("false"), fit(d, lab)).count() == 0


def test_limit_grows_with_the_words():
    assert 10 < toxicity.chi_limit(0.01, 10) < toxicity.chi_limit(0.01, 100_000) < 35


def test_bounds_keep_the_class_ratio(spark):
    """With both bounds reached, probabilities still mean the ratio of all labels."""
    r = random.Random(9)
    docs, labels = [], []
    for i in range(2700):
        y = int(i % 9 == 0)
        w = [r.choice("bcdfghklm") + r.choice("aeiou") + str(r.randint(0, 60)) for _ in range(r.randint(5, 40))]
        if r.random() < (0.9 if y else 0.1):
            w.insert(r.randint(0, len(w)), r.choice(BAD))
        docs.append((i, " ".join(w)))
        labels.append((i, y))
    d, lab = frames(spark, docs, labels)
    whole, index = fit(d, lab), fit(d, lab, max_toxic=150, max_clean=300)
    p, q = ({x.doc_id: x.toxicity for x in score(d, k).collect()} for k in (whole, index))
    rate = np.mean([y for _, y in labels])
    assert abs(np.mean(list(p.values())) - rate) < 0.2 * rate
    assert abs(np.mean(list(q.values())) - rate) < 0.2 * rate
    assert whole.weights == (1.0, 1.0) and abs(index.prior - rate) < 1e-9
