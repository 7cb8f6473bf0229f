"""Operator 6: the identity, held-out accuracy, odd input."""

import random

import numpy as np
import pyarrow as pa
import pytest

from inkwell.llm import quality_fm
from inkwell.llm.quality_fm import Machine, features, keep, learn, score, train
from inkwell.llm.textkernel import groups


def corpus(seed, n=400):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    docs, labels = [], []
    for i in range(n):
        y = int(r.random() < 0.7)
        w = [word() for _ in range(r.randint(20, 150))]
        if not y:
            w = [x.upper() + "!!" for x in w] if r.random() < 0.5 else [x + r.choice(["$$$", "&&&", "%%%"]) for x in w]
        docs.append((i, " ".join(w), r.choice(["a", "b", None]), "en"))
        labels.append((i, y))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame([(*d, 1, 0.5) for d in docs], "doc_id long, text string, source string, lang string, y int, quality_score double"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_sum_of_squares_identity():
    r = np.random.default_rng(1)
    _, _, buf, offs = next(groups(pa.array(["a b c a", "", "d e"])))
    ptr, index, value, _ = features(buf, offs, [("s", "l")] * 3)
    dim = int(index.max()) + 1
    m = Machine(0.3, r.normal(size=dim), r.normal(size=(dim, 4)))
    z, _ = m.margin(ptr, index, value)
    for k in range(3):
        i, x = index[ptr[k] : ptr[k + 1]], value[ptr[k] : ptr[k + 1]]
        pairs = sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert abs(z[k] - (0.3 + m.w[i] @ x + pairs)) < 1e-4


def test_held_out(spark):
    docs, labels = corpus(1)
    d, lab = frames(spark, docs, labels[:250])
    model = train(d, lab)
    got = {r.doc_id: r.quality_score for r in score(d, model).collect()}
    right = [(got[i] >= 0.5) == bool(y) for i, y in labels[250:]]
    assert sum(right) >= 0.95 * len(right)
    kept = keep(d, model)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s >= 0.5}


def test_odd_input(spark):
    docs, labels = corpus(2, 120)
    docs += [(900, None, None, None), (901, "", "a", "en"), (902, "?! ...", "a", "en"), (None, docs[0][1], "a", "en"), (903, "word " * 40_000, "a", "en"), docs[1], docs[1]]
    labels += [(None, 1), (900, 1), (7777, 0), (3, None), (4, 5)]
    d, lab = frames(spark, docs, labels)
    got = score(d, train(d, lab)).collect()
    assert len(got) == len(docs) and all(0 <= r.quality_score <= 1 for r in got)
    assert [r.quality_score for r in got if r.doc_id in (900, 901, 902)] == [0.0] * 3
    assert len({r.quality_score for r in got if r.doc_id == docs[1][0]}) == 1
    none = train(d, lab.filter("quality = 1"))
    assert none.w is None and keep(d, none).count() == len(docs) - 3
    assert score(d.filter("false"), none).count() == 0 and train(d.filter("false"), lab).w is None


def test_training_steps_are_those_of_plain_loops(monkeypatch):
    """One epoch of one batch, against sums over documents and features."""
    r = np.random.default_rng(4)
    texts = [" ".join(f"w{r.integers(0, 30)}" for _ in range(r.integers(1, 12))) for _ in range(9)]
    _, _, buf, offs = next(groups(pa.array(texts)))
    ptr, index, value, _ = features(buf, offs, [("s", "l")] * 9)
    y = np.array([1, 0, 1, 1, 0, 0, 1, 1, 0])
    got = learn(ptr, index, value, y, epochs=1, batch=9)
    dim = quality_fm.FIRST_WORD + (1 << quality_fm.WORD_BITS)
    seeded = np.random.default_rng(7)
    v = seeded.normal(0, 0.02, (dim, quality_fm.RANK)).astype(np.float32).astype(float)
    dw, dv, d0 = np.zeros(dim), np.zeros_like(v), 0.0
    for k in range(9):
        feats = list(zip(index[ptr[k] : ptr[k + 1]].tolist(), value[ptr[k] : ptr[k + 1]].tolist(), strict=True))
        sums = sum(v[i] * x for i, x in feats)
        z = 0.5 * sum((sums[f] ** 2 - sum((v[i][f] * x) ** 2 for i, x in feats)) for f in range(quality_fm.RANK))
        miss = (1 / (1 + np.exp(-z)) - y[k]) * (0.5 / y.mean() if y[k] else 0.5 / (1 - y.mean())) / 9
        d0 += miss
        for i, x in feats:
            dw[i] += miss * x
            dv[i] += miss * x * (sums - v[i] * x)
    used = np.unique(index)
    dv[used] += 1e-5 * v[used]
    assert abs(got.w0 + 0.1 * d0 / (1e-2 + d0 * d0) ** 0.5) < 1e-5
    assert np.allclose(got.w[used], -0.1 * dw[used] / np.sqrt(1e-2 + dw[used] ** 2), atol=1e-5)
    assert np.allclose(got.v[used], v[used] - 0.1 * dv[used] / np.sqrt(1e-2 + dv[used] ** 2), atol=1e-5)


def test_columns_are_found_as_spark_finds_them(spark):
    docs, labels = corpus(5, 100)
    d, lab = frames(spark, docs, labels)
    model = train(d, lab)
    want = sorted(r.doc_id for r in keep(d, model).collect())
    odd = d.select(d.text.alias("TEXT"), "doc_id", d.source.alias("Source"), "lang", d.y.alias("c1"), d.y.alias("c1"), d.y.alias("w0"))
    got = keep(odd, model)
    assert got.columns == odd.columns and sorted(r.doc_id for r in got.collect()) == want
    bare = d.select("doc_id", "text")
    assert score(bare, train(bare, lab)).count() == 100 and keep(bare, model).columns == ["doc_id", "text"]
    named = d.withColumn("doc_id", d.doc_id.cast("string")).replace("3", "three", ["doc_id"])
    assert score(named, model).filter("doc_id is null").count() == 1
    with pytest.raises(ValueError, match="text"):
        keep(d.select("doc_id"), model)


def test_the_draw_does_not_depend_on_partitions(spark):
    docs, labels = corpus(3, 150)
    d, lab = frames(spark, docs, labels)
    a, b = train(d, lab, 60), train(d.repartition(5), lab.repartition(3), 60)
    assert np.array_equal(a.w, b.w)
