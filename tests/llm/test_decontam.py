"""Operator 8 against every window of every text, by plain longest common subsequences."""

import random
import re

import numpy as np
import pyarrow as pa

from inkwell.llm import decontam
from inkwell.llm.decontam import LCS, SURE, common_subsequence, drop, leaks
from inkwell.llm.textkernel import Words, groups


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def words(text):
    return [w.lower() for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text or "")]


def brute(docs, items):
    """Pairs of a common subsequence in some window of the item's length and a quarter."""
    out = {}
    for i, t in docs:
        w = words(t)
        for k, q in items:
            v = words(q)
            size = len(v) + len(v) // 4 + 1
            best = max((lcs(v, w[p : p + size]) / len(v) for p in range(max(1, len(w) - size + 1))), default=0)
            if best >= LCS:
                out[i, k] = best
    return out


def corpus(seed, items=12, n=60):
    r = random.Random(seed)
    common = ["the", "of", "and", "to", "in", "is"]
    word = lambda: r.choice(common) if r.random() < 0.35 else r.choice("bcdfg") + r.choice("aeiou") + str(r.randint(0, 300))
    bench = [(100 + i, " ".join(word() for _ in range(r.randint(14, 59)))) for i in range(items)]
    docs, planted = [], set()
    for i in range(n):
        w = [word() for _ in range(r.choice([0, 3, 40, 200, 500]))]
        if i % 3 == 0:
            k, q = r.choice(bench)
            v = q.split()
            if i % 2:  # a paraphrase: some words are others, some are gone
                v = [word() if r.random() < 0.12 else x for x in v if r.random() > 0.05]
            at = r.randint(0, len(w))
            w[at:at] = v
            planted.add((i, k))
        docs.append((i, r.choice([" ", "\n", ", "]).join(w)))
    return docs, bench, planted


def frames(spark, docs, bench):
    return spark.createDataFrame([(i, t, "b", 1, 1) for i, t in docs], "doc_id long, text string, b string, item_id int, n int"), spark.createDataFrame(bench, "item_id long, text string")


def test_all_windows(spark):
    for seed in (1, 2):
        docs, bench, planted = corpus(seed)
        want = brute(docs, bench)
        rows = leaks(*frames(spark, docs, bench)).collect()
        got = {(r.doc_id, r.item_id): r.lcs_share for r in rows}
        sure = {p for p, s in want.items() if s >= SURE}
        assert len(sure & set(got)) >= 0.9 * len(sure) and len(sure) >= 12
        assert len(set(got) & planted) >= 0.9 * len(planted)
        assert set(got) <= planted | {p for p, s in want.items() if s >= LCS - 0.1}
        texts = dict(docs)
        for r in rows:
            there = words(texts[r.doc_id])[r.word_start : r.word_start + r.n_words]
            item = words(dict(bench)[r.item_id])
            assert abs(r.lcs_share - lcs(item, there) / len(item)) < 1e-9


def test_drop_keeps_clean_rows_and_columns(spark):
    docs, bench, planted = corpus(3)
    d, b = frames(spark, docs, bench)
    left = drop(d, b)
    assert left.columns == d.columns
    ids = {r.doc_id for r in left.collect()}
    gone = {i for i, _ in docs} - ids
    assert gone == {r.doc_id for r in leaks(d, b).select("doc_id").collect()}
    assert gone <= {i for i, _ in planted}


def test_defined_cases(spark):
    q = " ".join(f"q{i}" for i in range(20))
    docs = [(1, q), (1, q), (2, None), (3, ""), (None, q), (4, "zz"), (5, "w " * 30_000 + q), (6, "?!")]
    bench = [(7, q), (8, q), (None, q), (9, None), (10, "")]
    d, b = frames(spark, docs, bench)
    got = leaks(d, b).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 7), (1, 8), (5, 7), (5, 8)]
    assert all(r.lcs_share == 1.0 for r in got)
    assert sorted(r.doc_id for r in drop(d, b).collect()) == [2, 3, 4, 6]
    assert leaks(d, b.filter("false")).count() == 0 and drop(d, b.filter("false")).count() == len(docs)
    assert leaks(d.filter("false"), b).count() == 0 and drop(d.filter("false"), b).count() == 0


def test_answer(spark):
    """Between LCS and SURE it depends on the answer."""
    item = " ".join(f"q{i}" for i in range(30)) + " Answer: r1 r2 r3 r4"
    head = " ".join(f"q{i}" for i in range(25))
    docs = [(1, head + " x1 x2 x3 x4"), (2, head + " r1 r2 r3 r4"), (3, " ".join(f"z{i}" for i in range(200)))]
    got = {r.doc_id: r.answer_share for r in leaks(*frames(spark, docs, [(1, item)])).collect()}
    assert got == {2: 1.0}


def test_common_subsequence_by_bits():
    r = random.Random(5)
    for _ in range(300):
        a, b = ([r.randint(0, 6) for _ in range(r.randint(0, 90))] for _ in range(2))
        assert common_subsequence(a, b) == lcs(a, b)


def test_factors_span_the_leading_directions():
    r = np.random.default_rng(1)
    a = r.standard_normal((300, 12)) @ r.standard_normal((12, decontam.DIM // 8))
    test = r.standard_normal((a.shape[1], 20))
    v = decontam.factor(a.T @ (a @ test), test, 12)
    assert np.linalg.norm(a - a @ v @ v.T) < 1e-2 * np.linalg.norm(a)


def test_sketch_is_the_product(spark):
    docs, bench, _ = corpus(4)
    d, _ = frames(spark, docs, bench)
    df, n = decontam.document_frequencies(d)
    idf, width = decontam._weights(df, n), 5
    rows, counts = [], np.zeros(decontam.DIM, int)
    for _, t in docs:
        _, _, buf, offs = next(groups(pa.array([t], pa.string())))
        f = decontam._features(Words(buf, offs, plain=True))
        for p in range(0, len(f), decontam.BLOCK * decontam.PASSAGE):
            part = f[p : p + decontam.BLOCK * decontam.PASSAGE]
            counts[np.unique(part)] += 1
            row = np.bincount(part, minlength=decontam.DIM) * idf[: decontam.DIM]
            rows.append(row / max(np.sqrt((idf[part] ** 2).sum()), 1e-5))
    a = np.array(rows)
    assert n == len(rows) and (counts == df).all()
    assert np.allclose(decontam.sketch(d, idf, width), a.T @ (a @ decontam._test_matrix(width)), rtol=1e-3, atol=1e-3)


def test_recall_by_item_length(spark):
    """Of all pairs that plain subsequences confirm in some window, whatever the item's length."""
    r = random.Random(8)
    common = ["the", "of", "and", "to", "in", "is"]
    word = lambda: r.choice(common) if r.random() < 0.35 else r.choice("bcdfg") + r.choice("aeiou") + str(r.randint(0, 300))
    sizes = [(3, 6), (7, 12), (13, 19), (20, 29), (30, 63)]
    bench = [(i, " ".join(word() for _ in range(r.randint(*sizes[i % len(sizes)])))) for i in range(25)]
    docs, pairs = [], []
    for k, q in bench:
        for _ in range(24):
            keep = r.choice([0.65, 0.7, 0.75, 0.8, 1])
            v, w = [x if r.random() < keep else word() for x in q.split()], [word() for _ in range(r.randint(20, 200))]
            at = r.randint(0, len(w))
            w[at:at] = v
            pairs.append((len(docs), k))
            docs.append((len(docs), " ".join(w)))
    got = {(x.doc_id, x.item_id) for x in leaks(*frames(spark, docs, bench)).collect()}
    texts, items = dict(docs), dict(bench)
    for low, high in sizes:
        want = set()
        for i, k in pairs:
            w, v = texts[i].split(), items[k].split()
            n, cut = len(v), len(v) - max(1, round(len(v) * decontam.ANSWER_SHARE))
            for p in range(max(1, len(w) - n - n // 4) if low <= n <= high else 0):
                there = w[p : p + n + n // 4 + 1]
                share = common_subsequence(v, there) / n
                if share >= SURE or share >= LCS and common_subsequence(v[cut:], there) >= decontam.ANSWER * (n - cut):
                    want.add((i, k))
        assert len(want) >= 60 and len(want & got) >= 0.9 * len(want)


def test_items_of_words_without_weight(spark):
    """An item in more than MAX_DF of the passages is reported too."""
    item = " ".join(f"q{i}" for i in range(20))
    docs = [(i, item if i < 3 else " ".join(f"z{i}x{j}" for j in range(30))) for i in range(12)]
    got = leaks(*frames(spark, docs, [(7, item)])).collect()
    assert sorted((r.doc_id, r.item_id, r.lcs_share, r.cosine) for r in got) == [(i, 7, 1.0, 0.0) for i in range(3)]


def test_an_item_in_many_documents(spark):
    item = " ".join(f"q{i}" for i in range(30))
    docs = [(i, (item if i < 30 else "") + " " + " ".join(f"z{i}x{j}" for j in range(40))) for i in range(200)]
    got = leaks(*frames(spark, docs, [(1, item)])).collect()
    assert {r.doc_id for r in got} == set(range(30)) and len(got) == 30


def test_parts_of_a_benchmark_give_what_the_whole_gives(spark):
    docs, bench, _ = corpus(6)
    d, b = frames(spark, docs, bench)
    rows = lambda x: {(r.doc_id, r.item_id, round(r.lcs_share, 9), round(r.answer_share, 9)) for r in x.collect()}
    assert rows(leaks(d, b, most=5)) == rows(leaks(d, b))
    assert {r.doc_id for r in drop(d, b, most=5).collect()} == {r.doc_id for r in drop(d, b).collect()}


def test_cells_find_what_all_products_find():
    r = np.random.default_rng(3)
    topics = r.standard_normal((60, 64))
    items = (topics[r.integers(0, 60, 8000)] + 0.4 * r.standard_normal((8000, 64))).astype(np.float32)
    items /= np.linalg.norm(items, axis=1, keepdims=True)
    found = decontam.cells(list(range(8000)), items)
    assert len(found.ptr) - 1 > 60
    windows = items[::40] + 0.05 * r.standard_normal((200, 64)).astype(np.float32)
    want = {(int(w), int(k)) for w, k in zip(*np.nonzero(windows @ items.T >= 0.8), strict=True)}
    got = {(w, k) for w, k, _ in found.near(windows, 0.8)}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_columns_are_found_as_spark_finds_them(spark):
    docs, bench, _ = corpus(7)
    d, b = frames(spark, docs, bench)
    odd = d.select(d.text.alias("TEXT"), d.doc_id.cast("string").alias("doc_id"), d.n.alias("c0"), d.n.alias("c0"))
    left = drop(odd, b)
    assert left.columns == odd.columns and {int(r.doc_id) for r in left.collect()} == {r.doc_id for r in drop(d, b).collect()}
    assert {r.doc_id for r in leaks(odd, b).collect()} == {r.doc_id for r in leaks(d, b).collect()}
