"""Operator 3 against all pairs of exact similarities."""

import random
import re

import numpy as np

from inkwell.llm.minhash_dedup import PERMS, THRESHOLD, drop, least_matches, near_duplicates, survivors


def shingles(text):
    w = [x.lower() for x in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text or "")]
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def groups(docs, threshold=THRESHOLD):
    sets = {i: shingles(t) for i, t in docs}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = [i for i in sets if sets[i]]
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both / (len(sets[a]) + len(sets[b]) - both) >= threshold:
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: find(i) for i in ids if find(i) != i}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + str(r.randint(0, 300))
    docs, i = [], 0
    for _ in range(25):
        base = [word() for _ in range(r.choice([1, 2, 5, 40, 120, 300]))]
        for _ in range(r.choice([1, 1, 2, 6, 15])):
            rate = r.choice([0, 0, 0.01, 0.03, 0.05, 0.3])
            docs.append((i, " ".join(word() if r.random() < rate else w for w in base)))
            i += 1
    r.shuffle(docs)
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, None, "sig", 1) for i, t in docs], "doc_id long, text string, lang string, a string, n int")


def test_all_pairs(spark):
    docs = corpus(3)
    want = groups(docs)
    got = {r.doc_id: r.kept_doc_id for r in near_duplicates(frame(spark, docs)).collect()}
    assert len(set(want.items()) & set(got.items())) >= 0.97 * len(want)
    assert len(set(got.items()) - set(want.items())) <= 0.03 * len(want)
    kept = drop(frame(spark, docs))
    assert kept.columns == ["doc_id", "text", "lang", "a", "n"]
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - set(got)


def test_those_that_fail_with_the_least_of_a_bucket_are_compared(spark):
    w = [f"w{i}" for i in range(100)]
    mutate = lambda at: " ".join(f"x{i}" if i in at else v for i, v in enumerate(w))
    docs = [(0, mutate(set(range(4, 24, 5)) | {60, 70})), (1, mutate({30, 80})), (2, mutate({33, 80})), (3, mutate({33, 80, 90}))]
    want = groups(docs)
    got = {r.doc_id: r.kept_doc_id for r in near_duplicates(frame(spark, docs)).collect()}
    assert got == want


def test_defined_cases(spark):
    docs = [(1, "Same words here"), (2, "same, WORDS here!"), (2, "same, WORDS here!"), (3, None), (4, ""), (5, "..."), (None, "Same words here"), (6, "one"), (7, "One"), (8, "two")]
    got = near_duplicates(frame(spark, docs)).collect()
    assert sorted((r.doc_id, r.kept_doc_id, r.equal_words) for r in got) == [(2, 1, True), (7, 6, True)]
    left = [r.doc_id for r in drop(frame(spark, docs)).collect()]
    assert sorted(left, key=lambda x: -1 if x is None else x) == [None, 1, 3, 4, 5, 6, 8]
    assert near_duplicates(frame(spark, [])).count() == 0
    twice = drop(frame(spark, [(9, "a b c d"), (9, "a b c d"), (10, "z")])).collect()
    assert sorted(r.doc_id for r in twice) == [9, 10]
    long = " ".join(f"n{i}" for i in range(40_000))
    assert near_duplicates(frame(spark, [(1, long), (2, long + " end")])).count() == 1


def test_pruning_misses_as_chosen():
    need = least_matches(0.6, 0.01)  # over all four batches
    assert need == sorted(need) and 0 < need[0] < 20 and need[-1] < 77
    r = np.random.default_rng(1)
    lost = []
    for similarity in (0.6, 0.3):
        a = r.integers(0, 1 << 31, (4000, PERMS), dtype=np.uint32)
        b = np.where(r.random(a.shape) < similarity, a, a + 1)
        lost.append(1 - len(survivors(a, b, need)) / len(a))
    assert lost[0] < 0.01 and lost[1] > 0.99
