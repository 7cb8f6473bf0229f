"""Operators 1 and 2 against every window of LEAST words."""

import random
from collections import defaultdict

import pytest

from inkwell.llm.spans import LEAST, extend
from inkwell.llm.substring_dedup import FingerprintIndex, dedup_substrings
from inkwell.llm.suffix_dedup import dedup_suffixes, neighbours


def windows(docs):
    held = defaultdict(set)
    for i, t in docs:
        w = (t or "").encode().split()
        for p in range(len(w) - LEAST + 1):
            held[tuple(w[p : p + LEAST])].add(i)
    return held


def shared(docs):
    """ids with a window of another document; ids with a window of an earlier one."""
    every, later = set(), set()
    for ids in windows(docs).values():
        if len(ids) > 1:
            every |= ids
            later |= ids - {min(ids)}
    return every, later


def corpus(seed, n=60):
    """Random texts with passages around LEAST words, overlapping in all manners."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + str(r.randint(0, 400))
    pool = [word() for _ in range(400)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 4)):
            parts += [word() for _ in range(r.randint(0, 60))]
            if r.random() < 0.6:
                a = r.randint(0, 340)
                parts += pool[a : a + r.choice([10, 24, 25, 26, 40, 49, 50, 51, 60])]
        sep = r.choice([" ", "\n", "  ", "\t"])
        docs.append((i * 3 + 1, sep.join(parts)))
    docs += [(1000, docs[0][1]), (1001, docs[1][1] + " tail"), (1002, None), (1003, ""), (1004, "x " * 300), (1005, "é ü " + " ".join(pool[:80]))]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "pos", 1, "h") for i, t in docs], "doc_id long, text string, other_doc_id string, pos int, h string")


def verified(rows, docs, other):
    words = {i: (t or "").encode().split() for i, t in docs}
    for r in rows:
        a, b = words[r.doc_id], words[r[other]]
        s, n, o = r.word_start, r.n_words, r[other.replace("doc_id", "word_start")]
        assert n >= LEAST and r.doc_id != r[other]
        assert a[s : s + n] == b[o : o + n]
        assert s == 0 or o == 0 or a[s - 1] != b[o - 1]
        assert s + n == len(a) or o + n == len(b) or a[s + n] != b[o + n]


@pytest.mark.parametrize("seed", [1, 2])
def test_all_windows(spark, seed):
    docs = corpus(seed)
    every, later = shared(docs)
    one = dedup_substrings(frame(spark, docs), batches=3, buckets=4, fanout=2).collect()
    verified(one, docs, "first_doc_id")
    assert {r.doc_id for r in one} == later
    assert all(r.first_doc_id < r.doc_id for r in one)
    two = dedup_suffixes(frame(spark, docs)).collect()
    verified(two, docs, "other_doc_id")
    assert {r.doc_id for r in two} == every


def test_a_partner_that_shares_less(spark):
    """The first holder of an anchor shares 30 words; the passage of 60 is in two later ones."""
    w = [f"w{i}" for i in range(200)]
    docs = [(1, " ".join(w[100:130])), (2, " ".join(["a", *w[90:150], "b"])), (3, " ".join(["c", *w[90:150], "d"])), (4, " ".join(w[0:60])), (5, " ".join(["q", *w[0:60]]))]
    docs[0] = (1, " ".join(["z"] + w[100:130] + ["y"] * 30))
    for n in range(40):
        docs.append((10 + n, " ".join([f"f{n}", *w[95 + n % 20 : 125 + n % 20], f"g{n}"] + [f"k{n}-{j}" for j in range(40)])))
    assert {r.doc_id for r in dedup_substrings(frame(spark, docs), batches=2).collect()} == {3, 5} == shared(docs)[1]
    assert {r.doc_id for r in dedup_suffixes(frame(spark, docs)).collect()} == {2, 3, 4, 5}


def test_batches_and_manifest(spark):
    docs = corpus(5)
    whole = {r.doc_id for r in dedup_substrings(frame(spark, docs), batches=1).collect()}
    half = [d for d in docs if d[0] <= 90], [d for d in docs if d[0] > 90]
    texts = frame(spark, docs).selectExpr("doc_id", "coalesce(text, '') text")
    first = FingerprintIndex(spark, buckets=4, fanout=2)
    got = {r.doc_id for r in first.add(texts.filter("doc_id <= 90"), texts.filter("doc_id <= 90")).collect()}
    again = FingerprintIndex(spark, fanout=2, manifest=first.manifest())
    got |= {r.doc_id for r in again.add(texts.filter("doc_id > 90"), texts).collect()}
    assert got == whole and half
    assert [r.level for r in again.runs] == [1]
    assert again.add(texts.filter("false"), texts).count() == 0


def test_repeated_rows_nulls_and_empty_tables(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    docs = [(1, passage), (1, passage), (2, None), (None, passage), (3, "")]
    assert dedup_substrings(frame(spark, docs)).count() == 0
    assert dedup_suffixes(frame(spark, docs)).count() == 0
    inner = [(1, passage + " x " + passage)]
    assert dedup_suffixes(frame(spark, inner)).count() == 0
    assert dedup_substrings(frame(spark, [])).count() == 0
    assert dedup_suffixes(frame(spark, [])).count() == 0
    long = " ".join(f"n{i}" for i in range(60_000))
    assert [r.n_words for r in dedup_substrings(frame(spark, [(1, long), (2, long)])).collect()] == [60_000]


def test_extend_reads_words():
    a, b = b"x a b c y".split(), b"q a b c z".split()
    assert extend(a, b, [(1, 1, 7)], 2, 3) == ([(1, 4, 1)], [])
    assert extend(a, b, [(1, 1, 7)], 2, 4) == ([], [7])
    assert extend(a, b, [(0, 0, 7)], 2, 3) == ([], [7])


def test_every_suffix_has_a_neighbour_wherever_ranges_end(spark):
    """Anchors of one document have none; all others meet another document, at most one
    document off in the order, whatever the ranges; batches are cut to three rows."""
    r = random.Random(6)
    rows = sorted({(r.choice([5, 5, 5, 7, 8, 9, 10 + i]), r.randint(0, 1), r.randint(0, 6), i) for i in range(300)})
    frame_ = spark.createDataFrame([(h, c, d, p) for h, c, d, p in rows], "h long, c1 long, doc_id long, pos int")
    docs_of = defaultdict(set)
    for h, _, d, _ in rows:
        docs_of[h].add(d)
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for n in (1, 3, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            got = neighbours(frame_, ["c1"]).collect()
            held = {(x[0], x[2], x[3]) for x in rows}
            assert all((g.h, g.other_doc_id, g.other_pos) in held and g.other_doc_id != g.doc_id for g in got)
            assert len(got) == len({(g.h, g.doc_id, g.pos) for g in got})
            assert {(g.h, g.doc_id, g.pos) for g in got} == {(h, d, p) for h, _, d, p in rows if len(docs_of[h]) > 1}
            if n == 1:
                near = {(g.h, g.doc_id, g.pos): (g.other_doc_id, g.other_pos) for g in got}
                for h in docs_of:
                    own = [(d, p) for x, _, d, p in rows if x == h]
                    for i, (d, p) in enumerate(own):
                        back = next((o for o in reversed(own[:i]) if o[0] != d), None)
                        ahead = next((o for o in own[i:] if o[0] != d), None)
                        assert near.get((h, d, p)) == (back or ahead)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_ids_that_are_no_numbers_are_left_out(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    d = spark.createDataFrame([("1", passage), ("2", passage), ("x", passage), (None, passage)], "doc_id string, text string")
    assert {r.doc_id for r in dedup_substrings(d).collect()} == {2}
    assert {r.doc_id for r in dedup_suffixes(d).collect()} == {1, 2}
