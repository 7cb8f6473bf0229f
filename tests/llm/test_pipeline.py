"""The pipeline's stages against plain versions of their decisions, on a small table."""

import random

import corpus_pipeline
import pytest
from test_decontam import brute
from test_minhash import groups as near_groups
from test_secrets import crc_token

from inkwell.llm import mixing, quality_fm, secret_scan

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def make(seed=3, n=160):
    r = random.Random(seed)
    word = lambda: r.choice("bcdfgh") + r.choice("aeiou") + r.choice("klmn") + str(r.randint(0, 99))
    bench = [(i, " ".join(word() for _ in range(30))) for i in range(5)]
    docs, labels, junk, leaked = [], [], set(), set()
    for i in range(n):
        w = [word() for _ in range(r.randint(40, 120))]
        if i % 5 == 0:
            w = [x.upper() + "!!" for x in w]
            junk.add(i)
        elif i % 11 == 1:
            w[20:20] = bench[i % 5][1].split()
            leaked.add(i)
        elif i % 13 == 2:
            w[10:10] = [crc_token(r)]
        elif i % 7 == 3 and i > 20:
            w = docs[i - 8][1].split()[:-1] + [word()] if (i - 8) % 5 else w
        docs.append((i, " ".join(w), r.choice(["en", "de"]), r.choice(["a", "b"])))
        labels.append((i, int(i not in junk), 0))
    return docs, labels, bench, junk, leaked


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    docs, labels, bench, *_ = made = make()
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*d, len(d[1])) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, made


def test_run(spark, small):
    at, (docs, _, bench, junk, leaked) = small
    texts = dict((i, t) for i, t, *_ in docs)
    rows = [d for d in docs if d[0] not in junk]
    gone = near_groups([(i, t) for i, t, *_ in rows])
    rows = [d for d in rows if d[0] not in gone]
    dirty = {i for i, _ in brute([(i, t) for i, t, *_ in rows], bench)}
    assert len(gone) > 3 and len(dirty) > 3 and dirty <= leaked | set(gone.values())
    rows = [d for d in rows if d[0] not in dirty]
    clean = {}
    for i, t, *_ in rows:
        for s, e, k in reversed(secret_scan.find(t)):
            t = f"{t[:s]}[REDACTED:{secret_scan.RULES[k][0]}]{t[e:]}"
        clean[i] = t
    frame = spark.createDataFrame([(i, clean[i], x, s) for i, _, x, s in rows], "doc_id long, text string, lang string, source string")
    copies = {r.doc_id: r.copies for r in mixing.rates(frame).collect() if r.copies}
    got = corpus_pipeline.run(spark, at)
    assert got.columns == [*COLUMNS, "mix_copies"]
    out = got.collect()
    assert {r.doc_id: r.mix_copies for r in out} == copies
    assert all(r.text == clean[r.doc_id] and r.n_chars == len(r.text) for r in out) and any(clean[i] != texts[i] for i in clean)


def test_stages_keep_columns_and_take_odd_input(spark, small):
    at, _ = small
    docs = spark.read.parquet(f"{at}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (900, None, None, None, None), (901, "", "", "", 0), (902, "x", None, "a", 1), (902, "x", None, "a", 1)], docs.schema)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "secrets", "mixture"]
    for name, stage in corpus_pipeline.STAGES:
        for d in (docs.limit(0), odd):
            out = stage(spark, d, at)
            assert out.columns == COLUMNS + ["mix_copies"] * (name == "mixture")
            assert out.count() <= d.count()
    assert quality_fm.CUTOFF == 0.5
