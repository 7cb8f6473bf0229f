"""Operators 7 and 10 against plain loops."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from inkwell.llm import line_rules, mixing


def clean(docs, min_docs, share, left, most=1000):
    norm = lambda x: re.sub("[ \t\r]+", " ", x).strip(" ").lower()
    hosts, held = Counter(h or "" for _, _, h in docs), defaultdict(set)
    for i, t, h in docs:
        for x in (t or "").split("\n"):
            if norm(x):
                held[h or "", norm(x)].add(i)
    cut = {k for k, v in held.items() if len(v) > min_docs and len(v) > min(share * hosts[k[0]], most)}
    out = {}
    for i, t, h in docs:
        ls = (t or "").split("\n")
        keep = [x for x in ls if not norm(x) or (h or "", norm(x)) not in cut]
        size = lambda a: sum(len(x) for x in a if norm(x))
        if size(keep) and size(keep) >= left * size(ls):
            out[i] = ("\n".join(keep), len(ls), len(ls) - len(keep))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_lines(spark, seed):
    r = random.Random(seed)
    common = ["Home | About", "home |  about", "All rights reserved", "  Share this\t", "x"]
    docs = []
    for i in range(150):
        ls = [r.choice(common) if r.random() < 0.3 else "".join(r.choice("abcd ") for _ in range(r.randint(0, 30))) for _ in range(r.randint(0, 9))]
        docs.append((i, "\n".join(ls), r.choice(["h1", "h1", "h1", "h2", None])))
    docs += [(500, None, "h1"), (501, "", "h2"), (502, "\n\n", None), (503, "All rights reserved\n" * 3 + "y" * 200_000, "h1")]
    d = spark.createDataFrame([(i, t, h, 1, 2) for i, t, h in docs], "doc_id long, text string, source string, host int, h int")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_rules.clean_lines(d, min_docs=4, share=0.05).collect()}
    assert got == clean(docs, 4, 0.05, line_rules.LEAST_LEFT)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_rules.clean_lines(d, min_docs=4, share=0.9, max_docs=20).collect()}
    assert got == clean(docs, 4, 0.9, line_rules.LEAST_LEFT, 20) != clean(docs, 4, 0.9, line_rules.LEAST_LEFT)


def test_lines_at_the_limit_stay(spark):
    rows = [(i, "just enough\n" + f"own line of {i}", "h") for i in range(4)] + [(9, "other text", "h")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.n_removed for r in line_rules.clean_lines(d, min_docs=4).collect()} == {0}
    assert sum(r.n_removed for r in line_rules.clean_lines(d, min_docs=3).collect()) == 4


def test_lines_odd_input(spark):
    d = spark.createDataFrame([(1, "a\nb", "h"), (1, "a\nb", "h"), (None, "a", "h"), (2, "c", None)], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in line_rules.clean_lines(d).collect()) == [1, 2]
    assert line_rules.clean_lines(d.filter("false")).count() == 0


def table(spark, seed=1, n=3000):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        s = r.choices(["web", "books", "code", None], [70, 20, 8, 2])[0]
        rows.append((i, " ".join("w" for _ in range(int(r.lognormvariate(3, 1)))), s, r.choices(["en", "de"], [9, 1])[0], "x"))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, rate string")


def test_targets_are_met(spark):
    rows, d = table(spark)
    want = {"web": 0.4, "books": 0.3, "code": 0.2, "": 0.1}
    got = mixing.rates(d, source_targets=want, lang_targets={"en": 0.7, "de": 0.3}).toPandas()
    assert len(got) == len(rows)
    whole = (got.rate * got.tokens).sum()
    assert abs(whole / got.tokens.sum() - 1) < 1e-4
    for col, targets in (("source", want), ("lang", {"en": 0.7, "de": 0.3})):
        shares = (got.rate * got.tokens).groupby(got[col]).sum() / whole
        assert all(abs(shares[k] - v) < 1e-4 for k, v in targets.items())
        copies = (got.copies * got.tokens).groupby(got[col]).sum() / (got.copies * got.tokens).sum()
        assert all(abs(copies[k] - v) < 0.05 for k, v in targets.items())
    assert ((got.copies - got.rate).abs() < 1).all()


@pytest.mark.parametrize("local", [0, mixing.LOCAL_COUNTS])
def test_the_solution_is_the_exponential_tilt(spark, monkeypatch, local):
    """The rates are a tilt of that form, and meet the targets; the driver's sums are those of the aggregation."""
    monkeypatch.setattr(mixing, "LOCAL_COUNTS", local)
    rows, d = table(spark, 2, 600)
    facts = mixing._facts(d)
    b = mixing.balance(facts)
    p = facts.toPandas()
    p = p[p.tokens > 0]
    t = (p.tokens / b.mean).to_numpy()
    a = np.column_stack([*[(p.source == s) * t for s in b.sources], *[(p.lang == k) * t for k in b.langs], np.ones(len(p))])
    w = np.exp(a @ b.x)
    share = lambda col, power: (lambda own: own**power / (own**power).sum())((p.groupby(col).tokens.sum() / p.tokens.sum()))
    want = np.concatenate([share("source", mixing.SOURCE_POWER)[b.sources], share("lang", mixing.LANG_POWER)[b.langs], [1]]) * len(p)
    assert np.abs(a.T @ w - want).max() / len(p) < 1e-6 and b.steps < 40


def test_mixing_odd_input(spark):
    rows = [(1, None, None, None), (2, "", "a", "en"), (None, "x y", "a", "en"), (3, "x", "b", "en"), (3, "x", "b", "en"), (4, "w " * 50_000, "b", "de")]
    d = spark.createDataFrame([(*r, 7, "s") for r in rows], "doc_id long, text string, source string, lang string, mix_copies int, tokens string")
    got = mixing.rates(d).collect()
    assert len(got) == 6 and all(r.rate >= 0 and r.copies >= 0 for r in got)
    assert len({r.copies for r in got if r.doc_id == 3}) == 1
    assert mixing.mix(d.select("text", "doc_id")).columns == ["text", "doc_id", "mix_copies"]
    twice = d.select("doc_id", d.text.alias("TEXT"), "source", "lang", d.tokens.alias("c0"), d.tokens.alias("c0"))
    assert mixing.mix(twice).columns == [*twice.columns, "mix_copies"] and mixing.mix(twice).count() == mixing.mix(d).count()
    out = mixing.mix(d)
    assert out.columns == d.columns and all(r.mix_copies > 0 for r in out.collect())
    assert mixing.rates(d.filter("false")).count() == 0 and mixing.mix(d.filter("false")).count() == 0
    bare = mixing.rates(d.filter("doc_id = 1")).first()
    assert bare.tokens == 0 and bare.rate == 1.0


def test_targets_that_cannot_be_met(spark):
    """Source a is all English, b all German: the languages' shares are the sources'."""
    rows = [(i, "w " * (1 + i % 7), "ab"[i % 2], ("en", "de")[i % 2]) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    with pytest.raises(ValueError, match="off by 0.[3-9]"):
        mixing.rates(d, source_targets={"a": 0.9, "b": 0.1}, lang_targets={"en": 0.1, "de": 0.9})
    uneven = d.filter("source = 'a' or doc_id < 20")
    with pytest.warns(UserWarning, match="sources' stand"):
        got = mixing.rates(uneven).toPandas()
    whole = got.tokens.groupby(got.source).sum() / got.tokens.sum()
    want = whole**mixing.SOURCE_POWER / (whole**mixing.SOURCE_POWER).sum()
    have = (got.rate * got.tokens).groupby(got.source).sum() / (got.rate * got.tokens).sum()
    assert np.allclose(have[want.index], want, atol=1e-4)


def test_targets_of_zero(spark):
    rows, d = table(spark, 3, 800)
    got = mixing.rates(d, source_targets={"web": 0.5, "books": 0.5, "code": 0, "": 0}).toPandas()
    assert (got.rate[got.source.isin(["code", ""])] == 0).all() and (got.copies[got.source == "code"] == 0).all()
    tokens = (got.rate * got.tokens).groupby(got.source).sum()
    assert abs(tokens["web"] - tokens["books"]) < 1e-3 * tokens["web"] and abs(tokens.sum() / got.tokens.sum() - 1) < 1e-3
    for bad in ({"web": -1.0}, dict.fromkeys(["web", "books", "code", ""], 0)):
        with pytest.raises(ValueError, match="targets"):
            mixing.rates(d, source_targets=bad)


def test_many_sources(spark):
    rows = [(i, "w " * (1 + i % 11), f"host{i % 3000}", "en" if i % 7 else "de") for i in range(9000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    b = mixing.balance(mixing._facts(d))
    assert len(b.sources) == 3000 and b.gap < 1e-6
