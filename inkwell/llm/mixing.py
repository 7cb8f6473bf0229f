"""Mixing sources to target weights: entropy balancing of documents' rates.

Of all rates w (copies of a document, on average) under which each source's and
each language's tokens reach their targets, take those nearest in
Kullback-Leibler divergence to one copy each. They have the form
w_i = exp(t_i * (a[source_i] + b[lang_i]) + c) for token counts t_i (in units
of their mean), the unconstrained minimum of the convex dual
sum_i w_i - sum_r lambda_r target_r, found by damped Newton steps. A step's
gradient and Hessian need only sums of w, w t and w t^2 by (source, lang). All
documents of one source, language and number of tokens have one rate, so they are
counted once, and a step reads those counts: on the driver, up to LOCAL_COUNTS of
them, else by an aggregation. Tilts reach rows by joins. Of the
step's system the sources are a diagonal block, which is eliminated: the driver
solves one of the size of the languages, and holds the cells of sources and
languages, however many documents there are.

Rates are rounded to copies by a hash of the id: floor(w), and one more with
probability w - floor(w), so totals hold in expectation and reruns agree.

Targets that cannot be met together (sources and languages whose cells have no
such margins) leave a gap. Where they were given that is an error, which names
the gap; the default ones give way: the sources keep theirs, the languages fall
where the sources' tilts leave them, and a warning says so.

Defined cases: a document without words has 0 tokens and the rate exp(c); null
source or language, or a table without the column, is the value ''; sources
without a target keep their own share; targets for absent sources are left out;
the rest is scaled to 1; a target of 0 gives all documents of that source or
language the rate 0; negative targets, or none above 0, are an error; rows that
share a doc_id are each given copies, by the same draw; rows without doc_id, or
with one that is no whole number, take the draw of id 0; an empty table gives an
empty one. Other columns, whatever their names, are passed through by ``mix``.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, bare_columns, doc_key, keep, place, scratch, session, store, text_of

#: Production parameters: shares are flattened by these powers unless targets are given.
SOURCE_POWER, LANG_POWER, BUDGET, MAX_STEPS, TOLERANCE = 0.5, 0.7, 1.0, 60, 1e-7
#: Gap, in shares of all tokens, beyond which targets count as not met.
MET = 1e-4
#: Rows of counts (24 bytes each) up to which the driver adds up a step's sums itself.
LOCAL_COUNTS = 500_000


def _facts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, tokens, c0..) of every row."""
    flat, at = bare_columns(docs), place(docs, "doc_id")
    words = F.size(F.filter(F.split(F.coalesce(text_of(docs, "text"), F.lit("")), "[ \t\r\n]+"), lambda x: x != ""))
    value = lambda c: F.coalesce(text_of(docs, c), F.lit(""))
    key = F.lit(None).cast("long") if at is None else doc_key(f"c{at}")
    return flat.select(key.alias("doc_id"), value("source").alias("source"), value("lang").alias("lang"), words.cast("long").alias("tokens"), *flat.columns)


def _shares(totals: dict[str, float], targets: dict[str, float] | None, power: float) -> dict[str, float]:
    """Shares of the values that have tokens and no target of 0."""
    whole = sum(totals.values()) or 1.0
    own = {k: v / whole for k, v in totals.items() if v > 0}
    want = {k: (v**power if targets is None else targets.get(k, v)) for k, v in own.items()}
    scale = sum(want.values())
    if min(want.values()) < 0 or scale <= 0:
        raise ValueError(f"targets are not negative, and one at least is above 0: {targets}")
    return {k: v / scale for k, v in want.items() if v > 0}


def _side(spark: SparkSession, **columns) -> DataFrame:
    """A table of the driver, broadcast if it is of a size for that."""
    out = spark.createDataFrame(pa.table(columns))
    return F.broadcast(out) if len(next(iter(columns.values()))) <= BROADCAST_IDS else out


class Balance:
    """The dual's solution: tilts of sources and languages, the constant, the mean of tokens.
    zero: values whose target is 0. gap: the greatest miss of a target, in shares."""

    def __init__(self, sources: list[str], langs: list[str], mean: float, zero: tuple[list[str], list[str]] = ((), ())):
        self.sources, self.langs, self.mean, self.zero = sources, langs, mean, zero
        self.x = np.zeros(len(sources) + len(langs) + 1)
        self.steps, self.gap = 0, 0.0

    def rated(self, rows: DataFrame) -> DataFrame:
        """rows (source, lang, tokens, ..) with their rate; unknown values have the tilt 0."""
        n = len(self.sources)
        out, tilt = rows, F.lit(0.0)
        for col, names, x, zero in (("source", self.sources, self.x[:n], self.zero[0]), ("lang", self.langs, self.x[n:-1], self.zero[1])):
            if names or zero:
                side = _side(rows.sparkSession, _v=pa.array([*names, *zero], pa.string()), **{f"_t_{col}": np.concatenate([x, np.full(len(zero), np.nan)])})
                out = out.join(side, F.col(col) == F.col("_v"), "left").drop("_v")
                tilt = tilt + F.coalesce(f"_t_{col}", F.lit(0.0))
        rate = F.when(F.isnan(tilt), 0.0).otherwise(F.exp(F.least(F.lit(700.0), tilt * (F.col("tokens") / F.lit(self.mean)) + F.lit(float(self.x[-1])))))
        return out.withColumn("rate", rate).drop("_t_source", "_t_lang")


class _Cells:
    """Moments of the counted documents (s, l, tokens, n) by source and language."""

    def __init__(self, counts: DataFrame, b: Balance):
        self.counts, self.b, self.local = counts, b, None
        if counts.count() <= LOCAL_COUNTS:
            rows = counts.toArrow()
            s, lang, tokens, n = (rows[c].to_numpy() for c in ("s", "l", "tokens", "n"))
            cell, at = np.unique(s * len(b.langs) + lang, return_inverse=True)
            self.local = s, lang, tokens / b.mean, n, at, cell // len(b.langs), cell % len(b.langs)

    def moments(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """(source, language, sum w, sum w t, sum w t^2) of each cell at x, t in units of the mean."""
        k, b = len(self.b.sources), self.b
        if self.local:
            s, lang, t, n, at, cell_s, cell_l = self.local
            w = n * np.exp(np.minimum(700.0, (x[s] + x[k + lang]) * t + x[-1]))
            return cell_s, cell_l, *(np.bincount(at, weights=w * t**p, minlength=len(cell_s)) for p in range(3))
        spark = self.counts.sparkSession
        rows = self.counts
        for col, tilts in (("s", x[:k]), ("l", x[k:-1])):
            rows = rows.join(_side(spark, **{col: np.arange(len(tilts), dtype=np.int64), f"t{col}": np.asarray(tilts, float)}), col)
        t = F.col("tokens") / F.lit(b.mean)
        w = F.col("n") * F.exp(F.least(F.lit(700.0), (F.col("ts") + F.col("tl")) * t + F.lit(float(x[-1]))))
        out = rows.select("s", "l", t.alias("t"), w.alias("w")).groupBy("s", "l").agg(F.sum("w").alias("s0"), F.sum(F.col("w") * F.col("t")).alias("s1"), F.sum(F.col("w") * F.col("t") * F.col("t")).alias("s2")).toArrow()
        return tuple(out[c].to_numpy() for c in ("s", "l", "s0", "s1", "s2"))


def _step(n: int, m: int, cells: tuple, total: float, g: np.ndarray) -> np.ndarray:
    """Newton's step for the sums of the cells: sources eliminated, the rest by least squares
    (source and language rows are dependent, as both add up to all tokens; a ridge keeps the
    step finite where targets conflict)."""
    s, lang, s0, s1, s2 = cells
    s0, s1, s2 = s0 / total, s1 / total, s2 / total
    d = np.bincount(s, weights=s2, minlength=n)
    e = np.zeros((n, m + 1))
    np.add.at(e, (s, lang), s2)
    np.add.at(e, (s, m), s1)
    k = np.zeros((m + 1, m + 1))
    np.add.at(k, (lang, lang), s2)
    np.add.at(k, (lang, m), s1)
    k[m, :m] = k[:m, m]
    k[m, m] = s0.sum()
    ridge = 1e-10 * (d.sum() + np.trace(k))
    d, k = d + ridge, k + ridge * np.eye(m + 1)
    y = np.linalg.lstsq(k - e.T @ (e / d[:, None]), g[n:] - e.T @ (g[:n] / d), rcond=1e-12)[0]
    return -np.concatenate([(g[:n] - e @ y) / d, y])


def newton(moments, b: Balance, want: np.ndarray, total: float, fixed: bool = False) -> Balance:
    """Minimise the dual; ``moments(x)`` gives the cells' sums. want: targets of tokens by
    source, then language, then the documents' total rate, all over ``total``. fixed: the
    languages' tilts stay 0, and their targets do not count."""
    n, m = len(b.sources), len(b.langs)

    def parts(x):
        cells = moments(x)
        s, lang, s0, s1, _ = cells
        g = np.concatenate([np.bincount(s, weights=s1, minlength=n), np.bincount(lang, weights=s1, minlength=m), [s0.sum()]]) / total - want
        if fixed:
            g[n:-1] = 0
            cells = (s, np.zeros_like(lang), *cells[2:])
        return float(s0.sum() / total - want @ x), g, cells

    value, g, cells = parts(b.x)
    while b.steps < MAX_STEPS and np.abs(g).max() > TOLERANCE:
        if fixed:
            part = _step_sources(n, cells, total, g[:n], g[-1])
            step = np.concatenate([part[:-1], np.zeros(m), part[-1:]])
        else:
            step = _step(n, m, cells, total, g)
        size = 1.0
        while True:
            new = parts(b.x + size * step)
            b.steps += 1
            if np.isfinite(new[0]) and new[0] <= value + 1e-4 * size * float(g @ step) or size < 1e-4:
                break
            size /= 2
        if size < 1e-4:
            break
        b.x = b.x + size * step
        value, g, cells = new
    b.gap = float(np.abs(g).max())
    return b


def _step_sources(n: int, cells: tuple, total: float, g: np.ndarray, g_all: float) -> np.ndarray:
    """The step of the sources' tilts and the constant alone."""
    s, _, s0, s1, s2 = cells
    d = np.bincount(s, weights=s2, minlength=n) / total
    e = np.bincount(s, weights=s1, minlength=n) / total
    k = s0.sum() / total
    ridge = 1e-10 * (d.sum() + k)
    d = d + ridge
    y = (g_all - e @ (g / d)) / max(k + ridge - e @ (e / d), ridge)
    return -np.append((g - e * y) / d, y)


def balance(facts: DataFrame, source_targets: dict[str, float] | None = None, lang_targets: dict[str, float] | None = None, budget: float = BUDGET) -> Balance:
    """Solve for the tilts. facts: (source, lang, tokens), read once.
    budget: tokens of the mixture over tokens of the input."""
    with scratch(session(facts)):
        counts = store(facts.filter("tokens > 0").groupBy("source", "lang", "tokens").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
        rows = counts.groupBy("source", "lang").agg(F.sum(F.col("tokens") * F.col("n")).alias("t"), F.sum("n").alias("n")).collect()
        if not rows:
            return Balance([], [], 1.0)
        whole = float(sum(r.t for r in rows))
        shares = []
        for col, targets, power in (("source", source_targets, SOURCE_POWER), ("lang", lang_targets, LANG_POWER)):
            totals: dict[str, float] = {}
            for r in rows:
                totals[r[col]] = totals.get(r[col], 0.0) + r.t
            shares.append((_shares(totals, targets, power), totals))
        (ps, all_s), (pl, all_l) = shares
        left = [r for r in rows if r.source in ps and r.lang in pl]
        if {r.source for r in left} != set(ps) or {r.lang for r in left} != set(pl):
            raise ValueError("targets of 0 leave another source or language without documents")
        tokens, docs = sum(r.t for r in left), sum(r.n for r in left)
        b = Balance(sorted(ps), sorted(pl), tokens / docs, (sorted(all_s.keys() - ps.keys()), sorted(all_l.keys() - pl.keys())))
        # in units of the mean, all documents' tokens are docs; so everything is over docs
        scale = budget * whole / tokens
        want = np.array([ps[k] * scale for k in b.sources] + [pl[k] * scale for k in b.langs] + [scale])
        ids = lambda names, col: _side(counts.sparkSession, v=pa.array(names, pa.string()), **{col: np.arange(len(names), dtype=np.int64)})
        numbered = counts.join(ids(b.sources, "s"), F.col("source") == F.col("v")).drop("v").join(ids(b.langs, "l"), F.col("lang") == F.col("v")).select("s", "l", "tokens", "n")
        numbered = store(numbered, "mix-cells")
        cells = _Cells(numbered, b)
        b = newton(cells.moments, b, want, float(docs))
        if b.gap > MET * scale:
            if source_targets is not None or lang_targets is not None:
                raise ValueError(f"the targets cannot be met together: a share is off by {b.gap / scale:.4f}")
            warnings.warn(f"the languages' default targets cannot be met beside the sources' (off by {b.gap / scale:.4f}); the sources' stand", stacklevel=2)
            b = newton(cells.moments, Balance(b.sources, b.langs, b.mean, b.zero), want, float(docs), fixed=True)
        return b


def _copies(rate: Column, doc_id: Column) -> Column:
    draw = F.pmod(F.xxhash64(F.coalesce(doc_id, F.lit(0).cast("long")), F.lit(1931)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def rates(docs: DataFrame, **targets) -> DataFrame:
    """(doc_id, source, lang, tokens, rate, copies) of every row, also where copies is 0."""
    facts = keep(_facts(docs).select("doc_id", "source", "lang", "tokens"), "mix-facts")
    b = balance(facts, **targets)
    return b.rated(facts).withColumn("copies", _copies(F.col("rate"), F.col("doc_id"))).select("doc_id", "source", "lang", "tokens", "rate", "copies")


def mix(docs: DataFrame, **targets) -> DataFrame:
    """The rows of docs with at least one copy, and the column mix_copies (in place
    of a column of that name)."""
    facts = _facts(docs)
    b = balance(facts.select("source", "lang", "tokens"), **targets)
    out = b.rated(facts).withColumn("_copies", _copies(F.col("rate"), F.col("doc_id"))).filter("_copies > 0")
    names, at = docs.columns, place(docs, "mix_copies")
    cols = [F.col("_copies") if i == at else F.col(f"c{i}") for i in range(len(names))] + ([F.col("_copies")] if at is None else [])
    return out.select(*cols).toDF(*names, *(["mix_copies"] if at is None else []))
