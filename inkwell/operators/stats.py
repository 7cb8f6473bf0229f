"""Aggregate health of a document set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import degrees, orphans, ranked


def by_type_status(docs: DataFrame) -> DataFrame:
    """(type, status, n); a null status is the row of the type's total."""
    some = docs.filter("fm_state = 'ok' and type is not null")
    both = some.rollup("type", "status").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    return both.filter("level = 1 or level = 0 and status is not null").select("type", "status", "n")


def by_code(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


def staleness(docs: DataFrame, id_: str = "id", mtime: str = "mtime") -> DataFrame:
    """One row: the oldest (ties to the least id) and the newest (ties to the greatest)."""
    pair = F.struct(F.col(mtime), F.col(id_))
    return docs.agg(F.min_by(id_, pair).alias("oldest_id"), F.to_date(F.min(mtime)).alias("oldest"), F.max_by(id_, pair).alias("newest_id"), F.to_date(F.max(mtime)).alias("newest"))


def summary(docs: DataFrame, e: DataFrame, n: DataFrame) -> DataFrame:
    """One row: documents, edges, orphans, the most referenced and the most referring."""
    d = degrees(e)
    one = docs.filter("fm_state = 'ok' and type is not null").agg(F.count(F.lit(1)).alias("documents"))
    one = one.crossJoin(e.agg(F.count(F.lit(1)).alias("edges"))).crossJoin(orphans(e, n).agg(F.count(F.lit(1)).alias("orphans")))
    for by, name in (("n_in", "most_referenced"), ("n_out", "most_referring")):
        top = ranked(d, by).select(F.col("id").alias(name), F.col(by).alias(f"{name}_{by}"))
        one = one.join(top, F.lit(True), "left")
    return one
