"""Spark helpers shared by the operators: sized broadcasts, ids, columns, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import keep, new_path, remove_path, scratch
from ..sources.storage import shared_folder as shared_dir
from ..sources.storage import written as store

__all__ = ["bare_columns", "components", "doc_key", "ids_and_text", "keep", "mapped", "new_path", "place", "remove_path", "scratch", "session", "shared_dir", "sized", "store", "text_of"]

#: Ids (8 bytes and overhead each) up to which a side is broadcast.
BROADCAST_IDS = 1_000_000


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def sized(ids: DataFrame, limit: int = BROADCAST_IDS, weight: Column | None = None) -> DataFrame:
    """The frame with a broadcast hint if its rows (or the sum of ``weight``, for rows with
    arrays) are counted to be few, else as it is: Spark then plans a shuffled join. Pass a
    frame that is cheap to count."""
    n = ids.limit(limit + 1).count() if weight is None else ids.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(ids) if n <= limit else ids


def place(df: DataFrame, name: str) -> int | None:
    """Where the column is, by Spark's rules on case; None where there is none. Two of the
    name are an error, as they are to Spark."""
    same = (lambda c: c == name) if df.sparkSession.conf.get("spark.sql.caseSensitive") == "true" else (lambda c: c.lower() == name.lower())
    found = [i for i, c in enumerate(df.columns) if same(c)]
    if len(found) > 1:
        raise ValueError(f"columns {[df.columns[i] for i in found]} are all {name!r}")
    return found[0] if found else None


def bare_columns(df: DataFrame) -> DataFrame:
    """The frame with its columns named c0, c1, .. by place."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def doc_key(col: str = "doc_id") -> Column:
    """The id as a whole number; ids that are none (texts such as "a") count as null."""
    return F.col(col).try_cast("long")


def text_of(df: DataFrame, name: str) -> Column:
    """Column ``name`` of ``bare_columns(df)`` as a string; nulls where there is no such column."""
    at = place(df, name)
    return F.lit(None).cast("string") if at is None else F.col(f"c{at}").cast("string")


def mapped(docs: DataFrame, names: list[str], change: Callable[[list[pa.Array], pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """All columns of docs after ``change(columns of the names as strings, rows)``, batch by
    batch. Columns go by place, so that any other column may have any name, twice too; a
    named column that is not there is all null, but for text, without which there is no work."""
    if place(docs, "text") is None:
        raise ValueError("there is no column text")
    flat = bare_columns(docs)
    #: Columns that are strings are read where they are: texts are not sent twice.
    at = [place(docs, c) for c in names]
    here = [k if k is not None and docs.schema[k].dataType == T.StringType() else None for k in at]
    more = [text_of(docs, c).alias(f"w{i}") for i, (c, k) in enumerate(zip(names, here, strict=True)) if k is None]
    n = len(more)

    def run(batches: Iterator[pa.RecordBatch]):
        for x in batches:
            rows, cast = pa.RecordBatch.from_arrays(x.columns[n:], x.schema.names[n:]), iter(x.columns[:n])
            yield change([next(cast) if k is None else rows.column(k) for k in here], rows)

    schema = T.StructType([T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(docs.schema.fields)])
    return flat.select(*more, *flat.columns).mapInArrow(run, schema).toDF(*docs.columns)


def ids_and_text(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, *extra as strings), one row for each id that is a whole number.

    Null text counts as empty. Rows that share an id are one document, for
    which the least (text, *extra) stands; only those rows are shuffled.
    """
    key = doc_key().alias("doc_id")
    more = [F.col(c).cast("string").alias(c) if place(docs, c) is not None else F.lit(None).cast("string").alias(c) for c in extra]
    flat = docs.select(key, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more).filter("doc_id is not null")
    again = docs.select(key).filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if again.isEmpty():
        return flat
    again = keep(again, "repeated-ids")
    side = sized(again)
    one = flat.join(side, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *extra)).alias("_least")).select("doc_id", "_least.*")
    return flat.join(side, "doc_id", "left_anti").unionByName(one)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): least id of each connected component of (a, b); nodes of edges only.

    Large stars and small stars in turn: each node's greater neighbours are hung
    on the least of its neighbourhood, then its lesser ones, until nothing moves,
    in a logarithmic number of rounds, each of them a written table. Least
    neighbours are found by aggregation and joined back, so a node of very many
    neighbours is in no one task.
    """
    spark = session(edges)
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    with scratch(spark):
        e = store(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
        was = mark(e)
        while True:
            both = e.select(F.col("u").alias("n"), F.col("v").alias("x")).unionByName(e.select(F.col("v").alias("n"), F.col("u").alias("x")))
            least = both.groupBy("n").agg(F.least(F.min("x"), F.col("n")).alias("m"))
            large = store(both.filter("x > n").join(least, "n").select(F.col("x").alias("u"), F.col("m").alias("v")), "large-stars")
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            e = store(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
            now = mark(e)
            if now == was:
                break
            was = now
        out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        return keep(out.unionByName(out.select(F.col("component").alias("node"), "component").distinct()), "components")
