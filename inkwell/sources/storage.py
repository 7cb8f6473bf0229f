"""Tables in the folder that all executors share, and their removal.

A table that is written here lasts until the application ends at most; those
written within ``scratch`` go when it is left, but for what ``keep`` writes.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths written within each open scope, the innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where there is none, a session that runs on one
    machine (``local[..]``) gets a temporary folder, made once; any other is refused."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="inkwell-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/inkwell/{tag}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove_path(spark: SparkSession, path: str) -> None:
    fs, where = hadoop_path(spark, path)
    fs.delete(where, True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that are written within are removed at the end: what is returned has to be
    ``keep``'s, or not depend on them."""
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), paths))
    try:
        yield
    finally:
        _scopes.reset(token)
        for p in paths:
            remove_path(spark, p)


def _put(df: DataFrame, tag: str, scope: int) -> DataFrame:
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    fs, where = hadoop_path(spark, path)
    fs.deleteOnExit(where)
    open_ = _scopes.get()
    if len(open_) >= scope:
        open_[-scope].append(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, tag: str) -> DataFrame:
    """The frame, written as Parquet and read again: its lineage ends there."""
    return _put(df, tag, 1)


def keep(df: DataFrame, tag: str) -> DataFrame:
    """As ``written``, for what outlives the innermost scope."""
    return _put(df, tag, 2)
