"""Document trees as tables of files, the metadata snapshot, and writers."""

from __future__ import annotations

import fnmatch
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import hadoop_path

FILES = "path string, raw string, size long, mtime timestamp"


def _ignore_patterns(spark: SparkSession, root: str) -> list[tuple[bool, str]]:
    """Lines of the root's ignore file, on any file system."""
    fs, at = hadoop_path(spark, f"{root.rstrip('/')}/.gitignore")
    if not fs.exists(at):
        return []
    stream = fs.open(at)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    lines = [x.strip() for x in text.splitlines()]
    return [(x.startswith("!"), x.lstrip("!")) for x in lines if x and not x.startswith("#")]


def _ignore_expression(pattern: str) -> str:
    """A line of the root's ignore file as a regular expression of relative paths."""
    anchored = "/" in pattern.rstrip("/")
    body = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t, re.sub(r"([\\.^$|+()\[\]{}])", r"\\\1", t)) for t in re.findall(r"\*\*/|\*\*|.", pattern.strip("/")))
    return ("^" if anchored else "^(?:.*/)?") + body + ("/.*$" if pattern.endswith("/") else "(?:/.*)?$")


def glob_expression(glob: str) -> str:
    return fnmatch.translate(glob).replace("(?s:", "(?s)(?:").replace("\\Z", "\\z")


def scan(spark: SparkSession, root: str, pattern: str = "*.md", no_ignore: bool = False) -> DataFrame:
    """(path relative to root, raw, size, mtime) of the files whose name fits, each whole.

    Listing and reading are distributed; the root's ignore file is a filter on
    paths, which Spark applies before the texts are used.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    base = root.removeprefix("file://").rstrip("/")
    at = F.regexp_replace(path, "^(?:file:/*|[a-z0-9]+://[^/]*)?" + re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", base if base.startswith("/") else "/" + base).replace("/", "/+", 1) + "/", "")
    out = files.select(at.alias("path"), F.col("value").alias("raw"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("mtime"))
    if not no_ignore:
        hidden = F.lit(False)
        for keep, p in _ignore_patterns(spark, root):
            hidden = F.when(F.col("path").rlike(_ignore_expression(p)), F.lit(not keep)).otherwise(hidden)
        out = out.filter(~hidden)
    return out


def scan_names(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """Files of these exact names; nothing is ignored."""
    return scan(spark, root, "*", no_ignore=True).filter(F.element_at(F.split("path", "/"), -1).isin(names))


def scan_paths(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """The listed Markdown files that exist."""
    listed = spark.createDataFrame([(p.strip(),) for p in paths if p.strip().endswith(".md")], "path string").distinct()
    return scan(spark, root, no_ignore=True).join(F.broadcast(listed) if len(paths) <= 100_000 else listed, "path")


def one(spark: SparkSession, text: str, path: str | None = None) -> DataFrame:
    """A document that is given as text."""
    return spark.createDataFrame([(path, text)], "path string, raw string")


def path_order(path: Column) -> Column:
    """Paths sort by their parts."""
    return F.split(path, "/")


def snapshot(files: DataFrame) -> DataFrame:
    """What the metadata cache keeps: path, hash of the content, mtime in seconds, size."""
    return files.select("path", F.xxhash64("raw").alias("hash"), F.unix_timestamp("mtime").alias("mtime"), "size")


def stale(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, changed (mtime or size differ) or removed, between snapshots."""
    a, b = old.select("path", F.col("mtime").alias("m0"), F.col("size").alias("s0"), F.lit(1).alias("o")), new.select("path", F.col("mtime").alias("m1"), F.col("size").alias("s1"), F.lit(1).alias("n"))
    both = a.join(b, "path", "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~(F.col("m0").eqNullSafe(F.col("m1")) & F.col("s0").eqNullSafe(F.col("s1"))), "changed")
    return both.select("path", change.alias("change")).filter("change is not null")


def write_files(docs: DataFrame, root: str, column: str = "raw", suffix: str | None = None) -> None:
    """Writes each row's text to root/path, over what is there. The root is a folder that
    executors share; a task writes a file of its own name and renames it, so retries do no harm."""
    if "://" in root and not root.startswith("file://"):
        raise ValueError(f"{root} is no folder that tasks can write files to; mount it, or write a table")
    base = root.removeprefix("file://")

    def write(rows):
        import uuid

        for r in rows:
            at = os.path.join(base, r.path if suffix is None else os.path.splitext(r.path)[0].lower() + suffix)
            os.makedirs(os.path.dirname(at) or ".", exist_ok=True)
            part = f"{at}.{uuid.uuid4().hex}.part"
            with open(part, "w", encoding="utf-8", newline="") as f:
                f.write(r[1])
            os.replace(part, at)

    docs.select("path", column).foreachPartition(write)
