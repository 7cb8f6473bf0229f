"""Differences between two versions of documents: fields, sections, lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import split_lines

_RANK = {"added": 0, "changed": 1, "modified": 1, "removed": 2}


def _entries(docs: DataFrame) -> DataFrame:
    return docs.filter("fm_state = 'ok'").select("path", F.explode(F.map_entries("fields")).alias("e")).select("path", F.col("e.key").alias("field"), F.col("e.value.json").alias("json"), F.col("e.value.display").alias("shown"))


def fields(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, field, change, old_value, new_value): values are compared by structure."""
    a = _entries(old).select("path", "field", F.col("json").alias("j0"), F.col("shown").alias("old_value"))
    b = _entries(new).select("path", "field", F.col("json").alias("j1"), F.col("shown").alias("new_value"))
    both = a.join(b, ["path", "field"], "full_outer")
    change = F.when(F.col("j0").isNull(), "added").when(F.col("j1").isNull(), "removed").when(F.col("j0") != F.col("j1"), "changed")
    return both.withColumn("change", change).filter("change is not null").select("path", "field", "change", "old_value", "new_value")


def _sections(docs: DataFrame) -> DataFrame:
    """One row for each section by its path of headings; of equal paths the first."""
    at = docs.select("path", F.inline("sections").alias(*["ord", "parent", "level", "heading", "line", "names", "raw", "content", "n_paragraphs", "n_lists", "n_items", "code_infos", "text", "tables"]))
    reachable = at.withColumn("_top", F.min("level").over(Window.partitionBy("path"))).filter("parent is not null or level = _top")
    first = Window.partitionBy("path", "section").orderBy("ord")
    return reachable.select("path", F.array_join("names", " > ").alias("section"), "ord", "content").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def sections(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, section, change, lines_added, lines_removed): lines that the other version does
    not have, counted with their repeats."""
    a = _sections(old).select("path", "section", F.col("content").alias("c0"))
    b = _sections(new).select("path", "section", F.col("content").alias("c1"))
    both = a.join(b, ["path", "section"], "full_outer")
    change = F.when(F.col("c0").isNull(), "added").when(F.col("c1").isNull(), "removed").when(F.col("c0") != F.col("c1"), "modified")
    return both.withColumn("change", change).filter("change is not null").select("path", "section", "change", *line_counts(F.col("c0"), F.col("c1")))


def line_counts(old, new):
    """Columns lines_added and lines_removed."""
    a, b = F.coalesce(split_lines(old), F.array().cast("array<string>")), F.coalesce(split_lines(new), F.array().cast("array<string>"))
    return [F.size(F.filter(b, lambda x: ~F.array_contains(a, x))).alias("lines_added"), F.size(F.filter(a, lambda x: ~F.array_contains(b, x))).alias("lines_removed")]


def ordered(changes: DataFrame, name: str) -> DataFrame:
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in _RANK.items() for x in kv]), F.col("change"))
    return changes.orderBy("path", rank, name)
