"""Substring search with section, line and snippet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import contains, split_lines, strip
from ..sources.files import path_order

MATCHES = ["path", "id", "match_ord", "section", "line", "context"]


def lines(texts: DataFrame, key: str, text: str, query: str, case_sensitive: bool = False) -> DataFrame:
    """(key, line, context) of the lines that hold the query: built-in expressions, no shuffle.

    The context is the line and its neighbours, trimmed, blank ones left out.
    A row without the query is dropped before it is split.
    """
    if not query:
        raise ValueError("the query is empty")
    rows = texts.filter(contains(F.col(text), query, case_sensitive)).select(key, split_lines(F.col(text)).alias("_ls"))
    at = rows.select(key, "_ls", F.posexplode("_ls").alias("_i", "_line")).filter(contains(F.col("_line"), query, case_sensitive))
    return at.select(key, (F.col("_i") + 1).alias("line"), snippet(F.col("_ls"), F.col("_i")).alias("context"))


def snippet(ls, i):
    near = F.slice(ls, F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3))
    return F.array_join(F.filter(F.transform(near, strip), lambda x: x != ""), " ")


def search(docs: DataFrame, query: str, case_sensitive: bool = False, section: str | None = None, field: str | None = None, max_results: int | None = None) -> DataFrame:
    """Matches of frontmatter, then of the body, of each document, in the order of paths.

    A section leaves out frontmatter, a field leaves out bodies. Documents of
    malformed frontmatter are searched as they are. ``max_results`` limits
    documents, the first by path. (id is the title.)
    """
    if not query:
        raise ValueError("the query is empty")
    parts = []
    if section is None:
        pairs = docs.filter("fm_state = 'ok'").select("path", F.col("title").alias("id"), F.posexplode(F.array_sort(F.map_entries("fields"), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))).alias("_o", "_e"), split_lines(F.coalesce("raw", F.lit(""))).alias("_ls"))
        hit = pairs.filter(contains(F.col("_e.value.display"), query, case_sensitive))
        if field is not None:
            hit = hit.filter(F.lower("_e.key") == field.lower())
        line = F.array_position(F.transform("_ls", lambda x: F.startswith(x, F.concat(F.col("_e.key"), F.lit(":")))), True).cast("int")
        parts.append(hit.select("path", "id", F.lit(0).alias("_part"), F.col("_o"), F.lit("frontmatter").alias("section"), F.greatest(line, F.lit(1)).alias("line"), F.concat_ws(": ", "_e.key", "_e.value.display").alias("context")))
    if field is None:
        bad = F.col("fm_state") == "error"
        text = F.coalesce(F.when(bad, F.col("raw")).otherwise(F.col("body")), F.lit(""))
        body = docs.filter(contains(text, query, case_sensitive)).select("path", F.col("title").alias("id"), split_lines(text).alias("_ls"), F.when(bad, 0).otherwise(F.col("body_line_offset")).alias("_off"), F.when(bad, F.array().cast("array<struct<line:int,heading:string>>")).otherwise(F.transform("sections", lambda s: F.struct(s["line"].alias("line"), s["heading"].alias("heading")))).alias("_hs"))
        at = body.select("*", F.posexplode("_ls").alias("_o", "_line")).filter(contains(F.col("_line"), query, case_sensitive))
        here = F.coalesce(F.element_at(F.concat(F.array(F.struct(F.lit(0).alias("line"), F.lit("(root)").alias("heading"))), F.filter("_hs", lambda h: h["line"] <= F.col("_o") + 1)), -1).getField("heading"), F.lit("(root)"))
        found = at.select("path", "id", F.lit(1).alias("_part"), "_o", here.alias("section"), (F.col("_off") + F.col("_o") + 1).alias("line"), snippet(F.col("_ls"), F.col("_o")).alias("context"))
        parts.append(found if section is None else found.filter(F.lower("section") == section.lower()))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if max_results is not None:
        first = out.select("path").distinct().orderBy(path_order(F.col("path"))).limit(max_results)
        out = out.join(first, "path", "left_semi")
    from pyspark.sql import Window

    ranked = out.withColumn("match_ord", F.row_number().over(Window.partitionBy("path").orderBy("_part", "_o")) - 1)
    return ranked.select(*MATCHES).orderBy(path_order(F.col("path")), "match_ord")
