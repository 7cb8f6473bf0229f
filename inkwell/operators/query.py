"""Reading: lists, fields, sections, tables, whole documents, inspection, schema description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.parse import frontmatter_json
from ..functions.scalar import strip
from ..plans.schema import Schema
from ..sources.files import path_order
from ..sources.storage import written
from .filters import shown, where


def listing(docs: DataFrame, *predicates: Column, sort: str | None = None, fields: list[str] | None = None) -> DataFrame:
    """Filtered, sorted by a field's display (``-field``: falling; missing is empty; ties by
    path, rising either way), and reduced to path and the fields."""
    key = F.coalesce(shown(sort.lstrip("-")), F.lit("")) if sort else F.lit("")
    out = where(docs, *predicates).withColumn("_key", key)
    order = [F.col("_key").desc() if (sort or "").startswith("-") else F.col("_key").asc(), path_order(F.col("path")).asc()]
    if not fields:
        return out.orderBy(*order).drop("_key")
    # written first, as a sort reads its rows twice: to sample, and to sort
    flat = written(out.select("path", "_key", *[shown(f).alias(f"_{i}") for i, f in enumerate(fields)]), "listing")
    return flat.orderBy(*order).select("path", *[F.col(f"_{i}").alias(f) for i, f in enumerate(fields)])


def positions(docs: DataFrame, sort: str) -> DataFrame:
    """(path, key, pos): places in the order that ``listing`` gives, from 1. Rows are sorted by
    ranges and numbered within each; a range's rows come after those of the ranges before."""
    key = F.col("key").desc() if sort.startswith("-") else F.col("key").asc()
    at = written(where(docs).select("path", F.coalesce(shown(sort.lstrip("-")), F.lit("")).alias("key")), "sort-keys")
    placed = written(at.orderBy(key, path_order(F.col("path"))).withColumn("_m", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_m", 33)
    before = placed.groupBy(part.alias("_p")).count().withColumn("_b", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.withColumn("_p", part).join(F.broadcast(before.select("_p", "_b")), "_p").select("path", "key", (F.col("_b") + F.col("_m").bitwiseAND((1 << 33) - 1) + 1).alias("pos"))


def list_json(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(path, json): objects of the fields that are there; null values stay."""
    value = lambda f: F.try_element_at("fields", F.lit(f)).getField("json")
    name = lambda f: F.lit(__import__("json").dumps(f) + ":")
    parts = F.array_compact(F.array(F.concat(F.lit('"path":'), _quoted(F.col("path"))), *[F.when(value(f).isNotNull(), F.concat(name(f), value(f))) for f in fields]))
    return docs.select("path", F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("json"))


def _quoted(c: Column) -> Column:
    whole = F.to_json(F.struct(c.alias("k")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def first_section(heading: str) -> Column:
    """The first heading of that text at any level, whatever its case and outer blanks."""
    return F.try_element_at(F.filter("sections", lambda s: F.lower(strip(s["heading"])) == F.lit(heading.strip().lower())), F.lit(1))


def section_at(path: list[str]) -> Column:
    """The first part as above; each further one a child exactly one level below."""
    out = first_section(path[0])
    for name in path[1:]:
        parent = out
        out = F.try_element_at(F.filter("sections", lambda s: (s["parent"] == parent.getField("ord")) & (F.lower(s["heading"]) == F.lit(name.lower()))), F.lit(1))
    return out


def section(docs: DataFrame, path: list[str]) -> DataFrame:
    """(path, section) of the documents that have it."""
    return docs.select("path", section_at(path).alias("section")).filter("section is not null")


def top_sections(docs: DataFrame) -> DataFrame:
    """Sections of the least level that a document has."""
    least = F.array_min(F.transform("sections", lambda s: s["level"]))
    return docs.withColumn("_least", least).select("path", F.explode(F.filter("sections", lambda s: s["level"] == F.col("_least"))).alias("section"))


def headings(docs: DataFrame, level: int | None = None) -> DataFrame:
    out = docs.select("path", F.explode("sections").alias("s")).select("path", "s.ord", "s.level", F.col("s.heading").alias("text"), "s.line")
    return out if level is None else out.filter(F.col("level") == level)


def tables(docs: DataFrame, path: list[str] | None = None) -> DataFrame:
    """(path, heading, table_idx, headers, rows) of a section, those of its subsections too, or of all."""
    if path is not None:
        s = docs.select("path", section_at(path).alias("s"))
    else:
        s = docs.select("path", F.explode("sections").alias("s"))
    return s.select("path", F.col("s.heading").alias("heading"), F.posexplode("s.tables").alias("table_idx", "t")).select("path", "heading", "table_idx", "t.headers", "t.rows")


def cells(found: DataFrame) -> DataFrame:
    """Tables in long form: (path, heading, table_idx, row_idx, column, value)."""
    rows = found.select("path", "heading", "table_idx", "headers", F.posexplode("rows").alias("row_idx", "row"))
    return rows.select("path", "heading", "table_idx", "row_idx", F.inline(F.arrays_zip(F.col("headers").alias("column"), F.col("row").alias("value"))))


def column(found: DataFrame, name: str) -> DataFrame:
    """(path, heading, table_idx, values) of the first column of that name."""
    at = F.nullif(F.array_position("headers", name).cast("int"), F.lit(0))
    return found.filter(at.isNotNull()).select("path", "heading", "table_idx", F.transform("rows", lambda r: F.try_element_at(r, at)).alias("values"))


def cell(found: DataFrame, name: str, row: int) -> DataFrame:
    return column(found, name).select("path", "heading", "table_idx", F.try_element_at("values", F.lit(row + 1)).alias("value")).filter("value is not null")


def row(found: DataFrame, number: int) -> DataFrame:
    """(path, heading, table_idx, cells) of the row of that number, from 0, where there is one."""
    return found.select("path", "heading", "table_idx", F.try_element_at("rows", F.lit(number + 1)).alias("cells")).filter("cells is not null")


def parse_cell(text: str) -> tuple[str, int]:
    """``Column,Row`` as (column, row)."""
    name, sign, number = text.partition(",")
    if not sign or not number.strip().isdecimal():
        raise ValueError(f"a cell is Column,Row: {text!r}")
    return name, int(number)


def table_objects(found: DataFrame) -> DataFrame:
    """Each row as a map of its cells; ragged rows end with the shorter side."""
    return found.select("path", "heading", "table_idx", F.transform("rows", lambda r: F.map_from_entries(F.filter(F.arrays_zip(F.col("headers").alias("k"), r.alias("v")), lambda e: e["k"].isNotNull() & e["v"].isNotNull()))).alias("objects"))


def links(docs: DataFrame) -> DataFrame:
    return docs.select("path", F.posexplode("links").alias("ord", "url"))


def documents_json(docs: DataFrame) -> DataFrame:
    """(path, json): frontmatter, sections and body of whole documents."""
    inner = F.to_json(F.struct("path", F.transform("sections", lambda s: F.struct(s["heading"].alias("heading"), s["level"].alias("level"), s["content"].alias("content"))).alias("sections"), "body"))
    return docs.select("path", F.concat(F.lit('{"frontmatter":'), frontmatter_json(docs), F.lit(","), F.substring(inner, F.lit(2), F.length(inner))).alias("json"))


def inspect(docs: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Frontmatter, top sections with their sizes in bytes, and diagnostics of each document."""
    least = F.array_min(F.transform("sections", lambda s: s["level"]))
    tops = F.transform(F.filter("sections", lambda s: s["level"] == F.col("_least")), lambda s: F.struct(s["heading"].alias("heading"), s["level"].alias("level"), F.octet_length(s["content"]).alias("content_length")))
    found = diagnostics.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("stage", "o1", "o2", "severity", "code", "location", "message"))).alias("diagnostics"))
    return docs.withColumn("_least", least).select("path", "id", "type", frontmatter_json(docs).alias("frontmatter"), F.to_json(tops).alias("sections")).join(found, "path", "left").withColumn("diagnostics", F.to_json(F.coalesce("diagnostics", F.expr("array()"))))


def describe(spark: SparkSession, schema: Schema, what: str = "overview", type_name: str | None = None) -> DataFrame:
    """The schema as rows: overview, fields, sections, relations, rules or formats."""
    f = schema.frames(spark)
    only = (lambda d: d.filter(F.col("type") == type_name)) if type_name else (lambda d: d)
    match what:
        case "overview":
            n = f["fields"].groupBy("type").agg(F.count(F.lit(1)).alias("n_fields"), F.count_if("required").alias("n_required"))
            return only(f["types"]).join(n, "type", "left").na.fill(0, ["n_fields", "n_required"]).orderBy("ord")
        case "fields" | "sections" | "relations" | "rules" | "columns":
            return f[what] if what == "relations" else only(f[what])
        case "formats":
            return spark.createDataFrame(schema.ref_formats, "name string, pattern string")
    raise ValueError(f"cannot describe {what!r}")
