"""Changes of documents as new texts: fields, sections, tables, bulk edits, renames, fixes, templates.

Every operator returns (path, raw) of the documents that change, for review; the
sink writes them. One Arrow pass renders, and only over documents that change.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frontmatter as fm
from ..functions.markdown import blocks, parse_body, split_lines, split_row
from ..functions.parse import slices
from ..functions.scalar import closest, normal_id
from ..plans.schema import Schema, Section
from ..sources.storage import written
from .filters import where


def rewrite(changed: DataFrame, fields: Callable | None = None, body: Callable | None = None) -> DataFrame:
    """(path, raw, edit as JSON) to (path, raw) with edited frontmatter and body. Documents of
    malformed frontmatter are left out."""

    def change(path, raw, edit):
        state, values, _, text, _ = fm.parse(raw or "")
        if state == "error":
            return None
        todo = json.loads(edit)
        new = fields(dict(values), todo) if fields else values
        after = body(text, todo) if body else text
        if new != values or state == "ok" and after != text and new:
            raw = fm.render(new, after)
        elif after != text:
            raw = after if state == "absent" else fm.render(new, after)
        return path, raw

    def run(batches):
        for batch in batches:
            for x in slices(batch, "raw"):
                out = [r for t in zip(*(x.column(c).to_pylist() for c in ("path", "raw", "edit")), strict=True) if (r := change(*t))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in (0, 1)], ["path", "raw"])

    return changed.select("path", "raw", "edit").mapInArrow(run, "path string, raw string")


def set_fields(docs: DataFrame, values: dict[str, str], *, literal: bool = True) -> DataFrame:
    """Fields set, on all of docs; frontmatter is made where there is none."""
    edit = json.dumps({k: fm.coerce(v) if literal else v for k, v in values.items()})
    return rewrite(docs.select("path", "raw", F.lit(edit).alias("edit")), lambda f, e: {**f, **e})


def remove_field(docs: DataFrame, name: str) -> DataFrame:
    return rewrite(docs.filter(F.map_contains_key("fields", F.lit(name))).select("path", "raw", F.lit("{}").alias("edit")), lambda f, _: {k: v for k, v in f.items() if k != name})


def batch(docs: DataFrame, predicates: list[Column], values: dict[str, str]) -> DataFrame:
    """Bulk edit: refused without a predicate."""
    if not predicates:
        raise ValueError("a bulk edit needs a filter")
    return set_fields(where(docs, *predicates), values)


def deprecate(docs: DataFrame, path: str, superseded_by: str | None = None) -> DataFrame:
    values = {"status": "superseded", "superseded_by": normal_id(superseded_by)} if superseded_by else {"status": "deprecated"}
    return set_fields(docs.filter(F.col("path") == path), values, literal=False)


def _span(text: str, path: list[str]) -> tuple[list[str], int, int]:
    """(lines, first line of the section's content, line after it)."""
    found = None
    sections = parse_body(text)["sections"]
    for i, name in enumerate(path):
        found = next((s for s in sections if s["heading"].strip().lower() == name.strip().lower() and (i == 0 or s["parent"] == found["ord"])), None)
        if found is None:
            raise KeyError(" > ".join(path))
    lines = split_lines(text)
    return lines, found["line"], found["line"] + len(split_lines(found["content"]))


def _section_edit(docs: DataFrame, path: list[str], content: str, change: Callable) -> DataFrame:
    def body(text, e):
        try:
            lines, a, b = _span(text, e["path"])
        except KeyError:
            return text
        return "\n".join([*lines[:a], *change(lines[a:b], e["content"]), *lines[b:]]) + "\n"

    return rewrite(docs.select("path", "raw", F.lit(json.dumps({"path": path, "content": content})).alias("edit")), None, body)


def replace_section(docs: DataFrame, path: list[str], content: str) -> DataFrame:
    """New content, in place of subsections too; documents without the section stay as they are."""
    return _section_edit(docs, path, content, lambda _, new: ["", *split_lines(new.strip("\n") + "\n"), ""])


def append_section(docs: DataFrame, path: list[str], content: str) -> DataFrame:
    """Content added after a blank line."""

    def add(old, new):
        while old and not old[-1].strip():
            old = old[:-1]
        return [*old, "", *split_lines(new.strip("\n") + "\n"), ""]

    return _section_edit(docs, path, content, add)


def table_markdown(headers: list[str], rows: list[list[str]]) -> list[str]:
    """Lines of a table; rows are filled up or cut to the headers, bars in cells are escaped."""
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
    fit = lambda r: [*r, *[""] * len(headers)][: len(headers)]
    return [line(headers), "|" + "|".join(" --- " for _ in headers) + "|", *[line(fit(r)) for r in rows]]


def _table_edit(docs: DataFrame, path: list[str], edit: dict, change: Callable) -> DataFrame:
    def body(text, e):
        try:
            lines, a, b = _span(text, e["path"])
        except KeyError:
            return text
        table = next((x for t in blocks(lines[a:b], a) for x in t.walk() if x.kind == "table"), None)
        if table is None:
            return text
        whole = [split_row(x) for k, x in enumerate(lines[table.start : table.end]) if k != 1]
        headers, rows = change(whole[0], whole[1:], e)
        return "\n".join([*lines[: table.start], *table_markdown(headers, rows), *lines[table.end :]]) + "\n"

    return rewrite(docs.select("path", "raw", F.lit(json.dumps({**edit, "path": path})).alias("edit")), None, body)


def set_cell(docs: DataFrame, path: list[str], column: str, row: int, value: str) -> DataFrame:
    """A cell of the section's first table; no such cell, no change."""

    def change(headers, rows, e):
        if e["column"] in headers and e["row"] < len(rows):
            at = headers.index(e["column"])
            rows[e["row"]] = [*rows[e["row"]], *[""] * len(headers)][: len(headers)]
            rows[e["row"]][at] = e["value"]
        return headers, rows

    return _table_edit(docs, path, {"column": column, "row": row, "value": value}, change)


def add_row(docs: DataFrame, path: list[str], cells: list[str]) -> DataFrame:
    return _table_edit(docs, path, {"cells": cells}, lambda h, r, e: (h, [*r, e["cells"]]))


def parse_cells(text: str) -> list[str]:
    """Cells between commas; ``\\,`` is a comma."""
    return [c.replace("\0", ",").strip() for c in text.replace("\\,", "\0").split(",")]


def rename(docs: DataFrame, schema: Schema, path: str, new_id: str) -> tuple[DataFrame, str]:
    """((path, raw) of documents whose references change, the file's new path).

    Relation and reference fields are rewritten, whatever their case; links in
    bodies and references of the document to itself stay.
    """
    old = normal_id(path)
    folder, _, name = path.rpartition("/")
    stem = name.removesuffix(".md")
    rest = stem[len(old) :] if stem.upper().replace("_", "-").startswith(old) else ""
    target = (folder + "/" if folder else "") + new_id.lower() + rest + ".md"
    by_type = {t.name: schema.ref_fields(t.name) for t in schema.types}
    related, new = schema.relation_names(), normal_id(new_id)
    pointing = F.exists(F.map_values("fields"), lambda v: (F.upper(v["display"]) == old) | F.coalesce(F.exists(v["items"], lambda x: F.upper(x["value"]) == old), F.lit(False)))
    changed = docs.filter((F.col("path") != path) & (F.col("fm_state") == "ok") & pointing).select("path", "raw", F.to_json(F.struct(F.coalesce("type", F.lit("")).alias("type"))).alias("edit"))

    def edit(fields, e):
        swap = lambda v: new if isinstance(v, str) and v.upper() == old else v
        for k in by_type.get(e["type"], related):
            if k in fields:
                fields[k] = [swap(x) for x in fields[k]] if isinstance(fields[k], list) else swap(fields[k])
        return fields

    return rewrite(changed, edit), target


def rename_apply(docs: DataFrame, schema: Schema, root: str, path: str, new_id: str) -> str:
    """Writes the changed documents under the root, then moves the file; its new path."""
    from ..sources.files import write_files
    from ..sources.storage import hadoop_path

    new, target = rename(docs, schema, path, new_id)
    fs, source = hadoop_path(docs.sparkSession, f"{root.rstrip('/')}/{path}")
    _, there = hadoop_path(docs.sparkSession, f"{root.rstrip('/')}/{target}")
    if not fs.exists(source) or fs.exists(there):
        raise ValueError(f"{path} is not there" if not fs.exists(source) else f"{target} is there already")
    write_files(new, root)
    if not fs.rename(source, there):
        raise OSError(f"{path} could not be moved to {target}")
    return target


def today() -> str:
    return dt.datetime.now(dt.UTC).strftime("%Y-%m-%d")


def now() -> str:
    return dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def expand_default(text: str):
    return today() if text == "$TODAY" else now() if text == "$NOW" else fm.coerce(text)


def fix_plan(docs: DataFrame, diagnostics: DataFrame, schema: Schema) -> DataFrame:
    """(path, code, name, value, depth): what can be mended. F010 by the field's default, F021
    by the nearest value (at most half its length of edits, or 2), S010 by a heading."""
    tables = schema.frames(docs.sparkSession)
    enums = sorted({f.name for t in schema.types for f in t.fields if f.type == "enum"})
    shown = [F.try_element_at("fields", F.lit(k))["display"].alias(f"held_{i}") for i, k in enumerate(enums)]
    # joined once, for the three kinds
    d = written(diagnostics.filter(F.col("code").isin("F010", "F021", "S010")).select("path", "code", "o1").join(docs.select("path", "type", *shown), "path"), "fixable")
    fields = F.broadcast(tables["fields"].withColumnRenamed("ord", "o1"))
    out = d.filter("code = 'F010'").join(fields, ["type", "o1"]).filter("default is not null").select("path", "code", "name", F.col("default").alias("value"), F.lit(0).alias("depth"))
    for t in schema.types:
        for i, f in enumerate(t.fields):
            if f.type == "enum":
                held = F.col(f"held_{enums.index(f.name)}")
                near = closest(held, f.values, F.greatest(F.floor(F.length(held) / 2), F.lit(2)))
                out = out.unionByName(d.filter((F.col("code") == "F021") & (F.col("type") == t.name) & (F.col("o1") == i)).select("path", "code", F.lit(f.name).alias("name"), near.alias("value"), F.lit(0).alias("depth")).filter("value is not null"))
    sections = F.broadcast(tables["sections"].select(F.col("section_id").alias("o1"), "name", "depth"))
    return out.unionByName(d.filter("code = 'S010'").join(sections, "o1").select("path", "code", "name", F.lit(None).cast("string").alias("value"), "depth"))


def fix_apply(docs: DataFrame, actions: DataFrame) -> DataFrame:
    per = actions.groupBy("path").agg(F.to_json(F.sort_array(F.collect_list(F.struct("code", "depth", "name", "value")))).alias("edit"))

    def edit(fields, todo):
        for a in todo:
            if a["code"] == "F010":
                fields.setdefault(a["name"], expand_default(a["value"]))
            elif a["code"] == "F021":
                fields[a["name"]] = a["value"]
        return fields

    def body(text, todo):
        for a in todo:
            if a["code"] == "S010":
                text = text.rstrip("\n") + f"\n\n{'#' * (a['depth'] + 1)} {a['name']}\n"
        return text

    return rewrite(docs.select("path", "raw").join(per, "path"), edit, body)


def template(schema: Schema, type_name: str, values: dict[str, str] | None = None, fill: bool = False) -> str:
    """A new document: defaults, dates for date patterns, and the sections with their tables."""
    t = schema.type(type_name)
    if t is None:
        raise ValueError(f"no type {type_name!r}")
    fields: dict = {"type": type_name}
    for f in t.fields:
        if f.default is not None:
            fields[f.name] = expand_default(f.default)
        elif f.required or fill:
            dated = f.pattern and "\\d{4}-\\d{2}-\\d{2}" in f.pattern
            fields[f.name] = (now() if dated and "T" in f.pattern else today()) if dated else {"number": 0, "bool": False, "enum": f.values[0] if f.values else "", "user": "@"}.get(f.type, [] if f.type.endswith("[]") else "")
    fields |= {k: fm.coerce(v) for k, v in (values or {}).items()}

    def scaffold(s: Section, level: int) -> list[str]:
        out = ["#" * level + " " + s.name, ""]
        if s.table and s.table.columns:
            out += [*table_markdown([c.name for c in s.table.columns], []), ""]
        for c in s.children:
            out += scaffold(c, level + 1)
        return out

    return fm.render(fields, "\n" + "\n".join(x for s in t.sections for x in scaffold(s, 1)))


def new_document(spark: SparkSession, nodes: DataFrame, schema: Schema, type_name: str, values: dict[str, str] | None = None) -> DataFrame:
    """(path, raw) of a new document, in its type's folder, with the next free number."""
    from .graph import next_id

    t = schema.type(type_name)
    id_ = next_id(nodes, type_name).first().next_id.lower()
    return spark.createDataFrame([(f"{t.folder.rstrip('/') + '/' if t and t.folder else ''}{id_}.md", template(schema, type_name, values))], "path string, raw string")

