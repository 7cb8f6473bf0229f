"""Schema evolution: the difference of two schemas, its plan over documents, its application."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import strip
from ..plans.schema import Schema, Section, Type

CHANGES = "type string, kind string, name string, detail string"


def _headings(defs: list[Section]) -> set[str]:
    return {s.name for s in defs} | {x for s in defs for x in _headings(s.children)}


def changes(old: Schema, new: Schema) -> list[tuple[str, str, str, str | None]]:
    """(type, kind, name, detail), sorted: types, fields (kind, required, default), enum values, sections."""
    out: list[tuple[str, str, str, str | None]] = []
    a, b = {t.name: t for t in old.types}, {t.name: t for t in new.types}
    out += [(n, "type_added", n, None) for n in b.keys() - a.keys()] + [(n, "type_removed", n, None) for n in a.keys() - b.keys()]
    for n in a.keys() & b.keys():
        out += _of_type(a[n], b[n])
    return sorted(out, key=lambda r: (r[0], r[1], r[2], r[3] or ""))


def _of_type(a: Type, b: Type):
    f, g = {x.name: x for x in a.fields}, {x.name: x for x in b.fields}
    for n in g.keys() - f.keys():
        yield a.name, "field_added", n, g[n].default
    for n in f.keys() - g.keys():
        yield a.name, "field_removed", n, None
    for n in f.keys() & g.keys():
        x, y = f[n], g[n]
        if (x.type, x.required, x.default) != (y.type, y.required, y.default):
            yield a.name, "field_changed", n, f"{x.label()}{' required' * x.required} -> {y.label()}{' required' * y.required}"
        if x.type == y.type == "enum":
            for v in set(y.values) - set(x.values):
                yield a.name, "value_added", n, v
            for v in set(x.values) - set(y.values):
                yield a.name, "value_removed", n, v
    s, t = _headings(a.sections), _headings(b.sections)
    for n in t - s:
        yield a.name, "section_added", n, None
    for n in s - t:
        yield a.name, "section_removed", n, None


def diff(spark: SparkSession, old: Schema, new: Schema) -> DataFrame:
    return spark.createDataFrame(changes(old, new), CHANGES)


def plan(docs: DataFrame, old: Schema, new: Schema) -> DataFrame:
    """(kind, type, name, value, path): what each document needs.

    A new field where it has a default and the document lacks it; a field that
    is gone; an enum value that is no more (a person has to choose); a new
    section where no heading has its name.
    """
    todo = docs.sparkSession.createDataFrame([c for c in changes(old, new) if c[1] in ("field_removed", "value_removed", "section_added") or c[1] == "field_added" and c[3] is not None], "type string, kind string, name string, value string")
    at = docs.filter("fm_state = 'ok'").join(F.broadcast(todo), "type")
    held = F.try_element_at("fields", F.col("name"))
    titled = F.exists("sections", lambda s: F.lower(strip(s["heading"])) == F.lower("name"))
    due = (
        F.when(F.col("kind") == "field_added", held.isNull())
        .when(F.col("kind") == "field_removed", held.isNotNull())
        .when(F.col("kind") == "value_removed", F.coalesce(held["display"] == F.col("value"), F.lit(False)))
        .otherwise(~titled)
    )
    names = F.when(F.col("kind") == "field_added", "add_field").when(F.col("kind") == "field_removed", "remove_field").when(F.col("kind") == "value_removed", "removed_enum_value").otherwise("add_section")
    return at.filter(due).select(names.alias("kind"), "type", "name", "value", "path")


def summarised(actions: DataFrame) -> DataFrame:
    return actions.groupBy("kind", "type", "name", "value").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def apply(docs: DataFrame, actions: DataFrame) -> DataFrame:
    """(path, raw) of the documents that change; values that are gone are left for people."""
    from .mutate import expand_default, rewrite

    per = actions.filter("kind <> 'removed_enum_value'").groupBy("path").agg(F.to_json(F.sort_array(F.collect_list(F.struct("kind", "name", "value")))).alias("edit"))
    changed = docs.select("path", "raw").join(per, "path")

    def edit(fields, todo):
        for a in todo:
            if a["kind"] == "add_field":
                fields.setdefault(a["name"], expand_default(a["value"]))
            elif a["kind"] == "remove_field":
                fields.pop(a["name"], None)
        return fields

    def body(text, todo):
        for a in todo:
            if a["kind"] == "add_section":
                text = text.rstrip("\n") + f"\n\n# {a['name']}\n"
        return text

    return rewrite(changed, edit, body)
