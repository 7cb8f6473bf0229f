"""Document schemas: types with fields, sections and rules; relations; reference formats.

A schema is a driver object of a few hundred entries at most. ``frames`` gives
it as small tables, which operators broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .kdl import Node, SchemaError, parse

FIELD_TYPES = ("string", "number", "bool", "enum", "ref", "string[]", "ref[]", "user", "user[]")
COLUMN_TYPES = ("string", "number", "user")


@dataclass
class Field:
    name: str
    type: str = "string"
    required: bool = False
    pattern: str | None = None
    description: str | None = None
    default: str | None = None
    values: list[str] = field(default_factory=list)

    def label(self) -> str:
        return f"enum({', '.join(self.values)})" if self.type == "enum" else self.type


@dataclass
class Column:
    name: str
    type: str = "string"
    required: bool = False
    description: str | None = None


@dataclass
class Table:
    required: bool = False
    description: str | None = None
    columns: list[Column] = field(default_factory=list)


@dataclass
class Section:
    name: str
    required: bool = False
    description: str | None = None
    children: list["Section"] = field(default_factory=list)
    table: Table | None = None
    min_paragraphs: int | None = None
    list_required: bool = False
    list_min_items: int | None = None
    has_list: bool = False
    diagram_required: bool = False
    diagram_type: str | None = None


@dataclass
class Rule:
    name: str
    when_field: str
    when_equals: str
    then_required: list[str]


@dataclass
class Type:
    name: str
    description: str | None = None
    folder: str | None = None
    max_count: int | None = None
    match: str | None = None  # of a singleton
    fields: list[Field] = field(default_factory=list)
    sections: list[Section] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)

    @property
    def singleton(self) -> bool:
        return self.match is not None


@dataclass
class Relation:
    name: str
    inverse: str | None = None
    cardinality: str = "many"
    description: str | None = None
    acyclic: bool = False


def _arg(node: Node, what: str) -> str:
    if not node.args or not isinstance(node.args[0], str):
        raise SchemaError(f"{what} needs a name")
    return node.args[0]


def _flag(node: Node, name: str, default: bool = False) -> bool:
    v = node.props.get(name, default)
    if not isinstance(v, bool):
        raise SchemaError(f"{name} of {node.name} is a boolean")
    return v


def _whole(node: Node, name: str) -> int | None:
    v = node.props.get(name)
    return v if isinstance(v, int) and not isinstance(v, bool) else None


def _str(node: Node, name: str) -> str | None:
    v = node.props.get(name)
    return v if isinstance(v, str) else None


@dataclass
class Schema:
    types: list[Type] = field(default_factory=list)
    relations: list[Relation] = field(default_factory=list)
    ref_formats: list[tuple[str, str]] = field(default_factory=list)

    @classmethod
    def read(cls, path: str) -> "Schema":
        return cls.parse(Path(path).read_text())

    @classmethod
    def parse(cls, text: str) -> "Schema":
        out = cls()
        for n in parse(text):
            match n.name:
                case "type":
                    out.types.append(_type(n))
                case "relation":
                    kind = n.props.get("cardinality", "many")
                    if kind not in ("one", "many"):
                        raise SchemaError(f"cardinality is one or many, not {kind!r}")
                    out.relations.append(Relation(_arg(n, "relation"), _str(n, "inverse"), kind, _str(n, "description"), _flag(n, "acyclic")))
                case "ref-format":
                    for c in n.children or []:
                        if not _str(c, "pattern"):
                            raise SchemaError(f"reference format {c.name} needs a pattern")
                        out.ref_formats.append((c.name, c.props["pattern"]))
                case other:
                    raise SchemaError(f"unknown node {other!r}")
        return out

    def type(self, name: str) -> Type | None:
        return next((t for t in self.types if t.name == name), None)

    def relation(self, name: str) -> tuple[Relation, bool] | None:
        """(relation, whether the name is its inverse); the first that fits."""
        return next(((r, r.name != name) for r in self.relations if name in (r.name, r.inverse)), None)

    def relation_names(self) -> list[str]:
        return [x for r in self.relations for x in (r.name, r.inverse) if x]

    def ref_fields(self, type_name: str | None) -> list[str]:
        t = self.type(type_name) if type_name else None
        return self.relation_names() + [f.name for f in (t.fields if t else []) if f.type in ("ref", "ref[]")]

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        """types, fields, sections, columns, relations, rules as tables."""
        sections, columns = [], []

        def flat(t: Type, defs: list[Section], path: list[str], parent: int):
            for s in defs:
                me = len(sections)
                sections.append((t.name, me, parent, len(path), [*path, s.name], s.name, s.required, s.description, s.min_paragraphs, s.has_list, s.list_required, s.list_min_items, s.diagram_required, s.diagram_type, s.table is not None, s.table.required if s.table else False))
                columns.extend((t.name, me, s.name, c.name, c.type, c.required, i) for i, c in enumerate(s.table.columns if s.table else []))
                flat(t, s.children, [*path, s.name], me)

        for t in self.types:
            flat(t, t.sections, [], -1)
        make = spark.createDataFrame
        return {
            "types": make([(t.name, i, t.description, t.folder, t.max_count, t.match) for i, t in enumerate(self.types)], "type string, ord int, description string, folder string, max_count int, match string"),
            "fields": make([(t.name, f.name, f.type, f.required, f.pattern, f.description, f.default, f.values, i) for t in self.types for i, f in enumerate(t.fields)], "type string, name string, field_type string, required boolean, pattern string, description string, default string, enum_values array<string>, ord int"),
            "sections": make(sections, "type string, section_id int, parent_id int, depth int, path array<string>, name string, required boolean, description string, min_paragraphs int, has_list boolean, list_required boolean, list_min_items int, diagram_required boolean, diagram_type string, has_table boolean, table_required boolean"),
            "columns": make(columns, "type string, section_id int, section string, name string, col_type string, required boolean, ord int"),
            "relations": make([(n, r.name, n != r.name, (r.name if n != r.name else r.inverse), r.cardinality, r.acyclic, i) for i, (n, r) in enumerate((n, self.relation(n)[0]) for n in self.relation_names())], "field string, relation string, is_inverse boolean, inverse_field string, cardinality string, acyclic boolean, ord int"),
            "rules": make([(t.name, r.name, r.when_field, r.when_equals, r.then_required, i) for t in self.types for i, r in enumerate(t.rules)], "type string, name string, when_field string, when_equals string, then_required array<string>, ord int"),
        }


def _type(n: Node) -> Type:
    if n.children is None:
        raise SchemaError(f"type {n.args} has no body")
    t = Type(_arg(n, "type"), _str(n, "description"), _str(n, "folder"), _whole(n, "max_count"))
    single = _flag(n, "singleton")
    for c in n.children:
        match c.name:
            case "field":
                t.fields.append(_field(c))
            case "section":
                t.sections.append(_section(c))
            case "rule":
                t.rules.append(_rule(c))
            case "match":
                t.match = _arg(c, "match")
            case other:
                raise SchemaError(f"unknown node {other!r} in type {t.name!r}")
    if single and (t.fields or not t.match):
        raise SchemaError(f"singleton {t.name!r} has a match and no fields")
    if not single:
        t.match = None
    return t


def _field(n: Node) -> Field:
    f = Field(_arg(n, "field"), n.props.get("type", "string"), _flag(n, "required"), _str(n, "pattern"), _str(n, "description"), None if n.props.get("default") is None else _literal(n.props["default"]))
    if f.type not in FIELD_TYPES:
        raise SchemaError(f"unknown field type {f.type!r}")
    f.values = [str(a) for c in n.children or [] if c.name == "values" for a in c.args]
    if f.type == "enum" and not f.values:
        raise SchemaError(f"enum {f.name!r} has no values")
    return f


def _literal(v) -> str:
    return str(v).lower() if isinstance(v, bool) else str(v)


def _section(n: Node) -> Section:
    s = Section(_arg(n, "section"), _flag(n, "required"), _str(n, "description"))
    for c in n.children or []:
        match c.name:
            case "section":
                s.children.append(_section(c))
            case "table":
                s.table = Table(_flag(c, "required"), _str(c, "description"))
                for x in c.children or []:
                    if x.name == "column":
                        kind = x.props.get("type", "string")
                        if kind not in COLUMN_TYPES:
                            raise SchemaError(f"unknown column type {kind!r}")
                        s.table.columns.append(Column(_arg(x, "column"), kind, _flag(x, "required"), _str(x, "description")))
            case "content":
                s.min_paragraphs = _whole(c, "min-paragraphs")
            case "list":
                s.has_list, s.list_required, s.list_min_items = True, _flag(c, "required", True), _whole(c, "min-items")
            case "diagram":
                s.diagram_required, s.diagram_type = _flag(c, "required", True), _str(c, "type")
            case other:
                raise SchemaError(f"unknown node {other!r} in section {s.name!r}")
    return s


def _rule(n: Node) -> Rule:
    when = next((c for c in n.children or [] if c.name == "when"), None)
    then = [_arg(c, "then-required") for c in n.children or [] if c.name == "then-required"]
    if when is None or not isinstance(when.props.get("equals"), str) or not then:
        raise SchemaError(f"rule {n.args} needs when .. equals and then-required")
    return Rule(_arg(n, "rule"), _arg(when, "when"), when.props["equals"], then)
