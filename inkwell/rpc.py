"""Ten tools over JSON-RPC lines, on one session: a terminal for programs.

``serve`` reads a request a line and writes a response a line. Tools that
change documents give the new texts, and write them only when ``write`` is true.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.parse import parse_documents
from .functions.scalar import normal_id
from .operators import filters, graph, mutate, query, render, validate
from .plans.kdl import SchemaError
from .plans.schema import Schema
from .plans.users import Users
from .sources.files import scan, write_files

VERSION = "2024-11-05"


class Tools:
    """Each public method is a tool; its arguments are the tool's."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _docs(self, dir: str, pattern: str = "*.md"):
        return parse_documents(scan(self.spark, dir, pattern))

    def _one(self, dir: str, path: str):
        return self._docs(dir).filter(F.col("path") == path)

    def _changed(self, dir: str, new, write: bool) -> str:
        if write:
            write_files(new, dir)
        return render.rows(new, "json")

    def validate(self, dir: str, schema: str, users: str | None = None, path: str | None = None) -> str:
        docs = self._docs(dir)
        some = docs if path is None else docs.filter(F.col("path") == path)
        return render.report(validate.validate(some, Schema.read(schema), Users.read(users) if users else None, files=docs, single=path is not None), "json")

    def get(self, dir: str, path: str, field: str | None = None, section: list[str] | None = None, column: str | None = None, row: int | None = None) -> str:
        d = self._one(dir, path)
        if field is not None:
            out = d.select(filters.shown(field).alias("value"))
        elif section is not None and column is not None:
            found = query.tables(d, section)
            out = query.column(found, column) if row is None else query.cell(found, column, row)
        elif section is not None:
            out = query.section(d, section).select("section.heading", "section.content")
        else:
            out = query.documents_json(d)
        return render.rows(out, "json")

    def list(self, dir: str, filter: list[str] | None = None, sort: str | None = None, fields: list[str] | None = None) -> str:
        out = query.listing(self._docs(dir), *map(filters.parse, filter or []), sort=sort, fields=fields or ["type", "title", "status"])
        return render.rows(out, "json")

    def inspect(self, dir: str, path: str, schema: str) -> str:
        docs = self._docs(dir)
        some = docs.filter(F.col("path") == path)
        return render.rows(query.inspect(some, validate.validate(some, Schema.read(schema), files=docs, single=True)), "json")

    def describe(self, schema: str, what: str = "overview", type: str | None = None) -> str:
        return render.rows(query.describe(self.spark, Schema.read(schema), what, type), "json")

    def set(self, dir: str, path: str, fields: dict | None = None, section: list[str] | None = None, content: str | None = None, append: bool = False, write: bool = False) -> str:
        d = self._one(dir, path)
        if section is not None:
            new = (mutate.append_section if append else mutate.replace_section)(d, section, content or "")
        else:
            new = mutate.set_fields(d, fields or {})
        return self._changed(dir, new, write)

    def new(self, dir: str, schema: str, type: str, fields: dict | None = None, write: bool = False) -> str:
        s = Schema.read(schema)
        return self._changed(dir, mutate.new_document(self.spark, graph.nodes(self._docs(dir), s), s, type, fields), write)

    def refs(self, dir: str, schema: str, id: str, backward: bool = False, depth: int = 1) -> str:
        s, docs = Schema.read(schema), self._docs(dir)
        seeds = self.spark.createDataFrame([(normal_id(id),)], "id string")
        found = graph.walk(graph.edges(docs, s), seeds, depth, backward)
        return render.rows(graph.with_peers(found, graph.nodes(docs, s), "from" if backward else "to").orderBy("depth", "from", "to", "relation"), "json")

    def graph(self, dir: str, schema: str, check: bool = False, format: str = "json") -> str:
        s, docs = Schema.read(schema), self._docs(dir)
        e, n = graph.edges(docs, s), graph.nodes(docs, s)
        if check:
            return render.rows(graph.health(e, n, s), "json")
        if format in ("mermaid", "dot"):
            return "\n".join(r.line for r in getattr(graph, format)(e, n).collect())
        return json.dumps({"nodes": json.loads(render.rows(n.orderBy("id"), "json")), "edges": json.loads(render.rows(e.orderBy("from", "ord"), "json"))}, ensure_ascii=False)

    def deprecate(self, dir: str, schema: str, path: str, superseded_by: str | None = None, write: bool = False) -> str:
        docs = self._docs(dir)
        new = json.loads(self._changed(dir, mutate.deprecate(docs, path, superseded_by), write))
        back = graph.refs_to(graph.edges(docs, Schema.read(schema)), path).orderBy("from", "relation")
        return json.dumps({"changed": new, "backlinks": json.loads(render.rows(back, "json"))}, ensure_ascii=False)


NAMES = ("validate", "get", "list", "inspect", "describe", "set", "new", "refs", "graph", "deprecate")


def tools() -> list[dict]:
    """What each tool takes, from its signature."""
    import inspect

    kinds = {"str": "string", "int": "integer", "bool": "boolean", "dict": "object", "list[str]": "array"}
    out = []
    for name in NAMES:
        params = [p for p in inspect.signature(getattr(Tools, name)).parameters.values() if p.name != "self"]
        props = {p.name: {"type": kinds[str(p.annotation).split(" |")[0]]} for p in params}
        out.append({"name": name, "inputSchema": {"type": "object", "properties": props, "required": [p.name for p in params if p.default is inspect.Parameter.empty]}})
    return out


def answer(session: Tools, line: str) -> dict | None:
    """The response to a request line; None to a notification."""
    try:
        ask = json.loads(line)
    except ValueError:
        return _error(None, -32700, "not JSON")
    if not isinstance(ask, dict) or not isinstance(ask.get("method"), str):
        return _error(ask.get("id") if isinstance(ask, dict) else None, -32600, "not a request")
    if "id" not in ask:
        return None
    methods: dict[str, Callable] = {
        "initialize": lambda p: {"protocolVersion": VERSION, "capabilities": {"tools": {}}, "serverInfo": {"name": "inkwell", "version": "1"}},
        "ping": lambda p: {},
        "tools/list": lambda p: {"tools": tools()},
        "tools/call": lambda p: _call(session, p),
    }
    run = methods.get(ask["method"])
    if run is None:
        return _error(ask["id"], -32601, f"no method {ask['method']}")
    return {"jsonrpc": "2.0", "id": ask["id"], "result": run(ask.get("params") or {})}


def _error(id_, code: int, text: str) -> dict:
    return {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": text}}


def _call(session: Tools, params: dict) -> dict:
    name = params.get("name")
    try:
        if name not in NAMES:
            raise ValueError(f"no tool {name!r}")
        text, bad = getattr(session, name)(**(params.get("arguments") or {})), False
    except (SchemaError, ValueError, TypeError, OSError, KeyError) as e:
        text, bad = f"{type(e).__name__}: {e}", True
    return {"content": [{"type": "text", "text": text}], "isError": bad}


def serve(spark: SparkSession, lines=sys.stdin, out=sys.stdout) -> None:
    session = Tools(spark)
    for line in lines:
        if line.strip():
            reply = answer(session, line)
            if reply is not None:
                print(json.dumps(reply, ensure_ascii=False), file=out, flush=True)


__all__ = ["NAMES", "Tools", "answer", "serve", "tools"]
