"""Raw documents to typed rows, by Arrow batches."""

from __future__ import annotations

from json.encoder import encode_basestring

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import frontmatter as fm
from .markdown import body_links, parse_body
from .scalar import path_to_id

VALUE = "struct<kind:string,display:string,json:string,items:array<struct<kind:string,value:string>>>"
SECTION = {
    "ord": "int", "parent": "int", "level": "int", "heading": "string", "line": "int", "path": "array<string>", "raw": "string", "content": "string",
    "n_paragraphs": "int", "n_lists": "int", "n_items": "int", "code_infos": "array<string>", "text": "string", "tables": "array<struct<headers:array<string>,rows:array<array<string>>>>",
}
HEAD = f"fm_state string, parse_error string, fields map<string,{VALUE}>, body string, body_line_offset int"


def body_type(of: list[str] | None = None) -> str:
    """Of sections and links; of each section all fields, or some."""
    return f"sections array<struct<{','.join(f'{k}:{t}' for k, t in SECTION.items() if of is None or k in of)}>>, links array<string>"


def value_of(v) -> dict:
    if type(v) is str:
        return {"kind": "string", "display": v, "json": encode_basestring(v), "items": None}
    items = [{"kind": fm.kind(x), "value": fm.display(x)} for x in v] if isinstance(v, list) else None
    return {"kind": fm.kind(v), "display": fm.display(v), "json": fm.to_json(v), "items": items}


#: Rows, and characters of text, whose parsed values are held at once: a task's memory depends
#: neither on the session's size of batches nor on the table.
ROWS, CHARS = 256, 1 << 20


def slices(batch: pa.RecordBatch, col: str):
    """The batch in pieces of no more than ROWS rows, and of CHARS characters but for longer texts."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(col))), 0).to_pylist()
    at = held = 0
    for i, n in enumerate(sizes):
        if i > at and (i - at == ROWS or held + n > CHARS):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield batch.slice(at)


def _mapped(df: DataFrame, col: str, schema: str, make, only: list[str] | None = None) -> DataFrame:
    """df with the struct that ``make`` gives for the column's texts as more columns; of all
    columns ``only`` some, so that the others are not sent back."""
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = lambda fields: [f for f in fields if only is None or f.name in only]
    old, more = wanted(df.schema.fields), T.StructType(wanted(T._parse_datatype_string(schema).fields))
    kinds = [to_arrow_schema(more).field(i).type for i in range(len(more.fields))]
    held, names = [f.name for f in old], [f.name for f in more.fields]

    def run(batches):
        for whole_batch in batches:
            for x in slices(whole_batch, col):
                column = lambda n: x.column(x.schema.get_field_index(n))  # noqa: E731, B023
                rows = [make(t) for t in column(col).to_pylist()]
                cols = [pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)]
                del rows
                yield pa.RecordBatch.from_arrays([*map(column, held), *cols], [*held, *names])
                del cols

    return df.mapInArrow(run, T.StructType([*old, *more.fields]))


#: Bytes of input a core from which a table has splits enough by itself.
SPLIT = 16 << 20


def dealt(files: DataFrame) -> DataFrame:
    """The rows dealt out to all cores where the plan's estimate is of little data (a few
    splits, which would be parsed by as many tasks); larger tables are read as they are."""
    if files.isStreaming:
        return files
    cores = files.sparkSession.sparkContext.defaultParallelism
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return files.repartition(cores) if size < cores * SPLIT else files


def _head(raw: str | None) -> dict:
    state, fields, error, body, offset = fm.parse(raw or "")
    return {"fm_state": state, "parse_error": error, "fields": [(k, value_of(v)) for k, v in sorted(fields.items())], "body": body, "body_line_offset": offset}


def _named() -> dict:
    return {"file_name": F.element_at(F.split("path", "/"), -1), "id": path_to_id(F.col("path"))}


def _promoted(docs: DataFrame) -> DataFrame:
    shown = lambda k: F.try_element_at("fields", F.lit(k)).getField("display")
    return docs.withColumns(_named() | {"type": shown("type"), "title": shown("title"), "status": shown("status")})


def parse_frontmatter(files: DataFrame) -> DataFrame:
    """files (path, raw, ..) with state, fields, body, and the promoted id, type, title, status.

    Null raw is an empty document, without frontmatter.
    """
    return _promoted(_mapped(dealt(files), "raw", HEAD, _head))


def parse_documents(files: DataFrame, only: list[str] | None = None, of: list[str] | None = None) -> DataFrame:
    """As ``parse_frontmatter``, with the sections and links of the bodies, in the same pass.
    With ``only``, of the columns that are read and parsed these (and path and fields) alone;
    with ``of``, of each section these fields alone."""
    linked, kept = only is None or "links" in only, None if of is None else frozenset(of)

    def make(raw):
        head = _head(raw)
        return head | parse_body(head["body"], kept, linked)

    return _promoted(_mapped(dealt(files), "raw", f"{HEAD}, {body_type(of)}", make, only and ["path", "fields", *only]))


GRAPH = "fm_state string, type string, title string, status string, refs array<struct<relation:string,to:string>>, links array<string>"


def parse_graph(files: DataFrame, names: list[str], only: list[str] | None = None) -> DataFrame:
    """What the link graph reads of documents, in one pass: path, id, file_name, state, the
    promoted fields, ``refs`` (of the relation fields ``names``, in their order) and links.
    Neither other fields nor sections are built. ``only`` as in ``parse_documents``."""
    linked = only is None or "links" in only

    def make(raw):
        state, fields, _, body, _ = fm.parse(raw or "")
        refs = [(k, fm.display(x)) for k in names if k in fields for x in (fields[k] if isinstance(fields[k], list) else [fields[k]]) if fm.kind(x) == "string"]
        shown = {k: fm.display(fields[k]) if k in fields else None for k in ("type", "title", "status")}
        return {"fm_state": state, **shown, "refs": refs, "links": body_links(body) if linked else []}

    out = _mapped(dealt(files), "raw", GRAPH, make, only and ["path", "type", "title", "status", *only])
    return out.withColumns(_named())


def frontmatter_json(docs: DataFrame):
    """Column: all frontmatter as one JSON object with sorted keys."""
    pairs = F.transform(F.array_sort(F.map_keys("fields")), lambda k: F.concat(F.to_json(F.struct(k.alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(k.alias("k")))) - 6), F.lit(":"), F.element_at(F.col("fields"), k).getField("json")))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))

