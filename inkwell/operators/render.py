"""Collected results as text: fields, sections, tables, lists and reports. For results that fit the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from ..functions.markdown import blocks, plain, split_lines

FORMATS = ("text", "markdown", "json", "compact")


def choose(name: str | None, terminal: bool) -> str:
    """``auto`` is text at a terminal, and JSON elsewhere."""
    if name in (None, "auto"):
        return "text" if terminal else "json"
    if name not in FORMATS:
        raise ValueError(f"format is one of auto, {', '.join(FORMATS)}")
    return name


def strip_markdown(text: str) -> str:
    return "\n\n".join(plain(b.text.replace("\n", " ")) for t in blocks(split_lines(text)) for b in t.walk() if b.kind in ("paragraph", "heading"))


def value(shown: str, as_json: str, fmt: str) -> str:
    return as_json if fmt == "json" else shown


def section(heading: str, level: int, content: str, fmt: str) -> str:
    match fmt:
        case "json":
            return json.dumps({"heading": heading, "level": level, "content": content}, ensure_ascii=False)
        case "markdown":
            return f"{'#' * level} {heading}\n{content}"
    return strip_markdown(content)


def table(headers: list[str], rows: list[list[str]], fmt: str) -> str:
    """Markdown, a list of objects, or columns as many characters wide as their longest cell has bytes."""
    match fmt:
        case "json":
            return json.dumps([dict(zip(headers, r, strict=False)) for r in rows], ensure_ascii=False)
        case "markdown":
            from .mutate import table_markdown

            return "\n".join(table_markdown(headers, rows))
        case "compact":
            return "\n".join("\t".join(r) for r in [headers, *rows])
    size = lambda x: len(x.encode())
    wide = [max(size(r[i]) if i < len(r) else 0 for r in [headers, *rows]) for i in range(len(headers))]
    line = lambda r: " | ".join(c.ljust(w) for c, w in zip([*r, *[""] * len(headers)], wide, strict=False))
    return "".join(f"{x}\n" for x in [line(headers), "-+-".join("-" * w for w in wide), *map(line, rows)])


def rows(df: DataFrame, fmt: str) -> str:
    """Any small result."""
    got = df.collect()
    if fmt == "json":
        return json.dumps([r.asDict(recursive=True) for r in got], ensure_ascii=False, default=str)
    cells = [["" if v is None else str(v) for v in r] for r in got]
    return table(df.columns, cells, fmt)


def report(diagnostics: DataFrame, fmt: str) -> str:
    """Diagnostics by file; files without any are left out. JSON: files, errors, warnings, ok."""
    got = diagnostics.orderBy("path", "stage", "o1", "o2").collect()
    errors = sum(r.severity == "error" for r in got)
    warnings = sum(r.severity == "warning" for r in got)
    if fmt == "compact":
        return "\n".join(":".join((r.path, r.code, r.severity, r.location, r.message)) for r in got)
    by: dict[str, list] = {}
    for r in got:
        by.setdefault(r.path, []).append(r)
    if fmt == "json":
        files = [{"path": p, "diagnostics": [{k: r[k] for k in ("severity", "code", "message", "location", "hint")} for r in d]} for p, d in by.items()]
        return json.dumps({"files": files, "errors": errors, "warnings": warnings, "ok": errors == 0}, ensure_ascii=False)
    out = []
    for p, d in by.items():
        out += [p, *[f"  {r.severity} {r.code} at {r.location}: {r.message}" + (f" ({r.hint})" if r.hint else "") for r in d]]
    return "\n".join([*out, f"{errors} errors, {warnings} warnings"])
