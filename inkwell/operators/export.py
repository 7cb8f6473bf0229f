"""HTML pages: one for each document, and an index."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markdown import Block, blocks, split_lines
from ..functions.scalar import html_escape

_LINK = re.compile(r"(!?)\[((?:[^\[\]\\]|\\.)*)\]\(\s*<?([^\s()<>]*)>?(?:\s+[^)]*)?\)")
_AUTO = re.compile(r"(?<![\"'>=\w])(https?://[^\s<>\"']+[^\s<>\"'.,;:!?)])")


_MARKS = [
    (re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1"), r"<strong>\2</strong>"),
    (re.compile(r"(\*|(?<!\w)_)(?=\S)(.+?)(?<=\S)\1(?!\w)"), r"<em>\2</em>"),
    (re.compile(r"~~(?=\S)(.+?)(?<=\S)~~"), r"<del>\1</del>"),
]


def inline_html(text: str) -> str:
    parts = re.split(r"(`+.+?`+)", text)
    out = []
    for i, p in enumerate(parts):
        if i % 2:
            out.append(f"<code>{html.escape(p.strip('`').strip())}</code>")
            continue
        held: list[str] = []

        def keep(m):
            label = inline_html(m[2])
            safe = m[3] if re.match(r"(?i)(https?|mailto):|[^:]*$", m[3]) else ""
            held.append(f'<img src="{html.escape(safe)}" alt="{html.escape(m[2])}">' if m[1] else f'<a href="{html.escape(safe)}">{label}</a>')
            return f"\0{len(held) - 1}\0"

        p = html.escape(re.sub(r"</?[A-Za-z!][^>]*>", "", _LINK.sub(keep, p)), quote=False)
        p = _AUTO.sub(r'<a href="\1">\1</a>', p)
        for mark, made in _MARKS:
            p = mark.sub(made, p)
        out.append(re.sub("\0(\\d+)\0", lambda m: held[int(m[1])], p))
    return "".join(out)


def _block(b: Block, lines: list[str]) -> str:
    match b.kind:
        case "heading":
            return f"<h{b.level}>{html.escape(b.text)}</h{b.level}>"
        case "paragraph":
            return f"<p>{inline_html(b.text)}</p>"
        case "code":
            inner = lines[b.start + 1 : b.end - 1] if re.match(r" {0,3}(```|~~~)", lines[b.start]) else [x[4:] for x in lines[b.start : b.end]]
            lang = f' class="language-{html.escape(b.info.split()[0])}"' if b.info else ""
            return f"<pre><code{lang}>{html.escape(chr(10).join(inner))}</code></pre>"
        case "list":
            tag = "ol" if re.match(r"\s*\d", lines[b.start]) else "ul"
            return f"<{tag}>" + "".join("<li>" + "".join(_block(c, lines) for c in i.children) + "</li>" for i in b.children) + f"</{tag}>"
        case "quote":
            return "<blockquote>" + "".join(_block(c, lines) for c in b.children) + "</blockquote>"
        case "table":
            row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{inline_html(c)}</{tag}>" for c in cells) + "</tr>"
            return "<table>" + row(b.rows[0], "th") + "".join(row(r, "td") for r in b.rows[1:]) + "</table>"
        case "rule":
            return "<hr>"
    return ""


def to_html(body: str) -> str:
    """Markdown as HTML; raw HTML is left out."""
    lines = split_lines(body)
    return "\n".join(x for x in (_block(b, lines) for b in blocks(lines)) if x)


_KEPT = re.compile(r"(<a\b.*?</a>|<[^>]*>)", re.DOTALL)


def link_ids(page: str, known: list[str]) -> str:
    """Ids of the list in text, outside tags and links, as links to their pages."""
    if not known:
        return page
    ids = re.compile(r"\b(" + "|".join(map(re.escape, sorted(known, key=len, reverse=True))) + r")\b")
    return "".join(x if i % 2 else ids.sub(lambda m: f'<a href="{m[0].lower()}.html">{m[0]}</a>', x) for i, x in enumerate(_KEPT.split(page)))


def mentions(docs: DataFrame, n: DataFrame) -> DataFrame:
    """(path, known): ids of nodes that a document's text or fields name, by a join on the
    words that could be ids (capitals, digits, dashes)."""
    text = F.concat_ws("\n", "body", F.transform(F.map_values("fields"), lambda v: v["display"]))
    words = F.array_union(F.regexp_extract_all(text, F.lit(r"\b[A-Z]+-[0-9]+\b"), F.lit(0)), F.regexp_extract_all(text, F.lit(r"\b[A-Z][A-Z0-9-]*[A-Z0-9]\b"), F.lit(0)))
    return docs.select("path", F.explode(words).alias("id")).join(n.select("id"), "id", "left_semi").groupBy("path").agg(F.collect_set("id").alias("known"))


def pages(docs: DataFrame, e: DataFrame, n: DataFrame | None = None) -> DataFrame:
    """(path, html): frontmatter table, body and backlinks of each document; ids of n are links."""
    back = e.groupBy(F.col("to").alias("id")).agg(F.sort_array(F.collect_set(F.struct("from", "relation"))).alias("back"))
    rows = F.array_join(F.transform(F.array_sort(F.map_keys("fields")), lambda k: F.concat(F.lit("<tr><th>"), html_escape(k), F.lit("</th><td>"), html_escape(F.element_at(F.col("fields"), k)["display"]), F.lit("</td></tr>"))), "")
    at = docs.join(back, "id", "left").select("path", F.coalesce("title", "id").alias("title"), rows.alias("fields"), F.coalesce(F.transform("back", lambda b: F.concat(F.lit('<li><a href="'), F.lower(b["from"]), F.lit('.html">'), b["from"], F.lit("</a> "), b["relation"], F.lit("</li>"))), F.array().cast("array<string>")).alias("back"), "body")
    known = F.array().cast("array<string>")
    at = at.withColumn("known", known) if n is None else at.join(mentions(docs, n), "path", "left").withColumn("known", F.coalesce("known", known))

    def run(batches):
        for x in batches:
            out = []
            for title, fields, back, body, known in zip(*(x.column(c).to_pylist() for c in ("title", "fields", "back", "body", "known")), strict=True):
                t = html.escape(title or "")
                links = f"<section><h2>Backlinks</h2><ul>{''.join(back)}</ul></section>" if back else ""
                out.append(f'<!doctype html><html><head><meta charset="utf-8"><title>{t}</title></head><body>{link_ids(f"<table>{fields}</table>" + to_html(body or ""), known)}{links}</body></html>')
            yield pa.RecordBatch.from_arrays([x.column("path"), pa.array(out, pa.string())], ["path", "html"])

    return at.mapInArrow(run, "path string, html string")


def index(n: DataFrame) -> DataFrame:
    """(type, html): a list of each type's documents; without a type they are ``other``."""
    entry = F.concat(F.lit('<li><a href="'), F.lower("id"), F.lit('.html">'), html_escape(F.coalesce("title", "id")), F.lit("</a></li>"))
    grouped = n.groupBy(F.coalesce("type", F.lit("other")).alias("type")).agg(F.sort_array(F.collect_list(F.struct("id", entry.alias("entry")))).alias("es"))
    return grouped.select("type", F.concat(F.lit("<h2>"), html_escape(F.col("type")), F.lit("</h2><ul>"), F.array_join(F.transform("es", lambda x: x["entry"]), ""), F.lit("</ul>")).alias("html"))


def site(docs: DataFrame, e: DataFrame, n: DataFrame, out: str) -> None:
    """Pages and index.html under ``out``, a folder that executors share."""
    from ..sources.files import write_files

    write_files(pages(docs, e, n), out, "html", ".html")
    lists = index(n).orderBy("type").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("type", "html"))), lambda x: x["html"]), "").alias("html"))
    write_files(lists.select(F.lit("index.html").alias("path"), F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"><title>Documents</title></head><body>'), F.coalesce("html", F.lit("")), F.lit("</body></html>")).alias("html")), out, "html")
