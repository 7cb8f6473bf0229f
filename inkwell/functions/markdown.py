"""Markdown blocks in plain Python: headings, paragraphs, lists, code, quotes, tables, links.

A subset of CommonMark with GFM tables, without Spark. Every block knows its
lines (0-based, end exclusive), so sections are slices of the original text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})(.*)$")
_RULE = re.compile(r"^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_QUOTE = re.compile(r"^ {0,3}> ?")
_ITEM = re.compile(r"^( {0,3})([-+*]|\d{1,9}[.)])(?=[ \t]|$)([ \t]*)")
_HTML = re.compile(r"^ {0,3}<(?:/?[A-Za-z][\w-]*(?=[\s/>]|$)|!--|\?|![A-Z])")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_DELIMITER = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_DEFINITION = re.compile(r"^ {0,3}\[([^\]]+)\]:[ \t]*<?([^\s>]+)>?(?:[ \t]+[\"'(].*[\"')])?[ \t]*$")


@dataclass(eq=False, slots=True)  # compared by identity: index() is called for each heading
class Block:
    kind: str  # heading, paragraph, code, list, item, quote, table, html, rule, definition
    start: int
    end: int
    level: int = 0
    text: str = ""
    info: str = ""
    setext: bool = False
    rows: list[list[str]] = field(default_factory=list)
    children: list["Block"] = field(default_factory=list)

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()


def split_row(line: str) -> list[str]:
    """Cells of a table row: outer pipes dropped, ``\\|`` is a bar."""
    s = line.strip()
    if s.startswith("|"):
        s = s[1:]
    if "\\" not in s:
        *cells, last = [c.strip() for c in s.split("|")]
        return [*cells, last] if last or not s.endswith("|") else cells
    cells, cell, i = [], [], 0
    while i < len(s):
        if s[i] == "\\" and i + 1 < len(s) and s[i + 1] == "|":
            cell.append("|")
            i += 2
        elif s[i] == "|":
            cells.append("".join(cell).strip())
            cell = []
            i += 1
        else:
            cell.append(s[i])
            i += 1
    if "".join(cell).strip() or not s.endswith("|"):
        cells.append("".join(cell).strip())
    return cells


def _marked(line: str) -> bool:
    """Whether the line begins as blocks other than paragraphs may."""
    c = line.lstrip(" ")[:1]
    return c in "#`~>-*_<+[" or c.isdecimal()


def _interrupts(line: str) -> bool:
    if not _marked(line):
        return False
    m = _ITEM.match(line)
    item = m and line[m.end() :].strip() and (not m[2][0].isdigit() or m[2][:-1] == "1")
    return bool(_ATX.match(line) or _FENCE.match(line) or _QUOTE.match(line) or _RULE.match(line) or _HTML.match(line) or item)


def blocks(lines: list[str], base: int = 0) -> list[Block]:
    """Blocks of the lines; ``base`` is the number of the first one."""
    out: list[Block] = []
    n, i = len(lines), 0
    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
            continue
        if line.startswith(("    ", "\t")):
            j = k = i
            while j < n and (not lines[j].strip() or lines[j].startswith(("    ", "\t"))):
                if lines[j].strip():
                    k = j
                j += 1
            out.append(Block("code", base + i, base + k + 1))
            i = k + 1
            continue
        if not _marked(line):
            i = _paragraph(lines, i, base, out)
            continue
        m = _FENCE.match(line)
        if m and not (m[2][0] == "`" and "`" in m[3]):
            j = i + 1
            close = re.compile(rf"^ {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$")
            while j < n and not close.match(lines[j]):
                j += 1
            out.append(Block("code", base + i, base + min(j + 1, n), info=m[3].strip()))
            i = j + 1
            continue
        m = _ATX.match(line)
        if m:
            out.append(Block("heading", base + i, base + i + 1, level=len(m[1]), text=plain(m[2] or "")))
            i += 1
            continue
        if _RULE.match(line):
            out.append(Block("rule", base + i, base + i + 1))
            i += 1
            continue
        if _QUOTE.match(line):
            j, inner = i, []
            while j < n and (_QUOTE.match(lines[j]) or (lines[j].strip() and inner and inner[-1].strip() and not _interrupts(lines[j]))):
                inner.append(_QUOTE.sub("", lines[j], count=1))
                j += 1
            out.append(Block("quote", base + i, base + j, children=blocks(inner, base + i)))
            i = j
            continue
        if _ITEM.match(line):
            node, i = _list(lines, i, base)
            out.append(node)
            continue
        if _HTML.match(line):
            j = i
            while j < n and lines[j].strip():
                j += 1
            out.append(Block("html", base + i, base + j))
            i = j
            continue
        if _DEFINITION.match(line):
            m = _DEFINITION.match(line)
            out.append(Block("definition", base + i, base + i + 1, text=m[1].lower(), info=m[2]))
            i += 1
            continue
        i = _paragraph(lines, i, base, out)
    return out


def _paragraph(lines: list[str], i: int, base: int, out: list[Block]) -> int:
    n, j = len(lines), i
    while j < n and lines[j].strip():
        if j + 1 < n and "|" in lines[j] and "-" in lines[j + 1] and _DELIMITER.match(lines[j + 1]) and len(split_row(lines[j])) == len(split_row(lines[j + 1])):
            if j > i:
                out.append(Block("paragraph", base + i, base + j, text="\n".join(lines[i:j])))
            head = split_row(lines[j])
            k, rows = j + 2, []
            while k < n and lines[k].strip() and not _interrupts(lines[k]):
                cells = split_row(lines[k])[: len(head)]
                rows.append([plain(c) for c in cells] + [""] * (len(head) - len(cells)))
                k += 1
            out.append(Block("table", base + j, base + k, rows=[[plain(c) for c in head], *rows]))
            return k
        if j > i:
            m = _SETEXT.match(lines[j])
            if m:
                out.append(Block("heading", base + i, base + j + 1, level=1 if m[1][0] == "=" else 2, text=plain(" ".join(x.strip() for x in lines[i:j])), setext=True))
                return j + 1
            if _interrupts(lines[j]):
                break
        j += 1
    out.append(Block("paragraph", base + i, base + j, text="\n".join(lines[i:j])))
    return j


def _list(lines: list[str], i: int, base: int) -> tuple[Block, int]:
    """A list from line i on; the line after it."""
    n = len(lines)
    kind = lambda marker: marker[-1] if marker[0].isdigit() else marker
    m = _ITEM.match(lines[i])
    mark, start, items = kind(m[2]), i, []
    while i < n:
        m = _ITEM.match(lines[i])
        if not m or kind(m[2]) != mark or _RULE.match(lines[i]):
            break
        gap = len(m[3].expandtabs(4))
        offset = len(m[1]) + len(m[2]) + (gap if 1 <= gap <= 4 else 1)
        inner = [lines[i][min(offset, len(lines[i])) :]]
        j = i + 1
        while j < n:
            x = lines[j]
            if not x.strip():
                k = j
                while k < n and not lines[k].strip():
                    k += 1
                if k < n and len(lines[k]) - len(lines[k].lstrip(" ")) >= offset:
                    inner += [""] * (k - j)
                    j = k
                    continue
                break
            if len(x) - len(x.lstrip(" ")) >= offset:
                inner.append(x[offset:])
            elif inner[-1].strip() and not _ITEM.match(x) and not _interrupts(x):
                inner.append(x.lstrip())
            else:
                break
            j += 1
        items.append(Block("item", base + i, base + j, children=blocks(inner, base + i)))
        k = j
        while k < n and not lines[k].strip():
            k += 1
        i = j
        if k < n and k > j and _ITEM.match(lines[k]) and kind(_ITEM.match(lines[k])[2]) == mark:
            i = k
    return Block("list", base + start, items[-1].end, children=items), i


_INLINE = re.compile(
    r"(?P<esc>\\[!-/:-@\[-`{-~])|(?P<tick>`+)(?P<code>.+?)(?<!`)(?P=tick)(?!`)|<(?P<auto>[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[^\s<>@]+@[^\s<>@]+\.[^\s<>@]+)>"
    r"|(?P<img>!)?\[(?P<label>(?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\](?:\([ \t]*<?(?P<url>[^\s()<>]*(?:\([^\s()]*\)[^\s()<>]*)*)>?(?:[ \t]+[\"'(][^)]*[\"')])?[ \t]*\)|\[(?P<ref>[^\]]*)\])?",
    re.DOTALL,
)
_INLINE_MARK = re.compile(r"[\\`<\[*_~]")
_EMPHASIS = re.compile(r"(\*{1,3}|(?<![^\W_])_{1,3}|~~)(?=\S)(.+?)(?<=\S)\1", re.DOTALL)


def plain(text: str, definitions: dict[str, str] | None = None) -> str:
    """Text of an inline run, without marks."""

    def put(m):
        if m["esc"]:
            return m["esc"][1]
        if m["code"] is not None:
            return m["code"].strip() if m["code"].strip() else m["code"]
        if m["auto"]:
            return m["auto"]
        if m["url"] is not None or m["ref"] is not None or (definitions and m["label"].lower() in definitions):
            return plain(m["label"], definitions)
        return m[0]

    if not _INLINE_MARK.search(text):
        return text
    last = None
    text = _INLINE.sub(put, text)
    while last != text:
        last, text = text, _EMPHASIS.sub(r"\2", text)
    return text


def links(text: str, definitions: dict[str, str]) -> list[str]:
    """Targets of the links of an inline run, in order; not those of images."""
    if "[" not in text and "<" not in text:
        return []
    out = []
    for m in _INLINE.finditer(text):
        if m["auto"]:
            out.append(("mailto:" if "@" in m["auto"] and ":" not in m["auto"] else "") + m["auto"])
        elif m["label"] is not None and not m["img"]:
            if m["url"] is not None:
                out.append(m["url"])
            elif (m["ref"] or m["label"]).lower() in definitions:
                out.append(definitions[(m["ref"] or m["label"]).lower()])
        elif m["img"] and m["label"] is not None:
            out += links(m["label"], definitions) if "](" in m["label"] else []
    return out


def split_lines(text: str) -> list[str]:
    """Lines without their ends; no empty one after the last end."""
    lines = text.replace("\r\n", "\n").split("\n")
    return lines[:-1] if lines and not lines[-1] else lines


def _slice(lines: list[str], a: int, b: int, body: str) -> str:
    """Lines with their ends; the body's last one as it is."""
    if a >= b:
        return ""
    return "\n".join(lines[a:b]) + ("\n" if b < len(lines) or body.endswith("\n") else "")


def _definitions(every: list[Block]) -> dict[str, str]:
    out: dict[str, str] = {}
    for b in every:
        if b.kind == "definition":
            out.setdefault(b.text, b.info)
    return out


def _targets(lines: list[str], every: list[Block], definitions: dict[str, str]) -> list[str]:
    out = []
    for b in every:
        if b.kind == "paragraph":
            out += links(b.text, definitions)
        elif b.kind == "heading":
            out += links(lines[b.start], definitions)
        elif b.kind == "table":
            out += [x for k in range(b.start, b.end) for x in links(lines[k], definitions)]
    return out


def body_links(body: str) -> list[str]:
    """The links that ``parse_body`` gives, without the sections."""
    if "[" not in body and "<" not in body:
        return []
    lines = split_lines(body)
    every = [b for t in blocks(lines) for b in t.walk()]
    return _targets(lines, every, _definitions(every))


def parse_body(body: str, of: frozenset[str] | None = None, linked: bool = True) -> dict:
    """Headings, sections, links of a body. See ``functions.parse`` for the types. With ``of``,
    texts of sections (raw, content, text) that are not among these are left out."""
    if not body:
        return {"sections": [], "links": []}
    lines = split_lines(body)
    top = blocks(lines)
    every = [b for t in top for b in t.walk()]
    definitions = _definitions(every)
    found: list[tuple[Block, list[Block]]] = []  # heading, its siblings
    raw, content, text = (of is None or k in of for k in ("raw", "content", "text"))

    def gather(siblings: list[Block]):
        for b in siblings:
            if b.kind == "heading":
                found.append((b, siblings))
            gather(b.children)

    gather(top)
    sections, opened = [], []
    for ord_, (h, siblings) in enumerate(found):
        at = siblings.index(h)
        last = next((s for s in siblings[at + 1 :] if s.kind == "heading" and s.level <= h.level), None)
        end = last.start if last else (len(lines) if siblings is top else max(s.end for s in siblings))
        inside = [b for s in siblings[at + 1 :] if s.start < end for b in s.walk()]
        while opened and (opened[-1][1] is not siblings or opened[-1][0].level >= h.level):
            opened.pop()
        parent = next((o[2] for o in reversed(opened) if o[0].level == h.level - 1 and o[1] is siblings), None)
        parent = parent if opened and opened[-1][2] == parent else None
        path = [*sections[parent]["path"], h.text] if parent is not None else [h.text]
        opened.append((h, siblings, ord_))
        sections.append(
            {
                "ord": ord_, "parent": parent, "level": h.level, "heading": h.text, "line": h.start + 1, "path": path,
                "raw": _slice(lines, h.start, end, body) if raw else None, "content": _slice(lines, h.start + 1, end, body) if content else None,
                # a table counts as a paragraph, and so does the mark under a setext heading
                "n_paragraphs": sum(b.kind in ("paragraph", "table") for b in inside),
                "n_lists": sum(b.kind == "list" for b in inside), "n_items": sum(b.kind == "item" for b in inside),
                "code_infos": [b.info.lower() for b in inside if b.kind == "code"],
                "text": "\n\n".join(plain(" ".join(b.text.split("\n")), definitions) for b in inside if b.kind in ("paragraph", "heading")) if text else None,
                "tables": [{"headers": b.rows[0], "rows": b.rows[1:]} for b in inside if b.kind == "table"],
            }
        )
    return {"sections": sections, "links": _targets(lines, every, definitions) if linked else []}
