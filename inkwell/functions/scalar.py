"""Column functions: built-in expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (trim takes blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def path_to_id(path: Column) -> Column:
    """File stem, upper case, dashes for underscores; only LETTERS-DIGITS where it begins so."""
    stem = F.upper(F.replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", ""), F.lit("_"), F.lit("-")))
    head = F.regexp_extract(stem, r"^[A-Z]*-[0-9]+", 0)
    return F.when(head != "", head).otherwise(stem)


def normal_id(text: str) -> str:
    """An id as it is typed, or a path, as an id."""
    if "/" in text or text.endswith(".md"):
        stem = text.rsplit("/", 1)[-1].removesuffix(".md").upper().replace("_", "-")
        m = re.match(r"[A-Z]*-[0-9]+", stem)
        return m[0] if m else stem
    return text.upper().replace("_", "-")


def is_string_id(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z]+[-_][0-9]+\z")


def split_lines(c: Column) -> Column:
    """Lines of a text, without an empty one after the last line end."""
    parts = F.split(c, r"\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def quote(text: str) -> str:
    """The text as a regular expression of Java that matches it."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def dialect(pattern: str) -> str:
    """A linear-time expression in Java's dialect: ``$`` is the end of the text, classes are Unicode's."""
    if re.search(r"\(\?<?[=!]|\\[1-9]", pattern):
        raise ValueError("look-around and back-references are not allowed")
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(pattern[i : i + 2])
            i += 2
            continue
        inside = (inside or c == "[") and c != "]"
        out.append("\\z" if c == "$" and not inside else c)
        i += 1
    return "(?U)" + "".join(out)


def highlight(c: Column, query: str, case_sensitive: bool = False) -> Column:
    """Each match between asterisks."""
    return F.regexp_replace(c, ("" if case_sensitive else "(?iu)") + "(" + quote(query) + ")", "*$1*")


def contains(c: Column, query: str, case_sensitive: bool = False) -> Column:
    return F.contains(c, F.lit(query)) if case_sensitive else F.contains(F.lower(c), F.lit(query.lower()))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def closest(value: Column, candidates: list[str], limit: Column) -> Column:
    """The candidate of least edit distance, the first of equals; null beyond the limit."""
    ranked = F.array_min(F.array(*[F.struct(F.levenshtein(value, F.lit(c)).alias("d"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(candidates)]))
    return F.when(ranked.getField("d") <= limit, ranked.getField("c"))


def json_field(json: Column, path: str) -> Column:
    """Dotted path through objects; arrays have no fields."""
    quoted = "".join(f"['{p}']" for p in path.split("."))
    return F.try_variant_get(F.try_parse_json(json), "$" + quoted, "string")
