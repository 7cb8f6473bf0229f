"""A reader of the part of KDL that schemas need: nodes, arguments, properties, children, comments."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class SchemaError(ValueError):
    """A schema, users file or argument that makes no sense."""


@dataclass
class Node:
    name: str
    args: list = field(default_factory=list)
    props: dict = field(default_factory=dict)
    children: list["Node"] | None = None


_TOKEN = re.compile(
    r"""(?P<space>(?:[ \t﻿]|\\[ \t]*(?://[^\n]*)?\r?\n)+)|(?P<end>[\r\n;]+)|(?P<line>//[^\n]*)|(?P<block>/\*.*?\*/)|(?P<dash>/-)
    |(?P<raw>(?P<hash>\#+)"(?P<rawtext>.*?)"(?P=hash))|(?P<string>"(?:[^"\\]|\\.)*")|(?P<open>\{)|(?P<close>\})|(?P<equals>=)|(?P<word>[^\s{}()\[\]"=;/\\]+)""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "s": " ", "b": "\b", "f": "\f", '"': '"', "\\": "\\", "/": "/"}
_WORDS = {"#true": True, "#false": False, "#null": None, "true": True, "false": False, "null": None}


def _text(token: str) -> str:
    body = re.sub(r"\\u\{([0-9A-Fa-f]+)\}", lambda m: chr(int(m[1], 16)), token[1:-1])
    return re.sub(r"\\(\s+|.)", lambda m: "" if m[1].isspace() else _ESCAPES.get(m[1], m[1]), body, flags=re.DOTALL)


def _word(token: str):
    if token in _WORDS:
        return _WORDS[token]
    if re.fullmatch(r"[-+]?\d[\d_]*", token):
        return int(token.replace("_", ""))
    if re.fullmatch(r"[-+]?\d[\d_]*\.\d[\d_]*(?:[eE][-+]?\d+)?|[-+]?\d+[eE][-+]?\d+", token):
        return float(token.replace("_", ""))
    return token


def parse(text: str) -> list[Node]:
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SchemaError(f"line {text.count(chr(10), 0, at) + 1}: unexpected {text[at]!r}")
        at = m.end()
        kind = m.lastgroup if m.lastgroup not in ("hash", "rawtext") else "raw"
        if kind == "string":
            tokens.append(("value", _text(m[0])))
        elif kind == "raw" or m["raw"]:
            tokens.append(("value", m["rawtext"]))
        elif kind == "word":
            tokens.append(("word", m[0]))
        elif kind not in ("space", "line", "block"):
            tokens.append((kind, m[0]))
    nodes, rest = _nodes(tokens, 0, False)
    if rest < len(tokens):
        raise SchemaError("unexpected }")
    return nodes


def _nodes(tokens, i: int, nested: bool) -> tuple[list[Node], int]:
    out = []
    while i < len(tokens):
        kind, text = tokens[i]
        if kind == "end":
            i += 1
        elif kind == "close":
            if not nested:
                return out, i
            return out, i + 1
        else:
            skip = kind == "dash"
            if skip:
                i += 1
                kind, text = tokens[i]
            if kind not in ("word", "value"):
                raise SchemaError(f"a node cannot begin with {text!r}")
            node = Node(text)
            i += 1
            while i < len(tokens) and tokens[i][0] not in ("end", "close"):
                drop = tokens[i][0] == "dash"
                i += drop
                kind, text = tokens[i]
                if kind == "open":
                    children, i = _nodes(tokens, i + 1, True)
                    node.children = node.children if drop else children
                    break
                if kind not in ("word", "value"):
                    raise SchemaError(f"unexpected {text!r} in node {node.name!r}")
                if i + 1 < len(tokens) and tokens[i + 1][0] == "equals":
                    k, v = tokens[i + 2] if i + 2 < len(tokens) else ("", "")
                    if k not in ("word", "value"):
                        raise SchemaError(f"property {text!r} of {node.name!r} has no value")
                    if not drop:
                        node.props[text] = _word(v) if k == "word" else v
                    i += 3
                else:
                    if not drop:
                        node.args.append(_word(text) if kind == "word" else text)
                    i += 1
            if not skip:
                out.append(node)
    if nested:
        raise SchemaError("a { has no }")
    return out, i
