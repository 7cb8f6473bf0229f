"""Frontmatter: splitting, YAML 1.2 core values, their display, kinds and rendering."""

from __future__ import annotations

import json
import re

import yaml

Loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)


class CoreLoader(Loader):
    """Only null, booleans and numbers resolve: no dates, no yes and no, no base 60."""


CoreLoader.yaml_implicit_resolvers = {}
for _tag, _expression, _first in (
    ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")),
    ("int", r"^[-+]?(?:0|[1-9][0-9]*)$|^0o[0-7]+$|^0x[0-9a-fA-F]+$", list("-+0123456789")),
    ("float", r"^(?![-+]?0[0-9]+$)[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$|^[-+]?\.(?:inf|Inf|INF)$|^\.(?:nan|NaN|NAN)$", list("-+0123456789.")),
):
    CoreLoader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_expression), _first)
CoreLoader.add_constructor("tag:yaml.org,2002:int", lambda loader, node: int(node.value.replace("0o", "0O"), 0) if node.value[:2] in ("0x", "0o") else int(node.value))
CoreLoader.add_constructor("tag:yaml.org,2002:float", lambda loader, node: float(node.value.replace(".inf", "inf").replace(".nan", "nan").replace(".Inf", "inf").replace(".NaN", "nan")))
CoreLoader.add_multi_constructor("!", lambda loader, suffix, node: loader.construct_scalar(node) if isinstance(node, yaml.ScalarNode) else loader.construct_sequence(node, True) if isinstance(node, yaml.SequenceNode) else loader.construct_mapping(node, True))

KINDS = {bool: "bool", int: "number", float: "number", str: "string", list: "array", dict: "mapping", type(None): "null"}


def kind(value) -> str:
    return KINDS.get(type(value), "string")


def number(value) -> str:
    return str(value) if isinstance(value, int) else (repr(value) if value == value and abs(value) != float("inf") else {"nan": ".nan", "inf": ".inf", "-inf": "-.inf"}[str(value)])


def display(value) -> str:
    """How filters, sorts and diffs see a value."""
    match value:
        case None:
            return "null"
        case bool():
            return "true" if value else "false"
        case int() | float():
            return number(value)
        case list():
            return "[" + ", ".join(map(display, value)) + "]"
        case dict():
            return to_yaml(value)
    return str(value)


def plain_json(value):
    if isinstance(value, dict):
        return {display(k): plain_json(v) for k, v in value.items()}
    if isinstance(value, list):
        return [plain_json(v) for v in value]
    if isinstance(value, float) and (value != value or abs(value) == float("inf")):
        return None
    return value


_JSON = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def to_json(value) -> str:
    return _JSON.encode(plain_json(value))


def to_yaml(value: dict) -> str:
    """Keys sorted, one a line."""
    lines: list[str] = []
    if value and _put_plain(value, "", lines, set()):
        return "".join(lines)
    return slow_yaml(value)


def slow_yaml(value: dict) -> str:
    return yaml.dump(value, Dumper=CoreDumper, sort_keys=True, allow_unicode=True, default_flow_style=False, width=1 << 30) if value else "{}\n"


class CoreDumper(yaml.SafeDumper):
    def increase_indent(self, flow=False, indentless=False):
        return super().increase_indent(flow, False)


# text that readers of either version would take for something else is quoted
CoreDumper.yaml_implicit_resolvers = {c: [*CoreLoader.yaml_implicit_resolvers.get(c, []), *yaml.SafeDumper.yaml_implicit_resolvers.get(c, [])] for c in {*CoreLoader.yaml_implicit_resolvers, *yaml.SafeDumper.yaml_implicit_resolvers}}


# Plain frontmatter (one key a line, with a word, a number, a quoted text, or a list or a map of
# these, in brackets or a line each) is read and rendered without the YAML library, which takes
# longer by far; what is not certainly plain goes to the library, so that both give the same.

_KEY = r"[A-Za-z_][A-Za-z0-9_]{0,99}"
_WORD = r"[A-Za-z0-9](?:[A-Za-z0-9_./#-]|[ ](?=[A-Za-z0-9_./-])){0,999}"
_TEXT = r'"[ !#-\[\]-~¡-῿]*"' + r"|'[ -&(-~¡-῿]*'"
_ONE = f"(?:{_TEXT}|{_WORD})"
_LINE = re.compile(rf"({_KEY}):(?: (?:({_WORD})|({_TEXT})|\[((?:{_ONE}(?:, {_ONE})*)?)\]|\{{((?:{_KEY}: {_ONE}(?:, {_KEY}: {_ONE})*)?)\}}))?")
_NESTED = re.compile(rf"  (?:-|({_KEY}):) ({_ONE})")
_ITEM, _PAIR, _NAME = re.compile(_ONE), re.compile(f"({_KEY}): ({_ONE})"), re.compile(_KEY)
_INT, _NUMERIC = re.compile(r"0|[1-9][0-9]{0,299}"), re.compile(r"[0-9][0-9.eE+-]*|0[ox].*")
_CONSTANTS = {t: {"n": None, "t": True, "f": False}[w[0]] for w in ("null", "true", "false") for t in (w, w.capitalize(), w.upper())}


class _NotPlain(Exception):
    pass


def _scalar(text: str):
    c = text[0]
    if c in "\"'":
        return text[1:-1]
    if "0" <= c <= "9":
        if _INT.fullmatch(text):
            return int(text)
        if _NUMERIC.fullmatch(text):
            raise _NotPlain
    elif c in "nNtTfF" and text in _CONSTANTS:
        return _CONSTANTS[text]
    return text


def plain_fields(block: str) -> dict | None:
    """The fields of plain frontmatter; None if it is not."""
    out: dict = {}
    held: list | dict | None = None
    opened = None  # the key whose lines of items or pairs are read
    try:
        for line in block.split("\n"):
            if line.startswith(" "):
                m = _NESTED.fullmatch(line)
                if m is None or opened is None or m[1] in _CONSTANTS:
                    return None
                if held is None:
                    held = out[opened] = [] if m[1] is None else {}
                if (m[1] is None) is isinstance(held, dict):
                    return None
                if m[1] is None:
                    held.append(_scalar(m[2]))
                else:
                    held[m[1]] = _scalar(m[2])
                continue
            if not line:
                continue
            if opened is not None and held is None:
                return None
            m = _LINE.fullmatch(line)
            if m is None:
                return None
            opened = held = None
            key, word, text, items, pairs = m.groups()
            if key in _CONSTANTS:
                return None
            if word is not None:
                out[key] = _scalar(word)
            elif text is not None:
                out[key] = text[1:-1]
            elif items is not None:
                out[key] = [_scalar(x) for x in _ITEM.findall(items)]
            elif pairs is not None:
                found = _PAIR.findall(pairs)
                if any(k in _CONSTANTS for k, _ in found):
                    return None
                out[key] = {k: _scalar(x) for k, x in found}
            else:
                opened = key
                out.setdefault(key, None)  # a key keeps the place where it came first
    except _NotPlain:
        return None
    return None if opened is not None and held is None else out or None


_END = re.compile(r"^---[ \t]*(?:\r?\n|\Z)", re.MULTILINE)
_BARE = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9_./#-]|[ ](?=[A-Za-z0-9_./-]))*")
_MARKED = re.compile(r"(?:@[A-Za-z0-9_./-]+)?")


def _put_scalar(v) -> str | None:
    match v:
        case None:
            return "null"
        case bool():
            return "true" if v else "false"
        case int():
            return str(v)
        case str():
            if _BARE.fullmatch(v):
                return f"'{v}'" if any(r.match(v) for _, r in CoreDumper.yaml_implicit_resolvers.get(v[0], ())) else v
            return f"'{v}'" if _MARKED.fullmatch(v) else None
    return None


def _put_plain(value: dict, indent: str, lines: list[str], seen: set[int]) -> bool:
    """Lines of a map of plain values, as the library dumps them; False if some are not plain."""
    if not all(type(k) is str and _NAME.fullmatch(k) and _put_scalar(k) == k for k in value):
        return False
    for k in sorted(value):
        v = value[k]
        if isinstance(v, (list, dict)):
            if id(v) in seen:
                return False
            seen.add(id(v))
        if isinstance(v, list) and v:
            items = [_put_scalar(x) for x in v]
            if None in items:
                return False
            lines.append(f"{indent}{k}:\n")
            lines += [f"{indent}  - {x}\n" for x in items]
        elif isinstance(v, dict) and v:
            lines.append(f"{indent}{k}:\n")
            if not _put_plain(v, indent + "  ", lines, seen):
                return False
        else:
            x = "[]" if isinstance(v, list) else "{}" if isinstance(v, dict) else _put_scalar(v)
            if x is None:
                return False
            lines.append(f"{indent}{k}: {x}\n")
    return True


def split(raw: str) -> tuple[str | None, str, int]:
    """(YAML text or None, body, lines before the body)."""
    text = raw[1:] if raw.startswith("﻿") else raw
    head = re.match(r"---[ \t]*\r?\n", text)
    if not head:
        return None, text, 0
    end = _END.search(text, head.end())
    if not end:
        return None, text, 0
    body = text[end.end() :]
    return text[head.end() : end.start()], body, text[: end.end()].count("\n")


def parse(raw: str) -> tuple[str, dict, str | None, str, int]:
    """(state: ok, absent or error; fields; error; body; lines before the body)."""
    block, body, offset = split(raw)
    if block is None:
        return "absent", {}, None, body, 0
    fields = plain_fields(block)
    if fields is not None:
        return "ok", fields, None, body, offset
    try:
        value = yaml.load(block, Loader=CoreLoader)
    except (yaml.YAMLError, ValueError, RecursionError) as e:
        return "error", {}, str(e).split("\n")[0], body, offset
    if value is None:
        value = {}
    if not isinstance(value, dict):
        return "error", {}, "frontmatter is not a mapping", body, offset
    return "ok", {display(k): v for k, v in value.items()}, None, body, offset


def coerce(text: str):
    """A literal of the command line as a value: bool, whole number, number with a point, [list], else text."""
    if text in ("true", "false"):
        return text == "true"
    if re.fullmatch(r"[-+]?\d+", text) and -(1 << 63) <= int(text) < 1 << 63:
        return int(text)
    if "." in text:
        try:
            return float(text)
        except ValueError:
            pass
    if text.startswith("[") and text.endswith("]"):
        try:
            value = yaml.load(text, Loader=CoreLoader)
            if isinstance(value, list):
                return value
        except yaml.YAMLError:
            pass
    return text


def render(fields: dict, body: str) -> str:
    return f"---\n{to_yaml(fields) if fields else ''}---\n{body}"
